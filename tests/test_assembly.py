"""Records that the graph cannot take, as findings."""

from __future__ import annotations

from sealwright.operators import graph


def test_assembly_findings(spark, codes):
    def table(schema, *rows):
        return spark.createDataFrame([("g", *row) for row in rows], "graph_id string, " + schema)

    records = {
        "snapshot_file": table("path string, kind string", ("a.c", "file"), ("l", "symlink")),
        "api_artifact": table("path string, kind string", ("p.html", "api-page"), ("s.css", "asset")),
        "symbol_mapping": table(
            "refid string, source_path string, qualified_name string, html_path string, html_anchor string, line string, column string",
            ("ok", "a.c", "f", "p.html", "1", "3", None), ("page", "a.c", "g", "s.css", "2", "07", "0"), ("src", "l", "h", "p.html", "3", "3\n", None),
            ("twin", "a.c", "f", "p.html", "1", None, None), ("twin", "a.c", "f", "p.html", "9", None, None),
        ),
        "coverage_artifact": table("path string", ("r.html",)),
        "coverage_relation": table("report_path string, source_path string, symbol string", ("r.html", "a.c", "f"), ("x.html", "gone.c", None), ("r.html", "a.c", "other")),
        "stage_result": table("stage string, executed boolean", ("run", True), ("skip", False)),
        "stage_output": table("stage string, path string", ("run", "o"), ("none", "o2")),
        "producer_log": table("stage string, path string", ("run", "l1"), ("skip", "l2"), ("none", "l3")),
    }
    got = [(code.split(".")[1], path, detail) for _, code, path, detail in codes(graph.assembly_findings(records))]
    assert sorted(got) == sorted([
        ("missing_endpoint", "page", "page"), ("missing_endpoint", "src", "source"), ("duplicate_node_id", "twin", "reference id"),
        ("duplicate_node_id", "ok", "target"), ("invalid_identity", "page", "line"), ("invalid_identity", "page", "column"), ("invalid_identity", "src", "line"),
        ("ambiguous_relation", "r.html", "symbol"), ("missing_endpoint", "x.html", "report"), ("missing_endpoint", "gone.c", "source"),
        ("missing_endpoint", "o2", "output"), ("missing_endpoint", "l3", "log"), ("stage_output_mismatch", "l2", "log"),
    ])
    clean = {"snapshot_file": records["snapshot_file"]}
    assert codes(graph.assembly_findings(clean)) == []
