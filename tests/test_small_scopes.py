"""Ordered texts of small scopes are made in one group; large and null scopes still pass as blocks, with the same texts."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from sealwright import catalog
from sealwright.functions import ordered
from sealwright.plans.fixtures import VIEWS, Fixtures

COUNTS = {"a": 3, "b": 40, "c": 1, None: 4, "é": 9}


def listing_of(spark):
    rows = [(s, p, f"{n:03d}", f"{s}é{n}{p}") for s, count in COUNTS.items() for n in range(count) for p in (0, 1) if n % 2 >= p]
    rows += [("no glue", 0, "k", "t")]
    return spark.createDataFrame(rows, "s string, part int, key string, text string").repartition(7)


def whole(scope, glue):
    parts = [",".join(f"{scope}é{n}{p}" for n in range(COUNTS.get(scope, 0)) if n % 2 >= p) for p in (0, 1)]
    return glue[0] + parts[0] + glue[1] + parts[1] + glue[2]


@pytest.mark.parametrize("lines, chars", [(10_000, 1_000_000), (10, 1_000_000), (10_000, 50), (0, 0)])
def test_scopes_of_any_size_have_the_same_text(spark, monkeypatch, lines, chars):
    monkeypatch.setattr(ordered, "SCOPE_LINES", lines)
    monkeypatch.setattr(ordered, "SCOPE_CHARS", chars)
    monkeypatch.setattr(ordered, "BLOCK_CHARS", 30)
    glue = {s: [f"<{s}", "|", ">"] for s in (*COUNTS, "empty")}
    table = spark.createDataFrame(list(glue.items()), "s string, glue array<string>")
    rows = ordered.ordered_text(listing_of(spark), ["s"], table, parts=2, chunk_chars=17).collect()
    got: dict = {}
    for row in sorted(rows, key=lambda r: r.chunk):
        got[row.s] = got.get(row.s, "") + row.text
    assert got == {s: whole(s, pieces) for s, pieces in glue.items()}
    assert len({(r.s, r.chunk) for r in rows}) == len(rows) and max(len(r.text) for r in rows) == 17
    digests = {r.s: r.sha256 for r in ordered.ordered_digest(listing_of(spark), ["s"], table, parts=2).collect()}
    assert digests == {s: hashlib.sha256(text.encode()).hexdigest() for s, text in got.items()}


def test_small_scopes_are_not_made_of_blocks(spark, monkeypatch):
    def no_blocks(*args):
        raise AssertionError("blocks")

    monkeypatch.setattr(ordered, "_blocks", no_blocks)
    known = listing_of(spark).filter("s is not null")
    texts = ordered.ordered_text(known.filter("part = 0"), ["s"], ["[", "]"]).collect()
    assert {r.s: r.text for r in texts}["a"] == "[aé00,aé10,aé20]"
    digests = ordered.ordered_digest(known, ["s"], ["", "|", ""], parts=2)
    assert "MapInArrow" not in digests._jdf.queryExecution().optimizedPlan().toString() and digests.count() == 5


def test_a_line_without_text_is_no_empty_line(spark):
    with pytest.raises(Exception, match="a line without text"):
        ordered.ordered_text(listing_of(spark).filter("s is not null").withColumn("text", F.lit(None).cast("string")), ["s"], ["[", "]"]).collect()


def test_heads_of_runs_are_made_once_a_run(spark):
    catalog.queries()
    fixtures = Fixtures(spark, "/root/testdata/sf0.001")
    for name in ("plan_head", "run_head"):
        plan = getattr(fixtures, name)._jdf.queryExecution().optimizedPlan().toString()
        keys = next(line for line in plan.splitlines() if "Aggregate" in line).split("], [")[0]
        assert "run_id" in keys and "sha2" not in keys
        assert sorted(getattr(fixtures, name).collect()) == sorted(fixtures.sql(VIEWS[name]).collect())


def test_the_field_audit_of_nodes_derives_them_once(spark, monkeypatch):
    from sealwright.operators import graph

    passes, keep = [], graph.stored_table
    monkeypatch.setattr(graph, "stored_table", lambda df, label: passes.append(label) or keep(df, label))
    schema = "graph_id string, snapshot_id string, " + ", ".join(f"{name} string" for name in graph.NODE_COLUMNS)
    node = spark.createDataFrame([("g", "s", "n", "source-file", "a\u0301.c", "a\u0301.c", None, "0" * 64, None, None, "x", "{}")], schema)
    found = graph.node_field_audit(node)
    assert passes == ["node-faults"] and "LogicalRDD" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.code, r.detail) for r in found.collect()} >= {("artifact_graph.identity_mismatch", "label nfc"), ("artifact_graph.invalid_path", "path nfc")}
