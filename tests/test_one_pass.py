"""Digests of several versions of a listing in one pass, lines dealt by slices of their keys, and identities judged once."""

from __future__ import annotations

import hashlib
import os
import time

from pyspark.sql import functions as F

from sealwright import session
from sealwright.functions import ids, ordered
from sealwright.operators import graph


def digest(n) -> str:
    return hashlib.sha256(str(n).encode()).hexdigest()


def test_lines_dealt_by_slices_keep_the_order_of_whole_keys(spark):
    heads = ["edge:sha256:", "node:sha256:"]
    keys = [f"{head}{digest(n)}" for n in range(300) for head in heads] + ["", "a", "edge:sha256:", "edge:sha256:~", "edge:sha256:~~", "edge;", "nodf", "é", "edge:sha256:é1"]
    lines = spark.createDataFrame([(g, k, f"{k}|{t}", 1 + (n % 3)) for g in ("a", "b") for n, k in enumerate(keys) for t in (2, 1)], "g string, k string, t string, held int")
    listing = lines.repartition(5).select("g", F.lit(0).alias("part"), ordered.slice_of(F.col("k"), heads).alias("slice"), "held", "k", "t")
    glue = spark.createDataFrame([("a", ["<", ">"]), ("b", ["<", ">"]), ("none", ["<", ">"])], "g string, glue array<string>")
    told = ordered.ordered_digest(listing, ["g"], glue, late=(F.col("k"), F.col("t")), versions=2)
    assert "rangepartitioning" not in told._jdf.queryExecution().executedPlan().toString().lower()

    def want(bit: int) -> str:
        held = sorted((k.encode(), t) for n, k in enumerate(keys) for t in (f"{k}|2", f"{k}|1") if 1 + n % 3 & bit)
        return hashlib.sha256(("<" + ",".join(t for _, t in held) + ">").encode()).hexdigest()

    none = hashlib.sha256(b"<>").hexdigest()
    assert {r.g: r.sha256 for r in told.collect()} == {"a": [want(1), want(2)], "b": [want(1), want(2)], "none": [none, none]}


def test_quoted_texts_are_the_json_of_a_writer(spark):
    texts = ["", "plain", 'a"b', "back\\slash", "tab\t", "\u001f", "\u007f", "é ", "\\u001F", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ids.members({"t": ids.quoted(F.col("t"))}).alias("own"), ids.canonical({"t": F.col("t")}).alias("want"))
    assert [r.own for r in rows.collect()] == [r.want for r in rows.collect()]


def small_graph(spark):
    snapshot = spark.createDataFrame([("g", "s")], "graph_id string, snapshot_id string")
    files = spark.createDataFrame([("g", "s", f"f{n}", "file", digest(n)) for n in range(3)], "graph_id string, snapshot_id string, path string, kind string, sha256 string")
    reports = spark.createDataFrame(
        [("g", "s", "r.html", digest("r"), True, "r.html", digest("t"), "unknown-origin")],
        "graph_id string, snapshot_id string, path string, sha256 string, entry_point boolean, report_entry_point string, tree_sha256 string, provenance string",
    )
    relations = spark.createDataFrame(
        [("g", "s", "r.html", f"f{n}", None, n + 1, 'odd "name"') for n in range(3)],
        "graph_id string, snapshot_id string, report_path string, source_path string, fragment string, line int, symbol string",
    )
    return snapshot, *graph.assemble({"snapshot": snapshot, "snapshot_file": files, "coverage_artifact": reports, "coverage_relation": relations})


def test_identities_are_judged_once_and_both_graph_ids_told_in_one_pass(spark, codes, monkeypatch):
    snapshot, node, edge = small_graph(spark)
    claimed = session.stored(graph.graph_digest(node, edge, snapshot))
    assert claimed.collect() == graph.graph_digest(node, edge.drop("edge_id"), snapshot).collect()
    covers = {r.line: r for r in edge.filter("kind = 'covers-source'").collect()}
    forged = edge.withColumn("relation_id", F.when(F.col("line") == 1, F.lit(f"coverage-relation:sha256:{digest('x')}")).otherwise(F.col("relation_id")))
    forged = forged.withColumn("edge_id", F.when(F.col("line") == 2, F.concat("edge_id", F.lit("0"))).otherwise(F.col("edge_id")))
    calls, tell = [], ordered.ordered_digest
    monkeypatch.setattr(ordered, "ordered_digest", lambda *a, **b: calls.append(1) or tell(*a, **b))
    # the claimed id covers the right records: each forged id is one finding, at its own level
    found = graph.identity_levels({"none": snapshot}, node, forged, snapshot, claimed)
    wrong = [("g", "artifact_graph.identity_mismatch", covers[2].edge_id + "0", "edge id"), ("g", "artifact_graph.invalid_relation", covers[1].edge_id, "relation id")]
    assert codes(found) == sorted(wrong) and len(calls) == 1
    # an edge without a source node is in the records as they stand, and judged elsewhere
    dangling = edge.withColumn("source", F.when(F.col("line") == 3, F.lit("gone")).otherwise(F.col("source")))
    own = graph.graph_digest(node, dangling, snapshot)
    assert codes(graph.identity_levels({"none": snapshot}, node, dangling, snapshot, own)) == []


def test_shuffle_files_of_a_stored_table_are_dropped(spark):
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    folders = [folder.getPath() for folder in local]

    def shuffled():
        return {name for folder in folders for _, _, names in os.walk(folder) for name in names if name.startswith("shuffle_")}

    before = shuffled()
    table = session.stored(spark.range(1000).repartition(7, "id"))
    for _ in range(50):
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before and table.count() == 1000
