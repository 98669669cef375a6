"""Navigation entries move with ids as bytes, keys of many rows are broadcast, and the index is what it was."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from sealwright.functions import ids, joins, ordered
from sealwright.operators import navigation


def digest(n) -> str:
    return hashlib.sha256(str(n).encode()).hexdigest()


def test_keys_of_many_rows_are_sent_and_neither_side_is_dealt_for_them(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(300).selectExpr("if(id % 3 = 0, 'hot', cast(id as string)) as k", "id")
        right = left.select("k", F.length("k").alias("n")).distinct()
        plan = joins.counted_join(left, right, ["k"], ["id"], most=20)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("BroadcastHashJoin") == 2 and plan.count("SortMergeJoin") == 1


def test_ordinals_of_ids_made_late(spark):
    keys = [f"{kind}:sha256:{digest(n)}" for n in range(200) for kind in ("a-page", "a", "b")] + [f"a:sha256:{digest(1)}0", "a:sha256:zz"]
    frame = spark.createDataFrame([("g", k) for k in keys], "g string, i string").repartition(7).select("g", ids.packed(F.col("i")).alias("i"))
    got = ordered.digest_ordinal(frame, ["g"], "i", late=ids.unpacked(F.col("i"))).select(ids.unpacked(F.col("i")).alias("i"), "ord").collect()
    assert [r.i for r in sorted(got, key=lambda r: r.ord)] == sorted(keys) and sorted(r.ord for r in got) == list(range(1, len(keys) + 1))


def test_index_of_a_small_graph(spark, monkeypatch):
    report, source, stage = (f"{kind}:sha256:{digest(kind)}" for kind in ("coverage-page", "source-file", "stage-result"))
    nodes = [
        ("g", report, "coverage-page", "r é.html", "artifacts/coverage/r é.html", None, "unknown-origin"), ("g", source, "source-file", "f.c", "f.c", None, None),
        ("g", stage, "stage-result", "coverage", None, None, None), ("g", "odd", "symbol", "s", "artifacts/api/p.html", "a b", None),
    ]
    node = spark.createDataFrame(nodes, "graph_id string, node_id string, kind string, label string, path string, fragment string, provenance string")
    edges = [("g", f"edge:sha256:{digest(n)}", "covers-source", report, source, "L2" if n else None, n or None) for n in range(3)] + [("g", "x", "covers-source", report, "gone", None, 1), ("g", "y", "has-log", report, source, None, None)]
    edge = spark.createDataFrame(edges, "graph_id string, edge_id string, kind string, source string, target string, fragment string, line int")
    written, store = [], navigation.stored
    monkeypatch.setattr(navigation, "stored", lambda table, label: written.append(table.schema) or store(table, label))
    got = {(r.page, r.section, r.ord, r.label, r.href, r.node_id) for r in navigation.navigation_index(node, edge).collect()}
    place = {own: n + 1 for n, own in enumerate(sorted(f"edge:sha256:{digest(n)}" for n in range(3)))}
    page = "../artifacts/coverage/r%20%C3%A9.html"
    assert got == {
        ("index", "coverage", 1, "r é.html", page, report), ("index", "sources", 1, "f.c", None, source), ("index", "stages", 1, "coverage", None, stage),
        ("index", "symbols", 1, "s", "../artifacts/api/p.html#a%20b", "odd"), ("stages", "stages", 1, "coverage", None, stage), ("provenance", "carriers", 1, "r é.html", page, report),
        *[("index", "relations", place[f"edge:sha256:{digest(n)}"], f"f.c:{n}" if n else "f.c", page + ("#L2" if n else ""), report) for n in range(3)],
    }
    # ids are stored as bytes
    assert all(schema[name].dataType.simpleString().startswith("struct") for schema in written for name in schema.names if name in ("_key", "_node", "_source", "_target"))
    assert all("href" not in schema.names and "node_id" not in schema.names for schema in written)
