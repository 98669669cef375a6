"""Ids that travel as bytes, and ordered texts made where they are sorted, give what whole ids and texts give."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from sealwright import catalog
from sealwright.functions import ids, joins, ordered
from sealwright.operators import graph
from sealwright.plans.fixtures import DERIVED, Fixtures


def digest(n: int) -> str:
    return hashlib.sha256(str(n).encode()).hexdigest()


def test_packed_ids_come_back_byte_for_byte(spark):
    texts = [f"edge:sha256:{digest(1)}", f"edge:sha256:{digest(1)}0", f"edge:sha256:{digest(2).upper()}", "s1", "", None, f"a:b:sha256:{digest(3)}", f"edge:sha256:{digest(4)}\n"]
    table = spark.createDataFrame([(t,) for t in texts], "own string").select("own", ids.packed(F.col("own")).alias("pack"))
    rows = table.select("own", ids.unpacked(F.col("pack")).alias("again"), F.octet_length("pack.digest").alias("bytes")).collect()
    assert [r.again for r in rows] == [r.own for r in rows] == texts
    assert rows[0].bytes == 32 and rows[1].bytes is None


def test_texts_made_late_are_ordered_by_whole_keys(spark):
    keys = [f"edge:sha256:{digest(n)}" for n in range(200)] + [f"edge:sha256:{digest(7)}0", "edge:sha256:", "zz"]
    table = spark.createDataFrame([(g, k) for g in ("a", "b") for k in keys], "g string, key string").repartition(5)
    listing = table.select("g", F.lit(0).alias("part"), ids.packed(F.col("key")).alias("key"))
    own = ids.unpacked(F.col("key"))
    glue = spark.createDataFrame([("a", ["<", ">"]), ("b", ["<", ">"])], "g string, glue array<string>")
    got = ordered.ordered_digest(listing, ["g"], glue, late=(own, F.concat(F.lit("é"), own))).collect()
    want = hashlib.sha256(("<" + ",".join("é" + k for k in sorted(keys)) + ">").encode()).hexdigest()
    assert {r.g: r.sha256 for r in got} == {"a": want, "b": want}


def test_rows_of_keys_may_be_counted_elsewhere(spark):
    left = spark.createDataFrame([("k", n) for n in range(50)] + [("l", 1)], "k string, n long")
    right = spark.createDataFrame([("k", "x"), ("l", "y")], "k string, v string")
    met = joins.counted_join(left, right, ["k"], ["n"], most=10, counted=left.select("k"))
    assert met.count() == 51 and met.filter("k = 'k' and v = 'x'").select("n").distinct().count() == 50


def test_relations_are_read_once_and_the_graph_is_not_stored(spark):
    catalog.queries()
    fixtures = Fixtures(spark, "/root/testdata/sf0.001")
    assert {"node_record", "edge_record"} <= set(DERIVED)
    plan = fixtures.edge_record._jdf.queryExecution().optimizedPlan().toString()
    assert "stored/" not in plan
    relation = spark.createDataFrame([("g", "s", "r", "p", None, 1, "x"), ("g", "s", "r", "p", None, 2, None), ("g", "s", "r", "p", None, 3, "two")], "graph_id string, snapshot_id string, report_path string, source_path string, fragment string, line int, symbol string")
    reports = spark.createDataFrame([("g", "r", f"coverage-page:sha256:{digest(1)}", f"coverage-artifact:sha256:{digest(2)}")], "graph_id string, report_path string, _report string, report_artifact_id string")
    sources = spark.createDataFrame([("g", "p", f"source-file:sha256:{digest(3)}")], "graph_id string, source_path string, _source string")
    named = [("g", "p", "x", f"symbol:sha256:{digest(4)}")] + [("g", "p", "two", f"symbol:sha256:{digest(n)}") for n in (5, 6)]
    symbols = spark.createDataFrame(named, "graph_id string, source_path string, symbol string, _symbol string")
    rows = graph._relation_edges(relation, reports, sources, symbols).collect()
    assert sorted((r.kind, r.line, r.target) for r in rows) == [
        *[("covers-source", n, f"source-file:sha256:{digest(3)}") for n in (1, 2, 3)], ("covers-symbol", 1, f"symbol:sha256:{digest(4)}"),
    ]
    assert {r.source for r in rows} == {f"coverage-page:sha256:{digest(1)}"} and len({r.edge_id for r in rows}) == 4
