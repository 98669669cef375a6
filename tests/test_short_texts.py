"""Texts of one chunk are taken apart in one pass over evenly dealt rows, and give what chunks give."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from sealwright.functions import chunks
from sealwright.sources import sidecars

from test_chunks import value


def test_whole_texts_give_the_parts_of_chunks(spark):
    rng = random.Random(5)
    texts = [json.dumps({f"m{i}": value(rng, 1) for i in range(rng.randrange(6))}, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) for _ in range(80)]
    texts += [None, "", "[]", "[[1,2],[],[ ]]", '{"a":[]}', '{"a":[ ],"b":[[],[]]}', '{"a":[1,]}', '{"a":[,]}', '{"a":[ ,]}', "]]}}[[[1],2", "]]}}[[[", '"', '{"a":[1', '{"a":[', '{"a" [1]}', "{\\\"}", '{"e":[{"x":"]"},{"x":"\\""}],"e":[3]}']
    table = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")

    def rows(parts):
        return sorted(map(tuple, parts.select("doc", "array", "pos", "text").collect()))

    assert rows(chunks.whole_parts(table, ["doc"])) == rows(chunks.json_parts(chunks.as_chunks(table, ["doc"]), ["doc"]))


def test_short_mappings_are_dealt_and_only_long_ones_are_cut(spark, monkeypatch):
    def text(lines):
        return json.dumps({"relations": [{"fragment": None, "line": n, "report_path": "r", "source_path": "s", "symbol": None} for n in range(lines)], "report": {"entry_point": "i", "tree_sha256": "t"}, "schema": "s"})

    cut = []
    whole = chunks.json_parts
    monkeypatch.setattr(chunks, "json_parts", lambda table, scope: cut.append(table.select("scope").distinct().count()) or whole(table, scope))
    short = spark.createDataFrame([(f"s{n}", text(2)) for n in range(64)], "scope string, text string").coalesce(1)
    parts = sidecars.mapping_parts(short)
    assert cut == [] and parts.count() == 64 * 3
    assert parts.select(F.input_file_name()).distinct().count() > 1
    mixed = sidecars.mapping_parts(short.limit(2).unionByName(spark.createDataFrame([("long", text(30))], "scope string, text string")), 500)
    assert cut == [1] and {r["scope"]: r["count"] for r in mixed.groupBy("scope").count().collect()} == {"s0": 3, "s1": 3, "long": 31}
    assert sidecars.mapping_audit(short).count() == 0
    wrong = spark.createDataFrame([("w", text(2).replace('"line": 1', '"line": 1, "new": 2')), ("j", text(2)[:-1])], "scope string, text string")
    assert sorted((r.scope_id, r.code, r.path, r.detail) for r in sidecars.mapping_audit(wrong).collect()) == [
        ("j", "coverage.invalid_sidecar", None, "json"), ("w", "coverage.invalid_relation", "r", "1"),
    ]
