"""Rows enter and leave tasks in bounded batches, also where a row is a whole text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from sealwright.functions import batches, json_walk, ordered

SCHEMA = pa.schema([("n", pa.int64()), ("text", pa.string())])


def test_short_rows_travel_together():
    found = list(batches.batched(((n, "x") for n in range(10_000)), SCHEMA))
    assert [b.num_rows for b in found] == [4096, 4096, 1808]
    assert [n for b in found for n in b.column("n").to_pylist()] == list(range(10_000))
    assert list(batches.batched((), SCHEMA)) == []


def test_long_rows_do_not():
    long = "x" * (batches.BATCH_CHARS // 2)
    found = list(batches.batched(((n, long) for n in range(5)), SCHEMA))
    assert [b.num_rows for b in found] == [2, 2, 1]


def test_rows_of_a_batch_come_in_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array([str(n) * 400_000 for n in range(7)])], schema=SCHEMA)
    assert list(batches.rows(batch)) == [(n, str(n) * 400_000) for n in range(7)]
    assert list(batches.rows(batch.slice(0, 0))) == []


def test_texts_come_in_the_chunks_asked_for(spark):
    rows = spark.range(300).select(F.lit("s").alias("scope"), F.format_string("%05d", "id").alias("line"))
    listing = ordered.lines(rows, ["scope"], F.col("line"), F.col("line"))
    got = sorted((r.chunk, r.text) for r in ordered.ordered_text(listing, ["scope"], ["[", "]"], chunk_chars=100).collect())
    assert max(len(text) for _, text in got) == 100 and len(got) == 19
    assert "".join(text for _, text in got) == "[" + ",".join(f"{n:05d}" for n in range(300)) + "]"


def test_short_texts_are_dealt_and_leave_in_few_batches(spark):
    table = spark.range(0, 2000, 1, 1).select("id", F.lit('{"a":[1,"x"]}').alias("json"))
    walked = json_walk.walk(json_walk.dealt(table), ["id"], "json")
    assert walked.count() == 2000 * 4 and walked.select("doc").distinct().count() == 2000
    assert len({r.part for r in walked.select(F.shiftright("doc", 40).alias("part")).distinct().collect()}) > 1
