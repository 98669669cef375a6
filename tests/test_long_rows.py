"""Texts of up to a megabyte: a task holds few of them at a time, and they stay where they are."""

from __future__ import annotations

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from sealwright import session
from sealwright.functions import chunks


def test_long_rows_are_stored_and_handed_on_a_few_at_a_time(spark):
    def batch_bytes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([batch.num_rows] * batch.num_rows, pa.int64())], ["text", "n"])

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    texts = spark.range(0, 40, 1, 1).select(F.concat(F.col("id").cast("string"), F.repeat(F.lit("x"), 1 << 20)).alias("text"))
    table = session.stored(texts.mapInArrow(batch_bytes, "text string, n long"), "long", long_rows=True, group=8)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
    assert table.agg(F.max("n")).first()[0] <= 2 * session.LONG_BYTES >> 20 and table.select("text").distinct().count() == 40
    folder = table.inputFiles()[0].rpartition("/")[0].removeprefix("file://").removeprefix("file:")
    groups = [meta.row_group(k).total_byte_size for f in glob.glob(f"{folder}/*.parquet") for meta in [pq.read_metadata(f)] for k in range(meta.num_row_groups)]
    assert len(groups) >= 4 and max(groups) <= 9 << 20


def test_texts_stay_where_they_are_and_parts_are_the_same_either_way(spark, monkeypatch):
    text = '{"a":[' + ",".join(f'{{"k":"{n}\\"]"}}' for n in range(200)) + '],"b":[ ],"c":1}'
    table = spark.createDataFrame([("s", text), ("t", text[:700])], "scope string, text string")

    def parts():
        found = chunks.json_parts(chunks.as_chunks(table, ["scope"], size=50), ["scope"])
        return sorted((r.scope, r.array, r.pos, r.text) for r in found.collect())

    sent, send = [], chunks._sent
    monkeypatch.setattr(chunks, "_sent", lambda told: sent.append(send(told)) or sent[-1])
    here = parts()
    assert len(here) > 200 and len(sent) == 2
    assert all("broadcast" in told._jdf.queryExecution().logical().toString().lower() for told in sent)
    monkeypatch.setattr(chunks, "MOST_SENT", 0)
    assert parts() == here
