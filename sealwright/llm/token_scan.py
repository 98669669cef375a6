"""Operator 10, token counts by a separator scan of flat token files without an index.

A flat file is a stream of fixed-width ids in which an end id follows each document. Blocks of it
are searched with array operations; a block yields the documents that begin and end in it, and
counts for what reaches over its borders. A prefix scan over the blocks' separator counts numbers
the documents, and the parts of a document that crosses blocks are added by that number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealwright.llm import common, tokens

#: Ids of a block, end id of the public word tokenizer, bytes of an id.
BLOCK, END, WIDTH = 1 << 16, 49407, 2


def scan_block(data: bytes, end: int = END, width: int = WIDTH) -> tuple[int, np.ndarray]:
    """Separators of a block, and ids of each of its parts without separators: one part more."""
    ids = np.frombuffer(data, f"<u{width}")
    at = np.flatnonzero(ids == end)
    return len(at), np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1


@F.pandas_udf(T.StructType([T.StructField("separators", T.LongType()), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("size", T.LongType())]))
def _scan(data: pd.Series, end: pd.Series, width: pd.Series) -> pd.DataFrame:
    found = [scan_block(d, e, w) for d, e, w in zip(data, end, width)]
    return pd.DataFrame({"separators": [f[0] for f in found], "lengths": [f[1] for f in found], "size": [len(d) // w for d, w in zip(data, width)]})


def count_tokens(blocks: DataFrame, end: int = END, width: int = WIDTH) -> DataFrame:
    """(file, ordinal, n_tokens, start) of every document of ``blocks(file, block, data)``.

    Blocks are cut anywhere between ids and numbered in order within their file. ``start`` counts the ids
    before the document in its file. Ids after a file's last separator are a document if there are
    any; an empty file has none. A null or empty block adds nothing.
    """
    data = F.coalesce(F.col("data"), F.lit(b""))
    scanned = blocks.select("file", "block", _scan(data, F.lit(end), F.lit(width)).alias("s")).select("file", "block", "s.*")
    scanned = common.stage(scanned, "scanned")
    narrow = scanned.select("file", "block", "separators", "size")
    # about the root of a file's blocks in each bucket, so that a file of any length is many tasks
    spread = narrow.groupBy("file").agg(common.spread_count(F.count("*")).alias("span"))
    narrow = narrow.join(spread, "file").withColumn("bucket", F.floor(F.col("block") / F.col("span")))
    order = [F.col("block")]
    numbered = common.running_start(narrow, ["file"], "bucket", order, "separators", "before")
    numbered = common.running_start(numbered, ["file"], "bucket", order, "size", "first")
    placed = scanned.join(numbered.select("file", "block", "before", "first"), ["file", "block"])
    # a part begins after all ids and separators before it in its block
    parts = placed.select("file", "before", "first", "separators", F.posexplode(_with_starts("lengths")).alias("nth", "p"))
    parts = parts.select("file", (F.col("before") + F.col("nth")).alias("ordinal"), F.col("p.n").alias("n"), (F.col("first") + F.col("p.at")).alias("start"), (F.col("nth") < F.col("separators")).alias("ends"))
    docs = parts.groupBy("file", "ordinal").agg(F.sum("n").alias("n_tokens"), F.min("start").alias("start"), F.max("ends").alias("ended"))
    return docs.where("ended or n_tokens > 0").select("file", "ordinal", "n_tokens", "start")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("n", T.LongType()), T.StructField("at", T.LongType())])))
def _with_starts(lengths: pd.Series) -> pd.Series:
    out = []
    for found in lengths:
        at = np.concatenate([[0], np.cumsum(np.asarray(found) + 1)[:-1]])
        out.append([{"n": int(n), "at": int(a)} for n, a in zip(found, at)])
    return pd.Series(out, dtype=object)


def read_blocks(spark: SparkSession, path: str, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """(file, block, data) of the flat files below ``path``, each of at most 2 GB."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                view = memoryview(content.as_buffer())
                for i, at in enumerate(range(0, len(view), width * block)):
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([i]), pa.array([bytes(view[at : at + width * block])], pa.binary())], ["file", "block", "data"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(split, "file string, block long, data binary")


def flat_stream(docs: DataFrame, path: str | None = None, end: int = END, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The flat streams of ``docs(doc_id, text)``, as blocks, and the documents in them as (file, ordinal, doc_id).

    One stream for each task that writes; blocks are cut without regard to documents, and the
    stream holds nothing but ids. The list of documents is kept apart and plays no part in counting.
    """
    path = path or tokens.default_tokenizer()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, held, nth, ordinal = f"part-{TaskContext.get().partitionId():08d}", bytearray(), 0, 0
        size = block * WIDTH
        names = ["file", "block", "data", "ordinal", "doc_id"]

        def rows(first: int, datas: list[bytes | None], ordinals: list[int | None], ids: list[int | None]) -> pa.RecordBatch:
            n = len(datas)
            numbers = [first + i if datas[i] is not None else None for i in range(n)]
            columns = [[file] * n, numbers, datas, ordinals, ids]
            kinds = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            yield rows(0, [None] * len(ids), list(range(ordinal, ordinal + len(ids))), ids)
            ordinal += len(ids)
            texts = (t.as_py() for t in batch.column("text").cast(pa.binary()))
            for found in tokens.encoded(texts, path, end, plain=True):
                held += found
                if len(held) >= size:
                    whole = len(held) // size
                    yield rows(nth, [bytes(held[i * size : (i + 1) * size]) for i in range(whole)], [None] * whole, [None] * whole)
                    nth, held = nth + whole, held[whole * size :]
        if held:
            yield rows(nth, [bytes(held)], [None], [None])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    both = common.stage(named.mapInArrow(write, "file string, block long, data binary, ordinal long, doc_id long"), "flat")
    return both.where("block is not null").select("file", "block", "data"), both.where("block is null").select("file", "ordinal", "doc_id")


def document_tokens(docs: DataFrame, path: str | None = None, end: int = END, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_tokens, start) of ``docs(doc_id, text)``, counted by scanning their flat streams.

    Null and empty texts have 0 tokens. Equal rows and null ids come back as often as they came. The end id's
    name within a text is ordinary text.
    """
    blocks, listed = flat_stream(docs, path, end, block)
    return listed.join(count_tokens(blocks, end), ["file", "ordinal"]).select("doc_id", "n_tokens", "start")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_tokens(common.read(spark, sf_dir, "documents", "doc_id", "text"))
