"""Operator 7, mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of its documents' ids. A window gives each source a quantum of its target
share, and what a source could not use, or used too much, is its deficit in the next window. The
queues are cut at the ids where the targets of successive shards end, so a shard packs its windows
on its own, starting from the fraction of an id that the shard before owes each source.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealwright.llm import common, tokens

WINDOW = 4096
#: Ids of a shard: 64 windows.
SHARD = 1 << 18
END = 2
#: Most padding of a shard's last window; with more, the rest is cut at powers of two.
MOST_PADDING = 32
MOST_SOURCES = 10_000
_PIECES = "array<struct<shard:long,start:long,length:long,at:long>>"


def cuts(first: int, length: int, queue: int, total: int, shard: int) -> list[tuple[int, int, int, int]]:
    """(shard, start, length, place in the queue) of ids [first, first + length) of a queue of ``queue`` ids.

    Shard k ends the queue's part at ``floor((k + 1) * shard * queue / total)``.
    """
    out, at, end = [], first, first + length
    while at < end:
        k = -(-(at + 1) * total // (shard * queue)) - 1
        stop = min(end, (k + 1) * shard * queue // total)
        out.append((k, at - first, stop - at, at))
        at = stop
    return out


def window_sizes(total: int) -> list[int]:
    """Lengths of a shard's sequences: full windows, then the rest with little or no padding."""
    sizes, rest = [WINDOW] * (total // WINDOW), total % WINDOW
    if rest and WINDOW - rest <= MOST_PADDING:
        return [*sizes, rest]
    return sizes + [1 << b for b in range(WINDOW.bit_length(), -1, -1) if rest >> b & 1]


@dataclass
class _Queue:
    rows: list[tuple[int, int, int]]  # rid, start, length
    share: float
    deficit: float
    left: int
    nth: int = 0
    used: int = 0

    def take(self, want: int, window: int, offset: int, out: list[tuple]) -> int:
        """Move up to ``want`` ids to the window; how many were there."""
        got = 0
        while got < want and self.left:
            rid, start, length = self.rows[self.nth]
            n = min(want - got, length - self.used)
            out.append((rid, start + self.used, n, window, offset + got))
            got, self.used, self.left = got + n, self.used + n, self.left - n
            if self.used == length:
                self.nth, self.used = self.nth + 1, 0
        self.deficit -= got
        return got


def round_robin(queues: list[_Queue]) -> list[tuple[int, int, int, int, int]]:
    """(rid, start, length, window, offset) of all ids of a shard's queues."""
    out: list[tuple] = []
    for window, size in enumerate(window_sizes(sum(q.left for q in queues))):
        filled = 0
        for q in queues:
            q.deficit += q.share * size
            filled += q.take(min(int(q.deficit), size - filled), window, filled, out) if q.deficit >= 1 else 0
        # what rounding or an empty queue left open goes to whom most is owed
        while filled < size:
            q = max((q for q in queues if q.left), key=lambda q: q.deficit)
            filled += q.take(min(max(1, int(q.deficit)), size - filled), window, filled, out)
    return out


def _pack(frame: pd.DataFrame, shard: int, total: int) -> pd.DataFrame:
    k = int(frame["shard"].iloc[0])
    queues = []
    for _, rows in frame.sort_values(["source_no", "at"], kind="stable").groupby("source_no", sort=True):
        queue = int(rows["queue"].iloc[0])
        owed = (k * shard * queue) % total / total
        listed = list(zip(rows["rid"].tolist(), rows["start"].tolist(), rows["length"].tolist()))
        queues.append(_Queue(listed, queue / total, owed, int(rows["length"].sum())))
    found = pd.DataFrame(round_robin(queues), columns=["rid", "start", "length", "window", "offset"])
    return found.assign(sequence_id=(k << 20) + found["window"])[["rid", "start", "length", "sequence_id", "offset"]]


def _joined(pieces: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Pieces (start, length, sequence, offset) in order, with those that continue each other in one."""
    out: list[tuple[int, int, int, int]] = []
    for start, length, sequence, offset in sorted(pieces):
        if out and out[-1][2] == sequence and out[-1][3] + out[-1][1] == offset:
            out[-1] = (out[-1][0], out[-1][1] + length, sequence, out[-1][3])
        else:
            out.append((start, length, sequence, offset))
    return out


def tokenised(docs: DataFrame, path: str, end: int) -> DataFrame:
    """``docs(doc_id, text, source)`` with a row id, ids as little-endian binary (``width`` bytes each) and their number."""

    @F.pandas_udf("ids binary, n long, width int")
    def ids(texts: pd.Series) -> pd.DataFrame:
        width = tokens.encoder(path).width
        found = list(tokens.encoded(texts, path, end))
        return pd.DataFrame({"ids": found, "n": [len(x) // width for x in found], "width": width})

    got = docs.select("doc_id", F.col("source").cast("string").alias("source"), ids(F.col("text").cast("string").cast("binary")).alias("t"))
    return common.stage(got.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "source", "t.*"), "tokens")


def assign(rows: DataFrame, shard: int = SHARD) -> DataFrame:
    """(rid, start, length, sequence_id, offset) for the ids of ``rows(rid, source, n)``; only lengths are shuffled."""
    sums = rows.groupBy("source").agg(F.sum("n").alias("queue"), F.count("*").alias("docs"))
    sums = common.stage(sums.withColumns({"buckets": common.spread_count(F.col("docs")), "source_no": F.xxhash64("source")}), "queues")
    total = sums.agg(F.sum("queue")).first()[0] or 1
    few = common.bounded_broadcast(sums, MOST_SOURCES)
    placed = rows.alias("d").join(few.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    placed = placed.select("rid", "d.source", "n", "queue", "source_no", F.pmod(F.xxhash64("rid"), "buckets").alias("bucket"))
    placed = common.running_start(placed, ["source"], "bucket", [F.col("rid")], "n", "first")

    @F.pandas_udf(_PIECES)
    def pieces(first: pd.Series, n: pd.Series, queue: pd.Series) -> pd.Series:
        names = ("shard", "start", "length", "at")
        return pd.Series([[dict(zip(names, c)) for c in cuts(*map(int, row), total, shard)] for row in zip(first, n, queue)], dtype=object)

    dealt = placed.select("rid", "source_no", "queue", F.explode(pieces("first", "n", "queue")).alias("p")).select("rid", "source_no", "queue", "p.*")
    return dealt.groupBy("shard").applyInPandas(lambda f: _pack(f, shard, total), "rid long, start long, length long, sequence_id long, offset long")


def pack(docs: DataFrame, path: str | None = None, end: int = END, shard: int = SHARD) -> DataFrame:
    """One row per piece of ``docs(doc_id, text, source)``, with its place in its document and its sequence.

    A null or empty text is the end id alone. A null source is a queue of its own. Equal rows and
    null ids are packed as often as they come. Target shares are the sources' shares of all ids, as
    every id is packed once.
    """
    rows = tokenised(docs, path or tokens.default_tokenizer(), end)
    pieces = assign(rows.select("rid", "source", "n"), shard)
    by_doc = pieces.groupBy("rid").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))

    @F.pandas_udf("array<struct<start:long,length:long,ids_crc32:long,sequence_id:long,offset:long>>")
    def checked(ids: pd.Series, width: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for raw, size, of in zip(ids, width, found):
            wide = np.frombuffer(raw, f"<u{size}").astype("<u4")
            rows = []
            for a, n, s, o in _joined([(p["start"], p["length"], p["sequence_id"], p["offset"]) for p in of]):
                rows.append({"start": a, "length": n, "ids_crc32": zlib.crc32(wide[a : a + n].tobytes()), "sequence_id": s, "offset": o})
            out.append(rows)
        return pd.Series(out, dtype=object)

    joined = rows.join(by_doc, "rid").select("doc_id", F.col("n").alias("doc_tokens"), F.explode(checked("ids", "width", "pieces")).alias("p"))
    return joined.select("doc_id", "p.start", "p.length", "p.ids_crc32", "doc_tokens", "p.sequence_id", "p.offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.read(spark, sf_dir, "documents", "doc_id", "text", "source"))
