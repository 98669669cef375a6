"""Operator 8, embedding near-dedup by a pivot-permutation index.

A vector is described by its PREFIX nearest pivots in order, and stands in the inverted list of each
of them. Lists are searched in blocks: pairs that share SHARED of these pivots or more are candidates,
counted on bitmaps, and candidates are verified by their exact cosine. A pair that meets in
several lists counts in that of the first pivot it shares. Equal vectors are one entry with a weight,
and a list of any length is dealt to as many blocks as it needs, so links are counted and joined
but never written out as pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealwright.llm import common

LEAST_COSINE = 0.9
#: Pivots: PIVOTS times the root of the number of vectors, from LEAST_PIVOTS to MOST_PIVOTS.
PIVOTS, LEAST_PIVOTS, MOST_PIVOTS = 4, 64, 4096
#: No two pivots are closer than this cosine: a dense group that fills the sample would else give its members
#: many pivots, all about as near, in an order that says little.
APART = 0.6
PREFIX, SHARED = 8, 2
#: Entries of a verified block, and of the short lists that one group takes.
BLOCK, SHORT = 1024, 4096


def directions(rows: list[np.ndarray]) -> np.ndarray:
    """Vectors of one length at unit norm, in double precision; scaled first, so that squares stay finite."""
    m = np.asarray(np.stack(rows), np.float64)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def nearest(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The PREFIX nearest pivots of each vector, nearest first."""
    return np.argsort(-(pivots @ units.T), axis=0, kind="stable")[:PREFIX].T


def choose_pivots(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Pivots by vector length: a seeded hash sample of different vectors, at most MOST_PIVOTS of each length."""
    counts = {r.dim: r.n for r in vectors.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(64).collect()}
    out = {}
    for dim, n in counts.items():
        wanted = min(MOST_PIVOTS, max(LEAST_PIVOTS, int(PIVOTS * n**0.5)))
        share = F.pmod(F.xxhash64(F.lit(8), "k1", "k2"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, 2 * wanted / n))
        rows = vectors.where((F.col("dim") == dim) & share).orderBy(F.xxhash64(F.lit(9), "k1", "k2"), "k1", "k2").limit(wanted)
        found = [np.asarray(r.v) for r in rows.select("v").collect()]
        if len(found) >= PREFIX:
            out[dim] = _apart(directions(found))
    return out


def _apart(sample: np.ndarray) -> np.ndarray:
    """The sample less what is too close to a pivot before it; filled up to PREFIX pivots if need be."""
    out, n, near = np.empty_like(sample), 0, []
    for row in sample:
        if (out[:n] @ row > APART).any():
            near.append(row)
        else:
            out[n], n = row, n + 1
    more = near[: max(0, PREFIX - n)]
    return np.concatenate([out[:n], *[row[None] for row in more]])


def nearest(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The PREFIX nearest pivots of each vector, nearest first."""
    return np.argsort(-(pivots @ units.T), axis=0, kind="stable")[:PREFIX].T


def choose_pivots(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Pivots by vector length: a seeded hash sample of different vectors, at most MOST_PIVOTS of each length."""
    counts = {r.dim: r.n for r in vectors.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(64).collect()}
    out = {}
    for dim, n in counts.items():
        wanted = min(MOST_PIVOTS, max(LEAST_PIVOTS, int(PIVOTS * n**0.5)))
        share = F.pmod(F.xxhash64(F.lit(8), "k1", "k2"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, 2 * wanted / n))
        rows = vectors.where((F.col("dim") == dim) & share).orderBy(F.xxhash64(F.lit(9), "k1", "k2"), "k1", "k2").limit(wanted)
        found = [np.asarray(r.v) for r in rows.select("v").collect()]
        if len(found) >= PREFIX:
            out[dim] = _apart(directions(found))
    return out


def _apart(sample: np.ndarray) -> np.ndarray:
    """The sample less what is too close to a pivot before it; filled up to PREFIX pivots if need be."""
    chosen = np.zeros(len(sample), bool)
    for i, row in enumerate(sample):
        chosen[i] = not (sample[chosen] @ row > APART).any()
    chosen[np.flatnonzero(~chosen)[: max(0, PREFIX - int(chosen.sum()))]] = True
    return sample[chosen]


def _bitmaps(lists: np.ndarray) -> np.ndarray:
    """One row of 64-bit words with the pivots of each vector."""
    out = np.zeros((len(lists), int(lists.max()) // 64 + 1), np.uint64)
    for column in lists.T:
        out[np.arange(len(lists)), column // 64] |= np.uint64(1) << (column % 64).astype(np.uint64)
    return out


def candidates(left: np.ndarray, right: np.ndarray, pivot: int) -> np.ndarray:
    """Pairs of two blocks of the list ``pivot`` that share SHARED pivots or more, and none before it."""
    words = min(left.shape[1], right.shape[1])
    shared, before = np.zeros((len(left), len(right)), np.uint8), np.zeros((len(left), len(right)), bool)
    for w in range(words):
        both = left[:, w, None] & right[None, :, w]
        shared += np.bitwise_count(both)
        if 64 * w <= pivot:
            before |= (both & np.uint64((1 << min(64, int(pivot) - 64 * w)) - 1)) != 0
    return (shared >= SHARED) & ~before


def _linked(left: pd.DataFrame, right: pd.DataFrame, same: bool, pivot: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of two blocks of the list ``pivot`` with that cosine or more; all pairs of a list without pivots."""
    a = directions(left["v"].tolist())
    b = a if same else directions(right["v"].tolist())
    near = a @ b.T >= least
    if pivot >= 0:
        bits = _bitmaps(np.stack(left["lists"].tolist()))
        near &= candidates(bits, bits if same else _bitmaps(np.stack(right["lists"].tolist())), pivot)
    return np.nonzero(np.triu(near, 1) if same else near)


def _verify(frame: pd.DataFrame, least: float) -> pd.DataFrame:
    """(c, links, to) for vectors of a group with links in it; ``to``: the least vector they connect to here."""
    ids = np.unique(frame["c"].to_numpy())
    links, labels = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for (_, key), rows in frame.groupby(["dim", "key"]):
        first, second = int(rows["first"].iloc[0]), int(rows["second"].iloc[0])
        left = rows[rows["chunk"] == first]
        right = left if first == second else rows[rows["chunk"] == second]
        if not len(left) or not len(right) or len(rows) < 2:
            continue
        i, j = _linked(left, right, first == second, key, least)
        if not len(i):
            continue
        a = np.searchsorted(ids, left["c"].to_numpy()[i])
        b = np.searchsorted(ids, right["c"].to_numpy()[j])
        np.add.at(links, a, right["weight"].to_numpy()[j])
        np.add.at(links, b, left["weight"].to_numpy()[i])
        labels = common.hook(labels, a, b)
    held = links > 0
    return pd.DataFrame({"c": ids[held], "links": links[held], "to": ids[labels[held]]})


def _usable(vector):
    numbers = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(numbers, lambda x: x != 0)


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """(c, k1, k2, dim, v, weight, least_id) of the different usable vectors of ``vectors(vec_id, k1, k2, v)``."""
    usable = vectors.where(_usable(F.col("v")))
    grouped = usable.groupBy("k1", "k2").agg(F.first("v").alias("v"), F.count("*").alias("weight"), F.min("vec_id").alias("least_id"))
    return common.stage(grouped.select(F.monotonically_increasing_id().alias("c"), "k1", "k2", F.size("v").alias("dim"), "v", "weight", "least_id"), "vectors")


def index(distinct: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``distinct`` with ``lists``, the nearest pivots of each vector. Lengths without pivots share one list each."""
    held = distinct.sparkSession.sparkContext.broadcast(pivots)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def lists(vectors: pd.Series) -> pd.Series:
        out = pd.Series([np.full(1, -1, np.int64)] * len(vectors), dtype=object)
        sizes = np.array([len(v) for v in vectors])
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            if dim in held.value:
                for i, row in zip(at, nearest(directions([vectors.iloc[i] for i in at]), held.value[dim])):
                    out.iloc[i] = row
        return out

    return common.stage(distinct.withColumn("lists", lists("v")), "index")


def links(indexed: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """(c, links, to): verified links of each vector by block, equal vectors counted by weight."""
    posts = indexed.select("c", "dim", F.explode("lists").alias("key"))
    lengths = posts.groupBy("dim", "key").agg(F.count("*").alias("n")).where("n > 1")
    lengths = common.stage(lengths.withColumn("chunks", F.ceil(F.col("n") / BLOCK).cast("int")), "lists")
    groups = max(1, (lengths.agg(F.sum(F.when(F.col("chunks") == 1, F.col("n")))).first()[0] or 0) // SHORT)
    held = posts.join(lengths.select("dim", "key", "chunks"), ["dim", "key"])
    chunk = F.pmod(F.xxhash64(F.lit(3), "c"), F.col("chunks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least(o, F.col("chunk")).alias("first"), F.greatest(o, F.col("chunk")).alias("second")))
    dealt = held.withColumn("chunk", chunk).select("*", F.explode(others).alias("o")).select("c", "dim", "key", "chunks", "chunk", "o.*")
    # short lists are grouped, a block pair of a long list is a group of its own
    own = F.xxhash64("dim", "key")
    dealt = dealt.withColumn("grp", F.when(F.col("chunks") == 1, F.pmod(own, F.lit(groups))).otherwise(own))
    rows = dealt.join(indexed.select("c", "v", "weight", "lists"), "c")
    return rows.groupBy("grp", "chunks", "first", "second").applyInPandas(lambda f: _verify(f, least), "c long, links long, to long")


def near_duplicates(vectors: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors(vec_id, embedding)``.

    Null, empty and zero vectors and such with null or non-finite components link with nothing, nor do vectors of
    different length. Equal rows link with each other; each counts. A class takes its smallest id
    that is not null.
    """
    key = {"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(17), "v")}
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).withColumns(key)
    distinct = distinct_vectors(rows)
    found = common.stage(links(index(distinct, choose_pivots(distinct)), least), "links")
    roots = common.connected_components(found.select("c", "to"), "c", "to")
    rooted = distinct.join(roots, F.col("c") == F.col("node"), "left").select("c", "k1", "k2", "weight", "least_id", F.coalesce("root", "c").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    counts = found.groupBy("c").agg(F.sum("links").alias("links"))
    told = rooted.join(ids, "root").join(counts, "c", "left")
    told = told.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    named = rows.select("vec_id", F.when(_usable(F.col("v")), F.col("k1")).alias("k1"), "k2").join(told, ["k1", "k2"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = named.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
