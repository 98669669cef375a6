"""Operator 1, SimHash near-dedup: a self-join of the binary trie of fingerprints.

The trie of all distinct fingerprints is traversed in pairs of nodes of one depth. A pair carries
the number of bits in which its two prefixes differ and is dropped as soon as that exceeds the
budget. The top of the traversal is relational: a fingerprint goes to every pair of subtries whose
prefixes differ by at most ``budget`` bits. Each pair of subtries is then one group, traversed with
arrays; groups that are still too large go down further first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealwright.llm import common

BITS = 64
BUDGET = 2
WIDTH = 3
#: Fingerprints that one subtrie holds on average, and most rows of a pair of subtries before it goes deeper.
SUBTRIE, PAIR_ROWS = 1 << 16, 1 << 19
#: Fewest levels that the relational part takes, so that small inputs also spread.
LEAST_DEPTH = 4
#: Node pairs handled at once in a task, and pairs of entries below which a node pair is compared directly.
FRONTIER, DIRECT = 1 << 17, 8

_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """Majority of the XXH64 bits (seed 42) over all word shingles; A-Z are lower-cased."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    hashes = np.fromiter(map(_hash, shingles), np.uint64, max(1, len(words) - width + 1))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series, widths: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t, w) for t, w in zip(texts, widths)], dtype="uint64").astype("int64")


def _fp(width: int) -> Column:
    return _fingerprints(F.col("text").cast("string").cast("binary"), F.lit(width))


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp) for every row of ``docs(doc_id, text)``; no words or a null text: fingerprint 0."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _fp(width).alias("fp"))


def _children(ones: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Where a node's second child begins; ``ones``: running count of set bits at its depth."""
    return high - (ones[high] - ones[low])


def trie_links(left: np.ndarray, right: np.ndarray, same: bool, depth: int, used: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two sorted subtries of one depth that differ in at most ``budget`` bits.

    ``same``: both are one subtrie, and each pair comes once. ``used``: bits by which the two
    prefixes differ. Work is kept in chunks of node pairs, so memory stays bounded.
    """
    if not len(left) or not len(right):
        return
    zero = np.zeros(1, np.int64)
    stack = [(depth, zero, zero + len(left), zero, zero + len(right), zero + used)]
    running: dict[tuple[int, bool], np.ndarray] = {}

    def ones(values: np.ndarray, at: int, first: bool) -> np.ndarray:
        if (at, first) not in running:
            bits = (values >> np.uint64(BITS - 1 - at)) & np.uint64(1)
            running[at, first] = np.concatenate([[0], np.cumsum(bits.astype(np.int64))])
        return running[at, first]

    while stack:
        depth, a0, a1, b0, b1, diff = stack.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack.append((depth, a0[half:], a1[half:], b0[half:], b1[half:], diff[half:]))
            stack.append((depth, a0[:half], a1[:half], b0[:half], b1[:half], diff[:half]))
            continue
        product = (a1 - a0) * (b1 - b0)
        # entries that differ in no further bit are single values, so all pairs are small by the last depth
        direct = (product <= DIRECT) | (depth == BITS)
        if direct.any():
            count = product[direct]
            pair = np.repeat(np.flatnonzero(direct), count)
            nth = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
            wide = (b1 - b0)[pair]
            i, j = a0[pair] + nth // wide, b0[pair] + nth % wide
            near = np.bitwise_count(left[i] ^ right[j]) <= budget
            if same:
                near &= i < j
            if near.any():
                yield i[near], j[near]
        go = ~direct
        if not go.any():
            continue
        a0, a1, b0, b1, diff = a0[go], a1[go], b0[go], b1[go], diff[go]
        am, bm = _children(ones(left, depth, True), a0, a1), _children(ones(right, depth, same), b0, b1)
        parts = [(a0, am, b0, bm, diff), (am, a1, bm, b1, diff), (a0, am, bm, b1, diff + 1)]
        mirrored = (am, a1, b0, bm, diff + 1)
        if same:
            twice = a0 != b0
            mirrored = tuple(x[twice] for x in mirrored)
        nexts = [np.concatenate(column) for column in zip(*parts, mirrored)]
        alive = (nexts[1] > nexts[0]) & (nexts[3] > nexts[2]) & (nexts[4] <= budget)
        if alive.any():
            stack.append((depth + 1, *(x[alive] for x in nexts)))


def _pair(frame: pd.DataFrame, budget: int) -> pd.DataFrame:
    """Links within one pair of subtries, reduced to a forest of stars: (u, v) fingerprints."""
    depth, mask = int(frame["depth"].iloc[0]), np.uint64(int(frame["mask"].iloc[0]) & (2**64 - 1))
    side = frame["side"].to_numpy()
    values = frame["fp"].to_numpy().view(np.uint64)
    left, right = np.sort(values[side == 0]), np.sort(values[side == 1])
    same = mask == 0
    every = left if same else np.concatenate([left, right])
    labels, shift = np.arange(len(every)), 0 if same else len(left)
    for i, j in trie_links(left, left if same else right, bool(same), depth, int(np.bitwise_count(mask)), budget):
        labels = common.hook(labels, i, j + shift)
    moved = np.flatnonzero(labels != np.arange(len(every)))
    return pd.DataFrame({"u": every[moved].view(np.int64), "v": every[labels[moved]].view(np.int64)})


def _masks(width: int, budget: int) -> list[int]:
    return [sum(1 << i for i in bits) for k in range(budget + 1) for bits in combinations(range(width), k)]


def _descend(rows: DataFrame, depth: int, steps: int, budget: int) -> DataFrame:
    """Rows (node, mask, side, fp) of pairs at ``depth`` dealt to their pairs ``steps`` levels deeper."""
    down = depth + steps
    ends = F.array(*[F.lit(m).cast("long") for m in _masks(steps, budget)])
    within = F.filter(ends, lambda m: F.bit_count("mask") + F.bit_count(m) <= budget)
    rows = rows.withColumn("more", F.explode(within))
    mask = F.shiftleft("mask", steps).bitwiseOR(F.col("more"))
    own = F.shiftrightunsigned("fp", BITS - down) if down < BITS else F.col("fp")
    other = own.bitwiseXOR(mask)
    first = F.when(F.col("mask") == 0, own <= other).otherwise(F.col("side") == 0)
    return rows.select(
        F.when(first, own).otherwise(other).alias("node"),
        mask.alias("mask"),
        F.when(first, 0).otherwise(1).alias("side"),
        "fp",
        F.lit(down).alias("depth"),
    )


def trie_join(values: DataFrame, budget: int = BUDGET, subtrie: int = SUBTRIE, pair_rows: int = PAIR_ROWS) -> DataFrame:
    """Forest (u, v) that connects the distinct fingerprints ``values(fp)`` within ``budget`` bits.

    A link is never lost: two fingerprints meet in the one pair of subtries that their prefixes
    form. Links are reduced to stars per pair of subtries, as only the classes are asked for.
    """
    total = values.count()
    depth = min(24, max(LEAST_DEPTH, int(np.ceil(np.log2(max(1, total) / subtrie)))))
    root = values.select(F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("mask"), F.lit(0).alias("side"), "fp")
    rows, found = _descend(root, 0, depth, budget), None
    while True:
        sizes = rows.groupBy("node", "mask").agg(F.count("*").alias("n"))
        over = common.stage(sizes.where((F.col("n") > pair_rows) & F.lit(depth < BITS)), "wide-pairs")
        wide = over.select("node", "mask").count()
        small = rows.join(over, ["node", "mask"], "left_anti") if wide else rows
        forest = small.groupBy("node", "mask").applyInPandas(lambda frame: _pair(frame, budget), "u long, v long")
        found = forest if found is None else found.unionByName(forest)
        if not wide:
            return found
        rows = common.stage(_descend(rows.join(over, ["node", "mask"], "left_semi"), depth, min(4, BITS - depth), budget), "deeper-pairs")
        depth = min(BITS, depth + 4)


def classes(found: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(fp, component_id) for ``found(doc_id, fp)``: the smallest id that links can reach from a fingerprint."""
    distinct = common.stage(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = common.connected_components(trie_join(distinct.select("fp"), budget))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id", "root")


def near_duplicates(docs: DataFrame, budget: int = BUDGET, width: int = WIDTH) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Rows with a null id keep their fingerprint and link like any other; a class takes its smallest
    id that is not null, and null if it has none. Repeated rows come back as often as they came. An
    empty table gives no rows. Other columns are ignored.
    """
    found = common.stage(fingerprints(docs, width), "fingerprints")
    text = F.lpad(F.lower(F.hex("fp")), BITS // 4, "0").alias("fingerprint")
    return found.join(classes(found, budget), "fp").select("doc_id", text, "component_id")


def keep_first(docs: DataFrame, budget: int = BUDGET, width: int = WIDTH) -> DataFrame:
    """``docs`` with one row of each class: the one with the smallest id, a null id last.

    Of equal ids in a class one row stays. All columns stay as they were.
    """
    named = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), _fp(width).alias("fp"))
    rows = common.stage(named.withColumn("rid", F.monotonically_increasing_id()), "fingerprinted")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid"))
    ranked = common.stage(rows.groupBy("fp").agg(least.alias("least")), "first-of-fingerprint")
    rooted = classes(rows.select("doc_id", "fp"), budget)
    first = ranked.join(rooted, "fp").groupBy("root").agg(F.min("least").alias("least")).select("least.rid")
    return rows.join(first, "rid", "left_semi").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "documents", "doc_id", "text"))
