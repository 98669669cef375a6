"""Operator 12, ranked lexical search by bit-sliced Bloom signatures.

Documents of like size form a block. Each sets, for every term, the bits of a Bloom filter; a block keeps the
filter bit by bit, so that one bit's slice is a bitmap over its documents. AND of a term's slices overestimates
where the term is. A second filter entry tells that the term occurs twice, a third three times, and so on
(``STEPS``), so bitmaps also bound the number of occurrences from above. Weighted sums of these bitmaps give an
upper bound of each document's score. The documents with the highest bounds are scored exactly; the last of the
wanted ones gives a score to beat, and every document whose bound does not stay below it is scored exactly.

Blocks hold no text. Queries are a stated set: they are taken in groups of bounded size, each sent to all tasks.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sealwright.llm import common

TOP = 50
#: BM25 with k1 = 2 and b = 0.5, in thousandths and hundredths.
ONE, B = 1_000_000_000, 50
#: Filter bits for each entry, and slices of one entry: a rare term weighs more than all common ones together, so one
#: seen falsely makes a document a candidate, and an item has some forty terms.
BITS, HASHES = 24, 10
#: An entry tells that a term occurs at least so often; beyond the last the document's words bound it.
STEPS = (1, 2, 3, 4, 5, 6, 8, 10, 13, 17, 22, 29, 38, 50, 65, 85, 110, 150, 200, 300, 500, 1000, 2500, 10_000)
#: Entries and documents of a block.
ENTRIES, DOCUMENTS = 1 << 19, 2048
#: Entries of a task's dictionary before it hands them on; query rows and terms sent to a task at once; candidates
#: sent to all tasks, counted first.
WORDS, QUERIES, QUERY_TERMS, CANDIDATES = 200_000, 2_000, 500_000, 200_000

_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_NEXT = np.array([s - 1 for s in STEPS[1:]] + [np.iinfo(np.int64).max])
_BLOCK = "slots int, ids binary, texts binary, sizes binary, slices binary"
_INDEX = f"{_BLOCK}, term string, df long, docs long, terms long"


def terms(text: str | None) -> list[str]:
    return _TERM.findall((text or "").translate(_LOW))


def _slots(hashes: np.ndarray, steps: np.ndarray | int, slots: int) -> Iterator[np.ndarray]:
    """The slices of entries (term hash, step): HASHES times a number below ``slots`` for each."""
    with np.errstate(over="ignore"):
        mixed = (hashes + np.asarray(steps).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        one, two = mixed & np.uint64(0xFFFFFFFF), (mixed >> np.uint64(32)) * np.uint64(2) + np.uint64(1)
        for _ in range(HASHES):
            yield ((one & np.uint64(0xFFFFFFFF)) % np.uint64(slots)).astype(np.int64)
            one = one + two


def _hash(words: Iterable[str], known: dict[str, int] | None = None) -> np.ndarray:
    """64-bit hashes of terms; ``known`` keeps those of terms met before."""
    if known is None:
        return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    return np.array([known[w] for w in words], np.uint64)


def entries(hashes: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(term hash, step) of each filter entry of terms that reach ``often`` steps."""
    starts = np.cumsum(often) - often
    return np.repeat(hashes, often), np.arange(int(often.sum())) - np.repeat(starts, often)


class _Block:
    """Documents whose entries number between two powers of two, until the block is full."""

    def __init__(self, size: int) -> None:
        self.slots = max(64, BITS << size)
        self.room = min(DOCUMENTS, max(64, ENTRIES >> size))
        self.ids: list[int] = []
        self.texts: list[int] = []
        self.sizes: list[int] = []
        self.entries: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, row: int, text: int, size: int, hashes: np.ndarray, steps: np.ndarray) -> bool:
        self.entries.append((hashes, steps))
        self.ids.append(row)
        self.texts.append(text)
        self.sizes.append(size)
        return len(self.ids) == self.room

    def row(self) -> dict:
        n = len(self.ids)
        slots = _slots(*(np.concatenate(c) for c in zip(*self.entries)), self.slots)
        owner = np.repeat(np.arange(n), [len(h) for h, _ in self.entries])
        bits = np.zeros((self.slots, -(-n // 64) * 64), bool)
        for own in slots:
            bits[own, owner] = True
        packed = {"ids": self.ids, "texts": self.texts, "sizes": self.sizes}
        slices = np.packbits(bits, axis=1, bitorder="little").tobytes()
        return {"slots": self.slots, "slices": slices} | {c: np.array(v, np.int64).tobytes() for c, v in packed.items()}


def _rows(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"slots": pa.int32(), "ids": pa.binary(), "texts": pa.binary(), "sizes": pa.binary(), "slices": pa.binary(), "term": pa.string(), "df": pa.int64(), "docs": pa.int64(), "terms": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], k) for c, k in kinds.items()], list(kinds))


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks: dict[int, _Block] = {}
    seen: Counter = Counter()
    known: dict[str, int] = {}
    for batch in batches:
        docs = total = 0
        for row, digest, text in zip(*(batch.column(c).to_pylist() for c in ("_id", "_digest", "_text"))):
            counts = Counter(terms(text))
            if not counts:
                continue
            docs, size = docs + 1, sum(counts.values())
            total += size
            seen.update(counts.keys())
            often = np.searchsorted(STEPS, np.fromiter(counts.values(), np.int64, len(counts)), "right")
            hashes, steps = entries(_hash(counts, known), often)
            kind = max(3, (len(hashes) - 1).bit_length())
            block = blocks.setdefault(kind, _Block(kind))
            if block.add(row, digest, size, hashes, steps):
                yield _rows([blocks.pop(kind).row()])
        if docs:
            yield _rows([{"docs": docs, "terms": total}])
        if len(seen) > WORDS:
            yield _rows([{"term": t, "df": n} for t, n in seen.items()])
            seen.clear()
            known.clear()
    for block in blocks.values():
        yield _rows([block.row()])
    if seen:
        yield _rows([{"term": t, "df": n} for t, n in seen.items()])


def named(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` as (key, _id, _digest, _text): ``_id`` and ``_digest`` are 64-bit marks of the key and of the text.

    Marks only find rows again. Rows that share both are all scored, each by its own text.
    """
    own = F.col(text).cast("string")
    mark = F.coalesce(F.col(key), F.lit(0)) if dict(docs.dtypes)[key] in ("bigint", "int") else F.xxhash64(key)
    return docs.select(F.col(key), mark.cast("long").alias("_id"), F.xxhash64(own).alias("_digest"), own.alias("_text"))


def build(rows: DataFrame) -> DataFrame:
    """The stored index of ``named`` rows: blocks, and sums by term (``df``) and of all (``docs``, ``terms``) by task."""
    return common.stage(rows.select("_id", "_digest", "_text").mapInArrow(_build, _INDEX), "signatures")


@dataclass
class Queries:
    """Queries of one group: their distinct terms, and for each query its terms' numbers and weights."""

    numbers: list[int]
    words: list[str]
    own: list[np.ndarray]
    weights: list[np.ndarray]
    docs: int
    terms: int

    def middle(self, sizes: np.ndarray) -> np.ndarray:
        """The length term of each document."""
        scale = B * self.docs
        exact = int(sizes.max(initial=0)) * scale < 1 << 62
        ratio = (scale * sizes) // self.terms if exact else np.array([scale * int(s) // self.terms for s in sizes], np.int64)
        return 100 - B + ratio


def _part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's share of a score before its weight, by its occurrences."""
    return (ONE * tf) // (1000 * tf + 20 * m)


def bounds(queries: Queries, hashes: np.ndarray, slots: int, slices: bytes, sizes: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores of a block's documents, query by document.

    A bitmap of ``tf >= step`` is worth what the next step would at most add, so the sum over the steps of a term is
    the part of its highest step still possible. All is whole numbers below 2**53, exact as doubles.
    """
    n = len(sizes)
    table = np.frombuffer(slices, np.uint8).reshape(slots, -1)
    m = queries.middle(sizes)
    out = np.zeros((len(queries.own), n))
    open_ = np.arange(len(queries.words))
    before = np.zeros(n, np.int64)
    bits = None
    for k in range(len(STEPS)):
        at = _slots(hashes[open_], k, slots)
        now = table[next(at)]
        for row in at:
            now &= table[row]
        if bits is not None:
            now &= bits
        some = now.any(axis=1)
        open_, bits = open_[some], now[some]
        if not len(open_):
            break
        part = _part(np.minimum(_NEXT[k], sizes), m)
        worth = np.maximum(part - before, 0)
        before = np.maximum(part, before)
        place = np.full(len(queries.words), -1)
        place[open_] = np.arange(len(open_))
        there = np.unpackbits(bits, axis=1, bitorder="little")[:, :n]
        for q, own in enumerate(queries.own):
            mine = place[own]
            have = mine >= 0
            if have.any():
                out[q] += worth * (queries.weights[q][have] @ there[mine[have]])
    return out


def _blocks(batch: pa.RecordBatch):
    for slots, ids, texts, sizes, slices in zip(*(batch.column(c) for c in ("slots", "ids", "texts", "sizes", "slices"))):
        yield slots.as_py(), np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(texts.as_buffer(), np.int64), np.frombuffer(sizes.as_buffer(), np.int64), slices.as_buffer()


_FOUND = "query long, id long, digest long, bound long"


def _found(parts: list[tuple]) -> pa.RecordBatch:
    columns = [np.concatenate(c) if parts else np.zeros(0, np.int64) for c in (zip(*parts) if parts else [()] * 4)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query", "id", "digest", "bound"])


def _leading(queries: Queries, top: int):
    """The ``top`` documents of a task with the highest bounds, for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _hash(queries.words)
        held: list[np.ndarray | None] = [None] * len(queries.own)
        for batch in batches:
            for slots, ids, texts, sizes, slices in _blocks(batch):
                upper = bounds(queries, hashes, slots, slices, sizes)
                for q, row in enumerate(upper):
                    least = held[q][3, -1] if held[q] is not None and held[q].shape[1] == top else 0
                    at = np.flatnonzero(row > least)
                    if not len(at):
                        continue
                    if len(at) > top:
                        at = at[np.argpartition(-row[at], top - 1)[:top]]
                    new = np.stack([np.full(len(at), queries.numbers[q]), ids[at], texts[at], row[at].astype(np.int64)])
                    all_ = new if held[q] is None else np.concatenate([held[q], new], axis=1)
                    held[q] = all_[:, np.argsort(-all_[3], kind="stable")[:top]]
        yield _found([tuple(h) for h in held if h is not None])

    return run


def _possible(queries: Queries, beaten: dict[int, tuple[int, int | None]]):
    """Documents whose bound is not below the score to beat of a query; at that bound, whose id does not come later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _hash(queries.words)
        for batch in batches:
            for slots, ids, texts, sizes, slices in _blocks(batch):
                upper, parts = bounds(queries, hashes, slots, slices, sizes), []
                for q, row in enumerate(upper):
                    least, last = beaten.get(queries.numbers[q], (1, None))
                    at = np.flatnonzero(row >= least if last is None else (row > least) | ((row == least) & (ids <= last)))
                    parts.append((np.full(len(at), queries.numbers[q]), ids[at], texts[at], row[at].astype(np.int64)))
                yield _found(parts)

    return run


def _score(queries: Queries, names: list[str]):
    """Exact scores of the queries named beside each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {number: k for k, number in enumerate(queries.numbers)}
        for batch in batches:
            rows, numbers, scores = [], [], []
            for r, (text, asked) in enumerate(zip(batch.column("_text").to_pylist(), batch.column("queries").to_pylist())):
                counts = Counter(terms(text))
                m = int(queries.middle(np.array([sum(counts.values())]))[0])
                for number in asked:
                    own, weights = queries.own[place[number]], queries.weights[place[number]]
                    tfs = [counts.get(queries.words[t], 0) for t in own]
                    score = sum(int(w) * ((ONE * tf) // (1000 * tf + 20 * m)) for tf, w in zip(tfs, weights) if tf)
                    if score > 0:
                        rows.append(r)
                        numbers.append(number)
                        scores.append(score)
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *[kept.column(c) for c in names], pa.array(scores, pa.int64())], ["query", *names, "score"])

    return run


def _exact(found: DataFrame, rows: DataFrame, queries: Queries, key: str) -> DataFrame:
    """(query, key, _id, score) of the documents in ``found``, scored by their texts."""
    asked = found.groupBy("id", "digest").agg(F.collect_set("query").alias("queries"))
    few = common.bounded_broadcast(asked, CANDIDATES)
    met = rows.join(few, (F.col("_id") == F.col("id")) & (F.col("_digest") == F.col("digest"))).select(key, "_id", "_text", "queries")
    kind = rows.schema[key].dataType.simpleString()
    return met.mapInArrow(_score(queries, [key, "_id"]), f"query long, `{key}` {kind}, _id long, score long")


def _asked(items: DataFrame, text: str) -> DataFrame:
    """(query, term): each item's terms, once each."""
    low = F.translate(F.col(text).cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    return items.select("query", F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0)))).alias("term"))


def _groups(asked: DataFrame, docs: int, terms_: int, df: DataFrame) -> Iterator[Queries]:
    """The queries in groups of at most QUERIES queries, and of QUERY_TERMS terms unless one query has more."""
    weighed = common.stage(asked.join(df, "term"), "asked")
    sizes = weighed.groupBy("query").agg(F.count("*").alias("n"))
    ordered = sizes.orderBy("query").toLocalIterator()

    def load(numbers: list[int]) -> Queries:
        rows = weighed.where(F.col("query").between(numbers[0], numbers[-1])).collect()
        words = sorted({r.term for r in rows})
        at = {w: k for k, w in enumerate(words)}
        own: dict[int, list] = {n: [] for n in numbers}
        for r in rows:
            own[r.query].append((at[r.term], math.floor(1000 * math.log((2 * docs + 2) / (2 * r.df + 1)))))
        pairs = [np.array(sorted(own[n]), np.int64).reshape(-1, 2) for n in numbers]
        return Queries(numbers, words, [p[:, 0] for p in pairs], [p[:, 1] for p in pairs], docs, terms_)

    numbers, total = [], 0
    for row in ordered:
        if numbers and (len(numbers) == QUERIES or total + row.n > QUERY_TERMS):
            yield load(numbers)
            numbers, total = [], 0
        numbers.append(row["query"])
        total += row.n
    if numbers:
        yield load(numbers)


def _best(scored: DataFrame, key: str, top: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col(key).asc_nulls_last())
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", top: int = TOP) -> DataFrame:
    """(item, rank, key, score): the ``top`` documents of each item with a score above 0, equal scores by ascending key.

    Null texts have no term and are never found; an item without a term that any document has finds nothing. Each
    row of ``items`` is an item, also if its id is null or repeated; equal documents are ranked each by itself, null keys
    after others. Without documents or items there are no rows.
    """
    spark = docs.sparkSession
    rows = named(docs, key, text)
    asked = common.stage(items.select(F.col(item).alias("item"), F.col(text).alias("_text")).withColumn("query", F.monotonically_increasing_id()), "queries")
    index = build(rows)
    sums = index.agg(F.sum("docs"), F.sum("terms")).first()
    kind = rows.schema[key].dataType.simpleString()
    out = spark.createDataFrame([], f"query long, rank int, `{key}` {kind}, score long")
    if sums[0]:
        df = index.where("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
        blocks = index.where("slices is not null").select("slots", "ids", "texts", "sizes", "slices")
        ordered = dict(docs.dtypes)[key] in ("bigint", "int")
        for queries in _groups(_asked(asked, "_text"), sums[0], sums[1], df):
            leading = common.stage(blocks.mapInArrow(_leading(queries, top), _FOUND), "leading")
            rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "id", "digest"))
            leading = leading.withColumn("n", rank).where(F.col("n") <= top)
            last = _best(_exact(leading, rows, queries, key), key, top).where(F.col("rank") == top)
            # ids order ties only where they are the key, and a null key comes last
            beaten = {r["query"]: (r.score, r._id if ordered and r[key] is not None else None) for r in last.collect()}
            possible = common.stage(blocks.mapInArrow(_possible(queries, beaten), _FOUND), "possible")
            out = out.unionByName(_best(_exact(possible, rows, queries, key), key, top).select("query", "rank", key, "score"))
    return asked.select("query", "item").join(out, "query").select(F.col("item").alias(item), "rank", key, "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.read(spark, sf_dir, "documents", "doc_id", "text"), common.read(spark, sf_dir, "benchmark", "item_id", "text"))


SQL = r"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents where text is not null),
tok as (select rid, unnest(w) as t from d),
tf as (select rid, t, count(*) as tf from tok group by rid, t),
df as (select t, count(*) as df from tf group by t),
len as (select rid, doc_id, cast(len(w) as bigint) as n from d where len(w) > 0),
tot as (select cast(count(*) as bigint) as docs, cast(sum(n) as bigint) as terms from len),
q as (select row_number() over () as qid, item_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as w from benchmark where text is not null),
qt as (select qid, item_id, unnest(w) as t from q),
w as (select qid, item_id, t, cast(floor(1000 * ln((2.0::double * docs + 2) / (2.0::double * df + 1))) as bigint) as w from qt join df using (t), tot),
s as (select qid, item_id, doc_id, rid, cast(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (50 + (50 * n * docs) // terms)))) as bigint) as score
  from w join tf using (t) join len using (rid), tot group by qid, item_id, doc_id, rid),
r as (select item_id, doc_id, score, row_number() over (partition by qid order by score desc, doc_id nulls last) as rank from s where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from r where rank <= 50
"""
