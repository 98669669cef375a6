"""Operator 5, language ID with language-bitmask n-gram filters.

Letter n-grams that a language uses often enough are its set. All sets share one bit-sliced Bloom
filter: row ``h(gram)`` holds one bit per language, and the AND of a gram's rows is the mask of all
languages that contain it. A text is decided by the count of its grams per language, less the
false positives that the slice of that language is expected to give.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealwright.llm import common

GRAM = 4
#: A gram is in a language's set from this share of the language's grams on, so a set has at most 1 / RATE grams ...
RATE = 2e-5
#: ... and from this part of the largest share that any language gives it on, so stray words of other languages stay out.
PART = 0.05
HASHES, ROWS_PER_GRAM = 3, 8
UNKNOWN = "und"
#: Code points handled at once.
BLOCK = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str], n: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all letter n-grams of ``texts``, and where the grams of each text begin.

    Texts are lower-cased; everything but letters is one kind of gap. Grams hold a letter at
    least, and none crosses a text.
    """
    gap = " " * (n - 1)
    parts = [gap + t.lower() for t in texts]
    points = np.frombuffer(("".join(parts) + gap).encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[points]
    points = np.where(letter, points, 0).astype(np.uint64)
    ends = np.cumsum([len(p) for p in parts])
    size = max(0, len(points) - n + 1)
    mixed, held = np.zeros(size, np.uint64), np.zeros(size, bool)
    for step in range(n):
        mixed = (mixed ^ points[step : step + size]) * _MIX
        held |= letter[step : step + size]
    mixed ^= mixed >> np.uint64(29)
    mixed *= _MIX
    mixed ^= mixed >> np.uint64(32)
    before = np.concatenate([[0], np.cumsum(held)])
    return mixed[held], before[np.minimum(np.concatenate([[0], ends]), size)]


def blocks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about BLOCK code points, with the index of the first."""
    first, held, size = 0, [], 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= BLOCK:
            yield first, held
            first, held, size = first + len(held), [], 0
    if held:
        yield first, held


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        frame = batch.to_pandas()
        for lang, texts in frame.groupby("lang")["text"]:
            for _, block in blocks(texts.tolist()):
                found, count = np.unique(grams(block)[0].view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(count)], ["lang", "gram", "n"])


def gram_sets(examples: DataFrame, rate: float = RATE, part: float = PART) -> DataFrame:
    """(lang, gram) of the sets that ``examples(text, lang)`` teach."""
    counted = examples.select("text", "lang").mapInArrow(_count, "lang string, gram long, n long")
    counted = common.stage(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    total = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    rated = counted.join(F.broadcast(total), "lang").withColumn("rate", F.col("n") / F.col("total")).where(F.col("rate") >= rate)
    best = rated.groupBy("gram").agg(F.max("rate").alias("best"))
    return rated.join(best, "gram").where(F.col("rate") >= part * F.col("best")).select("lang", "gram")


class Filter:
    """Bit-sliced Bloom filter: ``slices[w]`` is a column of rows with 64 languages each."""

    def __init__(self, langs: list[str], slices: np.ndarray):
        self.langs, self.slices, self.rows = langs, slices, slices.shape[1]
        fill = [((slices[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(langs))]
        self.false = np.array(fill) ** HASHES

    def languages(self, found: np.ndarray, word: int) -> np.ndarray:
        """Mask of the languages (64 from ``64 * word`` on) that contain each gram."""
        mask = np.full(len(found), 2**64 - 1, np.uint64)
        for k in range(HASHES):
            mask &= self.slices[word][_row(found, k, self.rows)]
        return mask

    def shares(self, texts: list[str]) -> np.ndarray:
        """Per text and language: share of the text's grams in the set, corrected for false positives."""
        found, starts = grams(texts)
        size = np.diff(starts)
        out = np.zeros((len(texts), len(self.langs)))
        for i in range(len(self.langs)):
            if i % 64 == 0:
                mask = self.languages(found, i // 64)
            hits = np.concatenate([[0], np.cumsum((mask >> np.uint64(i % 64)) & np.uint64(1), dtype=np.int64)])
            share = (hits[starts[1:]] - hits[starts[:-1]]) / np.maximum(size, 1)
            out[:, i] = np.clip((share - self.false[i]) / (1 - self.false[i]), 0, 1) if self.false[i] < 1 else 0
        return out


def _row(found: np.ndarray, k: int, rows: int) -> np.ndarray:
    return ((found >> np.uint64(21 * k)) & np.uint64(rows - 1)).astype(np.int64)


def train(examples: DataFrame, rate: float = RATE) -> Filter:
    """Learn the filter from ``examples(text, lang)``, nulls left out.

    Its bits are set by Spark; the driver takes only filter rows, of which there are at most
    ``16 / rate`` whatever the size of the input, and the names of the languages.
    """
    known = examples.where("text is not null and lang is not null").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    sets = common.stage(gram_sets(known, rate), "gram-sets")
    sizes = {r.lang: r.n for r in sets.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    rows = min(1 << 21, 1 << max(10, int(np.ceil(np.log2(ROWS_PER_GRAM * max(sizes.values(), default=1))))))
    slices = np.zeros((max(1, -(-len(langs) // 64)), rows), np.uint64)
    at = F.explode(F.array(*[F.shiftrightunsigned("gram", 21 * k).bitwiseAND(rows - 1) for k in range(HASHES)]))
    for word in range(len(slices)):
        bits = {lang: 1 << i for i, lang in enumerate(langs[64 * word : 64 * word + 64])}
        if not bits:
            continue
        of = F.create_map(*[F.lit(x) for k, v in bits.items() for x in (k, v - (1 << 64 if v >> 63 else 0))])
        mine = sets.where(F.col("lang").isin(list(bits))).select(of[F.col("lang")].cast("long").alias("bit"), at.alias("at"))
        for r in mine.groupBy("at").agg(F.bit_or("bit").alias("mask")).collect():
            slices[word, r["at"]] = np.uint64(r.mask & (2**64 - 1))
    return Filter(langs, slices)


def identify(docs: DataFrame, model: Filter) -> DataFrame:
    """``docs`` as a struct ``row``, with ``lang_pred`` and ``score`` for its ``text``.

    ``und`` and 0 for a null text, one without a letter, or when no language was learned. Ties go
    to the first language by code point. The score is the share of the text's grams that the
    language contains, corrected for false positives.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def decide(texts: pd.Series) -> pd.DataFrame:
        filled, letters = held.value, _letters()
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        for first, block in blocks(texts.tolist()):
            if not filled.langs:
                break
            shares = filled.shares(block)
            best = shares.argmax(axis=1)
            for i, text in enumerate(block):
                if any(map(str.isalpha, text)):
                    langs[first + i], scores[first + i] = filled.langs[best[i]], shares[i, best[i]]
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    # a deterministic function is run again, by workers of its own, for a filter on what it gives
    decide = decide.asNondeterministic()
    named = docs.select(F.struct("*").alias("row"), decide(F.col("text").cast("string")).alias("found"))
    return named.select("row", "found.lang_pred", "found.score")


def examples(docs: DataFrame) -> DataFrame:
    return docs.where(~common.held_out(F.col("doc_id"))).select("text", "lang")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), train(examples(docs)))
    return found.select("row.doc_id", common.held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")
