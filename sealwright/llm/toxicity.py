"""Operator 6, toxicity by maximum-scoring segments.

Tokens get log-odds of the toxic against the clean class, smoothed by nested Dirichlet priors: a
word shrinks to its stem class (first letters), a stem class to the corpus. A linear scan finds
all maximal scoring segments of a text. Segment scores are calibrated by the extreme-value law of
such segments in clean text (``E = K n exp(-lambda S)``); the significant ones of a document are
added up, and the share of toxic labels at that sum, pooled until it only rises, is the score.

The lexicon learns from folds 0 and 1 of the labels and the calibration from fold 3, so a document
never calibrates the words that it taught.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealwright.llm import common

LEXICON_FOLDS, CALIBRATION_FOLDS = (0, 1), (3,)
#: Most labelled rows used; above it a hash sample of that size is taken.
MOST_LABELS = 2_000_000
#: Weights of the prior of a stem class and of a word; letters of a stem; share of lexicon words in a toxic passage.
STEM_PRIOR, WORD_PRIOR, STEM, DENSITY = 10.0, 5.0, 4, 0.2
#: A lexicon entry's log-odds, its documents, and its share of all token documents (so at most 1 / RATE entries).
LEAST_ODDS, LEAST_DOCS, RATE = 1.0, 3, 1e-6
#: A document is toxic from this score on.
TOXIC = 0.3
CELLS = 64
_TOKEN = re.compile(r"[^\W\d_]+")


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    other: float = math.log(1 - DENSITY)
    scale: float = 1.0  #: lambda
    spread: float = 1.0  #: K

    def hits(self, tokens: list[str]) -> list[tuple[int, float]]:
        words, stems = self.words, self.stems
        found = []
        for i, token in enumerate(tokens):
            odds = words.get(token)
            if odds is None:
                odds = stems.get(token[:STEM])
            if odds is not None:
                found.append((i, odds))
        return found


def maximal_segments(scores: list[tuple[int, float]], other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a token sequence, in linear time.

    ``scores``: (position, score) of the tokens that are not worth ``other`` (below 0). A segment
    is kept when no other holds it and scores more, and none in it reaches its score alone.
    """
    total, at = 0.0, -1
    held: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum after
    for place, score in scores:
        total += other * (place - at - 1)
        at = place
        if score <= 0:
            total += score
            continue
        first, last, before, after = place, place, total, total + score
        total = after
        while held:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= before:
                j -= 1
            if j < 0 or held[j][3] >= after:
                break
            first, before = held[j][0], held[j][2]
            del held[j:]
        held.append((first, last, before, after))
    return [(a, b, y - x) for a, b, x, y in held]


def evidence(text: str | None, lexicon: Lexicon) -> tuple[float, list[tuple[int, int, float]]]:
    """Sum of the significant segments' calibrated scores, and those segments in tokens."""
    tokens = _TOKEN.findall((text or "").lower())
    hits = lexicon.hits(tokens)
    if not hits:
        return 0.0, []
    chance = math.log(max(lexicon.spread * len(tokens), 1e-12))
    bits = [(a, b, lexicon.scale * s - chance) for a, b, s in maximal_segments(hits, lexicon.other)]
    passages = [x for x in bits if x[2] > 0]
    return sum(x[2] for x in passages), passages


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic, all_ = {}, {}
        for text, mark in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            for token in set(_TOKEN.findall((text or "").lower())):
                all_[token] = all_.get(token, 0) + 1
                if mark:
                    toxic[token] = toxic.get(token, 0) + 1
        keys = list(all_)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array(all_.values(), pa.int64()), pa.array([toxic.get(k, 0) for k in keys], pa.int64())], ["token", "n", "t"]
        )


def labelled(labels: DataFrame, folds: tuple[int, ...], most: int = MOST_LABELS) -> DataFrame:
    """(id, toxic) of the labels in ``folds``, at most about ``most``; a document with several is toxic if any says so."""
    known = labels.where("doc_id is not null and toxic is not null").where(common.fold(F.col("doc_id")).isin(*folds))
    single = common.stage(known.groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic")), "labels")
    total = single.count()
    if total > most:
        single = single.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(most / total * (1 << 30)))
    return single


def learn(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """The lexicon of ``docs(doc_id, text)`` whose fold is one of LEXICON_FOLDS."""
    told = labelled(labels, LEXICON_FOLDS)
    # the number of labels is bounded by MOST_LABELS, 16 bytes each
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(told), F.col("doc_id") == F.col("id")).select("text", "toxic")
    counted = rows.mapInArrow(_tokens, "token string, n long, t long").groupBy("token").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    counted = common.stage(counted.withColumn("stem", F.substring("token", 1, STEM)), "tokens")
    every = counted.agg(F.sum("n").alias("n"), F.sum("t").alias("t")).first()
    if not every.n or not every.t or every.t == every.n:
        return Lexicon()
    base = every.t / every.n
    usual = math.log(base / (1 - base))
    least = max(LEAST_DOCS, RATE * every.n)
    odds = lambda share: F.log(share / (1 - share)) - usual
    stems = counted.groupBy("stem").agg(F.sum("n").alias("stem_n"), F.sum("t").alias("stem_t"))
    stems = stems.withColumn("share", (F.col("stem_t") + STEM_PRIOR * base) / (F.col("stem_n") + STEM_PRIOR))
    listed = stems.withColumn("odds", odds(F.col("share"))).where((F.col("odds") >= LEAST_ODDS) & (F.col("stem_n") >= least))
    share = (F.col("t") + WORD_PRIOR * F.col("share")) / (F.col("n") + WORD_PRIOR)
    words = counted.join(stems, "stem").withColumn("odds", odds(share)).where(F.col("n") >= least)
    # a word below LEAST_ODDS is listed only to take it out of its stem's class
    words = words.join(listed.select("stem", F.lit(True).alias("in_class")), "stem", "left")
    words = words.where((F.col("odds") >= LEAST_ODDS) | F.col("in_class")).select("token", "odds", "n", "t")
    entries = {r.token: r.odds if r.odds > 0 else None for r in words.collect()}
    clean = words.where("odds > 0").groupBy(F.round("odds", 1).alias("odds")).agg(F.sum(F.col("n") - F.col("t")).alias("c")).collect()
    lexicon = Lexicon({k: v if v is not None else math.log(1 - DENSITY) for k, v in entries.items()}, {r.stem: r.odds for r in listed.collect()})
    lexicon.scale = _lambda([(r.odds, r.c / (every.n - every.t)) for r in clean], lexicon.other)
    # segments begin at lexicon words, so their number in clean text follows from how often it has these
    hits = (sum(r.c for r in clean) + 0.5) / (every.n - every.t + 1)
    lexicon.spread = min(1.0, hits * math.exp(lexicon.scale * LEAST_ODDS))
    return lexicon


def _lambda(scores: list[tuple[float, float]], other: float) -> float:
    """The positive root of ``sum p exp(lambda s) = 1`` over clean tokens, at most 1."""
    rest = max(0.0, 1 - sum(p for _, p in scores))
    excess = lambda x: sum(p * math.exp(x * s) for s, p in scores) + rest * math.exp(x * other) - 1
    if excess(1.0) <= 0:
        return 1.0
    low, high = 1e-3, 1.0
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return low


def _scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([evidence(t, held.value)[0] for t in texts], dtype="float64")

    return docs.select("doc_id", score(F.col("text").cast("string")).alias("evidence"))


def passages(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, first_token, last_token, score) of every significant toxic passage."""
    held = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("array<struct<first_token:long,last_token:long,score:double>>")
    def spans(texts: pd.Series) -> pd.Series:
        names = ("first_token", "last_token", "score")
        return pd.Series([[dict(zip(names, s)) for s in evidence(t, held.value)[1]] for t in texts], dtype=object)

    return docs.select("doc_id", F.explode(spans(F.col("text").cast("string"))).alias("s")).select("doc_id", "s.*")


def calibrate(rows: DataFrame, labels: DataFrame) -> list[float]:
    """Share of toxic labels per cell of evidence, rising: pooled adjacent violators over CELLS cells."""
    told = labelled(labels, CALIBRATION_FOLDS)
    seen = rows.join(F.broadcast(told), F.col("doc_id") == F.col("id")).groupBy(_cell().alias("cell"))
    got = {r.cell: (r.n, r.t) for r in seen.agg(F.count("*").alias("n"), F.sum("toxic").cast("long").alias("t")).collect()}
    n, t = sum(x[0] for x in got.values()), sum(x[1] for x in got.values())
    usual = (t + 0.5) / (n + 5)
    pools: list[list[float]] = []
    for cell in range(CELLS):
        count, toxic = got.get(cell, (0, 0))
        # cells without evidence or labels lean to the overall share, those with strong evidence to toxic
        prior = usual if cell == 0 else 0.5 + 0.5 * cell / CELLS
        pools.append([toxic + prior, count + 1.0, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            top = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], top)]
    return [p[0] / p[1] for p in pools for _ in range(int(p[2]))]


def _cell():
    """Cell of the evidence: 0 for none, else by its root, up to the last."""
    return F.when(F.col("evidence") <= 0, 0).otherwise(F.least(F.lit(CELLS - 1), 1 + F.floor(4 * F.sqrt("evidence")))).cast("int")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs(doc_id, text)``.

    Labels (doc_id, toxic) teach from folds other than 2 only. Null and empty texts have no
    evidence and get the score of texts without any. Without labels every score is the prior.
    Repeated rows come back as often as they came; a null id is not held out.
    """
    rows = common.stage(_scored(docs, learn(docs, labels)), "evidence")
    shares = F.array(*[F.lit(float(s)) for s in calibrate(rows, labels)])
    got = rows.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), F.element_at(shares, _cell() + 1).alias("score"))
    return got.withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.read(spark, sf_dir, "documents", "doc_id", "text"), common.read(spark, sf_dir, "labels", "doc_id", "toxic"))
