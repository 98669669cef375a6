"""Operator 2, quality rules with risk-controlled thresholds.

Each rule rejects a document whose ratio is above a cutoff. Cutoffs are chosen on labelled
documents, per stratum: a cutoff is certified when an exact binomial test refutes that it rejects
more than ``risk / rules`` of the good documents. Cutoffs of a rule are tested from the loosest to
the strictest and the first failure ends the sequence, so one level serves the whole sequence; the
level is split over all rules and strata. With probability ``1 - error`` no stratum then loses more
than ``risk`` of its good documents to the rules. A stratum with too few labels rejects nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sealwright.llm import common

RISK, ERROR = 0.1, 0.1
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Cutoffs of every ratio, fixed before any label is seen.
GRID = tuple(round(0.02 * i, 2) for i in range(1, 51))
#: Rules: ratio by name, larger is worse.
RULES = ("symbols", "dup_lines", "repeats", "capitals", "marks")
MOST_STRATA = 10_000

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals", "n_marks")
_SHAPE = T.StructType([T.StructField(name, T.LongType()) for name in _COUNTS])


def repeated_words(words: list[bytes]) -> int:
    """Positions covered by three-word windows that occur at least twice."""
    if len(words) < 4:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(index) + ids[1:], return_inverse=True)[1]
    _, which, count = np.unique(pairs[:-1] * len(index) + ids[2:], return_inverse=True, return_counts=True)
    twice = count[which] > 1
    covered = np.zeros(len(words), bool)
    for step in range(3):
        covered[step : step + len(twice)] |= twice
    return int(covered.sum())


def counts(text: str | None) -> tuple[int, ...]:
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    letters = len(raw) - len(raw.translate(None, _LETTERS))
    return (
        len(words),
        len(text) - sum(map(text.count, " \t\n\v\f\r")),
        sum(map(text.count, "#*$%&|<>")),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        letters,
        len(raw) - len(raw.translate(None, _UPPER)),
        raw.count(b"!") + raw.count(b"?"),
    )


@F.pandas_udf(_SHAPE)
def _counts(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([counts(t) for t in texts], columns=list(_COUNTS), dtype="int64")


def base_features(docs: DataFrame) -> DataFrame:
    """Counts of every whole text of ``docs(doc_id, text, stratum)``."""
    rows = docs.select("doc_id", "stratum", _counts(F.col("text").cast("string")).alias("c"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.select("doc_id", "stratum", "c.*").withColumn("base_failed", failed)


def ratio(rule: str) -> Column:
    top, bottom = {
        "symbols": ("n_symbols", "n_words"),
        "dup_lines": ("n_dup_lines", "n_lines"),
        "repeats": ("n_repeat_words", "n_words"),
        "capitals": ("n_capitals", "n_letters"),
        "marks": ("n_marks", "n_words"),
    }[rule]
    return F.col(top) / F.greatest(F.col(bottom), F.lit(1))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial count, as the regularised incomplete beta I(1-p; n-k, k+1)."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - front * _fraction(b, a, 1 - x) / b
    return front * _fraction(a, b, x) / a


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1))
    value = d
    for m in range(1, 10_000):
        step = 1.0
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + term * d) or tiny)
            c = (1 + term / c) or tiny
            step = c * d
            value *= step
        if abs(step - 1) < 1e-13:
            break
    return value


@F.pandas_udf(T.DoubleType())
def _tail(rejected: pd.Series, total: pd.Series, risk: pd.Series) -> pd.Series:
    return pd.Series([binomial_cdf(int(k), int(n), p) for k, n, p in zip(rejected, total, risk)], dtype="float64")


def certified_cutoffs(good: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, rule, cutoff): the strictest certified cutoff, from ``good(stratum, <counts>)``.

    ``good`` holds the labelled good documents. Only counts by stratum, rule and grid cell are
    shuffled. A rule without a certified cutoff has no row.
    """
    cells = F.array(*[F.struct(F.lit(r).alias("rule"), ratio(r).alias("value")) for r in RULES])
    rows = good.select("stratum", F.explode(cells).alias("r")).select("stratum", "r.*")
    grid = F.array(*[F.lit(g) for g in GRID])
    passed = F.size(F.filter(grid, lambda g: F.col("value") > g))
    held = rows.groupBy("stratum", "rule", passed.alias("cell")).agg(F.count("*").alias("n"))
    totals = held.groupBy("stratum", "rule").agg(F.sum("n").alias("total"))
    strata = totals.select("stratum").distinct().count()
    steps = totals.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(len(GRID) - 1))))
    spread = steps.join(held.select("stratum", "rule", "cell", "n"), ["stratum", "rule"]).where("cell > g")
    above = spread.groupBy("stratum", "rule", "g").agg(F.sum("n").alias("rejected"))
    tests = steps.join(above, ["stratum", "rule", "g"], "left").fillna(0, ["rejected"])
    level = error / (len(RULES) * max(1, strata))
    certain = _tail(F.col("rejected"), F.col("total"), F.lit(risk / len(RULES))) <= level
    looser = Window.partitionBy("stratum", "rule").orderBy(F.desc("g"))
    run = tests.withColumn("certain", certain).withColumn("all", F.min("certain").over(looser))
    cut = F.element_at(grid, (F.min("g") + 1).cast("int"))
    return run.where("all").groupBy("stratum", "rule").agg(cut.alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """One row per row of ``docs(doc_id, text, stratum)``, with its counts, ``base_failed`` and ``kept``.

    Labels (doc_id, quality) of folds other than 2 certify the cutoffs; fold 2 is left for
    measuring them. Documents that fail the base are not rejected by rules and take no part in
    the tests. Null texts have no words. A null stratum is a stratum of its own. A document with
    several labels is good if none says otherwise; null ids and null labels certify nothing.
    """
    rows = common.stage(base_features(docs.withColumn("stratum", F.coalesce(F.col("stratum").cast("string"), F.lit("")))), "quality")
    told = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    told = told.where((F.col("quality") == 1) & ~common.held_out(F.col("doc_id"))).select("doc_id")
    good = rows.where(~F.col("base_failed")).join(told, "doc_id", "left_semi")
    cutoffs = common.stage(certified_cutoffs(good, risk, error), "cutoffs")
    by_rule = cutoffs.groupBy(F.col("stratum").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))
    held = rows.join(common.bounded_broadcast(by_rule, MOST_STRATA), F.col("stratum") == F.col("of"), "left")
    broken = [F.coalesce(ratio(r) > F.col("cutoffs")[r], F.lit(False)) for r in RULES]
    rejected = F.filter(F.array(*[F.when(b, F.lit(r)) for r, b in zip(RULES, broken)]), lambda r: r.isNotNull())
    out = held.withColumn("rejected_by", F.concat_ws(",", rejected))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rejected_by") == ""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents", "doc_id", "text", "lang").withColumnRenamed("lang", "stratum")
    judged = judge(docs, common.read(spark, sf_dir, "labels", "doc_id", "quality"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")
