"""The findings table: every fault is a row with a stable code.

``finding(scope_id string, check_rank int, code string, path string, detail string)``

Findings of pages may also carry ``order_page`` and ``order_pos``: the page a reader was on and the
place in it, which the path of the finding need not tell.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("scope_id", "check_rank", "code", "path", "detail")


def _text(value: Column | str | None) -> Column:
    if isinstance(value, Column):
        return value.cast("string")
    return F.lit(value).cast("string")


def finding(
    df: DataFrame,
    scope: str,
    rank: int | Column,
    code: str | Column,
    path: Column | str | None = None,
    detail: Column | str | None = None,
    order: tuple[Column, Column] | None = None,
) -> DataFrame:
    """Project rows that are faults already into the findings schema.

    ``code`` and ``detail`` given as text are constants; columns are columns. ``order`` is the page
    and the place in it.
    """
    rank = rank if isinstance(rank, Column) else F.lit(rank)
    place = () if order is None else (order[0].cast("string").alias("order_page"), order[1].cast("long").alias("order_pos"))
    return df.select(
        F.col(scope).cast("string").alias("scope_id"),
        rank.cast("int").alias("check_rank"),
        _text(code).alias("code"),
        _text(path).alias("path"),
        _text(detail).alias("detail"),
        *place,
    )


def faults(
    df: DataFrame, scope: str, rank: int, path: Column | str | None, *rules: tuple, suspect: Column | None = None
) -> DataFrame:
    """One pass over ``df``: each rule is ``(condition, code, detail)``, each hit a row.

    A compiled filter drops clean rows first, so only faulty ones are taken
    apart.  ``suspect`` is a cheaper condition that holds for every faulty row;
    by default it is any of the rules.
    """
    conditions = [F.coalesce(condition, F.lit(False)) for condition, _, _ in rules]
    if suspect is None:
        suspect = reduce(Column.__or__, conditions)
    hits = F.array(
        *[
            F.when(condition, F.struct(_text(code).alias("code"), _text(detail).alias("detail")))
            for condition, (_, code, detail) in zip(conditions, rules)
        ]
    )
    return (
        df.filter(suspect)
        .select(
            F.col(scope).cast("string").alias("scope_id"),
            F.lit(rank).cast("int").alias("check_rank"),
            _text(path).alias("path"),
            F.explode(F.filter(hits, lambda hit: hit.isNotNull())).alias("_hit"),
        )
        .select("scope_id", "check_rank", "_hit.code", "path", "_hit.detail")
    )


def union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def first_finding(findings: DataFrame) -> DataFrame:
    """The single fault a fail-fast run would report, one row per scope.

    A minimum over structs merges map-side, so a scope with very many faults
    costs one partial row per task.  Faults of a rank come by page and place in it where they
    have these, else by path; size comes before digest within a path.
    """
    paged = "order_page" in findings.columns
    page = F.coalesce("order_page", "path") if paged else F.col("path")
    pos = F.coalesce("order_pos", F.lit(0)) if paged else F.lit(0)
    after = F.when(F.col("code") == "payload.hash_mismatch", 1).otherwise(0)
    least = F.min(F.struct("check_rank", page.alias("page"), pos.alias("pos"), after.alias("after"), "path", "code", "detail"))
    return findings.groupBy("scope_id").agg(least.alias("f")).select(
        "scope_id", "f.check_rank", "f.code", "f.path", "f.detail"
    )
