"""Symbols of the documentation producer: targets, index, sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .findings import faults, finding, union


def normal_arguments(args: Column) -> Column:
    """Arguments with white space collapsed; none is empty."""
    return F.coalesce(F.trim(F.regexp_replace(args, r"[\s\p{Z}]+", " ")), F.lit(""))


def _match_key(df: DataFrame) -> DataFrame:
    member = F.col("member_name").isNotNull()
    return (
        df.withColumn("_is_member", member)
        .withColumn("_member", F.coalesce("member_name", F.lit("")))
        .withColumn("_args", F.when(member, normal_arguments(F.col("args"))).otherwise(F.lit("")))
    )


_KEYS = ["snapshot_id", "compound_name", "kind", "_is_member", "_member", "_args"]


def symbol_target_match(entity: DataFrame, target: DataFrame, payload: DataFrame) -> DataFrame:
    """Every entity with its outcome: mapped, missing or ambiguous target.

    Targets are counted per match key first, so an entity meets one row and no
    pairs are formed whatever the number of equal targets.
    """
    counted = _match_key(target).groupBy(*_KEYS).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("html_path", "anchor")).alias("_t")
    )
    have = payload.select("snapshot_id", F.col("path").alias("html_path"), F.lit(True).alias("_collected"))
    matched = (
        _match_key(entity)
        .join(counted, _KEYS, "left")
        .withColumn("html_path", F.when(F.col("_n") == 1, F.col("_t.html_path")))
        .withColumn("anchor", F.when(F.col("_n") == 1, F.col("_t.anchor")))
        .join(have, ["snapshot_id", "html_path"], "left")
    )
    outcome = (
        F.when(F.col("_n").isNull(), "doxygen.target_missing")
        .when(F.col("_n") > 1, "doxygen.ambiguous_target")
        .when(F.col("_collected").isNull(), "doxygen.target_missing")
        .otherwise("mapped")
    )
    return matched.select(*entity.columns, "html_path", "anchor", outcome.alias("outcome"))


def symbol_findings(matched: DataFrame) -> DataFrame:
    bad = matched.filter("outcome <> 'mapped'")
    return finding(bad, "snapshot_id", 0, F.col("outcome"), F.coalesce("html_path", "refid"))


def refid_index_diff(index_ref: DataFrame, detail_ref: DataFrame, scope: str = "snapshot_id") -> DataFrame:
    """Index ids without detail, detail ids without index, repetitions on either side."""
    keys = [scope, "refid"]
    sides = (
        index_ref.select(*keys, F.lit(1).alias("i"), F.lit(0).alias("d"))
        .unionByName(detail_ref.select(*keys, F.lit(0).alias("i"), F.lit(1).alias("d")))
        .groupBy(*keys)
        .agg(F.sum("i").alias("i"), F.sum("d").alias("d"))
    )
    return faults(
        sides, scope, 0, F.col("refid"),
        (F.col("d") == 0, "doxygen.refid_target_missing", None),
        (F.col("i") == 0, "doxygen.unindexed_refid", None),
        (F.col("i") > 1, "doxygen.duplicate_refid", "index"),
        (F.col("d") > 1, "doxygen.duplicate_refid", "detail"),
    )


def symbol_source_check(entity: DataFrame, snapshot_file: DataFrame, root: str) -> DataFrame:
    """Locations must be exact selected paths; absolute ones lie below ``root``."""
    base = root.rstrip("/") + "/"
    location = F.col("source_path")
    rows = entity.withColumn("_outside", location.startswith("/") & ~location.startswith(base)).withColumn(
        "_path", F.when(location.startswith(base), F.substring(location, F.lit(len(base) + 1), F.length(location))).otherwise(location)
    )
    inside = rows.filter(~F.col("_outside"))
    keys = ["snapshot_id", "_path"]
    have = snapshot_file.filter("kind = 'file'").select("snapshot_id", F.col("path").alias("_path"))
    absent = inside.select(*keys).distinct().join(have, keys, "left_anti")
    return union(
        finding(rows.filter("_outside"), "snapshot_id", 0, "doxygen.source_outside_snapshot", location, F.col("refid")),
        finding(
            inside.join(absent, keys, "left_semi"), "snapshot_id", 0, "doxygen.source_target_missing", F.col("_path"), F.col("refid")
        ),
    )
