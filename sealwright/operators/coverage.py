"""Coverage relations and attestations against reports, sources and snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import contract as c
from ..functions import paths
from .findings import faults, finding


def line_count(content: Column) -> Column:
    """Line feeds, plus one for a last line without."""
    feeds = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    return feeds + F.when((content != "") & ~content.endswith("\n"), 1).otherwise(0)


def relation_report_check(relation: DataFrame, artifact: DataFrame, scope: str = "scope") -> DataFrame:
    """Report paths that are no report artifact."""
    keys = [scope, "report_path"]
    have = artifact.select(scope, F.col("path").alias("report_path"))
    absent = relation.select(*keys).distinct().join(have, keys, "left_anti")
    hits = relation.join(absent, keys, "left_semi")
    return finding(hits, scope, 0, "coverage.report_target_missing", F.col("report_path"), F.col("source_path"))


def relation_source_check(
    relation: DataFrame, source: DataFrame, scope: str = "scope", shared: Sequence[str] = ()
) -> DataFrame:
    """Sources must be exact selected paths; a bare name is never resolved.

    ``shared`` names the columns both sides are scoped by, if any.
    """
    keys = [*shared, "source_path"]
    exact = source.select(*shared, F.col("path").alias("source_path"))
    absent = relation.select(*keys).distinct().join(exact, keys, "left_anti")
    names = source.groupBy(*shared, paths.basename(F.col("path")).alias("source_path")).agg(F.count(F.lit(1)).alias("_n"))
    code = F.when(F.col("_n") > 1, "coverage.ambiguous_source").otherwise("coverage.source_missing")
    named = absent.join(names, keys, "left").select(*keys, code.alias("_code"))
    hits = relation.join(named, keys)
    return finding(hits, scope, 0, F.col("_code"), F.col("source_path"), F.col("report_path"))


def relation_line_check(
    relation: DataFrame, source: DataFrame, scope: str = "scope", shared: Sequence[str] = ()
) -> DataFrame:
    """Lines must lie within their source.  Decided once per distinct ``(source, line)``."""
    keys = [*shared, "source_path", "line"]
    wanted = relation.filter("line is not null").select(*keys).distinct()
    sizes = source.select(*shared, F.col("path").alias("source_path"), "line_count")
    code = F.when(F.col("line") < 1, "coverage.invalid_sidecar").when(
        F.col("line") > F.col("line_count"), "coverage.source_line_missing"
    )
    bad = (
        wanted.join(sizes, [*shared, "source_path"])
        .select(*keys, code.alias("_code"), "line_count")
        .filter("_code is not null")
    )
    hits = relation.join(bad, keys)
    return finding(hits, scope, 0, F.col("_code"), F.col("source_path"), F.concat_ws("/", "line", "line_count"))


def report_binding_check(
    binding: DataFrame, actual: DataFrame, scope: str = "scope", code: str = "coverage.mapping_report_mismatch"
) -> DataFrame:
    """Sidecars bind the exact entry point and tree digest of their report."""
    real = actual.select(scope, F.col("entry_point").alias("_entry"), F.col("tree_sha256").alias("_tree"))
    joined = binding.join(real, scope, "left")
    return faults(
        joined, scope, 0, F.col("entry_point"),
        (
            ~F.col("entry_point").eqNullSafe(F.col("_entry")) | ~F.col("tree_sha256").eqNullSafe(F.col("_tree")),
            code, F.col("tree_sha256"),
        ),
    )


def attestation_match(report: DataFrame, attestation: DataFrame, scope: str = "scope") -> DataFrame:
    """Add ``provenance`` and ``diagnostics`` to reports; nothing is ever upgraded further.

    ``report`` has tree, snapshot and configuration digests of the ingestion,
    ``attestation`` the bound ones.
    """
    bound = attestation.select(
        scope,
        F.col("tree_sha256").alias("_tree"),
        F.col("snapshot_id").alias("_snapshot"),
        F.col("configuration_sha256").alias("_configuration"),
        F.lit(True).alias("_declared"),
    )
    joined = report.join(bound, scope, "left")
    off = F.array_compact(
        F.array(
            F.when(~F.col("_tree").eqNullSafe(F.col("tree_sha256")), "coverage.attestation_report_mismatch"),
            F.when(~F.col("_snapshot").eqNullSafe(F.col("snapshot_id")), "coverage.attestation_snapshot_mismatch"),
            F.when(
                ~F.col("_configuration").eqNullSafe(F.col("configuration_sha256")),
                "coverage.attestation_configuration_mismatch",
            ),
        )
    )
    declared = F.coalesce(F.col("_declared"), F.lit(False))
    diagnostics = F.when(declared, F.array_join(off, ",")).otherwise(F.lit(""))
    return joined.select(
        *report.columns,
        F.when(declared & (F.size(off) == 0), c.ATTESTED).otherwise(c.UNKNOWN).alias("provenance"),
        diagnostics.alias("diagnostics"),
    )
