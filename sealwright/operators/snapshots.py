"""Source snapshots: selection, records, comparison, links, identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import contract as c
from ..functions import ids, ordered, paths, text
from ..functions.joins import spread_join
from ..session import stored
from .findings import faults, finding, union


def snapshot_select(snapshot_file: DataFrame, policy: DataFrame) -> DataFrame:
    """Keep files below an included and no excluded root; no include means all.

    ``policy`` is ``(snapshot_id, list, root)``.  A file meets the roots by equi
    joins of its own path prefixes, never by comparing it with each root.
    """
    keys = ["snapshot_id", "path"]
    prefixes = snapshot_file.select(*keys, F.explode(paths.self_and_ancestors(F.col("path"))).alias("root"))

    def below(name: str) -> DataFrame:
        roots = policy.filter(F.col("list") == name).select("snapshot_id", "root").distinct()
        return prefixes.join(roots, ["snapshot_id", "root"], "left_semi").select(*keys).distinct()

    restricted = policy.filter("list = 'include'").select("snapshot_id").distinct()
    free = spread_join(snapshot_file, restricted, ["snapshot_id"], "path", "left_anti")
    included = snapshot_file.join(below("include"), keys, "left_semi")
    return free.unionByName(included).join(below("exclude"), keys, "left_anti")


def snapshot_record_audit(snapshot_file: DataFrame, payload: DataFrame) -> DataFrame:
    """File records: kind and mode, canonical size, digest and size of the bytes."""
    stored = payload.select(
        "snapshot_id", "path", F.col("sha256").alias("_sha"), F.col("size").cast("string").alias("_size")
    )
    joined = snapshot_file.join(stored, ["snapshot_id", "path"], "left")
    pair = F.lit(False)
    for kind, mode in c.FILE_MODES:
        pair = pair | ((F.col("kind") == kind) & (F.col("mode") == mode))
    canonical = F.coalesce(F.col("size").rlike(c.SIZE), F.lit(False))
    code = "artifact_graph.identity_mismatch"
    return faults(
        joined, "snapshot_id", 0, F.col("path"),
        (~F.coalesce(pair, F.lit(False)), code, "mode"),
        (~canonical | ~F.col("size").eqNullSafe(F.col("_size")), code, "size"),
        (~F.col("sha256").eqNullSafe(F.col("_sha")), code, "digest"),
        ((F.col("kind") == "symlink") & F.col("target").isNull(), code, "target"),
        ((F.col("kind") == "file") & F.col("target").isNotNull(), code, "target"),
    )


def snapshot_source_audit(snapshot: DataFrame) -> DataFrame:
    """Source profile: clean revision, known object format, ids of its length."""
    pattern = F.when(F.col("object_format") == "sha1", F.lit(c.HEX40)).otherwise(F.lit(c.HEX64))
    code = "artifact_graph.identity_mismatch"
    return faults(
        snapshot, "snapshot_id", 0, None,
        (~F.col("kind").eqNullSafe("git-clean") | ~F.coalesce(F.col("object_format").isin("sha1", "sha256"), F.lit(False)), code, "source"),
        (~F.coalesce(F.regexp_like("commit", pattern), F.lit(False)), code, "commit"),
        (~F.coalesce(F.regexp_like("tree", pattern), F.lit(False)), code, "tree"),
    )


def snapshot_diff(before: DataFrame, after: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Changes from one capture to the next: ``(path, change)``, several per path possible.

    Both captures are grouped by path, which needs one shuffle and splits evenly.
    """
    keys = [*(scope or []), "path"]
    record = F.struct("kind", "mode", "sha256", "target")
    none = F.lit(None).cast(T_RECORD)
    sides = (
        before.select(*keys, record.cast(T_RECORD).alias("a"), none.alias("b"))
        .unionByName(after.select(*keys, none.alias("a"), record.cast(T_RECORD).alias("b")))
        .groupBy(*keys)
        .agg(F.max("a").alias("a"), F.max("b").alias("b"))
    )
    a, b = F.col("a"), F.col("b")
    both = a.isNotNull() & b.isNotNull()
    changes = F.array_compact(
        F.array(
            F.when(a.isNull(), "added"),
            F.when(b.isNull(), "removed"),
            F.when(both & ((a["mode"] != b["mode"]) | (a["kind"] != b["kind"])), "mode-changed"),
            F.when(both & ~a["target"].eqNullSafe(b["target"]), "retargeted"),
            F.when(both & (a["sha256"] != b["sha256"]), "byte-changed"),
        )
    )
    return sides.select(*keys, F.explode(changes).alias("change"))


T_RECORD = "struct<kind:string,mode:string,sha256:string,target:string>"


def symlink_resolution(snapshot_file: DataFrame) -> DataFrame:
    """Links must stay inside the snapshot and name a selected regular file."""
    links = snapshot_file.filter("kind = 'symlink'").select("snapshot_id", "path", "target")
    target = F.col("target")
    unsafe = F.coalesce(
        (target == "") | target.startswith("/") | (F.instr(target, "\\") > 0) | target.rlike(r"\p{Cc}"), F.lit(True)
    )
    rows = links.withColumn("_unsafe", unsafe).withColumn(
        "_resolved", paths.normpath(paths.join_path(paths.dirname(F.col("path")), target))
    )
    resolved = F.col("_resolved")
    rows = rows.withColumn(
        "_code",
        F.when(F.col("_unsafe"), "snapshot.invalid_symlink")
        .when((resolved == "..") | resolved.startswith("../") | resolved.startswith("/"), "snapshot.symlink_escape")
        .when(paths.bad_segments(target), "snapshot.invalid_symlink"),
    )
    # links are few: their narrow rows are written once, and all checks read those
    rows = stored(text.with_nfc(stored(rows, "links"), "_resolved", "_nfc"), "links")
    rows = rows.withColumn("_code", F.when(F.col("_code").isNull() & ~F.col("_nfc"), "snapshot.invalid_symlink").otherwise(F.col("_code")))
    broken = rows.filter("_code is not null")
    usable = rows.filter("_code is null")
    files = snapshot_file.filter("kind = 'file'").select("snapshot_id", F.col("path").alias("_resolved"))
    keys = ["snapshot_id", "_resolved"]
    absent = usable.select(*keys).distinct().join(files, keys, "left_anti")
    dangling = usable.join(absent, keys, "left_semi")
    return union(
        finding(broken, "snapshot_id", 0, F.col("_code"), F.col("path"), target),
        finding(dangling, "snapshot_id", 0, "snapshot.invalid_symlink", F.col("path"), resolved),
    )


def file_record() -> Column:
    """Canonical text of one file record; links commit their target too."""
    common = {name: F.col(name) for name in ("kind", "mode", "path", "size")}
    return F.when(
        F.col("kind") == "symlink",
        ids.canonical({"identity": {"sha256": F.col("sha256"), "target": F.col("target")}, **common}),
    ).otherwise(ids.canonical({"identity": {"sha256": F.col("sha256")}, **common}))


def snapshot_digest(
    snapshot: DataFrame, snapshot_file: DataFrame, policy: DataFrame,
    namespace: str = c.DEFAULT_NAMESPACE,
) -> DataFrame:
    """``(snapshot_id, content_id)`` over source, policy and ordered file records."""
    source = ids.canonical({name: F.col(name) for name in ("commit", "kind", "object_format", "tree")})
    glue = snapshot.select(
        "snapshot_id",
        F.array(
            F.lit('{"identity":{"files":['),
            F.lit('],"policy":{"exclude":['),
            F.lit('],"include":['),
            F.concat(
                F.lit(']},"schema":"%s","source":' % c.schema_id("snapshot.v1", namespace)), source, F.lit('},"kind":"snapshot"}')
            ),
        ).alias("glue"),
    )
    root = ids.json_string(F.col("root"))
    listing = union(
        ordered.lines(snapshot_file, ["snapshot_id"], F.col("path"), file_record(), 0),
        ordered.lines(policy.filter("list = 'exclude'"), ["snapshot_id"], F.col("root"), root, 1),
        ordered.lines(policy.filter("list = 'include'"), ["snapshot_id"], F.col("root"), root, 2),
    )
    digest = ordered.ordered_digest(listing, ["snapshot_id"], glue, parts=3)
    return digest.select("snapshot_id", F.concat(F.lit("snapshot:sha256:"), "sha256").alias("content_id"))
