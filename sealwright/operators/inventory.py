"""Closure of bundles: listings, manifests, digests, checksums, identities.

Ranks of the findings follow the order in which a fail-fast check of one bundle
would meet them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import contract as c
from ..functions import ids, ordered, paths
from ..session import stored
from .findings import faults, finding, union

ORDER_RUN = 1 << 16
RANK_LISTING = 10
RANK_MANIFEST_TEXT = 20
RANK_ENTRY = 25
RANK_ORDER = 26
RANK_DUPLICATE = 27
RANK_ENTRY_POINT = 30
RANK_MISSING = 40
RANK_EXTRA = 41
RANK_DIRECTORY = 42
RANK_PAYLOAD = 50
RANK_CHECKSUMS = 60
RANK_RUN_REPORT = 70
RANK_PAGE = 80
RANK_LINK = 90


def payload_inventory(content: DataFrame) -> DataFrame:
    """``(bundle_id, path, content)`` to ``(bundle_id, path, size, sha256)``.

    Bytes are hashed in this narrow projection, so content never shuffles.
    """
    return content.select(
        "bundle_id",
        "path",
        F.octet_length("content").cast("long").alias("size"),
        F.sha2(F.col("content").cast("binary"), 256).alias("sha256"),
    )


def empty_tree(scopes: DataFrame, payload: DataFrame) -> DataFrame:
    """Scopes that have no file at all."""
    missing = scopes.select("bundle_id").distinct().join(
        payload.select("bundle_id").distinct(), "bundle_id", "left_anti"
    )
    return finding(missing, "bundle_id", RANK_LISTING, "inventory.empty_tree")


def _expected_files(manifest: DataFrame) -> DataFrame:
    """Listed payloads plus the two control files of every bundle."""
    control = manifest.select("bundle_id").distinct().select(
        "bundle_id", F.explode(F.array(*[F.lit(path) for path in c.RESERVED_PATHS])).alias("path")
    )
    return manifest.select("bundle_id", "path").unionByName(control)


def inventory_closure(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files listed against files present.

    A full outer join would not be split on a skewed bundle; grouping both sides
    by ``(bundle_id, path)`` spreads the same work evenly and merges map-side.
    """
    expected = _expected_files(manifest).select("bundle_id", "path", F.lit(1).alias("e"), F.lit(0).alias("p"))
    present = listing.filter(F.col("object_type") == "file").select(
        "bundle_id", "path", F.lit(0).alias("e"), F.lit(1).alias("p")
    )
    sides = (
        expected.unionByName(present)
        .groupBy("bundle_id", "path")
        .agg(F.max("e").alias("e"), F.max("p").alias("p"))
        .filter(F.col("e") != F.col("p"))
    )
    missing = F.col("e") == 1
    return finding(
        sides,
        "bundle_id",
        F.when(missing, RANK_MISSING).otherwise(RANK_EXTRA),
        F.when(missing, "inventory.missing_file").otherwise("inventory.extra_file"),
        F.col("path"),
    )


def directory_closure(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Directories that no listed file implies."""
    implied = manifest.select("bundle_id", F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
    extra = listing.filter(F.col("object_type") == "directory").join(implied, ["bundle_id", "path"], "left_anti")
    return finding(extra, "bundle_id", RANK_DIRECTORY, "inventory.extra_directory", F.col("path"))


def forbidden_objects(listing: DataFrame) -> DataFrame:
    bad = listing.filter(~F.col("object_type").isin("file", "directory"))
    return finding(bad, "bundle_id", RANK_LISTING, "inventory.forbidden_object", F.col("path"))


def payload_digest_check(payload: DataFrame, manifest: DataFrame) -> DataFrame:
    """Size and digest of stored bytes against the manifest."""
    stored = payload.select("bundle_id", "path", F.col("size").cast("string").alias("_size"), F.col("sha256").alias("_sha"))
    both = manifest.select("bundle_id", "path", "size", "sha256").join(stored, ["bundle_id", "path"])
    return faults(
        both, "bundle_id", RANK_PAYLOAD, F.col("path"),
        (F.col("_size") != F.col("size"), "payload.size_mismatch", F.concat_ws("/", "size", "_size")),
        (F.col("_sha") != F.col("sha256"), "payload.hash_mismatch", F.col("_sha")),
    )


def entry_point_check(entry_points: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(bundle_id, index, run_report)``: both must name payloads."""
    points = entry_points.select(
        "bundle_id",
        F.inline(
            F.array(
                F.struct(F.lit("index").alias("name"), F.col("index").alias("path")),
                F.struct(F.lit("run_report").alias("name"), F.col("run_report").alias("path")),
            )
        ),
    )
    known = manifest.select("bundle_id", "path")
    dangling = points.join(known, ["bundle_id", "path"], "left_anti")
    return finding(
        dangling, "bundle_id", RANK_ENTRY_POINT, "manifest.invalid_entry_points", F.col("path"), F.col("name")
    )


def manifest_entry_audit(manifest: DataFrame) -> DataFrame:
    """Shape of single entries: digest, size, reserved names."""
    return faults(
        manifest, "bundle_id", RANK_ENTRY, F.col("path"),
        (~F.coalesce(F.col("sha256").rlike(c.HEX64), F.lit(False)), "manifest.invalid_entry", "sha256"),
        (~F.coalesce(F.col("size").rlike(c.SIZE), F.lit(False)), "manifest.invalid_entry", "size"),
        (F.col("path").isin(*c.RESERVED_PATHS), "manifest.reserved_path", None),
    )


def order_audit(
    table: DataFrame, scope: str, key: str = "path", pos: str = "pos", code: str = "manifest.unsorted_entries"
) -> DataFrame:
    """Stored order must be byte order; positions may have gaps.

    Rows are ordered in runs of ORDER_RUN positions, so one scope spreads over many tasks; the last
    key of each run, one row, meets the first row of the next.
    """
    rows = table.select(scope, F.col(pos).cast("long").alias("_pos"), F.col(key).alias("_key"))
    rows = rows.withColumn("_run", F.floor(F.col("_pos") / ORDER_RUN))
    inside = Window.partitionBy(scope, "_run").orderBy("_pos", "_key")
    lasts = rows.groupBy(scope, "_run").agg(F.max(F.struct("_pos", "_key")).alias("_last"))
    ahead = Window.partitionBy(scope).orderBy("_run")
    lasts = lasts.select(scope, "_run", F.lag("_last._key").over(ahead).alias("_ahead"))
    before = F.coalesce(F.lag("_key").over(inside), "_ahead")
    met = rows.join(lasts, [scope, "_run"]).withColumn("_before", before)
    return finding(met.filter(F.col("_before") > F.col("_key")), scope, RANK_ORDER, code, F.col("_key"), F.col("_before"))


def duplicate_ids(
    table: DataFrame, scope: str, keys: list[str], code: str = "manifest.duplicate_entry", rank: int = RANK_DUPLICATE
) -> DataFrame:
    """Keys that occur more than once in their scope, with their count."""
    repeated = table.groupBy(scope, *keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    label = F.concat_ws("|", *[F.coalesce(F.col(key).cast("string"), F.lit("")) for key in keys])
    return finding(repeated, scope, rank, code, label, F.col("_n"))


def path_collisions(payload: DataFrame) -> DataFrame:
    """Paths used twice, paths that are directories of others, reserved parents."""
    own = payload.select("bundle_id", "path")
    repeated = own.groupBy("bundle_id", "path").count().filter("count > 1")
    parents = own.select("bundle_id", F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
    shadowed = parents.join(own.distinct(), ["bundle_id", "path"], "left_semi")
    reserved = parents.filter(F.col("path").isin(*c.RESERVED_PATHS))
    code = "bundle.path_collision"
    return union(
        finding(repeated, "bundle_id", RANK_DUPLICATE, code, F.col("path"), "duplicate"),
        finding(shadowed, "bundle_id", RANK_DUPLICATE, code, F.col("path"), "directory"),
        finding(reserved, "bundle_id", RANK_DUPLICATE, code, F.col("path"), "reserved"),
    )


# --- ordered identities -----------------------------------------------------

def entry_line() -> Column:
    return ids.canonical({"path": F.col("path"), "sha256": F.col("sha256"), "size": F.col("size").cast("string")})


def manifest_glue(namespace: str = c.DEFAULT_NAMESPACE) -> list[str]:
    return [
        '{"entries":[',
        '],"entry_points":{"index":"%s","run_report":"%s"},"schema":"%s"}'
        % (c.INDEX_PATH, c.RUN_REPORT_PATH, c.schema_id("bundle-manifest.v1", namespace)),
    ]


def _entry_lines(payload: DataFrame) -> DataFrame:
    return ordered.lines(payload, ["bundle_id"], F.col("path"), entry_line())


def _checksum_lines(payload: DataFrame, manifest_digest: DataFrame) -> DataFrame:
    own = manifest_digest.select("bundle_id", F.lit(c.MANIFEST).alias("path"), "sha256")
    rows = payload.select("bundle_id", "path", "sha256").unionByName(own)
    return ordered.lines(
        rows, ["bundle_id"], F.col("path"), F.concat("sha256", F.lit("  "), "path", F.lit("\n"))
    )


def tree_digest(payload: DataFrame, scope: str = "bundle_id", namespace: str = c.DEFAULT_NAMESPACE) -> DataFrame:
    """Digest over the ordered inventory of a report tree: ``(scope, tree_sha256)``."""
    glue = [
        '{"entries":[',
        '],"kind":"coverage-report-tree","schema":"%s"}' % c.schema_id("coverage-report-tree.v1", namespace),
    ]
    listing = ordered.lines(payload, [scope], F.col("path"), entry_line())
    return ordered.ordered_digest(listing, [scope], glue).withColumnRenamed("sha256", "tree_sha256")


def ordered_manifest_digest(payload: DataFrame, namespace: str = c.DEFAULT_NAMESPACE) -> DataFrame:
    """``(bundle_id, sha256)`` of the canonical manifest text."""
    return ordered.ordered_digest(_entry_lines(payload), ["bundle_id"], manifest_glue(namespace))


def payload_inventory_stored(payload: DataFrame) -> DataFrame:
    """``(bundle_id, path, sha256, size)`` written once, so that content is read and hashed once."""
    return stored(payload.select("bundle_id", "path", "sha256", "size"), "inventory")


def bundle_digest(payload: DataFrame, namespace: str = c.DEFAULT_NAMESPACE) -> DataFrame:
    """``(bundle_id, manifest_sha256, checksums_sha256, content_id)`` per bundle."""
    entries = payload_inventory_stored(payload)
    manifest = stored(ordered.ordered_digest(_entry_lines(entries), ["bundle_id"], manifest_glue(namespace)), "manifest-digest")
    checksums = ordered.ordered_digest(_checksum_lines(entries, manifest), ["bundle_id"], ["", ""], separator="")
    both = manifest.withColumnRenamed("sha256", "manifest_sha256").join(
        checksums.withColumnRenamed("sha256", "checksums_sha256"), "bundle_id"
    )
    identity = {"checksums_sha256": F.col("checksums_sha256"), "manifest_sha256": F.col("manifest_sha256")}
    return both.withColumn("content_id", ids.content_id("bundle", ids.scoped_identity("bundle", identity)))


def control_texts(payload: DataFrame, namespace: str = c.DEFAULT_NAMESPACE) -> DataFrame:
    """``(bundle_id, name, chunk, text)``: exact text of both control files, in bounded chunks."""
    entries = payload_inventory_stored(payload)
    lines, glue = _entry_lines(entries), manifest_glue(namespace)
    digest = stored(ordered.ordered_digest(lines, ["bundle_id"], glue), "manifest-digest")
    manifest = ordered.ordered_text(lines, ["bundle_id"], glue)
    checksums = ordered.ordered_text(_checksum_lines(entries, digest), ["bundle_id"], ["", ""], separator="")
    return union(
        manifest.select("bundle_id", F.lit(c.MANIFEST).alias("name"), "chunk", "text"),
        checksums.select("bundle_id", F.lit(c.CHECKSUMS).alias("name"), "chunk", "text"),
    )


def checksums_check(checksum: DataFrame, payload: DataFrame, manifest_digest: DataFrame | None = None) -> DataFrame:
    """Stored checksum records against stored digests, and their order.

    ``manifest_digest`` is ``(bundle_id, sha256)`` of each manifest; without it
    only payload records are compared.
    """
    actual = payload.select("bundle_id", "path", "sha256")
    if manifest_digest is not None:
        actual = actual.unionByName(
            manifest_digest.select("bundle_id", F.lit(c.MANIFEST).alias("path"), "sha256")
        )
    sides = (
        checksum.select("bundle_id", "path", F.col("sha256").alias("c"), F.lit(None).cast("string").alias("a"))
        .unionByName(actual.select("bundle_id", "path", F.lit(None).cast("string").alias("c"), F.col("sha256").alias("a")))
        .groupBy("bundle_id", "path")
        .agg(F.max("c").alias("c"), F.max("a").alias("a"), F.count("c").alias("n"))
    )
    code = "checksums.noncanonical"
    records = faults(
        sides, "bundle_id", RANK_CHECKSUMS, F.col("path"),
        (F.col("c").isNull(), code, "missing record"),
        (F.col("a").isNull(), code, "extra record"),
        (F.col("c") != F.col("a"), code, "digest"),
        (F.col("n") > 1, code, "duplicate record"),
    )
    order = order_audit(checksum, "bundle_id", code=code).withColumn("check_rank", F.lit(RANK_CHECKSUMS))
    return union(records, order.withColumn("detail", F.lit("order")))


# --- classification ---------------------------------------------------------

def classify_api(payload: DataFrame) -> DataFrame:
    path = F.col("path")
    return payload.withColumn(
        "kind",
        F.when(path.startswith("html/") & path.endswith(".html"), "api-page")
        .when(path.endswith(".xml") | path.endswith(".tag"), "producer-machine-output")
        .otherwise("producer-asset"),
    )


def classify_coverage(payload: DataFrame, entry_point: str = "entry_point") -> DataFrame:
    """``entry_point`` is the boolean column that marks the report's first page."""
    return payload.withColumn(
        "kind",
        F.when(F.col(entry_point), "coverage-report")
        .when(F.col("path").endswith(".html"), "coverage-page")
        .otherwise("coverage-summary"),
    )
