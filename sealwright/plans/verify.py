"""Whole-bundle reports composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import contract as c
from ..operators import findings, inventory, links, records
from ..session import stored
from ..sources import manifests


def bundle_report(
    payload: DataFrame, manifest: DataFrame, listing: DataFrame, namespace: str = c.DEFAULT_NAMESPACE
) -> DataFrame:
    """Identity of each bundle, its number of findings and the first one."""
    found = findings.union(
        inventory.inventory_closure(listing, manifest),
        inventory.directory_closure(listing, manifest),
        inventory.payload_digest_check(payload, manifest),
    )
    return _summary(inventory.bundle_digest(payload, namespace), found)


def _summary(identity: DataFrame, found: DataFrame) -> DataFrame:
    first = findings.first_finding(found).select(
        F.col("scope_id").alias("bundle_id"), "check_rank", "code", "path", "detail"
    )
    count = found.groupBy(F.col("scope_id").alias("bundle_id")).agg(F.count(F.lit(1)).alias("findings"))
    identity = identity.withColumn("bundle_id", F.col("bundle_id").cast("string"))
    return identity.join(count, "bundle_id", "left").join(first, "bundle_id", "left")


def verify_bundles(
    payload: DataFrame,
    manifest: DataFrame,
    entry_points: DataFrame,
    checksum: DataFrame,
    listing: DataFrame,
    html: DataFrame,
    run_report: DataFrame,
    namespace: str = c.DEFAULT_NAMESPACE,
    manifest_text: DataFrame | None = None,
) -> DataFrame:
    """All findings of all bundles, with the place in its page where a finding has one.

    Inputs are the parsed tables: ``payload`` with size and digest, ``manifest`` entries with
    position, ``checksum`` records (with ``code`` where lines may be malformed), ``html`` pages (null where the
    bytes are no UTF-8) and ``run_report`` as ``(bundle_id, report)``; ``manifest_text`` adds the
    checks of the whole text. Pages are parsed once and their parts stored, since five checks
    read them. Control files are part of a listing, so only entries are held against their names.
    """
    parts = stored(links.page_parts(html), "page-parts")
    resolved = stored(links.resolve_links(links.links(parts)), "resolved-links")
    anchor = links.anchors(parts)
    control = inventory.ordered_manifest_digest(manifest, namespace)
    bundles = listing.select("bundle_id").unionByName(manifest.select("bundle_id")).distinct()
    found = [
        inventory.empty_tree(bundles, listing.filter("object_type = 'file'")),
        records.path_profile_audit(listing, "bundle_id", rank=inventory.RANK_LISTING),
        inventory.forbidden_objects(listing),
        records.path_profile_audit(manifest, "bundle_id", rank=inventory.RANK_ENTRY),
        inventory.manifest_entry_audit(manifest),
        inventory.order_audit(manifest, "bundle_id"),
        inventory.duplicate_ids(manifest, "bundle_id", ["path"], "manifest.duplicate_entry"),
        inventory.entry_point_check(entry_points, manifest),
        inventory.inventory_closure(listing, manifest),
        inventory.directory_closure(listing, manifest),
        inventory.payload_digest_check(payload, manifest),
        inventory.checksums_check(checksum.filter("code is null") if "code" in checksum.columns else checksum, payload, control),
        records.run_report_audit(run_report, "bundle_id", namespace=namespace),
        links.unsupported_parts(parts, ordered=True),
        links.duplicate_anchors(anchor, ordered=True),
        links.resolution_findings(resolved, ordered=True),
        links.link_target_check(resolved, manifest, ordered=True),
        links.link_fragment_check(resolved, manifest, anchor, ordered=True),
    ]
    if "code" in checksum.columns:
        found.append(manifests.malformed_checksums(checksum))
    if manifest_text is not None:
        found.append(manifests.manifest_shape_audit(manifest_text, namespace))
    return findings.union(*found)
