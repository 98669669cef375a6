"""Links and anchors of bundle pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import contract as c
from ..functions import markup, references, text
from .findings import faults, finding, union
from .inventory import RANK_LINK, RANK_PAGE

_PAGE = ["bundle_id", "path"]


def page_parts(html: DataFrame) -> DataFrame:
    """``(bundle_id, path, kind, pos, value)`` of every page, read once."""
    pages = html.select(F.col("bundle_id").cast("string"), F.col("path").cast("string"), F.col("html").cast("string"))
    return pages.mapInPandas(markup.page_parts, markup.PART_SCHEMA)


def links(parts: DataFrame) -> DataFrame:
    return parts.filter("kind = 'reference'").select(*_PAGE, "pos", F.col("value").alias("reference"))


def anchors(parts: DataFrame) -> DataFrame:
    return parts.filter("kind = 'anchor'").select(*_PAGE, "pos", F.col("value").alias("name"))


def _order(page, pos, ordered: bool):
    return (page, pos) if ordered else None


def unsupported_parts(parts: DataFrame, ordered: bool = False) -> DataFrame:
    """Pages with a base address or a source set, and pages without text, one finding per page and code."""
    pages = parts.filter(F.col("kind").isin("base", "srcset", markup.UNREADABLE)).select(*_PAGE, "kind").distinct()
    code = F.when(F.col("kind") == markup.UNREADABLE, "link.invalid_html_utf8").otherwise(F.concat(F.lit("link.unsupported_"), F.col("kind")))
    step = F.when(F.col("kind") == markup.UNREADABLE, 0).when(F.col("kind") == "base", 1).otherwise(2)
    return finding(pages, "bundle_id", RANK_PAGE, code, F.col("path"), None, _order(F.col("path"), step, ordered))


def invalid_html_utf8(payload: DataFrame) -> DataFrame:
    """Pages whose bytes are no UTF-8."""
    bad = payload.filter(F.col("path").endswith(".html") & ~F.is_valid_utf8(F.col("content").cast("string")))
    return finding(bad, "bundle_id", RANK_PAGE, "link.invalid_html_utf8", F.col("path"))


def duplicate_anchors(anchor: DataFrame, ordered: bool = False) -> DataFrame:
    repeated = anchor.groupBy(*_PAGE, "name").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return finding(repeated, "bundle_id", RANK_PAGE, "link.ambiguous_fragment", F.col("path"), F.col("name"), _order(F.col("path"), F.lit(3), ordered))


def resolve_links(link: DataFrame) -> DataFrame:
    """Add ``target``, ``fragment``, ``bad_fragment`` and ``code`` to internal links; drop external ones."""
    resolved = references.resolution(F.col("path"), F.col("reference"))
    internal = link.withColumn("_r", resolved).filter(F.col("_r").isNotNull()).select(*link.columns, "_r.*")
    told = text.with_nfc(internal, "target", "_nfc")
    code = F.when(F.col("code").isNull() & ~F.col("_nfc"), F.lit("path.invalid")).otherwise(F.col("code"))
    return told.withColumn("code", code).drop("_nfc")


def resolution_findings(resolved: DataFrame, ordered: bool = False) -> DataFrame:
    bad = resolved.filter(F.col("code").isNotNull())
    return finding(bad, "bundle_id", RANK_LINK, F.col("code"), F.col("path"), F.col("reference"), _order(F.col("path"), F.col("pos"), ordered))


def _missing(resolved: DataFrame, payload: DataFrame) -> DataFrame:
    """Distinct targets without payload; popular targets collapse before the shuffle."""
    wanted = resolved.filter(F.col("code").isNull()).select("bundle_id", "target").distinct()
    have = payload.select("bundle_id", F.col("path").alias("target"))
    return wanted.join(have, ["bundle_id", "target"], "left_anti")


def link_target_check(resolved: DataFrame, payload: DataFrame, ordered: bool = False) -> DataFrame:
    usable = resolved.filter(F.col("code").isNull())
    dangling = usable.join(_missing(resolved, payload), ["bundle_id", "target"], "left_semi")
    return finding(dangling, "bundle_id", RANK_LINK, "link.missing_target", F.col("target"), F.col("path"), _order(F.col("path"), F.col("pos"), ordered))


def link_fragment_check(resolved: DataFrame, payload: DataFrame, anchor: DataFrame, ordered: bool = False) -> DataFrame:
    """Fragments of links whose target exists: page targets only, and a known anchor."""
    keys = ["bundle_id", "target", "fragment"]
    usable = resolved.filter(F.col("code").isNull() & (F.coalesce(F.col("fragment"), F.lit("")) != ""))
    wanted = usable.select(*keys).distinct()
    have = payload.select("bundle_id", F.col("path").alias("target")).distinct()
    wanted = wanted.join(have, ["bundle_id", "target"], "left_semi")
    is_page = F.col("target").endswith(".html")
    named = anchor.select("bundle_id", F.col("path").alias("target"), F.col("name").alias("fragment")).distinct()
    bad = union(
        wanted.filter(~is_page).withColumn("_code", F.lit("link.non_html_fragment")),
        wanted.filter(is_page).join(named, keys, "left_anti").withColumn("_code", F.lit("link.missing_fragment")),
    )
    hits = usable.join(bad, keys)
    order = _order(F.col("path"), F.col("pos"), ordered)
    broken = resolved.filter(F.col("code").isNull() & F.col("bad_fragment")).join(have, ["bundle_id", "target"], "left_semi")
    return union(
        finding(hits, "bundle_id", RANK_LINK, F.col("_code"), F.col("target"), F.concat_ws("#", "path", "fragment"), order),
        finding(broken, "bundle_id", RANK_LINK, "link.invalid_percent_utf8", F.col("path"), F.col("reference"), order),
    )


def fragment_needs(node: DataFrame, edge: DataFrame) -> DataFrame:
    """Fragments a graph relies on: those of symbols, and of coverage edges on their report."""
    symbols = node.filter("kind = 'symbol' and coalesce(fragment, '') <> '' and path is not null").select(
        "graph_id", "path", "fragment"
    )
    reports = node.select("graph_id", F.col("node_id").alias("source"), "path").filter("path is not null")
    covers = (
        edge.filter(F.col("kind").isin(*c.RELATION_EDGES) & (F.coalesce("fragment", F.lit("")) != ""))
        .select("graph_id", "source", "fragment")
        .distinct()
        .join(reports, ["graph_id", "source"])
        .select("graph_id", "path", "fragment")
    )
    return symbols.unionByName(covers).distinct()


def fragment_resolves_once(needs: DataFrame, anchor: DataFrame, scope: str = "graph_id") -> DataFrame:
    """Each needed ``(scope, path, fragment)`` must be exactly one anchor of its page."""
    counted = anchor.groupBy(scope, "path", F.col("name").alias("fragment")).agg(F.count(F.lit(1)).alias("_n"))
    wanted = needs.select(scope, "path", "fragment").distinct().join(counted, [scope, "path", "fragment"], "left")
    times = F.coalesce(F.col("_n"), F.lit(0))
    return faults(
        wanted, scope, 0, F.concat_ws("#", "path", "fragment"),
        (times == 0, "navigation.fragment_missing", "0"),
        (times > 1, "navigation.fragment_ambiguous", times),
    )
