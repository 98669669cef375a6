"""Data of the navigation pages: ordered entries, links and producer bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import contract as c
from ..functions import ids, ordered, references
from ..functions.joins import counted_join
from ..session import stored
from .findings import faults, finding, union
from .graph import node_id, with_edge, with_node

PAGES = ("index", "stages", "provenance")


def producer_digest_check(node: DataFrame, payload: DataFrame) -> DataFrame:
    """Digest a producer node commits to against the stored bytes."""
    kept = payload.select("graph_id", "path", F.col("sha256").alias("_stored"))
    wanted = node.filter(F.col("kind").isin(*c.PRODUCER_KINDS) & F.col("path").isNotNull() & F.col("sha256").isNotNull())
    joined = wanted.join(kept, ["graph_id", "path"], "left")
    return faults(
        joined, "graph_id", 0, F.col("path"),
        (F.col("_stored").isNull(), "navigation.artifact_unavailable", None),
        (F.col("_stored") != F.col("sha256"), "navigation.digest_mismatch", F.col("_stored")),
    )


def href(path: Column, fragment: Column) -> Column:
    """Relative address of an artifact from a navigation page; null for other paths."""
    target = F.concat(F.lit("../"), references.quoted(path, safe_slash=True))
    anchor = F.when(F.coalesce(fragment, F.lit("")) != "", F.concat(F.lit("#"), references.quoted(fragment, safe_slash=False)))
    return F.when(path.startswith("artifacts/"), F.concat(target, F.coalesce(anchor, F.lit(""))))


def navigation_index(node: DataFrame, edge: DataFrame) -> DataFrame:
    """``(graph_id, page, section, ord, label, href, node_id)`` of all pages."""
    section = None
    for name, kinds in c.NAVIGATION_SECTIONS:
        test = F.col("kind").isin(*kinds)
        section = F.when(test, name) if section is None else section.when(test, name)
    # ids move as bytes, and addresses are made last, from paths
    def own(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), ids.packed(F.col(name)))

    entry = ["graph_id", "page", "section", "label", "_path", "fragment", "_node", "_key"]
    addressed = F.when(F.col("kind") != "stage-result", F.col("path")).alias("_path")
    listed = node.select("graph_id", "kind", "provenance", "label", addressed, "fragment", own("node_id").alias("_node"))
    pages = F.array_compact(F.array(
        F.when(section.isNotNull(), F.struct(F.lit("index").alias("page"), section.alias("section"))),
        F.when(F.col("kind") == "stage-result", F.struct(F.lit("stages").alias("page"), F.lit("stages").alias("section"))),
        F.when(F.col("provenance").isNotNull(), F.struct(F.lit("provenance").alias("page"), F.lit("carriers").alias("section"))),
    ))
    listed = listed.select("*", F.explode(pages).alias("_at"), F.lit(None).cast("struct<name:string,digest:binary>").alias("_key")).select("*", "_at.*")
    reports = node.select("graph_id", own("node_id").alias("_source"), F.col("path").alias("_path"))
    targets = node.select("graph_id", own("node_id").alias("_target"), F.col("label").alias("_label"))
    covers = edge.filter("kind = 'covers-source'").select("graph_id", own("edge_id").alias("_key"), own("source").alias("_source"), own("target").alias("_target"), "fragment", "line")
    covers = stored(covers, "covers")
    # a popular source, or report, is dealt by its number of relations; sources first, as their short labels take the place of ids
    met = counted_join(covers, targets, ["graph_id", "_target"], ["_key"]).drop("_target")
    relations = (
        counted_join(met, reports, ["graph_id", "_source"], ["_key"], counted=covers)
        .select(
            "graph_id",
            F.lit("index").alias("page"),
            F.lit("relations").alias("section"),
            F.concat("_label", F.coalesce(F.concat(F.lit(":"), F.col("line").cast("string")), F.lit(""))).alias("label"),
            "_path",
            "fragment",
            F.col("_source").alias("_node"),
            "_key",
        )
    )
    # counted by slice and ranked, so written once
    rows = stored(union(listed.select(*entry), relations), "entries")
    key = ids.unpacked(F.coalesce("_key", "_node"))
    return ordered.digest_ordinal(rows, ["graph_id", "page", "section"], "_key", late=key).select(
        "graph_id", "page", "section", "ord", "label", href(F.col("_path"), F.col("fragment")).alias("href"), ids.unpacked(F.col("_node")).alias("node_id")
    )


def _page_identity() -> dict:
    return {name: F.col(name) for name in ("base_graph_id", "path", "sha256", "size", "snapshot_id")}


def navigation_targets(node: DataFrame, rendered: DataFrame) -> DataFrame:
    """``links-to`` edges from each rendered page to the nodes it exposes.

    ``rendered`` is ``(graph_id, snapshot_id, base_graph_id, page, path, sha256, size)``,
    three rows per graph.
    """
    exposed = F.array_compact(
        F.array(
            F.when(F.col("kind") != "rendered-navigation-artifact", F.lit("index")),
            F.when(F.col("kind") == "stage-result", F.lit("stages")),
            F.when(F.col("provenance").isNotNull(), F.lit("provenance")),
        )
    )
    wanted = node.select("graph_id", "node_id", F.explode(exposed).alias("page"))
    pages = rendered.select(
        "graph_id", "page", node_id("rendered-navigation-artifact", _page_identity()).alias("_page")
    )
    return with_edge(counted_join(wanted, pages, ["graph_id", "page"], ["node_id"]), "links-to", F.col("_page"), F.col("node_id"))


def rendered_graph(node: DataFrame, rendered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of rendered pages, and their edges: each describes its snapshot and links to what it exposes.

    A page whose graph has no snapshot node gets no ``describes-snapshot`` edge.
    """
    identity = ids.scoped_identity("rendered-navigation-artifact", _page_identity())
    pages = with_node(rendered, F.lit("rendered-navigation-artifact"), identity, F.col("path"), path=F.col("path"), sha256=F.col("sha256"))
    snapshot = node.filter("kind = 'snapshot'").select("graph_id", F.col("node_id").alias("_snapshot"))
    described = with_edge(pages.join(snapshot, "graph_id"), "describes-snapshot", F.col("node_id"), F.col("_snapshot"))
    return pages, described.unionByName(navigation_targets(node, rendered))


def rendered_audit(node: DataFrame, rendered: DataFrame) -> DataFrame:
    """Rendered pages whose path comes twice in a graph, or whose size or digest is not one; graphs that have rendered pages already."""
    twice = rendered.groupBy("graph_id", "path").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    present = node.filter("kind = 'rendered-navigation-artifact'").select("graph_id", "path").join(rendered.select("graph_id").distinct(), "graph_id", "left_semi")
    return union(
        finding(twice, "graph_id", 0, "artifact_graph.duplicate_node_id", F.col("path")),
        finding(present, "graph_id", 0, "artifact_graph.navigation_already_present", F.col("path")),
        faults(
            rendered, "graph_id", 0, F.col("path"),
            (~F.coalesce(F.col("size").cast("string").rlike(c.SIZE), F.lit(False)), "artifact_graph.invalid_size", F.col("size")),
            (~F.coalesce(F.col("sha256").rlike(c.HEX64), F.lit(False)), "artifact_graph.invalid_digest", F.col("sha256")),
        ),
    )
