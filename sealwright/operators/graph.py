"""The typed artifact graph as two tables, ``node`` and ``edge``.

Node and edge ids are pure functions of fields, so most edges are computed on
the row of their source without a join.  Checks against nodes first reduce the
edges to distinct endpoints: the snapshot node, which a large share of all edges
point at, becomes one row per map task before anything shuffles.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import contract as c
from ..functions import ids, json_walk, ordered, paths, text
from ..functions.joins import counted_join, spread_join
from ..session import stored as stored_table
from .findings import faults, finding, union

_OPTIONAL = ("path", "fragment", "sha256", "provenance", "stage_status")
NODE_COLUMNS = ("node_id", "kind", "label", *_OPTIONAL, "identity_sha256", "identity_json")
_EDGE_HEAD = "edge:sha256:"
#: Columns that hold content ids.
_IDS = ("node_id", "edge_id", "source", "target", "relation_id")
EDGE_COLUMNS = ("edge_id", "kind", "source", "target", "relation_id", "fragment", "line", "symbol")


def _null() -> Column:
    return F.lit(None).cast("string")


# --- ids --------------------------------------------------------------------

def node_id(kind: str, identity: Mapping[str, ids.Value]) -> Column:
    return ids.content_id(kind, ids.scoped_identity(kind, identity))


def with_node(df: DataFrame, kind: Column, identity_json: Column, label: Column, **fields: Column) -> DataFrame:
    """Project records to nodes; ``identity_json`` is the committed preimage."""
    return (
        df.select(
            "graph_id",
            "snapshot_id",
            kind.alias("kind"),
            label.alias("label"),
            *[fields.get(name, _null()).cast("string").alias(name) for name in _OPTIONAL],
            identity_json.alias("identity_json"),
        )
        .withColumn("identity_sha256", F.sha2("identity_json", 256))
        .withColumn("node_id", F.concat("kind", F.lit(":sha256:"), "identity_sha256"))
        .select("graph_id", "snapshot_id", *NODE_COLUMNS)
    )


def edge_id(
    fragment: Column, kind: Column, line: Column, relation: Column, source: Column, symbol: Column, target: Column, made: bool = False
) -> Column:
    """The id of an edge; ``made``: kind and ids were made here and need no escapes."""
    known = ids.made if made else ids.quoted
    own = {"kind": known(kind), "relation_id": known(relation), "source": known(source), "target": known(target)}
    return ids.content_id("edge", ids.members(own | {"fragment": ids.quoted(fragment), "line": ids.number(line), "symbol": ids.quoted(symbol)}))


def with_edge_ids(edge: DataFrame, made: bool = False) -> DataFrame:
    """Add ``edge_id`` to rows that have the other edge columns, missing ones as null."""
    for name in ("relation_id", "fragment", "symbol"):
        if name not in edge.columns:
            edge = edge.withColumn(name, _null())
    if "line" not in edge.columns:
        edge = edge.withColumn("line", F.lit(None).cast("int"))
    own = edge_id(*[F.col(n) for n in ("fragment", "kind", "line", "relation_id", "source", "symbol", "target")], made=made)
    return edge.withColumn("edge_id", own)


def with_edge(df: DataFrame, kind: str, source: Column, target: Column, **locator: Column) -> DataFrame:
    """Edges of ``kind`` between ids that were made here."""
    return with_edge_ids(
        df.select(
            "graph_id",
            F.lit(kind).alias("kind"),
            source.alias("source"),
            target.alias("target"),
            *[column.alias(name) for name, column in locator.items()],
        ),
        made=True,
    ).select("graph_id", *EDGE_COLUMNS)


def artifact_ids(payload: DataFrame, tree: Column, kind: str = "mapping") -> DataFrame:
    """Payload ids of a file as API artifact, coverage artifact and sidecar."""
    path, digest = F.col("path"), F.col("sha256")
    return payload.select(
        "bundle_id",
        "path",
        ids.artifact_id(path, digest, c.SYMBOL_PAYLOAD_KIND).alias("artifact_id"),
        ids.coverage_artifact_id(path, tree).alias("coverage_artifact_id"),
        ids.sidecar_id(kind, path, digest).alias("sidecar_id"),
    )


# --- identity objects -------------------------------------------------------

def _columns(*names: str) -> dict[str, Column]:
    return {name: F.col(name) for name in names}


_SNAPSHOT = ("snapshot_id",)
_SOURCE = ("path", "sha256", "snapshot_id")
_STAGE = ("digest", "snapshot_id", "stage", "status")
_OUTPUT = ("kind", "path", "sha256", "size", "snapshot_id", "stage")
_LOG = ("path", "sha256", "size", "snapshot_id", "stage", "stage_node_id")


def _api_json() -> Column:
    common = {
        "adapter": c.SYMBOL_ADAPTER,
        "artifact_id": ids.artifact_id(F.col("path"), F.col("sha256"), c.SYMBOL_PAYLOAD_KIND),
        "path": F.concat(F.lit("artifacts/api/"), "path"),
        "provenance": c.VERIFIED,
        **_columns("sha256", "snapshot_id"),
    }
    return F.when(F.col("kind") == "api-page", ids.scoped_identity("api-page", common)).otherwise(
        ids.scoped_identity("api-artifact", common | _columns("kind"))
    )


def _symbol_json() -> Column:
    return ids.scoped_identity(
        "symbol",
        {
            "adapter": c.SYMBOL_ADAPTER,
            "fragment": F.col("html_anchor"),
            "label": F.col("qualified_name"),
            "path": F.concat(F.lit("artifacts/api/"), "html_path"),
            **_columns("column", "entity_kind", "html_artifact_id", "line", "refid", "snapshot_id", "source_path"),
        },
    )


def _coverage_json(kind: Column, namespace: str) -> Column:
    # most nodes are coverage artifacts: their preimages are put together without a JSON writer
    texts = {
        "adapter_schema": F.lit(c.schema_id("coverage-report-tree.v1", namespace)),
        "path": F.concat(F.lit("artifacts/coverage/"), "path"),
        "report_tree_sha256": F.col("tree_sha256"),
        **_columns("provenance", "report_entry_point", "sha256", "snapshot_id"),
    }
    identity = {name: ids.quoted(text) for name, text in texts.items()}
    identity |= {"artifact_id": ids.made(ids.coverage_artifact_id(F.col("path"), F.col("tree_sha256"))), "entry_point": ids.number(F.col("entry_point"))}
    return ids.members({"identity": ids.members(identity), "kind": ids.made(kind)})


def _sidecar_json() -> Column:
    return ids.scoped_identity(
        "coverage-sidecar",
        {
            "artifact_id": ids.sidecar_id(F.col("kind"), F.col("path"), F.col("sha256")),
            "path": F.concat(F.lit("artifacts/coverage-sidecars/"), "kind", F.lit("/"), "path"),
            "source_path": F.col("path"),
            **_columns("kind", "sha256", "size", "snapshot_id"),
        },
    )


# --- assembly ---------------------------------------------------------------

def assemble(records: Mapping[str, DataFrame], namespace: str = c.DEFAULT_NAMESPACE) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all graphs from their record tables.

    ``records`` holds ``snapshot`` and ``snapshot_file`` and may hold
    ``stage_result``, ``stage_output``, ``api_artifact``, ``symbol_mapping``,
    ``coverage_artifact``, ``coverage_sidecar``, ``coverage_relation`` and
    ``producer_log``.  Rows have ``graph_id`` and ``snapshot_id``; sizes are
    decimal text.  Attribution to stages is one join for all kinds of records.
    """
    nodes: list[DataFrame] = []
    edges: list[DataFrame] = []
    described: list[DataFrame] = []
    credited: list[DataFrame] = []

    def add(rows: DataFrame) -> None:
        nodes.append(rows)
        described.append(rows.select("graph_id", "snapshot_id", "node_id"))

    def credit(df: DataFrame, json: Column, kind: Column, stage: Column) -> None:
        own = F.concat(kind, F.lit(":sha256:"), F.sha2(json, 256))
        credited.append(df.select("graph_id", own.alias("node_id"), stage.alias("stage")))

    nodes.append(
        with_node(
            records["snapshot"], F.lit("snapshot"), ids.scoped_identity("snapshot", _columns(*_SNAPSHOT)), F.col("snapshot_id")
        )
    )
    files = records["snapshot_file"].filter("kind = 'file'")
    file_json = ids.scoped_identity("source-file", _columns(*_SOURCE))
    add(with_node(files, F.lit("source-file"), file_json, F.col("path"), **_columns("path", "sha256")))
    sources = files.select(
        "graph_id", F.col("path").alias("source_path"), node_id("source-file", _columns(*_SOURCE)).alias("_source")
    )

    results = None
    if "stage_result" in records:
        stages = records["stage_result"]
        stage_json = ids.scoped_identity("stage-result", _columns(*_STAGE))
        add(with_node(stages, F.lit("stage-result"), stage_json, F.col("stage"), sha256=F.col("digest"), stage_status=F.col("status")))
        results = stages.select(
            "graph_id", "stage", "status", "executed", node_id("stage-result", _columns(*_STAGE)).alias("stage_node_id")
        )

    if "stage_output" in records:
        outputs = spread_join(
            records["stage_output"], results.select("graph_id", "stage", "status"), ["graph_id", "stage"], "path"
        )
        output_json = ids.scoped_identity("stage-output", _columns(*_OUTPUT))
        add(
            with_node(
                outputs, F.lit("stage-output"), output_json, F.col("path"),
                stage_status=F.col("status"), **_columns("path", "sha256"),
            )
        )
        credit(records["stage_output"], output_json, F.lit("stage-output"), F.col("stage"))

    symbols = None
    if "api_artifact" in records:
        api = records["api_artifact"]
        kind = F.when(F.col("kind") == "api-page", "api-page").otherwise("api-artifact")
        add(
            with_node(
                api, kind, _api_json(), F.col("path"), path=F.concat(F.lit("artifacts/api/"), "path"),
                sha256=F.col("sha256"), provenance=F.lit(c.VERIFIED),
            )
        )
        credit(api, _api_json(), kind, F.lit(c.SYMBOL_STAGE))
        pages = api.filter("kind = 'api-page'").select(
            "graph_id",
            F.col("path").alias("html_path"),
            F.concat(F.lit("api-page:sha256:"), F.sha2(_api_json(), 256)).alias("_page"),
            ids.artifact_id(F.col("path"), F.col("sha256"), c.SYMBOL_PAYLOAD_KIND).alias("html_artifact_id"),
        )
        if "symbol_mapping" in records:
            mapped = records["symbol_mapping"].join(pages, ["graph_id", "html_path"]).join(sources, ["graph_id", "source_path"])
            nodes.append(
                with_node(
                    mapped, F.lit("symbol"), _symbol_json(), F.col("qualified_name"),
                    path=F.concat(F.lit("artifacts/api/"), "html_path"), fragment=F.col("html_anchor"),
                )
            )
            own = F.concat(F.lit("symbol:sha256:"), F.sha2(_symbol_json(), 256))
            pairs = mapped.select("graph_id", "_page", "_source").distinct()
            edges.append(with_edge(pairs, "documents-source", F.col("_page"), F.col("_source")))
            edges.append(with_edge(mapped, "documents-symbol", F.col("_page"), own))
            symbols = mapped.select("graph_id", "source_path", F.col("qualified_name").alias("symbol"), own.alias("_symbol"))

    if "coverage_artifact" in records:
        artifacts = records["coverage_artifact"]
        kind = (
            F.when(F.col("entry_point"), "coverage-report")
            .when(F.col("path").endswith(".html"), "coverage-page")
            .otherwise("coverage-summary")
        )
        json = _coverage_json(kind, namespace)
        add(
            with_node(
                artifacts, kind, json, F.col("path"), path=F.concat(F.lit("artifacts/coverage/"), "path"),
                **_columns("sha256", "provenance"),
            )
        )
        credit(artifacts, json, kind, F.lit(c.COVERAGE_STAGE))
        if "coverage_relation" in records:
            reports = artifacts.select(
                "graph_id",
                F.col("path").alias("report_path"),
                F.concat(kind, F.lit(":sha256:"), F.sha2(json, 256)).alias("_report"),
                ids.coverage_artifact_id(F.col("path"), F.col("tree_sha256")).alias("report_artifact_id"),
            )
            edges.append(_relation_edges(records["coverage_relation"], reports, sources, symbols))

    if "coverage_sidecar" in records:
        sidecars = records["coverage_sidecar"]
        add(
            with_node(
                sidecars, F.lit("coverage-sidecar"), _sidecar_json(), F.col("path"), sha256=F.col("sha256"),
                path=F.concat(F.lit("artifacts/coverage-sidecars/"), "kind", F.lit("/"), "path"),
            )
        )
        credit(sidecars, _sidecar_json(), F.lit("coverage-sidecar"), F.lit(c.COVERAGE_STAGE))

    if "producer_log" in records:
        executed = results.filter("executed").select("graph_id", "stage", "stage_node_id")
        logs = spread_join(records["producer_log"], executed, ["graph_id", "stage"], "path")
        log_json = ids.scoped_identity("producer-log", _columns(*_LOG))
        add(
            with_node(
                logs, F.lit("producer-log"), log_json, F.col("path"),
                path=F.concat(F.lit("artifacts/logs/"), "path"), sha256=F.col("sha256"),
            )
        )
        own = node_id("producer-log", _columns(*_LOG))
        edges.append(with_edge(logs, "has-log", F.col("stage_node_id"), own))

    edges.append(
        with_edge(union(*described), "describes-snapshot", F.col("node_id"), node_id("snapshot", _columns(*_SNAPSHOT)))
    )
    if results is not None and credited:
        # most records of a graph belong to one of two stages
        owned = spread_join(
            union(*credited), results.select("graph_id", "stage", "stage_node_id"), ["graph_id", "stage"], "node_id"
        )
        edges.append(with_edge(owned, "generated-by-stage", F.col("node_id"), F.col("stage_node_id")))
    return union(*nodes), union(*edges)


def _relation_edges(
    relation: DataFrame, reports: DataFrame, sources: DataFrame, symbols: DataFrame | None
) -> DataFrame:
    """Edges of relations to their source and, if it is one, to their symbol.

    Relations meet symbols and sources while they are still narrow, and reports last: long ids are made where the edge is, and
    digests travel as bytes.
    """
    # sources first, as they drop relations whose source is not there; only relations with a symbol move on to meet symbols
    sources = sources.withColumn("_source", ids.digest_of(F.col("_source")))
    if symbols is None:
        rows = relation.join(sources, ["graph_id", "source_path"]).withColumn("_symbol", F.lit(None).cast("binary"))
    else:
        keys = ["graph_id", "source_path", "symbol"]
        unique = symbols.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(ids.digest_of(F.col("_symbol"))).alias("_symbol")).filter("_n = 1").drop("_n")
        named, others = (relation.filter(f"symbol is {which}").join(sources, ["graph_id", "source_path"]) for which in ("not null", "null"))
        rows = others.withColumn("_symbol", F.lit(None).cast("binary")).unionByName(named.join(unique, keys, "left"))
    reports = reports.select(
        "graph_id", "report_path", F.substring_index("_report", ":", 2).alias("_name"), ids.digest_of(F.col("_report")).alias("_report"),
        ids.digest_of(F.col("report_artifact_id")).alias("_artifact"),
    )
    spread = ["source_path", "fragment", "line", "symbol"]
    bound = counted_join(rows, reports, ["graph_id", "report_path"], spread, counted=relation)
    artifact = ids.with_digest(F.lit("coverage-artifact:sha256"), F.col("_artifact"))
    own = ids.relation_id(*[artifact if n is None else F.col(n) for n in ("fragment", "line", None, "report_path", "snapshot_id", "source_path", "symbol")])
    ends = F.array(
        F.struct(F.lit("covers-source").alias("kind"), ids.with_digest(F.lit("source-file:sha256"), F.col("_source")).alias("target")),
        F.when(F.col("_symbol").isNotNull(), F.struct(F.lit("covers-symbol").alias("kind"), ids.with_digest(F.lit("symbol:sha256"), F.col("_symbol")).alias("target"))),
    )
    each = bound.select(
        "graph_id", F.explode(F.array_compact(ends)).alias("_end"), ids.with_digest(F.col("_name"), F.col("_report")).alias("source"),
        own.alias("relation_id"), "fragment", "line", "symbol",
    )
    edges = each.select("graph_id", "_end.kind", "source", "_end.target", "relation_id", "fragment", "line", "symbol")
    return with_edge_ids(edges, made=True).select("graph_id", *EDGE_COLUMNS)


def _absent(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not known; popular keys meet ``known`` once, and only failing ones come back to their rows."""
    missing = rows.select(*keys).distinct().join(known.select(*keys).distinct(), keys, "left_anti")
    return rows.join(missing, keys, "left_semi")


def assembly_findings(records: Mapping[str, DataFrame]) -> DataFrame:
    """Records that :func:`assemble` can give no node or edge, as rows.

    Absent endpoints of symbol mappings, coverage relations, stage outputs and logs; symbols that a
    relation could mean more than one of; mappings that repeat a reference id or a semantic target;
    lines and columns that are no positive canonical decimals.
    """
    found: list[DataFrame] = []

    def report(rows: DataFrame, code: str, path: Column, detail: str | None = None) -> None:
        found.append(finding(rows, "graph_id", 0, f"artifact_graph.{code}", path, detail))

    sources = records["snapshot_file"].filter("kind = 'file'").select("graph_id", F.col("path").alias("source_path"))
    if "symbol_mapping" in records and "api_artifact" in records:
        mapped, refid = records["symbol_mapping"], F.col("refid")
        pages = records["api_artifact"].filter("kind = 'api-page'").select("graph_id", F.col("path").alias("html_path"))
        report(_absent(mapped, pages, ["graph_id", "html_path"]), "missing_endpoint", refid, "page")
        report(_absent(mapped, sources, ["graph_id", "source_path"]), "missing_endpoint", refid, "source")
        for keys, detail in ((["refid"], "reference id"), (["source_path", "qualified_name", "html_path", "html_anchor"], "target")):
            repeated = mapped.groupBy("graph_id", *keys).agg(F.count(F.lit(1)).alias("_n"), F.min("refid").alias("_first")).filter("_n > 1")
            report(repeated, "duplicate_node_id", F.col("_first"), detail)
        for place in ("line", "column"):
            if place in mapped.columns:
                text = F.col(place).cast("string")
                report(mapped.filter(text.isNotNull() & ~text.rlike(c.POSITIVE_SIZE)), "invalid_identity", refid, place)
        if "coverage_relation" in records:
            keys = ["graph_id", "source_path", "symbol"]
            names = mapped.select("graph_id", "source_path", F.col("qualified_name").alias("symbol"))
            many = names.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*keys)
            report(records["coverage_relation"].join(many, keys, "left_semi"), "ambiguous_relation", F.col("report_path"), "symbol")
    if "coverage_relation" in records and "coverage_artifact" in records:
        relation = records["coverage_relation"]
        reports = records["coverage_artifact"].select("graph_id", F.col("path").alias("report_path"))
        report(_absent(relation, reports, ["graph_id", "report_path"]), "missing_endpoint", F.col("report_path"), "report")
        report(_absent(relation, sources, ["graph_id", "source_path"]), "missing_endpoint", F.col("source_path"), "source")
    if "stage_result" in records:
        results = records["stage_result"]
        for name, detail in (("stage_output", "output"), ("producer_log", "log")):
            if name in records:
                report(_absent(records[name], results, ["graph_id", "stage"]), "missing_endpoint", F.col("path"), detail)
        if "producer_log" in records:
            idle = results.filter(~F.col("executed")).select("graph_id", "stage").distinct()
            report(records["producer_log"].join(idle, ["graph_id", "stage"], "left_semi"), "stage_output_mismatch", F.col("path"), "log")
    return union(*found) if found else finding(sources.limit(0), "graph_id", 0, "artifact_graph.missing_endpoint")


# --- field audits -----------------------------------------------------------

def rule_table(spark: SparkSession) -> DataFrame:
    """The fixed rules over node kinds, one row per kind."""
    schema = "kind string, fields array<string>, prefix string, members array<string>"
    rows = [
        (kind, list(rule["fields"]), rule["prefix"], list(rule["identity"])) for kind, rule in c.NODE_RULES.items()
    ]
    return spark.createDataFrame(rows, schema)


_MEMBERS = ("digest", "fragment", "label", "path", "provenance", "sha256", "snapshot_id", "stage", "status")


def node_field_audit(node: DataFrame) -> DataFrame:
    """Which fields a kind carries, its path prefix and label, and its identity object.

    The rule table has one row per node kind, thirteen in all, and is broadcast.
    """
    code = "artifact_graph.identity_mismatch"
    kind, label, path = F.col("kind"), F.col("label"), F.col("path")
    known = F.col("fields").isNotNull()
    rows = (
        node.join(F.broadcast(rule_table(node.sparkSession)), "kind", "left")
        .withColumn("_identity", F.get_json_object("identity_json", "$.identity"))
        .withColumn("_value", F.from_json("_identity", ", ".join(f"{name} string" for name in _MEMBERS)))
        .withColumn("_rest", F.expr("substring(path, length(coalesce(prefix, '')) + 1)"))
    )
    rest, member = F.col("_rest"), F.col("_value")

    def carries(name: str) -> Column:
        return F.array_contains("fields", name)

    def differs(name: str, value: Column, wanted: Column) -> Column:
        return wanted & ~member[name].eqNullSafe(value)

    def listed(name: str) -> Column:
        return F.array_contains("members", name)

    wrong_label = (
        F.when(kind == "snapshot", ~label.eqNullSafe(F.col("snapshot_id")))
        .when(kind == "stage-result", ~F.coalesce(label.rlike(c.TOKEN), F.lit(False)))
        .when(kind == "symbol", label.isNull() | (label == "") | text.has_control(label))
        .when(kind == "coverage-sidecar", ~F.regexp_replace(rest, "^[^/]*/", "").eqNullSafe(label))
        .otherwise(~rest.eqNullSafe(label))
    )
    wrong_value = (
        differs("sha256", F.col("sha256"), listed("sha256"))
        | differs("provenance", F.col("provenance"), listed("provenance"))
        | differs("snapshot_id", F.col("snapshot_id"), listed("snapshot_id"))
        | differs("path", F.when(kind == "producer-log", rest).otherwise(path), listed("path"))
        | differs("digest", F.col("sha256"), kind == "stage-result")
        | differs("stage", label, kind == "stage-result")
        | differs("status", F.col("stage_status"), kind == "stage-result")
        | differs("label", label, kind == "symbol")
        | differs("fragment", F.col("fragment"), kind == "symbol")
    )
    wrong_fields = F.exists(
        F.array(*[F.col(name).isNotNull() != carries(name) for name in _OPTIONAL]), lambda off: off
    )
    digest_ok = F.coalesce(F.col("sha256").rlike(c.HEX64), F.lit(False))
    # nodes may be costly to derive: one pass tells all rules, and hands on the texts that have to be looked at
    looked = {"label": code, "path": "artifact_graph.invalid_path"}
    found = stored_table(faults(
        rows, "graph_id", 0, F.col("node_id"),
        (~known, "artifact_graph.invalid_node_kind", kind),
        (known & ~kind.isin("snapshot", "symbol") & ~digest_ok, "artifact_graph.invalid_digest", None),
        (known & wrong_fields, code, "fields"),
        (known & F.col("prefix").isNotNull() & ~F.coalesce(path.startswith(F.col("prefix")), F.lit(False)), code, "prefix"),
        (known & carries("path") & paths.breaks_profile(rest), "artifact_graph.invalid_path", path),
        (known & wrong_label, code, "label"),
        (F.col("provenance").isNotNull() & ~F.col("provenance").isin(*c.PROVENANCE), code, "provenance"),
        (F.col("stage_status").isNotNull() & ~F.col("stage_status").isin(*c.STAGE_STATES), code, "stage_status"),
        (known & ~F.array_sort(F.json_object_keys("_identity")).eqNullSafe(F.col("members")), code, "identity members"),
        (known & wrong_value, code, "identity values"),
        *[(text.may_break_nfc(F.col(name)), f"{name}?", F.col(name)) for name in looked],
    ), "node-faults")
    composed = [
        text.only_not_nfc(found.filter(F.col("code") == f"{name}?"), "detail").withColumns({"code": F.lit(problem), "detail": F.lit(f"{name} nfc")})
        for name, problem in looked.items()
    ]
    return union(found.filter(~F.col("code").isin(*[f"{name}?" for name in looked])), *composed)


def edge_field_audit(edge: DataFrame) -> DataFrame:
    """Coverage edges carry a full locator, structural edges none."""
    covers = F.col("kind").isin(*c.RELATION_EDGES)
    known = F.col("kind").isin(*c.EDGE_KINDS)

    def unclean(name: str) -> Column:
        return F.coalesce((F.col(name) == "") | text.has_control(F.col(name)), F.lit(False))

    own = F.col("edge_id")
    rules = [
        (~known, "artifact_graph.invalid_edge_kind", F.col("kind")),
        (covers & ~F.coalesce(F.col("relation_id").rlike(c.RELATION_ID), F.lit(False)), "artifact_graph.invalid_relation", "relation_id"),
        (covers & F.coalesce(F.col("line") < 1, F.lit(False)), "artifact_graph.invalid_relation", "line"),
        (covers & unclean("fragment"), "artifact_graph.invalid_identity", "fragment"),
        (covers & unclean("symbol"), "artifact_graph.invalid_identity", "symbol"),
        (
            known & ~covers
            & (F.col("relation_id").isNotNull() | F.col("fragment").isNotNull() | F.col("line").isNotNull() | F.col("symbol").isNotNull()),
            "artifact_graph.invalid_relation", "structural",
        ),
    ]
    # edges may be costly to derive: one pass keeps those that break a rule, and those whose text has to be looked at
    beyond = [covers & F.coalesce(F.col(name).rlike(r"[^\x00-\x7F]"), F.lit(False)) for name in ("fragment", "symbol")]
    suspect = reduce(Column.__or__, [F.coalesce(condition, F.lit(False)) for condition, _, _ in rules] + beyond)
    held = stored_table(edge.filter(suspect).select("graph_id", "edge_id", "kind", "relation_id", "fragment", "line", "symbol"), "suspect-edges")
    relation = held.filter(covers)
    return union(
        faults(held, "graph_id", 0, own, *rules),
        *[
            finding(text.only_not_nfc(relation, name), "graph_id", 0, "artifact_graph.invalid_identity", own, name)
            for name in ("fragment", "symbol")
        ],
    )


# --- checks between nodes and edges -----------------------------------------

def _sides(edge: DataFrame, *extra: str) -> list[tuple[str, DataFrame]]:
    return [(side, edge.select("graph_id", *extra, F.col(side).alias("node_id")).distinct()) for side in ("source", "target")]


def edge_endpoint_check(node: DataFrame, edge: DataFrame) -> DataFrame:
    """Both ends of an edge must be nodes of its graph."""
    known = node.select("graph_id", "node_id")
    parts = []
    for side, ends in _sides(edge):
        absent = ends.join(known, ["graph_id", "node_id"], "left_anti").withColumnRenamed("node_id", side)
        hits = edge.join(absent, ["graph_id", side], "left_semi")
        parts.append(finding(hits, "graph_id", 0, "artifact_graph.missing_endpoint", F.col("edge_id"), side))
    return union(*parts)


def edge_type_check(node: DataFrame, edge: DataFrame) -> DataFrame:
    """Kinds of both ends must suit the edge kind.

    The rule is one set of kinds per side, so each side is decided on distinct
    ``(edge kind, end)`` pairs by itself.
    """
    kinds = node.groupBy("graph_id", "node_id").agg(F.min("kind").alias("_end"))
    parts = []
    for n, (side, ends) in enumerate(_sides(edge, "kind")):
        allowed = None
        for kind, rule in c.EDGE_ENDPOINTS.items():
            test = F.col("_end").isin(*rule[n])
            allowed = F.when(F.col("kind") == kind, test) if allowed is None else allowed.when(F.col("kind") == kind, test)
        wrong = (
            ends.join(kinds, ["graph_id", "node_id"])
            .filter(~allowed.otherwise(F.lit(False)))
            .select("graph_id", "kind", F.col("node_id").alias(side))
        )
        hits = edge.join(wrong, ["graph_id", "kind", side], "left_semi")
        parts.append(finding(hits, "graph_id", 0, "artifact_graph.invalid_edge_kind", F.col("edge_id"), side))
    return union(*parts)


def symbol_endpoint_check(node: DataFrame) -> DataFrame:
    """Source file and page of a symbol exist once each and agree on the page's artifact."""

    def member(name: str) -> Column:
        return F.get_json_object("identity_json", f"$.identity.{name}")

    symbols = node.filter("kind = 'symbol'").select(
        "graph_id", "node_id", "path", member("source_path").alias("source_path"), member("html_artifact_id").alias("_own")
    )
    files = node.filter("kind = 'source-file'").groupBy("graph_id", F.col("path").alias("source_path")).agg(
        F.count(F.lit(1)).alias("_files")
    )
    pages = node.filter("kind = 'api-page'").groupBy("graph_id", "path").agg(
        F.count(F.lit(1)).alias("_pages"), F.min(member("artifact_id")).alias("_artifact")
    )
    joined = symbols.join(files, ["graph_id", "source_path"], "left").join(pages, ["graph_id", "path"], "left")
    alone = F.coalesce((F.col("_files") == 1) & (F.col("_pages") == 1), F.lit(False))
    return faults(
        joined, "graph_id", 0, F.col("node_id"),
        (~alone, "artifact_graph.missing_endpoint", F.concat_ws("|", F.coalesce("_files", F.lit(0)), F.coalesce("_pages", F.lit(0)))),
        (alone & ~F.col("_own").eqNullSafe(F.col("_artifact")), "artifact_graph.identity_mismatch", None),
    )


def coverage_symbol_resolution(relation: DataFrame, symbol: DataFrame, scope: str) -> DataFrame:
    """Relations that name a symbol: one match is an edge, several are a fault, none stays at file level."""
    keys = [scope, "source_path", "symbol"]
    matches = symbol.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("symbol_node").alias("symbol_node"))
    outcome = (
        F.when(F.col("_n").isNull(), "file-level")
        .when(F.col("_n") == 1, "covers-symbol")
        .otherwise("artifact_graph.ambiguous_relation")
    )
    return (
        relation.filter(F.col("symbol").isNotNull())
        .join(matches, keys, "left")
        .withColumn("outcome", outcome)
        .withColumn("symbol_node", F.when(F.col("_n") == 1, F.col("symbol_node")))
        .drop("_n")
    )


def singleton_check(node: DataFrame) -> DataFrame:
    """One snapshot per graph; its coverage nodes share one report, entry point and tree."""

    def member(name: str) -> Column:
        return F.get_json_object("identity_json", f"$.identity.{name}")

    covers = F.col("kind").isin(*c.COVERAGE_KINDS)
    # distinct values are told apart by least and greatest, which needs no set
    summary = node.groupBy("graph_id").agg(
        F.count_if(F.col("kind") == "snapshot").alias("snapshots"),
        F.count_if(covers).alias("coverage"),
        F.count_if(F.col("kind") == "coverage-report").alias("reports"),
        F.min(F.when(covers, member("report_entry_point"))).alias("e1"),
        F.max(F.when(covers, member("report_entry_point"))).alias("e2"),
        F.min(F.when(covers, member("report_tree_sha256"))).alias("t1"),
        F.max(F.when(covers, member("report_tree_sha256"))).alias("t2"),
    )
    has = F.col("coverage") > 0
    return faults(
        summary, "graph_id", 0, None,
        (F.col("snapshots") != 1, "artifact_graph.snapshot_cardinality", F.col("snapshots")),
        (has & (F.col("reports") != 1), "artifact_graph.identity_mismatch", "report nodes"),
        (has & ~((F.col("e1") == F.col("e2")) & F.col("e1").isNotNull()), "artifact_graph.identity_mismatch", "entry points"),
        (has & ~((F.col("t1") == F.col("t2")) & F.col("t1").isNotNull()), "artifact_graph.identity_mismatch", "trees"),
    )


def scope_binding_check(child: DataFrame, parent: DataFrame, scope: str, columns: list[str], record: str, code: str) -> DataFrame:
    """Child records must carry the bindings of their parent."""
    renamed = parent.select(scope, *[F.col(name).alias(f"_p_{name}") for name in columns], F.lit(True).alias("_found"))
    joined = counted_join(child, renamed, [scope], [record], "left")
    return faults(
        joined, scope, 0, F.col(record),
        (F.col("_found").isNull(), code, "no parent"),
        *[
            (F.col("_found") & ~F.col(name).eqNullSafe(F.col(f"_p_{name}")), code, name)
            for name in columns
        ],
    )


def base_graph(node: DataFrame, edge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without rendered pages, and the edges that keep both ends."""
    kept = node.filter("kind <> 'rendered-navigation-artifact'")
    known = kept.select("graph_id", "node_id")
    for side, ends in _sides(edge):
        gone = ends.join(known, ["graph_id", "node_id"], "left_anti").withColumnRenamed("node_id", side)
        edge = edge.join(gone, ["graph_id", side], "left_anti")
    return kept, edge


# --- identities and summaries -----------------------------------------------

def node_record() -> Column:
    return ids.canonical(_columns(*NODE_COLUMNS))


def edge_record() -> Column:
    return ids.canonical(_columns(*EDGE_COLUMNS))


def graph_digest(
    node: DataFrame, edge: DataFrame, snapshot: DataFrame, namespace: str = c.DEFAULT_NAMESPACE, versions: int = 1
) -> DataFrame:
    """``(graph_id, content_id)`` over schema, snapshot and all ordered records.

    ``edge`` may be made ready by :func:`edge_lines`. With ``versions`` the edges of several versions of a graph, with the versions
    that hold each as bits in ``held``, are told in one pass: ``content_id_2`` is the id of the second, and so on.
    """
    glue = snapshot.select(
        "graph_id",
        F.array(
            F.lit('{"edges":['),
            F.lit('],"nodes":['),
            F.concat(
                F.lit('],"schema":"%s","snapshot_id":' % c.schema_id("artifact-graph.v1", namespace)),
                ids.json_string(F.col("snapshot_id")),
                F.lit("}"),
            ),
        ).alias("glue"),
    )
    lines = edge_lines(edge) if "_edge" not in edge.columns else edge.select("graph_id", "slice", "key", "_edge", "held")
    listing = lines.withColumn("part", F.lit(0)).unionByName(_node_lines(node, (1 << versions) - 1).withColumn("part", F.lit(1)), allowMissingColumns=True)
    first = F.col("part") == 0
    late = (
        F.when(first, _edge_key()).otherwise(_node_key()), F.when(first, _edge_text()).otherwise(_node_text()), {"_body": F.when(first, _edge_body())},
    )
    digest = ordered.ordered_digest(listing, ["graph_id"], glue, parts=2, late=late, versions=versions)
    told = [F.col("sha256")] if versions == 1 else [F.col("sha256")[at] for at in range(versions)]
    named = [F.concat(F.lit("artifact-graph:sha256:"), one).alias(f"content_id_{at + 1}" if at else "content_id") for at, one in enumerate(told)]
    return digest.select("graph_id", *named)


def edge_lines(edge: DataFrame, follows: Column | None = None, extra: list[str] | None = None) -> DataFrame:
    """Edges as they are dealt to be sorted: ``(graph_id, slice, key, _edge, held)`` and ``extra`` columns.

    Digests are bytes. An id that follows from the other columns is not dealt, but made again (``key`` is null); ``follows`` tells
    which do. Edges without ``edge_id`` have the id that follows.
    """
    own = edge_id(*[F.col(n) for n in ("fragment", "kind", "line", "relation_id", "source", "symbol", "target")])
    if "edge_id" not in edge.columns:
        edge, follows = edge.withColumn("edge_id", own), F.lit(True)
    elif follows is None:
        follows = F.col("edge_id").eqNullSafe(own)
    rest = [ids.packed(F.col(n)).alias(n) if n in _IDS else F.col(n) for n in EDGE_COLUMNS if n != "edge_id"]
    key = F.when(~follows, ids.packed(F.col("edge_id")))
    held = F.col("held") if "held" in edge.columns else F.lit(1).alias("held")
    return edge.select("graph_id", ordered.slice_of(F.col("edge_id"), [_EDGE_HEAD]).alias("slice"), key.alias("key"), F.struct(*rest).alias("_edge"), held, *(extra or []))


def _edge_body() -> Column:
    """The preimage of an edge's id without its first bracket; the record of the edge goes on with it after the id."""
    at = F.col("_edge")
    texts = {n: ids.quoted_pack(at[n]) if n in _IDS else ids.number(at[n]) if n == "line" else ids.quoted(at[n]) for n in EDGE_COLUMNS if n != "edge_id"}
    return ids.members(texts, opened=True)


def _edge_key(body: Column | None = None) -> Column:
    body = F.col("_body") if body is None else body
    return F.when(F.col("key").isNull(), ids.content_id("edge", F.concat(F.lit("{"), body))).otherwise(ids.unpacked(F.col("key")))


def _edge_text() -> Column:
    own = F.when(F.col("key").isNull(), ids.made(F.col("_line_key"))).otherwise(ids.quoted(F.col("_line_key")))
    return F.concat(F.lit('{"edge_id":'), own, F.lit(","), F.col("_body"))


def edges_of(lines: DataFrame) -> DataFrame:
    """The edges of :func:`edge_lines`."""
    at = F.col("_edge")
    rest = [(ids.unpacked(at[n]) if n in _IDS else at[n]).alias(n) for n in EDGE_COLUMNS if n != "edge_id"]
    return lines.select("graph_id", _edge_key(_edge_body()).alias("edge_id"), *rest)


def _node_lines(node: DataFrame, held: int) -> DataFrame:
    """Nodes as they are dealt to be sorted; what follows from kind and preimage, id and digest, is made again."""
    digest = F.sha2("identity_json", 256)
    follows = F.coalesce((F.col("identity_sha256") == digest) & (F.col("node_id") == F.concat("kind", F.lit(":sha256:"), digest)), F.lit(False))
    rest = [F.col(n) for n in NODE_COLUMNS if n not in ("node_id", "identity_sha256")]
    heads = [f"{kind}:sha256:" for kind in c.NODE_RULES]
    return node.select(
        "graph_id", ordered.slice_of(F.col("node_id"), heads).alias("slice"), F.when(~follows, ids.packed(F.col("node_id"))).alias("key"),
        F.struct(F.when(~follows, F.col("identity_sha256")).alias("identity_sha256"), *rest).alias("_node"), F.lit(held).alias("held"),
    )


def _node_key() -> Column:
    at = F.col("_node")
    return F.when(F.col("key").isNull(), F.concat(at["kind"], F.lit(":sha256:"), F.sha2(at["identity_json"], 256))).otherwise(ids.unpacked(F.col("key")))


def _node_text() -> Column:
    at = F.col("_node")
    digest = F.when(F.col("key").isNull(), F.substring("_line_key", -64, 64)).otherwise(at["identity_sha256"])
    return ids.canonical({n: F.col("_line_key") if n == "node_id" else digest if n == "identity_sha256" else at[n] for n in NODE_COLUMNS})


def content_id_check(node: DataFrame, edge: DataFrame | None) -> DataFrame:
    """Stored ids, digests and preimages against recomputation, for nodes and (if given) edges."""
    code = "artifact_graph.identity_mismatch"
    preimage, digest = F.col("identity_json"), F.sha2("identity_json", 256)
    member = F.from_json(preimage, "identity struct<snapshot_id:string>, kind string")
    # a sound node is told by one digest and one look into its preimage
    sound = (
        F.col("identity_sha256").eqNullSafe(digest)
        & F.col("node_id").eqNullSafe(F.concat("kind", F.lit(":sha256:"), "identity_sha256"))
        & preimage.eqNullSafe(F.concat(F.lit('{"identity":'), F.get_json_object(preimage, "$.identity"), F.lit(',"kind":"'), "kind", F.lit('"}')))
        & F.get_json_object(preimage, "$.identity.snapshot_id").eqNullSafe(F.col("snapshot_id"))
    )
    held = preimage.isNotNull()
    nodes = faults(
        node, "graph_id", 0, F.col("node_id"),
        (~held, code, "no preimage"),
        (held & ~F.get_json_object(preimage, "$.kind").eqNullSafe(F.col("kind")), code, "kind"),
        (held & ~member["identity"]["snapshot_id"].eqNullSafe(F.col("snapshot_id")), code, "scope"),
        (held & ~F.col("identity_sha256").eqNullSafe(digest), code, "digest"),
        (held & ~F.col("node_id").eqNullSafe(F.concat("kind", F.lit(":sha256:"), digest)), code, "node id"),
        suspect=~sound,
    )
    if edge is None:
        return nodes
    again = edge_id(*[F.col(n) for n in ("fragment", "kind", "line", "relation_id", "source", "symbol", "target")])
    edges = faults(edge, "graph_id", 0, F.col("edge_id"), (~F.col("edge_id").eqNullSafe(again), code, "edge id"))
    return union(nodes, edges)


def graph_id_check(stored: DataFrame, digest: DataFrame, corrected: DataFrame | None = None) -> DataFrame:
    """Stored graph ids ``(graph_id, content_id)`` against :func:`graph_digest`.

    ``corrected``: the digest over records whose own faults are mended. A graph id that covers the right
    records is sound, whatever has been done to a record since.
    """
    joined = stored.select("graph_id", F.col("content_id").alias("_stored")).join(digest, "graph_id", "left")
    sound = F.col("_stored").eqNullSafe(F.col("content_id"))
    if corrected is not None:
        joined = joined.join(corrected.select("graph_id", F.col("content_id").alias("_right")), "graph_id", "left")
        sound |= F.col("_stored").eqNullSafe(F.col("_right"))
    return finding(joined.filter(~sound), "graph_id", 0, "artifact_graph.identity_mismatch", F.col("_stored"), F.col("content_id"))


def leaf_id_check(records: Mapping[str, DataFrame]) -> DataFrame:
    """Ids that records claim of themselves, against recomputation: the lowest level of identities.

    ``api_artifact``, ``coverage_artifact`` and ``coverage_sidecar`` claim ``artifact_id``, ``stage_result`` claims
    ``digest`` of ``identity_json``. A sidecar may bring its ``content``: then digest and size are held against it too. Tables
    and columns that are not there are not checked.
    """
    code = "artifact_graph.identity_mismatch"
    path, digest = F.col("path"), F.col("sha256")
    found: list[DataFrame] = []
    claims = {
        "api_artifact": ("artifact id", lambda: ids.artifact_id(path, digest, c.SYMBOL_PAYLOAD_KIND)),
        "coverage_artifact": ("coverage artifact id", lambda: ids.coverage_artifact_id(path, F.col("tree_sha256"))),
        "coverage_sidecar": ("sidecar id", lambda: ids.sidecar_id(F.col("kind"), path, digest)),
    }
    for name, (detail, own) in claims.items():
        if name in records and "artifact_id" in records[name].columns:
            rules = [(~F.col("artifact_id").eqNullSafe(own()), code, detail)]
            if "content" in records[name].columns:
                content = F.col("content")
                wrong = ~digest.eqNullSafe(F.sha2(content, 256)) | ~F.col("size").eqNullSafe(F.octet_length(content).cast("string"))
                rules.append((wrong, code, "sidecar bytes"))
            found.append(faults(records[name], "graph_id", 0, path, *rules))
    if "stage_result" in records and "identity_json" in records["stage_result"].columns:
        found.append(stage_result_check(records["stage_result"]))
    nothing = finding(next(iter(records.values())).limit(0), "graph_id", 0, code)
    return union(*found) if found else nothing


#: Members of a stage result's preimage: always, and with or without a process.
_RESULT = ("adapter", "policy", "schema", "snapshot_id", "stage", "status")
_PROCESS = {True: ("executable", "invocation", "outputs"), False: ("diagnostics",)}


def stage_result_check(stage_result: DataFrame) -> DataFrame:
    """Stage results whose preimage is not canonical, has other members or values than its row, or another digest.

    Of ``adapter``, ``policy``, ``schema``, ``snapshot_id``, ``stage`` and ``status`` the columns that are there are
    held against the preimage; ``executed`` tells which members it has besides.
    """
    code = "artifact_graph.identity_mismatch"
    read = json_walk.with_part(stage_result, "identity_json", "_read")
    executed = F.coalesce("executed", F.lit(False)) if "executed" in stage_result.columns else F.array_contains("_read.keys", "executable")

    def members(process: bool) -> Column:
        return F.array(*[F.lit(name) for name in sorted((*_RESULT, *_PROCESS[process]))])

    closed = F.array_sort("_read.keys").eqNullSafe(F.when(executed, members(True)).otherwise(members(False)))
    named = [name for name in _RESULT if name in stage_result.columns]
    other = reduce(Column.__or__, [~F.get_json_object("identity_json", f"$.{name}").eqNullSafe(F.col(name)) for name in named], F.lit(False))
    sound = F.coalesce(F.col("_read.canonical") & ~F.col("_read.repeated"), F.lit(False))
    return faults(
        read, "graph_id", 0, F.col("stage"),
        (~sound, code, "stage result preimage"),
        (sound & (~closed | other), code, "stage result fields"),
        (~F.col("digest").eqNullSafe(F.sha2("identity_json", 256)), code, "stage result digest"),
    )


def _true_relations(node: DataFrame, covers: DataFrame) -> DataFrame:
    """Coverage edges (packed ids) with ``_true``, the relation id that follows from the nodes they join, and ``_met``, whether these are there.

    The report's artifact id is not read from its preimage but recomputed from its path and tree, so that a forged
    leaf does not pass upward. A popular report is dealt to tasks by its number of edges. Targets, which bring short texts, are met first.
    """
    identity = "identity struct<report_tree_sha256:string,source_path:string>"
    member = F.from_json("identity_json", identity)["identity"]
    relative = F.regexp_replace("path", r"\Aartifacts/coverage/", "")
    own = F.when(F.col("node_id").isNotNull(), ids.packed(F.col("node_id")))
    artifact = ids.digest_of(ids.coverage_artifact_id(relative, member["report_tree_sha256"]))
    reports = node.filter(F.col("kind").isin(*c.COVERAGE_KINDS)).select(
        "graph_id", own.alias("source"), relative.alias("_report_path"), artifact.alias("_artifact"), F.lit(True).alias("_reported")
    )
    targets = node.filter(F.col("kind").isin("source-file", "symbol")).select(
        "graph_id", "snapshot_id", own.alias("target"), F.when(F.col("kind") == "symbol", member["source_path"]).otherwise(F.col("path")).alias("_source_path"),
        F.lit(True).alias("_aimed"),
    )
    met = counted_join(covers, targets.dropDuplicates(["graph_id", "target"]), ["graph_id", "target"], ["source", "relation_id"], "left")
    met = counted_join(met, reports.dropDuplicates(["graph_id", "source"]), ["graph_id", "source"], ["target", "relation_id"], "left", counted=covers)
    artifact = ids.with_digest(F.lit("coverage-artifact:sha256"), F.col("_artifact"))
    own = ids.relation_id(*[artifact if n is None else F.col(n) for n in ("fragment", "line", None, "_report_path", "snapshot_id", "_source_path", "symbol")])
    return met.select(*covers.columns, own.alias("_true"), (F.col("_reported") & F.col("_aimed")).eqNullSafe(True).alias("_met"))


def _edge_id_with(relation: Column) -> Column:
    return edge_id(F.col("fragment"), F.col("kind"), F.col("line"), relation, F.col("source"), F.col("symbol"), F.col("target"))


def _judged(node: DataFrame, edge: DataFrame) -> DataFrame:
    """:func:`edge_lines` of two versions of the edges, and whether a line's relation id and edge id are forged.

    Version 1 are the edges as they stand, version 2 the same with the true relation ids in their places, and all edge ids as they
    follow from their edges. Most edges are the same in both, and one line. Coverage edges whose ends are absent are in
    version 1 only, and not judged.
    """
    is_relation = F.col("kind").isin(*c.RELATION_EDGES)
    own, packs = F.col("edge_id"), ("source", "target", "relation_id")
    # an id that follows from the edge is not dealt
    key = F.when(~own.eqNullSafe(_edge_id_with(F.col("relation_id"))), ids.packed(own))
    narrow = edge.select("graph_id", "kind", "fragment", "line", "symbol", key.alias("key"), *[F.when(F.col(n).isNotNull(), ids.packed(F.col(n))).alias(n) for n in packs])
    covers = _true_relations(node, narrow.filter(is_relation))
    others = narrow.filter(~F.coalesce(is_relation, F.lit(False))).select("*", ids.unpacked(F.col("relation_id")).alias("_true"), F.lit(True).alias("_met"))
    rows = covers.unionByName(others).withColumns({n: ids.unpacked(F.col(n)) for n in packs})
    rows = rows.withColumn("_own", _edge_id_with(F.col("relation_id"))).withColumn("_same", F.col("relation_id").eqNullSafe(F.col("_true")))
    right = F.when(F.col("_same"), F.col("_own")).otherwise(_edge_id_with(F.col("_true")))
    rows = rows.withColumns({"_right": right, "_follows": F.col("key").isNull(), "edge_id": F.when(F.col("key").isNull(), F.col("_own")).otherwise(ids.unpacked(F.col("key")))})
    sound, met = F.col("_same") & F.col("edge_id").eqNullSafe(F.col("_right")), F.col("_met")
    wrong_relation, wrong_edge = met & ~F.col("_same"), met & ~F.col("_follows") & ~F.col("edge_id").eqNullSafe(F.col("_right"))

    def version(held: int, edge_id: Column, relation: Column, follows: Column, relation_off: Column, edge_off: Column) -> Column:
        return F.struct(
            F.lit(held).alias("held"), edge_id.alias("edge_id"), relation.alias("relation_id"), follows.alias("_follows"),
            relation_off.alias("_relation_off"), edge_off.alias("_edge_off"),
        )

    no = F.lit(False)
    versions = F.array_compact(F.array(
        F.when(met & sound, version(3, F.col("_right"), F.col("_true"), F.lit(True), no, no)),
        F.when(~(met & sound), version(1, F.col("edge_id"), F.col("relation_id"), F.col("_follows"), wrong_relation, wrong_edge)),
        F.when(met & ~sound, version(2, F.col("_right"), F.col("_true"), F.lit(True), no, no)),
    ))
    each = rows.select("graph_id", "kind", "source", "target", "fragment", "line", "symbol", F.explode(versions).alias("_v"))
    flat = each.select("graph_id", "kind", "source", "target", "fragment", "line", "symbol", "_v.*")
    return edge_lines(flat, F.col("_follows"), ["_relation_off", "_edge_off"])


def identity_levels(
    records: Mapping[str, DataFrame], node: DataFrame, edge: DataFrame, snapshot: DataFrame, stored: DataFrame, namespace: str = c.DEFAULT_NAMESPACE
) -> DataFrame:
    """All identities of graphs, bottom up: leaves, relations, nodes and edges, graphs.

    Each level is judged with the recomputed ids of the level below in its preimages, so one forged id is one finding, at
    its own level: an edge id follows from the edge as it stands or with its true relation id, and a graph id covers its records as
    they stand or with their own faults mended. ``stored`` are the claimed graph ids ``(graph_id, content_id)``; edges whose ends are absent
    belong to :func:`edge_endpoint_check`.
    """
    # judged once; both graph ids are told in one pass over the lines, most of which they share
    lines = stored_table(_judged(node, edge), "judged-edges")
    digests = stored_table(graph_digest(node, lines, snapshot, namespace, versions=2), "graph-ids")
    code, own = "artifact_graph.identity_mismatch", _edge_key(_edge_body())
    return union(
        leaf_id_check(records), finding(lines.filter("_relation_off"), "graph_id", 0, "artifact_graph.invalid_relation", own, "relation id"),
        content_id_check(node, None), finding(lines.filter("_edge_off"), "graph_id", 0, code, own, "edge id"),
        graph_id_check(stored, digests.select("graph_id", "content_id"), digests.select("graph_id", F.col("content_id_2").alias("content_id"))),
    )


def artifact_counts(node: DataFrame) -> DataFrame:
    return node.groupBy("graph_id", "kind").agg(F.count(F.lit(1)).cast("string").alias("count"))


def provenance_summary(node: DataFrame) -> DataFrame:
    """Provenance states of a graph and how many nodes carry each."""
    return node.filter(F.col("provenance").isNotNull()).groupBy("graph_id", "provenance").agg(
        F.count(F.lit(1)).alias("carriers")
    )
