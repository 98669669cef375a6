"""Artifact graphs: one per region, from record tables over the star schema.

``node_record`` and ``edge_record`` spell out every id by text concatenation and
are the SQL side of the assembly; seeded changes to them feed the audits.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import contract as c
from ..functions import ids
from ..operators import graph, navigation
from ..plans.fixtures import DERIVED, VIEWS, Fixtures, view
from ..session import settled, stored
from . import query

TREE_SCHEMA = c.schema_id("coverage-report-tree.v1")
GRAPH_SCHEMA = c.schema_id("artifact-graph.v1")

# --- record tables ----------------------------------------------------------
# Five graphs.  Keys decide the graph of a record, so most tables are one scan.
def _snapshot_of(key: str) -> str:
    return f"cast({key} % 5 as int) as graph_id, 'snapshot:sha256:' || sha2('g' || ({key} % 5), 256) as snapshot_id"


def _stage_of(key: str) -> str:
    return (
        f"case {key} - {key} % 5 when 0 then 'doxygen' when 5 then 'coverage' else 'stage-' || ({key} - {key} % 5) end as stage"
    )


view("g_snapshot", f"select {_snapshot_of('r_regionkey')} from region")
view("g_file", f"""
select {_snapshot_of('p_partkey')}, 'src/' || p_partkey || '.c' as path, case when p_partkey % 40 = 0 then 'symlink' else 'file' end as kind,
       sha2(p_name || p_partkey, 256) as sha256
from part
""")
view("g_stage", f"""
select {_snapshot_of('n_nationkey')}, {_stage_of('n_nationkey')}, sha2(n_name, 256) as digest, n_nationkey < 15 as executed, n_nationkey,
       case n_nationkey - n_nationkey % 5 when 0 then 'succeeded' when 5 then 'succeeded' when 10 then 'failed' when 15 then 'blocked' else 'skipped' end as status
from nation
""")
view("g_output", f"""
select {_snapshot_of('s_nationkey')}, {_stage_of('s_nationkey')}, 'artifacts/stage-outputs/s' || s_suppkey || '.json' as path,
       'json' as kind, sha2(s_name, 256) as sha256, cast(s_suppkey as string) as size
from supplier
""")
view("g_api", f"""
select distinct {_snapshot_of('p_partkey')}, 'html/' || (p_partkey - p_partkey % 20) || '_' || (p_partkey % 5) || '.html' as path,
       'api-page' as kind, sha2('html' || (p_partkey - p_partkey % 20), 256) as sha256
from part
union all
select {_snapshot_of('p_partkey')}, 'xml/' || p_partkey || '.xml', 'producer-machine-output', sha2('x' || p_partkey, 256) from part
""")
view("g_symbol", f"""
select {_snapshot_of('p_partkey')}, 'ref' || p_partkey as refid, p_type as entity_kind, 'sym' || p_partkey as qualified_name,
       'src/' || p_partkey || '.c' as source_path, case when p_partkey % 3 = 0 then null else cast(p_size as string) end as line,
       cast(null as string) as decl_column, 'html/' || (p_partkey - p_partkey % 20) || '_' || (p_partkey % 5) || '.html' as html_path,
       'a' || p_partkey as html_anchor
from part
""")
view("g_coverage", f"""
select {_snapshot_of('o_orderkey')}, 'r/' || o_orderkey || case when o_orderkey % 3 = 0 then '.json' else '.html' end as path,
       sha2('o' || o_orderkey, 256) as sha256, false as entry_point, 'r/index.html' as report_entry_point,
       sha2('t' || (o_orderkey % 5), 256) as tree_sha256, 'unknown-origin' as provenance
from orders
union all
select {_snapshot_of('r_regionkey')}, 'r/index.html', sha2(r_name, 256), true, 'r/index.html', sha2('t' || (r_regionkey % 5), 256), 'unknown-origin'
from region
""")
view("g_relation", f"""
select {_snapshot_of('l_orderkey')}, 'r/' || l_orderkey || case when l_orderkey % 3 = 0 then '.json' else '.html' end as report_path,
       'src/' || l_partkey || '.c' as source_path, case when l_linenumber = 2 then 'L' || l_linenumber end as fragment,
       case when l_linenumber = 1 then null else cast(l_quantity as int) end as line,
       case when l_returnflag = 'R' then 'sym' || l_partkey end as symbol
from lineitem
""")
view("g_sidecar", """
select graph_id, snapshot_id, 'mapping' as kind, 'in/map.json' as path, sha2('m' || graph_id, 256) as sha256, '120' as size from g_snapshot
union all select graph_id, snapshot_id, 'attestation', 'in/att.json', sha2('a' || graph_id, 256), '340' from g_snapshot
""")
view("g_log", f"""
select {_snapshot_of('c_nationkey')}, {_stage_of('c_nationkey')}, 'c' || c_custkey || '.log' as path, sha2(c_name, 256) as sha256,
       cast(c_custkey as string) as size
from customer
""")


# --- the same graph in SQL --------------------------------------------------
def _q(expr: str) -> str:
    """SQL for a JSON string of an expression that needs no escapes; null stays null."""
    return f"coalesce('\"' || {expr} || '\"', 'null')"


def _n(expr: str) -> str:
    return f"coalesce(cast({expr} as string), 'null')"


def _obj(members: dict[str, str]) -> str:
    parts = [f"'\"{key}\":' || {value}" for key, value in sorted(members.items())]
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


def _node_sql(table: str, kind: str, identity: dict[str, str], label: str, where: str = "", **fields: str) -> str:
    columns = ", ".join(f"cast({fields.get(name, 'null')} as string) as {name}" for name in graph._OPTIONAL)
    text = f"'{{\"identity\":' || {_obj(identity)} || ',\"kind\":\"{kind}\"}}'"
    return (
        f"select graph_id, snapshot_id, '{kind}' as kind, {label} as label, {columns}, {text} as identity_json "
        f"from {table} {where}"
    )


SNAP = _q("snapshot_id")
ARTIFACT = "'artifact:sha256:' || sha2('{\"kind\":\"doxygen-payload\",\"path\":\"' || path || '\",\"sha256\":\"' || sha256 || '\"}', 256)"
COVERAGE_ARTIFACT = "'coverage-artifact:sha256:' || sha2('{\"path\":\"' || path || '\",\"report_tree_sha256\":\"' || tree_sha256 || '\"}', 256)"
SIDECAR = "'coverage-sidecar:sha256:' || sha2('{\"kind\":\"' || kind || '\",\"path\":\"' || path || '\",\"sha256\":\"' || sha256 || '\"}', 256)"
ADAPTER = "'\"builtin.doxygen.v1\"'"
VERIFIED = "'\"verified-current-snapshot\"'"


def _api_identity(extra: dict[str, str]) -> dict[str, str]:
    return {
        "adapter": ADAPTER, "artifact_id": _q(ARTIFACT), "path": _q("'artifacts/api/' || path"),
        "provenance": VERIFIED, "sha256": _q("sha256"), "snapshot_id": SNAP, **extra,
    }


def _coverage_sql(kind: str, where: str) -> str:
    return _node_sql(
        "g_coverage", kind,
        {
            "adapter_schema": f"'\"{TREE_SCHEMA}\"'", "artifact_id": _q(COVERAGE_ARTIFACT), "entry_point": _n("entry_point"),
            "path": _q("'artifacts/coverage/' || path"), "provenance": _q("provenance"),
            "report_entry_point": _q("report_entry_point"), "report_tree_sha256": _q("tree_sha256"),
            "sha256": _q("sha256"), "snapshot_id": SNAP,
        },
        "path", where, path="'artifacts/coverage/' || path", sha256="sha256", provenance="provenance",
    )


view("g_symbol_bound", f"""
select m.*, {ARTIFACT.replace('path', 'a.path').replace('a.path":', 'path":').replace("|| sha256", "|| a.sha256")} as html_artifact_id
from g_symbol m join g_api a on a.graph_id = m.graph_id and a.path = m.html_path
join g_file f on f.graph_id = m.graph_id and f.path = m.source_path and f.kind = 'file'
""")
view("g_log_bound", """
select l.*, st.stage_node_id from g_log l join (
  select graph_id, stage, 'stage-result:sha256:' || sha2('{"identity":{"digest":"' || digest || '","snapshot_id":"' || snapshot_id || '","stage":"' || stage
    || '","status":"' || status || '"},"kind":"stage-result"}', 256) as stage_node_id
  from g_stage where executed) st on st.graph_id = l.graph_id and st.stage = l.stage
""")
view("g_output_bound", """
select o.*, st.status from g_output o join g_stage st on st.graph_id = o.graph_id and st.stage = o.stage
""")
view("node_raw", "\nunion all ".join([
    _node_sql("g_snapshot", "snapshot", {"snapshot_id": SNAP}, "snapshot_id"),
    _node_sql("g_file", "source-file", {"path": _q("path"), "sha256": _q("sha256"), "snapshot_id": SNAP}, "path",
              "where kind = 'file'", path="path", sha256="sha256"),
    _node_sql("g_stage", "stage-result", {"digest": _q("digest"), "snapshot_id": SNAP, "stage": _q("stage"), "status": _q("status")},
              "stage", sha256="digest", stage_status="status"),
    _node_sql("g_output_bound", "stage-output",
              {"kind": _q("kind"), "path": _q("path"), "sha256": _q("sha256"), "size": _q("size"), "snapshot_id": SNAP, "stage": _q("stage")},
              "path", path="path", sha256="sha256", stage_status="status"),
    _node_sql("g_api", "api-page", _api_identity({}), "path", "where kind = 'api-page'",
              path="'artifacts/api/' || path", sha256="sha256", provenance="'verified-current-snapshot'"),
    _node_sql("g_api", "api-artifact", _api_identity({"kind": _q("kind")}), "path", "where kind <> 'api-page'",
              path="'artifacts/api/' || path", sha256="sha256", provenance="'verified-current-snapshot'"),
    _node_sql("g_symbol_bound", "symbol",
              {"adapter": ADAPTER, "column": _q("decl_column"), "entity_kind": _q("entity_kind"), "fragment": _q("html_anchor"),
               "html_artifact_id": _q("html_artifact_id"), "label": _q("qualified_name"), "line": _q("line"),
               "path": _q("'artifacts/api/' || html_path"), "refid": _q("refid"), "snapshot_id": SNAP, "source_path": _q("source_path")},
              "qualified_name", path="'artifacts/api/' || html_path", fragment="html_anchor"),
    _coverage_sql("coverage-report", "where entry_point"),
    _coverage_sql("coverage-page", "where not entry_point and path like '%.html'"),
    _coverage_sql("coverage-summary", "where not entry_point and path not like '%.html'"),
    _node_sql("g_sidecar", "coverage-sidecar",
              {"artifact_id": _q(SIDECAR), "kind": _q("kind"), "path": _q("'artifacts/coverage-sidecars/' || kind || '/' || path"),
               "sha256": _q("sha256"), "size": _q("size"), "snapshot_id": SNAP, "source_path": _q("path")},
              "path", path="'artifacts/coverage-sidecars/' || kind || '/' || path", sha256="sha256"),
    _node_sql("g_log_bound", "producer-log",
              {"path": _q("path"), "sha256": _q("sha256"), "size": _q("size"), "snapshot_id": SNAP, "stage": _q("stage"),
               "stage_node_id": _q("stage_node_id")},
              "path", path="'artifacts/logs/' || path", sha256="sha256"),
]))
view("node_record", """
select graph_id, snapshot_id, kind || ':sha256:' || sha2(identity_json, 256) as node_id, kind, label, path, fragment, sha256, provenance, stage_status,
       sha2(identity_json, 256) as identity_sha256, identity_json
from node_raw
""")

_NONE = "cast(null as string) as relation_id, cast(null as string) as fragment, cast(null as int) as line, cast(null as string) as symbol"


def _structural(kind: str, source: str, target: str, tables: str) -> str:
    return f"select {source.split('.')[0]}.graph_id, '{kind}' as kind, {source} as source, {target} as target, {_NONE} from {tables}"


view("relation_bound", f"""
select r.graph_id, c.node_id as report, f.node_id as source_node, r.source_path, r.fragment, r.line, r.symbol,
  'coverage-relation:sha256:' || sha2({_obj({
      "fragment": _q("r.fragment"), "line": _n("r.line"), "report_artifact_id": _q("c.artifact_id"), "report_path": _q("r.report_path"),
      "snapshot_id": _q("r.snapshot_id"), "source_path": _q("r.source_path"), "symbol": _q("r.symbol")})}, 256) as relation_id
from g_relation r
join (select n.graph_id, n.node_id, g.path, {COVERAGE_ARTIFACT.replace("|| path ||", "|| g.path ||").replace("|| tree_sha256", "|| g.tree_sha256")} as artifact_id
      from node_record n join g_coverage g on g.graph_id = n.graph_id and n.path = 'artifacts/coverage/' || g.path) c
  on c.graph_id = r.graph_id and c.path = r.report_path
join node_record f on f.graph_id = r.graph_id and f.kind = 'source-file' and f.path = r.source_path
""")
view("symbol_node", """
select n.graph_id, n.node_id, n.label, s.source_path, n.path
from node_record n join g_symbol_bound s on n.graph_id = s.graph_id and n.kind = 'symbol' and n.fragment = s.html_anchor
""")
view("edge_raw", "\nunion all ".join([
    _structural("describes-snapshot", "n.node_id", "s.node_id",
                "node_record n join node_record s on s.graph_id = n.graph_id and s.kind = 'snapshot' where n.kind not in ('snapshot', 'symbol')"),
    _structural("generated-by-stage", "n.node_id", "st.node_id",
                "node_record n join node_record st on st.graph_id = n.graph_id and st.kind = 'stage-result' and st.label = 'doxygen' where n.kind in ('api-page', 'api-artifact')"),
    _structural("generated-by-stage", "n.node_id", "st.node_id",
                "node_record n join node_record st on st.graph_id = n.graph_id and st.kind = 'stage-result' and st.label = 'coverage' where n.kind in ('coverage-report', 'coverage-page', 'coverage-summary', 'coverage-sidecar')"),
    _structural("generated-by-stage", "n.node_id", "st.node_id",
                "node_record n join g_output o on n.graph_id = o.graph_id and n.kind = 'stage-output' and n.path = o.path "
                "join node_record st on st.graph_id = n.graph_id and st.kind = 'stage-result' and st.label = o.stage"),
    _structural("has-log", "l.stage_node_id", "n.node_id",
                "node_record n join g_log_bound l on n.graph_id = l.graph_id and n.kind = 'producer-log' and n.label = l.path"),
    "select p.graph_id, 'documents-source' as kind, p.page as source, p.file as target, " + _NONE + " from ("
    "select distinct y.graph_id, a.node_id as page, f.node_id as file from symbol_node y join node_record a on a.graph_id = y.graph_id and a.kind = 'api-page' and a.path = y.path "
    "join node_record f on f.graph_id = y.graph_id and f.kind = 'source-file' and f.path = y.source_path) p",
    _structural("documents-symbol", "a.node_id", "y.node_id",
                "symbol_node y join node_record a on a.graph_id = y.graph_id and a.kind = 'api-page' and a.path = y.path"),
    "select graph_id, 'covers-source' as kind, report as source, source_node as target, relation_id, fragment, line, symbol from relation_bound",
    "select r.graph_id, 'covers-symbol' as kind, r.report as source, y.node_id as target, r.relation_id, r.fragment, r.line, r.symbol "
    "from relation_bound r join (select graph_id, source_path, label, min(node_id) as node_id from symbol_node "
    "group by graph_id, source_path, label having count(*) = 1) y on y.graph_id = r.graph_id and y.source_path = r.source_path and y.label = r.symbol",
]))
EDGE_JSON = _obj({
    "fragment": _q("fragment"), "kind": _q("kind"), "line": _n("line"), "relation_id": _q("relation_id"),
    "source": _q("source"), "symbol": _q("symbol"), "target": _q("target"),
})
view("edge_record", f"""
select graph_id, 'edge:sha256:' || sha2({EDGE_JSON}, 256) as edge_id, kind, source, target, relation_id, fragment, line, symbol from edge_raw
""")

# --- seeded changes ---------------------------------------------------------
# by the first digit of the digest: another id, no preimage, another kind,
# another label, lost digest, extra status, wrong prefix, bad provenance
view("node_forged", """
select graph_id, snapshot_id,
       case substring(identity_sha256, 1, 1) when '0' then node_id || '0' else node_id end as node_id,
       case substring(identity_sha256, 1, 1) when '1' then 'source-file' when '2' then 'widget' else kind end as kind,
       case substring(identity_sha256, 1, 1) when '3' then label || '?' else label end as label,
       case substring(identity_sha256, 1, 1) when '4' then 'elsewhere/' || path when '5' then path || '/../x' else path end as path,
       fragment,
       case substring(identity_sha256, 1, 1) when '6' then upper(sha256) when '7' then null else sha256 end as sha256,
       case substring(identity_sha256, 1, 1) when '8' then 'trusted' else provenance end as provenance,
       case substring(identity_sha256, 1, 1) when '9' then 'succeeded' else stage_status end as stage_status,
       case substring(identity_sha256, 1, 1) when 'a' then sha2(identity_sha256, 256) else identity_sha256 end as identity_sha256,
       case substring(identity_sha256, 1, 1) when 'b' then null when 'c' then replace(identity_json, '"snapshot_id"', '"snapshot"') else identity_json end as identity_json
from node_record
""", stored=True)
view("edge_forged", """
select graph_id, case substring(edge_id, 13, 1) when '0' then edge_id || '0' else edge_id end as edge_id,
       case substring(edge_id, 13, 1) when '1' then 'mentions' else kind end as kind, source, target,
       case substring(edge_id, 13, 1) when '2' then 'coverage-relation:sha256:zz' when '3' then null else relation_id end as relation_id,
       case substring(edge_id, 13, 1) when '4' then '' when '5' then 'a' || chr(7) else fragment end as fragment,
       case substring(edge_id, 13, 1) when '6' then 0 else line end as line,
       case substring(edge_id, 13, 1) when '7' then 'é' else symbol end as symbol
from edge_record
""", stored=True)
# plain graph of keys with rendered pages added
view("graph_node_nav", """
select graph_id, kind, node_key, label from graph_node
union all select r_regionkey, 'rendered-navigation-artifact', 'v' || r_regionkey, 'navigation/index.html' from region
""")
view("graph_edge_nav", """
select graph_id, kind, source, target, line from graph_edge
union all select n_regionkey, 'links-to', 'v' || n_regionkey, 'n' || n_nationkey, null from nation
""")
view("g_rendered", "\nunion all ".join(
    f"select graph_id, snapshot_id, 'artifact-graph:sha256:' || sha2(snapshot_id, 256) as base_graph_id, '{page}' as page, "
    f"'navigation/{page}.html' as path, sha2('{page}' || snapshot_id, 256) as sha256, '99' as size from g_snapshot"
    for page in navigation.PAGES
))
# stored producer bytes: every 16th digest differs, every 16th file is absent
view("g_stored", """
select graph_id, path, case when substring(identity_sha256, 1, 1) = '0' then sha2(sha256, 256) else sha256 end as sha256
from node_record where path is not null and substring(identity_sha256, 1, 1) <> '1'
""")


def _records(v: Fixtures) -> dict:
    return {
        "snapshot": v.g_snapshot, "snapshot_file": v.g_file, "stage_result": v.g_stage, "stage_output": v.g_output,
        "api_artifact": v.g_api, "symbol_mapping": v.g_symbol.withColumnRenamed("decl_column", "column"),
        "coverage_artifact": v.g_coverage, "coverage_relation": v.g_relation, "coverage_sidecar": v.g_sidecar, "producer_log": v.g_log,
    }


# In Spark the audits read the assembled graph, which ``graph_assemble`` proves
# equal to the SQL views of these names. It is not stored: a query computes and moves the columns it reads.
DERIVED["node_record"] = lambda v: graph.assemble(_records(v))[0]
DERIVED["edge_record"] = lambda v: graph.assemble(_records(v))[1]


def _forged(v: Fixtures, part: str):
    """View ``node_forged`` or ``edge_forged`` for a query that reads it once: derived, each id once, and not stored."""
    record = {f"{part}_record": settled(getattr(v, f"{part}_record"))}
    return settled(v.spark.sql(VIEWS[f"{part}_forged"].replace(f"from {part}_record", f"from {{{part}_record}}"), **record))


def _keyed(v: Fixtures, nav: bool = False):
    node = (v.graph_node_nav if nav else v.graph_node).withColumnRenamed("node_key", "node_id")
    edge = v.graph_edge_nav if nav else v.graph_edge
    return node, edge.withColumn("edge_id", F.concat_ws(">", "source", "target", F.coalesce(F.col("line"), F.lit(0))))


@query("graph_assemble", """
select graph_id, 'node' as part, kind, node_id as record_id from node_record
union all select graph_id, 'edge', kind, edge_id from edge_record
""")
def _(v: Fixtures):
    node, edge = graph.assemble(_records(v))
    return node.select("graph_id", F.lit("node").alias("part"), "kind", F.col("node_id").alias("record_id")).unionByName(
        edge.select("graph_id", F.lit("edge").alias("part"), "kind", F.col("edge_id").alias("record_id"))
    )


# symbol mappings with pages that are gone, repeated reference ids, and lines that are no canonical numbers
view("g_symbol_wrong", """
select graph_id, snapshot_id, case when p % 33 = 0 then 'twin' else refid end as refid, entity_kind, qualified_name, source_path,
       case when p % 21 = 0 then '0' || line else line end as line, decl_column, case when p % 14 = 0 then 'gone.html' else html_path end as html_path, html_anchor
from (select graph_id, snapshot_id, refid, entity_kind, qualified_name, source_path, line, decl_column, html_path, html_anchor, cast(substring(refid, 4, 12) as int) as p from g_symbol) g
union all
select graph_id, snapshot_id, refid || 'b', entity_kind, qualified_name, source_path, line, decl_column, html_path, html_anchor from g_symbol where refid like '%77'
""")


@query("assembly_findings", """
select cast(graph_id as varchar) as scope_id, 0 as check_rank, 'artifact_graph.' || code as code, path, detail from (
  select graph_id, 'missing_endpoint' as code, refid as path, 'page' as detail from g_symbol_wrong m where not exists (select 1 from g_api a where a.graph_id = m.graph_id and a.path = m.html_path and a.kind = 'api-page')
  union all select graph_id, 'missing_endpoint', refid, 'source' from g_symbol_wrong m where not exists (select 1 from g_file f where f.graph_id = m.graph_id and f.path = m.source_path and f.kind = 'file')
  union all select graph_id, 'duplicate_node_id', min(refid), 'reference id' from g_symbol_wrong group by graph_id, refid having count(*) > 1
  union all select graph_id, 'duplicate_node_id', min(refid), 'target' from g_symbol_wrong group by graph_id, source_path, qualified_name, html_path, html_anchor having count(*) > 1
  union all select graph_id, 'invalid_identity', refid, 'line' from g_symbol_wrong where line is not null and not regexp_matches(line, '^[1-9][0-9]*$')
  union all select r.graph_id, 'ambiguous_relation', r.report_path, 'symbol' from g_relation r
    where exists (select 1 from g_symbol_wrong s where s.graph_id = r.graph_id and s.source_path = r.source_path and s.qualified_name = r.symbol group by s.graph_id having count(*) > 1)
  union all select graph_id, 'missing_endpoint', report_path, 'report' from g_relation r where not exists (select 1 from g_coverage k where k.graph_id = r.graph_id and k.path = r.report_path)
  union all select graph_id, 'missing_endpoint', source_path, 'source' from g_relation r where not exists (select 1 from g_file f where f.graph_id = r.graph_id and f.path = r.source_path and f.kind = 'file')
  union all select graph_id, 'missing_endpoint', path, 'output' from g_output o where not exists (select 1 from g_stage k where k.graph_id = o.graph_id and k.stage = o.stage)
  union all select graph_id, 'missing_endpoint', path, 'log' from g_log o where not exists (select 1 from g_stage k where k.graph_id = o.graph_id and k.stage = o.stage)
  union all select graph_id, 'stage_output_mismatch', path, 'log' from g_log o where exists (select 1 from g_stage k where k.graph_id = o.graph_id and k.stage = o.stage and not k.executed)) t
""")
def _(v: Fixtures):
    return graph.assembly_findings(_records(v) | {"symbol_mapping": v.g_symbol_wrong.withColumnRenamed("decl_column", "column")})


@query("node_ids", "select graph_id, node_id, kind, label, path, fragment, sha256, provenance, stage_status, identity_sha256, identity_json from node_record")
def _(v: Fixtures):
    return graph.assemble(_records(v))[0].drop("snapshot_id")


@query("edge_ids", f"""
select graph_id, kind, source, target, line, 'edge:sha256:' || sha2({EDGE_JSON}, 256) as edge_id
from (select graph_id, kind, source, target, line, cast(null as string) as fragment, cast(null as string) as relation_id, cast(null as string) as symbol from graph_edge) e
""")
def _(v: Fixtures):
    return graph.with_edge_ids(v.graph_edge).select("graph_id", "kind", "source", "target", "line", "edge_id")


@query("artifact_ids", f"""
select bundle_id, path, {ARTIFACT} as artifact_id, {COVERAGE_ARTIFACT} as coverage_artifact_id, {SIDECAR} as sidecar_id
from (select bundle_id, path, sha256, 'mapping' as kind, sha2(bundle_id, 256) as tree_sha256 from payload) p
""")
def _(v: Fixtures):
    return graph.artifact_ids(v.payload, ids.sha256(F.col("bundle_id")))


@query("content_id_check", f"""
select cast(graph_id as varchar) as scope_id, 0 as check_rank, 'artifact_graph.identity_mismatch' as code, node_id as path, detail from (
  select graph_id, node_id, 'no preimage' as detail from node_forged where identity_json is null
  union all select graph_id, node_id, 'kind' from node_forged where json_extract_string(identity_json, '$.kind') <> kind
  union all select graph_id, node_id, 'scope' from node_forged where identity_json is not null and json_extract_string(identity_json, '$.identity.snapshot_id') is distinct from snapshot_id
  union all select graph_id, node_id, 'digest' from node_forged where sha2(identity_json, 256) <> identity_sha256
  union all select graph_id, node_id, 'node id' from node_forged where kind || ':sha256:' || sha2(identity_json, 256) <> node_id) t
union all
select cast(graph_id as varchar), 0, 'artifact_graph.identity_mismatch', edge_id, 'edge id' from edge_forged where edge_id <> 'edge:sha256:' || sha2({EDGE_JSON.replace("|| fragment ||", "|| replace(fragment, chr(7), '\\u0007') ||")}, 256)
""")
def _(v: Fixtures):
    return graph.content_id_check(_forged(v, "node"), _forged(v, "edge"))


# claims at every level, each forged by a digit of a digest: ids of leaves, stage results, relations and edges
def _claimed(expr: str, prefix: str) -> str:
    return f"case substring(sha256, 1, 1) when '0' then '{prefix}:sha256:' || sha256 else {expr} end as artifact_id"


view("api_claimed", f"select a.*, {_claimed(ARTIFACT, 'artifact')} from g_api a")
view("coverage_claimed", f"select a.*, {_claimed(COVERAGE_ARTIFACT, 'coverage-artifact')} from g_coverage a")
view("sidecar_claimed", f"""
select graph_id, snapshot_id, kind, path, sha256, content, case when graph_id = 1 then '999' else cast(octet_length(content) as string) end as size,
       case when graph_id = 2 and kind = 'mapping' then 'coverage-sidecar:sha256:' || sha256 else {SIDECAR} end as artifact_id
from (select graph_id, snapshot_id, kind, path, case when kind = 'mapping' then 'm' else 'a' end || graph_id as content,
             case when graph_id = 3 then sha2('other', 256) else sha256 end as sha256 from g_sidecar) s
""")
_RESULT_JSON = """'{"adapter":"a",' || case when executed then '' else '"diagnostics":[],' end || case when executed then '"executable":{"name":"x"},"invocation":{},"outputs":[],' else '' end
  || '"policy":"required","schema":"s","snapshot_id":"' || snapshot_id || '","stage":"' || stage || '","status":"' || status || '"}'"""
view("stage_claimed", f"""
select graph_id, snapshot_id, stage, status, executed, n_nationkey, case when n_nationkey = 7 then sha2(identity_json, 256) || '0' else sha2(identity_json, 256) end as digest, identity_json
from (select graph_id, snapshot_id, stage, case when n_nationkey = 11 then 'degraded' else status end as status, executed, n_nationkey,
             case n_nationkey when 3 then replace(text, ',', ', ') when 4 then replace(text, '"schema":', '"scheme":') when 5 then '{{' else text end as identity_json
      from (select a.*, {_RESULT_JSON} as text from g_stage a) t) u
""")
view("edge_claim", f"""
select graph_id, d, case d when '2' then edge_id || '0' when '1' then 'edge:sha256:' || sha2({EDGE_JSON}, 256) else edge_id end as edge_id, kind, source, target, relation_id, fragment, line, symbol
from (select graph_id, edge_id, substring(edge_id, 13, 1) as d, kind, source, target,
             case when relation_id is not null and substring(edge_id, 13, 1) in ('0', '1') then 'coverage-relation:sha256:' || sha2(relation_id, 256) else relation_id end as relation_id,
             fragment, line, symbol from edge_record) e
""")
view("edge_claimed", "select graph_id, edge_id, kind, source, target, relation_id, fragment, line, symbol from edge_claim")


def _digest_sql(edges: str) -> str:
    def record(names) -> str:
        return "cast(to_json({" + ", ".join(f"'{name}': {name}" for name in sorted(names)) + "}) as varchar)"

    return f"""
select s.graph_id, 'artifact-graph:sha256:' || sha256('{{"edges":[' || coalesce(e.text, '') || '],"nodes":[' || n.text
       || '],"schema":"{GRAPH_SCHEMA}","snapshot_id":"' || s.snapshot_id || '"}}') as content_id
from g_snapshot s
join (select graph_id, string_agg({record(graph.NODE_COLUMNS)}, ',' order by node_id, {record(graph.NODE_COLUMNS)}) as text from node_record group by graph_id) n on n.graph_id = s.graph_id
left join (select graph_id, string_agg({record(graph.EDGE_COLUMNS)}, ',' order by edge_id, {record(graph.EDGE_COLUMNS)}) as text from {edges} group by graph_id) e on e.graph_id = s.graph_id"""


_LEVEL_ROW = "select cast(graph_id as varchar) as scope_id, 0 as check_rank, 'artifact_graph.identity_mismatch' as code"


@query("content_id_levels", f"""
{_LEVEL_ROW}, path, 'artifact id' as detail from g_api where substring(sha256, 1, 1) = '0'
union all {_LEVEL_ROW}, path, 'coverage artifact id' from g_coverage where substring(sha256, 1, 1) = '0'
union all {_LEVEL_ROW}, path, 'sidecar id' from g_sidecar where graph_id = 2 and kind = 'mapping'
union all {_LEVEL_ROW}, path, 'sidecar bytes' from g_sidecar where graph_id in (1, 3)
union all {_LEVEL_ROW}, stage, 'stage result preimage' from g_stage where n_nationkey in (3, 5)
union all {_LEVEL_ROW}, stage, 'stage result fields' from g_stage where n_nationkey in (4, 11)
union all {_LEVEL_ROW}, stage, 'stage result digest' from g_stage where n_nationkey = 7
union all {_LEVEL_ROW.replace('identity_mismatch', 'invalid_relation')}, edge_id, 'relation id' from edge_claim where relation_id is not null and d in ('0', '1')
union all {_LEVEL_ROW}, edge_id || '0', 'edge id' from edge_record where substring(edge_id, 13, 1) = '2'
union all select cast(f.graph_id as varchar), 0, 'artifact_graph.identity_mismatch', t.content_id || '0', f.content_id
  from ({_digest_sql("edge_claimed")}) f join ({_digest_sql("edge_record")}) t on t.graph_id = f.graph_id where f.graph_id = 3
""")
def _(v: Fixtures):
    records = {"api_artifact": v.api_claimed, "coverage_artifact": v.coverage_claimed, "coverage_sidecar": v.sidecar_claimed, "stage_result": v.stage_claimed}
    node = stored(v.node_record, "nodes")
    # edges are derived once and stored narrow: the claimed ids of graphs and the forged edges are both made from them
    lines = stored(graph.edge_lines(v.edge_record.drop("edge_id")), "edges")
    claimed = stored(graph.graph_digest(node, lines, v.g_snapshot), "claimed-ids")
    claimed = claimed.withColumn("content_id", F.when(F.col("graph_id") == 3, F.concat("content_id", F.lit("0"))).otherwise(F.col("content_id")))
    sql = VIEWS["edge_claim"].replace("{", "{{").replace("}", "}}").replace("from edge_record", "from {edges}")
    forged = v.spark.sql(sql, edges=settled(graph.edges_of(lines)))
    return graph.identity_levels(records, node, settled(forged.drop("d")), v.g_snapshot, claimed)


def _kinds(values) -> str:
    return "(" + ", ".join(f"'{value}'" for value in values) + ")"


def _rule_sql() -> str:
    """The node rule table as rows, for the SQL side."""
    rows = []
    for kind, rule in c.NODE_RULES.items():
        flags = ", ".join("true" if name in rule["fields"] else "false" for name in graph._OPTIONAL)
        keys = "[" + ", ".join(f"'{key}'" for key in rule["identity"]) + "]"
        prefix = "null" if rule["prefix"] is None else f"'{rule['prefix']}'"
        rows.append(f"('{kind}', {flags}, {prefix}, {keys})")
    return "(values " + ", ".join(rows) + ") r(kind, " + ", ".join(f"has_{name}" for name in graph._OPTIONAL) + ", prefix, members)"


@query("node_field_audit", f"""
with n as (
  select n.*, r.kind is not null as known, r.has_path, r.has_fragment, r.has_sha256, r.has_provenance, r.has_stage_status, r.prefix, r.members,
         substring(path, length(coalesce(r.prefix, '')) + 1) as rel
  from node_forged n left join {_rule_sql()} on r.kind = n.kind),
f as (
  select graph_id, node_id, 'artifact_graph.invalid_node_kind' as code, kind as detail from n where not known
  union all select graph_id, node_id, 'artifact_graph.invalid_digest', null from n
    where known and kind not in ('snapshot', 'symbol') and not coalesce(regexp_matches(sha256, '^[0-9a-f]{{64}}$'), false)
  union all select graph_id, node_id, 'artifact_graph.identity_mismatch', 'fields' from n where known and
    ((path is not null) <> has_path or (fragment is not null) <> has_fragment or (sha256 is not null) <> has_sha256
     or (provenance is not null) <> has_provenance or (stage_status is not null) <> has_stage_status)
  union all select graph_id, node_id, 'artifact_graph.identity_mismatch', 'prefix' from n where known and prefix is not null and not coalesce(starts_with(path, prefix), false)
  union all select graph_id, node_id, 'artifact_graph.invalid_path', path from n where known and has_path
    and (rel is null or rel = '' or starts_with(rel, '/') or contains(rel, chr(92)) or len(list_filter(string_split(rel, '/'), lambda s: s in ('', '.', '..'))) > 0)
  union all select graph_id, node_id, 'artifact_graph.identity_mismatch', 'label' from n where known and case kind
      when 'snapshot' then label <> snapshot_id when 'stage-result' then not regexp_matches(label, '^[a-z0-9]+([._-][a-z0-9]+)*$')
      when 'symbol' then label = '' when 'coverage-sidecar' then regexp_replace(rel, '^[^/]*/', '') is distinct from label
      else rel is distinct from label end
  union all select graph_id, node_id, 'artifact_graph.identity_mismatch', 'provenance' from n
    where provenance not in ('verified-current-snapshot', 'externally-attested', 'unknown-origin')
  union all select graph_id, node_id, 'artifact_graph.identity_mismatch', 'stage_status' from n
    where stage_status not in ('succeeded', 'failed', 'blocked', 'skipped', 'degraded')
  union all select graph_id, node_id, 'artifact_graph.identity_mismatch', 'identity members' from n where known and
    list_sort(json_keys(json_extract(identity_json, '$.identity'))) is distinct from members
  union all select graph_id, node_id, 'artifact_graph.identity_mismatch', 'identity values' from n where known and (
    (list_contains(members, 'sha256') and json_extract_string(identity_json, '$.identity.sha256') is distinct from sha256)
    or (list_contains(members, 'provenance') and json_extract_string(identity_json, '$.identity.provenance') is distinct from provenance)
    or (list_contains(members, 'snapshot_id') and json_extract_string(identity_json, '$.identity.snapshot_id') is distinct from snapshot_id)
    or (list_contains(members, 'path') and json_extract_string(identity_json, '$.identity.path') is distinct from case when kind = 'producer-log' then rel else path end)
    or (kind = 'stage-result' and (json_extract_string(identity_json, '$.identity.digest') is distinct from sha256
        or json_extract_string(identity_json, '$.identity.stage') is distinct from label or json_extract_string(identity_json, '$.identity.status') is distinct from stage_status))
    or (kind = 'symbol' and (json_extract_string(identity_json, '$.identity.label') is distinct from label
        or json_extract_string(identity_json, '$.identity.fragment') is distinct from fragment))))
select cast(graph_id as varchar) as scope_id, 0 as check_rank, code, node_id as path, detail from f
""")
def _(v: Fixtures):
    # one pass: what is read once need not be stored
    return graph.node_field_audit(v.sql(VIEWS["node_forged"]))


@query("edge_field_audit", f"""
with e as (select *, kind in ('covers-source', 'covers-symbol') as covers, kind in {_kinds(c.EDGE_KINDS)} as known from edge_forged)
select cast(graph_id as varchar) as scope_id, 0 as check_rank, code, edge_id as path, detail from (
  select graph_id, edge_id, 'artifact_graph.invalid_edge_kind' as code, kind as detail from e where not known
  union all select graph_id, edge_id, 'artifact_graph.invalid_relation', 'relation_id' from e where covers and not coalesce(regexp_matches(relation_id, '^coverage-relation:sha256:[0-9a-f]{{64}}$'), false)
  union all select graph_id, edge_id, 'artifact_graph.invalid_relation', 'line' from e where covers and line < 1
  union all select graph_id, edge_id, 'artifact_graph.invalid_identity', 'fragment' from e where covers and (fragment = '' or contains(fragment, chr(7)))
  union all select graph_id, edge_id, 'artifact_graph.invalid_identity', 'symbol' from e where covers and nfc_normalize(symbol) <> symbol
  union all select graph_id, edge_id, 'artifact_graph.invalid_relation', 'structural' from e
    where known and not covers and (relation_id is not null or fragment is not null or line is not null or symbol is not null)) t
""")
def _(v: Fixtures):
    return graph.edge_field_audit(_forged(v, "edge"))


@query("edge_endpoint_check", """
select cast(e.graph_id as varchar) as scope_id, 0 as check_rank, 'artifact_graph.missing_endpoint' as code,
       e.source || '>' || e.target || '>' || coalesce(e.line, 0) as path, side as detail
from (select *, 'source' as side, source as node_key from graph_edge union all select *, 'target', target from graph_edge) e
where not exists (select 1 from graph_node n where n.graph_id = e.graph_id and n.node_key = e.node_key)
""")
def _(v: Fixtures):
    return graph.edge_endpoint_check(*_keyed(v))


_ALLOWED = " or ".join(
    f"(e.kind = '{kind}' and ((side = 'source' and n.kind in {_kinds(rule[0])}) or (side = 'target' and n.kind in {_kinds(rule[1])})))"
    for kind, rule in c.EDGE_ENDPOINTS.items()
)


@query("edge_type_check", f"""
select cast(e.graph_id as varchar) as scope_id, 0 as check_rank, 'artifact_graph.invalid_edge_kind' as code,
       e.source || '>' || e.target || '>' || coalesce(e.line, 0) as path, side as detail
from (select *, 'source' as side, source as node_key from graph_edge union all select *, 'target', target from graph_edge) e
join graph_node n on n.graph_id = e.graph_id and n.node_key = e.node_key
where not ({_ALLOWED})
""")
def _(v: Fixtures):
    return graph.edge_type_check(*_keyed(v))


@query("symbol_endpoint_check", """
with y as (select graph_id, node_id, path, json_extract_string(identity_json, '$.identity.source_path') as source_path,
                  json_extract_string(identity_json, '$.identity.html_artifact_id') as own from node_forged where kind = 'symbol'),
f as (select graph_id, path, count(*) as n from node_forged where kind = 'source-file' group by graph_id, path),
p as (select graph_id, path, count(*) as n, min(json_extract_string(identity_json, '$.identity.artifact_id')) as artifact from node_forged where kind = 'api-page' group by graph_id, path),
j as (select y.*, coalesce(f.n, 0) as files, coalesce(p.n, 0) as pages, p.artifact from y
      left join f on f.graph_id = y.graph_id and f.path = y.source_path left join p on p.graph_id = y.graph_id and p.path = y.path)
select cast(graph_id as varchar) as scope_id, 0 as check_rank, 'artifact_graph.missing_endpoint' as code, node_id as path, files || '|' || pages as detail from j where files <> 1 or pages <> 1
union all select cast(graph_id as varchar), 0, 'artifact_graph.identity_mismatch', node_id, null from j where files = 1 and pages = 1 and own is distinct from artifact
""")
def _(v: Fixtures):
    return graph.symbol_endpoint_check(v.node_forged)


@query("singleton_check", """
with s as (select graph_id, count(*) filter (where kind = 'snapshot') as snapshots,
    count(*) filter (where kind in ('coverage-report', 'coverage-page', 'coverage-summary')) as coverage, count(*) filter (where kind = 'coverage-report') as reports,
    count(distinct case when kind like 'coverage-%' and kind <> 'coverage-sidecar' then json_extract_string(identity_json, '$.identity.report_entry_point') end) as entries,
    count(distinct case when kind like 'coverage-%' and kind <> 'coverage-sidecar' then json_extract_string(identity_json, '$.identity.report_tree_sha256') end) as trees
  from node_forged group by graph_id)
select cast(graph_id as varchar) as scope_id, 0 as check_rank, 'artifact_graph.snapshot_cardinality' as code, cast(null as varchar) as path, cast(snapshots as varchar) as detail from s where snapshots <> 1
union all select cast(graph_id as varchar), 0, 'artifact_graph.identity_mismatch', null, 'report nodes' from s where coverage > 0 and reports <> 1
union all select cast(graph_id as varchar), 0, 'artifact_graph.identity_mismatch', null, 'entry points' from s where coverage > 0 and entries <> 1
union all select cast(graph_id as varchar), 0, 'artifact_graph.identity_mismatch', null, 'trees' from s where coverage > 0 and trees <> 1
""")
def _(v: Fixtures):
    return graph.singleton_check(v.node_forged)


@query("scope_binding_check", """
select cast(f.graph_id as varchar) as scope_id, 0 as check_rank, 'artifact_graph.snapshot_mismatch' as code, cast(f.n_nationkey as varchar) as path,
       case when s.graph_id is null then 'no parent' else 'snapshot_id' end as detail
from (select case when n_nationkey % 11 = 0 then 99 else graph_id end as graph_id, n_nationkey,
             case when n_nationkey % 7 = 0 then 'snapshot:sha256:' || sha2('other', 256) else snapshot_id end as snapshot_id from g_stage) f
left join g_snapshot s on s.graph_id = f.graph_id where s.graph_id is null or s.snapshot_id <> f.snapshot_id
""")
def _(v: Fixtures):
    child = v.sql("""
        select case when n_nationkey % 11 = 0 then 99 else graph_id end as graph_id, n_nationkey,
               case when n_nationkey % 7 = 0 then 'snapshot:sha256:' || sha2('other', 256) else snapshot_id end as snapshot_id from g_stage""")
    return graph.scope_binding_check(child, v.g_snapshot, "graph_id", ["snapshot_id"], "n_nationkey", "artifact_graph.snapshot_mismatch")


@query("base_graph_subset", """
with k as (select graph_id, node_key, kind from graph_node_nav where kind <> 'rendered-navigation-artifact')
select graph_id, 'node' as part, kind, node_key as record_key from k
union all
select e.graph_id, 'edge', e.kind, e.source || '>' || e.target || '>' || coalesce(e.line, 0) from graph_edge_nav e
where exists (select 1 from k where k.graph_id = e.graph_id and k.node_key = e.source) and exists (select 1 from k where k.graph_id = e.graph_id and k.node_key = e.target)
""")
def _(v: Fixtures):
    node, edge = graph.base_graph(*_keyed(v, nav=True))
    return node.select("graph_id", F.lit("node").alias("part"), "kind", F.col("node_id").alias("record_key")).unionByName(
        edge.select("graph_id", F.lit("edge").alias("part"), "kind", F.col("edge_id").alias("record_key"))
    )


def _json(names) -> str:
    return "cast(to_json({" + ", ".join(f"'{name}': {name}" for name in sorted(names)) + "}) as varchar)"


@query("graph_digest", f"""
with e as (select graph_id, string_agg({_json(graph.EDGE_COLUMNS)}, ',' order by edge_id, {_json(graph.EDGE_COLUMNS)}) as text from edge_record group by graph_id),
n as (select graph_id, string_agg({_json(graph.NODE_COLUMNS)}, ',' order by node_id, {_json(graph.NODE_COLUMNS)}) as text from node_record group by graph_id)
select s.graph_id, 'artifact-graph:sha256:' || sha256('{{"edges":[' || coalesce(e.text, '') || '],"nodes":[' || n.text
       || '],"schema":"{GRAPH_SCHEMA}","snapshot_id":"' || s.snapshot_id || '"}}') as content_id
from g_snapshot s join n on n.graph_id = s.graph_id left join e on e.graph_id = s.graph_id
""")
def _(v: Fixtures):
    # ids of edges are made here, once
    return graph.graph_digest(v.node_record, v.edge_record.drop("edge_id"), v.g_snapshot)


@query("artifact_counts", "select graph_id, kind, cast(count(*) as varchar) as count from graph_node group by graph_id, kind")
def _(v: Fixtures):
    return graph.artifact_counts(v.graph_node)


@query("provenance_summary", "select graph_id, provenance, count(*) as carriers from node_record where provenance is not null group by graph_id, provenance")
def _(v: Fixtures):
    return graph.provenance_summary(v.node_record)


@query("producer_digest_check", f"""
select cast(n.graph_id as varchar) as scope_id, 0 as check_rank,
       case when s.sha256 is null then 'navigation.artifact_unavailable' else 'navigation.digest_mismatch' end as code, n.path, s.sha256 as detail
from node_record n left join g_stored s on s.graph_id = n.graph_id and s.path = n.path
where n.kind in {_kinds(c.PRODUCER_KINDS)} and (s.sha256 is null or s.sha256 <> n.sha256)
""")
def _(v: Fixtures):
    return navigation.producer_digest_check(v.node_record, v.g_stored)


def _href(path: str, fragment: str) -> str:
    return (
        f"case when starts_with({path}, 'artifacts/') then '../' || replace(url_encode({path}), '%2F', '/') || "
        f"coalesce('#' || url_encode(nullif({fragment}, '')), '') end"
    )


_SECTION = " ".join(f"when kind in {_kinds(kinds)} then '{name}'" for name, kinds in c.NAVIGATION_SECTIONS)


@query("navigation_index", f"""
with r as (
  select graph_id, 'index' as page, case {_SECTION} end as section, label, case when kind <> 'stage-result' then {_href('path', 'fragment')} end as href, node_id, node_id as k
  from node_record where kind <> 'snapshot'
  union all select graph_id, 'stages', 'stages', label, null, node_id, node_id from node_record where kind = 'stage-result'
  union all select graph_id, 'provenance', 'carriers', label, {_href('path', 'fragment')}, node_id, node_id from node_record where provenance is not null
  union all select e.graph_id, 'index', 'relations', t.label || coalesce(':' || e.line, ''), {_href('s.path', 'e.fragment')}, e.source, e.edge_id
    from edge_record e join node_record s on s.graph_id = e.graph_id and s.node_id = e.source
    join node_record t on t.graph_id = e.graph_id and t.node_id = e.target where e.kind = 'covers-source')
select graph_id, page, section, row_number() over (partition by graph_id, page, section order by k) as ord, label, href, node_id from r
""")
def _(v: Fixtures):
    return navigation.navigation_index(v.node_record, v.edge_record)


@query("navigation_targets", f"""
with p as (
  select graph_id, page, 'rendered-navigation-artifact:sha256:' || sha2('{{"identity":' || {_obj({
      "base_graph_id": _q("base_graph_id"), "path": _q("path"), "sha256": _q("sha256"), "size": _q("size"), "snapshot_id": SNAP})}
      || ',"kind":"rendered-navigation-artifact"}}', 256) as source from g_rendered),
x as (
  select graph_id, node_id, 'index' as page from node_record
  union all select graph_id, node_id, 'stages' from node_record where kind = 'stage-result'
  union all select graph_id, node_id, 'provenance' from node_record where provenance is not null)
select graph_id, source, target, 'edge:sha256:' || sha2({EDGE_JSON}, 256) as edge_id from (
  select x.graph_id, 'links-to' as kind, p.source, x.node_id as target, {_NONE} from x join p on p.graph_id = x.graph_id and p.page = x.page) e
""")
def _(v: Fixtures):
    return navigation.navigation_targets(v.node_record, v.g_rendered).select("graph_id", "source", "target", "edge_id")


@query("rendered_graph", f"""
with p as (
  select graph_id, snapshot_id, page, '{{"identity":' || {_obj({
      "base_graph_id": _q("base_graph_id"), "path": _q("path"), "sha256": _q("sha256"), "size": _q("size"), "snapshot_id": SNAP})}
      || ',"kind":"rendered-navigation-artifact"}}' as json from g_rendered),
n as (select graph_id, page, 'rendered-navigation-artifact:sha256:' || sha2(json, 256) as node_id from p),
x as (
  select graph_id, node_id, 'index' as page from node_record
  union all select graph_id, node_id, 'stages' from node_record where kind = 'stage-result'
  union all select graph_id, node_id, 'provenance' from node_record where provenance is not null)
select graph_id, 'node' as part, 'rendered-navigation-artifact' as kind, node_id as record_id from n
union all
select graph_id, 'edge', kind, 'edge:sha256:' || sha2({EDGE_JSON}, 256) from (
  select x.graph_id, 'links-to' as kind, n.node_id as source, x.node_id as target, {_NONE} from x join n on n.graph_id = x.graph_id and n.page = x.page
  union all select n.graph_id, 'describes-snapshot', n.node_id, s.node_id, {_NONE} from n join node_record s on s.graph_id = n.graph_id and s.kind = 'snapshot') e
""")
def _(v: Fixtures):
    node, edge = navigation.rendered_graph(v.node_record, v.g_rendered)
    return node.select("graph_id", F.lit("node").alias("part"), "kind", F.col("node_id").alias("record_id")).unionByName(
        edge.select("graph_id", F.lit("edge").alias("part"), "kind", F.col("edge_id").alias("record_id"))
    )
