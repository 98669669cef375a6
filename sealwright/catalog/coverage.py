"""Coverage relations and attestations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import contract as c
from ..functions import chunks, ids, ordered
from ..operators import coverage, graph
from ..plans.fixtures import Fixtures, view
from ..session import stored
from ..sources import sidecars
from . import query

MAP_SCHEMA = c.schema_id("coverage-map.v1")
ATTESTATION_SCHEMA = c.schema_id("coverage-attestation.v1")

view("attestation_text", f"""
select scope, '{{"configuration_identity_sha256":"' || sha2(bound_configuration, 256) || '","coverage_data_identity":"d' || scope || '","instrumentation_identity":"i","producer":{{"name":"gcov","version":"'
  || (scope % 4) || '.1"}},"report":{{"entry_point":"index.html","tree_sha256":"' || bound_tree_sha256 || '"}},"schema":"{ATTESTATION_SCHEMA}","snapshot_id":"' || bound_snapshot_id
  || '","test_result_identity":"r","test_selection_identity":"t"}}' as text
from attestation
""")
view("report", """
select c_custkey as scope, 'index.html' as entry_point, sha2(c_name, 256) as tree_sha256, 's' || c_nationkey as snapshot_id, sha2(c_mktsegment, 256) as configuration_sha256
from customer
""")
view("mapped_symbol", """
select 'src/' || p_partkey || '/' || replace(p_name, ' ', '_') || '.c' as source_path, p_name as symbol, 'n' || p_partkey as symbol_node from part where p_partkey % 10 <> 0
union all select 'src/' || p_partkey || '/' || replace(p_name, ' ', '_') || '.c', p_name, 'm' || p_partkey from part where p_partkey % 12 = 0
""")
view("source_text", """
select source as scope, 'src/' || doc_id || '.c' as path, replace(text, '. ', chr(10)) as content from documents
""")


_RELATION_JSON = "cast(to_json({'fragment': null, 'line': line, 'report_path': report_path, 'source_path': source_path, 'symbol': symbol}) as varchar)"


@query("read_relation_sidecars", f"""
select scope, row_number() over (partition by scope order by {_RELATION_JSON}) - 1 as pos, report_path, source_path, cast(null as varchar) as fragment, line, symbol from relation
""")
def _(v: Fixtures):
    record = ids.canonical({"fragment": None, **{n: F.col(n) for n in ("line", "report_path", "source_path", "symbol")}})
    listing = ordered.lines(v.relation.withColumn("_json", record), ["scope"], F.col("_json"), F.col("_json"))
    glue = ['{"relations":[', '],"report":{"entry_point":"index.html","tree_sha256":"%s"},"schema":"%s"}' % ("0" * 64, MAP_SCHEMA)]
    return sidecars.read_relation_sidecars(stored(ordered.ordered_text(listing, ["scope"], glue, chunk_chars=chunks.READ_CHARS), "mapping-chunks", long_rows=True, group=8))


@query("read_attestations", """
select scope, 'index.html' as entry_point, bound_tree_sha256 as tree_sha256, bound_snapshot_id as snapshot_id, sha2(bound_configuration, 256) as configuration_sha256,
       'gcov' as producer_name, (scope % 4) || '.1' as producer_version, 't' as test_selection_identity, 'r' as test_result_identity,
       'i' as instrumentation_identity, 'd' || scope as coverage_data_identity
from attestation
""")
def _(v: Fixtures):
    return sidecars.read_attestations(v.attestation_text)


# attestations with an unknown member, another schema, a digest in capitals, an empty name
view("attestation_wrong", f"""
select scope, case scope % 11 when 1 then replace(text, '"producer":', '"extra":1,"producer":') when 2 then replace(text, '{ATTESTATION_SCHEMA}', 'v0')
         when 3 then replace(text, '"tree_sha256":"', '"tree_sha256":"X') when 4 then replace(text, '"name":"gcov"', '"name":""') when 5 then replace(text, '"test_result_identity":"r"', '"test_result_identity":""') else text end as text
from attestation_text
""")


@query("attestation_audit", """
select cast(scope as varchar) as scope_id, 0 as check_rank, case scope % 11 when 2 then 'coverage.unsupported_attestation_schema' else 'coverage.invalid_sidecar' end as code, cast(null as varchar) as path,
       case scope % 11 when 1 then 'members' when 2 then 'v0' when 3 then 'tree_sha256' when 4 then 'producer' else 'test_result_identity' end as detail
from attestation where scope % 11 between 1 and 5
""")
def _(v: Fixtures):
    return sidecars.attestation_audit(v.attestation_wrong)


# a mapping for each attested scope: sound, cut off, with a member too many, with a relation that has one
view("mapping_text", f"""
select scope, case scope % 7 when 1 then substring(text, 1, length(text) - 1) when 2 then replace(text, '"report":', '"more":[],"report":') when 3 then replace(text, '"line":1,', '"line":1,"new":2,') else text end as text
from (select scope, '{{"relations":[{{"fragment":null,"line":1,"report_path":"r.html","source_path":"s' || scope || '.c","symbol":null}},{{"fragment":null,"line":2,"report_path":"r.html","source_path":"t.c","symbol":null}}],"report":{{"entry_point":"index.html","tree_sha256":"'
             || tree_sha256 || '"}},"schema":"{MAP_SCHEMA}"}}' as text from attestation) m
""")


@query("mapping_audit", """
select cast(scope as varchar) as scope_id, 0 as check_rank, case scope % 7 when 3 then 'coverage.invalid_relation' else 'coverage.invalid_sidecar' end as code,
       case scope % 7 when 3 then 'r.html' end as path, case scope % 7 when 1 then 'json' when 2 then 'members' else '0' end as detail
from attestation where scope % 7 between 1 and 3
""")
def _(v: Fixtures):
    return sidecars.mapping_audit(v.mapping_text)


@query("read_report_bindings", "select scope, case when scope % 7 <> 1 then 'index.html' end as entry_point, case when scope % 7 <> 1 then tree_sha256 end as tree_sha256 from attestation")
def _(v: Fixtures):
    return sidecars.read_report_bindings(v.mapping_text)


@query("relation_report_check", """
select cast(r.scope as varchar) as scope_id, 0 as check_rank, 'coverage.report_target_missing' as code, r.report_path as path, r.source_path as detail
from relation r where not exists (select 1 from coverage_artifact a where a.scope = r.scope and a.path = r.report_path)
""")
def _(v: Fixtures):
    return coverage.relation_report_check(v.relation, v.coverage_artifact)


@query("relation_source_check", """
with n as (select basename, count(*) as n from relation_source group by basename)
select cast(r.scope as varchar) as scope_id, 0 as check_rank, case when n.n > 1 then 'coverage.ambiguous_source' else 'coverage.source_missing' end as code,
       r.source_path as path, r.report_path as detail
from relation r left join n on n.basename = r.source_path where not exists (select 1 from relation_source s where s.path = r.source_path)
""")
def _(v: Fixtures):
    return coverage.relation_source_check(v.relation, v.relation_source)


@query("relation_line_check", """
select cast(r.scope as varchar) as scope_id, 0 as check_rank, case when r.line < 1 then 'coverage.invalid_sidecar' else 'coverage.source_line_missing' end as code,
       r.source_path as path, r.line || '/' || s.line_count as detail
from relation r join relation_source s on s.path = r.source_path where r.line < 1 or r.line > s.line_count
""")
def _(v: Fixtures):
    return coverage.relation_line_check(v.relation, v.relation_source)


@query("source_line_count", """
select scope, path, len(string_split(content, chr(10))) - case when content = '' or ends_with(content, chr(10)) then 1 else 0 end as lines from source_text
""")
def _(v: Fixtures):
    return v.source_text.select("scope", "path", coverage.line_count(F.col("content")).cast("long").alias("lines"))


@query("report_binding_check", """
select cast(a.scope as varchar) as scope_id, 0 as check_rank, 'coverage.mapping_report_mismatch' as code, 'index.html' as path, bound_tree_sha256 as detail
from attestation a where bound_tree_sha256 <> tree_sha256
""")
def _(v: Fixtures):
    binding = v.attestation.select("scope", F.lit("index.html").alias("entry_point"), F.col("bound_tree_sha256").alias("tree_sha256"))
    return coverage.report_binding_check(binding, v.report)


@query("attestation_match", """
select r.scope, r.entry_point, r.tree_sha256, r.snapshot_id, r.configuration_sha256,
       case when a.scope is not null and a.bound_tree_sha256 = r.tree_sha256 and a.bound_snapshot_id = r.snapshot_id
              and sha2(a.bound_configuration, 256) = r.configuration_sha256 then 'externally-attested' else 'unknown-origin' end as provenance,
       case when a.scope is null then '' else concat_ws(',', case when a.bound_tree_sha256 <> r.tree_sha256 then 'coverage.attestation_report_mismatch' end,
         case when a.bound_snapshot_id <> r.snapshot_id then 'coverage.attestation_snapshot_mismatch' end,
         case when sha2(a.bound_configuration, 256) <> r.configuration_sha256 then 'coverage.attestation_configuration_mismatch' end) end as diagnostics
from report r left join attestation a on a.scope = r.scope
""")
def _(v: Fixtures):
    return coverage.attestation_match(v.report, sidecars.read_attestations(v.attestation_text))


@query("coverage_symbol_resolution", """
with m as (select source_path, symbol, count(*) as n, min(symbol_node) as symbol_node from mapped_symbol group by source_path, symbol)
select r.scope, r.report_path, r.source_path, r.line, r.symbol, case when m.n = 1 then m.symbol_node end as symbol_node,
       case when m.n is null then 'file-level' when m.n = 1 then 'covers-symbol' else 'artifact_graph.ambiguous_relation' end as outcome
from relation r left join m on m.source_path = r.source_path and m.symbol = r.symbol where r.symbol is not null
""")
def _(v: Fixtures):
    # one snapshot serves all scopes here, so both sides share a constant one
    relation = v.relation.withColumn("snapshot", F.lit("s"))
    symbol = v.mapped_symbol.withColumn("snapshot", F.lit("s"))
    return graph.coverage_symbol_resolution(relation, symbol, "snapshot").drop("snapshot")
