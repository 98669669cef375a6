"""Symbol index, tag targets and their match."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import symbols
from ..plans.fixtures import Fixtures, view
from ..sources import symbols_xml
from . import query

view("compound_xml", """
select 'snap' as snapshot_id, p_partkey, '<compounddef id="c' || p_partkey || '" kind="' || case when p_partkey % 17 = 0 then 'dir' else 'class' end || '"><compoundname>' || p_name
  || '</compoundname>' || case when p_partkey % 5 = 0 then '' else '<location file="src/' || p_partkey || '.c" line="' || p_size || '" column="1"/>' end
  || '<sectiondef kind="func"><memberdef id="m' || p_partkey || '" kind="function"><name>f' || p_partkey || '</name>'
  || case when p_partkey % 3 = 0 then '<qualifiedname>ns::f' || p_partkey || '</qualifiedname>' else '' end
  || '<argsstring>(int a)</argsstring><location file="src/' || p_partkey || '.c" line="' || (p_size + 1) || '"/></memberdef></sectiondef></compounddef>' as xml
from part
""")
view("tag_xml", """
select 'snap' as snapshot_id, p_partkey, '<compound kind="class"><name>' || p_name || '</name>' || case when p_partkey % 7 = 0 then '' else '<filename>' || p_partkey || '.html</filename>' end
  || '<member kind="function"><name>f' || p_partkey || '</name><anchorfile>' || p_partkey || '.html</anchorfile>'
  || case when p_partkey % 11 = 0 then '' else '<anchor>a' || p_partkey || '</anchor>' end || '<arglist>(int a)</arglist></member></compound>' as xml
from part
""")
view("entity", """
select 'snap' as snapshot_id, refid, compound_name, member_name, kind, args, source_path from symbol_entity
""")
view("target", """
select 'snap' as snapshot_id, compound_name, member_name, kind, args, html_path, anchor from symbol_target
""")
view("api_file", """
select 'snap' as snapshot_id, 'html/' || p_partkey || '.html' as path from part where p_partkey % 31 <> 0
""")
view("index_ref", """
select 'snap' as snapshot_id, 'p' || p_partkey as refid from part
union all select 'snap', 'p' || p_partkey from part where p_partkey % 97 = 0
""")
view("located", """
select 'snap' as snapshot_id, 'p' || p_partkey as refid, case p_partkey % 6 when 0 then '/snap/src/' || p_partkey || '.c' when 1 then '/usr/include/' || p_partkey || '.h'
  else 'src/' || p_partkey || '.c' end as source_path
from part
""")
view("selected_file", """
select 'snap' as snapshot_id, 'src/' || p_partkey || '.c' as path, case when p_partkey % 9 = 0 then 'symlink' else 'file' end as kind from part
""")


@query("read_symbol_entities", """
select 'snap' as snapshot_id, 'c' || p_partkey as refid, 'class' as kind, p_name as qualified_name, 'src/' || p_partkey || '.c' as source_path,
       cast(p_size as varchar) as line, '1' as "column", p_name as compound_name, cast(null as varchar) as member_name, cast(null as varchar) as args
from part where p_partkey % 17 <> 0 and p_partkey % 5 <> 0
union all
select 'snap', 'm' || p_partkey, 'function', case when p_partkey % 3 = 0 then 'ns::f' else 'f' end || p_partkey, 'src/' || p_partkey || '.c',
       cast(p_size + 1 as varchar), null, p_name, 'f' || p_partkey, '(int a)' from part
""")
def _(v: Fixtures):
    return symbols_xml.read_symbol_entities(symbols_xml.parse_compounds(v.compound_xml))


@query("read_symbol_targets", """
select 'snap' as snapshot_id, p_name as compound_name, 'class' as kind, cast(null as varchar) as member_name, cast(null as varchar) as args,
       'html/' || p_partkey || '.html' as html_path, '' as anchor from part where p_partkey % 7 <> 0
union all select 'snap', p_name, 'function', 'f' || p_partkey, '(int a)', 'html/' || p_partkey || '.html', 'a' || p_partkey from part where p_partkey % 11 <> 0
""")
def _(v: Fixtures):
    return symbols_xml.read_symbol_targets(symbols_xml.parse_tags(v.tag_xml))


@query("symbol_target_match", """
with t as (select compound_name, member_name, kind, regexp_replace(args, ' +', ' ', 'g') as args, count(*) as n, min({'p': html_path, 'a': anchor}) as t
           from target group by compound_name, member_name, kind, regexp_replace(args, ' +', ' ', 'g'))
select e.*, case when t.n = 1 then t.t.p end as html_path, case when t.n = 1 then t.t.a end as anchor,
       case when t.n is null then 'doxygen.target_missing' when t.n > 1 then 'doxygen.ambiguous_target'
            when not exists (select 1 from api_file a where a.path = t.t.p) then 'doxygen.target_missing' else 'mapped' end as outcome
from entity e left join t on t.compound_name = e.compound_name and t.member_name = e.member_name and t.kind = e.kind and t.args = regexp_replace(e.args, ' +', ' ', 'g')
""")
def _(v: Fixtures):
    return symbols.symbol_target_match(v.entity, v.target, v.api_file)


_UNMATCHED = """
with t as (select compound_name, member_name, kind, regexp_replace(args, ' +', ' ', 'g') as args, count(*) as n, min({'p': html_path, 'a': anchor}) as t
           from target group by compound_name, member_name, kind, regexp_replace(args, ' +', ' ', 'g')),
m as (select e.*, case when t.n = 1 then t.t.p end as html_path,
             case when t.n is null then 'doxygen.target_missing' when t.n > 1 then 'doxygen.ambiguous_target'
                  when not exists (select 1 from api_file a where a.path = t.t.p) then 'doxygen.target_missing' else 'mapped' end as outcome
      from entity e left join t on t.compound_name = e.compound_name and t.member_name = e.member_name and t.kind = e.kind and t.args = regexp_replace(e.args, ' +', ' ', 'g'))
select cast(snapshot_id as varchar) as scope_id, 0 as check_rank, outcome as code, coalesce(html_path, refid) as path, cast(null as varchar) as detail from m where outcome <> 'mapped'
"""


@query("symbol_findings", _UNMATCHED)
def _(v: Fixtures):
    return symbols.symbol_findings(symbols.symbol_target_match(v.entity, v.target, v.api_file))


@query("refid_index_diff", """
with s as (select coalesce(i.refid, d.refid) as refid, coalesce(i.n, 0) as i, coalesce(d.n, 0) as d
           from (select refid, count(*) as n from index_ref group by refid) i full join (select refid, count(*) as n from detail_ref group by refid) d on i.refid = d.refid)
select 'snap' as scope_id, 0 as check_rank, code, refid as path, detail from (
  select refid, 'doxygen.refid_target_missing' as code, cast(null as varchar) as detail from s where d = 0
  union all select refid, 'doxygen.unindexed_refid', null from s where i = 0
  union all select refid, 'doxygen.duplicate_refid', 'index' from s where i > 1
  union all select refid, 'doxygen.duplicate_refid', 'detail' from s where d > 1) t
""")
def _(v: Fixtures):
    return symbols.refid_index_diff(v.index_ref, v.detail_ref.withColumn("snapshot_id", F.lit("snap")))


@query("symbol_source_check", """
with e as (select *, regexp_replace(source_path, '^/snap/', '') as p from located)
select 'snap' as scope_id, 0 as check_rank, 'doxygen.source_outside_snapshot' as code, source_path as path, refid as detail from e where starts_with(p, '/')
union all select 'snap', 0, 'doxygen.source_target_missing', p, refid from e
where not starts_with(p, '/') and not exists (select 1 from selected_file f where f.path = e.p and f.kind = 'file')
""")
def _(v: Fixtures):
    return symbols.symbol_source_check(v.located, v.selected_file, "/snap")
