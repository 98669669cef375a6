"""Snapshots: selection, records, comparison, links, identity."""

from __future__ import annotations

from .. import contract as c
from ..operators import snapshots
from ..plans.fixtures import Fixtures, view
from . import query

SNAPSHOT_SCHEMA = c.schema_id("snapshot.v1")

view("snapshot_policy", """
select distinct 'a' as snapshot_id, 'include' as list, lang as root from documents where lang <> 'de'
union all select 'a', 'exclude', lang || '/' || doc_id || '.txt' from documents where doc_id % 50 = 0
union all select distinct 'b', 'exclude', lang from documents where lang = 'fr'
""", stored=True)
view("snapshot_record", """
select source as snapshot_id, lang || '/' || doc_id || '.txt' as path, case when doc_id % 31 = 0 then 'symlink' else 'file' end as kind,
       case when doc_id % 31 = 0 then '120000' when doc_id % 37 = 0 then '120000' when doc_id % 5 = 0 then '100755' else '100644' end as mode,
       case when doc_id % 41 = 0 then '0' else '' end || octet_length(text) as size, sha2(case when doc_id % 43 = 0 then 'x' || text else text end, 256) as sha256,
       case when doc_id % 31 = 0 and doc_id % 2 = 0 then 'x' when doc_id % 47 = 0 then 'y' end as target
from documents
""")
view("snapshot_bytes", """
select source as snapshot_id, lang || '/' || doc_id || '.txt' as path, octet_length(text) as size, sha2(text, 256) as sha256 from documents
""")
# symbolic links of every class
view("link_file", """
select source as snapshot_id, lang || '/' || doc_id || '.txt' as path, case when doc_id % 4 = 0 then 'symlink' else 'file' end as kind,
       case when doc_id % 4 = 0 then case doc_id % 9 when 0 then '/abs' when 1 then '../../up' when 2 then '../x' when 3 then '' when 4 then 'a' || chr(92) || 'b'
            when 5 then './' || doc_id else (doc_id + doc_id % 7) || '.txt' end end as target
from documents
""")
view("snapshot_sized", """
select snapshot_id, path, kind, mode, cast(length(path) as string) as size, sha256, target from snapshot_file
""")
view("snapshot_head", """
select distinct 'a' as snapshot_id, 'git-clean' as kind, 'sha1' as object_format, substring(sha2('ca', 256), 1, 40) as revision, substring(sha2('ta', 256), 1, 40) as tree from region
union all select distinct 'b', 'git-clean', 'sha256', sha2('cb', 256), sha2('tb', 256) from region
""", stored=True)
view("source_profile", """
select c_custkey as snapshot_id, case when c_custkey % 13 = 0 then 'git-dirty' else 'git-clean' end as kind,
       case c_custkey % 3 when 0 then 'sha1' when 1 then 'sha256' else 'md5' end as object_format, substring(sha2(c_name, 256), 1, case when c_custkey % 7 = 0 then 40 else 64 end) as revision,
       case when c_custkey % 2 = 0 then substring(sha2(c_mktsegment, 256), 1, 40) else upper(sha2(c_mktsegment, 256)) end as tree
from customer
""")


@query("snapshot_select", """
select s.snapshot_id, s.path, s.kind, s.mode, s.sha256, s.target from snapshot_file s
where (not exists (select 1 from snapshot_policy p where p.snapshot_id = s.snapshot_id and p.list = 'include')
       or exists (select 1 from snapshot_policy p where p.snapshot_id = s.snapshot_id and p.list = 'include' and (s.path = p.root or starts_with(s.path, p.root || '/'))))
  and not exists (select 1 from snapshot_policy p where p.snapshot_id = s.snapshot_id and p.list = 'exclude' and (s.path = p.root or starts_with(s.path, p.root || '/')))
""")
def _(v: Fixtures):
    return snapshots.snapshot_select(v.snapshot_file, v.snapshot_policy)


@query("snapshot_record_audit", """
with j as (select r.*, b.size as bsize, b.sha256 as bsha from snapshot_record r left join snapshot_bytes b on b.snapshot_id = r.snapshot_id and b.path = r.path)
select snapshot_id as scope_id, 0 as check_rank, 'artifact_graph.identity_mismatch' as code, path, detail from (
  select snapshot_id, path, 'mode' as detail from j where (kind = 'symlink') <> (mode = '120000')
  union all select snapshot_id, path, 'size' from j where size is distinct from cast(bsize as varchar)
  union all select snapshot_id, path, 'digest' from j where sha256 is distinct from bsha
  union all select snapshot_id, path, 'target' from j where (kind = 'symlink') <> (target is not null)) t
""")
def _(v: Fixtures):
    return snapshots.snapshot_record_audit(v.snapshot_record, v.snapshot_bytes)


@query("snapshot_source_audit", """
select cast(snapshot_id as varchar) as scope_id, 0 as check_rank, 'artifact_graph.identity_mismatch' as code, cast(null as varchar) as path, detail from (
  select snapshot_id, 'source' as detail from source_profile where kind <> 'git-clean' or object_format not in ('sha1', 'sha256')
  union all select snapshot_id, 'commit' from source_profile where not regexp_matches(revision, case when object_format = 'sha1' then '^[0-9a-f]{40}$' else '^[0-9a-f]{64}$' end)
  union all select snapshot_id, 'tree' from source_profile where not regexp_matches(tree, case when object_format = 'sha1' then '^[0-9a-f]{40}$' else '^[0-9a-f]{64}$' end)) t
""")
def _(v: Fixtures):
    return snapshots.snapshot_source_audit(v.source_profile.withColumnRenamed("revision", "commit"))


@query("snapshot_diff", """
with a as (select * from snapshot_file where snapshot_id = 'a'), b as (select * from snapshot_file where snapshot_id = 'b'),
j as (select coalesce(a.path, b.path) as path, a.path as ap, b.path as bp, a.mode as am, b.mode as bm, a.kind as ak, b.kind as bk, a.sha256 as asha, b.sha256 as bsha, a.target as atarget, b.target as btarget
      from a full join b on a.path = b.path)
select path, 'added' as change from j where ap is null union all select path, 'removed' from j where bp is null
union all select path, 'mode-changed' from j where am <> bm or ak <> bk
union all select path, 'retargeted' from j where ap is not null and bp is not null and atarget is distinct from btarget
union all select path, 'byte-changed' from j where asha <> bsha
""")
def _(v: Fixtures):
    return snapshots.snapshot_diff(v.snapshot_file.filter("snapshot_id = 'a'"), v.snapshot_file.filter("snapshot_id = 'b'"))


@query("symlink_resolution", """
with l as (select *, cast(regexp_extract(path, '([0-9]+)', 1) as bigint) as n, regexp_replace(path, '/.*', '') as dir from link_file where kind = 'symlink'),
k as (select *, case when n % 9 in (0, 3, 4) then 'snapshot.invalid_symlink' when n % 9 = 1 then 'snapshot.symlink_escape' when n % 9 in (2, 5) then 'snapshot.invalid_symlink' end as code from l)
select snapshot_id as scope_id, 0 as check_rank, code, path, target as detail from k where code is not null
union all select snapshot_id, 0, 'snapshot.invalid_symlink', path, dir || '/' || target from k
where code is null and not exists (select 1 from link_file f where f.snapshot_id = k.snapshot_id and f.path = k.dir || '/' || k.target and f.kind = 'file')
""")
def _(v: Fixtures):
    return snapshots.symlink_resolution(v.link_file)


_FILE_JSON = """
'{"identity":{"sha256":"' || sha256 || '"' || case when kind = 'symlink' then ',"target":"' || target || '"' else '' end || '},"kind":"' || kind || '","mode":"' || mode || '","path":"' || path || '","size":"' || size || '"}'
"""


@query("snapshot_digest", f"""
with f as (select snapshot_id, string_agg({_FILE_JSON}, ',' order by path) as text from snapshot_sized group by snapshot_id),
p as (select snapshot_id, string_agg('"' || root || '"', ',' order by root) filter (where list = 'include') as inc,
             string_agg('"' || root || '"', ',' order by root) filter (where list = 'exclude') as exc from snapshot_policy group by snapshot_id)
select h.snapshot_id, 'snapshot:sha256:' || sha256('{{"identity":{{"files":[' || f.text || '],"policy":{{"exclude":[' || coalesce(p.exc, '') || '],"include":[' || coalesce(p.inc, '')
  || ']}},"schema":"{SNAPSHOT_SCHEMA}","source":{{"commit":"' || h.revision || '","kind":"' || h.kind || '","object_format":"' || h.object_format || '","tree":"' || h.tree || '"}}}},"kind":"snapshot"}}') as content_id
from snapshot_head h join f on f.snapshot_id = h.snapshot_id left join p on p.snapshot_id = h.snapshot_id
""")
def _(v: Fixtures):
    head = v.snapshot_head.withColumnRenamed("revision", "commit")
    return snapshots.snapshot_digest(head, v.snapshot_sized, v.snapshot_policy)
