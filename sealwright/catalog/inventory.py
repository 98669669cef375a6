"""Bundle closure, control texts and identities."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import contract as c
from ..functions import ordered
from ..operators import findings, inventory
from ..plans.fixtures import Fixtures, view
from ..session import shared_folder, stored
from ..sources import manifests, releases, trees
from . import query, stages

MANIFEST_SCHEMA = c.schema_id("bundle-manifest.v1")
TREE_SCHEMA = c.schema_id("coverage-report-tree.v1")

ENTRY_JSON = "cast(to_json({'path': path, 'sha256': sha256, 'size': cast(size as varchar)}) as varchar)"
MANIFEST_TAIL = (
    '],"entry_points":{"index":"%s","run_report":"%s"},"schema":"%s"}'
    % (c.INDEX_PATH, c.RUN_REPORT_PATH, MANIFEST_SCHEMA)
)

# checksum lines: every 41st has an upper-case digest, every 43rd one space only
view("checksum_line", """
select bundle_id, pos, path, sha256,
       case when pos % 41 = 0 then upper(sha256) || '  ' || path
            when pos % 43 = 0 then sha256 || ' ' || path
            else sha256 || '  ' || path end as line
from checksum
""")

# manifest entries with their stored position; every 6th page of entries is swapped
view("manifest_entry", """
select bundle_id, path, sha256, size, case when pos % 6 = 0 then pos + 1 when pos % 6 = 1 and pos > 1 then pos - 1 else pos end as pos,
       case when pos % 50 = 7 then upper(sha256) else sha256 end as stored_sha256,
       case when pos % 50 = 9 then '0' || size else size end as stored_size
from (select bundle_id, path, sha256, size, row_number() over (partition by bundle_id order by path) as pos from manifest) t
""")

view("manifest_numbered", "select bundle_id, path, sha256, size, row_number() over (partition by bundle_id order by path) - 1 as pos from manifest")

# entry points named by each bundle: the index is the least path, the run report is absent for some
view("entry_points", """
select source as bundle_id, min('artifacts/' || lang || '/' || doc_id || '.txt') as index_path,
       max(case when doc_id % 3 = 0 then 'reports/run.json' else 'artifacts/' || lang || '/' || doc_id || '.txt' end) as run_report
from documents group by source
""")

# candidates: identical, new, or known with another report
view("release_candidate", """
select s_suppkey as root,
       case when s_suppkey % 5 = 0 then 'bundle:sha256:' || sha2('new' || s_name, 256) else 'bundle:sha256:' || sha2(s_name, 256) end as bundle_id,
       case when s_suppkey % 7 = 0 then sha2('other' || s_suppkey, 256) else sha2('r' || s_suppkey, 256) end as run_report_sha256
from supplier
""")

# paths that break one rule each, and nested ones that collide
view("path_case", """
select source as bundle_id, case doc_id % 12
         when 0 then '/abs/' || doc_id when 1 then 'a//' || doc_id when 2 then 'a/../' || doc_id when 3 then './' || doc_id
         when 4 then 'a' || chr(92) || doc_id when 5 then 'bell' || chr(7) || doc_id when 6 then 'cafe\u0301/' || doc_id
         when 7 then '' when 8 then 'manifest.json' when 9 then 'caf\u00e9/' || doc_id
         when 10 then 'artifacts/' || lang else 'artifacts/' || lang || '/' || doc_id || '.txt' end as path
from documents
""")

# producer files of the API stage, by extension
view("producer_file", """
select p_brand as bundle_id, case p_partkey % 5 when 0 then 'html/' || p_partkey || '.html' when 1 then 'xml/' || p_partkey || '.xml'
         when 2 then 'out/' || p_partkey || '.tag' when 3 then 'html/' || p_partkey || '.css' else p_partkey || '.html' end as path,
       sha2(p_name, 256) as sha256, p_size as size
from part
""")


@query("scan_payload_tree", "select bundle_id, path, size, sha256 from payload")
def _(v: Fixtures):
    """The given contents written as files to the shared folder, and that tree scanned."""
    root = f"{shared_folder(v.spark)}/trees/{uuid.uuid4().hex}"
    trees.write_tree(v.payload, root)
    return trees.scan_payload_tree(v.spark, root)


def _manifest_text(v: Fixtures):
    rows = v.manifest
    entries = ordered.lines(rows, ["bundle_id"], F.col("path"), inventory.entry_line())
    return stored(ordered.ordered_text(entries, ["bundle_id"], inventory.manifest_glue()), "manifest-chunks")


@query(
    "read_manifests",
    "select bundle_id, row_number() over (partition by bundle_id order by path) - 1 as pos, path, sha256, size from manifest",
)
def _(v: Fixtures):
    return manifests.read_manifests(_manifest_text(v))


@query("read_checksums", r"""
select bundle_id, pos - 1 as pos,
       case when regexp_matches(line, '^[0-9a-f]{64}  .+$') then regexp_extract(line, '^([0-9a-f]{64})  (.+)$', 1) end as sha256,
       case when regexp_matches(line, '^[0-9a-f]{64}  .+$') then regexp_extract(line, '^([0-9a-f]{64})  (.+)$', 2) end as path,
       case when regexp_matches(line, '^[0-9a-f]{64}  .+$') then null else 'checksums.noncanonical' end as code
from checksum_line
""")
def _(v: Fixtures):
    return _read_checksums(v)


_CONTROL_SQL = f"""
with m as (
  select bundle_id, '{{"entries":[' || string_agg({ENTRY_JSON}, ',' order by path) || '{MANIFEST_TAIL}' as text
  from payload group by bundle_id),
lines as (
  select bundle_id, path, sha256 from payload
  union all select bundle_id, 'manifest.json', sha256(text) from m),
k as (select bundle_id, string_agg(sha256 || '  ' || path || chr(10), '' order by path) as text from lines group by bundle_id)
"""


@query("write_manifests", _CONTROL_SQL + """
select bundle_id, 'manifest.json' as name, 0 as chunk, text from m
union all select bundle_id, 'checksums.sha256', 0, text from k
""")
def _(v: Fixtures):
    return inventory.control_texts(v.payload)


@query("bundle_digest", _CONTROL_SQL + """
, d as (select m.bundle_id, sha256(m.text) as manifest_sha256, sha256(k.text) as checksums_sha256 from m join k on m.bundle_id = k.bundle_id)
select bundle_id, manifest_sha256, checksums_sha256,
       'bundle:sha256:' || sha256('{"identity":{"checksums_sha256":"' || checksums_sha256 || '","manifest_sha256":"' || manifest_sha256 || '"},"kind":"bundle"}') as content_id
from d
""")
def _(v: Fixtures):
    return inventory.bundle_digest(v.payload)


@query("tree_digest", f"""
select bundle_id, sha256('{{"entries":[' || string_agg({ENTRY_JSON}, ',' order by path)
       || '],"kind":"coverage-report-tree","schema":"{TREE_SCHEMA}"}}') as tree_sha256
from payload group by bundle_id
""")
def _(v: Fixtures):
    return inventory.tree_digest(v.payload)


@query("path_profile_audit", r"""
select cast(bundle_id as varchar) as scope_id, 10 as check_rank, 'path.invalid' as code, path, rule as detail from (
  select bundle_id, path, 'empty' as rule from path_case where path = ''
  union all select bundle_id, path, 'absolute' from path_case where path <> '' and starts_with(path, '/')
  union all select bundle_id, path, 'backslash' from path_case where contains(path, chr(92))
  union all select bundle_id, path, 'control' from path_case where regexp_matches(path, '\p{Cc}')
  union all select bundle_id, path, 'segment' from path_case where path <> ''
    and len(list_filter(string_split(path, '/'), lambda s: s in ('', '.', '..'))) > 0
  union all select bundle_id, path, 'nfc' from path_case where nfc_normalize(path) <> path) t
union all select bundle_id, 10, 'manifest.reserved_path', path, null from path_case where path in ('manifest.json', 'checksums.sha256')
""")
def _(v: Fixtures):
    from ..operators import records
    from ..operators.findings import union

    return union(records.path_profile_audit(v.path_case, "bundle_id"), records.reserved_path_audit(v.path_case, "bundle_id"))


@query("path_collision_audit", """
with parents as (
  select distinct bundle_id, array_to_string(parts[1:n], '/') as path
  from (select bundle_id, string_split(path, '/') as parts, unnest(range(1, len(string_split(path, '/')))) as n from path_case) t)
select bundle_id as scope_id, 27 as check_rank, 'bundle.path_collision' as code, path, detail from (
  select bundle_id, path, 'duplicate' as detail from path_case group by bundle_id, path having count(*) > 1
  union all select p.bundle_id, p.path, 'directory' from parents p join (select distinct bundle_id, path from path_case) c
    on p.bundle_id = c.bundle_id and p.path = c.path
  union all select bundle_id, path, 'reserved' from parents where path in ('manifest.json', 'checksums.sha256')) t
""")
def _(v: Fixtures):
    return inventory.path_collisions(v.path_case)


@query("classify_artifacts", """
select bundle_id, path, case when starts_with(path, 'html/') and ends_with(path, '.html') then 'api-page'
         when ends_with(path, '.xml') or ends_with(path, '.tag') then 'producer-machine-output' else 'producer-asset' end as kind,
       case when sha256 < '1' then 'coverage-report' when ends_with(path, '.html') then 'coverage-page' else 'coverage-summary' end as coverage_kind
from producer_file
""")
def _(v: Fixtures):
    api = inventory.classify_api(v.producer_file).withColumn("entry_point", F.col("sha256") < "1")
    both = inventory.classify_coverage(api.withColumnRenamed("kind", "api_kind"))
    return both.select("bundle_id", "path", F.col("api_kind").alias("kind"), F.col("kind").alias("coverage_kind"))


CLOSURE_SQL = """
with e as (
  select bundle_id, path from manifest
  union select bundle_id, 'manifest.json' from manifest union select bundle_id, 'checksums.sha256' from manifest),
p as (select distinct bundle_id, path from listing where object_type = 'file')
select coalesce(e.bundle_id, p.bundle_id) as scope_id, case when p.path is null then 40 else 41 end as check_rank,
       case when p.path is null then 'inventory.missing_file' else 'inventory.extra_file' end as code,
       coalesce(e.path, p.path) as path, cast(null as varchar) as detail
from e full join p on e.bundle_id = p.bundle_id and e.path = p.path
where e.path is null or p.path is null
"""
DIRECTORY_SQL = """
with implied as (
  select distinct bundle_id, array_to_string(parts[1:n], '/') as path
  from (select bundle_id, string_split(path, '/') as parts, unnest(range(1, len(string_split(path, '/')))) as n from manifest) t)
select l.bundle_id as scope_id, 42 as check_rank, 'inventory.extra_directory' as code, l.path, cast(null as varchar) as detail
from listing l where object_type = 'directory'
  and not exists (select 1 from implied i where i.bundle_id = l.bundle_id and i.path = l.path)
"""
DIGEST_SQL = """
select bundle_id as scope_id, 50 as check_rank, code, path, detail from (
  select m.bundle_id, m.path, 'payload.size_mismatch' as code, m.size || '/' || p.size as detail
  from manifest m join payload p on m.bundle_id = p.bundle_id and m.path = p.path where m.size <> cast(p.size as varchar)
  union all
  select m.bundle_id, m.path, 'payload.hash_mismatch', p.sha256
  from manifest m join payload p on m.bundle_id = p.bundle_id and m.path = p.path where m.sha256 <> p.sha256) t
"""


@query("inventory_closure", CLOSURE_SQL)
def _(v: Fixtures):
    return inventory.inventory_closure(v.listing, v.manifest)


@query("directory_closure", DIRECTORY_SQL)
def _(v: Fixtures):
    return inventory.directory_closure(v.listing, v.manifest)


@query("payload_digest_check", DIGEST_SQL)
def _(v: Fixtures):
    return inventory.payload_digest_check(v.payload, v.manifest)


@query("entry_point_check", """
select bundle_id as scope_id, 30 as check_rank, 'manifest.invalid_entry_points' as code, path, name as detail from (
  select bundle_id, 'index' as name, index_path as path from entry_points
  union all select bundle_id, 'run_report', run_report from entry_points) p
where not exists (select 1 from manifest m where m.bundle_id = p.bundle_id and m.path = p.path)
""")
def _(v: Fixtures):
    points = v.entry_points.withColumnRenamed("index_path", "index")
    return inventory.entry_point_check(points, v.manifest)


@query("checksums_check", """
with s as (
  select coalesce(c.bundle_id, p.bundle_id) as bundle_id, coalesce(c.path, p.path) as path, c.sha256 as c, p.sha256 as a
  from checksum c full join payload p on c.bundle_id = p.bundle_id and c.path = p.path),
o as (select bundle_id, path, lag(path) over (partition by bundle_id order by pos) as before from checksum)
select bundle_id as scope_id, 60 as check_rank, 'checksums.noncanonical' as code, path,
       case when c is null then 'missing record' when a is null then 'extra record' else 'digest' end as detail
from s where c is null or a is null or c <> a
union all select bundle_id, 60, 'checksums.noncanonical', path, 'order' from o where before > path
""")
def _(v: Fixtures):
    return inventory.checksums_check(v.checksum, v.payload)


@query("order_audit", """
select bundle_id as scope_id, 26 as check_rank, 'manifest.unsorted_entries' as code, path, before as detail
from (select bundle_id, path, lag(path) over (partition by bundle_id order by pos) as before from manifest_entry) t
where before > path
""")
def _(v: Fixtures):
    return inventory.order_audit(v.manifest_entry, "bundle_id")


@query("manifest_entry_audit", """
select bundle_id as scope_id, 25 as check_rank, 'manifest.invalid_entry' as code, path, 'sha256' as detail
from manifest_entry where not regexp_matches(stored_sha256, '^[0-9a-f]{64}$')
union all select bundle_id, 25, 'manifest.invalid_entry', path, 'size'
from manifest_entry where not regexp_matches(stored_size, '^(0|[1-9][0-9]*)$')
""")
def _(v: Fixtures):
    return inventory.manifest_entry_audit(
        v.manifest_entry.select("bundle_id", "path", F.col("stored_sha256").alias("sha256"), F.col("stored_size").alias("size"))
    )


@query("duplicate_ids", """
select cast(scope as varchar) as scope_id, 27 as check_rank, 'coverage.duplicate_relation' as code,
       report_path || '|' || source_path || '|' || coalesce(cast(line as varchar), '') || '|' || coalesce(symbol, '') as path,
       cast(count(*) as varchar) as detail
from relation group by scope, report_path, source_path, line, symbol having count(*) > 1
""")
def _(v: Fixtures):
    keys = ["report_path", "source_path", "line", "symbol"]
    return inventory.duplicate_ids(v.relation, "scope", keys, "coverage.duplicate_relation")


ENTRY_POINT_SQL = """
select bundle_id as scope_id, 30 as check_rank, 'manifest.invalid_entry_points' as code, path, name as detail from (
  select bundle_id, 'index' as name, index_path as path from entry_points
  union all select bundle_id, 'run_report', run_report from entry_points) p
where not exists (select 1 from manifest m where m.bundle_id = p.bundle_id and m.path = p.path)
"""
# control texts hold the manifest too, whose digest no record names
VERIFY_CHECKSUM_SQL = f"""
with m as (select bundle_id, '{{"entries":[' || string_agg({ENTRY_JSON}, ',' order by path) || '{MANIFEST_TAIL}' as text from manifest group by bundle_id),
a as (select bundle_id, path, sha256 from payload union all select bundle_id, 'manifest.json', sha256(text) from m),
s as (
  select coalesce(c.bundle_id, p.bundle_id) as bundle_id, coalesce(c.path, p.path) as path, c.sha256 as c, p.sha256 as a
  from checksum c full join a p on c.bundle_id = p.bundle_id and c.path = p.path),
o as (select bundle_id, path, lag(path) over (partition by bundle_id order by pos) as before from checksum)
select bundle_id as scope_id, 60 as check_rank, 'checksums.noncanonical' as code, path,
       case when c is null then 'missing record' when a is null then 'extra record' else 'digest' end as detail
from s where c is null or a is null or c <> a
union all select bundle_id, 60, 'checksums.noncanonical', path, 'order' from o where before > path
"""
VERIFY_PAGE_SQL = """
select 'talk' as scope_id, 80 as check_rank, 'link.ambiguous_fragment' as code, path, name as detail
from (select 'c' || conv_id || '.html' as path, 't' || turn as name from conversations
      union all select 'c' || conv_id || '.html', role from conversations) a
group by path, name having count(*) > 1
union all
select 'talk', 90, 'link.missing_target', 'c' || (conv_id + 1) || '.html', 'c' || conv_id || '.html' from conversations
"""

FIRST_SQL = f"""
with closure as ({CLOSURE_SQL}), dirs as ({DIRECTORY_SQL}), bytes as ({DIGEST_SQL}),
f as (select * from closure union all select * from dirs union all select * from bytes)
select scope_id, check_rank, code, path, detail from (
  select *, row_number() over (partition by scope_id order by check_rank, path,
    case when code = 'payload.hash_mismatch' then 1 else 0 end, code) as rn from f) t
where rn = 1
"""


def bundle_findings(v: Fixtures):
    return findings.union(
        inventory.inventory_closure(v.listing, v.manifest),
        inventory.directory_closure(v.listing, v.manifest),
        inventory.payload_digest_check(v.payload, v.manifest),
    )


@query("first_finding", FIRST_SQL)
def _(v: Fixtures):
    return findings.first_finding(bundle_findings(v))


def _read_checksums(v: Fixtures):
    rows = ordered.lines(
        v.checksum_line, ["bundle_id"], F.lpad(F.col("pos").cast("string"), 12, "0"), F.concat("line", F.lit("\n"))
    )
    return manifests.read_checksums(stored(ordered.ordered_text(rows, ["bundle_id"], ["", ""], separator=""), "checksum-chunks"))


# the texts of a bundle: seeded faults of a manifest by the bundle's number, with the rank of each
_MANIFEST_FAULTS = (
    (1, '{"entries":', '{"entries":[],"entries":', 0, "manifest.duplicate_member"),
    (2, '{"entries":', '{"entries":,', 1, "manifest.invalid_json"),
    (3, '{"entries":', '{"added":1,"entries":', 3, "manifest.invalid_shape"),
    (4, MANIFEST_SCHEMA, MANIFEST_SCHEMA + "9", 4, "manifest.unsupported_schema"),
    (5, '{"entries":', '{ "entries":', 2, "manifest.noncanonical"),
)
# checksum lines that are well formed, as the view checksum_line seeds the others
view("checksum_kept", "select bundle_id, sha256, path, pos from checksum_line where pos % 41 <> 0 and pos % 43 <> 0")
# a bundle takes the least run of the user with its number
view("bundle_run", """
select d.bundle_id, min(run_id) as run_id
from run_head join (select distinct source as bundle_id from documents) d on d.bundle_id = 'src' || split_part(run_id, '-', 1)
group by d.bundle_id
""")
_KEPT_CHECKSUM_SQL = VERIFY_CHECKSUM_SQL.replace("from checksum", "from checksum_kept")
_MANIFEST_FAULT_SQL = " union all ".join(
    f"select distinct source as scope_id, {inventory.RANK_MANIFEST_TEXT + rank} as check_rank, '{code}' as code, cast(null as varchar) as path, cast(null as varchar) as detail "
    f"from documents where cast(substr(source, 4) as int) % 6 = {n}"
    for n, _old, _new, rank, code in _MANIFEST_FAULTS
)
_REPORT_FAULT_SQL = stages.tamper_sql("b.bundle_id", f"({stages._REPORT_SQL}) r join bundle_run b on b.run_id = r.run_id")


_VERIFY_TEXTS_SQL = f"""
with closure as ({CLOSURE_SQL}), dirs as ({DIRECTORY_SQL}), bytes as ({DIGEST_SQL}), points as ({ENTRY_POINT_SQL}), sums as ({_KEPT_CHECKSUM_SQL}), pages as ({VERIFY_PAGE_SQL}),
texts as ({_MANIFEST_FAULT_SQL}), reports as ({_REPORT_FAULT_SQL})
select * from closure union all select * from dirs union all select * from bytes union all select * from points
union all select * from sums union all select * from pages union all select * from texts union all select * from reports
union all select bundle_id, 60, 'checksums.noncanonical', null, cast(pos - 1 as varchar) from checksum_line where pos % 41 = 0 or pos % 43 = 0
"""


@query("verify_bundles", _VERIFY_TEXTS_SQL)
@query("verify_bundle_texts", _VERIFY_TEXTS_SQL)
def _(v: Fixtures):
    """Whole bundles with all their inputs: texts of manifests, checksum lines as read, run reports, pages."""
    from ..plans import verify

    pages = v.html_talk.select("bundle_id", "path", F.col("html_part").alias("html"))
    numbered = v.manifest_numbered.select("bundle_id", "path", "sha256", "size", "pos")
    points = v.entry_points.withColumnRenamed("index_path", "index")
    text, number = F.col("text"), F.substring("bundle_id", 4, 9).cast("int") % 6
    for n, old, new, _rank, _code in _MANIFEST_FAULTS:
        text = F.when(number == n, F.replace(F.col("text"), F.lit(old), F.lit(new))).otherwise(text)
    # both literals stand once, in the first and in the last chunk
    manifest_text = _manifest_text(v).select("bundle_id", "chunk", text.alias("text"))
    # a bundle holds the report of one run: those of other runs are not made
    runs = stored(v.bundle_run, "bundle-runs")
    whole = stages.whole_reports(v, runs.select("run_id").distinct()).join(runs, "run_id")
    reports = whole.select("bundle_id", stages.tampered(F.col("run_id"), F.col("text")).alias("report"))
    found = verify.verify_bundles(v.payload, numbered, points, _read_checksums(v), v.listing, pages, reports, manifest_text=manifest_text)
    return found.select("scope_id", "check_rank", "code", "path", "detail")


@query("append_new_releases", """
with c as (
  select c.*, case when r.bundle_id is null then 'append' when r.run_report_sha256 = c.run_report_sha256 then 'reuse' else 'publication.release_identity_mismatch' end as outcome
  from release_candidate c left join release r on c.root = r.root and c.bundle_id = r.bundle_id)
select 'first' as step, cast(root as varchar) as root, bundle_id, run_report_sha256, outcome from c
union all
select 'again', cast(root as varchar), bundle_id, run_report_sha256, case outcome when 'append' then 'reuse' else outcome end from c
union all
select 'table', cast(root as varchar), bundle_id, run_report_sha256, null from release
union all
select 'table', cast(root as varchar), bundle_id, run_report_sha256, null from c where outcome = 'append'
""")
def _(v: Fixtures):
    """A table of the given releases; the candidates are appended to it, and then once more by another attempt."""
    path = f"{shared_folder(v.spark)}/releases/{uuid.uuid4().hex}"
    releases.append_new_releases(v.release, path, "given")
    told = [("first", stored(releases.append_new_releases(v.release_candidate, path, "first"), "outcomes"))]
    told.append(("again", stored(releases.append_new_releases(v.release_candidate, path, "again"), "outcomes")))
    table = releases.read_releases(v.spark, path).withColumn("outcome", F.lit(None).cast("string"))
    parts = [rows.withColumn("step", F.lit(step)) for step, rows in [*told, ("table", table)]]
    return findings.union(*parts).select("step", "root", "bundle_id", "run_report_sha256", "outcome")
