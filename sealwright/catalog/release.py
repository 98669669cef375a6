"""Publication results, pointers, policies, packages and signatures."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import contract as c
from ..operators import release
from ..plans.fixtures import Fixtures, view
from . import query

POLICY_SCHEMA = c.schema_id("release-policy.v1")
SIGNATURE_SCHEMA = c.schema_id("detached-signature.v1")
SUPPORTED = {
    "bundle": [c.schema_id("bundle-manifest.v1")],
    "config": [c.schema_id("config.v1")],
    "plan": [c.schema_id("plan.v1")],
    "run-report": [c.schema_id("run.v1")],
    "snapshot": [c.schema_id("snapshot.v1")],
    "stage-result": [c.schema_id("stage-result.v1")],
}

view("publication_full", """
select run_id, case when run_id % 101 = 0 then 'paused' else state end as state, exit_code, bundle_id,
       case when run_id % 103 = 0 then 'releases/other' when bundle_id is not null and run_id % 17 <> 0 then 'releases/' || bundle_id end as release_path,
       case when bundle_id is not null and run_id % 19 <> 0 then sha2('r' || run_id, 256) end as run_report_sha256,
       case when run_id % 7 = 4 and bundle_id is not null and run_id % 23 <> 0 then 'releases/' || bundle_id when run_id % 107 = 0 then 'releases/' || bundle_id end as prior_current_target,
       case when run_id % 7 in (1, 2, 3) and bundle_id is not null and run_id % 29 <> 0 then intended_current_target end as intended_current_target
from publication
""", stored=True)
view("process_result", """
select o_orderkey as result_id, case o_orderkey % 3 when 0 then 'plan' when 1 then 'build' else 'verify' end as command,
       case when o_orderkey % 31 = 0 then 'recovery' when o_orderkey % 3 = 1 and o_orderkey % 7 >= 4 and o_orderkey % 37 <> 0 then 'recovery' else 'run' || o_orderkey end as run_id,
       case when o_orderkey % 41 = 0 then null else 'run' || o_orderkey end as expected_run_id,
       case when o_orderkey % 43 = 0 then 'unsure' when o_orderkey % 5 = 0 then 'failed' when o_orderkey % 3 = 0 and o_orderkey % 11 = 0 then 'blocked' else 'succeeded' end as status,
       o_orderkey % 22 = 0 as blocking,
       case when o_orderkey % 3 = 1 then case o_orderkey % 7 when 0 then 'not-attempted' when 1 then 'definite-pre-commit-failure' when 2 then 'commit-indeterminate' when 3 then 'durable-success'
         when 4 then 'recovered-durable-success' when 5 then 'recovered-no-commit' else 'recovery-blocked' end end as state,
       case when o_orderkey % 3 = 2 then o_orderkey % 5 <> 0 end as valid,
       case when o_orderkey % 3 = 2 and o_orderkey % 10 <> 0 then 'bundle:sha256:' || sha2('b' || o_orderkey, 256) end as bundle_id,
       o_orderkey % 13 <> 0 as has_configuration, o_orderkey % 17 <> 0 as has_source, o_orderkey % 3 = 0 and o_orderkey % 5 <> 0 as has_plan,
       cast(case when o_orderkey % 47 = 0 then 2 when o_orderkey % 5 = 0 then 1 else 0 end as int) as exit_code
from orders
""", stored=True)
view("policy_text", f"""
select c_custkey as project, '{{"contract_assets":{{' || case when c_custkey % 9 = 1 then '"b.json":"' || sha2('b', 256) || '","a.json":"' || sha2('a', 256) || '"' when c_custkey % 9 = 2 then '"a.json":"' || sha2('a', 256) || '"'
     when c_custkey % 9 = 3 then '"a.json":"' || sha2('a', 256) || '","b.json":"x"' else '"a.json":"' || sha2('a', 256) || '","b.json":"' || sha2('b', 256) || '"' end
  || '}},"fixture_revision":' || (c_custkey % 4) || ',"package":{{"name":"inspector","version":"' || case when c_custkey % 9 = 4 then '0.2.0' else '0.1.0' end || '"}},"schema":"' || case when c_custkey % 9 = 5 then 'other' else '{POLICY_SCHEMA}' end
  || '","support":{{"operating_systems":["linux"' || case when c_custkey % 9 = 6 then ',"macos"' else '' end || '],"process_protocols":["run-v1"],"python":["3.12","3.13"],"schemas":["{POLICY_SCHEMA}"' || case when c_custkey % 9 = 7 then ',"a"' else '' end
  || ']}}' || case when c_custkey % 9 = 8 then ',"note":1' else '' end || '}}' as policy_json
from customer
""")
view("member_case", """
select bundle_id, path from path_case
union all select bundle_id, upper(path) from path_case where path like 'artifacts/%'
union all select source, 'Artifacts/' || lang || '/' || doc_id || '.TXT' from documents
union all select source, 'CAFÉ/' || doc_id from documents
""")
# package members and the listing of the package: every 17th row differs
view("package_member", """
select source as archive, 'pkg/' || doc_id || '.py' as path, sha2(text, 256) as sha256, octet_length(text) as size from documents where doc_id % 19 <> 0
union all select distinct source, 'RECORD', sha2(source, 256), 10 from documents
""")
view("package_record", """
select source as archive, 'pkg/' || doc_id || '.py' as path,
       'sha256=' || replace(replace(replace(base64(unhex(sha2(case when doc_id % 17 = 0 then 'x' || text else text end, 256))), '+', '-'), '/', '_'), '=', '') as digest,
       cast(octet_length(text) as string) as size from documents where doc_id % 23 <> 0
union all select distinct source, 'RECORD', case when source like '%3' then 'sha256=x' else '' end, '' from documents
""")
view("advertised", "select distinct o_custkey as project, name, schema from (select o_custkey, " + "case o_orderkey % 7 " + " ".join(
    f"when {n} then '{name}'" for n, name in enumerate(SUPPORTED)) + " else 'extra' end as name, case when o_orderkey % 77 = 0 then 'v9' else " + "case o_orderkey % 7 " + " ".join(
    f"when {n} then '{schemas[0]}'" for n, schemas in enumerate(SUPPORTED.values())) + " else 'none' end end as schema from orders) t")
view("envelope", f"""
select c_custkey as bundle_key, case when c_custkey % 53 = 0 then replace(t, '}},"key_id"', '}}, "key_id"') when c_custkey % 59 = 0 then replace(t, ',"signature"', ',"x":1,"signature"') else t end as envelope_json
from (select c_custkey, '{{"algorithm":"' || case when c_custkey % 11 = 0 then 'rsa' else 'ed25519' end || '","binding":{{"bundle_id":"bundle:sha256:' || sha2('b' || c_custkey, 256)
  || '","checksums_sha256":"' || sha2('c' || c_custkey, 256) || '","manifest_sha256":"' || case when c_custkey % 7 = 0 then sha2('x', 256) else sha2('m' || c_custkey, 256) end
  || '","payload_sha256":"' || case when c_custkey % 17 = 0 then 'short' else sha2('p' || c_custkey, 256) end || '","statement_type":"review.v1"}},"key_id":"n' || c_nationkey
  || '","public_key":' || case when c_custkey % 2 = 0 then 'null' else '"' || substring(sha2('k' || c_custkey, 256), 1, 42) || 'A"' end
  || ',"schema":"' || case when c_custkey % 13 = 0 then 'v0' else '{SIGNATURE_SCHEMA}' end || '","signature":"' || sha2('s' || c_custkey, 256) || substring(sha2('t' || c_custkey, 256), 1, 21) || 'Q"}}' as t, c_nationkey from customer) e
""", stored=True)
view("bound_bundle", """
select c_custkey as bundle_key, 'bundle:sha256:' || sha2('b' || c_custkey, 256) as bundle_id, sha2('c' || c_custkey, 256) as checksums_sha256,
       sha2('m' || c_custkey, 256) as manifest_sha256, sha2('p' || c_custkey, 256) as payload_sha256 from customer
""")
view("anchor", """
select 'n' || n_nationkey as key_id, substring(sha2(n_name, 256), 1, case when n_nationkey % 6 = 0 then 16 else 32 end) as key_bytes from nation where n_nationkey % 3 <> 1
""")


def _rows(rules: list[tuple[str, str]], table: str, code: str, scope: str, path: str) -> str:
    parts = [f"select {scope} as s, {path} as p, '{detail}' as detail from {table} where {condition}" for condition, detail in rules]
    return f"select cast(s as varchar) as scope_id, 0 as check_rank, '{code}' as code, p as path, detail from (" + " union all ".join(parts) + ") t"


_REL = "('releases/' || bundle_id)"
_BOUND = f"(bundle_id is not null and release_path is not distinct from {_REL} and run_report_sha256 is not null)"
_DURABLE = "state in ('durable-success', 'recovered-durable-success')"
_TARGET = "'^releases/bundle:sha256:[0-9a-f]{64}$'"


@query("publication_result_audit", _rows([
    ("state = 'paused'", "state"),
    ("state <> 'paused' and exit_code <> case state when 'not-attempted' then 10 when 'definite-pre-commit-failure' then 11 when 'commit-indeterminate' then 12 when 'recovered-no-commit' then 13 when 'recovery-blocked' then 14 else 0 end", "exit code"),
    (f"not coalesce(regexp_matches(release_path, {_TARGET}), true) or not coalesce(regexp_matches(prior_current_target, {_TARGET}), true) or not coalesce(regexp_matches(intended_current_target, {_TARGET}), true)", "target profile"),
    (f"{_DURABLE} and not {_BOUND}", "durable binding"),
    (f"state = 'durable-success' and intended_current_target is distinct from {_REL}", "durable target"),
    (f"state = 'recovered-durable-success' and (prior_current_target is distinct from {_REL} or intended_current_target is not null)", "recovered target"),
    (f"state = 'commit-indeterminate' and not ({_BOUND} and intended_current_target is not distinct from {_REL})", "indeterminate binding"),
    (f"state = 'definite-pre-commit-failure' and case when bundle_id is null then release_path is not null or intended_current_target is not null else not ({_BOUND} and intended_current_target is not distinct from {_REL}) end", "pre-commit binding"),
    ("state in ('not-attempted', 'recovered-no-commit', 'recovery-blocked') and coalesce(bundle_id, release_path, run_report_sha256, prior_current_target, intended_current_target) is not null", "unexpected binding"),
], "publication_full", "publication.inconsistent_result", "run_id", "state"))
def _(v: Fixtures):
    return release.publication_result_audit(v.publication_full)


_RECOVERY = "state in ('recovered-durable-success', 'recovered-no-commit', 'recovery-blocked')"
_EXIT = ("case when command = 'build' then case state when 'not-attempted' then 10 when 'definite-pre-commit-failure' then 11 when 'commit-indeterminate' then 12 "
         "when 'recovered-no-commit' then 13 when 'recovery-blocked' then 14 else 0 end when status = 'succeeded' then 0 else 1 end")


@query("process_result_audit", _rows([
    ("status = 'unsure' or (status = 'blocked' and command <> 'plan')", "status"),
    ("command = 'plan' and status <> 'failed' and (status = 'blocked') <> blocking", "blocking"),
    ("command = 'plan' and status <> 'failed' and not (has_configuration and has_source and has_plan)", "missing binding"),
    ("command = 'plan' and status = 'failed' and (has_configuration or has_source or has_plan)", "untrusted binding"),
    (f"command = 'build' and {_RECOVERY} and run_id <> 'recovery'", "recovery run"),
    (f"command = 'build' and not {_RECOVERY} and run_id = 'recovery'", "reserved run"),
    (f"command = 'build' and not {_RECOVERY} and run_id <> 'recovery' and run_id is distinct from expected_run_id", "run correlation"),
    (f"command = 'build' and (status = 'succeeded') <> ({_DURABLE})", "publication state"),
    ("command = 'build' and state <> 'not-attempted' and not (has_configuration and has_source)", "missing binding"),
    ("command = 'build' and state = 'not-attempted' and has_source and not has_configuration", "source without configuration"),
    ("command = 'verify' and status = 'succeeded' and (not valid or bundle_id is null)", "verification"),
    ("command = 'verify' and status = 'failed' and (valid or bundle_id is not null)", "verification"),
    (f"exit_code <> {_EXIT}", "exit code"),
], "process_result", "process.inconsistent_result", "result_id", "command"))
def _(v: Fixtures):
    return release.process_result_audit(v.process_result)



@query("release_policy_audit", _rows([
    ("project % 9 = 8", "members"),
    ("project % 9 = 5", "schema"),
    ("project % 9 = 4", "package"),
    ("project % 9 <> 8 and project % 4 = 0", "fixture revision"),
    ("project % 9 = 6", "operating systems"),
    ("project % 9 = 7", "schemas"),
    ("project % 9 = 2", "asset set"),
    ("project % 9 = 1", "asset order"),
    ("project % 9 = 3", "asset digest"),
], "policy_text", "contract.policy_violation", "project", "cast(null as varchar)"))
def _(v: Fixtures):
    return release.release_policy_audit(
        v.policy_text, "project", "policy_json", package=("inspector", "0.1.0"), required_assets=("a.json", "b.json"),
        operating_systems=("linux",), python=("3.12", "3.13"), protocols=("run-v1",),
    )


@query("contract_change_gate", """
with p as (select *, lag(contract_digest) over w as pd, lag(version) over w as pv, lag(fixture_revision) over w as pf from policy window w as (partition by project order by revision_order))
select cast(project as varchar) as scope_id, 0 as check_rank, 'contract.version_unchanged' as code, cast(revision_order as varchar) as path, version as detail from p where pd <> contract_digest and pv = version
union all select cast(project as varchar), 0, 'contract.fixture_unchanged', cast(revision_order as varchar), cast(fixture_revision as varchar) from p where pd <> contract_digest and pf = fixture_revision
""")
def _(v: Fixtures):
    return release.contract_change_gate(v.policy, slice_width=1000)


@query("contract_pin_check", """
with s as (select coalesce(a.bundle_id, p.bundle_id) as bundle_id, coalesce(a.path, p.path) as path, a.sha256 as a, p.sha256 as p
           from payload a full join manifest p on a.bundle_id = p.bundle_id and a.path = p.path)
select bundle_id as scope_id, 0 as check_rank, case when a is null then 'contract.asset_missing' when p is null then 'contract.asset_unpinned' else 'contract.digest_changed' end as code,
       path, case when a is not null and p is not null then a end as detail from s where a is null or p is null or a <> p
""")
def _(v: Fixtures):
    return release.contract_pin_check(v.payload, v.manifest, "bundle_id")


@query("record_listing_check", """
with s as (select coalesce(r.archive, m.archive) as archive, coalesce(r.path, m.path) as path, r.path as rp, m.path as mp, r.digest, r.size, m.size as msize,
             'sha256=' || replace(replace(replace(base64(unhex(m.sha256)), '+', '-'), '/', '_'), '=', '') as mdigest
           from package_record r full join package_member m on r.archive = m.archive and r.path = m.path)
select archive as scope_id, 0 as check_rank, code, path, detail from (
  select archive, path, 'distribution.record_missing' as code, cast(null as varchar) as detail from s where rp is null
  union all select archive, path, 'distribution.member_missing', null from s where mp is null
  union all select archive, path, 'distribution.record_self_entry', null from s where path = 'RECORD' and (digest <> '' or size <> '')
  union all select archive, path, 'distribution.record_mismatch', digest from s where path <> 'RECORD' and rp is not null and mp is not null and (digest <> mdigest or size <> cast(msize as varchar))) t
""")
def _(v: Fixtures):
    return release.record_listing_check(v.package_record, v.package_member, "archive")


@query("archive_name_collisions", """
select bundle_id as scope_id, 0 as check_rank, 'distribution.unsafe_member' as code, path, cast(null as varchar) as detail from member_case
where path = '' or contains(path, chr(92)) or starts_with(path, '/') or len(list_filter(string_split(path, '/'), lambda s: s in ('', '.', '..'))) > 0
union all
select bundle_id, 0, 'distribution.name_collision', folded, cast(count(*) as varchar)
from (select bundle_id, lower(nfc_normalize(path)) as folded from member_case where path <> '') f group by bundle_id, folded having count(*) > 1
""")
def _(v: Fixtures):
    return release.archive_name_collisions(v.member_case, "bundle_id")


_SUPPORTED = " union all ".join(f"select '{name}' as name, '{schemas[0]}' as schema" for name, schemas in SUPPORTED.items())


@query("capability_set_diff", f"""
with w as (select distinct a.project, s.name, s.schema from advertised a cross join ({_SUPPORTED}) s)
select cast(project as varchar) as scope_id, 0 as check_rank, 'process.capability_missing' as code, name as path, schema as detail from (select project, name, schema from w except select project, name, schema from advertised) m
union all select cast(project as varchar), 0, 'process.capability_unknown', name, schema from (select project, name, schema from advertised except select project, name, schema from w) u
""")
def _(v: Fixtures):
    return release.capability_set_diff(v.advertised, SUPPORTED, "project")


@query("release_pointer_check", """
select p.root, case when pointer_target is null then 'recovered-no-commit' when not regexp_matches(pointer_target, '^releases/bundle:sha256:[0-9a-f]{64}$') or r.root is null then 'recovery-blocked' else 'recovered-durable-success' end as state,
       case when pointer_target is null then null when not regexp_matches(pointer_target, '^releases/bundle:sha256:[0-9a-f]{64}$') then 'publication.recovery_target_unsafe' when r.root is null then 'publication.recovery_target_missing' end as code,
       r.bundle_id, r.run_report_sha256
from release p left join (select root, bundle_id, run_report_sha256 from release) r on r.root = p.root and p.pointer_target = 'releases/' || r.bundle_id
""")
def _(v: Fixtures):
    pointer = v.release.select("root", F.col("pointer_target").alias("target"))
    return release.release_pointer_check(pointer, v.release)


@query("signature_binding_audit", """
select c.c_custkey as bundle_key, 'n' || c_nationkey as key_id,
  case when c_custkey % 53 = 0 or c_custkey % 59 = 0 then 'malformed_envelope' when c_custkey % 13 = 0 then 'unsupported_version' when c_custkey % 11 = 0 then 'unsupported_algorithm'
       when c_custkey % 17 = 0 then 'malformed_envelope' when a.key_id is not null and c_nationkey % 6 = 0 then 'invalid_trust_anchor' when a.key_id is null and c_custkey % 2 = 0 then 'unknown_key'
       when c_custkey % 7 = 0 then 'binding_mismatch' else 'binding_ok' end as status, a.key_id is not null as anchored
from customer c left join anchor a on a.key_id = 'n' || c_nationkey
""")
def _(v: Fixtures):
    return release.signature_binding_audit(v.envelope, v.bound_bundle, v.anchor)
