"""Audits of single records and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import contract as c
from ..operators import records
from ..plans.fixtures import Fixtures, view
from . import query

# JSON records: clean, unknown member, repeated member, cut off, empty
view("record_text", """
select event_id, user_id, case event_id % 11 when 0 then '{"a":' || event_id || '}' when 1 then '{"k":1,"z":2}' when 2 then '{"k":1,"k":2}'
         when 3 then '{"k":' when 4 then '{}' when 5 then '{"k":{"n":1,"n":2}}' when 6 then props else replace(props, ' ', '') end as props
from events
""")

# JSON scalars of every number class
view("number_case", """
select l_orderkey % 100 as project_id, '/n/' || l_orderkey || '/' || l_linenumber as pointer,
       case l_linenumber when 1 then '-0' when 2 then '0' || l_orderkey when 3 then l_orderkey || '.5' when 4 then '9007199254740992'
            when 5 then '-9007199254740991' when 6 then l_orderkey || 'e3' else cast(l_orderkey as string) end as value_json
from lineitem
union all select o_orderkey % 100, '/s/' || o_orderkey, '"' || o_orderpriority || '"' from orders
union all select o_orderkey % 100, '/b/' || o_orderkey, case when o_orderkey % 2 = 0 then '123456789012345678901234567890' else 'true' end from orders
""")

view("diagnostic", """
select user_id as run_id, event_id, case event_id % 5 when 0 then 'Bad Code' when 1 then '' else 'stage.' || event_type end as code,
       case event_id % 4 when 0 then chr(9) || 'tab ' || event_id || chr(10) when 1 then chr(7) || chr(8) when 2 then 'a' || chr(13) || 'b' else '  m ' || event_id end as message
from events
""")


@query("token_profile_audit", """
select cast(project as varchar) as scope_id, 25 as check_rank, 'record.invalid_field' as code, cast(revision_order as varchar) as path, field as detail from (
  select project, revision_order, 'version' as field from policy where not regexp_matches(version, '^[A-Za-z0-9]+([._+-][A-Za-z0-9]+)*$')
  union all select project, revision_order, 'contract_digest' from policy where not regexp_matches(contract_digest, '^[a-z0-9]+(-[a-z0-9]+)*$')
  union all select project, revision_order, 'fixture_revision' from policy where not regexp_matches(cast(fixture_revision as varchar), '^[1-9][0-9]*$')) t
""")
def _(v: Fixtures):
    rules = {"version": c.VERSION, "contract_digest": c.KIND, "fixture_revision": c.POSITIVE_SIZE}
    return records.token_profile_audit(v.policy, "project", rules, "revision_order")


@query("closed_record_audit", """
with k as (select user_id, props, json_valid(props) as ok, case when json_valid(props) then json_keys(props) end as keys from record_text)
select cast(user_id as varchar) as scope_id, 21 as check_rank, 'manifest.invalid_json' as code, cast(null as varchar) as path, cast(null as varchar) as detail from k where not ok
union all select cast(user_id as varchar), 23, 'manifest.invalid_shape', 'k', 'missing' from k where ok and not list_contains(keys, 'k')
union all select cast(user_id as varchar), 23, 'manifest.invalid_shape', name, 'unknown'
  from (select user_id, unnest(list_distinct(keys)) as name from k where ok) u where name <> 'k'
""")
def _(v: Fixtures):
    return records.closed_record_audit(v.record_text, "user_id", "props", ("k",))


@query("duplicate_member_audit", """
select cast(user_id as varchar) as scope_id, 20 as check_rank, 'manifest.duplicate_member' as code,
       case when event_id % 11 = 2 then 'k' end as path, case when event_id % 11 = 2 then 'top' else 'nested' end as detail
from record_text where event_id % 11 in (2, 5)
""")
def _(v: Fixtures):
    return records.duplicate_member_audit(v.record_text, "user_id", "props")


@query("canonical_json_audit", """
select cast(user_id as varchar) as scope_id, 22 as check_rank, 'manifest.noncanonical' as code, cast(null as varchar) as path, cast(null as varchar) as detail
from record_text where not regexp_matches(props, '^[{]"k":(0|-?[1-9][0-9]*)[}]$')
""")
def _(v: Fixtures):
    return records.canonical_json_audit(v.record_text, "user_id", "props", "k bigint")


@query("safe_number_audit", """
select cast(project_id as varchar) as scope_id, 24 as check_rank, 'configuration.invalid_number' as code, pointer as path, detail from (
  select *, case when not regexp_matches(value_json, '^(0|-?[1-9][0-9]*)$') then 'token'
                 when abs(cast(value_json as hugeint)) > 9007199254740991 then 'range' end as detail
  from number_case where regexp_matches(value_json, '^[-+.0-9]')) t
where detail is not null
""")
def _(v: Fixtures):
    return records.safe_number_audit(v.number_case, "project_id", "value_json", F.col("pointer"))


@query("redact_secrets", """
select l.run_id, l.seq, coalesce(list_reduce(s.literals, lambda done, literal: replace(done, literal, '<redacted>'), l.text), l.text) as text
from logs l left join (select run_id, list(literal order by ord) as literals from secret where literal <> '' group by run_id) s on s.run_id = l.run_id
""")
def _(v: Fixtures):
    return records.redact_secrets(v.logs, v.secret)


@query("report_text_clean", r"""
select run_id, event_id, case when regexp_matches(code, '^[a-z0-9]+([._-][a-z0-9]+)*$') then code else 'stage.invalid_diagnostic_code' end as code,
       coalesce(nullif(trim(regexp_replace(message, '\p{Cc}', ' ', 'g')), ''), 'stage diagnostic unavailable') as message
from diagnostic
""")
def _(v: Fixtures):
    return records.clean_diagnostics(v.diagnostic)
