"""Stage results, dependencies, outputs, plan digests and run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import contract as c
from ..functions import json_text, ordered
from ..operators import producers, records, stages
from ..plans.fixtures import DERIVED, VIEWS, Fixtures, view
from . import query

PLAN_SCHEMA = c.schema_id("plan.v1")
RUN_SCHEMA = c.schema_id("run.v1")

view("stage_declared", "select run_id, stage, 'out/' || stage || '.json' as path, 'json' as kind from stage")
view("stage_observed", """
select run_id, stage, path, kind, length(run_id) % 5 = 0 and stage = 'click' as existed_before from stage_output
""")
view("stage_input", """
select run_id, stage, 's' as snapshot_id, 'part/' || (event_id % 3000) as path from stage
""")
view("input_file", "select 's' as snapshot_id, 'part/' || p_partkey as path from part")
# stored edges: some dependencies absent, some edges from a stage nobody declared
view("plan_edge", """
select run_id, dependency as from_stage, stage as to_stage from stage_dep where dependency is not null and not (stage = 'click' and run_id like '%5')
union all select distinct run_id, 'ghost', 'view' from stage_dep where run_id like '1%'
""")
view("stage_own", """
select run_id, stage, policy, case when status = 'degraded' then 'failed' when status in ('blocked', 'skipped') then 'succeeded' else status end as own_status,
       status in ('blocked', 'skipped') as static_fault
from stage
""")
view("plan_stage", "select run_id, stage, policy from stage")
# stages with no, one and two dependencies
view("plan_dependency", """
select d.run_id, d.stage, d.dependency from stage_dep d join stage s on s.run_id = d.run_id and s.stage = d.stage where d.dependency is not null
union all select run_id, stage, 'preflight' from stage where stage = 'purchase'
""")
view("plan_diagnostic", """
select run_id, stage, 'plan.input_missing' as code, 'no input for ' || stage as message, policy = 'required' as blocking from stage where status in ('blocked', 'skipped')
""")
view("plan_head", """
select distinct run_id, '{"resolved":{"sha256":"' || sha2(run_id, 256) || '"}}' as configuration_json,
       '{"snapshot_id":"snapshot:sha256:' || sha2('s' || run_id, 256) || '"}' as snapshot_json from stage
""")
view("run_head", f"""
select distinct run_id, '{{"controlled_input":{{"path":"inspector.json","sha256":"' || sha2(run_id, 256) || '","size":"1"}},"defaults":{{"id":"builtin","sha256":"' || sha2('d', 256)
  || '"}},"overrides":[{{"pointer":"/a","value":{{"n":[1,true,null]}}}}],"resolved":{{"sha256":"' || sha2('r' || run_id, 256) || '"}},"schema":{{"id":"{c.schema_id('config.v1')}","sha256":"' || sha2('s', 256) || '"}}}}' as configuration_json,
       sha2('p' || run_id, 256) as plan_sha256, 'snapshot:sha256:' || sha2('s' || run_id, 256) as snapshot_id, '0.1.0' as version from stage
""")
# heads are texts over the run alone: in Spark runs are told apart before their texts are made
for _head in ("plan_head", "run_head"):
    DERIVED[_head] = lambda v, sql=VIEWS[_head].replace("select distinct", "select").replace(" from stage", " from run_known"): v.sql(sql)
view("run_known", "select distinct run_id from stage")
view("run_stage", "select run_id, stage, stage as ord, status, policy, sha2(run_id || stage || status, 256) as digest from stage")
view("run_diagnostic", """
select run_id, stage, stage as ord, 'process.nonzero_exit' as code, 'stage ' || stage || ' ended with "1"' as message
from stage where status in ('failed', 'degraded')
""")
view("run_count", """
select run_id, 'stage-output' as kind, cast(count(*) as string) as count from stage_output group by run_id
union all select run_id, 'stage-result', cast(count(*) as string) from stage group by run_id
""")

@query("process_evidence_audit", """
with s as (select *, case when status = 'failed' then 'nonzero_exit' end as failure, coalesce(exit_code = 0, false) as fine from stage)
select run_id as scope_id, 0 as check_rank, 'stage.process_result_invalid' as code, stage as path, detail from (
  select run_id, stage, 'success' as detail from s where status = 'succeeded' and not fine
  union all select run_id, stage, 'exit code' from s where failure is not null and (exit_code is null or fine)
  union all select run_id, stage, 'negative time' from s where wall_seconds < 0 or duration_seconds < 0
  union all select run_id, stage, 'duration' from s
    where abs(wall_seconds - duration_seconds) > greatest(1.0, 0.25 * greatest(wall_seconds, duration_seconds))) t
""")
def _(v: Fixtures):
    return stages.process_evidence_audit(v.stage)


_ATTRIBUTION = """
select o.run_id as scope_id, 0 as check_rank,
       case when s.status is null then 'artifact_graph.missing_endpoint' else 'artifact_graph.stage_output_mismatch' end as code,
       o.path, coalesce(s.status, o.stage) as detail
from {table} o left join (select run_id, stage, status from stage where stage <> 'error') s on s.run_id = o.run_id and s.stage = o.stage
where s.status is null or s.status not in ({allowed})
"""


@query("stage_attribution_check", _ATTRIBUTION.format(table="stage_output", allowed="'succeeded'") + " union all "
       + _ATTRIBUTION.format(table="(select run_id, stage, 'logs/' || stage || '.log' as path from stage)", allowed="'succeeded', 'failed', 'degraded'"))
def _(v: Fixtures):
    results = v.stage.filter("stage <> 'error'")
    logs = v.stage.select("run_id", "stage", F.concat(F.lit("logs/"), "stage", F.lit(".log")).alias("path"))
    return stages.stage_attribution_check(v.stage_output, results, ("succeeded",)).unionByName(
        stages.stage_attribution_check(logs, results, ("succeeded", "failed", "degraded"))
    )


@query("output_declaration_diff", """
with s as (select coalesce(d.run_id, o.run_id) as run_id, coalesce(d.stage, o.stage) as stage, coalesce(d.path, o.path) as path,
             d.path is not null as declared, o.path is not null as observed, coalesce(o.existed_before, false) as stale
           from stage_declared d full join stage_observed o on d.run_id = o.run_id and d.stage = o.stage and d.path = o.path and d.kind = o.kind)
select run_id as scope_id, 0 as check_rank, code, path, stage as detail from (
  select run_id, stage, path, 'process.output_missing' as code from s where not observed
  union all select run_id, stage, path, 'process.output_undeclared' from s where not declared
  union all select run_id, stage, path, 'process.output_stale' from s where stale) t
""")
def _(v: Fixtures):
    return stages.output_declaration_diff(v.stage_declared, v.stage_observed)


@query("missing_inputs", """
select i.run_id, i.stage, i.path, 'plan.input_missing' as code, s.policy = 'required' as blocking
from stage_input i join stage s on s.run_id = i.run_id and s.stage = i.stage
where not exists (select 1 from input_file f where f.snapshot_id = i.snapshot_id and f.path = i.path)
""")
def _(v: Fixtures):
    return stages.missing_inputs(v.stage_input, v.input_file, v.stage)


@query("stage_edge_check", """
with d as (select run_id, dependency as a, stage as b, count(*) as n from stage_dep group by run_id, dependency, stage),
e as (select run_id, from_stage as a, to_stage as b, count(*) as n from plan_edge group by run_id, from_stage, to_stage),
s as (select coalesce(d.run_id, e.run_id) as run_id, coalesce(d.a, e.a) as a, coalesce(d.b, e.b) as b, coalesce(d.n, 0) as d, coalesce(e.n, 0) as e
      from d full join e on d.run_id = e.run_id and d.a is not distinct from e.a and d.b = e.b)
select run_id as scope_id, 0 as check_rank, 'plan.edge_mismatch' as code, concat_ws('>', a, b) as path, case when d > e then 'missing edge' else 'extra edge' end as detail
from s where d <> e
union all
select run_id, 0, 'plan.unknown_dependency', dependency || '>' || stage, null from stage_dep d
where dependency <> 'snapshot' and not exists (select 1 from stage s where s.run_id = d.run_id and s.stage = d.dependency)
""")
def _(v: Fixtures):
    return stages.stage_edge_check(v.stage, v.stage_dep, v.plan_edge)


# five stage names bound the depth of these plans, so five rounds suffice in SQL
_LEVELS = """
st as (select distinct run_id, stage from stage),
w as (select distinct d.run_id, d.stage, d.dependency from stage_dep d where dependency is not null and dependency <> 'snapshot'),
l0 as (select *, 0 as level from st where not exists (select 1 from w where w.run_id = st.run_id and w.stage = st.stage)),
""" + ",\n".join(
    f"""l{n} as (select * from l{n - 1} union all select run_id, stage, {n} from st
  where not exists (select 1 from l{n - 1} p where p.run_id = st.run_id and p.stage = st.stage)
    and not exists (select 1 from w where w.run_id = st.run_id and w.stage = st.stage
      and not exists (select 1 from l{n - 1} p where p.run_id = w.run_id and p.stage = w.dependency)))"""
    for n in range(1, 6)
)


@query("stage_levels", f"with {_LEVELS} select st.run_id, st.stage, l5.level from st left join l5 on l5.run_id = st.run_id and l5.stage = st.stage")
def _(v: Fixtures):
    return stages.stage_levels(v.stage, v.stage_dep)


_OUTCOMES = ",\n".join(
    f"""r{n} as ({'select * from r%d union all ' % (n - 1) if n else ''}select o.run_id, o.stage, o.policy,
    case when o.static_fault then case when o.policy = 'required' then 'blocked' else 'skipped' end
         when exists (select 1 from w where w.run_id = o.run_id and w.stage = o.stage
           and not exists (select 1 from {f'r{n - 1}' if n else '(select null as run_id, null as stage, null as status)'} p
                           where p.run_id = w.run_id and p.stage = w.dependency and p.status = 'succeeded')) then 'blocked'
         when o.own_status = 'failed' and o.policy <> 'required' then 'degraded' else o.own_status end as status
  from stage_own o join l5 on l5.run_id = o.run_id and l5.stage = o.stage where l5.level = {n})"""
    for n in range(6)
)


@query("stage_outcome_propagation", f"with {_LEVELS}, {_OUTCOMES} select run_id, stage, policy, status from r5")
def _(v: Fixtures):
    return stages.stage_outcomes(v.stage_own, v.stage_dep)


@query("level_findings", f"""with {_LEVELS}
select st.run_id as scope_id, 0 as check_rank, 'orchestration.invalid_dependencies' as code, st.stage as path, cast(null as varchar) as detail
from st where not exists (select 1 from l5 where l5.run_id = st.run_id and l5.stage = st.stage)""")
def _(v: Fixtures):
    return stages.level_findings(stages.stage_levels(v.stage, v.stage_dep))


@query("failed_dependencies", f"""with {_LEVELS}, {_OUTCOMES}
select w.run_id as scope_id, 0 as check_rank, 'stage.dependency_failed' as code, w.stage as path, w.dependency as detail
from w join r5 b on b.run_id = w.run_id and b.stage = w.stage and b.status = 'blocked'
where not exists (select 1 from r5 p where p.run_id = w.run_id and p.stage = w.dependency and p.status = 'succeeded')""")
def _(v: Fixtures):
    return stages.failed_dependencies(stages.stage_outcomes(v.stage_own, v.stage_dep), v.stage_dep)


@query("required_stage_decision", """
select run_id, case when count(*) filter (where policy = 'required' and status <> 'succeeded') = 0 then 'satisfied' else 'blocked' end as decision
from stage group by run_id
""")
def _(v: Fixtures):
    return stages.required_stage_decision(v.stage)


_LISTS = """
coalesce(string_agg('"' || stage || '"', ',' order by stage) filter (where status = 'degraded'), '') as degraded,
coalesce(string_agg('"' || stage || '"', ',' order by stage) filter (where status = 'skipped'), '') as skipped
"""


@query("optional_stage_rollup", f"""
select run_id, 0 as chunk, '{{"degraded":[' || degraded || '],"skipped":[' || skipped || ']}}' as text
from (select run_id, {_LISTS} from stage group by run_id) t
""")
def _(v: Fixtures):
    return stages.optional_stage_rollup(v.stage)


@query("stage_status_overlap", """
select run_id as scope_id, 70 as check_rank, 'run_report.invalid_shape' as code, stage as path, 'stage overlap' as detail
from (select user_id || '' as run_id, event_type as stage, case event_id % 10 when 2 then 'skipped' when 3 then 'degraded' end as status from events) e
group by run_id, stage having count(*) filter (where status = 'skipped') > 0 and count(*) filter (where status = 'degraded') > 0
""")
def _(v: Fixtures):
    listed = v.events.select(
        F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("stage"),
        F.expr("case event_id % 10 when 2 then 'skipped' when 3 then 'degraded' end").alias("status"),
    )
    return stages.stage_status_overlap(listed)


_STAGE_RECORD = """
'{"adapter":{"selector":"builtin.' || stage || '.v1"},"adapter_options":{},"capability":null,"dependencies":[' || coalesce(dependencies, '')
|| '],"expected_outputs":["out/' || stage || '.json"],"id":"' || stage || '","invocation":{"argv":["run"]},"policy":"' || policy
|| '","required_inputs":[],"workspace":"stages/' || stage || '"}'
"""


@query("plan_digest", f"""
with l as (select run_id, stage, string_agg('"' || dependency || '"', ',' order by dependency) as dependencies from plan_dependency group by run_id, stage),
s as (select p.run_id, string_agg({_STAGE_RECORD.replace("stage", "p.stage").replace("p.stages/", "stages/")}, ',' order by p.stage) as text
      from plan_stage p left join l on l.run_id = p.run_id and l.stage = p.stage group by p.run_id),
e as (select run_id, string_agg('{{"from":"' || dependency || '","to":"' || stage || '"}}', ',' order by dependency, stage) as text from plan_dependency group by run_id),
d as (select run_id, string_agg('{{"blocking":' || blocking || ',"code":"' || code || '","message":"' || message || '","stage":"' || stage || '"}}', ',' order by stage, code) as text
      from plan_diagnostic group by run_id)
select h.run_id, sha256('{{"identity":{{"configuration":' || configuration_json || ',"diagnostics":[' || coalesce(d.text, '') || '],"edges":[' || coalesce(e.text, '')
  || '],"schema":"{PLAN_SCHEMA}","snapshot":' || snapshot_json || ',"stages":[' || coalesce(s.text, '') || ']}},"kind":"plan"}}') as plan_sha256
from plan_head h left join s on s.run_id = h.run_id left join e on e.run_id = h.run_id left join d on d.run_id = h.run_id
""")
def _(v: Fixtures):
    record = stages.plan_stage_record(
        selector=F.concat(F.lit("builtin."), "stage", F.lit(".v1")), stage=F.col("stage"), policy=F.col("policy"),
        dependencies=F.coalesce("dependencies", F.array().cast("array<string>")), expected_outputs=F.array(F.concat(F.lit("out/"), "stage", F.lit(".json"))),
        argv=F.array(F.lit("run")), workspace=F.concat(F.lit("stages/"), "stage"),
    )
    listed = v.plan_dependency.groupBy("run_id", "stage").agg(F.array_sort(F.collect_list("dependency")).alias("dependencies"))
    plan = v.plan_stage.join(listed, ["run_id", "stage"], "left").withColumn("record_json", record)
    return stages.plan_digest(v.plan_head, plan, v.plan_dependency, v.plan_diagnostic)


_REPORT_SQL = f"""
with s as (select run_id, string_agg('"' || digest || '"', ',' order by ord) as digests, {_LISTS},
       case when count(*) filter (where policy = 'required' and status <> 'succeeded') = 0 then 'satisfied' else 'blocked' end as decision
     from run_stage group by run_id),
n as (select run_id, string_agg('{{"count":"' || "count" || '","kind":"' || kind || '"}}', ',' order by kind) as text from run_count group by run_id),
d as (select g.run_id, string_agg(cast(to_json({{'code': code, 'message': message, 'path': null, 'severity': case when r.policy = 'optional' then 'warning' else 'error' end}}) as varchar), ',' order by g.ord) as text
      from run_diagnostic g join run_stage r on r.run_id = g.run_id and r.stage = g.stage group by g.run_id)
select h.run_id, 0 as chunk, '{{"artifact_counts":[' || coalesce(n.text, '') || '],"claim_boundary":{{"does_not_establish":["certification","evidence-adequacy","evidence-approval","fitness-for-use","functional-safety","security","software-qualification","standards-compliance","tool-qualification"],"scope":"mechanical-structural-and-integrity-inspection"}},"configuration_identity":'
  || configuration_json || ',"diagnostics":[' || coalesce(d.text, '') || '],"inspector":{{"version":"' || version || '"}},"optional_stages":{{"degraded":[' || s.degraded || '],"skipped":[' || s.skipped
  || ']}},"plan_sha256":"' || plan_sha256 || '","required_stage_decision":"' || s.decision || '","schema":"{RUN_SCHEMA}","snapshot_id":"' || snapshot_id
  || '","stage_result_digests":[' || s.digests || ']}}' as text
from run_head h join s on s.run_id = h.run_id left join n on n.run_id = h.run_id left join d on d.run_id = h.run_id
"""


def _reports(v: Fixtures, runs: DataFrame | None = None):
    """Reports of all runs, or of those in ``runs(run_id)``; no others are made then."""
    tables = [v.run_head, v.run_count, v.run_stage, v.run_diagnostic]
    return stages.run_report(*[table if runs is None else table.join(runs, "run_id", "left_semi") for table in tables])


@query("run_report", _REPORT_SQL)
def _(v: Fixtures):
    return _reports(v)


# seeded faults by the last digit of the run's date: text, its replacement, code and detail of the finding
_TAMPER = (
    ("0", '"satisfied"', '"approved"', "invalid_shape", "decision"),
    ("1", '"version":"0.1.0"', '"version":"0 1"', "invalid_shape", "version"),
    ("2", '"certification",', "", "invalid_shape", "claim_boundary"),
    ("3", '"kind":"stage-result"', '"kind":"Stage"', "invalid_shape", "artifact_counts"),
    ("4", '"severity":"warning"', '"severity":"notice"', "invalid_shape", "diagnostics"),
    ("5", "snapshot:sha256:", "snapshot:md5:", "invalid_shape", "snapshot_id"),
    ("6", '{"artifact_counts":', 'x {"artifact_counts":', "invalid_json", None),
    ("7", '"size":"1"', '"size":1', "invalid_shape", "configuration size"),
    ("8", '"snapshot_id":', '"shadow":null,"snapshot_id":', "invalid_shape", "members"),
    ("9", '"defaults":{', '"defaults":{"added":1,', "invalid_shape", "configuration members"),
)


def tampered(run_id, text):
    """The report's text with the fault of its run."""
    out = text
    for digit, old, new, _code, _detail in _TAMPER:
        out = F.when(run_id.endswith(digit), F.replace(text, F.lit(old), F.lit(new))).otherwise(out)
    return out


def tamper_sql(scope: str, reports: str) -> str:
    """Findings of the seeded faults; ``reports`` has ``run_id`` and ``text``."""
    return " union all ".join(
        f"select {scope} as scope_id, 70 as check_rank, 'run_report.{code}' as code, cast(null as varchar) as path, {f"'{detail}'" if detail else 'cast(null as varchar)'} as detail "
        f"from {reports} where r.run_id like '%{digit}' and contains(text, '{old}')"
        for digit, old, _new, code, detail in _TAMPER
    )


def whole_reports(v: Fixtures, runs: DataFrame | None = None):
    """``(run_id, text)`` of all runs or of ``runs``: run reports are records of a few kilobytes, and are read as such."""
    chunk = F.struct("chunk", "text")
    return _reports(v, runs).groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(chunk)), lambda x: x["text"]), "").alias("text"))


@query("run_report_audit", "with r as (" + _REPORT_SQL + ") " + tamper_sql("run_id", "r"))
def _(v: Fixtures):
    return records.run_report_audit(whole_reports(v).withColumn("report", tampered(F.col("run_id"), F.col("text"))))


# --- plug-ins ---------------------------------------------------------------
@query("register_producer", """
select 'api' as producer, bundle_id as scope_id, 'artifacts/api/' || path as path, case when starts_with(path, 'html/') and ends_with(path, '.html') then 'api-page'
  when ends_with(path, '.xml') or ends_with(path, '.tag') then 'producer-machine-output' else 'producer-asset' end as kind, sha256, cast(size as varchar) as size from producer_file
union all select 'text', bundle_id, path, 'text', sha256, cast(size as varchar) from payload
""")
def _(v: Fixtures):
    from ..operators import inventory

    registry = producers.ProducerRegistry()
    registry.register_producer(
        "api",
        lambda tables: inventory.classify_api(tables["files"]).select(
            F.col("bundle_id").alias("scope_id"), F.concat(F.lit("artifacts/api/"), "path").alias("path"), "kind", "sha256",
            F.col("size").cast("string").alias("size"),
        ),
    )
    registry.register_producer(
        "text",
        lambda tables: tables["documents"].select(
            F.col("bundle_id").alias("scope_id"), "path", F.lit("text").alias("kind"), "sha256", F.col("size").cast("string").alias("size")
        ),
    )
    return registry.collect({"files": v.producer_file, "documents": v.payload})


view("output_content", """
select user_id as scope, 'out/' || event_id as path, case when event_id % 2 = 0 then 'json' else 'text' end as kind, props as content from record_text
""")


@query("output_validator", """
select cast(scope as varchar) as scope_id, 0 as check_rank, 'process.output_malformed' as code, path, kind as detail
from output_content where (kind = 'json' and not json_valid(content)) or (kind = 'text' and not contains(content, '"k"'))
""")
def _(v: Fixtures):
    validators = {
        "json": json_text.is_valid,
        "text": lambda content: F.contains(content, F.lit('"k"')),
    }
    return producers.output_findings(v.output_content, "scope", validators)
