"""Stage results, dependencies, outputs, plans and run reports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import contract as c
from ..functions import batches as arrow_batches
from ..functions import ids, ordered
from ..session import stored
from .findings import faults, finding, union

ROOT = "snapshot"
#: Stages and dependencies of a run, together, that a task holds to place them; larger runs are placed in rounds by all tasks.
RUN_ROWS = 50_000


def process_evidence_audit(stage_result: DataFrame, accepted: tuple[int, ...] = (0,)) -> DataFrame:
    """Success against exit code and failure, failure kinds, wall time against measured time.

    Wall time is ``wall_seconds``, or the span from ``started_at`` to ``ended_at``.
    """
    rows = stage_result
    if "wall_seconds" not in rows.columns:
        span = (F.unix_micros("ended_at") - F.unix_micros("started_at")) / F.lit(1_000_000)
        rows = rows.withColumn("wall_seconds", span)
    if "failure_kind" not in rows.columns:
        rows = rows.withColumn("failure_kind", F.when(F.col("status") == "failed", F.lit("nonzero_exit")))
    wall, measured, exit_code, failure = (F.col(n) for n in ("wall_seconds", "duration_seconds", "exit_code", "failure_kind"))
    fine_exit = F.coalesce(exit_code.isin(*accepted), F.lit(False))
    code = "stage.process_result_invalid"
    return faults(
        rows, "run_id", 0, F.col("stage"),
        ((F.col("status") == "succeeded") & (~fine_exit | failure.isNotNull()), code, "success"),
        ((F.col("status") == "failed") & failure.isNull(), code, "failure kind"),
        (
            (failure == "spawn") & exit_code.isNotNull()
            | failure.isNotNull() & (failure != "spawn") & exit_code.isNull()
            | (failure == "nonzero_exit") & fine_exit,
            code, "exit code",
        ),
        ((wall < 0) | (measured < 0), code, "negative time"),
        (F.abs(wall - measured) > F.greatest(F.lit(1.0), F.lit(0.25) * F.greatest(wall, measured)), code, "duration"),
    )


def stage_attribution_check(record: DataFrame, stage_result: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Records ``(run_id, stage, path)`` may be credited only to stages in an allowed state.

    Outputs need ``succeeded``; logs any executed state.
    """
    status = stage_result.select("run_id", "stage", F.col("status").alias("_status"))
    joined = record.join(status, ["run_id", "stage"], "left")
    return faults(
        joined, "run_id", 0, F.col("path"),
        (F.col("_status").isNull(), "artifact_graph.missing_endpoint", F.col("stage")),
        (~F.col("_status").isin(*allowed), "artifact_graph.stage_output_mismatch", F.col("_status")),
    )


def output_declaration_diff(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """Declared against observed outputs; both sides grouped by their full key."""
    keys = ["run_id", "stage", "path", "kind"]
    stale = F.col("existed_before") if "existed_before" in observed.columns else F.lit(False)
    sides = (
        declared.select(*keys, F.lit(1).alias("d"), F.lit(0).alias("o"), F.lit(False).alias("s"))
        .unionByName(observed.select(*keys, F.lit(0).alias("d"), F.lit(1).alias("o"), stale.alias("s")))
        .groupBy(*keys)
        .agg(F.max("d").alias("d"), F.max("o").alias("o"), F.max("s").alias("s"))
    )
    return faults(
        sides, "run_id", 0, F.col("path"),
        ((F.col("d") == 1) & (F.col("o") == 0), "process.output_missing", F.col("stage")),
        ((F.col("d") == 0) & (F.col("o") == 1), "process.output_undeclared", F.col("stage")),
        (F.col("s"), "process.output_stale", F.col("stage")),
    )


def missing_inputs(stage_input: DataFrame, snapshot_file: DataFrame, stage: DataFrame) -> DataFrame:
    """Required inputs absent from the snapshot: ``(run_id, stage, path, code, blocking)``."""
    wanted = stage_input.select("snapshot_id", "path").distinct()
    absent = wanted.join(snapshot_file.select("snapshot_id", "path"), ["snapshot_id", "path"], "left_anti")
    hits = stage_input.join(absent, ["snapshot_id", "path"], "left_semi")
    policy = stage.select("run_id", "stage", "policy")
    return hits.join(policy, ["run_id", "stage"]).select(
        "run_id", "stage", "path", F.lit("plan.input_missing").alias("code"), (F.col("policy") == "required").alias("blocking")
    )


def stage_edge_check(stage: DataFrame, stage_dep: DataFrame, plan_edge: DataFrame) -> DataFrame:
    """The stored edge list must equal the dependencies, which must name known stages."""
    keys = ["run_id", "from_stage", "to_stage"]
    derived = stage_dep.select("run_id", F.col("dependency").alias("from_stage"), F.col("stage").alias("to_stage"))
    sides = (
        derived.select(*keys, F.lit(1).alias("d"), F.lit(0).alias("e"))
        .unionByName(plan_edge.select(*keys, F.lit(0).alias("d"), F.lit(1).alias("e")))
        .groupBy(*keys)
        .agg(F.sum("d").alias("d"), F.sum("e").alias("e"))
    )
    arrow = F.concat_ws(">", "from_stage", "to_stage")
    named = stage_dep.filter(F.col("dependency").isNotNull() & (F.col("dependency") != ROOT))
    known = stage.select("run_id", F.col("stage").alias("dependency"))
    unknown = named.join(known, ["run_id", "dependency"], "left_anti")
    return union(
        faults(
            sides, "run_id", 0, arrow,
            (F.col("d") > F.col("e"), "plan.edge_mismatch", "missing edge"),
            (F.col("d") < F.col("e"), "plan.edge_mismatch", "extra edge"),
        ),
        finding(unknown, "run_id", 0, "plan.unknown_dependency", F.concat_ws(">", "dependency", "stage")),
    )


# --- levels and outcomes ----------------------------------------------------

def _waits(stage: DataFrame, stage_dep: DataFrame) -> DataFrame:
    """Dependencies that known stages wait for, each once."""
    waits = stage_dep.filter(F.col("dependency").isNotNull() & (F.col("dependency") != ROOT)).select("run_id", "stage", "dependency").distinct()
    return waits.join(stage.select("run_id", "stage").distinct(), ["run_id", "stage"], "left_semi")


def _chains(nodes: DataFrame, waits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(pointers, edges)`` of plans whose chains are drawn together.

    A stage with a single dependency points to it; pointers are followed to where they point, so that after k rounds they
    span 2**k stages, until they end at an *anchor*: a stage with no or with several dependencies, or a name that is no
    stage. A pointer that has arrived is written once. ``pointers`` is ``(run_id, stage, anchor, steps, ok)``; ``edges`` has the
    same columns for each dependency of the stages with several. ``ok``: all stages passed on the way are ``ok``
    in ``nodes (run_id, stage, ok)``. What waits for a ring of such stages has no pointer, and edges of it no anchor.
    """
    counted = waits.join(waits.groupBy("run_id", "stage").agg(F.count(F.lit(1)).alias("n")), ["run_id", "stage"])
    own = nodes.select("run_id", F.col("stage").alias("anchor"), F.col("ok").alias("_own"))
    counted = stored(counted, "waits")
    open_ = counted.filter("n = 1").select("run_id", "stage", F.col("dependency").alias("anchor"), F.lit(1).cast("long").alias("steps"), F.lit(True).alias("ok"))
    open_ = stored(open_, "pointers")
    singles = open_.select("run_id", F.col("stage").alias("anchor"))
    left = open_.count()
    rounds, done = max(1, left).bit_length() + 1, []
    arrived = stored(open_.join(singles, ["run_id", "anchor"], "left_anti"), "arrived")
    done.append(arrived)
    open_ = stored(open_.join(singles, ["run_id", "anchor"], "left_semi"), "pointers")
    for _ in range(rounds):
        if open_.isEmpty():
            break
        ahead = union(*done, open_).select("run_id", F.col("stage").alias("_at"), F.col("anchor").alias("_next"), F.col("steps").alias("_steps"), F.col("ok").alias("_ok"))
        met = open_.join(own, ["run_id", "anchor"], "left").join(ahead.withColumnRenamed("_at", "anchor"), ["run_id", "anchor"])
        moved = met.select(
            "run_id", "stage", F.col("_next").alias("anchor"), (F.col("steps") + F.col("_steps")).alias("steps"),
            (F.col("ok") & F.coalesce("_own", F.lit(False)) & F.col("_ok")).alias("ok"),
        )
        moved = stored(moved, "pointers")
        done.append(stored(moved.join(singles, ["run_id", "anchor"], "left_anti"), "arrived"))
        open_ = moved.join(singles, ["run_id", "anchor"], "left_semi")
    pointers = union(*done)
    several = counted.filter("n > 1").select("run_id", "stage", F.col("dependency").alias("_at"))
    ways = pointers.select("run_id", F.col("stage").alias("_at"), "anchor", "steps", F.col("ok").alias("_ok"))
    single = singles.withColumnRenamed("anchor", "_at").withColumn("_single", F.lit(True))
    edges = (
        several.join(single, ["run_id", "_at"], "left").join(ways, ["run_id", "_at"], "left")
        .join(own.withColumnRenamed("anchor", "_at"), ["run_id", "_at"], "left")
    )
    passed = F.coalesce("_own", F.lit(False)) & F.col("_ok")
    edges = edges.select(
        "run_id", "stage", F.when(F.col("_single"), F.col("anchor")).otherwise(F.col("_at")).alias("anchor"),
        (F.coalesce("steps", F.lit(0)) + 1).cast("long").alias("steps"), F.coalesce(passed, F.col("_single").isNull()).alias("ok"),
    )
    return pointers, stored(edges, "chain-edges")


def place_run(own: dict[str, bool], waits: set[tuple[str, str]]) -> dict[str, tuple[int, bool]]:
    """Level of each stage that can be placed, and whether something it waits for, near or far, is not ``own`` sound."""
    left = dict.fromkeys(own, 0)
    followers: dict[str, list[str]] = {}
    for stage, dependency in waits:
        if stage in own:
            left[stage] += 1
            followers.setdefault(dependency, []).append(stage)
    level, broken = 0, dict.fromkeys(own, False)
    ready, placed = [stage for stage, n in left.items() if not n], {}
    while ready:
        after = []
        for stage in ready:
            placed[stage] = (level, broken[stage])
            for follower in followers.get(stage, ()):
                broken[follower] |= broken[stage] or not own[stage]
                left[follower] -= 1
                if not left[follower]:
                    after.append(follower)
        ready, level = after, level + 1
    return placed


def _placed(stage: DataFrame, stage_dep: DataFrame, sound: Column) -> tuple[DataFrame, DataFrame | None]:
    """``(run_id, stage, level, broken)`` of runs of at most RUN_ROWS rows, stored, and the ``run_id`` of the larger ones, if any.

    Rows are dealt by run once; a task reads its runs one after the other and holds one at a time.
    """
    schema = T.StructType([stage.schema["run_id"], *T.StructType.fromDDL("stage string, level int, broken boolean, large boolean")])
    arrow, most = to_arrow_schema(schema), RUN_ROWS

    def told(run, own: dict[str, bool], waits: set[tuple[str, str]]) -> Iterator[tuple]:
        # a null run or stage is met by nothing
        found = place_run(own, waits) if run is not None else {}
        yield from ((run, name, *found.get(name, (None, None)), False) for name in own)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        run, held, own, waits = None, 0, {}, set()
        for batch in batches:
            for owner, name, dependency, fine in arrow_batches.rows(batch):
                if owner != run:
                    if held <= most:
                        yield from told(run, own, waits)
                    run, held, own, waits = owner, 0, {}, set()
                held += 1
                if held == most + 1 and run is not None:
                    own, waits = {}, set()
                    yield run, None, None, None, True
                elif run is None and fine is not None:
                    yield None, name, None, None, False
                elif held <= most and fine is not None:
                    own[name] = own.get(name, True) and fine
                elif held <= most:
                    waits.add((name, dependency))
        if held <= most:
            yield from told(run, own, waits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return arrow_batches.batched(placed(batches), arrow)

    # rows of stages tell whether they are sound, rows of dependencies do not
    own = stage.select("run_id", "stage", F.lit(None).cast("string").alias("dependency"), F.coalesce(sound, F.lit(False)).alias("fine"))
    waits = stage_dep.filter(F.col("dependency").isNotNull() & (F.col("dependency") != ROOT) & F.col("stage").isNotNull())
    waits = waits.select("run_id", "stage", "dependency", F.lit(None).cast("boolean").alias("fine"))
    dealt = own.unionByName(waits).repartition("run_id").sortWithinPartitions("run_id")
    found = stored(dealt.mapInArrow(run, schema), "placed-runs")
    large = found.filter("large").select("run_id")
    small = found.filter("not large").drop("large")
    return small, None if large.isEmpty() else large


def _of_runs(table: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of the large runs, of which there are at most one for each RUN_ROWS rows of a table."""
    return table.join(F.broadcast(runs), "run_id", "left_semi")


def stage_levels(stage: DataFrame, stage_dep: DataFrame) -> DataFrame:
    """``(run_id, stage, level)``; level is null on a cycle or behind an unknown dependency.

    A run is placed by the task it is dealt to, level by level; runs of more than RUN_ROWS rows are placed by all tasks together
    (:func:`levels_in_rounds`).
    """
    small, large = _placed(stage, stage_dep, F.lit(True))
    levels = small.select("run_id", "stage", "level")
    levels = levels.filter("run_id is not null").unionByName(levels.filter("run_id is null").distinct())
    return levels if large is None else levels.unionByName(levels_in_rounds(_of_runs(stage, large), _of_runs(stage_dep, large)))


def levels_in_rounds(stage: DataFrame, stage_dep: DataFrame) -> DataFrame:
    """``(run_id, stage, level)``; level is null on a cycle or behind an unknown dependency.

    Chains are drawn together first (:func:`_chains`), in as many rounds as the logarithm of their length. What is left are
    stages with several dependencies. All runs place these together, a round for each that lies behind another; a round
    writes the stages it places, once, and the edges that still wait.
    """
    nodes = stored(stage.select("run_id", "stage").distinct().withColumn("ok", F.lit(True)), "stages")
    waits = stored(_waits(stage, stage_dep), "waits")
    pointers, edges = _chains(nodes, waits)
    new = stored(nodes.join(waits, ["run_id", "stage"], "left_anti").select("run_id", "stage", F.lit(0).cast("long").alias("level")), "placed")
    placed = [new]
    # a stage's edges, and one row without anchor for the highest of those that are answered
    open_ = edges.select("run_id", "stage", "anchor", F.col("anchor").isNull().alias("lost"), "steps", F.lit(None).cast("long").alias("best"))
    while not new.isEmpty() and not open_.isEmpty():
        told = open_.join(new.select("run_id", F.col("stage").alias("anchor"), "level"), ["run_id", "anchor"], "left")
        answered = F.col("level").isNotNull()
        told = told.select(
            "run_id", "stage", F.when(~answered, F.col("anchor")).alias("anchor"), "lost", "steps",
            F.when(answered, F.col("level") + F.col("steps")).otherwise(F.col("best")).alias("best"),
        )
        waiting = told.filter("anchor is not null or lost")
        best = told.filter("anchor is null and not lost").groupBy("run_id", "stage").agg(F.max("best").alias("best"))
        state = waiting.unionByName(best.select("run_id", "stage", F.lit(None).cast("string").alias("anchor"), F.lit(False).alias("lost"), F.lit(None).cast("long").alias("steps"), "best"))
        state = stored(state, "open-edges")
        still = state.filter("anchor is not null or lost").select("run_id", "stage").distinct()
        new = state.join(still, ["run_id", "stage"], "left_anti").select("run_id", "stage", F.col("best").alias("level"))
        new = stored(new, "placed")
        placed.append(new)
        open_ = state.join(still, ["run_id", "stage"], "left_semi")
    anchors = union(*placed)
    along = pointers.join(anchors.withColumnRenamed("stage", "anchor"), ["run_id", "anchor"]).select("run_id", "stage", (F.col("level") + F.col("steps")).alias("level"))
    found = anchors.unionByName(along)
    return nodes.select("run_id", "stage").join(found, ["run_id", "stage"], "left").select("run_id", "stage", F.col("level").cast("int").alias("level"))


def level_findings(levels: DataFrame) -> DataFrame:
    stuck = levels.filter(F.col("level").isNull())
    return finding(stuck, "run_id", 0, "orchestration.invalid_dependencies", F.col("stage"))


def stage_outcomes(stage: DataFrame, stage_dep: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """``(run_id, stage, policy, status)`` after dependencies are taken into account.

    ``stage`` has ``policy``, the outcome ``own_status`` the stage would have by
    itself, and ``static_fault``.  Static faults block a required stage and skip
    an optional one; a dependency that did not succeed blocks; a failed optional
    stage is degraded.  Stages without level get no result.

    A stage succeeds if it and all that it waits for do so by themselves. That is told where the levels of a run are
    placed; for runs of more than RUN_ROWS rows, and with ``levels`` given, failure spreads in rounds (:func:`outcomes_in_rounds`).
    """
    if levels is not None:
        return outcomes_in_rounds(stage, stage_dep, levels)
    small, large = _placed(stage, stage_dep, _sound())
    broken = small.filter("level is not null").select("run_id", "stage", F.col("broken").alias("_broken"))
    told = stage.join(broken, ["run_id", "stage"]).select("run_id", "stage", "policy", _status().alias("status"))
    if large is None:
        return told
    stage, stage_dep = _of_runs(stage, large), _of_runs(stage_dep, large)
    return told.unionByName(outcomes_in_rounds(stage, stage_dep, levels_in_rounds(stage, stage_dep)))


def _sound() -> Column:
    return ~F.coalesce(F.col("static_fault"), F.lit(False)) & F.col("own_status").eqNullSafe("succeeded")


def _status() -> Column:
    required = F.col("policy") == "required"
    own = F.when((F.col("own_status") == "failed") & ~required, "degraded").otherwise(F.col("own_status"))
    return (
        F.when(F.col("static_fault"), F.when(required, "blocked").otherwise("skipped"))
        .when(F.col("_broken"), "blocked")
        .otherwise(own)
    )


def outcomes_in_rounds(stage: DataFrame, stage_dep: DataFrame, levels: DataFrame) -> DataFrame:
    """:func:`stage_outcomes` of runs of any size.

    Along chains failure is read off their pointers; between stages with several dependencies it spreads in rounds,
    each of which writes only the stages it newly reaches.
    """
    levels = stored(levels)
    staged = stored(stage.join(levels.filter("level is not null"), ["run_id", "stage"]), "staged")
    nodes = stored(staged.groupBy("run_id", "stage").agg(F.min(_sound()).alias("ok")), "own-outcomes")
    waits = stored(_waits(nodes, stage_dep), "waits")
    pointers, edges = _chains(nodes, waits)
    own_bad = nodes.filter("not ok").select("run_id", "stage")
    single = pointers.select("run_id", "stage")
    # anchors that fail by themselves, or over a way that does
    new = own_bad.join(single, ["run_id", "stage"], "left_anti").unionByName(edges.filter("not ok").select("run_id", "stage")).distinct()
    new = stored(new, "failed")
    failed = [new]
    while not new.isEmpty():
        hit = edges.join(new.withColumnRenamed("stage", "anchor"), ["run_id", "anchor"], "left_semi").select("run_id", "stage").distinct()
        new = stored(hit.join(union(*failed), ["run_id", "stage"], "left_anti"), "failed")
        failed.append(new)
    bad = union(*failed).withColumnRenamed("stage", "anchor").withColumn("_bad", F.lit(True))
    told = pointers.unionByName(edges).join(bad, ["run_id", "anchor"], "left")
    broken = told.groupBy("run_id", "stage").agg(F.max(~F.col("ok") | F.col("_bad").isNotNull()).alias("_broken"))
    return staged.join(broken, ["run_id", "stage"], "left").select("run_id", "stage", "policy", _status().alias("status"))


def failed_dependencies(outcome: DataFrame, stage_dep: DataFrame) -> DataFrame:
    """One finding per dependency that kept a stage from running."""
    waits = stage_dep.filter(F.col("dependency").isNotNull() & (F.col("dependency") != ROOT))
    outcome = stored(outcome.select("run_id", "stage", "status"), "outcomes")
    good = outcome.filter("status = 'succeeded'").select("run_id", F.col("stage").alias("dependency"))
    blocked = outcome.filter("status = 'blocked'").select("run_id", "stage")
    hits = waits.join(blocked, ["run_id", "stage"], "left_semi").join(good, ["run_id", "dependency"], "left_anti")
    return finding(hits, "run_id", 0, "stage.dependency_failed", F.col("stage"), F.col("dependency"))


# --- roll-ups ---------------------------------------------------------------

def required_stage_decision(stage_result: DataFrame) -> DataFrame:
    """``satisfied`` iff every required stage succeeded; none required counts as satisfied."""
    unmet = F.count_if((F.col("policy") == "required") & (F.col("status") != "succeeded"))
    return stage_result.groupBy("run_id").agg(F.when(unmet == 0, "satisfied").otherwise("blocked").alias("decision"))


def _stage_lines(stage_result: DataFrame, first_part: int) -> DataFrame:
    listed = stage_result.filter(F.col("status").isin("degraded", "skipped"))
    text = ids.json_string(F.col("stage"))
    return union(
        ordered.lines(listed.filter("status = 'degraded'"), ["run_id"], F.col("stage"), text, first_part),
        ordered.lines(listed.filter("status = 'skipped'"), ["run_id"], F.col("stage"), text, first_part + 1),
    )


def optional_stage_rollup(stage_result: DataFrame) -> DataFrame:
    """JSON text of the sorted degraded and skipped lists of each run, by chunk."""
    glue = stage_result.select("run_id").distinct().select(
        "run_id", F.array(F.lit('{"degraded":['), F.lit('],"skipped":['), F.lit("]}")).alias("glue")
    )
    return ordered.ordered_text(_stage_lines(stage_result, 0), ["run_id"], glue, parts=2)


def stage_status_overlap(listed: DataFrame) -> DataFrame:
    """Stages ``(run_id, stage, status)`` that are both degraded and skipped."""
    both = listed.groupBy("run_id", "stage").agg(
        F.max((F.col("status") == "degraded").cast("int")).alias("d"), F.max((F.col("status") == "skipped").cast("int")).alias("s")
    )
    hits = both.filter("d = 1 and s = 1")
    return finding(hits, "run_id", 70, "run_report.invalid_shape", F.col("stage"), "stage overlap")


def plan_stage_record(**columns: Column) -> Column:
    """Canonical text of one stage of a plan; lists are array columns."""
    none = F.array().cast("array<string>")
    return ids.canonical(
        {
            "adapter": {"selector": columns["selector"]},
            "adapter_options": columns.get("adapter_options", F.struct()),
            "capability": columns.get("capability", None),
            "dependencies": columns.get("dependencies", none),
            "expected_outputs": columns.get("expected_outputs", none),
            "id": columns["stage"],
            "invocation": {"argv": columns.get("argv", none)},
            "policy": columns["policy"],
            "required_inputs": columns.get("required_inputs", none),
            "workspace": columns["workspace"],
        }
    )


def plan_digest(
    plan: DataFrame, stage: DataFrame, stage_dep: DataFrame, diagnostic: DataFrame,
    namespace: str = c.DEFAULT_NAMESPACE,
) -> DataFrame:
    """``(run_id, plan_sha256)``.

    ``plan`` is ``(run_id, configuration_json, snapshot_json)``, ``stage`` is
    ``(run_id, stage, record_json)``, ``diagnostic`` is
    ``(run_id, stage, code, message, blocking)``.
    """
    glue = plan.select(
        "run_id",
        F.array(
            F.concat(F.lit('{"identity":{"configuration":'), "configuration_json", F.lit(',"diagnostics":[')),
            F.lit('],"edges":['),
            F.concat(
                F.lit('],"schema":"%s","snapshot":' % c.schema_id("plan.v1", namespace)), "snapshot_json", F.lit(',"stages":[')
            ),
            F.lit(']},"kind":"plan"}'),
        ).alias("glue"),
    )
    gap = F.lit("\x00")
    listing = union(
        ordered.lines(
            diagnostic, ["run_id"], F.concat("stage", gap, "code"),
            ids.canonical({n: F.col(n) for n in ("blocking", "code", "message", "stage")}), 0,
        ),
        ordered.lines(
            stage_dep, ["run_id"], F.concat("dependency", gap, "stage"),
            ids.canonical({"from": F.col("dependency"), "to": F.col("stage")}), 1,
        ),
        ordered.lines(stage, ["run_id"], F.col("stage"), F.col("record_json"), 2),
    )
    digest = ordered.ordered_digest(listing, ["run_id"], glue, parts=3)
    return digest.withColumnRenamed("sha256", "plan_sha256")


def report_diagnostics(stage_result: DataFrame, diagnostic: DataFrame) -> DataFrame:
    """Diagnostics of a run with their severity: optional stages warn, required ones err."""
    policy = stage_result.select("run_id", "stage", F.col("policy").alias("_policy"))
    return diagnostic.join(policy, ["run_id", "stage"]).withColumn(
        "severity", F.when(F.col("_policy") == "optional", "warning").otherwise("error")
    ).drop("_policy")


def run_report(
    run: DataFrame, artifact_count: DataFrame, stage_result: DataFrame, diagnostic: DataFrame,
    namespace: str = c.DEFAULT_NAMESPACE,
) -> DataFrame:
    """Canonical text of each run report: ``(run_id, chunk, text)``.

    ``run`` is ``(run_id, configuration_json, plan_sha256, snapshot_id, version)``,
    ``artifact_count`` is ``(run_id, kind, count)`` with text counts, ``stage_result``
    has ``ord`` and ``digest``, ``diagnostic`` has ``ord``, cleaned code and message.
    """
    claim = ids.canonical(
        {"does_not_establish": F.array(*[F.lit(name) for name in c.CLAIM_EXCLUSIONS]), "scope": c.CLAIM_SCOPE}
    )
    decision = required_stage_decision(stage_result)
    glue = run.join(decision, "run_id", "left").select(
        "run_id",
        F.array(
            F.lit('{"artifact_counts":['),
            F.concat(
                F.lit('],"claim_boundary":'), claim, F.lit(',"configuration_identity":'), "configuration_json",
                F.lit(',"diagnostics":['),
            ),
            F.concat(
                F.lit('],"inspector":{"version":'), ids.json_string(F.col("version")), F.lit('},"optional_stages":{"degraded":[')
            ),
            F.lit('],"skipped":['),
            F.concat(
                F.lit(']},"plan_sha256":"'), "plan_sha256", F.lit('","required_stage_decision":"'),
                F.coalesce("decision", F.lit("satisfied")),
                F.lit('","schema":"%s","snapshot_id":"' % c.schema_id("run.v1", namespace)), "snapshot_id",
                F.lit('","stage_result_digests":['),
            ),
            F.lit("]}"),
        ).alias("glue"),
    )
    rows = report_diagnostics(stage_result, diagnostic)
    entry = ids.canonical(
        {"code": F.col("code"), "message": F.col("message"), "path": None, "severity": F.col("severity")}
    )
    listing = union(
        ordered.lines(artifact_count, ["run_id"], F.col("kind"), ids.canonical({"count": F.col("count"), "kind": F.col("kind")}), 0),
        ordered.lines(rows, ["run_id"], F.col("ord"), entry, 1),
        _stage_lines(stage_result, 2),
        ordered.lines(stage_result, ["run_id"], F.col("ord"), ids.json_string(F.col("digest")), 4),
    )
    return ordered.ordered_text(listing, ["run_id"], glue, parts=5)
