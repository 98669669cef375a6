"""Audits of single records: paths, tokens, JSON texts, numbers, reports."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import contract as c
from ..functions import ids, json_text, json_walk, paths, text
from . import configuration
from .findings import faults, finding, union


def path_profile_audit(table: DataFrame, scope: str, column: str = "path", rank: int = 10) -> DataFrame:
    """One finding per broken path rule."""
    path = F.col(column)
    broken = table.select(scope, column, F.explode(paths.profile_violations(path)).alias("_rule"))
    not_nfc = text.only_not_nfc(table.select(scope, column), column)
    return union(
        finding(broken, scope, rank, "path.invalid", path, F.col("_rule")),
        finding(not_nfc, scope, rank, "path.invalid", path, "nfc"),
    )


def reserved_path_audit(table: DataFrame, scope: str, column: str = "path", rank: int = 10) -> DataFrame:
    """Entries that take the name of a control file; a listing holds those names rightly."""
    return finding(table.filter(F.col(column).isin(*c.RESERVED_PATHS)), scope, rank, "manifest.reserved_path", F.col(column))


def token_profile_audit(
    table: DataFrame, scope: str, rules: Mapping[str, str], record: str, code: str = "record.invalid_field"
) -> DataFrame:
    """Every field of ``rules`` must match its pattern; null never does."""
    checks = [
        (~F.coalesce(F.col(field).cast("string").rlike(pattern), F.lit(False)), code, field)
        for field, pattern in rules.items()
    ]
    return faults(table, scope, 25, F.col(record), *checks)


def closed_record_audit(
    table: DataFrame, scope: str, json: str, keys: tuple[str, ...], code: str = "manifest.invalid_shape"
) -> DataFrame:
    """Members missing from, or unknown to, an exact key set; texts that are no JSON object."""
    expected = F.array(*[F.lit(key) for key in keys])
    rows = json_text.with_reading(table.select(scope, json), json, "_read").select(scope, F.col("_read.valid"), F.col("_read.keys").alias("_keys"))
    family = code.rsplit(".", 1)[0]
    told = rows.filter(F.col("_keys").isNotNull())
    parts = [
        finding(rows.filter(~F.col("valid")), scope, 21, f"{family}.invalid_json"),
        finding(rows.filter(F.col("valid") & F.col("_keys").isNull()), scope, 23, code, None, "not an object"),
    ]
    for names, detail in ((F.array_except(expected, "_keys"), "missing"), (F.array_except("_keys", expected), "unknown")):
        parts.append(finding(told.select(scope, F.explode(names).alias("_name")), scope, 23, code, F.col("_name"), detail))
    return union(*parts)


def duplicate_member_audit(table: DataFrame, scope: str, json: str, code: str = "manifest.duplicate_member") -> DataFrame:
    """Member names that occur again in one object, at any depth and inside arrays.

    Names of the outer object are listed; inner repetitions are one finding each text. Texts that
    are no JSON are the concern of :func:`closed_record_audit`.
    """
    rows = json_text.with_reading(table.select(scope, json), json, "_read").select(scope, "_read.*")
    names = rows.filter("size(repeated) > 0").select(scope, F.explode("repeated").alias("_name"))
    return union(
        finding(names, scope, 20, code, F.col("_name"), "top"),
        finding(rows.filter("nested"), scope, 20, code, None, "nested"),
    )


def canonical_json_audit(table: DataFrame, scope: str, json: str, schema: str, code: str = "manifest.noncanonical") -> DataFrame:
    """Stored text must equal its canonical re-encoding under ``schema``.

    ``schema`` declares members in sorted order, so encoding the parsed value
    again gives the canonical text.
    """
    parsed = F.from_json(F.col(json), schema)
    again = ids.canonical_text(parsed)
    bad = table.filter(~again.eqNullSafe(F.col(json)))
    return finding(bad, scope, 22, code)


def safe_number_audit(table: DataFrame, scope: str, value: str, path: Column | None = None) -> DataFrame:
    """JSON scalars: integers only, no ``-0`` or leading zeros, within the safe range.

    ``value`` holds the JSON text of one scalar; texts that start like a number
    are numbers.
    """
    token = F.col(value)
    number = token.rlike(r"^[-+.0-9]")
    integer = token.rlike(c.INTEGER)
    digits = F.length(F.regexp_replace(token, "^-", ""))
    beyond = F.when(digits > 16, F.lit(True)).when(
        digits >= 16, F.abs(token.try_cast("decimal(38,0)")) > F.lit(c.SAFE_INTEGER)
    ).otherwise(F.lit(False))
    return faults(
        table, scope, 24, path if path is not None else token,
        (number & ~integer, "configuration.invalid_number", "token"),
        (integer & beyond, "configuration.invalid_number", "range"),
    )


# --- run reports ------------------------------------------------------------

def run_report_rules(namespace: str = c.DEFAULT_NAMESPACE) -> list[json_walk.Rule]:
    """Types, exact members, patterns and allowed values at every level of a run report."""
    rule = json_walk.Rule
    text, entries = ("string",), ("array",)
    return [
        rule("", ("object",), "members", members=(
            "artifact_counts", "claim_boundary", "configuration_identity", "diagnostics", "inspector", "optional_stages",
            "plan_sha256", "required_stage_decision", "schema", "snapshot_id", "stage_result_digests",
        )),
        rule("/schema", text, None, allowed=(c.schema_id("run.v1", namespace),), code="run_report.unsupported_schema"),
        rule("/claim_boundary", ("object",), "claim_boundary", members=("does_not_establish", "scope")),
        rule("/claim_boundary/scope", text, "claim_boundary", allowed=(c.CLAIM_SCOPE,)),
        rule("/claim_boundary/does_not_establish", entries, "claim_boundary"),
        rule("/claim_boundary/does_not_establish/[]", text, "claim_boundary"),
        rule("/artifact_counts", entries, "artifact_counts"),
        rule("/artifact_counts/[]", ("object",), "artifact_counts", members=("count", "kind")),
        rule("/artifact_counts/[]/count", text, "artifact_counts", pattern=c.POSITIVE_SIZE),
        rule("/artifact_counts/[]/kind", text, "artifact_counts", pattern=c.KIND),
        rule("/optional_stages", ("object",), "optional_stages", members=("degraded", "skipped")),
        *[rule(f"/optional_stages/{name}", entries, "optional_stages") for name in ("degraded", "skipped")],
        *[rule(f"/optional_stages/{name}/[]", text, "optional_stages", pattern=c.TOKEN) for name in ("degraded", "skipped")],
        rule("/diagnostics", entries, "diagnostics"),
        rule("/diagnostics/[]", ("object",), "diagnostics", members=("code", "message", "path", "severity")),
        rule("/diagnostics/[]/code", text, "diagnostics", pattern=c.TOKEN),
        rule("/diagnostics/[]/message", text, "diagnostics", pattern=r"(?s)\A\P{Cc}+\z"),
        rule("/diagnostics/[]/path", ("string", "null"), "diagnostics"),
        rule("/diagnostics/[]/severity", text, "diagnostics", allowed=c.SEVERITIES),
        rule("/inspector", ("object",), "version", members=("version",)),
        rule("/inspector/version", text, "version", pattern=c.VERSION),
        rule("/stage_result_digests", entries, "stage_result_digests"),
        rule("/stage_result_digests/[]", text, "stage_result_digests", pattern=c.HEX64),
        rule("/plan_sha256", text, "plan_sha256", pattern=c.HEX64),
        rule("/snapshot_id", text, "snapshot_id", pattern=c.SNAPSHOT_ID),
        rule("/required_stage_decision", text, "decision", allowed=c.DECISIONS),
        *configuration.identity_rules("/configuration_identity", "configuration ", namespace),
    ]


def run_report_audit(
    run_report: DataFrame, scope: str = "run_id", json: str = "report", namespace: str = c.DEFAULT_NAMESPACE
) -> DataFrame:
    """All rules of a run report, strictly read; each broken rule is one finding named in ``detail``.

    A text that is no JSON, a repeated member and text other than its canonical form have codes of their own. Everything
    else is told on the rows of one strict walk (``json_walk``), in one pass that stores and shuffles none but broken
    ones: exact members and types at every level, among them those of the configuration identity, patterns, order and
    repetition in lists.
    """
    code = "run_report.invalid_shape"
    identity = "/configuration_identity"
    wanted = {
        "kinds": "/artifact_counts/[]/kind", "degraded": "/optional_stages/degraded/[]", "skipped": "/optional_stages/skipped/[]",
        "digests": "/stage_result_digests/[]", "claims": "/claim_boundary/does_not_establish/[]", "pointers": f"{identity}/overrides/[]/pointer",
    }
    rules = run_report_rules(namespace)
    nodes = json_walk.with_rules(json_walk.read(run_report, [scope], json, list(wanted.values())), rules, code)
    kinds, degraded, skipped, digests, claims, pointers = (F.col("listed")[at] for at in range(len(wanted)))
    value, outer, text = F.col("value"), F.col("outer"), F.col("type") == "string"
    valid = F.col("type") != json_walk.INVALID
    sound = outer & valid
    claim = F.array(*[F.lit(name) for name in c.CLAIM_EXCLUSIONS])
    single = [
        *[(valid & condition, own, detail) for condition, own, detail in json_walk.tests(rules)],
        ((F.col("path") == "/diagnostics/[]/path") & text & paths.breaks_profile(value), code, "diagnostics"),
        ((F.col("path") == f"{identity}/controlled_input/path") & text & paths.breaks_profile(value), "path.invalid", value),
        (configuration.is_unsafe(identity), code, "configuration override value"),
    ]
    # what concerns a report as a whole; one without the list of claims has been told that a member is missing
    whole = [
        (outer & ~valid, "run_report.invalid_json", None),
        (sound & F.col("repeated"), "run_report.duplicate_member", None),
        (sound & ~F.col("repeated") & ~F.col("canonical"), "run_report.noncanonical", None),
        (sound & (claims != claim), code, "claim_boundary"),
        (sound & ~json_walk.ascending(kinds), code, "artifact_counts"),
        *[(sound & ~json_walk.ascending(names), code, "optional_stages") for names in (degraded, skipped)],
        (sound & F.arrays_overlap(degraded, skipped), code, "stage overlap"),
        (sound & (F.size(F.array_distinct(digests)) != F.size(digests)), code, "stage_result_digests"),
        *[(sound & condition, own, detail) for condition, own, detail in configuration.pointer_rules(pointers, "configuration ")],
    ]
    # nearly all values are sound by their rule; few places are asked more than that, and few values are outer ones
    asked = F.col("path").isin("/diagnostics/[]/path", f"{identity}/controlled_input/path") | F.col("type").isin("number", "integer")
    suspect = outer | asked | reduce(Column.__or__, [condition for condition, _, _ in json_walk.tests(rules)])
    # several values may break one rule of a report
    owner = F.struct("doc", F.col(scope).cast("string").alias("owner"))
    found = faults(nodes.withColumn("_of", F.to_json(owner)), "_of", 70, None, *single, *whole, suspect=suspect).distinct()
    return found.select(F.get_json_object("scope_id", "$.owner").alias("scope_id"), "check_rank", "code", "path", "detail")


# --- text cleaning ----------------------------------------------------------

def redact_secrets(log_text: DataFrame, secret: DataFrame, column: str = "text") -> DataFrame:
    """Replace every protected literal of a row's run, in list order, by a fixed mark.

    ``secret`` is ``(run_id, ord, literal)``. The literals of a run are its configuration, so they
    travel as one ordered array; null and empty ones protect nothing.
    """
    useful = secret.filter(F.coalesce(F.col("literal"), F.lit("")) != "")
    listed = F.array_sort(F.collect_list(F.struct("ord", "literal")))
    per_run = useful.groupBy("run_id").agg(F.transform(listed, lambda item: item["literal"]).alias("_literals"))
    redacted = F.aggregate(
        F.col("_literals"), F.col(column), lambda done, literal: F.replace(done, literal, F.lit(c.REDACTED))
    )
    return (
        log_text.join(per_run, "run_id", "left")
        .withColumn(column, F.coalesce(redacted, F.col(column)))
        .select(*log_text.columns)
    )


def clean_diagnostics(diagnostic: DataFrame) -> DataFrame:
    """Normalise code and message for the run report."""
    spaced = F.regexp_replace("message", text.CONTROL, " ")
    cleaned = F.regexp_replace(spaced, r"\A\p{Z}+|\p{Z}+\z", "")
    return diagnostic.withColumn(
        "code", F.when(F.col("code").rlike(c.TOKEN), F.col("code")).otherwise(F.lit("stage.invalid_diagnostic_code"))
    ).withColumn("message", F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("stage diagnostic unavailable")))
