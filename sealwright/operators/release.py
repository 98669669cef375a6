"""Publication results, release pointers, policies, packages and signatures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import contract as c
from ..functions import ids, json_walk, ordered, paths, text
from .findings import faults, finding, union


def _lookup(key: Column, table: Mapping[str, int]) -> Column:
    chain = None
    for name, value in table.items():
        chain = F.when(key == name, F.lit(value)) if chain is None else chain.when(key == name, F.lit(value))
    return chain


_BINDINGS = ("bundle_id", "release_path", "run_report_sha256", "prior_current_target", "intended_current_target")


def publication_result_audit(publication: DataFrame) -> DataFrame:
    """Which ids and targets each state must or must not carry, and its exit code."""
    state, release = F.col("state"), F.concat(F.lit("releases/"), "bundle_id")
    path, intended, prior = (F.col(n) for n in ("release_path", "intended_current_target", "prior_current_target"))
    report = F.col("run_report_sha256")
    bound = F.col("bundle_id").isNotNull() & path.eqNullSafe(release) & report.isNotNull()
    expected = _lookup(state, c.PUBLICATION_EXIT)
    code = "publication.inconsistent_result"

    def off_profile(column: Column, pattern: str) -> Column:
        return column.isNotNull() & ~column.rlike(pattern)

    durable = state.isin("durable-success", "recovered-durable-success")
    idle = state.isin("not-attempted", "recovered-no-commit", "recovery-blocked")
    early = state == "definite-pre-commit-failure"
    anything = F.lit(False)
    for name in _BINDINGS:
        anything = anything | F.col(name).isNotNull()
    return faults(
        publication, "run_id", 0, state,
        (~F.coalesce(state.isin(*c.PUBLICATION_EXIT), F.lit(False)), code, "state"),
        (F.col("exit_code") != expected, code, "exit code"),
        (off_profile(F.col("bundle_id"), c.BUNDLE_ID) | off_profile(report, c.HEX64), code, "identity"),
        (
            off_profile(path, c.RELEASE_TARGET) | off_profile(prior, c.RELEASE_TARGET) | off_profile(intended, c.RELEASE_TARGET),
            code, "target profile",
        ),
        (durable & ~bound, code, "durable binding"),
        ((state == "durable-success") & ~intended.eqNullSafe(release), code, "durable target"),
        ((state == "recovered-durable-success") & (~prior.eqNullSafe(release) | intended.isNotNull()), code, "recovered target"),
        ((state == "commit-indeterminate") & ~(bound & intended.eqNullSafe(release)), code, "indeterminate binding"),
        (
            early & F.when(F.col("bundle_id").isNull(), path.isNotNull() | intended.isNotNull()).otherwise(
                ~(bound & intended.eqNullSafe(release))
            ),
            code, "pre-commit binding",
        ),
        (idle & anything, code, "unexpected binding"),
    )


def process_result_audit(result: DataFrame) -> DataFrame:
    """Status of plan, build and verify results against flags, states and exit codes.

    Columns: ``result_id, command, run_id, expected_run_id, status, blocking, state,
    valid, bundle_id, has_configuration, has_source, has_plan, exit_code``.
    """
    command, status, state = F.col("command"), F.col("status"), F.col("state")
    plan, build, verify = command == "plan", command == "build", command == "verify"
    durable = F.coalesce(state.isin("durable-success", "recovered-durable-success"), F.lit(False))
    recovery = F.coalesce(
        state.isin("recovered-durable-success", "recovered-no-commit", "recovery-blocked"), F.lit(False)
    )
    carries = F.col("has_configuration") | F.col("has_source") | F.col("has_plan")
    known = F.when(plan, status.isin("succeeded", "blocked", "failed")).otherwise(status.isin("succeeded", "failed"))
    success = F.when(build, durable).otherwise(status == "succeeded")
    expected = F.when(build, _lookup(state, c.PUBLICATION_EXIT)).otherwise(F.when(success, 0).otherwise(1))
    bundle_ok = F.coalesce(F.col("bundle_id").rlike(c.BUNDLE_ID), F.lit(False))
    code = "process.inconsistent_result"
    return faults(
        result, "result_id", 0, command,
        (~F.coalesce(command.isin("plan", "build", "verify"), F.lit(False)), code, "command"),
        (~F.coalesce(known, F.lit(False)), code, "status"),
        (plan & (status != "failed") & ((status == "blocked") != F.col("blocking")), code, "blocking"),
        (plan & (status != "failed") & ~(F.col("has_configuration") & F.col("has_source") & F.col("has_plan")), code, "missing binding"),
        (plan & (status == "failed") & carries, code, "untrusted binding"),
        (build & recovery & ~F.col("run_id").eqNullSafe("recovery"), code, "recovery run"),
        (build & ~recovery & (F.col("run_id") == "recovery"), code, "reserved run"),
        (
            build & ~recovery & (F.col("run_id") != "recovery") & ~F.col("run_id").eqNullSafe(F.col("expected_run_id")),
            code, "run correlation",
        ),
        (build & ((status == "succeeded") != durable), code, "publication state"),
        (build & (state != "not-attempted") & ~(F.col("has_configuration") & F.col("has_source")), code, "missing binding"),
        (build & (state == "not-attempted") & F.col("has_source") & ~F.col("has_configuration"), code, "source without configuration"),
        (verify & (status == "succeeded") & ~(F.coalesce(F.col("valid"), F.lit(False)) & bundle_ok), code, "verification"),
        (verify & (status == "failed") & (F.coalesce(F.col("valid"), F.lit(True)) | F.col("bundle_id").isNotNull()), code, "verification"),
        (F.col("exit_code") != expected, code, "exit code"),
    )


def release_policy_audit(
    policy: DataFrame, scope: str, json: str, *, package: tuple[str, str], required_assets: Sequence[str],
    operating_systems: Sequence[str], python: Sequence[str], protocols: Sequence[str],
    namespace: str = c.DEFAULT_NAMESPACE,
) -> DataFrame:
    """Closed policy object, exact declarations, complete and sorted asset bindings, strictly read.

    A text that is no JSON object of exactly the five members has that finding only. Closed are also ``package`` and
    ``support``; a value of another type breaks the rule of its member.
    """
    own = c.schema_id("release-policy.v1", namespace)
    nodes = json_walk.walk(json_walk.dealt(policy.select(scope, json)), [scope], json)
    code, text = "contract.policy_violation", ("string",)
    rule = json_walk.Rule
    named = {"operating_systems": ("operating systems", operating_systems), "python": ("python", python), "process_protocols": ("protocols", protocols), "schemas": ("schemas", None)}
    rules = [
        rule("", ("object",), "members", members=("contract_assets", "fixture_revision", "package", "schema", "support")),
        rule("/schema", text, "schema", allowed=(own,)),
        rule("/package", ("object",), "package", members=("name", "version")),
        rule("/package/name", text, "package", allowed=(package[0],)),
        rule("/package/version", text, "package", allowed=(package[1],)),
        rule("/fixture_revision", ("integer",), "fixture revision"),
        rule("/contract_assets", ("object",), "asset set", members=tuple(required_assets)),
        rule("/support", ("object",), "support", members=tuple(named)),
        *[rule(f"/support/{name}", ("array",), detail) for name, (detail, _) in named.items()],
        *[rule(f"/support/{name}/[]", text, detail) for name, (detail, _) in named.items()],
    ]
    bad = json_walk.broken(nodes, rules, code)
    outer = bad.filter("at = ''").select("doc").distinct()
    listed = json_walk.lists(nodes, [scope], **{name: f"/support/{name}/[]" for name in named})
    there = nodes.filter(F.col("path").startswith("/support/") & (F.col("type") == "array")).groupBy("doc").agg(F.collect_set("path").alias("_there"))
    listed = listed.join(there, "doc")
    revision = (F.col("path") == "/fixture_revision") & (F.col("type") == "integer") & ~F.coalesce(F.col("value").try_cast("decimal(38,0)") >= 1, F.lit(False))
    asset = (F.col("parent") == "/contract_assets") & ~((F.col("type") == "string") & F.coalesce(F.col("value").rlike(c.HEX64), F.lit(False)))
    assets = (F.col("path") == "/contract_assets") & (F.col("type") == "object") & (F.array_sort("members") != F.col("members"))

    def given(name: str, broken: Column) -> Column:
        return F.array_contains("_there", f"/support/{name}") & broken

    def exactly(wanted: Sequence[str]) -> Column:
        return F.array(*[F.lit(value) for value in wanted])

    found = union(
        finding(bad, "doc", 0, F.col("code"), None, F.col("detail")),
        finding(nodes.filter(revision), "doc", 0, code, None, "fixture revision"),
        finding(nodes.filter(asset), "doc", 0, code, None, "asset digest"),
        finding(nodes.filter(assets), "doc", 0, code, None, "asset order"),
        finding(nodes.filter("repeated"), "doc", 0, code, None, "repeated member"),
        faults(
            listed, "doc", 0, None,
            *[(given(name, F.col(name) != exactly(wanted)), code, detail) for name, (detail, wanted) in named.items() if wanted is not None],
            (given("schemas", ~F.array_contains("schemas", own) | ~json_walk.ascending(F.col("schemas"))), code, "schemas"),
        ),
    )
    found = found.withColumn("doc", F.col("scope_id").cast("long")).distinct()
    found = found.join(outer, "doc", "left_anti").unionByName(found.filter("detail = 'members'").join(outer, "doc", "left_semi"))
    owners = nodes.filter("at = ''").select("doc", F.col(scope).cast("string").alias("_owner"))
    return found.join(owners, "doc").select(F.col("_owner").alias("scope_id"), "check_rank", "code", "path", "detail")


def contract_change_gate(policy_history: DataFrame, slice_width: int | None = None) -> DataFrame:
    """Revisions whose contracts changed need a new version and a new fixture revision.

    Each revision meets its predecessor of the same project, the neighbour in one sort over all tasks
    (``ordered.with_previous``); how far apart the numbers of revisions lie does not matter. ``slice_width`` has no meaning
    any more.
    """
    record = ["revision_order", "version", "fixture_revision", "contract_digest"]
    paired = ordered.with_previous(policy_history.select("project", *record), "project", ["revision_order"], record)
    changed = F.col("_prev").isNotNull() & (F.col("_prev.contract_digest") != F.col("contract_digest"))
    return faults(
        paired, "project", 0, F.col("revision_order"),
        (changed & (F.col("_prev.version") == F.col("version")), "contract.version_unchanged", F.col("version")),
        (
            changed & (F.col("_prev.fixture_revision") == F.col("fixture_revision")),
            "contract.fixture_unchanged", F.col("fixture_revision"),
        ),
    )


def contract_pin_check(asset: DataFrame, pin: DataFrame, scope: str) -> DataFrame:
    """Assets against their pinned digests."""
    keys = [scope, "path"]
    none = F.lit(None).cast("string")
    sides = (
        asset.select(*keys, F.col("sha256").alias("a"), none.alias("p"))
        .unionByName(pin.select(*keys, none.alias("a"), F.col("sha256").alias("p")))
        .groupBy(*keys)
        .agg(F.max("a").alias("a"), F.max("p").alias("p"))
    )
    return faults(
        sides, scope, 0, F.col("path"),
        (F.col("a").isNull(), "contract.asset_missing", None),
        (F.col("p").isNull(), "contract.asset_unpinned", None),
        (F.col("a") != F.col("p"), "contract.digest_changed", F.col("a")),
    )


def record_listing_check(record: DataFrame, member: DataFrame, scope: str, self_name: str = "RECORD") -> DataFrame:
    """Package listing ``(scope, path, digest, size)`` against members with hex digest and size."""
    keys = [scope, "path"]
    none = F.lit(None).cast("string")
    encoded = F.translate(F.base64(F.unhex("sha256")), "+/=", "-_")
    sides = (
        record.select(*keys, F.col("digest").alias("d"), F.col("size").cast("string").alias("s"), none.alias("md"), none.alias("ms"), F.lit(1).alias("r"), F.lit(0).alias("m"))
        .unionByName(
            member.select(
                *keys, none.alias("d"), none.alias("s"), F.concat(F.lit("sha256="), encoded).alias("md"),
                F.col("size").cast("string").alias("ms"), F.lit(0).alias("r"), F.lit(1).alias("m"),
            )
        )
        .groupBy(*keys)
        .agg(*[F.max(n).alias(n) for n in ("d", "s", "md", "ms")], F.sum("r").alias("r"), F.sum("m").alias("m"))
    )
    own = F.col("path") == self_name
    filled = (F.coalesce("d", F.lit("")) != "") | (F.coalesce("s", F.lit("")) != "")
    both = (F.col("r") > 0) & (F.col("m") > 0)
    return faults(
        sides, scope, 0, F.col("path"),
        (F.col("r") == 0, "distribution.record_missing", None),
        (F.col("m") == 0, "distribution.member_missing", None),
        (F.col("r") > 1, "distribution.record_duplicate", None),
        (own & filled, "distribution.record_self_entry", None),
        (
            both & ~own & (~F.col("d").eqNullSafe(F.col("md")) | ~F.col("s").eqNullSafe(F.col("ms"))),
            "distribution.record_mismatch", F.col("d"),
        ),
    )


def archive_name_collisions(member: DataFrame, scope: str) -> DataFrame:
    """Unsafe member names, and names equal after normalisation and case folding."""
    name = F.col("path")
    unsafe = (
        (name == "") | (F.instr(name, "\\") > 0) | name.startswith("/")
        | (paths.bad_segments(name) & (name != "."))
    )
    folded = text.with_folded(member.filter(name != "").select(scope, "path"), "path", "_folded")
    repeated = folded.groupBy(scope, "_folded").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return union(
        finding(member.filter(unsafe), scope, 0, "distribution.unsafe_member", name),
        finding(repeated, scope, 0, "distribution.name_collision", F.col("_folded"), F.col("_n")),
    )


def capability_set_diff(advertised: DataFrame, supported: Mapping[str, Sequence[str]], scope: str) -> DataFrame:
    """Advertised ``(scope, name, schema)`` must equal the supported set, per scope."""
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.lit(schema).alias("schema"))
            for name, schemas in supported.items()
            for schema in schemas
        ]
    )
    wanted = advertised.select(scope).distinct().select(scope, F.inline(pairs))
    keys = [scope, "name", "schema"]
    sides = (
        advertised.select(*keys, F.lit(1).alias("a"), F.lit(0).alias("s"))
        .unionByName(wanted.select(*keys, F.lit(0).alias("a"), F.lit(1).alias("s")))
        .groupBy(*keys)
        .agg(F.max("a").alias("a"), F.max("s").alias("s"))
    )
    return faults(
        sides, scope, 0, F.col("name"),
        (F.col("a") < F.col("s"), "process.capability_missing", F.col("schema")),
        (F.col("a") > F.col("s"), "process.capability_unknown", F.col("schema")),
    )


def release_pointer_check(pointer: DataFrame, release: DataFrame) -> DataFrame:
    """State of the current pointer of each root: ``(root, state, code, bundle_id, run_report_sha256)``."""
    target = F.col("target")
    named = pointer.select("root", target, F.when(target.rlike(c.RELEASE_TARGET), F.regexp_replace(target, "^releases/", "")).alias("bundle_id"))
    verified = F.col("verified_id") if "verified_id" in release.columns else F.col("bundle_id")
    known = release.select("root", "bundle_id", "run_report_sha256", verified.alias("_verified"))
    joined = named.join(known, ["root", "bundle_id"], "left")
    code = (
        F.when(target.isNull(), F.lit(None))
        .when(F.col("bundle_id").isNull(), "publication.recovery_target_unsafe")
        .when(F.col("_verified").isNull(), "publication.recovery_target_missing")
        .when(F.col("_verified") != F.col("bundle_id"), "publication.recovery_identity_mismatch")
        .when(F.col("run_report_sha256").isNull(), "publication.recovery_report_unavailable")
    )
    state = (
        F.when(target.isNull(), "recovered-no-commit")
        .when(F.col("code").isNotNull(), "recovery-blocked")
        .otherwise("recovered-durable-success")
    )
    good = F.col("state") == "recovered-durable-success"
    return (
        joined.withColumn("code", code.cast("string"))
        .withColumn("state", state)
        .select(
            "root", "state", "code",
            F.when(good, F.col("bundle_id")).alias("bundle_id"),
            F.when(good, F.col("run_report_sha256")).alias("run_report_sha256"),
        )
    )


# --- detached signatures ----------------------------------------------------
ENVELOPE_TYPE = (
    "algorithm string,binding struct<bundle_id:string,checksums_sha256:string,manifest_sha256:string,"
    "payload_sha256:string,statement_type:string>,key_id string,public_key string,schema string,signature string"
)
# fixed values: unpadded base64url of 64 and of 32 bytes, unused bits zero
SIGNATURE_TEXT = r"\A[A-Za-z0-9_-]{85}[AQgw]\z"
PUBLIC_KEY_TEXT = r"\A[A-Za-z0-9_-]{42}[AEIMQUYcgkosw048]\z"


def signature_binding_audit(
    envelope: DataFrame, bundle: DataFrame, trust_anchor: DataFrame, namespace: str = c.DEFAULT_NAMESPACE
) -> DataFrame:
    """``(bundle_key, key_id, status, anchored)`` of each envelope.

    ``envelope`` is ``(bundle_key, envelope_json)``, ``bundle`` has the four bound
    digests of the same key, ``trust_anchor`` is ``(key_id, key_bytes)``.  The
    signature itself is not proved here, so no status says that it is valid.
    """
    json = F.col("envelope_json")
    keys = F.json_object_keys(json)
    rows = envelope.select(
        "bundle_key", "envelope_json", F.from_json(json, ENVELOPE_TYPE).alias("_e"),
        F.array_sort(keys).eqNullSafe(F.array(*[F.lit(k) for k in c.ENVELOPE_KEYS])).alias("_closed"),
        F.array_sort(F.json_object_keys(F.get_json_object(json, "$.binding"))).eqNullSafe(
            F.array(*[F.lit(k) for k in c.BINDING_KEYS])
        ).alias("_bound"),
    )
    e = F.col("_e")
    rows = rows.withColumn("key_id", e["key_id"]).withColumn(
        "_canonical", ids.canonical_text(F.col("_e")).eqNullSafe(F.col("envelope_json"))
    )
    anchors = trust_anchor.select("key_id", F.octet_length("key_bytes").alias("_key_size"))
    stored = bundle.select("bundle_key", *[F.col(n).alias(f"_b_{n}") for n in c.BINDING_KEYS if n != "statement_type"])
    joined = rows.join(anchors, "key_id", "left").join(stored, "bundle_key", "left")

    def matches(value: Column, pattern: str) -> Column:
        return F.coalesce(value.rlike(pattern), F.lit(False))

    b = e["binding"]
    well_formed = (
        F.col("_bound") & matches(e["key_id"], c.KEY_ID) & matches(b["bundle_id"], c.BUNDLE_ID)
        & matches(b["checksums_sha256"], c.HEX64) & matches(b["manifest_sha256"], c.HEX64)
        & matches(b["payload_sha256"], c.HEX64) & matches(b["statement_type"], c.TOKEN)
        & (e["public_key"].isNull() | matches(e["public_key"], PUBLIC_KEY_TEXT)) & matches(e["signature"], SIGNATURE_TEXT)
    )
    same = F.lit(True)
    for name in c.BINDING_KEYS:
        if name != "statement_type":
            same = same & b[name].eqNullSafe(F.col(f"_b_{name}"))
    status = (
        F.when(~(F.col("_closed") & F.col("_canonical")) | e["schema"].isNull(), "malformed_envelope")
        .when(e["schema"] != c.schema_id("detached-signature.v1", namespace), "unsupported_version")
        .when(e["algorithm"].isNull(), "malformed_envelope")
        .when(e["algorithm"] != c.SIGNATURE_ALGORITHM, "unsupported_algorithm")
        .when(~well_formed, "malformed_envelope")
        .when(F.col("_key_size").isNotNull() & (F.col("_key_size") != 32), "invalid_trust_anchor")
        .when(F.col("_key_size").isNull() & e["public_key"].isNull(), "unknown_key")
        .when(~same, "binding_mismatch")
        .otherwise("binding_ok")
    )
    return joined.select("bundle_key", "key_id", status.alias("status"), F.col("_key_size").isNotNull().alias("anchored"))
