"""Coverage sidecars: mapping and attestation texts as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import contract as c
from ..functions import chunks, json_walk
from ..operators.findings import faults, finding, union
from ..session import stored

REPORT_TYPE = "report struct<entry_point:string,tree_sha256:string>"
RELATION = {"fragment": "string", "line": "integer", "report_path": "string", "source_path": "string", "symbol": "string"}
ATTESTATION_TYPE = (
    "configuration_identity_sha256 string,coverage_data_identity string,instrumentation_identity string,"
    "producer struct<name:string,version:string>,report struct<entry_point:string,tree_sha256:string>,schema string,"
    "snapshot_id string,test_result_identity string,test_selection_identity string"
)
ATTESTATION_KEYS = (
    "configuration_identity_sha256", "coverage_data_identity", "instrumentation_identity", "producer", "report",
    "schema", "snapshot_id", "test_result_identity", "test_selection_identity",
)


def mapping_parts(sidecar_text: DataFrame, size: int | None = None) -> DataFrame:
    """``(scope, array, pos, text)``: relations and frames of mapping texts, whole or in chunks; stored.

    Whole texts of one chunk, nearly all, are dealt to tasks and taken apart where they are; only longer ones are cut.
    """
    if "chunk" in sidecar_text.columns:
        return stored(chunks.json_parts(chunks.as_chunks(sidecar_text, ["scope"], size=size), ["scope"]), "mapping-parts")
    short = F.coalesce(F.length("text"), F.lit(0)) <= (size or chunks.READ_CHARS)
    parts = chunks.whole_parts(json_walk.dealt(sidecar_text.where(short).select("scope", "text")), ["scope"])
    long = sidecar_text.where(~short)
    if not long.isEmpty():
        parts = parts.unionByName(chunks.json_parts(chunks.as_chunks(long, ["scope"], size=size), ["scope"]))
    return stored(parts, "mapping-parts")


def _frames(parts: DataFrame) -> DataFrame:
    return json_walk.with_part(parts.where(F.col("array") == chunks.FRAME).select("scope", "text"), "text", "_read")


def _elements(parts: DataFrame) -> DataFrame:
    return parts.where((F.col("array") != chunks.FRAME) & (F.col("pos") >= 0))


def _listed(frames: DataFrame) -> DataFrame:
    """``(scope, array)`` of the array ``relations``; of several of the name, the last one."""
    place = F.array_size("arrays") - F.array_position(F.reverse("arrays"), "relations")
    return frames.where(F.array_contains("arrays", "relations")).select("scope", place.cast("long").alias("array"))


def _relations(parts: DataFrame) -> DataFrame:
    """Each relation with its strictly typed members in ``_r``."""
    rows = _elements(parts).join(_listed(_frames(parts).select("scope", "_read.arrays")), ["scope", "array"])
    return json_walk.with_members(rows, "text", "_r", **RELATION)


def _parts(sidecar_text: DataFrame) -> DataFrame:
    return sidecar_text if "array" in sidecar_text.columns else mapping_parts(sidecar_text)


def read_relation_sidecars(sidecar_text: DataFrame) -> DataFrame:
    """Mapping texts or parts to relation rows with their position; a member of another type is null."""
    return _relations(_parts(sidecar_text)).select("scope", "pos", "_r.report_path", "_r.source_path", "_r.fragment", "_r.line", "_r.symbol")


def read_report_bindings(sidecar_text: DataFrame) -> DataFrame:
    parsed = _frames(_parts(sidecar_text)).select("scope", F.when(F.col("_read.valid"), F.from_json("text", REPORT_TYPE)).alias("m"))
    return parsed.select("scope", "m.report.entry_point", "m.report.tree_sha256")


def mapping_audit(sidecar_text: DataFrame) -> DataFrame:
    """Mapping texts or parts that are no JSON, repeat a member, or have other members; relations of another shape."""
    parts = _parts(sidecar_text)
    # every text is read once: what is told of frames and of their elements is narrow, and stored
    frames = stored(_frames(parts).select("scope", "_read.*"), "mapping-frames")
    both = json_walk.with_part(json_walk.with_members(_elements(parts), "text", "_r", **RELATION), "text", "_read")
    open_ = ~F.col("_r.closed") | F.col("_r.report_path").isNull() | F.col("_r.source_path").isNull()
    each = both.select("scope", "array", "pos", "_read.valid", "_read.repeated", open_.alias("open"), F.when(open_, F.col("_r.report_path")).alias("report_path"))
    each = stored(each, "mapping-elements")
    told = each.groupBy("scope").agg(F.min("valid").alias("_valid"), F.max(F.coalesce("repeated", F.lit(False))).alias("_repeated"))
    no_names = F.array().cast("array<string>")
    closed = F.array_sort(F.coalesce("keys", no_names)) == F.array(F.lit("relations"), F.lit("report"), F.lit("schema"))
    read = frames.join(told, "scope", "left").select(
        "scope", (F.col("valid") & F.coalesce("_valid", F.lit(True))).alias("valid"),
        (F.coalesce("repeated", F.lit(False)) | F.coalesce("_repeated", F.lit(False))).alias("repeated"),
        (closed & F.array_contains(F.coalesce("arrays", no_names), "relations")).alias("closed"),
    )
    valid, repeated, closed = F.col("valid"), F.col("repeated"), F.col("closed")
    listed = each.filter("open").select("scope", "array", "pos", "report_path").join(_listed(frames), ["scope", "array"])
    shaped = listed.join(read.filter(valid & ~repeated & closed).select("scope"), "scope", "left_semi")
    code = "coverage.invalid_sidecar"
    return union(
        faults(
            read, "scope", 0, None,
            (~valid, code, "json"), (valid & repeated, code, "repeated member"), (valid & ~repeated & ~closed, code, "members"),
        ),
        finding(shaped, "scope", 0, "coverage.invalid_relation", F.col("report_path"), F.col("pos")),
    )


def read_attestations(sidecar_text: DataFrame) -> DataFrame:
    """``(scope, text)`` to one typed row per attestation."""
    parsed = sidecar_text.select("scope", F.from_json("text", ATTESTATION_TYPE).alias("a"))
    return parsed.select(
        "scope", "a.report.entry_point", "a.report.tree_sha256", "a.snapshot_id",
        F.col("a.configuration_identity_sha256").alias("configuration_sha256"),
        F.col("a.producer.name").alias("producer_name"), F.col("a.producer.version").alias("producer_version"),
        "a.test_selection_identity", "a.test_result_identity", "a.instrumentation_identity", "a.coverage_data_identity",
    )


def attestation_audit(sidecar_text: DataFrame, namespace: str = c.DEFAULT_NAMESPACE) -> DataFrame:
    """Closed shape, schema, digests and non-empty identities."""
    rows = sidecar_text.select(
        "scope",
        F.array_sort(F.json_object_keys("text")).eqNullSafe(F.array(*[F.lit(k) for k in ATTESTATION_KEYS])).alias("_closed"),
        F.from_json("text", ATTESTATION_TYPE).alias("a"),
    )
    a = F.col("a")
    identities = ("coverage_data_identity", "instrumentation_identity", "snapshot_id", "test_result_identity", "test_selection_identity")
    code = "coverage.invalid_sidecar"

    def blank(value):
        return F.coalesce(value == "", F.lit(True)) | value.rlike(r"\p{Cc}")

    return faults(
        rows, "scope", 0, None,
        (~F.col("_closed"), code, "members"),
        (F.col("_closed") & ~a["schema"].eqNullSafe(c.schema_id("coverage-attestation.v1", namespace)), "coverage.unsupported_attestation_schema", a["schema"]),
        (F.col("_closed") & ~F.coalesce(a["report"]["tree_sha256"].rlike(c.HEX64), F.lit(False)), code, "tree_sha256"),
        (F.col("_closed") & ~F.coalesce(a["configuration_identity_sha256"].rlike(c.HEX64), F.lit(False)), code, "configuration"),
        (F.col("_closed") & (blank(a["producer"]["name"]) | blank(a["producer"]["version"])), code, "producer"),
        *[(F.col("_closed") & blank(a[name]), code, name) for name in identities],
    )
