"""Manifest and checksum texts: parse to rows, write from rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import contract as c
from ..functions import chunks, json_walk
from ..operators.findings import finding, union
from ..operators.inventory import RANK_CHECKSUMS, RANK_ENTRY, RANK_ENTRY_POINT, RANK_MANIFEST_TEXT, control_texts
from ..session import stored

ENTRY = {"path": "string", "sha256": "string", "size": "string"}


def load_texts(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``(bundle_id, text)``: one control file per bundle folder below ``root``."""
    return (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(root, wholetext=True)
        .select(
            F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("bundle_id"),
            F.col("value").alias("text"),
        )
    )


def manifest_parts(manifest_text: DataFrame, size: int | None = None) -> DataFrame:
    """``(bundle_id, array, pos, text)``: entries and frames of manifest texts, whole or in chunks; stored.

    Readers take either these parts or texts. ``size``: characters a task takes apart at a time.
    """
    return stored(chunks.json_parts(chunks.as_chunks(manifest_text, ["bundle_id"], size=size), ["bundle_id"]), "manifest-parts")


def _parts(manifest_text: DataFrame) -> DataFrame:
    return manifest_text if "array" in manifest_text.columns else manifest_parts(manifest_text)


def _frames(parts: DataFrame) -> DataFrame:
    return json_walk.with_part(parts.where(F.col("array") == chunks.FRAME).select("bundle_id", "text"), "text", "_read")


def _array(parts: DataFrame, name: str) -> DataFrame:
    """Elements of the array ``name``; of several, the last one, as readers of objects have it."""
    place = F.array_size("_read.arrays") - F.array_position(F.reverse("_read.arrays"), name)
    named = _frames(parts).where(F.array_contains("_read.arrays", name)).select("bundle_id", place.cast("long").alias("array"))
    return parts.where((F.col("array") != chunks.FRAME) & (F.col("pos") >= 0)).join(named, ["bundle_id", "array"])


def read_manifests(manifest_text: DataFrame) -> DataFrame:
    """Manifest texts or parts to ``(bundle_id, pos, path, sha256, size)``, one row for each entry.

    Strict: a member that is no text is null, and so are all members of an entry that is no JSON object.
    """
    entries = json_walk.with_members(_array(_parts(manifest_text), "entries"), "text", "_e", **ENTRY)
    return entries.select("bundle_id", "pos", "_e.path", "_e.sha256", "_e.size")


def read_entry_points(manifest_text: DataFrame) -> DataFrame:
    """``(bundle_id, index, run_report)`` of every text or its parts; what is no text is null."""
    return _points(_frames(_parts(manifest_text))).select("bundle_id", "_p.index", "_p.run_report")


def _points(frames: DataFrame) -> DataFrame:
    return json_walk.with_members(frames.withColumn("_points", F.when(F.col("_read.valid"), F.get_json_object("text", "$.entry_points"))), "_points", "_p", index="string", run_report="string")


def manifest_shape_audit(manifest_text: DataFrame, namespace: str = c.DEFAULT_NAMESPACE) -> DataFrame:
    """Faults of manifest texts or parts, each in its place of the order of reading.

    A text that is no JSON, repeated members at any depth, text that differs from its canonical form, members
    missing or unknown, an unsupported schema, entries that are no list. What entries are is told part by part:
    an entry with other members than its three, or with one that is no text, is a finding with its position.
    """
    parts = _parts(manifest_text)
    frames = _points(_frames(parts)).select("bundle_id", "text", "_read.*", "_p")
    entries = json_walk.with_part(parts.where(F.col("array") != chunks.FRAME), "text", "_read")
    # spaces in an empty array stand at -1
    spaced = F.col("pos") < 0
    told = entries.groupBy("bundle_id").agg(
        F.min(spaced | F.col("_read.valid")).alias("_valid"),
        F.max(F.coalesce("_read.repeated", F.lit(False))).alias("_repeated"),
        F.min(~spaced & F.coalesce("_read.canonical", F.lit(False))).alias("_canonical"),
    )
    read = frames.join(told, "bundle_id", "left").select(
        "bundle_id", "keys", "arrays", "_p", F.from_json("text", "schema string").alias("m"),
        (F.col("valid") & F.coalesce("_valid", F.lit(True))).alias("valid"),
        (F.coalesce("repeated", F.lit(False)) | F.coalesce("_repeated", F.lit(False))).alias("repeated"),
        (F.coalesce("canonical", F.lit(False)) & F.coalesce("_canonical", F.lit(True))).alias("canonical"),
    )
    whole = read.filter("valid")
    single = whole.filter("not repeated")
    members = F.array(F.lit("entries"), F.lit("entry_points"), F.lit("schema"))
    closed = (F.array_sort(F.coalesce("keys", F.array().cast("array<string>"))) == members) & F.array_contains("arrays", "entries")
    supported = F.col("m.schema").eqNullSafe(c.schema_id("bundle-manifest.v1", namespace))
    rank = RANK_MANIFEST_TEXT
    typed = json_walk.with_members(_array(parts, "entries"), "text", "_e", **ENTRY)
    typed = typed.join(single.filter(closed & supported).select("bundle_id"), "bundle_id", "left_semi")
    e = F.col("_e")
    broken = ~e["closed"] | e["path"].isNull() | e["sha256"].isNull() | e["size"].isNull()
    return union(
        finding(read.filter(~F.col("valid")), "bundle_id", rank + 1, "manifest.invalid_json"),
        finding(whole.filter("repeated"), "bundle_id", rank, "manifest.duplicate_member"),
        finding(single.filter(~closed), "bundle_id", rank + 3, "manifest.invalid_shape"),
        finding(single.filter(closed & ~supported), "bundle_id", rank + 4, "manifest.unsupported_schema"),
        finding(single.filter(closed & supported & ~F.col("canonical")), "bundle_id", rank + 2, "manifest.noncanonical"),
        finding(
            single.filter(closed & supported & ~F.col("_p.closed")), "bundle_id", RANK_ENTRY_POINT, "manifest.invalid_entry_points", None, "members"
        ),
        finding(typed.filter(broken), "bundle_id", RANK_ENTRY, "manifest.invalid_entry", e["path"], F.col("pos")),
    )


def read_checksums(checksum_text: DataFrame) -> DataFrame:
    """Texts, whole or in chunks, to ``(bundle_id, pos, sha256, path, code)``.

    ``code`` is null for a well-formed record.  The text after the last line
    feed must be empty, otherwise it is a malformed record too.
    """
    rows = chunks.lines(chunks.as_chunks(checksum_text, ["bundle_id"]), ["bundle_id"]).filter("not (last and line = '')")
    well_formed = F.col("line").rlike(c.CHECKSUM_LINE) & ~F.col("last")
    return rows.select(
        "bundle_id",
        "pos",
        F.when(well_formed, F.regexp_extract("line", c.CHECKSUM_LINE, 1)).alias("sha256"),
        F.when(well_formed, F.regexp_extract("line", c.CHECKSUM_LINE, 2)).alias("path"),
        F.when(~well_formed, F.lit("checksums.noncanonical")).alias("code"),
    )


def malformed_checksums(records: DataFrame) -> DataFrame:
    bad = records.filter(F.col("code").isNotNull())
    return finding(bad, "bundle_id", RANK_CHECKSUMS, F.col("code"), None, F.col("pos"))


def write_manifests(payload: DataFrame, path: str, namespace: str = c.DEFAULT_NAMESPACE) -> None:
    """Save both control texts of every bundle, partitioned by file name."""
    control_texts(payload, namespace).write.mode("append").partitionBy("name").parquet(path)
