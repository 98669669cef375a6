"""Canonical JSON of fixed records, and content ids over it.

Canonical form: members sorted by name, no spaces, nulls kept, text unescaped
beyond what JSON needs.  ``to_json`` over a struct declared in sorted order
yields exactly that for the fixed ASCII member names used here.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | str | int | bool | None | Mapping


def _column(value: Value) -> Column:
    if isinstance(value, Mapping):
        return F.struct(*[_column(value[key]).alias(key) for key in sorted(value)])
    if isinstance(value, Column):
        return value
    if value is None:
        return F.lit(None).cast("string")
    return F.lit(value)


#: Control characters whose escape has a hex letter; ``to_json`` writes it in upper case.
_LETTERED = (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20))


def lower_escapes(json: Column) -> Column:
    """JSON text with the hex letters of its control escapes in lower case.

    Only escapes change: a backslash that is itself escaped begins none. Texts without such an
    escape, nearly all, are told by one search.
    """
    # an even number of backslashes before it is part of the match and comes back
    places = [F.struct(F.lit(rf"(?<!\\)((?:\\\\)*)\\u{point:04X}").alias("old"), F.lit(rf"$1\\u{point:04x}").alias("new")) for point in _LETTERED]
    # one step over a short list: written out, the steps would fill the code of every id
    lowered = F.aggregate(F.array(*places), json, lambda done, place: F.regexp_replace(done, place["old"], place["new"]))
    return F.when(json.contains("\\u00") & json.rlike(r"\\u00[01][A-F]"), lowered).otherwise(json)


def canonical_text(value: Column) -> Column:
    """Canonical JSON of a struct, array or map column that is declared in sorted order."""
    return lower_escapes(F.to_json(value, {"ignoreNullFields": "false"}))


def canonical(record: Mapping[str, Value]) -> Column:
    return canonical_text(_column(record))


def json_string(text: Column) -> Column:
    """One JSON string literal, quotes included."""
    return F.regexp_extract(lower_escapes(F.to_json(F.struct(text.alias("v")))), r"(?s)\A\{\"v\":(.*)\}\z", 1)


def quoted(text: Column) -> Column:
    """JSON of a text, or ``null``; texts that need no escape, nearly all, are told by one search."""
    plain = F.concat(F.lit('"'), text, F.lit('"'))
    return F.when(text.isNull(), F.lit("null")).when(text.rlike(r'[\x00-\x1f"\\]'), json_string(text)).otherwise(plain)


def number(value: Column) -> Column:
    """JSON of a whole number, or ``null``."""
    return F.coalesce(value.cast("string"), F.lit("null"))


def made(own: Column) -> Column:
    """JSON of an id that was made here, or ``null``; it needs no escape."""
    return F.coalesce(F.concat(F.lit('"'), own, F.lit('"')), F.lit("null"))


def members(texts: Mapping[str, Column], opened: bool = False) -> Column:
    """Canonical JSON of an object whose members are JSON texts already; without its first bracket if that is ``opened``."""
    pieces = []
    for at, name in enumerate(sorted(texts)):
        before = "," if at else "" if opened else "{"
        pieces += [F.lit(f'{before}"{name}":'), texts[name]]
    return F.concat(*pieces, F.lit("}"))


def packed(own: Column) -> Column:
    """An id as its name and the bytes of its digest, half as long to move; any other text stays as it is."""
    raw = own.cast("binary")
    name = F.substring(raw, F.lit(1), F.octet_length(raw) - 65).cast("string")
    digest = F.unhex(F.substring(raw, -64, 64).cast("string"))
    # what comes back byte for byte is one; to look at each letter would take longer
    sound = F.coalesce(with_digest(name, digest) == own, F.lit(False)) & (F.octet_length(digest) == 32)
    return F.struct(F.when(sound, name).otherwise(own).alias("name"), F.when(sound, digest).alias("digest"))


def unpacked(pack: Column) -> Column:
    """The id of :func:`packed`, byte for byte."""
    return F.when(pack["digest"].isNull(), pack["name"]).otherwise(with_digest(pack["name"], pack["digest"]))


def quoted_pack(pack: Column) -> Column:
    """JSON of the id of :func:`packed`; only its name, which is short, is searched for escapes."""
    plain = pack["digest"].isNotNull() & pack["name"].rlike(r"\A[a-z0-9:-]+\z")
    return F.when(plain, F.concat(F.lit('"'), with_digest(pack["name"], pack["digest"]), F.lit('"'))).otherwise(quoted(unpacked(pack)))


def digest_of(own: Column) -> Column:
    """The digest of a content id that was made here, as bytes."""
    return F.unhex(F.substring(own, -64, 64))


def with_digest(name: Column, digest: Column) -> Column:
    return F.concat(name, F.lit(":"), F.lower(F.hex(digest)))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def content_id(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:sha256:"), sha256(text))


def scoped_identity(kind: str | Column, identity: Mapping[str, Value]) -> Column:
    """Canonical text of ``{"identity": ..., "kind": ...}``, the preimage of a node id."""
    return canonical({"identity": identity, "kind": kind})


def artifact_id(path: Column, digest: Column, payload_kind: str) -> Column:
    return content_id("artifact", canonical({"kind": payload_kind, "path": path, "sha256": digest}))


def coverage_artifact_id(path: Column, tree_digest: Column) -> Column:
    return content_id("coverage-artifact", members({"path": quoted(path), "report_tree_sha256": quoted(tree_digest)}))


def sidecar_id(kind: Value, path: Column, digest: Column) -> Column:
    return content_id("coverage-sidecar", canonical({"kind": kind, "path": path, "sha256": digest}))


def relation_id(
    fragment: Column,
    line: Column,
    report_artifact_id: Column,
    report_path: Column,
    snapshot_id: Column,
    source_path: Column,
    symbol: Column,
) -> Column:
    texts = {"fragment": fragment, "report_artifact_id": report_artifact_id, "report_path": report_path, "snapshot_id": snapshot_id, "source_path": source_path, "symbol": symbol}
    return content_id("coverage-relation", members({"line": number(line)} | {name: quoted(text) for name, text in texts.items()}))
