"""URI references inside bundle pages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import breaks_profile, dirname, join_path, normpath

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_REPLACEMENT = "�"


def _clean(reference: Column) -> Column:
    """Leading blanks and controls go, as do tabs and line ends anywhere."""
    return F.regexp_replace(F.regexp_replace(reference, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def let(value: Column, body) -> Column:
    """Bind ``value`` once for use in ``body``, so expression trees stay small."""
    return F.transform(F.array(value), lambda bound: body(bound))[0]


def split(text: Column) -> Column:
    """Struct of scheme, authority, path, query and fragment; absent parts are empty."""

    def parts(rest: Column) -> Column:
        tail = F.regexp_replace(rest, r"^//[^/?#]*", "")
        return F.struct(
            F.regexp_extract(text, _SCHEME, 1).alias("scheme"),
            F.regexp_extract(rest, r"^//([^/?#]*)", 1).alias("authority"),
            F.regexp_extract(tail, r"(?s)^([^?#]*)", 1).alias("path"),
            F.regexp_extract(tail, r"(?s)^[^?#]*\?([^#]*)", 1).alias("query"),
            F.regexp_extract(tail, r"(?s)#(.*)\z", 1).alias("fragment"),
        )

    return let(F.regexp_replace(text, _SCHEME, ""), parts)


def bad_authority(authority: Column) -> Column:
    """Unbalanced brackets, or brackets that hold no IP literal."""
    opened, closed = F.instr(authority, "[") > 0, F.instr(authority, "]") > 0
    literal = authority.rlike(r"\[([vV][0-9A-Fa-f]+\..+|[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*(%.*)?)\]")
    return (opened != closed) | (opened & closed & ~literal)


def malformed_percent(reference: Column) -> Column:
    return reference.rlike(r"%(?![0-9A-Fa-f]{2})")


def decode(text: Column) -> Column:
    """Percent-decode as UTF-8; a plus sign stays a plus sign."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def _count(text: Column, piece: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / F.lit(len(piece))


def undecodable(text: Column) -> Column:
    """Escapes that are no UTF-8 leave replacement characters nobody wrote."""
    written = _count(F.upper(text), "%EF%BF%BD") + _count(text, _REPLACEMENT)
    return F.coalesce(_count(decode(text), _REPLACEMENT) > written, F.lit(True))


def resolve(source: Column, path: Column) -> Column:
    """Bundle path a decoded reference path points at."""
    full = F.when(path.endswith("/"), F.concat(path, F.lit("index.html"))).otherwise(path)
    return (
        F.when(path == "", source)
        .when(path.startswith("/"), normpath(F.regexp_replace(full, "^/", "")))
        .otherwise(normpath(join_path(dirname(source), full)))
    )


def escapes_root(target: Column) -> Column:
    return (target == "..") | target.startswith("../")


def resolution(source: Column, reference: Column) -> Column:
    """Struct ``(target, fragment, bad_fragment, code)`` of one reference.

    Null for an external reference.  Faults are named in the order in which a
    reader of one link would meet them.
    """

    def answer(target: Column | None, fragment: Column | None, bad_fragment: Column, code: Column) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(
            (none if target is None else target).alias("target"),
            (none if fragment is None else fragment).alias("fragment"),
            bad_fragment.alias("bad_fragment"),
            code.cast("string").alias("code"),
        )

    def fault(code: str) -> Column:
        return answer(None, None, F.lit(False), F.lit(code))

    def resolved(part: Column) -> Column:
        def with_target(target: Column) -> Column:
            code = F.when(escapes_root(target), "link.root_escape").when(breaks_profile(target), "path.invalid")
            lost = undecodable(part["fragment"])
            return answer(target, F.when(~lost, decode(part["fragment"])), lost, code)

        return let(resolve(source, decode(part["path"])), with_target)

    def classified(part: Column) -> Column:
        external = (part["scheme"] != "") | (part["authority"] != "")
        return (
            F.when(bad_authority(part["authority"]), fault("link.invalid_reference"))
            .when(external, F.lit(None))
            .when(malformed_percent(reference), fault("link.malformed_percent"))
            .when(
                undecodable(part["path"]) | undecodable(part["query"]), fault("link.invalid_percent_utf8")
            )
            .otherwise(resolved(part))
        )

    return let(_clean(reference), lambda text: let(split(text), classified))


def quoted(text: Column, safe_slash: bool) -> Column:
    """Percent-encode all but unreserved characters, and slashes on request."""
    encoded = F.regexp_replace(F.regexp_replace(F.url_encode(text), r"\+", "%20"), r"\*", "%2A")
    encoded = F.replace(encoded, F.lit("%7E"), F.lit("~"))
    return F.replace(encoded, F.lit("%2F"), F.lit("/")) if safe_slash else encoded
