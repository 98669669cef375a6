"""Slash-separated relative paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import has_control


def _strings(*values: str) -> Column:
    return F.array(*[F.lit(value) for value in values]).cast("array<string>")


def ancestors(path: Column) -> Column:
    """All proper directory prefixes, shortest first."""
    depth = F.size(F.split(path, "/"))
    prefixes = F.transform(
        F.sequence(F.lit(1), depth - 1),
        lambda n: F.call_function("substring_index", path, F.lit("/"), n),
    )
    return F.when(depth > 1, prefixes).otherwise(_strings())


def self_and_ancestors(path: Column) -> Column:
    return F.concat(ancestors(path), F.array(path))


def dirname(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def basename(path: Column) -> Column:
    return F.call_function("substring_index", path, F.lit("/"), F.lit(-1))


def bad_segments(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda part: part.isin("", ".", ".."))


def profile_violations(path: Column) -> Column:
    """Names of the broken path rules except NFC, which needs Python (see ``text``)."""
    empty = path.isNull() | (path == "")
    return F.when(empty, _strings("empty")).otherwise(
        F.filter(
            F.array(
                F.when(path.startswith("/"), "absolute"),
                F.when(F.instr(path, "\\") > 0, "backslash"),
                F.when(has_control(path), "control"),
                F.when(bad_segments(path), "segment"),
            ),
            lambda rule: rule.isNotNull(),
        )
    )


def breaks_profile(path: Column) -> Column:
    """True for an unusable path, NFC aside."""
    return F.size(profile_violations(path)) > 0


def normpath(path: Column) -> Column:
    """Fold ``.`` and ``..``; leading ``..`` survive on relative paths."""
    rooted = path.startswith("/")

    def step(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        climbs = (part == "..") & (F.size(done) > 0) & (F.coalesce(last, F.lit("")) != "..")
        return (
            F.when(part.isin("", "."), done)
            .when(climbs, F.slice(done, F.lit(1), F.size(done) - 1))
            .when((part == "..") & rooted, done)
            .otherwise(F.concat(done, F.array(part)))
        )

    joined = F.array_join(F.aggregate(F.split(path, "/"), _strings(), step), "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)


def join_path(base: Column, relative: Column) -> Column:
    return F.when(base == "", relative).otherwise(F.concat_ws("/", base, relative))
