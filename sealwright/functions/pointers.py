"""JSON Pointer text as columns.

A canonical pointer escapes ``~`` and ``/`` inside tokens, so prefixes of the
pointer text at token borders are exactly the pointers of its ancestors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import ancestors


def is_malformed(pointer: Column) -> Column:
    return pointer.isNull() | ~pointer.startswith("/") | pointer.rlike(r"~([^01]|\z)")


def tokens(pointer: Column) -> Column:
    return F.transform(
        F.split(F.substring(pointer, 2, 2**31 - 1), "/"),
        lambda token: F.replace(F.replace(token, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")),
    )


def encode(names: Column) -> Column:
    return F.concat(
        F.lit("/"),
        F.array_join(
            F.transform(
                names,
                lambda name: F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")),
            ),
            "/",
        ),
    )


def proper_prefixes(pointer: Column) -> Column:
    """Pointers of all proper ancestors except the root."""
    return F.filter(ancestors(pointer), lambda prefix: prefix != "")
