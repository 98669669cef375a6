"""Strict reading of whole JSON texts in Arrow batches: validity, member names, repeated members.

The built-in readers are lenient: they take single quotes and text after the value, and keep one of
several members of a name. What a text is has to be settled over the whole of it first.
"""

from __future__ import annotations

import json
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHAPE = "valid boolean, keys array<string>, repeated array<string>, nested boolean"


class _Repeats:
    """Members of the objects of one text; the reader closes inner objects before outer ones."""

    def __init__(self):
        self.inner, self.last = False, []

    def members(self, pairs: list[tuple[str, object]]) -> dict:
        names = [name for name, _ in pairs]
        # an object closed before this one lies inside it, or beside it in an outer one
        self.inner |= len(set(self.last)) < len(self.last)
        self.last = names
        return dict(pairs)


def _no_constant(name: str) -> None:
    raise ValueError(name)


def read(text: str | None) -> tuple[bool, list[str] | None, list[str], bool]:
    """``(valid, keys, repeated, nested)``.

    ``keys``: member names of the outer object as written, null for other values. ``repeated``:
    those that occur again. ``nested``: a name occurs again in an inner object.
    """
    seen = _Repeats()
    try:
        # numbers of any length are read as they stand
        value = json.loads(text, object_pairs_hook=seen.members, parse_constant=_no_constant, parse_int=str, parse_float=str)
    except (TypeError, ValueError, RecursionError):
        return False, None, [], False
    if not isinstance(value, dict):
        return True, None, [], seen.inner | (len(set(seen.last)) < len(seen.last))
    keys = seen.last
    return True, keys, sorted(k for k, n in Counter(keys).items() if n > 1), seen.inner


def with_reading(table: DataFrame, column: str, name: str) -> DataFrame:
    """Add the struct of :func:`read` for a JSON column."""

    @F.pandas_udf(SHAPE)
    def batch(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(t) for t in texts], columns=["valid", "keys", "repeated", "nested"])

    return table.withColumn(name, batch(F.col(column).cast("string")))


def is_valid(column: Column) -> Column:
    """Whether a column holds JSON texts; null is none."""

    @F.pandas_udf("boolean")
    def batch(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: read(t)[0]).astype("boolean")

    return batch(column.cast("string"))
