"""Text profile tests: control characters and Unicode NFC."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"\p{Cc}"
# Every string over U+0000..U+02FF is NFC already, so only the rest needs Python.
_BEYOND_LATIN = r"[^\x{0000}-\x{02FF}]"


def has_control(text: Column) -> Column:
    return text.rlike(CONTROL)


def may_break_nfc(text: Column) -> Column:
    return text.rlike(_BEYOND_LATIN)


def _is_nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import unicodedata

    for batch in batches:
        yield batch.map(lambda text: unicodedata.is_normalized("NFC", text), na_action="ignore").astype("boolean")


def _nfc_casefold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import unicodedata

    for batch in batches:
        yield batch.map(lambda text: unicodedata.normalize("NFC", text).casefold(), na_action="ignore")


def only_not_nfc(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text is not NFC; plain Latin text never leaves the JVM."""
    is_nfc = F.pandas_udf(_is_nfc, "boolean")
    return df.filter(may_break_nfc(F.col(column))).filter(~is_nfc(F.col(column)))


def with_nfc(df: DataFrame, column: str, name: str) -> DataFrame:
    """Add whether the text is NFC, null for null; plain Latin text never leaves the JVM."""
    is_nfc = F.pandas_udf(_is_nfc, "boolean")
    beyond = F.coalesce(may_break_nfc(F.col(column)), F.lit(False))
    plain = df.filter(~beyond).withColumn(name, F.when(F.col(column).isNotNull(), F.lit(True)))
    return plain.unionByName(df.filter(beyond).withColumn(name, is_nfc(F.col(column))))


def with_folded(df: DataFrame, column: str, name: str) -> DataFrame:
    """Add the NFC case-folded text: ASCII by ``lower``, the rest by a batch function."""
    nfc_casefold = F.pandas_udf(_nfc_casefold, "string")
    ascii_only = ~F.col(column).rlike(r"[^\x00-\x7F]")
    plain = df.filter(ascii_only).withColumn(name, F.lower(column))
    other = df.filter(~ascii_only).withColumn(name, nfc_casefold(F.col(column)))
    return plain.unionByName(other)
