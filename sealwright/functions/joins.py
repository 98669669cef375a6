"""Joins whose key alone may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 32
#: Rows of one key that a task joins; a key with more is dealt to as many tasks as it needs.
TASK_ROWS = 100_000


def spread_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], spread_by: str, how: str = "inner", buckets: int = BUCKETS
) -> DataFrame:
    """Join many ``left`` rows to few ``right`` rows per key, split over ``buckets`` tasks a key.

    ``spread_by`` is a left column with many values per key, such as an id.  The
    right side, about one row per key, is repeated once per bucket, so a key
    with a third of all rows is worked on by many tasks, with or without runtime
    skew handling.
    """
    salted = left.withColumn("_bucket", F.pmod(F.xxhash64(spread_by), F.lit(buckets)).cast("int"))
    repeated = right.withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return salted.join(repeated, [*keys, "_bucket"], how).drop("_bucket")


def counted_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], spread_by: Sequence[str], how: str = "inner", most: int | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Join many ``left`` rows to few ``right`` rows per key, each key dealt to tasks by its own number of rows.

    Keys are counted once. Those with more than ``most`` left rows, at most one for each ``most`` rows of the table, get a salt
    from ``spread_by``, and their right rows a copy for each salt; all others meet unsalted and uncopied. Null keys match
    nothing, and are not counted. ``counted`` is a table that tells the rows of each key more cheaply than ``left``, such as
    the one that ``left`` was joined from.
    """
    names, most = list(keys), most or TASK_ROWS
    hot = (left if counted is None else counted).groupBy(*names).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > most)
    # few by their number, so that neither side is dealt for them
    hot = F.broadcast(hot.dropna(subset=names).select(*names, F.ceil(F.col("_rows") / most).cast("int").alias("_salts")))
    salt = F.pmod(F.xxhash64(*spread_by), F.coalesce("_salts", F.lit(1))).cast("int")
    salted = left.join(hot, names, "left").withColumn("_salt", salt).drop("_salts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    repeated = right.join(hot, names, "left").withColumn("_salt", copies).drop("_salts")
    return salted.join(repeated, [*names, "_salt"], how).drop("_salt")
