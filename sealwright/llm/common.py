"""Helpers shared by the training-data operators: staged tables, folds, spreads, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words of the contracts: runs of anything but space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a session without one (tests) gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and spark.sparkContext.getCheckpointDir() is not None:
        folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Folders of the tables staged so far by this driver.
STAGED: list[str] = []


def release(spark: SparkSession, folders: list[str]) -> None:
    """Delete staged tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
        if folder in STAGED:
            STAGED.remove(folder)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cut lineage that survives lost executors.

    Shuffle files of the write are of no use after it and are dropped at once.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_folder(spark)}/llm/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Rows of texts are long: 1,000 of them to an Arrow batch where the session has left the 10,000 of Spark."""
    if spark.conf.get(_BATCH_ROWS) == "10000":
        spark.conf.set(_BATCH_ROWS, "1000")


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(0)).cast("int")


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 2


def spread_count(total: Column) -> Column:
    """Buckets for a group of ``total`` units: both their number and their fill grow as the root."""
    return F.greatest(F.lit(1), F.ceil(F.sqrt(total))).cast("long")


def running_start(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` per group, in order of ``bucket`` and then ``order``.

    Two levels: sums per (group, bucket) are scanned first, rows only inside their bucket, so a
    group with a third of all rows is many tasks.
    """
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    ahead = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*group, bucket, F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = [rows[c].eqNullSafe(base[c]) for c in [*group, bucket]]
    keep = [rows[c] for c in df.columns]
    return rows.join(base, same).select(*keep, (F.col("_base") + F.col("_inside")).cast("long").alias(out))


def hook(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Merge the classes that the links join; a class is named by its smallest member."""
    while len(left):
        a, b = labels[left], labels[right]
        apart = a != b
        left, right = left[apart], right[apart]
        np.minimum.at(labels, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(up := labels[labels], labels):
            labels = up
    return labels


def connected_components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node reachable.

    Alternates large-star and small-star rounds. Neighbour sets are only ever reduced to their
    minimum, never gathered, so a node with a third of all links is a partial aggregate and a
    join that adaptive execution can split. Each round is a staged table.
    """

    def small_first(df: DataFrame) -> DataFrame:
        u, v = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
        return df.where(F.col("u") != F.col("v")).select(u, v).distinct()

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = stage(small_first(edges.select(F.col(left).alias("u"), F.col(right).alias("v"))), "edges")
    before = mark(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = small_first(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stage(small_first(small.unionByName(least.select("u", F.col("m").alias("v")))), "edges")
        after = mark(now)
        if after == before:
            break
        before = after
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return leaves.unionByName(roots)


def bounded_broadcast(df: DataFrame, most: int) -> DataFrame:
    """Broadcast ``df`` if it was counted and has at most ``most`` rows; else leave the join to Spark."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
