"""Session settings the jobs rely on, and where iterative jobs cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of long rows that a batch between Spark and Python holds.
LONG_BYTES = 4 << 20
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "5000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "67108864",
}


def recommended(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    return builder


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without one gets its own for its lifetime."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, label: str = "table", long_rows: bool = False, group: int | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Cuts lineage, survives lost executors, and later reads prune columns and push filters down. Most of what is stored are
    hex digests, which zstd halves and snappy leaves as they are. Shuffle files of the write are of no use after it and are dropped at once.
    ``long_rows``: rows are made from texts of up to a megabyte, of which a task holds few at a time in Arrow batches. ``group``: rows of
    a row group, which is read as a whole and whose size Parquet tells after compression only.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored/{label}-{uuid.uuid4().hex}"
    wanted = {_DROP_SHUFFLES: "true"} | ({_BATCH_BYTES: str(LONG_BYTES)} if long_rows else {})
    before = {name: spark.conf.get(name) for name in wanted}
    writer = df.write.option("compression", "zstd")
    if group is not None:
        writer = writer.option("parquet.block.row.count.limit", str(group)).option("parquet.page.size.row.check.min", "1")
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        writer.parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(path)


cut_lineage = stored


def settled(df: DataFrame) -> DataFrame:
    """``df`` with its columns derived once: conditions on them read them, and are not moved into what they are derived from.

    Nothing is stored. Without it the optimizer writes an id, with all it is made of, into each condition that names it.
    """
    return df.withColumn("_settled", F.monotonically_increasing_id()).where(F.col("_settled") >= 0).drop("_settled")
