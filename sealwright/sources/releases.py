"""Release tables: insert if absent, by content id.

A table is a folder of attempts and one of commit records. An attempt writes its rows into a folder of its own name; what
makes them part of the table is a record, created under the next number, that names the attempt. Creating it fails if
another driver was faster; then the candidates are held against the table again. Rows of an attempt without a record do
not exist for readers, and a rerun of the attempt replaces them; an attempt that has its record adds nothing.
"""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.findings import finding

_KEY = ["root", "bundle_id"]
SCHEMA = "root string, bundle_id string, run_report_sha256 string"


def classify_candidates(candidates: DataFrame, releases: DataFrame) -> DataFrame:
    """Each candidate is new, an exact reuse, or contradicts the stored release."""
    known = releases.select(*_KEY, F.col("run_report_sha256").alias("_known"))
    outcome = (
        F.when(F.col("_known").isNull(), "append")
        .when(F.col("_known") == F.col("run_report_sha256"), "reuse")
        .otherwise("publication.release_identity_mismatch")
    )
    return candidates.join(known, _KEY, "left").select(*_KEY, "run_report_sha256", outcome.alias("outcome"))


def to_append(candidates: DataFrame, releases: DataFrame) -> DataFrame:
    """Rows to insert: unknown ids, each once; of several reports of one id, the one with the least digest."""
    unknown = candidates.join(releases.select(*_KEY), _KEY, "left_anti")
    return unknown.groupBy(*_KEY).agg(F.min("run_report_sha256").alias("run_report_sha256"))


def conflicts(candidates: DataFrame, releases: DataFrame) -> DataFrame:
    bad = classify_candidates(candidates, releases).filter(F.col("outcome").startswith("publication."))
    return finding(bad, "root", 0, F.col("outcome"), F.col("bundle_id"))


# --- the table ----------------------------------------------------------------

def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    return jvm, folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def commits(spark: SparkSession, path: str) -> list[str]:
    """Attempts that are part of the table, in their order; one small record each."""
    jvm, folder, system = _files(spark, path)
    if not system.exists(folder):
        return []
    names = sorted(s.getPath().getName() for s in system.listStatus(folder) if s.getPath().getName().endswith(".json"))
    found = []
    for name in names:
        source = system.open(jvm.org.apache.hadoop.fs.Path(folder, name))
        try:
            found.append(json.loads(bytes(source.readAllBytes()))["attempt"])
        finally:
            source.close()
    return found


def _commit(spark: SparkSession, path: str, number: int, attempt: str) -> bool:
    """Create record ``number``; False if it is there already.

    The record is written under another name and then renamed, which fails if the name is taken, so it is there as a
    whole or not at all.
    """
    jvm, folder, system = _files(spark, path)
    system.mkdirs(folder)
    target = jvm.org.apache.hadoop.fs.Path(folder, f"{number:010d}.json")
    if system.exists(target):
        return False
    draft = jvm.org.apache.hadoop.fs.Path(folder, f".{number:010d}-{attempt}")
    out = system.create(draft, True)
    try:
        out.write(bytearray(json.dumps({"attempt": attempt, "number": number}).encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    keep = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    keep[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(system.makeQualified(draft), system.makeQualified(target), keep)
    except Py4JJavaError:
        if not system.exists(draft):
            raise
        system.delete(draft, False)
        return False
    return True


def read_releases(spark: SparkSession, path: str) -> DataFrame:
    """``(root, bundle_id, run_report_sha256)`` of all attempts that have their record."""
    accepted = commits(spark, path)
    if not accepted:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(*[f"{path}/attempts/{name}" for name in accepted])


def append_new_releases(candidates: DataFrame, path: str, attempt: str | None = None) -> DataFrame:
    """Insert unknown candidates into the table at ``path``, once for each name of an attempt; what became of each candidate.

    Without an attempt, ``path`` is a plain Parquet table by root, which has no records: one writer at a time.

    A driver that was lost calls again with the same ``attempt``: rows it wrote without a record are replaced, and
    if the record is there nothing is added. The result is told against the table as it was before this attempt; two
    candidates of one id and different reports are one ``append`` and a mismatch.
    """
    spark = candidates.sparkSession
    if attempt is None:
        plain = spark.read.parquet(path)
        told = classify_candidates(candidates, plain)
        to_append(candidates, plain).write.mode("append").partitionBy("root").parquet(path)
        return told
    own = candidates.select(*[F.col(name).cast("string").alias(name) for name in (*_KEY, "run_report_sha256")])
    while True:
        accepted = commits(spark, path)
        if attempt in accepted:
            earlier = accepted[: accepted.index(attempt)]
            break
        earlier = accepted
        new = to_append(own, read_releases(spark, path))
        new.write.mode("overwrite").parquet(f"{path}/attempts/{attempt}")
        if _commit(spark, path, len(accepted), attempt):
            break
    before = spark.read.schema(SCHEMA).parquet(*[f"{path}/attempts/{name}" for name in earlier]) if earlier else spark.createDataFrame([], SCHEMA)
    added = spark.read.schema(SCHEMA).parquet(f"{path}/attempts/{attempt}").select(*_KEY, F.col("run_report_sha256").alias("_added"))
    told = classify_candidates(own, before).join(added, _KEY, "left")
    beaten = (F.col("outcome") == "append") & ~F.col("run_report_sha256").eqNullSafe(F.col("_added"))
    return told.withColumn("outcome", F.when(beaten, "publication.release_identity_mismatch").otherwise(F.col("outcome"))).drop("_added")
