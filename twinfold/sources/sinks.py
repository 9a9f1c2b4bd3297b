"""Writers: replacement by repository, insert-or-touch by key, and readers of what they wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_partitions(df: DataFrame, path: str, by: str = "repo_id", scope: DataFrame | None = None) -> None:
    """Overwrite only the partitions that ``df`` has rows of; those of ``scope`` (a table of ``by``) that it has none of become empty."""
    spark = df.sparkSession
    if scope is not None and exists(spark, path):
        gone = scope.select(by).distinct().join(df.select(by).distinct(), by, "left_anti")
        stored = spark.read.parquet(path)
        if not stored.join(gone, by, "left_semi").isEmpty():
            delete(spark, path, gone, by)
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _swap(spark: SparkSession, fresh: DataFrame, path: str, by: str | None = None) -> None:
    """Write ``fresh`` beside the table, then move the old one away and the new one in; the old one goes last, and comes back if the move fails."""
    beside = f"{path.rstrip('/')}-{uuid.uuid4().hex[:8]}"
    writer = fresh.write
    (writer.partitionBy(by) if by else writer).parquet(beside)
    jvm = spark._jvm.org.apache.hadoop.fs
    files = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    at, old = jvm.Path(path), jvm.Path(f"{beside}-old")
    had = files.exists(at)
    if had and not files.rename(at, old):
        raise OSError(f"{path} couldn't be moved away; the new table is at {beside}")
    if not files.rename(jvm.Path(beside), at):
        if had:
            files.rename(old, at)
        raise OSError(f"{beside} couldn't be moved to {path}")
    if had:
        files.delete(old, True)


def upsert(df: DataFrame, path: str, keys: list[str], latest: str | None = None) -> None:
    """Insert rows, replacing those with the same keys. Of several with the same keys the one with the highest ``latest`` (and else the highest values) stays."""
    spark = df.sparkSession
    rest = [c for c in df.columns if c not in keys]
    if rest:
        order = F.struct(*([latest] if latest else []), *[F.to_json(F.struct(*rest))])
        fresh = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*").select(*df.columns)
    else:
        fresh = df.distinct()
    if exists(spark, path):
        fresh = spark.read.parquet(path).join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)
    _swap(spark, fresh, path)


def delete(spark: SparkSession, path: str, keys: DataFrame, by: str | None = None) -> None:
    """Delete the rows whose keys are in ``keys``; ``by``: the column that the table is partitioned by."""
    _swap(spark, spark.read.parquet(path).join(keys, keys.columns, "left_anti"), path, by)


def missing_totals(snapshots: DataFrame, functions: DataFrame) -> DataFrame:
    """(repo_id, functions_total): stored counts for snapshots whose totals are 0 or missing; nothing is written."""
    counts = functions.groupBy("repo_id").agg(F.count(F.lit(1)).alias("functions_total"))
    return snapshots.where(F.coalesce("stats.functions_total", F.lit(0)) == 0).select("repo_id").join(counts, "repo_id")
