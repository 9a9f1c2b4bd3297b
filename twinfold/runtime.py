"""Session-level plumbing: the shared work folder, staged tables, and joins that survive a hot key."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key that a single task may be asked to handle before the key is split.
HOT_ROWS = 50_000
#: Entries of a list of hot keys up to which it is broadcast, and copies of a longer one.
HOT_SHIPPED, HOT_COPIES = 100_000, 64


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Read from the session; created only for a local master."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    known = "file://" + tempfile.mkdtemp(prefix="twinfold-")
    spark.conf.set("spark.checkpoint.dir", known)
    _delete_on_exit(spark, known)
    return known


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


#: Lets Spark delete an execution's shuffle files when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    It cuts lineage, survives the loss of any executor, is columnar (later column pruning still works)
    and gives the planner true sizes for its join choices. The shuffle files of the write go when it ends: nothing
    reads them again. :func:`free` deletes the table once what was made of it is staged.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    _delete_on_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def free(*staged: DataFrame | None) -> None:
    """Delete staged tables that nothing unfinished reads; anything else is left alone."""
    for df in staged:
        path = df.__dict__.get("_staged_at") if df is not None else None
        if path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
            del df._staged_at


def width(spark: SparkSession) -> int:
    """Partitions for a compute-heavy stage: never fewer than the session's shuffle partitions or cores."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def hot_keys(rows: DataFrame, key: str, threshold: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``threshold`` rows and the number of slices each needs.

    Counted exactly with partial (map-side) counts. At most rows/threshold keys come out.
    """
    return (
        rows.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > threshold)
        .select(key, F.ceil(F.col("_n") / F.lit(threshold)).cast("int").alias("_slices"))
    )


def with_slices(rows: DataFrame, hot: DataFrame, key: str, spread: Column) -> DataFrame:
    """``rows`` with ``_slices``, the number of slices of their key, null where the key isn't hot.

    ``hot`` is a staged list of :func:`hot_keys`. Up to ``HOT_SHIPPED`` entries are broadcast, so that the rows of a hot
    key never meet in one task; of a longer list each row joins one of ``HOT_COPIES`` copies, by ``spread``.
    """
    n_hot = _count(hot)
    if not n_hot:
        return rows.withColumn("_slices", F.lit(None).cast("int"))
    if n_hot <= HOT_SHIPPED:
        return rows.join(F.broadcast(hot), key, "left")
    copies = hot.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(HOT_COPIES - 1))))
    return rows.withColumn("_copy", F.pmod(spread, F.lit(HOT_COPIES)).cast("int")).join(copies, [key, "_copy"], "left").drop("_copy")


def _count(hot: DataFrame) -> int:
    if hot.__dict__.get("_rows") is None:
        hot._rows = hot.count()
    return hot._rows


def salted_lookup(
    rows: DataFrame, lookup: DataFrame, key: str, spread: Column, threshold: int = HOT_ROWS, how: str = "inner", hot: DataFrame | None = None
) -> DataFrame:
    """Join ``rows`` to ``lookup`` (one row per key) so that a hot key is spread over several tasks.

    ``spread`` is any well-mixed hash of the row. Cold keys have one slice; a hot key's lookup row is copied
    once per slice. ``hot`` may be given if :func:`hot_keys` of these rows is known already (staged, as it is read
    three times). It holds at most rows/threshold entries.
    """
    hot = stage(hot_keys(rows, key, threshold), "hot") if hot is None else hot
    if not _count(hot):
        return rows.join(lookup, key, how)
    slices = F.coalesce(F.col("_slices"), F.lit(1))
    left = with_slices(rows, hot, key, spread).withColumn("_slice", F.pmod(spread, slices).cast("int")).drop("_slices")
    right = lookup.join(F.broadcast(hot) if _count(hot) <= HOT_SHIPPED else hot, key, "left")
    right = right.withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1))).drop("_slices")
    return left.join(right, [key, "_slice"], how).drop("_slice")
