"""Unified diffs as tables: which lines of the new file were added."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexer, text

# Fixed value: the head of a hunk in a unified diff.
HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@"


def patch_lines(patches: DataFrame, keys: list[str], patch: str = "patch") -> DataFrame:
    """(keys, n, line): the lines of each patch in order; a missing or empty patch has none."""
    return patches.where(F.length(patch) > 0).select(*keys, F.posexplode(F.split(patch, "\n")).alias("n", "line"))


def numbered(patches: DataFrame, keys: list[str], patch: str = "patch") -> DataFrame:
    """Patch lines with ``kind`` (hunk, added, removed, context) and ``at``, their line in the new file."""
    lines = patch_lines(patches, keys, patch)
    start = F.regexp_extract("line", HUNK, 1)
    kind = F.when(start != "", "hunk").when(F.col("line").startswith("+"), "added").when(F.col("line").startswith("-"), "removed").otherwise("context")
    lines = lines.withColumn("kind", kind).withColumn("_start", F.when(start != "", start.cast("int")))
    order = Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("_hunk", F.count("_start").over(order)).withColumn("_first", F.coalesce(F.last("_start", True).over(order), F.lit(0)))
    within = Window.partitionBy(*keys, "_hunk").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    moved = F.coalesce(F.sum(F.col("kind").isin("added", "context").cast("int")).over(within), F.lit(0))
    return lines.withColumn("at", (F.col("_first") + moved).cast("int"))


def added_ranges(patches: DataFrame, keys: list[str], patch: str = "patch") -> DataFrame:
    """(keys, low, high): runs of consecutive added lines, in lines of the new file."""
    lines = numbered(patches, keys, patch)
    order = Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    island = F.sum((F.col("kind") != "added").cast("int")).over(order)
    added = lines.withColumn("_island", island).where(F.col("kind") == "added")
    # line numbers start at 1: of a run before any hunk header, which starts on line 0, the rest counts
    return added.where("at > 0").groupBy(*keys, "_island").agg(F.min("at").alias("low"), F.max("at").alias("high")).drop("_island")


def changed_ranges(files: DataFrame, keys: list[str]) -> DataFrame:
    """Added ranges of (filename, status, patch) rows that are neither removed nor anything but source."""
    kept = files.where((F.col("status") != "removed") & text.is_source_path(F.col("filename")))
    return added_ranges(kept, [*keys, "filename"])


def _opening(batches):
    for batch in batches:
        yield batch.filter(pa.array([lexer.opens_function(line) for line in batch.column("line").to_pylist()], pa.bool_()))


def added_declarations(patches: DataFrame, keys: list[str], patch: str = "patch") -> DataFrame:
    """(keys, line): added lines that open a function, without white space around; judged by the tokens of the line."""
    lines = patch_lines(patches, keys, patch).where(F.col("line").startswith("+") & ~F.col("line").startswith("+++"))
    lines = lines.select(*keys, F.trim(F.expr("substring(line, 2)")).alias("line")).where(F.col("line").contains("(") | F.col("line").contains("=>") | F.col("line").contains("function"))
    return lines.mapInArrow(_opening, lines.schema)
