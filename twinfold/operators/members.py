"""Joins between functions, caches and the members of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..runtime import HOT_ROWS, salted_lookup


def latest_functions(functions: DataFrame) -> DataFrame:
    """One row a function: the delivery updated last. A window with a rank limit, so it prunes before the shuffle."""
    order = Window.partitionBy("function_id").orderBy(F.desc("updated_at"), F.desc("start_line"))
    return functions.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def distinct_bodies(functions: DataFrame) -> DataFrame:
    """One function a body: the first by identifier."""
    return functions.groupBy("body_hash").agg(F.min("function_id").alias("function_id"), F.count(F.lit(1)).alias("functions"))


def derivations(functions: DataFrame, version: str | None = None) -> DataFrame:
    """(body_hash, fingerprint, embedding, embed_version): reusable results by content, one a body, the latest.

    With ``version`` the vectors of other recipes are left out; fingerprints are reusable whatever the recipe.
    """
    rows = functions.where(F.col("fingerprint").isNotNull() & (F.size("embedding") > 0))
    if version is not None:
        rows = rows.where(F.col("embed_version") == version)
    kept = F.max_by(F.struct("fingerprint", "embedding", "embed_version"), F.struct("updated_at", "function_id")).alias("d")
    return rows.groupBy("body_hash").agg(kept).select("body_hash", "d.*")


def cache_lookup(functions: DataFrame, cache: DataFrame) -> DataFrame:
    """``functions`` with ``hit``: whether their body is in ``cache``; a body of any frequency is spread."""
    known = cache.select("body_hash").where(F.col("body_hash").isNotNull()).distinct().withColumn("hit", F.lit(True))
    joined = salted_lookup(functions, known, "body_hash", F.xxhash64("function_id"), HOT_ROWS, how="left")
    return joined.withColumn("hit", F.coalesce("hit", F.lit(False)))


def attach(functions: DataFrame, derived: DataFrame) -> DataFrame:
    """``functions`` with the fingerprint and vector of their body, nulls where there is none."""
    return salted_lookup(functions.drop("fingerprint", "embedding", "embed_version"), derived, "body_hash", F.xxhash64("function_id"), HOT_ROWS, how="left")


def exploded(clusters: DataFrame) -> DataFrame:
    """(cluster_id, canonical_id, position, function_id): a row a listed member, repeats included."""
    return clusters.select("cluster_id", "canonical_id", F.posexplode("function_ids").alias("position", "function_id"))


def member_rows(clusters: DataFrame, functions: DataFrame) -> DataFrame:
    """Listed members that exist, canonical first and else in their order: ``place`` counts from 1."""
    rows = exploded(clusters).join(functions.select("function_id", "name", "file", "loc"), "function_id")
    order = Window.partitionBy("cluster_id").orderBy((F.col("function_id") != F.col("canonical_id")).cast("int"), "position")
    return rows.select("cluster_id", F.row_number().over(order).alias("place"), "function_id", "name", "file", "loc")


def counts_with_zero(keys: DataFrame, rows: DataFrame, by: str, name: str) -> DataFrame:
    """(by, name): the number of ``rows`` of each of ``keys``, 0 where there is none."""
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias(name))
    return keys.select(by).join(counts, by, "left").select(by, F.coalesce(name, F.lit(0)).alias(name))


def not_indexed(snapshots: DataFrame, functions: DataFrame, by: str) -> DataFrame:
    """Snapshots without a stored function."""
    return snapshots.join(functions.select(by).distinct(), by, "left_anti")


def candidate_bodies(candidates: DataFrame, functions: DataFrame) -> DataFrame:
    """(candidate_id, members of (position, function_id, body, domain)): in the candidate's order, '' and 'unknown' where there is none."""
    listed = candidates.select("candidate_id", F.posexplode("member_ids").alias("position", "function_id"))
    rows = listed.join(functions.select("function_id", "body", F.col("fingerprint.domain").alias("domain")), "function_id", "left")
    member = F.struct("position", "function_id", F.coalesce("body", F.lit("")).alias("body"), F.coalesce("domain", F.lit("unknown")).alias("domain"))
    return rows.groupBy("candidate_id").agg(F.array_sort(F.collect_list(member)).alias("members"))


def removable_lines(clusters: DataFrame, functions: DataFrame) -> DataFrame:
    """(cluster_id, lines_removable): lines of all members but the canonical one; unknown members count 0."""
    rows = exploded(clusters).join(functions.select("function_id", "loc"), "function_id", "left")
    lines = F.when(F.col("function_id") != F.col("canonical_id"), F.coalesce("loc", F.lit(0))).otherwise(0)
    return rows.groupBy("cluster_id").agg(F.sum(lines).cast("bigint").alias("lines_removable"))


def used_by(clusters: DataFrame, functions: DataFrame) -> DataFrame:
    """(function_id, modules): the modules of all members of a function's clusters, else its own."""
    members = exploded(clusters).select("cluster_id", "function_id").distinct()
    homes = functions.select("function_id", text.module_of(F.col("file")).alias("module"))
    known = members.join(homes, "function_id").select("cluster_id", "module").distinct()
    seen = members.join(known, "cluster_id").select("function_id", "module").distinct()
    seen = seen.groupBy("function_id").agg(F.array_sort(F.collect_set("module")).alias("modules"))
    return homes.join(seen, "function_id", "left").select("function_id", F.coalesce("modules", F.array("module")).alias("modules"))


def canonical_modules(clusters: DataFrame, functions: DataFrame) -> DataFrame:
    """(cluster_id, elsewhere): members that live in another module than their existing canonical function."""
    homes = functions.select("function_id", text.module_of(F.col("file")).alias("module"))
    rows = exploded(clusters).where("function_id <> canonical_id").join(homes, "function_id")
    canonical = homes.select(F.col("function_id").alias("canonical_id"), F.col("module").alias("home"))
    return rows.join(canonical, "canonical_id").groupBy("cluster_id").agg(F.count_if(F.col("module") != F.col("home")).alias("elsewhere"))


def labelled(pairs: DataFrame, functions: DataFrame) -> DataFrame:
    """Labelled pairs whose ends both exist, with the domains of their functions."""
    side = functions.select("function_id", F.col("fingerprint.domain").alias("domain"))
    left = side.select(F.col("function_id").alias("a"), F.col("domain").alias("domain_a"))
    right = side.select(F.col("function_id").alias("b"), F.col("domain").alias("domain_b"))
    return pairs.join(left, "a").join(right, "b")


def overlaps(functions: DataFrame, ranges: DataFrame, on: list[str], bin_lines: int = 64) -> DataFrame:
    """(function_id, low, high): functions with each [low, high] of the same ``on`` that meets their [start_line, end_line].

    Lines are binned, so the join has an equality on the bin and stays a hash join; ranges are merged per bin first.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_lines), F.floor(F.col(b) / bin_lines)))
    binned = ranges.where("low <= high").withColumn("_bin", bins("low", "high")).select(*on, "_bin", F.col("low").alias("_low"), F.col("high").alias("_high")).distinct()
    spread = functions.where("start_line <= end_line").select("function_id", *on, "start_line", "end_line").withColumn("_bin", bins("start_line", "end_line"))
    met = spread.join(binned, [*on, "_bin"]).where("start_line <= _high and _low <= end_line")
    return met.select("function_id", F.col("_low").alias("low"), F.col("_high").alias("high")).distinct()


def overlapping(functions: DataFrame, ranges: DataFrame, on: list[str], bin_lines: int = 64) -> DataFrame:
    """Functions whose [start_line, end_line] overlaps a [low, high] of the same ``on``; a semi join."""
    return functions.join(overlaps(functions, ranges, on, bin_lines).select("function_id").distinct(), "function_id", "left_semi")
