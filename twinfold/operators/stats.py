"""Aggregates over functions, clusters, judgements and execution results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..params import DEFAULTS, Params
from .members import exploded

# Fixed values of the health score.
CONFLICT, DUPLICATE, NEAR, LEAST_SCALE, SATURATION = 6, 2, 1, 50, 0.27


def health_score(functions: Column, clusters: Column, conflicts: Column, near: Column) -> Column:
    """100 without findings, falling to 0 as weighted findings a function reach saturation."""
    clusters = F.greatest(clusters, F.lit(0))
    conflicts = F.least(F.greatest(conflicts, F.lit(0)), clusters)
    units = CONFLICT * conflicts + DUPLICATE * (clusters - conflicts) + NEAR * F.greatest(near, F.lit(0))
    density = units / F.greatest(functions, F.lit(LEAST_SCALE))
    score = 100 * (1 - F.least(F.lit(1.0), density / SATURATION))
    return F.when(units == 0, 100).otherwise(F.floor(text.clamp(score, 0.0, 100.0) + 0.5)).cast("int")


def totals(functions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(repo_id, functions, functions_analyzed, functions_total): the total is the snapshot's where it has one above 0, else what was analysed."""
    counts = functions.groupBy("repo_id").agg(F.count(F.lit(1)).alias("functions"))
    known = snapshots.groupBy("repo_id").agg(F.max("stats.functions_total").cast("bigint").alias("known"))
    out = counts.join(known, "repo_id", "left")
    return out.select("repo_id", "functions", F.col("functions").alias("functions_analyzed"), F.coalesce(F.when(F.col("known") > 0, F.col("known")), "functions").alias("functions_total"))


def repo_stats(functions: DataFrame, clusters: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """One row a repository of ``functions``: counts, duplicates, removable lines, health.

    A member counts for its cluster wherever its row lives; lines, call sites and reinventions are those of the
    confirmed clusters of the repository.
    """
    module = text.module_of(F.col("file"))
    base = functions.groupBy("repo_id").agg(F.count(F.lit(1)).alias("functions"), F.countDistinct("file").alias("files"), F.countDistinct(module).alias("modules"))
    sure = F.col("confidence") >= params.confirm_threshold
    found = clusters.groupBy("repo_id").agg(
        F.count_if(sure).alias("duplicate_clusters"),
        F.count_if(sure & (F.col("disagreement_risk") == "semantic")).alias("conflicts"),
        F.count_if(~sure).alias("near_duplicates"),
    )
    confirmed = clusters.where(sure)
    home = functions.select("function_id", "loc", module.alias("module"))
    members = exploded(confirmed).join(confirmed.select("cluster_id", "repo_id"), "cluster_id").where("function_id <> canonical_id").join(home, "function_id")
    canonical = home.select(F.col("function_id").alias("canonical_id"), F.col("module").alias("home"))
    members = members.join(canonical, "canonical_id", "left").groupBy("repo_id")
    members = members.agg(
        F.sum("loc").cast("bigint").alias("lines_removable"),
        F.count(F.lit(1)).alias("call_sites"),
        F.count_if(F.col("home").isNotNull() & (F.col("module") != F.col("home"))).alias("reinvented"),
    )
    grouped = confirmed.select(F.explode("function_ids").alias("function_id")).distinct()
    reusable = functions.where(F.col("is_pure") & F.col("is_exported")).join(grouped, "function_id", "left_anti")
    reusable = reusable.groupBy("repo_id").agg(F.count(F.lit(1)).alias("reusable"))
    out = base.join(found, "repo_id", "left").join(members, "repo_id", "left").join(reusable, "repo_id", "left")
    counts = ["duplicate_clusters", "conflicts", "near_duplicates", "lines_removable", "call_sites", "reinvented", "reusable"]
    out = out.na.fill(0, counts)
    return out.withColumn("health_score", health_score(F.col("functions"), F.col("duplicate_clusters"), F.col("conflicts"), F.col("near_duplicates")))


def portfolio(stats: DataFrame) -> DataFrame:
    """The repositories' rows and one of their totals (``repo_id`` null)."""
    sums = ["functions", "duplicate_clusters", "conflicts", "near_duplicates", "lines_removable"]
    out = stats.rollup("repo_id").agg(F.count(F.lit(1)).alias("repos"), *[F.sum(c).cast("bigint").alias(c) for c in sums])
    return out


def reconciled(stats: DataFrame, clusters: DataFrame, proven: Column) -> DataFrame:
    """Per repository and in total (``repo_id`` null): confirmed clusters by the statistics against stored ones, with those proven."""
    stored = clusters.groupBy("repo_id").agg(F.count(F.lit(1)).alias("stored"), F.count_if(proven).alias("proven"))
    rows = stats.join(stored, "repo_id", "left").na.fill(0, ["stored", "proven"])
    sums = ["functions", "duplicate_clusters", "stored", "near_duplicates", "conflicts", "proven", "lines_removable"]
    return rows.rollup("repo_id").agg(*[F.sum(c).cast("bigint").alias(c) for c in sums], F.when(F.grouping("repo_id") == 0, F.max("health_score")).alias("health_score"))


def sweep(pairs: DataFrame, low: int = 60, high: int = 95) -> DataFrame:
    """The confusion matrix of 'cosine >= threshold' over (is_clone, cosine), by hundredths.

    One pass: pairs are counted by the highest hundredth they reach, then summed downwards over at most 36 rows.
    """
    reached = F.least(F.greatest(F.floor(F.col("cosine") * 100 + 1e-9), F.lit(low - 1)), F.lit(high)).cast("int")
    counts = pairs.where(F.col("cosine").isNotNull()).groupBy(reached.alias("h")).agg(F.count_if("is_clone").alias("p"), F.count_if(~F.col("is_clone")).alias("n"))
    steps = pairs.sparkSession.range(low - 1, high + 1).select(F.col("id").cast("int").alias("h"))
    table = steps.join(counts, "h", "left").na.fill(0, ["p", "n"])
    up, all_rows = Window.orderBy(F.desc("h")), Window.partitionBy()
    table = table.select(
        "h",
        F.sum("p").over(up).alias("tp"),
        F.sum("n").over(up).alias("fp"),
        F.sum("p").over(all_rows).alias("all_p"),
        F.sum("n").over(all_rows).alias("all_n"),
    )
    table = table.where(F.col("h") >= low).select(
        (F.col("h") / 100).alias("threshold"), "tp", "fp", (F.col("all_p") - F.col("tp")).alias("fn"), (F.col("all_n") - F.col("fp")).alias("tn")
    )
    return table.select(
        "*",
        F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"),
        F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"),
        F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)).alias("f1"),
    )


def best_threshold(swept: DataFrame) -> DataFrame:
    """The row of the largest F1, the lowest threshold of a tie."""
    return swept.orderBy(F.desc("f1"), "threshold").limit(1)


def distribution(values: DataFrame, by: str, value: str, buckets: int = 4096) -> DataFrame:
    """Count, least, upper median, mean and largest of ``value`` by ``by``; the median is exact and an actual value.

    The median's bucket is found from at most ``buckets`` counts a group, and only the distinct values in it are
    ordered: no group is ever sorted by one task.
    """
    rows = values.where(F.col(value).isNotNull()).select(F.col(by).alias("g"), F.col(value).alias("v"))
    size = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.avg("v").alias("mean"), F.max("v").alias("largest"))
    span = F.nullif(F.col("largest") - F.col("least"), F.lit(0.0))
    bucket = F.coalesce(F.floor((F.col("v") - F.col("least")) / span * buckets), F.lit(0))
    counts = rows.join(size.withColumnRenamed("g", "sg"), F.col("g").eqNullSafe(F.col("sg"))).select("g", "v", bucket.alias("k"), F.floor(F.col("n") / 2).alias("at"))
    held = counts.groupBy("g", "k", "at").agg(F.count(F.lit(1)).alias("c"))
    up = F.sum("c").over(Window.partitionBy("g").orderBy("k"))
    held = held.withColumn("_up", up).where((F.col("_up") > F.col("at")) & (F.col("_up") - F.col("c") <= F.col("at"))).select("g", "k", (F.col("_up") - F.col("c")).alias("before"))
    inside = counts.join(held.withColumnsRenamed({"g": "hg", "k": "hk"}), (F.col("hk") == F.col("k")) & F.col("hg").eqNullSafe(F.col("g")))
    inside = inside.groupBy("g", "v", "at", "before").agg(F.count(F.lit(1)).alias("c"))
    inside = inside.withColumn("_up", F.col("before") + F.sum("c").over(Window.partitionBy("g").orderBy("v"))).where((F.col("_up") > F.col("at")) & (F.col("_up") - F.col("c") <= F.col("at")))
    middle = inside.select(F.col("g").alias("mg"), F.col("v").alias("median"))
    return size.join(middle, F.col("g").eqNullSafe(F.col("mg"))).select(F.col("g").alias(by), "n", "least", "median", "mean", "largest")


def divergence(cells: DataFrame) -> DataFrame:
    """(group_id, input, results, diverged): cells (group_id, input, member, output, error, key) by input.

    A row diverges if its members have more than one key. Outputs are listed by member.
    """
    result = F.struct("member", "output", F.nullif("error", F.lit("")).alias("error"))
    out = cells.groupBy("group_id", "input").agg(F.array_sort(F.collect_list(result)).alias("results"), F.countDistinct("key").alias("_keys"))
    return out.select("group_id", "input", "results", (F.col("_keys") > 1).alias("diverged"))


def reference_keys(cells: DataFrame) -> DataFrame:
    """(group_id, input, reference): the canonical member's key, else the key that most members share, else null."""
    canonical = F.max(F.when(F.col("is_canonical"), F.col("key"))).alias("c")
    counts = cells.groupBy("group_id", "input", "key").agg(F.count(F.lit(1)).alias("n"), canonical)
    top = F.min(F.struct((-F.col("n")).alias("d"), "key")).alias("t")
    out = counts.groupBy("group_id", "input").agg(F.max("c").alias("c"), top)
    return out.select("group_id", "input", F.coalesce("c", F.when(F.col("t.d") < -1, F.col("t.key"))).alias("reference"))


def usage(calls: DataFrame, by: str, amount: str) -> DataFrame:
    return calls.groupBy(by).agg(F.count(F.lit(1)).alias("calls"), F.sum(amount).alias("total"))


def index_report(functions: DataFrame) -> DataFrame:
    return functions.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("functions"),
        F.count_if("is_pure").alias("pure"),
        F.count_if("is_exported").alias("exported"),
        F.count_if(~F.col("is_exported")).alias("internal"),
        F.countDistinct("file").alias("files"),
    )
