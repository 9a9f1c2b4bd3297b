"""Views of stored results: repositories, clusters, findings of a change, and a diagnosis of the clustering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..params import DEFAULTS
from . import members, ordering, similarity

# From which health score a repository is in the upper and the middle band.
GOOD, FAIR = 80, 50


def diverged(divergence: Column) -> Column:
    """Whether the code was run and a row of the results differs; ``divergence`` has (executed, rows of (input, diverged))."""
    return F.coalesce(divergence["executed"] & F.exists(divergence["rows"], lambda r: r["diverged"]), F.lit(False))


def verdict(confidence: Column, risk: Column, proven: Column, claim: float = DEFAULTS.claim_threshold) -> Column:
    """What is said of a cluster: a lead below the claim threshold, else by its risk and whether it is proven."""
    sure = F.when(risk == "semantic", F.when(proven, "conflict").otherwise("suspected")).when(risk == "cosmetic", "cosmetic").otherwise("none")
    return F.when(F.coalesce(confidence, F.lit(0.0)) < claim, "lead").otherwise(sure)


def health_band(score: Column) -> Column:
    return F.when(score >= GOOD, "good").when(score >= FAIR, "fair").otherwise("poor")


def finding_state(verdict: Column, match: Column, executed: Column) -> Column:
    """New without a match or by verdict, else proven if both functions were run, else suspected."""
    return F.when((verdict == "novel") | match.isNull(), "novel").when(executed, "proven").otherwise("suspected")


def pair_verdict(status: Column, confidence: Column, threshold: float = DEFAULTS.confirm_threshold) -> Column:
    """(confidence, verdict) of an adjudicated pair: a refusal means new, a failure is a near duplicate of confidence 0."""
    sure = text.round2(confidence)
    return (
        F.when(status == "rejected", F.struct(F.lit(0.0).alias("confidence"), F.lit("novel").alias("verdict")))
        .when(status == "failed", F.struct(F.lit(0.0).alias("confidence"), F.lit("near-duplicate").alias("verdict")))
        .otherwise(F.struct(sure.alias("confidence"), F.when(confidence >= threshold, "duplicate").otherwise("near-duplicate").alias("verdict")))
    )


def repositories(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of every repository, newest first: what a list shows."""
    rows = ordering.latest_snapshots(snapshots).select("repo_id", "owner", "name", "commit_sha", "indexed_at")
    return ordering.placed(rows, F.desc_nulls_last("indexed_at"), F.col("repo_id"))


def cluster_summaries(clusters: DataFrame, functions: DataFrame, proven: Column) -> DataFrame:
    """A row a cluster: members, removable lines, whether it is proven, its place in its repository."""
    lines = members.removable_lines(clusters, functions)
    rows = clusters.withColumn("proven", proven).join(lines, "cluster_id")
    rows = ordering.placed(rows, *ordering.by_confidence(), by=["repo_id"])
    return rows.select("repo_id", "cluster_id", "domain", "behavior_summary", F.size("function_ids").alias("member_count"), "confidence", "disagreement_risk", "proven", "lines_removable", "place")


def repository_detail(snapshots: DataFrame, clusters: DataFrame, functions: DataFrame, proven: Column) -> DataFrame:
    """Every snapshot with its stored statistics and the summaries of its clusters, in order; no function row but the members' is read."""
    rows = cluster_summaries(clusters, functions, proven)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "cluster_id", "member_count", "proven", "lines_removable"))), lambda x: x)
    return snapshots.select("repo_id", "owner", "name", "commit_sha", "indexed_at", "stats").join(rows.groupBy("repo_id").agg(listed.alias("clusters")), "repo_id", "left")


def cluster_detail(clusters: DataFrame, functions: DataFrame) -> DataFrame:
    """The members of every cluster that exist, canonical first and else in their order, with what a page shows of them."""
    shown = functions.select("function_id", "start_line", "end_line", "body", "is_pure")
    rows = members.member_rows(clusters, functions).join(clusters.select("cluster_id", "canonical_id"), "cluster_id").join(shown, "function_id")
    return rows.withColumn("is_canonical", F.col("function_id") == F.col("canonical_id")).drop("canonical_id")


def ranked_repositories(stats: DataFrame, snapshots: DataFrame, clusters: DataFrame, proven: Column) -> DataFrame:
    """Snapshots by interest: statistics that are missing last, then proven divergences, clusters, functions, name."""
    counts = clusters.groupBy("repo_id").agg(F.count_if(proven).alias("proven"))
    rows = snapshots.select("repo_id", "owner", "name").join(stats.select("repo_id", "functions", "duplicate_clusters", "health_score"), "repo_id", "left")
    rows = rows.join(counts, "repo_id", "left").na.fill(0, ["proven"])
    return ordering.placed(rows, *ordering.by_interest())


def known_overlaps(clusters: DataFrame, functions: DataFrame, ranges: DataFrame, on: list[str]) -> DataFrame:
    """(function_id, cluster_id, low, high): members of stored clusters whose lines a change touches, with the first range that does.

    ``ranges`` has (on, low, high). A member of several clusters is named with the last in their order.
    """
    listed = members.exploded(clusters).select("cluster_id", "function_id").distinct()
    order = Window.partitionBy("function_id").orderBy(F.asc_nulls_first("confidence"), F.asc_nulls_first("cohesion"), F.desc("cluster_id"))
    of = listed.join(clusters.select("cluster_id", "confidence", "cohesion"), "cluster_id").withColumn("_r", F.row_number().over(order)).where("_r = 1").select("function_id", "cluster_id")
    inside = members.overlaps(functions.join(of.select("function_id"), "function_id", "left_semi"), ranges, on)
    first = inside.groupBy("function_id").agg(F.min(F.struct("low", "high")).alias("r"))
    return first.join(of, "function_id").select("function_id", "cluster_id", "r.low", "r.high")


def feasibility(changes: DataFrame, patches: DataFrame, declarations: DataFrame, overlaps: DataFrame, indexed: DataFrame) -> DataFrame:
    """A row a change: its files, those in the indexed tree, added functions, touched members, and whether it has any.

    ``changes`` (change_id, file), ``patches`` (change_id, file), ``declarations`` (change_id, line), ``overlaps``
    (change_id, function_id), ``indexed`` (file) of the indexed members.
    """
    files = changes.groupBy("change_id").agg(F.count(F.lit(1)).alias("files"))
    tree = patches.join(indexed.select("file").distinct(), "file", "left_semi").groupBy("change_id").agg(F.count(F.lit(1)).alias("in_tree"))
    added = declarations.groupBy("change_id").agg(F.count(F.lit(1)).alias("added"))
    hits = overlaps.groupBy("change_id").agg(F.count(F.lit(1)).alias("hits"))
    rows = files.join(tree, "change_id", "left").join(added, "change_id", "left").join(hits, "change_id", "left").na.fill(0, ["in_tree", "added", "hits"])
    return rows.withColumns({"touches_duplicate": F.col("hits") > 0, "adds_functions": F.col("added") > 0, "touches_tree": F.col("in_tree") > 0})


def finding_counts(findings: DataFrame, by: str) -> DataFrame:
    """Findings (verdict, match, executed) by ``by``: duplicates, states, and whether each gate would fail."""
    state = finding_state(F.col("verdict"), F.col("match"), F.col("executed"))
    duplicate = F.col("verdict").isin("duplicate", "near-duplicate")
    out = findings.groupBy(by).agg(
        F.count_if(duplicate).alias("duplicates"),
        F.count_if(F.col("executed")).alias("executed"),
        *[F.count_if(state == s).alias(s) for s in ("proven", "suspected", "novel")],
    )
    return out.withColumns({"fails_on_duplicate": F.col("duplicates") > 0, "fails_on_proven": F.col("executed") > 0})


def gate(findings: DataFrame, fail_on: str) -> None:
    """Raise if the findings break the gate: 'none', 'duplicate' or 'proven-divergence'."""
    broken = {"none": F.lit(False), "duplicate": F.col("verdict").isin("duplicate", "near-duplicate"), "proven-divergence": F.col("executed")}
    if fail_on not in broken:
        raise ValueError(f"no gate is called {fail_on}")
    n = findings.where(broken[fail_on]).count()
    if n:
        raise ValueError(f"{n} findings break the gate {fail_on}")


def diagnose(functions: DataFrame, name: str, candidates: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Pairs (a, b, similarity) among the functions called ``name``, least similar first; and the candidates that hold any of them."""
    same = functions.where((F.col("name") == name) & (F.size("embedding") > 0))
    rows = same.select(F.col("function_id").alias("id"), F.col("embedding").alias("vector"), F.lit("").alias("block"))
    pairs = similarity.similar_pairs(rows, -2.0, compatible=False).orderBy("similarity", "a", "b")
    if candidates is None:
        return pairs, None
    members_ = candidates.withColumn("member", F.explode("member_ids")).join(same.select(F.col("function_id").alias("member")), "member", "left_semi")
    return pairs, members_.groupBy("member_ids", "cohesion").agg(F.count(F.lit(1)).alias("named"))
