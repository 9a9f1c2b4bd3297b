"""Data-quality checks: each returns the rows that break a rule, with the rule's name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule): a row for each rule that a row of ``df`` breaks; null counts as broken. One pass."""
    broken = [F.when(F.coalesce(rule, F.lit(False)), None).otherwise(F.lit(name)) for name, rule in rules.items()]
    return df.select(F.col(key), F.explode(F.array_compact(F.array(*broken))).alias("rule"))


def function_rules() -> dict[str, Column]:
    return {
        "loc is the span of lines": F.col("loc") == F.col("end_line") - F.col("start_line") + 1,
        "hash is that of the body": F.lower("body_hash") == text.body_hash(F.col("body")),
        "signature is not empty": F.length("signature") > 0,
    }


def cluster_rules() -> dict[str, Column]:
    return {
        "members are distinct": F.size("function_ids") == F.size(F.array_distinct("function_ids")),
        "two members at least": F.size("function_ids") >= 2,
        "canonical is a member": F.array_contains("function_ids", F.col("canonical_id")),
        "confidence within 0 and 1": F.col("confidence").between(0, 1),
        "cohesion within -1 and 1": F.col("cohesion").between(-1, 1),
        "risk is known": F.col("disagreement_risk").isin("none", "cosmetic", "semantic"),
    }


def proof_rules() -> dict[str, Column]:
    """Of clusters with (proven, divergence of (executed, rows))."""
    executed = F.coalesce(F.col("divergence.executed"), F.lit(False))
    differs = F.coalesce(F.exists("divergence.rows", lambda r: r["diverged"]), F.lit(False))
    return {"proven was executed": ~F.col("proven") | executed, "executed and diverged is proven": ~(executed & differs) | F.col("proven")}


def total_rules() -> dict[str, Column]:
    """Of repositories' statistics beside what their clusters sum up to."""
    return {
        "clusters are those stored": F.col("duplicate_clusters") == F.col("stored_clusters"),
        "suspected are at least those proven": F.col("conflicts") >= F.col("stored_proven"),
        "removable lines are the sum": F.col("lines_removable") == F.col("stored_lines"),
        "score within 0 and 100": F.col("health_score").between(0, 100),
        "analysed are at most all": F.col("functions_analyzed") <= F.col("functions_total"),
    }


def missing_members(clusters: DataFrame, functions: DataFrame) -> DataFrame:
    """(cluster_id, function_id): listed members that have no row."""
    listed = clusters.select("cluster_id", F.explode("function_ids").alias("function_id")).distinct()
    return listed.join(functions.select("function_id"), "function_id", "left_anti")


def table_rules(tables: DataFrame) -> DataFrame:
    """(group_id, input, rule) over divergence tables (group_id, members, input, results, diverged)."""
    keys = F.transform("results", lambda r: F.coalesce(r["error"], r["output"]))
    rules = {
        "every result has an output or an error": F.forall("results", lambda r: r["output"].isNotNull() | r["error"].isNotNull()),
        "every member has a result": F.size("results") == F.col("members"),
        "diverged is as recomputed": F.col("diverged") == (F.size(F.array_distinct(keys)) > 1),
    }
    return reduce(lambda a, b: a.unionByName(b), [tables.where(~F.coalesce(rule, F.lit(False))).select("group_id", "input", F.lit(name).alias("rule")) for name, rule in rules.items()])
