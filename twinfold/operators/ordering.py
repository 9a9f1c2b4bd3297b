"""Orders, pages and canonical forms of sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..runtime import stage


def placed(df: DataFrame, *order: Column, by: list[str] | None = None, name: str = "place") -> DataFrame:
    """``df`` with each row's place in a total order (within ``by``).

    Without ``by`` the rows are sorted by ranges, numbered within each, and moved up by the sizes of the ranges before.
    """
    if not by:
        bits = 33  # monotonically_increasing_id holds the partition above these, the row's number below
        rows = stage(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "placed")
        part, within = F.shiftright("_at", bits), F.col("_at").bitwiseAND(F.lit((1 << bits) - 1))
        sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row a partition
        before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sizes = F.broadcast(sizes.select("_part", before.alias("_before")))
        return rows.withColumn("_part", part).join(sizes, "_part").withColumn(name, F.col("_before") + within + 1).drop("_at", "_part", "_before")
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def risk_rank(risk: Column) -> Column:
    return F.when(risk == "semantic", 0).when(risk == "cosmetic", 1).otherwise(2)


def by_confidence() -> list[Column]:
    return [F.desc_nulls_last("confidence"), F.desc_nulls_last("cohesion"), F.col("cluster_id")]


def by_risk() -> list[Column]:
    return [risk_rank(F.col("disagreement_risk")), F.desc_nulls_last("confidence"), F.desc_nulls_last("cohesion"), F.col("cluster_id")]


def by_interest() -> list[Column]:
    """Repositories whose statistics are missing last; then by proven divergences, clusters, functions and name."""
    return [F.col("health_score").isNull().cast("int"), F.desc("proven"), F.desc_nulls_last("duplicate_clusters"), F.desc_nulls_last("functions"), F.concat("owner", F.lit("/"), "name"), F.col("repo_id")]


def by_state() -> list[Column]:
    """Findings that are proven, then suspected, then new."""
    return [F.when(F.col("state") == "proven", 0).when(F.col("state") == "suspected", 1).otherwise(2)]


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> tuple[DataFrame, dict[str, int]]:
    """One page, and the counts that go with it; at least one page."""
    if number < 1 or size < 1:
        raise ValueError("pages and their sizes start at 1")
    total = df.count()
    meta = {"page": number, "limit": size, "total": total, "total_pages": max(1, -(-total // size))}
    return df.orderBy(*order).offset((number - 1) * size).limit(size), meta


def capped(df: DataFrame, order: list[Column], most: int, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` rows of each ``by``, and the rows left out: a cap never drops silently."""
    ranked = placed(df, *order, by=by, name="_place")
    return ranked.where(F.col("_place") <= most).drop("_place"), ranked.where(F.col("_place") > most).drop("_place")


def refuse_over(df: DataFrame, most: int) -> DataFrame:
    """``df`` itself, or an error if it has more than ``most`` rows."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows: refused rather than cut")
    return df


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of every owner and name."""
    order = [F.desc_nulls_last("indexed_at"), F.col("repo_id")]
    return placed(snapshots, *order, by=["owner", "name"], name="_place").where("_place = 1").drop("_place")


def json_arrays(inputs: Column) -> Column:
    """Distinct array-typed JSON texts in their canonical form; everything else is left out."""
    parsed = F.transform(inputs, lambda x: F.try_parse_json(x))
    arrays = F.filter(parsed, lambda v: v.isNotNull() & F.schema_of_variant(v).startswith("ARRAY"))
    return F.array_distinct(F.transform(arrays, lambda v: F.to_json(v)))


def distinct_imports(static: Column, required: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(static, required)))


def distinct_member_sets(clusters: DataFrame) -> DataFrame:
    """(member_key, clusters): clusters that list the same members, in whatever order and however often."""
    key = text.member_key(F.array_distinct("function_ids"))
    return clusters.groupBy(key.alias("member_key")).agg(F.count(F.lit(1)).alias("clusters"))
