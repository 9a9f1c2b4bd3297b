"""Problem 3: pairwise matches consolidated into groups by low-diameter decomposition.

One round: every vertex draws an exponential head start, drawn again if it exceeds ``RADIUS``; clusters grow from the shifted
start times, so a vertex joins the centre that reaches it first. With head starts of at most ``radius`` the winning
centre is at most that many links away, so ``radius`` relaxations give the decomposition exactly. Clusters contract
to super-vertices, the next round runs on the links between clusters, and the assignments are composed backwards.

Defined results
    null ends, equal ends    no link
    repeated links           count once, in either direction
    empty table              no rows
    vertices without a link  don't come out
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import HOT_ROWS, free, hot_keys, salted_lookup, stage

#: The rate of the head starts and where they are cut off, in links.
BETA, RADIUS = 0.3, 6


def _head_start(vertex: Column, turn: int) -> Column:
    """Exponential under the condition that it is less than ``RADIUS``, as if longer ones were drawn again."""
    uniform = (F.pmod(F.xxhash64(vertex, F.lit(turn)), F.lit(1 << 40)) + F.lit(0.5)) / float(1 << 40)
    return -F.log(1 - uniform * (1 - math.exp(-BETA * RADIUS))) / BETA


def _decompose(links: DataFrame, hot: DataFrame, turn: int) -> DataFrame:
    """(v, centre) of every vertex in the symmetric ``links`` (s, t)."""
    vertices = links.select(F.col("s").alias("v")).distinct()
    state = vertices.select("v", (F.lit(float(RADIUS)) - _head_start(F.col("v"), turn)).alias("at"), F.col("v").alias("centre"))
    # a link of length 0 to itself keeps what a vertex has, so that each step reads the state once
    steps = links.withColumn("far", F.lit(1.0)).unionByName(vertices.select(F.col("v").alias("s"), F.col("v").alias("t"), F.lit(0.0).alias("far")))
    for _ in range(RADIUS):
        arrive = salted_lookup(steps, state.withColumnRenamed("v", "s"), "s", F.xxhash64("t"), hot=hot)
        best = F.min(F.struct((F.col("at") + F.col("far")).alias("at"), "centre")).alias("b")
        state = arrive.groupBy(F.col("t").alias("v")).agg(best).select("v", "b.at", "b.centre")
    return stage(state.select("v", "centre"), "p3-cluster")


def groups(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(``vertex``, ``group_id``): every linked vertex with the smallest vertex reachable from it."""
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = edges.select(F.least(a, b).alias("s"), F.greatest(a, b).alias("t")).distinct()
    edges = stage(edges.unionByName(edges.select(F.col("t").alias("s"), F.col("s").alias("t"))), "p3-links")
    levels: list[tuple[DataFrame, DataFrame]] = []
    while not edges.isEmpty():
        if len(levels) == max_rounds:
            raise RuntimeError(f"links remain after {max_rounds} rounds")
        hot = stage(hot_keys(edges, "s", hot_rows), "p3-hot")
        hot._rows = hot.count()
        cluster = _decompose(edges, hot, len(levels))
        # the smallest original vertex within every super-vertex
        own = cluster.withColumn("low", F.col("v")) if not levels else cluster.join(levels[-1][1].select(F.col("centre").alias("v"), "low"), "v")
        levels.append((cluster, stage(own.groupBy("centre").agg(F.min("low").alias("low"), F.count(F.lit(1)).alias("_n")), "p3-low")))
        moved = salted_lookup(edges, cluster.select(F.col("v").alias("s"), F.col("centre").alias("cs")), "s", F.xxhash64("t"), hot=hot)
        hot_t = hot.withColumnRenamed("s", "t")  # the links are symmetric
        hot_t._rows = hot._rows
        moved = salted_lookup(moved, cluster.select(F.col("v").alias("t"), F.col("centre").alias("ct")), "t", F.xxhash64("s"), hot=hot_t)
        between = stage(moved.where("cs <> ct").select(F.col("cs").alias("s"), F.col("ct").alias("t")).distinct(), "p3-between")
        free(edges, hot)
        edges = between
    if not levels:
        return edges.select(F.col("s").alias("vertex"), F.col("t").alias("group_id"))
    above = None
    for k, (cluster, low) in enumerate(reversed(levels)):
        # a super-vertex that took part in the next round has its group from there, else its own smallest vertex
        answer = low.select("centre", F.col("low").alias("group_id"))
        if above is not None:
            answer = low.join(above.select(F.col("v").alias("centre"), "group_id"), "centre", "left").select("centre", F.coalesce("group_id", "low").alias("group_id"))
        hot = stage(low.where(F.col("_n") > hot_rows).select("centre", F.ceil(F.col("_n") / hot_rows).cast("int").alias("_slices")), "p3-hot")
        above = salted_lookup(cluster, answer, "centre", F.xxhash64("v"), hot=hot).select("v", "group_id")
        if k + 1 < len(levels):
            above = stage(above, "p3-above")
    return above.select(F.col("v").alias("vertex"), "group_id")


def clone_links(pairs: DataFrame) -> DataFrame:
    """The rows of labelled_pair that link their ends: label 'clone' without regard to case and outer white space."""
    label = F.lower(F.regexp_replace("label", r"^[\p{IsWhite_Space}]+|[\p{IsWhite_Space}]+$", ""))
    return pairs.where(label == "clone").select("a", "b")


def found(pairs: DataFrame) -> DataFrame:
    return groups(clone_links(pairs)).select("group_id", F.col("vertex").alias("function_id"))
