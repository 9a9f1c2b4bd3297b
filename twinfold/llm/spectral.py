"""Problem 2: clusters of functions alike in behaviour, by power-iteration spectral clustering.

The affinities are the cosines of at least ``MIN_COSINE`` (sparse, found by the projection trees of
:mod:`vector_search`), with 1 on the diagonal, each row normalised to sum 1. Several distributed vectors of hashed
starting values are multiplied by this matrix until they stand still; within a group of mutually similar vectors all
values become equal, between groups they differ. The rows of this embedding are clustered by k-means: seeds are the
occupied cells of a fine grid, a seed close to a heavier one gives way, points go to the nearest seed, and the centres
move to the means of their points until no point changes. A last exact check splits clusters whose parts have no affinity (groups that came into one cell by chance) and joins clusters
between which one remains (groups too stretched to have come to rest).

Equal vectors are one class, weighted by its members, so copies cost nothing.

Defined results
    unusable vectors    belong to no cluster (see vector_search)
    repeated rows       one identifier counts once
    singletons          are no cluster
    empty table         no rows
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import free, hot_keys, salted_lookup, stage
from . import match_groups, vector_search

#: Vectors that are iterated, steps between two looks at their movement, and how often to look at most.
VECTORS, STEPS, LOOKS = 4, 4, 12
#: Width of a cell, the share of it within which seeds count as one, and the movement at which the vectors stand still.
#: Within a group of cosines >= 0.8 a step leaves at most a ninth of the differences.
CELL, MARGIN, STILL = 5e-4, 0.1, 5e-4
#: Share of the rows that may still move: they belong to stretched groups, which the last check puts together.
RESTLESS = 0.001
#: Rounds of k-means at most, should points keep changing between centres at the same distance.
ROUNDS = 20
#: Members named as typical of a cluster.
TYPICAL = 3


def affinities(pairs: DataFrame) -> DataFrame:
    """(i, j, w): both directions and the diagonal."""
    both = pairs.select(F.col("a").alias("i"), F.col("b").alias("j"), F.col("cosine").alias("w")).unionByName(
        pairs.select(F.col("b").alias("i"), F.col("a").alias("j"), F.col("cosine").alias("w"))
    )
    return both.unionByName(both.select("i").distinct().select("i", F.col("i").alias("j"), F.lit(1.0).alias("w")))


def _start(node: Column, k: int) -> Column:
    return F.pmod(F.xxhash64(node, F.lit(k)), F.lit(1 << 40)) / float(1 << 40)


def iterate(links: DataFrame, hot: DataFrame) -> DataFrame:
    """(i, x0, x1, ...): the vectors once they stand still, or after the last look."""
    names = [f"x{k}" for k in range(VECTORS)]
    state = links.where("i = j").select("i", *[_start(F.col("i"), k).alias(x) for k, x in enumerate(names)])
    held = None
    for _ in range(LOOKS):
        for step in range(STEPS):
            product = salted_lookup(links, state.withColumnRenamed("i", "j"), "j", F.xxhash64("i"), hot=hot)
            sums = [(F.sum(F.col("w") * F.col(x)) / F.sum("w")).alias(x) for x in names]
            old = [F.max(F.when(F.col("i") == F.col("j"), F.col(x))).alias(f"old_{x}") for x in names] if step == STEPS - 1 else []
            state = product.groupBy("i").agg(*sums, *old)
        state = stage(state, "p2-vectors")
        free(held)
        held = state
        moved = F.greatest(*[F.abs(F.col(x) - F.col(f"old_{x}")) for x in names]) >= STILL
        restless, all_rows = state.agg(F.count_if(moved), F.count(F.lit(1))).head()
        state = state.select("i", *names)
        if restless <= RESTLESS * all_rows:
            break
    return state


def kmeans(points: DataFrame) -> DataFrame:
    """(i, label): points of the embedding by their nearest seed."""
    names = [f"x{k}" for k in range(VECTORS)]
    cells = [f"g{k}" for k in range(VECTORS)]
    grid = [F.floor(F.col(x) / CELL).alias(g) for x, g in zip(names, cells)]
    seeds = points.groupBy(*grid).agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("label"), *[F.avg(x).alias(f"m_{x}") for x in names])
    seeds = stage(seeds, "p2-seeds")

    def around(df: DataFrame, columns: list[str]) -> DataFrame:
        """Every row in the cells within the margin of it."""
        near = [F.explode(F.array_distinct(F.array(F.floor(F.col(x) / CELL - MARGIN), F.floor(F.col(x) / CELL + MARGIN)))).alias(g) for x, g in zip(columns, cells)]
        return reduce(lambda d, e: d.select("*", e), near, df)

    def apart(left: str, right: str) -> Column:
        return F.greatest(*[F.abs(F.col(left + x) - F.col(right + x)) for x in names])

    mine = around(seeds.select("label", "n", *[F.col(f"m_{x}").alias(x) for x in names]), names)
    theirs = seeds.select(*cells, F.col("label").alias("l2"), F.col("n").alias("n2"), *[f"m_{x}" for x in names])
    heavier = (F.col("n2") > F.col("n")) | ((F.col("n2") == F.col("n")) & (F.col("l2") < F.col("label")))
    yields = mine.join(theirs, cells).where(heavier & (apart("", "m_") <= CELL * MARGIN)).select("label").distinct()
    left = seeds.join(yields, "label", "left_anti").select(*cells, "label", *[f"m_{x}" for x in names])
    near = around(points, names)

    def nearest(centres: DataFrame) -> DataFrame:
        return near.join(centres, cells).groupBy("i").agg(F.min_by("label", F.struct(apart("", "m_").alias("d"), "label")).alias("label"))

    # a point whose seed gave way and that lies next to no other keeps its own cell's name
    own = points.select("i", *grid).join(seeds.select(*cells, F.col("label").alias("own")), cells).select("i", "own")
    placed = stage(own.join(nearest(left), "i", "left").select("i", F.coalesce("label", "own").alias("label")), "p2-cells")
    for _ in range(ROUNDS):
        centres = points.join(placed, "i").groupBy("label").agg(*[F.avg(x).alias(f"m_{x}") for x in names])
        centres = centres.select("label", *[f"m_{x}" for x in names], *[F.floor(F.col(f"m_{x}") / CELL).alias(g) for x, g in zip(names, cells)])
        again = placed.join(nearest(centres).withColumnRenamed("label", "new"), "i", "left")
        again = stage(again.select("i", F.coalesce("new", "label").alias("label"), (F.col("new") != F.col("label")).alias("changed")), "p2-cells")
        free(placed)
        placed = again
        if placed.where("changed").isEmpty():
            break
    free(seeds)
    return placed.select("i", "label")


def split(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(i, label): each label that the affinities inside it don't connect is replaced by labels of its parts (negative, so new).

    A label with a point that has an affinity to all others is connected; only the rest is looked at closer.
    """
    inner = pairs.join(labels.select(F.col("i").alias("a"), "label"), "a").join(labels.select(F.col("i").alias("b"), F.col("label").alias("lb")), "b")
    inner = stage(inner.where(F.col("label") == F.col("lb")).select("a", "b", "label"), "p2-inner")
    ends = inner.select("label", F.col("a").alias("i")).unionByName(inner.select("label", F.col("b").alias("i")))
    most = ends.groupBy("label", "i").agg(F.count(F.lit(1)).alias("n")).groupBy("label").agg(F.max("n").alias("most"))
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    doubtful = stage(sizes.join(most, "label", "left").where(F.coalesce("most", F.lit(0)) < F.col("size") - 1).select("label", F.lit(True).alias("doubtful")), "p2-doubtful")
    parts = match_groups.groups(inner.join(doubtful, "label", "left_semi").select("a", "b")).select(F.col("vertex").alias("i"), "group_id")
    placed = labels.join(doubtful, "label", "left").join(parts, "i", "left")
    return placed.select("i", F.when(F.col("doubtful"), F.bitwise_not(F.coalesce("group_id", "i"))).otherwise(F.col("label")).alias("label"))


def class_clusters(pairs: DataFrame) -> DataFrame:
    """(c, label) of the classes that have an affinity."""
    links = stage(affinities(pairs), "p2-links")
    hot = stage(hot_keys(links, "j"), "p2-hot")
    embedding = iterate(links, hot)
    free(links, hot)
    labels = stage(split(pairs, kmeans(embedding)), "p2-labels")
    across = pairs.join(labels.select(F.col("i").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("i").alias("b"), F.col("label").alias("lb")), "b")
    across = across.where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    merged = match_groups.groups(across).select(F.col("vertex").alias("label"), "group_id")
    return labels.join(merged, "label", "left").select(F.col("i").alias("c"), F.coalesce("group_id", "label").alias("label"))


def _members(functions: DataFrame, min_cosine: float, **usable_options) -> tuple[DataFrame, DataFrame, DataFrame]:
    points, members = vector_search.classes(vector_search.usable(functions, **usable_options))
    pairs = vector_search.similar_pairs(points, min_cosine)
    label = points.select("c").join(class_clusters(pairs), "c", "left").select("c", F.coalesce("label", "c").alias("label"))
    placed = stage(salted_lookup(members, label, "c", F.xxhash64("id")), "p2-placed")
    keys = placed.groupBy("label").agg(F.min("id").alias("cluster_key"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return salted_lookup(placed, keys, "label", F.xxhash64("id")), points, pairs


def found(functions: DataFrame, min_cosine: float = vector_search.MIN_COSINE, **usable_options) -> DataFrame:
    """(``cluster_key``, ``function_id``): every member of a cluster of two or more."""
    return _members(functions, min_cosine, **usable_options)[0].select("cluster_key", F.col("id").alias("function_id"))


def describe(functions: DataFrame, min_cosine: float = vector_search.MIN_COSINE, **usable_options) -> DataFrame:
    """(``cluster_key``, ``size``, ``cohesion``, ``typical_ids``): one row a cluster; its members are in :func:`found`.

    Cohesion is the mean cosine of all pairs of members, from the squared length of the sum of their unit vectors.
    Typical are the members with the largest internal affinity, compared to four decimals.
    """
    placed, points, pairs = _members(functions, min_cosine, **usable_options)
    placed = stage(placed, "p2-members")
    classes = placed.groupBy("cluster_key", "size", "c").agg(F.count(F.lit(1)).alias("m"))
    classes = stage(classes, "p2-classes")

    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    parts = classes.join(points, "c").select("cluster_key", "size", F.posexplode(F.transform("vector", lambda x: F.col("m") * x / norm)).alias("at", "v"))
    square = parts.groupBy("cluster_key", "size", "at").agg(F.sum("v").alias("v")).groupBy("cluster_key", "size").agg(F.sum(F.col("v") * F.col("v")).alias("q"))
    size = F.col("size")
    cohesion = square.select("cluster_key", "size", ((F.col("q") - size) / (size * (size - 1))).alias("cohesion"))

    weight = classes.select("c", "cluster_key", "m")
    drawn = affinities(pairs).where("i <> j").join(weight.select(F.col("c").alias("j"), F.col("cluster_key").alias("kj"), F.col("m").alias("mj")), "j")
    drawn = drawn.groupBy("i", "kj").agg(F.sum(F.col("w") * F.col("mj")).alias("drawn"))
    inner = weight.join(drawn, (F.col("c") == F.col("i")) & (F.col("cluster_key") == F.col("kj")), "left")
    inner = inner.select("c", (F.coalesce("drawn", F.lit(0.0)) + F.col("m") - 1).alias("inner"))
    ranked = salted_lookup(placed, inner, "c", F.xxhash64("id"))
    rank = F.row_number().over(Window.partitionBy("cluster_key").orderBy(F.round("inner", 4).desc(), "id"))
    typical = ranked.withColumn("r", rank).where(F.col("r") <= TYPICAL).groupBy("cluster_key")
    typical = typical.agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]).alias("typical_ids"))
    return cohesion.join(typical, "cluster_key").select("cluster_key", "size", "cohesion", "typical_ids")
