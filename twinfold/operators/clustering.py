"""Connected components, capped average linkage, and the candidate clusters made of them."""

from __future__ import annotations

import heapq
import tempfile

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..params import DEFAULTS, Params
from ..runtime import HOT_ROWS, free, salted_lookup, stage
from .similarity import similar_pairs

#: Members of a component up to which its similarities are held in memory; those of a larger one lie in a file.
IN_MEMORY = 3_000


def _sign(links: DataFrame) -> tuple:
    """Count and two order-free hashes of the distinct links: equal signs mean equal sets."""
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64(F.lit(1), "v", "u"))).head())


def components(edges: DataFrame, max_rounds: int = 60, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, component): the smallest identifier that each vertex of (a, b) is connected to.

    Alternating large-star and small-star steps: each is one aggregation over the links, the number of rounds grows
    with the logarithm of the longest path. A hub's links are spread over as many tasks as it has ``hot_rows`` of them.
    """
    links = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-links")
    sign = _sign(links)

    def lowest(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Each ``u`` with its smallest partner, and the hubs among them."""
        low = stage(rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n")), "cc-low")
        return low, stage(low.where(F.col("_n") > hot_rows).select("u", F.ceil(F.col("_n") / hot_rows).cast("int").alias("_slices")), "cc-hot")

    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low, hot = lowest(both)
        large = salted_lookup(both, low.select("u", F.least("u", "m").alias("m")), "u", F.xxhash64("v"), hot=hot)
        large = large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large.where("u <> v"), "cc-large")
        free(low, hot, links)
        low, hot = lowest(large)
        small = salted_lookup(large, low.select("u", "m"), "u", F.xxhash64("v"), hot=hot)
        small = small.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        small = stage(small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct(), "cc-small")
        free(low, hot, large)
        links, before = small, sign
        sign = _sign(links)
        if sign == before:
            break
    else:
        raise RuntimeError(f"components are still growing after {max_rounds} rounds")
    roots = links.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def linkage(sims: np.ndarray, threshold: float, most: int, total: np.ndarray | None = None) -> list[list[int]]:
    """Groups of two or more: repeatedly the two groups of the largest mean similarity, the last pair of a tie.

    Each group holds its best partner behind it; what a merge makes worse is looked at again when it comes first, so
    a merge costs one row, not the matrix. ``total``: a copy of ``sims`` to work in.
    """
    n = len(sims)
    total = sims.copy() if total is None else total  # sums of similarities between groups
    groups: list[list[int]] = [[i] for i in range(n)]
    size, live = np.ones(n), np.ones(n, bool)
    held, partner, queue = np.full(n, -np.inf), np.full(n, -1), []

    def means(i: int, some: slice) -> np.ndarray:
        mean = total[i, some] / (size[i] * size[some])
        mean[~live[some] | (size[i] + size[some] > most)] = -np.inf
        return mean

    def hold(i: int, mean: float, j: int) -> None:
        held[i], partner[i] = mean, j
        heapq.heappush(queue, (-mean, -i, -j))

    def look(i: int) -> None:
        mean = means(i, slice(i + 1, n))
        top = mean.max(initial=-np.inf)
        if top >= threshold:
            hold(i, top, i + 1 + int(np.flatnonzero(mean == top)[-1]))
        else:
            held[i], partner[i] = -np.inf, -1

    for i in range(n):
        look(i)
    while queue:
        mean, i, j = (-x for x in heapq.heappop(queue))
        if not live[i] or held[i] != mean or partner[i] != j:
            continue
        if not means(i, slice(j, j + 1))[0] == mean:
            look(i)
            continue
        groups[i] += groups[j]
        row = total[i] + total[j]
        row[i] = -np.inf
        total[i] = row
        total[:, i] = row
        size[i] += size[j]
        live[j] = False
        look(i)
        before = means(i, slice(0, i))
        better = (before >= threshold) & ((before > held[:i]) | ((before == held[:i]) & (i > partner[:i])))
        for k in np.flatnonzero(better).tolist():
            hold(k, float(before[k]), i)
    return [g for k, g in enumerate(groups) if live[k] and len(g) > 1]


def _square(n: int) -> np.ndarray:
    """An n x n matrix of -inf; a large one lies in a file that vanishes with it."""
    if n <= IN_MEMORY:
        return np.full((n, n), -np.inf)
    with tempfile.TemporaryFile() as file:
        out = np.memmap(file, np.float64, "w+", shape=(n, n))
    for start in range(0, n, 1000):
        out[start : start + 1000] = -np.inf
    return out


def _link_components(threshold: float, most: int):
    """Pairs sorted by component come in; a component is never held as rows, only as its matrix."""

    def linked(component, kind, sims: np.ndarray):
        import pyarrow as pa

        total = _square(len(sims))
        for start in range(0, len(sims), 1000):
            total[start : start + 1000] = sims[start : start + 1000]
        number, at, cohesion = [], [], []
        for k, group in enumerate(linkage(sims, threshold, most, total)):
            inner = float(np.mean([sims[x, y] for n, x in enumerate(group) for y in group[n + 1 :]]))
            number += [k] * len(group)
            at += group
            cohesion += [inner] * len(group)
        names = pa.array([component] * len(at), kind)
        return pa.RecordBatch.from_arrays([names, pa.array(number, pa.int32()), pa.array(at, pa.int32()), pa.array(cohesion, pa.float64())], names=["component", "number", "at", "cohesion"]) if at else None

    def run(batches):
        component = sims = None
        for batch in batches:
            names = batch.column(0).to_pylist()
            sizes, x, y, value = (batch.column(k).to_numpy() for k in range(1, 5))
            cuts = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if sims is None or names[a] != component:
                    if sims is not None and (out := linked(component, batch.schema.field(0).type, sims)) is not None:
                        yield out
                    component, sims = names[a], _square(int(sizes[a]))
                sims[x[a:b], y[a:b]] = sims[y[a:b], x[a:b]] = value[a:b]
        if sims is not None and (out := linked(component, batch.schema.field(0).type, sims)) is not None:
            yield out

    return run


def candidates(rows: DataFrame, params: Params = DEFAULTS, limit: bool = True) -> DataFrame:
    """(member_ids, cohesion, module_count, priority): what is worth a closer look, best first.

    ``rows`` as from :func:`similarity.clusterable`. Linkage needs the similarity of every pair in a component, also
    below the floor, so pairs are taken from the lowest similarity that can still matter: all within the block.
    """
    near = stage(similar_pairs(rows, params.edge_floor), "cand-near")
    member = stage(components(near), "cand-components")
    # within components all compatible pairs count, whatever their similarity
    inside = rows.join(member, "id").withColumn("block", F.col("component"))
    every = stage(similar_pairs(inside.drop("component"), -2.0), "cand-every")
    kind = rows.schema["id"].dataType.simpleString()
    of = Window.partitionBy("component")
    place = member.select("id", "component", (F.row_number().over(of.orderBy("id")) - 1).alias("at"), F.count(F.lit(1)).over(of).cast("int").alias("n"))
    place = stage(place, "cand-places")
    pairs = every.join(place.select(F.col("id").alias("a"), "component", "n", F.col("at").alias("x")), "a").join(place.select(F.col("id").alias("b"), F.col("at").alias("y")), "b")
    pairs = pairs.select("component", "n", "x", "y", "similarity").repartition("component").sortWithinPartitions("component")
    linked = pairs.mapInArrow(_link_components(params.merge_threshold, params.max_cluster_size), f"component {kind}, number int, at int, cohesion double")
    groups = linked.join(place, ["component", "at"]).groupBy("component", "number").agg(F.array_sort(F.collect_list("id")).alias("member_ids"), F.first("cohesion").alias("cohesion"))
    groups = groups.select("member_ids", "cohesion")
    groups = stage(groups, "cand-groups")
    modules = groups.select("member_ids", F.explode("member_ids").alias("id")).join(rows.select("id", "file"), "id")
    modules = modules.groupBy("member_ids").agg(F.countDistinct(F.coalesce(text.module_of(F.col("file")), F.lit("."))).alias("module_count"))
    out = groups.join(modules, "member_ids").withColumn("priority", priority(F.col("module_count"), F.col("cohesion"), params.copy_cohesion))
    return out.orderBy(F.desc("priority"), F.desc("cohesion"), text.member_key(F.col("member_ids"))).limit(params.max_candidates) if limit else out


def priority(module_count, cohesion, copy_cohesion: float = DEFAULTS.copy_cohesion):
    """Two points for spanning modules, one for not being a plain copy."""
    return F.when(module_count > 1, 2).otherwise(0) + F.when(cohesion < copy_cohesion, 1).otherwise(0)


def cohesion(clusters: DataFrame, vectors: DataFrame) -> DataFrame:
    """(cluster_id, members, cohesion): mean cosine of all pairs of distinct members with a usable vector; 0 under two.

    From the squared length of the sum of unit vectors, so no pair is ever formed.
    """
    members = clusters.select("cluster_id", F.explode(F.array_distinct("function_ids")).alias("id"))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    unit = F.posexplode(F.transform("vector", lambda x: x / length)).alias("at", "v")
    held = members.join(vectors, "id")
    sizes = held.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("members"))
    sums = held.select("cluster_id", unit).groupBy("cluster_id", "at").agg(F.sum("v").alias("v"))
    square = sums.groupBy("cluster_id").agg(F.sum(F.col("v") * F.col("v")).alias("q"))
    n = F.col("members")
    mean = F.when(n < 2, 0.0).otherwise((F.col("q") - n) / F.nullif(n * (n - 1), F.lit(0)))
    return sizes.join(square, "cluster_id").select("cluster_id", "members", mean.alias("cohesion"))
