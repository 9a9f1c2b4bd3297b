"""Problem 5: the most similar vectors of every vector, by stable projections indexed with kd-trees.

Each tree projects the unit vectors on a few Gaussian (2-stable) directions, ``PROJECTED`` of them, and splits them at
medians, one direction a level. A query first meets the points of its own leaf; the k-th best of them bounds how far
its neighbours can be (so does ``min_cosine``, where one is given). It then goes to further leaves in the order in
which it would cross the fewest, nearest splits: across ``f`` crossed splits at squared projected distance ``D`` a
vector at the current k-th distance ``d`` is expected with a probability of at most 2**-f * P(chi2_f > D / d**2), and
the leaves of a tree end where this falls under ``MISS``. Within a leaf the projected neighbours are taken in rings of
growing projected distance and verified as they come; each ring may lower the k-th distance, and the search stops
once the next projected distance fails the chi-square test with ``PROJECTED`` degrees of freedom against it.

A tree alone loses more pairs the more levels it has, so there are as many trees as neighbours at the least cosine
need to be met with a probability of ``RECALL``, whatever the size. Trees are searched a few at a time, so that the
disk doesn't hold the visits of all of them. Points travel as 4-bit codes; what passes is verified with the full
vectors. A leaf with far more points than planned is split into slices that every visitor goes to.

Equal vectors are collapsed into one class first, so a class of any size is one point of the index.

Defined results
    null, empty, zero or short vector    not usable: no query and no answer
    other ``embed_version``              not usable
    repeated rows                        one identifier counts once, with its latest usable vector
    ties                                 the smaller identifier comes first
    fewer than k others                  as many as there are
    empty table                          no rows
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import free, salted_lookup, stage, width

DIMENSIONS, VERSION = 96, "intent-v3"
#: Neighbours asked for, and the cosine under which a vector doesn't count as a neighbour.
K, MIN_COSINE = 5, 0.80
#: Dimensions of a projection (a tree with more levels than this has one for each level), and points of a leaf.
PROJECTED, LEAF = 24, 1400
#: Least number of trees, and the chance under which a leaf isn't visited any more.
TREES, MISS = 3, 0.3
#: Chance of losing a neighbour to the stopping test within a leaf, and the rings, as shares of where it stops.
MISS_POINT, RINGS = 1e-3, (0.2, 0.5, 1.0)
#: Share of the pairs at the least cosine that the trees together are to find; it sets their number.
RECALL = 0.998
#: Without a least cosine: the cosine for which the trees are planned, and their ``MISS`` and ``RECALL``.
ANY_COSINE, ANY_MISS, ANY_RECALL = 0.30, 2e-3, 0.99
#: Trees that are searched at a time.
TOGETHER = 4
#: Multiple of the squared k-th distance of the own leaf to look for in others: a query then goes as far alone as both
#: ends of a pair would with the plain distance.
WIDER = 2.0
#: Parts in which met pairs are verified: a pair carries a whole vector through a shuffle.
VERIFIED = 2
#: Vectors from which the upper splits are taken (a bounded sample; every vector is indexed), levels whose splits come
#: from it, and vectors a leaf for the deeper ones.
SAMPLE, TOP_LEVELS, PER_LEAF = 20_000, 8, 32
#: Levels of a tree at most, so that the splits that are shipped stay under 100 MB; leaves grow beyond, and are sliced.
MOST_LEVELS = 19
#: Points of a leaf, as a multiple of the planned number, from which it is sliced.
HOT_LEAF = 4
#: What the 4-bit codes may understate a cosine by.
CODE_SLACK = 0.06


def chi2_tail(x: float, f: int) -> float:
    """P(chi2_f > x) for whole ``f``, from the closed forms for 1 and 2 by the recurrence in steps of 2."""
    if x <= 0:
        return 1.0
    half = x / 2
    tail, term, k = (math.erfc(math.sqrt(half)), math.sqrt(half / math.pi) * 2 * math.exp(-half), 1) if f % 2 else (math.exp(-half), half * math.exp(-half), 2)
    while k < f:
        tail += term
        k += 2
        term *= half / (k / 2)
    return min(1.0, tail)


def chi2_point(share: float, f: int) -> float:
    """The x with P(chi2_f > x) = ``share``."""
    low, high = 0.0, 400.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_tail(mid, f) > share else (low, mid)
    return low


def stop_distances(miss: float, levels: int) -> np.ndarray:
    """For each number of crossed splits, the D / d**2 at which the test stops; negative where it stops at once."""
    out = np.full(levels + 1, -1.0)
    for f in range(levels + 1):
        share = miss * 2.0**f
        if f == 0:
            out[f] = np.inf
        elif share < 1:
            out[f] = chi2_point(share, f)
    return out


def meeting_chance(cosine: float, reach: float, levels: int, miss: float, both: bool = True, pairs: int = 1 << 16) -> float:
    """Chance that two vectors of ``cosine`` meet in one tree, ``both`` or only one visiting the other's leaf: simulated, fixed seed."""
    rng = np.random.default_rng(5)
    stops = stop_distances(miss, levels)
    x, y = rng.standard_normal((2, pairs, levels))
    y = cosine * x + math.sqrt(1 - cosine * cosine) * y
    apart = (x > 0) != (y > 0)
    limit = reach * stops[np.cumsum(apart, axis=1)]
    comes = [((np.cumsum(np.where(apart, z * z, 0), axis=1) <= limit) | ~apart).all(1) for z in (x, y)]
    return float((comes[0] | comes[1] if both else comes[0]).mean())


def trees_needed(cosine: float, levels: int, miss: float = MISS, recall: float = RECALL, both: bool = True, least: int = TREES) -> int:
    """Trees with which pairs at ``cosine`` are found with a probability of ``recall``; at least ``least``."""
    lost = 1 - meeting_chance(cosine, 2 - 2 * cosine, levels, miss, both)
    return max(least, math.ceil(math.log(1 - recall) / math.log(lost))) if lost > 0 else least


class Forest:
    """The kd-trees: directions and split values. Nodes count from 1 at the root; those of a level follow each other."""

    def __init__(self, dimensions: int, levels: int, trees: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.levels, self.trees = levels, trees
        self.directions = rng.standard_normal((trees, dimensions, max(PROJECTED, levels))).astype(np.float32)
        self.splits = np.zeros((trees, 1 << levels), np.float32)

    def fit_top(self, sample: np.ndarray) -> None:
        """The upper levels, from a sample on the driver."""
        for t in range(self.trees):
            shadow = sample @ self.directions[t]
            node = np.ones(len(sample), np.int64)
            for level in range(min(self.levels, TOP_LEVELS)):
                self._fit_level(t, level, range(1 << level, 2 << level), shadow, node)
                node = node * 2 + (shadow[:, level] > self.splits[t, node])

    def fit_under(self, t: int, top: int, shadow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes below ``top`` and their splits, from the projections of vectors in ``top``."""
        node, first, out = np.full(len(shadow), top), 1, []
        for level in range(TOP_LEVELS, self.levels):
            nodes = range(top * first, (top + 1) * first)
            self._fit_level(t, level, nodes, shadow, node)
            out += nodes
            node = node * 2 + (shadow[:, level] > self.splits[t, node])
            first *= 2
        return np.array(out, np.int64), self.splits[t, out]

    def _fit_level(self, t: int, level: int, nodes, shadow: np.ndarray, node: np.ndarray) -> None:
        everywhere = np.median(shadow[:, level]) if len(shadow) else 0.0
        order = np.argsort(node, kind="stable")
        cuts = np.searchsorted(node[order], [*nodes, nodes[-1] + 1])
        for n, a, b in zip(nodes, cuts[:-1], cuts[1:]):
            self.splits[t, n] = np.median(shadow[order[a:b], level]) if b - a >= 8 else everywhere

    def down(self, t: int, shadow: np.ndarray, levels: int) -> np.ndarray:
        node = np.ones(len(shadow), np.int64)
        for level in range(levels):
            node = node * 2 + (shadow[:, level] > self.splits[t, node])
        return node

    def visits(self, t: int, unit: np.ndarray, reach: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, leaf and whether it is the row's own leaf. ``reach``: squared distance to look for; less than 0 for points that ask nothing."""
        shadow = unit @ self.directions[t, :, : max(self.levels, 1)]
        row, node = np.arange(len(unit)), np.ones(len(unit), np.int64)
        far, crossed = np.zeros(len(unit), np.float32), np.zeros(len(unit), np.int64)
        for level in range(self.levels):
            gap = shadow[row, level] - self.splits[t, node]
            side = (gap > 0).astype(np.int64)
            beyond = far + gap * gap
            go = (reach[row] >= 0) & (beyond <= reach[row] * stops[crossed + 1])
            node, far, crossed, row = (
                np.concatenate([node * 2 + side, node[go] * 2 + 1 - side[go]]),
                np.concatenate([far, beyond[go]]),
                np.concatenate([crossed, crossed[go] + 1]),
                np.concatenate([row, row[go]]),
            )
        return row, node, crossed == 0


def usable(functions: DataFrame, id_col: str = "function_id", dimensions: int = DIMENSIONS, version: str = VERSION) -> DataFrame:
    """(id, vector, _at): rows whose embedding can be compared; ``vector`` as floats."""
    ok = (F.size("embedding") == dimensions) & (F.col("embed_version") == version) & F.exists("embedding", lambda x: x != 0)
    ok &= ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    return functions.where(F.col(id_col).isNotNull() & ok).select(F.col(id_col).alias("id"), F.col("embedding").cast("array<float>").alias("vector"), F.col("updated_at").alias("_at"))


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, vector) of the distinct vectors and (id, c) of their members."""
    keyed = vectors.withColumn("h", F.xxhash64("vector")).withColumn("g", F.xxhash64(F.lit(1), F.col("vector")))
    latest = keyed.groupBy("id").agg(F.max_by(F.struct("h", "g"), F.struct("_at", "h", "g")).alias("k")).select("id", "k.h", "k.g")
    latest = stage(latest, "p5-latest")
    live = latest.select("h", "g").distinct()
    points = keyed.groupBy("h", "g").agg(F.first("vector").alias("vector")).join(live, ["h", "g"], "left_semi")
    points = stage(points.withColumn("c", F.monotonically_increasing_id()), "p5-points")
    # the second hash joins, too: both together name a vector
    named = points.select(F.struct("h", "g").alias("k"), "c")
    members = salted_lookup(latest.select("id", F.struct("h", "g").alias("k")), named, "k", F.xxhash64("id")).select("id", "c")
    members = stage(members, "p5-members")
    free(latest)
    return points.select("c", "vector"), members


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    unit = flat.reshape(len(column), -1)
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def _codes(unit: np.ndarray) -> np.ndarray:
    """Two 4-bit values a byte, scaled to the row's largest value."""
    scaled = unit * (7.5 / np.abs(unit).max(axis=1, keepdims=True))
    level = np.clip(np.floor(scaled) + 8, 0, 15).astype(np.uint8)
    return level[:, 0::2] << 4 | level[:, 1::2]


def _decoded(codes: np.ndarray) -> np.ndarray:
    out = np.empty((len(codes), codes.shape[1] * 2), np.float32)
    out[:, 0::2], out[:, 1::2] = codes >> 4, codes & 15
    out -= 7.5
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def runs(batches, key: int = 0):
    """Whole runs of equal keys from batches sorted by column ``key``: (arrow table of one key)."""
    import pyarrow as pa

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        if held and held[-1].column(key)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-2], cuts[1:-1]):
            yield pa.Table.from_batches([*held, batch.slice(a, b - a)])
            held = []
        held.append(batch.slice(cuts[-2]))
    if held:
        yield pa.Table.from_batches(held)


def fixed_bytes(table, name: str, size: int) -> np.ndarray:
    """A binary column whose values all have ``size`` bytes, as rows of bytes."""
    return np.frombuffer(b"".join(table.column(name).to_pylist()), np.uint8).reshape(-1, size)


def bytes_column(rows: np.ndarray):
    import pyarrow as pa

    rows = np.ascontiguousarray(rows)
    offsets = np.arange(0, rows.nbytes + 1, rows.shape[1], dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _pieces(batches, rows: int = 2000):
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _under_top(forest, t_list: list[int], share: float):
    """Projections of a sample, by tree and node of the last upper level, for the deeper splits."""

    def run(batches):
        import pyarrow as pa

        trees = forest.value
        for part in _pieces(batches):
            c = part.column(0).to_numpy().astype(np.uint64)
            take = np.flatnonzero((c * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.float64) < share * 2.0**32)
            unit = _matrix(part.column(1).take(pa.array(take))) if len(take) else np.zeros((0, 1), np.float32)
            for t in t_list if len(take) else ():
                shadow = unit @ trees.directions[t]
                yield pa.RecordBatch.from_arrays([pa.array(trees.down(t, shadow, TOP_LEVELS) + (t << 40)), bytes_column(np.ascontiguousarray(shadow, np.float32).view(np.uint8))], names=["top", "shadow"])

    return run


def _fit_under(forest):
    def run(batches):
        import pyarrow as pa

        trees = forest.value
        for table in runs(batches):
            key = table.column(0)[0].as_py()
            t, top = key >> 40, key & ((1 << 40) - 1)
            shadow = fixed_bytes(table, "shadow", trees.directions.shape[2] * 4).view(np.float32)
            nodes, splits = trees.fit_under(t, top, shadow)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), t, np.int64)), pa.array(nodes), pa.array(splits)], names=["t", "node", "split"])

    return run


def build(points: DataFrame, n: int, leaf: float, trees: int, levels: int) -> Forest:
    """Fit the trees: the upper levels on the driver, the deeper ones under each upper node by one task."""
    spark = points.sparkSession
    dimensions = len(points.select("vector").head()[0]) if n else 2
    sample = points.select("vector").sample(min(1.0, 1.2 * SAMPLE / max(n, 1)), seed=11).limit(SAMPLE).toPandas()["vector"] if n else []
    sample = np.array(list(sample), np.float32).reshape(-1, dimensions)
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    forest = Forest(dimensions, levels, trees)
    forest.fit_top(sample)
    for first in range(0, trees if levels > TOP_LEVELS else 0, TOGETHER):
        shipped = spark.sparkContext.broadcast(forest)
        some = list(range(first, min(first + TOGETHER, trees)))
        under = points.select("c", "vector").mapInArrow(_under_top(shipped, some, min(1.0, PER_LEAF * (1 << levels) / n)), "top long, shadow binary")
        under = under.repartition(max(width(spark), len(some) << TOP_LEVELS >> 4), "top").sortWithinPartitions("top")
        rows = under.mapInArrow(_fit_under(shipped), "t long, node long, split float").toPandas()
        forest.splits[rows["t"].to_numpy(), rows["node"].to_numpy()] = rows["split"]
    return forest


def _first_leaves(forest):
    def run(batches):
        import pyarrow as pa

        trees = forest.value
        for part in _pieces(batches):
            shadow = _matrix(part.column("vector")) @ trees.directions[0]
            yield pa.RecordBatch.from_arrays([pa.array(trees.down(0, shadow, trees.levels)), *part.columns], names=["leaf", *part.schema.names])

    return run


def _bounds(k: int, reach: float):
    """From points in the order of their leaves: ``WIDER`` times the squared distance of each query's k-th best in its own leaf, or ``reach``.

    Any k others bound the k-th distance, so a leaf is looked at in pieces.
    """

    def run(batches):
        import pyarrow as pa

        for part in _pieces(batches, 1000):
            unit = _matrix(part.column("vector"))
            bound = np.full(len(unit), reach, np.float32)
            if len(unit) > k:
                sims = unit @ unit.T
                np.fill_diagonal(sims, -2)
                best = -np.partition(-sims, k - 1, axis=1)[:, k - 1]
                bound = np.minimum(bound, WIDER * np.maximum(2 - 2 * best, 0) + 1e-5).astype(np.float32)
            bound[part.column("reach").to_numpy() < 0] = -1
            yield pa.RecordBatch.from_arrays([part.column("c"), part.column("vector"), pa.array(bound)], names=["c", "vector", "reach"])

    return run


def _addresses(forest, some: list[int], stops: np.ndarray, homes_only: bool = False, whole: bool = False):
    def run(batches):
        import pyarrow as pa

        trees = forest.value
        for part in _pieces(batches):
            unit, c, reach = _matrix(part.column(1)), part.column(0).to_numpy(), part.column(2).to_numpy()
            if homes_only:
                for t in some:
                    yield pa.RecordBatch.from_arrays([pa.array(trees.down(t, unit @ trees.directions[t], trees.levels) + (t << 40))], names=["leaf"])
                continue
            codes = unit.view(np.uint8) if whole else _codes(unit)
            for t in some:
                row, node, home = trees.visits(t, unit, reach, stops)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node + (t << 40)), pa.array(np.where(home, c[row], ~c[row])), pa.array(reach[row]), bytes_column(codes[row])], names=["leaf", "c", "reach", "code"]
                )

    return run


def _kth(row: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have ``k`` values, and their k-th largest."""
    order = np.lexsort((-value, row))
    row, value = row[order], value[order]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    last = first + k - 1
    last = last[last < np.r_[first[1:], len(row)]]
    return row[last], value[last]


def _best(row: np.ndarray, other: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries of each row with its ``k`` largest values."""
    order = np.lexsort((-value, row))
    row = row[order]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    keep = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)])) < k
    return row[keep], other[order[keep]], value[order[keep]]


def _search(forest, n_bytes: int, k: int | None, slack: float, stop: float, whole: bool = False):
    """Pairs (a, b) of whole leaves: queries against the leaf's points, in rings of projected distance.

    ``whole``: the points come as full vectors; then the ``k`` best of each query come out, with their cosine.
    """

    def run(batches):
        import pyarrow as pa

        trees = forest.value
        for table in runs(batches):
            c = table.column("c").to_numpy()
            visit = c < 0  # a class that visits comes as the complement of its number
            c = np.where(visit, ~c, c)
            reach = table.column("reach").to_numpy()
            home, ask = np.flatnonzero(~visit), np.flatnonzero(reach >= 0)
            if not len(home) or not len(ask):
                continue
            unit = fixed_bytes(table, "code", n_bytes)
            unit = unit.view(np.float32) if whole else _decoded(unit)[:, : trees.directions.shape[1]]
            shadow = unit @ trees.directions[table.column("leaf")[0].as_py() >> 40]
            names, size = c[home], (shadow * shadow).sum(1)
            # one product gives the squared projected distance less the one at which a query stops
            points = np.ascontiguousarray(np.concatenate([shadow[home], size[home, None], np.ones((len(home), 1), np.float32)], axis=1).T)
            asks = np.concatenate([-2 * shadow, np.ones((len(c), 1), np.float32), (size - stop * reach - 1e-4)[:, None]], axis=1)
            place = np.full(len(c), -1)
            place[home] = np.arange(len(home))
            step = max(1, 300_000 // len(home))  # a product that stays in the cache
            for start in range(0, len(ask), step):
                rows = ask[start : start + step]
                beyond = (asks[rows] @ points).ravel()
                at = np.flatnonzero(beyond <= 0)
                apart = beyond[at] + stop * reach[rows[at // len(home)]]
                at, other = np.divmod(at, len(home))
                if k is None:  # two points of the leaf meet once
                    keep = (place[rows[at]] < 0) | (place[rows[at]] < other)
                    at, other, apart = at[keep], other[keep], apart[keep]
                limit, found_at, found_sim, held = reach[rows].copy(), [], [], []
                done = np.zeros(len(at), bool)
                for ring in RINGS if k else RINGS[-1:]:
                    here = np.flatnonzero(~done & (apart <= ring * stop * limit[at] + 1e-4))
                    done[here] = True
                    if not len(here):
                        continue
                    i, j = at[here], other[here]
                    if len(here) * 8 > len(beyond):
                        sim = (unit[rows] @ unit[home].T)[i, j]
                    else:
                        sim = np.einsum("ij,ij->i", unit[rows[i]], unit[home[j]])
                    good = (sim >= 1 - limit[i] / 2 - slack) & (c[rows[i]] != names[j])  # in a sliced leaf a point also visits itself
                    i, j, sim = i[good], j[good], sim[good]
                    if whole and len(i):
                        held.append((i, j, sim))
                        held = [_best(*map(np.concatenate, zip(*held)), k)]
                        row, least = _kth(held[0][0], held[0][2], k)
                        limit[row] = np.minimum(limit[row], 2 - 2 * least)
                    elif len(i):
                        x, y = c[rows[i]], names[j]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])
                        if k and ring < RINGS[-1]:
                            found_at.append(i)
                            found_sim.append(sim)
                            row, least = _kth(np.concatenate(found_at), np.concatenate(found_sim), k)
                            limit[row] = np.minimum(limit[row], 2 - 2 * (least - slack))
                for i, j, sim in held:
                    x, y = c[rows[i]], names[j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(sim.astype(np.float64))], names=["a", "b", "cosine"])

    return run


def _verify(least: float):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x, y = (_matrix(batch.column(k)).astype(np.float64) for k in (2, 3))
            cosine = np.einsum("ij,ij->i", x, y) / np.linalg.norm(x, axis=1) / np.linalg.norm(y, axis=1)
            keep = np.flatnonzero(cosine >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.array(cosine[keep])], names=["a", "b", "cosine"])

    return run


def search(points: DataFrame, k: int | None, min_cosine: float | None, trees: int | None = None, leaf: float = LEAF, miss: float | None = None) -> DataFrame:
    """(a, b, cosine) with a < b: the pairs of classes that a search from either side meets and verifies.

    ``points``: (c, vector, reach); a ``reach`` below 0 marks a point that asks nothing. With ``k`` the pairs hold the
    k nearest of every query, without it all pairs of at least ``min_cosine``. With ``k`` and no ``min_cosine`` every
    leaf gives whole vectors' k best of each query, so that far neighbours aren't verified pair by pair: meant for few
    queries, as each meets nearly all leaves. ``trees``: as many as needed if not given.
    """
    spark = points.sparkSession
    n = points.count()
    levels = min(MOST_LEVELS, max(0, math.ceil(math.log2(max(n, 2) / leaf))))
    miss, recall = (miss or MISS, RECALL) if min_cosine is not None else (miss or ANY_MISS, ANY_RECALL)
    if not trees:
        trees = trees_needed(ANY_COSINE, levels, miss, recall, False, 1) if min_cosine is None else trees_needed(min_cosine, levels, miss, recall)
    fitted = build(points, n, leaf, trees, levels)
    forest, stops, dimensions = spark.sparkContext.broadcast(fitted), stop_distances(miss, levels), fitted.directions.shape[1]
    reach = 4.0 if min_cosine is None else 2 - 2 * min_cosine
    whole = k is not None and min_cosine is None
    if k:
        leaves = points.mapInArrow(_first_leaves(forest), "leaf long, c long, vector array<float>, reach float").repartition(max(width(spark), n // 20_000), "leaf").sortWithinPartitions("leaf")
        points = stage(leaves.mapInArrow(_bounds(k, reach), "c long, vector array<float>, reach float"), "p5-bounded")
    else:
        points = points.withColumn("reach", F.when(F.col("reach") < 0, F.col("reach")).otherwise(F.lit(reach)).cast("float"))
    stop = chi2_point(MISS_POINT if min_cosine is not None else MISS_POINT / 10, fitted.directions.shape[2])
    most = max(leaf, 50)
    homes = points.select("c", "vector", "reach").mapInArrow(_addresses(forest, list(range(trees)), stops, True), "leaf long")
    homes = homes.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_LEAF * most)
    hot = stage(homes.select("leaf", F.ceil(F.col("n") / most).cast("int").alias("slices")), "p5-hot")
    split = not hot.isEmpty()
    met = None
    for first in range(0, trees, TOGETHER):
        some = list(range(first, min(first + TOGETHER, trees)))
        visits = points.mapInArrow(_addresses(forest, some, stops, whole=whole), "leaf long, c long, reach float, code binary")
        if split:
            # at most n / (HOT_LEAF * leaf) entries of 12 bytes a tree
            slices = F.when(F.col("slices").isNull(), F.array(F.lit(0))).when(F.col("c") >= 0, F.array(F.pmod(F.xxhash64("c"), F.col("slices")).cast("int")))
            slices = F.explode(slices.otherwise(F.sequence(F.lit(0), F.col("slices") - 1)))
            # a home row asks in its own slice only; its question to the others goes as a visit
            home = visits.join(F.broadcast(hot), "leaf", "left")
            asks = home.where((F.col("c") >= 0) & (F.col("reach") >= 0) & F.col("slices").isNotNull()).withColumn("c", F.bitwise_not("c"))
            visits = home.unionByName(asks).withColumn("slice", slices).select((F.col("leaf") + F.shiftleft(F.col("slice").cast("long"), 24)).alias("leaf"), "c", "reach", "code")
        met_rows = _search(forest, dimensions * 4, k, 0.0, stop, True) if whole else _search(forest, (dimensions + 1) // 2, k, CODE_SLACK, stop)
        pairs = (
            visits.repartition(max(width(spark), n * len(some) // 20_000), "leaf")
            .sortWithinPartitions("leaf")
            .mapInArrow(met_rows, "a long, b long" + ", cosine double" * whole)
        )
        both = pairs if met is None else pairs.unionByName(met)
        once = both.groupBy("a", "b").agg(F.max("cosine").alias("cosine")) if whole else both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("times")).select("a", "b")
        new = stage(once, "p5-met")
        free(met)
        met = new
    if whole:
        free(points, hot)
        return met
    left, right = points.select(F.col("c").alias("a"), F.col("vector").alias("va")), points.select(F.col("c").alias("b"), F.col("vector").alias("vb"))
    pairs = None
    for k in range(VERIFIED):
        some = met.where(F.pmod(F.xxhash64("a"), F.lit(VERIFIED)) == k)
        both = some.join(left, "a").join(right, "b").select("a", "b", "va", "vb")
        part = stage(both.mapInArrow(_verify(-1.0 if min_cosine is None else min_cosine), "a long, b long, cosine double"), "p5-pairs")
        pairs = part if pairs is None else pairs.unionByName(part)
    free(met, points, hot)
    return pairs


def similar_pairs(points: DataFrame, min_cosine: float = MIN_COSINE, **options) -> DataFrame:
    """(a, b, cosine) with a < b: all pairs of classes with at least ``min_cosine`` that the search meets."""
    return search(points.select("c", "vector", F.lit(0.0).cast("float").alias("reach")), None, min_cosine, **options)


def _ranked(df: DataFrame, by: str, order: list[Column], most: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def neighbours(functions: DataFrame, k: int = K, min_cosine: float | None = MIN_COSINE, asking: Column | None = None, **usable_options) -> DataFrame:
    """(id, neighbour, cosine): of every usable vector its ``k`` most similar others, of at least ``min_cosine`` if given.

    ``asking``: a condition on ``id``; only rows that meet it get an answer, from all rows.
    """
    points, members = classes(usable(functions, **usable_options))
    if asking is None:
        asks, asked = F.lit(True), points.withColumn("reach", F.lit(0.0).cast("float"))
    else:
        asks = asking
        reach = members.groupBy("c").agg(F.max(F.when(asks, 0.0).otherwise(-1.0)).cast("float").alias("reach"))
        asked = points.join(reach, "c").select("c", "vector", "reach")
    pairs = search(asked, k, min_cosine)
    # a class is its own nearest neighbour, with cosine 1; k + 1 names of a class are enough for any answer
    first = stage(_ranked(members, "c", [F.col("id")], k + 1), "p5-first")
    other = pairs.select(F.col("a").alias("of"), F.col("b").alias("c"), "cosine").unionByName(pairs.select(F.col("b").alias("of"), F.col("a").alias("c"), "cosine"))
    other = _ranked(other, "of", [F.col("cosine").desc(), F.col("c")], k)
    own = first.select(F.col("c").alias("of"), "c").distinct().withColumn("cosine", F.lit(1.0))
    names = other.unionByName(own.select("of", "c", "cosine")).join(first, "c")
    names = _ranked(names, "of", [F.col("cosine").desc(), F.col("id")], k + 1)
    lists = names.groupBy("of").agg(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("d"), "id"))).alias("near"))
    out = salted_lookup(members.where(asks), lists.select(F.col("of").alias("c"), "near"), "c", F.xxhash64("id"))
    out = out.withColumn("near", F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k))
    return out.select("id", F.explode("near").alias("x")).select("id", F.col("x.id").alias("neighbour"), (-F.col("x.d")).alias("cosine"))


def found(functions: DataFrame) -> DataFrame:
    """(``function_a``, ``function_b``): each pair once, the smaller identifier first."""
    return neighbours(functions).select(F.least("id", "neighbour").alias("function_a"), F.greatest("id", "neighbour").alias("function_b")).distinct()


def by_fifty(name: str) -> Column:
    """Whether the number in hex digits 5 to 12 of an identifier is divisible by 50 (the digits before and after hardly vary)."""
    return F.conv(F.substring(name, 5, 8), 16, 10).cast("long") % 50 == 0


def nearest(functions: DataFrame, k: int = K) -> DataFrame:
    """(``function_id``, ``neighbour_id``, ``place``): the ``k`` most similar of every 50th function, however dissimilar."""
    near = neighbours(functions, k, None, asking=by_fifty("id"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.col("cosine").desc(), "neighbour"))
    return near.select(F.col("id").alias("function_id"), F.col("neighbour").alias("neighbour_id"), place.cast("long").alias("place"))
