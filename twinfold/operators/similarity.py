"""Exact similarity joins inside blocks, tiled so that no block has to fit one task.

Every row gets a tile within its block; a pair of tiles is one unit of work, a matrix product of two bounded
matrices. A row is sent to as many units as its block has tiles, which is the least an exact all-pairs join needs;
blocks of up to one tile send each row once. Compatibility is decided on the few pairs above the floor.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..runtime import stage

#: Rows of a tile.
TILE = 2_000


def clusterable(functions: DataFrame) -> DataFrame:
    """(id, vector, block, inputs, outputs, file): analysable rows, blocked by arity bucket and purity."""
    rows = functions.where(F.col("fingerprint").isNotNull() & (F.size("embedding") > 0))
    block = F.concat_ws(":", text.arity_bucket(F.size("params")).cast("string"), F.col("is_pure").cast("string"))
    none = F.array().cast("array<string>")
    return rows.select(
        F.col("function_id").alias("id"),
        F.col("embedding").alias("vector"),
        block.alias("block"),
        F.coalesce("fingerprint.inputs", none).alias("inputs"),
        F.coalesce("fingerprint.outputs", none).alias("outputs"),
        "file",
    )


def _units(rows: DataFrame, tile: int, columns: list[str]) -> DataFrame:
    """Each row once a pair of tiles (t, u), t <= u, of its block."""
    sizes = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")).select("block", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    rows = rows.join(sizes, "block").withColumn("t", own).withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return rows.select(*columns, F.least("t", "u").alias("low"), F.greatest("t", "u").alias("high"), F.col("t").alias("mine"))


def _scaled(vectors: pd.Series) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """By length: (length, positions, unit rows). A zero vector stays zero."""
    sizes = vectors.map(len).to_numpy()
    out = []
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        rows = np.array(vectors.iloc[at].tolist(), np.float64)
        length = np.linalg.norm(rows, axis=1, keepdims=True)
        out.append((int(size), at, rows / np.where(length == 0, 1, length)))
    return out


def _pair_unit(floor: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parts = []
        ids, mine = rows["id"].to_numpy(), rows["mine"].to_numpy()
        same = rows["low"].iloc[0] == rows["high"].iloc[0]
        for _, at, unit in _scaled(rows["vector"]):
            left = np.arange(len(at)) if same else np.flatnonzero(mine[at] == rows["low"].iloc[0])
            right = left if same else np.flatnonzero(mine[at] == rows["high"].iloc[0])
            for start in range(0, len(left), 500):
                some = left[start : start + 500]
                sims = unit[some] @ unit[right].T
                i, j = np.nonzero(sims >= floor)
                a, b = ids[at[some[i]]], ids[at[right[j]]]
                keep = a < b if same else a != b
                a, b, s = a[keep], b[keep], sims[i, j][keep]
                parts.append(pd.DataFrame({"a": np.where(a < b, a, b), "b": np.where(a < b, b, a), "similarity": s}))
        return pd.concat(parts) if parts else pd.DataFrame({"a": [], "b": [], "similarity": []})

    return run


def similar_pairs(rows: DataFrame, floor: float, compatible: bool = True, tile: int = TILE) -> DataFrame:
    """(a, b, similarity), a < b: all pairs within a block at or above ``floor``, compatible ones only."""
    kind = rows.schema["id"].dataType.simpleString()
    units = _units(rows.select("id", "vector", "block"), tile, ["id", "vector", "block"])
    pairs = units.groupBy("block", "low", "high").applyInPandas(_pair_unit(floor), f"a {kind}, b {kind}, similarity double")
    if not compatible:
        return pairs
    shape = rows.select("id", "inputs", "outputs")
    left = shape.select(F.col("id").alias("a"), F.col("inputs").alias("ia"), F.col("outputs").alias("oa"))
    right = shape.select(F.col("id").alias("b"), F.col("inputs").alias("ib"), F.col("outputs").alias("ob"))
    both = stage(pairs, "pairs").join(left, "a").join(right, "b")
    return both.where(text.outputs_overlap(F.col("oa"), F.col("ob")) & text.inputs_line_up(F.col("ia"), F.col("ib"))).select("a", "b", "similarity")


def best_match(pairs: DataFrame) -> DataFrame:
    """(id, match, similarity): of every row its most similar partner; of similarities equal to nine decimals the smaller identifier wins."""
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("match"), "similarity").unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("match"), "similarity"))
    return best_of(both)


def best_of(directed: DataFrame) -> DataFrame:
    """The best row of each ``id`` among (id, match, similarity)."""
    best = F.min(F.struct((-F.round("similarity", 9)).alias("d"), "match", "similarity")).alias("m")
    return directed.groupBy("id").agg(best).select("id", "m.match", "m.similarity")


def is_stale(version: str) -> Column:
    """Whether a row has a vector that another recipe made."""
    return (F.size("embedding") > 0) & ~F.col("embed_version").eqNullSafe(F.lit(version))


def check_recipe(functions: DataFrame, version: str) -> Callable[[], None]:
    """A check to run before a search: raises if an indexed vector is of another recipe."""

    def run() -> None:
        stale = functions.where(is_stale(version)).limit(1).count()
        if stale:
            raise ValueError(f"the index holds vectors that weren't made by {version}: embed it again first")

    return run
