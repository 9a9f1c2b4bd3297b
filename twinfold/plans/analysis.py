"""Composed plans: the whole analysis of sources, the check of new functions, and the check of a change."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import clustering, diff, members, similarity, stats
from ..params import DEFAULTS, Params
from ..runtime import stage
from . import extract
from .providers import Provider, derive

#: Incoming rows that may be shipped to every worker; more go through the tiled join.
SHIPPED_ROWS = 2_000


def index(files: DataFrame, provider: Provider, cache: DataFrame | None = None, params: Params = DEFAULTS) -> DataFrame:
    """Stored functions of ``files`` (repo_id, file, body): extracted, described, embedded."""
    files = files.withColumn("_k", F.struct("repo_id", "file"))
    found = extract.functions_of(files.select("_k", "file", "body"), params.min_loc, id_col="_k").withColumn("repo_id", F.col("_k.repo_id")).drop("_k")
    found = stage(found, "index-functions")
    derived = stage(derive(found, cache, provider, params), "index-derived")
    key = F.concat_ws(":", "repo_id", "file", F.col("start_line").cast("string"), "name")
    return members.attach(found.withColumn("function_id", F.substring(F.sha2(key, 256), 1, 24)), derived)


def analyse(functions: DataFrame, params: Params = DEFAULTS) -> dict[str, DataFrame]:
    """Candidate clusters of stored functions and the statistics of their repositories before judgement."""
    found = stage(clustering.candidates(similarity.clusterable(functions), params, limit=False), "analysis-candidates")
    ids = found.select(text.member_key(F.col("member_ids")).alias("cluster_id"), "member_ids", "cohesion", "module_count", "priority")
    summary = found.agg(F.count(F.lit(1)).alias("candidates"), F.max(F.size("member_ids")).alias("largest"), F.sum(F.size("member_ids")).alias("members"))
    return {"candidates": ids, "summary": summary, "report": stats.index_report(functions)}


def _best(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """Of each asked row its most similar compatible one among ``rows`` of the same block; similarities are tried from the highest."""
    out: list[tuple] = []
    wild = set(text.WILDCARD_TYPES)
    meet = lambda x, y: x in wild or y in wild or x == y
    for size, mine, units in similarity._scaled(asked["vector"]):
        for other, theirs, stored in similarity._scaled(rows["vector"]):
            if other != size:
                continue
            names = rows["id"].to_numpy()[theirs]
            ins, outs = rows["inputs"].to_numpy()[theirs], rows["outputs"].to_numpy()[theirs]
            for k, sims in zip(mine, units @ stored.T):
                ia, oa = asked["inputs"].iloc[k], asked["outputs"].iloc[k]
                for j in np.lexsort((names, -np.round(sims, 9))):
                    if (not len(oa) or not len(outs[j]) or any(meet(x, y) for x in oa for y in outs[j])) and all(map(meet, ia, ins[j])):
                        out.append((asked["id"].iloc[k], names[j], float(sims[j])))
                        break
    return pd.DataFrame(out, columns=["id", "match", "similarity"])


def _against_shipped(shipped):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = shipped.value
        for rows in batches:
            for block, part in rows.groupby("block"):
                if block in asked:
                    yield _best(asked[block], part)

    return run


def _tiled(rows: pd.DataFrame) -> pd.DataFrame:
    return _best(rows[rows["asks"]], rows[~rows["asks"]])


def nearest(incoming: DataFrame, stored: DataFrame, shipped_rows: int = SHIPPED_ROWS, tile: int = similarity.TILE) -> DataFrame:
    """(id, match, similarity): of every incoming row its most similar compatible stored row.

    Both as from :func:`similarity.clusterable`, with identifiers of one type. A small request is shipped to the
    workers, so the index moves nowhere; a large one meets it tile by tile. Either way a task gives one row for each
    incoming row it saw, never a pair more, and one aggregation follows.
    """
    spark = incoming.sparkSession
    plain = [F.transform(c, text.normal_type).alias(c) for c in ("inputs", "outputs")]
    incoming, stored = (df.select("id", "block", "vector", *plain) for df in (incoming, stored))
    kind = stored.schema["id"].dataType.simpleString()
    schema = f"id {incoming.schema['id'].dataType.simpleString()}, match {kind}, similarity double"
    if incoming.limit(shipped_rows + 1).count() <= shipped_rows:
        rows = incoming.toPandas()
        shipped = spark.sparkContext.broadcast({block: part for block, part in rows.groupby("block")})
        return similarity.best_of(stored.mapInPandas(_against_shipped(shipped), schema))
    sizes = [df.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias(name)) for df, name in ((incoming, "n_asking"), (stored, "n_stored"))]
    tiles = F.broadcast(sizes[0].join(sizes[1], "block"))  # a row a block
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = incoming.join(tiles, "block").withColumn("asks", F.lit(True)).withColumn("t", own("n_asking")).withColumn("u", every("n_stored"))
    right = stored.join(tiles, "block").withColumn("asks", F.lit(False)).withColumn("t", every("n_asking")).withColumn("u", own("n_stored"))
    columns = ["block", "t", "u", "id", "vector", "inputs", "outputs", "asks"]
    met = left.select(*columns).unionByName(right.select(*columns)).groupBy("block", "t", "u").applyInPandas(_tiled, schema)
    return similarity.best_of(met)


def guard(incoming: DataFrame, stored: DataFrame, clusters: DataFrame, emit_unmatched: bool = False, params: Params = DEFAULTS) -> DataFrame:
    """(id, match, similarity, state, used_by): new functions against the index; refuses an index of another recipe.

    State is 'near' from the match floor, which compares the unrounded similarity, else 'novel'. Functions without a
    compatible neighbour come out only on request.
    """
    similarity.check_recipe(stored, params.embed_version)()
    mine = similarity.clusterable(incoming)
    best = nearest(mine, similarity.clusterable(stored))
    near = F.col("similarity") >= params.match_floor
    homes = members.used_by(clusters, stored).select(F.col("function_id").alias("match"), F.col("modules").alias("used_by"))
    out = best.join(homes, "match", "left").select("id", "match", text.round2(F.col("similarity")).alias("similarity"), F.when(near, "near").otherwise("novel").alias("state"), "used_by")
    if emit_unmatched:
        rest = mine.select("id").join(out.select("id"), "id", "left_anti")
        out = out.unionByName(rest.withColumn("state", F.lit("novel")), allowMissingColumns=True)
    return out


def change(patches: DataFrame, contents: DataFrame, stored: DataFrame, clusters: DataFrame, provider: Provider, params: Params = DEFAULTS) -> DataFrame:
    """The functions that a change touched, against the index, which it only reads.

    ``patches`` has (repo_id, filename, status, patch), ``contents`` (repo_id, file, body) of the new versions.
    """
    ranges = diff.changed_ranges(patches, ["repo_id"]).withColumnRenamed("filename", "file")
    fresh = index(contents.join(ranges.select("repo_id", "file").distinct(), ["repo_id", "file"], "left_semi"), provider, members.derivations(stored), params)
    touched = members.overlapping(fresh, ranges, ["repo_id", "file"])
    return guard(touched, stored, clusters, emit_unmatched=True, params=params)
