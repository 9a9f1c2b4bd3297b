"""Descriptions and vectors of bodies from pluggable providers, behind a cache keyed by content.

A provider sees each distinct body once. Results carry their provenance: 'replay' from a table of earlier results,
'heuristic' from the offline stand-in below, or the name of a provider that is passed in. The stand-in makes no
claim to understand code; it gives the later stages something deterministic to work on.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..params import DEFAULTS, Params

FINGERPRINT = "struct<intent:string,domain:string,inputs:array<string>,outputs:array<string>,side_effects:array<string>,behavior:array<string>,pure:boolean>"


class Provider(Protocol):
    name: str

    def describe(self, bodies: list[dict]) -> list[dict | None]:
        """A fingerprint for each body, or None where there is none: a failure is never guessed."""

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        """A vector for each text, in their order."""


def _words(code: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]?[a-z]{3,}", code)]


class Heuristic:
    """Word statistics instead of a model."""

    name = "heuristic"

    def __init__(self, dimensions: int = DEFAULTS.dimensions):
        self.dimensions = dimensions

    def describe(self, bodies: list[dict]) -> list[dict | None]:
        out: list[dict | None] = []
        for row in bodies:
            words = _words(row["body"] or "")
            if not words:
                out.append(None)
                continue
            common = sorted(set(words), key=lambda w: (-words.count(w), w))
            calls = list(dict.fromkeys(re.findall(r"\.(\w+)\(", row["body"])))
            out.append(
                {
                    "intent": " ".join(sorted(common[:4])),
                    "domain": common[0],
                    "inputs": ["unknown"] * len(row["params"] if row["params"] is not None else []),
                    "outputs": [row["return_type_text"] or "unknown"],
                    "side_effects": [] if row["is_pure"] else ["unknown"],
                    "behavior": [f"applies {c}" for c in calls],
                    "pure": bool(row["is_pure"]),
                }
            )
        return out

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        out: list[list[float] | None] = []
        for t in texts:
            v = np.zeros(self.dimensions)
            for w in _words(t):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % self.dimensions] += 1.0 if h >> 40 & 1 else -1.0
            size = np.linalg.norm(v)
            out.append((v / size).tolist() if size else None)
        return out


def _batched(call: Callable[[list], list], rows: list, size: int) -> list:
    out: list = []
    for k in range(0, len(rows), size):
        part = call(rows[k : k + size])
        if len(part) != len(rows[k : k + size]):
            raise ValueError(f"{len(part)} answers for {len(rows[k : k + size])} requests")
        out += part
    return out


def derive(functions: DataFrame, cache: DataFrame | None, provider: Provider, params: Params = DEFAULTS) -> DataFrame:
    """(body_hash, fingerprint, embedding, embed_version, provenance) of every distinct body of ``functions``.

    ``cache`` has (body_hash, fingerprint, embedding, embed_version). A fingerprint is reused whatever its recipe, a
    vector only if its recipe is current. Bodies without a fingerprint are left out. Write the result before using it
    twice, so that no body is paid for again.
    """
    bodies = functions.groupBy("body_hash").agg(F.min_by(F.struct("body", "params", "return_type_text", "is_pure", "name"), F.struct("name", "body")).alias("r")).select("body_hash", "r.*")
    if cache is None:
        cache = bodies.limit(0).selectExpr("body_hash", f"cast(null as {FINGERPRINT}) as fingerprint", "cast(null as array<double>) as embedding", "cast(null as string) as embed_version")
    wanted = bodies.join(cache.select("body_hash", "fingerprint", "embedding", "embed_version"), "body_hash", "left")
    schema = f"body_hash string, name string, fingerprint {FINGERPRINT}, embedding array<double>, embed_version string, provenance string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            missing = rows["fingerprint"].isna().to_numpy()
            asked = rows.loc[missing, ["body", "params", "return_type_text", "is_pure"]].to_dict("records")
            rows["provenance"] = np.where(missing, provider.name, "replay")
            if asked:
                answers = _batched(provider.describe, asked, params.embed_batch)
                rows["fingerprint"] = pd.Series(dict(zip(rows.index[missing], answers)), dtype=object).reindex(rows.index).where(missing, rows["fingerprint"])
            yield rows[["body_hash", "name", "fingerprint", "embedding", "embed_version", "provenance"]]

    described = wanted.mapInPandas(run, schema).where(F.col("fingerprint").isNotNull())
    p, name = F.col("fingerprint"), F.col("name")
    clean = p
    for column in ("intent", "domain"):
        clean = clean.withField(column, text.scrub(p[column], name))
    for column in ("behavior", "side_effects"):
        clean = clean.withField(column, F.transform(p[column], lambda x: text.scrub(x, name)))
    described = described.withColumn("fingerprint", F.when(F.col("provenance") == "replay", p).otherwise(clean))
    p = F.col("fingerprint")
    described = described.withColumn("t", text.embed_text(p["intent"], p["domain"], p["inputs"], p["outputs"]))
    stale = F.col("embedding").isNull() | (F.size("embedding") == 0) | ~F.col("embed_version").eqNullSafe(F.lit(params.embed_version))
    described = described.withColumn("embedding", F.when(~stale, F.col("embedding"))).drop("embed_version", "name")

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            at = rows.index[rows["embedding"].isna()]
            if len(at):
                made = _batched(provider.embed, rows.loc[at, "t"].tolist(), params.embed_batch)
                rows["embedding"] = pd.Series(dict(zip(at, made)), dtype=object).reindex(rows.index).where(rows["embedding"].isna(), rows["embedding"])
            yield rows[["body_hash", "fingerprint", "embedding", "provenance"]]

    out = described.mapInPandas(embed, f"body_hash string, fingerprint {FINGERPRINT}, embedding array<double>, provenance string")
    return out.where(F.col("embedding").isNotNull()).withColumn("embed_version", F.lit(params.embed_version))


def report(functions: DataFrame, derived: DataFrame) -> DataFrame:
    """One row: functions, distinct bodies, bodies by provenance, bodies without a result."""
    total = functions.agg(F.count(F.lit(1)).alias("functions"), F.countDistinct("body_hash").alias("bodies"))
    done = derived.agg(F.count_if(F.col("provenance") == "replay").alias("reused"), F.count_if(F.col("provenance") != "replay").alias("calls"))
    return total.crossJoin(done).withColumn("failed", F.col("bodies") - F.col("reused") - F.col("calls"))  # two single rows
