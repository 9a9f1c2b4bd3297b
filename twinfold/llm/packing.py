"""Problem 8: documents packed into containers of fixed capacity by the sum-of-squares rule.

A document goes where the sum, over all gaps, of the squared number of open containers with that gap becomes
smallest; a new container is one of the choices. The rule keeps the gaps of the open containers spread out, so that
most sizes find a gap that they fill. Documents are dealt into shards of bounded size by a hash of their identifier
and each shard is packed by one task. Containers of which more than ``LOOSE`` is left are unpacked and dealt into fewer,
again bounded, shards, until one shard is left or nothing more is saved.

Defined results
    null or empty text    size 0: one row, in a container of its shard, taking no space
    larger than capacity  cut into full containers and one remainder; nothing else is ever cut
    null identifier       packed like any other document
    repeated rows         each row is an item
    empty table           no rows
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import stage
from . import tokenizer

CAPACITY = 2048
#: Items of one task, and the share of a container that must stay empty for it to be unpacked again.
SHARD_ITEMS, LOOSE = 20_000, 0.02


class Packer:
    """Sum-of-squares packing of integer sizes, one item at a time."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.arrive = np.ones(capacity + 1)  # rise of the sum when a container comes to this gap
        self.arrive[0] = 0.0
        self.leave = np.full(capacity + 1, -np.inf)  # fall of the sum when one leaves it
        self.made = 0

    def _shift(self, gap: int, by: int) -> None:
        n = len(self.open[gap]) if by else 0
        if gap:
            self.arrive[gap] = 2.0 * n + 1.0
            self.leave[gap] = 2.0 * n - 1.0 if n else -np.inf

    def place(self, size: int) -> int:
        c = self.capacity
        rise = self.arrive[: c + 1 - size] - self.leave[size:]
        k = int(np.argmin(rise))  # of equal choices the tightest
        gap = k + size
        if rise[k] <= self.arrive[c - size] and self.open[gap]:
            where = self.open[gap].pop()
            self._shift(gap, 1)
        else:
            where, gap = self.made, c
            self.made += 1
        left = gap - size
        if left:
            self.open[left].append(where)
            self._shift(left, 1)
        return where


def _pack_shard(capacity: int):
    def run(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["_order", "first_token"], kind="stable")
        packer = Packer(capacity)
        sizes = items["n_tokens"].tolist()
        items["_slot"] = [packer.place(n) if n else 0 for n in sizes]
        items["_fill"] = items.groupby("_slot")["n_tokens"].transform("sum")
        return items

    return run


def pack(sizes: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(``container_id``, ``id_col``, ``first_token``, ``n_tokens``): where each document, or each piece of it, went."""
    size = F.coalesce(F.col(size_col), F.lit(0)).cast("int")
    starts = F.when(size == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), size - 1, F.lit(capacity)))
    items = sizes.select(F.col(id_col), size.alias("_size"), F.explode(starts).alias("first_token"))
    items = items.select(id_col, "first_token", F.least(F.col("_size") - F.col("first_token"), F.lit(capacity)).alias("n_tokens"))
    items = stage(items.withColumn("_order", F.xxhash64(id_col, "first_token")), "p8-items")

    parts: list[DataFrame] = []
    level, waiting, before = 0, items, None
    while True:
        n = waiting.count()
        shards = max(1, -(-n // shard_items))
        schema = T.StructType([*waiting.schema.fields, T.StructField("_shard", T.IntegerType()), T.StructField("_slot", T.LongType()), T.StructField("_fill", T.LongType())])
        packed = (
            waiting.withColumn("_shard", F.pmod(F.xxhash64("_order", F.lit(level)), F.lit(shards)).cast("int"))
            .groupBy("_shard")
            .applyInPandas(_pack_shard(capacity), schema)
        )
        packed = stage(packed, f"p8-level{level}")
        last = shards == 1 or (before is not None and n > 0.7 * before)
        done = packed if last else packed.where(F.col("_fill") >= capacity * (1 - LOOSE))
        # level, shard and slot in one number
        number = F.shiftleft(F.lit(level).cast("long"), 58) + F.shiftleft(F.col("_shard").cast("long"), 30) + F.col("_slot")
        parts.append(done.select(number.alias("container_id"), id_col, "first_token", "n_tokens"))
        if last:
            break
        waiting = packed.where(F.col("_fill") < capacity * (1 - LOOSE)).select(*items.columns)
        level, before = level + 1, n
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def containers(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, **options) -> DataFrame:
    """Pack ``documents`` (doc_id, text), sized in tokens of the tokenizer at ``tokenizer_path``."""
    sizes = tokenizer.encode(documents, tokenizer_path, count_only=True)
    return pack(stage(sizes, "p8-sizes"), capacity=capacity, **options)
