"""Problem 1: records that are equal but for formatting.

Every record gets a canonical key (SHA-256 of its canonical text). Keys with many copies are found exactly by
partial counts, their rows are salted into a two-level aggregation, all other keys take one shuffle. The
representative of a group is its smallest identifier.

Defined results
    null body or attrs      equal to another null in that column only, not to an empty text
    attrs that isn't JSON   compared as one text, under the same rules as a string value, never equal to JSON
    repeated rows           one identifier counts once, however often it is delivered
    null identifier         the row is left out: it can neither represent nor be named
    empty table             no rows
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import HOT_ROWS, hot_keys, salted_lookup, stage, with_slices

#: What a copy may differ by, beside white space and letter case.
IGNORED = "'\"`;,"
_GONE = re.compile(rf"[\s﻿​{IGNORED}]+")
_JVM_GONE = "[\\p{IsWhite_Space}\\x{1C}-\\x{1F}\\x{FEFF}\\x{200B}" + IGNORED + "]+"


def _plain(text: str) -> str:
    return _GONE.sub("", text).lower()


def _canonical(value):
    if isinstance(value, str):
        return _plain(value)
    if isinstance(value, list):
        return [_canonical(v) for v in value]
    if isinstance(value, dict):
        return {k: _canonical(v) for k, v in value.items()}
    return value


def canonical_json(text: str | None) -> str | None:
    """The JSON text with sorted fields, one spacing, one way of escaping, and canonical string values."""
    if text is None:
        return None
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return "?" + _plain(text)
    return "=" + json.dumps(_canonical(value), sort_keys=True, separators=(",", ":"))


@F.pandas_udf(T.StringType())
def _canonical_json(column: pd.Series) -> pd.Series:
    return pd.Series([canonical_json(t) for t in column], dtype=object)


def canonical_text(column):
    """Lower case without white space of any kind and without the ignored characters; stays in the JVM."""
    return F.lower(F.regexp_replace(column, _JVM_GONE, ""))


def membership(records: DataFrame, id_col: str = "record_id", text_col: str = "body", json_col: str = "attrs", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(``keep_id``, ``record_id``): every record with the representative of its group, itself included."""
    # chr(0) marks a null; the canonical texts can't hold the separator chr(1) followed by it
    key = F.sha2(
        F.concat(F.coalesce(canonical_text(F.col(text_col)), F.lit("\x00")), F.lit("\x01"), F.coalesce(_canonical_json(F.col(json_col)), F.lit("\x00"))), 256
    )
    keyed = records.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("record_id"), F.unhex(key).alias("_key"))
    keyed = stage(keyed, "p1-keys")

    hot = stage(hot_keys(keyed, "_key", hot_rows), "p1-hot")
    keyed = with_slices(keyed, hot, "_key", F.xxhash64("record_id"))
    cold = (
        keyed.where(F.col("_slices").isNull())
        .groupBy("_key")
        .agg(F.min("record_id").alias("keep_id"), F.collect_set("record_id").alias("_ids"))
        .select("keep_id", F.explode("_ids").alias("record_id"))
    )
    first = stage(
        keyed.where(F.col("_slices").isNotNull())
        .withColumn("_slice", F.pmod(F.xxhash64("record_id"), F.col("_slices")))
        .groupBy("_key", "_slice")
        .agg(F.min("record_id").alias("_low"), F.collect_set("record_id").alias("_ids")),
        "p1-hot-first",
    )
    second = first.groupBy("_key").agg(F.min("_low").alias("keep_id"))
    # the slices of a hot key meet its representative in as many tasks as it has slices
    heavy = salted_lookup(first.withColumnRenamed("_slice", "_part"), second, "_key", F.xxhash64("_part"), hot=hot).select("keep_id", F.explode("_ids").alias("record_id"))
    return cold.unionByName(heavy)


def copies(records: DataFrame, **columns) -> DataFrame:
    """(``keep_id``, ``n_copies``): one row for each distinct record."""
    return membership(records, **columns).groupBy("keep_id").agg(F.count(F.lit(1)).alias("n_copies"))


def found(records: DataFrame, **columns) -> DataFrame:
    """(``keep_id``, ``copy_id``): one row for each record that isn't the representative of its group."""
    return membership(records, **columns).where(F.col("record_id") != F.col("keep_id")).select("keep_id", F.col("record_id").alias("copy_id"))
