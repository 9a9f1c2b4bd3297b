"""Readers: extractor caches, source archives and plain source trees."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

#: Limits of an archive: a larger file is skipped, a larger archive refused.
MAX_FILE, MAX_ARCHIVE = 512 * 1024, 256 * 1024 * 1024

_TEXT, _INT, _BOOL = T.StringType(), T.IntegerType(), T.BooleanType()
FUNCTION = T.StructType(
    [T.StructField(n, _TEXT) for n in ("name", "file", "signature", "body", "bodyHash", "returnTypeText", "preamble")]
    + [T.StructField(n, _INT) for n in ("startLine", "endLine", "loc")]
    + [T.StructField(n, _BOOL) for n in ("isExported", "callsExternal", "isPure")]
    + [T.StructField(n, T.ArrayType(_TEXT)) for n in ("params", "imports")]
)
ENVELOPE = T.StructType([T.StructField(n, _TEXT) for n in ("owner", "name", "repo", "commit")] + [T.StructField("functions", T.ArrayType(FUNCTION))])
NAMES = {"bodyHash": "body_hash", "returnTypeText": "return_type_text", "startLine": "start_line", "endLine": "end_line", "isExported": "is_exported", "callsExternal": "calls_external", "isPure": "is_pure"}


def extractor_cache(spark: SparkSession, path: str) -> DataFrame:
    """Functions of JSON cache files that hold either an envelope or a bare array; strict about their shape."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("cache"), F.col("value"))
    bare = F.from_json("value", T.ArrayType(FUNCTION), {"mode": "FAILFAST"})
    envelope = F.from_json("value", ENVELOPE, {"mode": "FAILFAST"})
    is_bare = F.ltrim(F.col("value")).startswith("[")
    read = whole.select(
        "cache",
        F.when(~is_bare, F.coalesce(envelope["owner"], F.split(envelope["repo"], "/")[0])).alias("owner"),
        F.when(~is_bare, F.coalesce(envelope["name"], F.split(envelope["repo"], "/")[1])).alias("repo_name"),
        F.coalesce(F.when(~is_bare, envelope["commit"]), F.lit("unknown")).alias("commit_sha"),
        F.when(is_bare, bare).otherwise(envelope["functions"]).alias("functions"),
    )
    rows = read.select("cache", "owner", "repo_name", "commit_sha", F.inline("functions"))
    rows = rows.withColumnsRenamed(NAMES)
    return rows.withColumns({"body_hash": F.coalesce("body_hash", text.body_hash(F.col("body"))), "loc": F.coalesce("loc", text.line_count(F.col("body")))})


def record_functions(records: DataFrame) -> DataFrame:
    """Raw extractor deliveries (attrs as JSON) as typed functions, hash and line count derived where missing."""
    kept = T.StructType([f for f in FUNCTION.fields if f.name not in ("body", "bodyHash", "preamble", "startLine", "endLine", "loc")])
    attrs = F.from_json("attrs", kept)
    rows = records.select("record_id", "repo_id", "body", F.lower("body_hash").alias("body_hash"), "start_line", "end_line", "loc", attrs.alias("a"), "received_at")
    rows = rows.select("record_id", "repo_id", "body", "body_hash", "start_line", "end_line", "loc", "received_at", "a.*").withColumnsRenamed(NAMES)
    return rows.withColumns({"body_hash": F.coalesce("body_hash", text.body_hash(F.col("body"))), "loc": F.coalesce("loc", text.line_count(F.col("body")))})


def _entries(content: bytes, scope: str) -> Iterator[tuple[str, str, str, str]]:
    with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as archive:
        total = 0
        for entry in archive:
            root, _, path = entry.name.partition("/")
            if not entry.isfile() or not path or (scope and not path.startswith(scope + "/")):
                continue
            if entry.size > MAX_FILE:
                yield root, path, "", "too large"
                continue
            total += entry.size
            if total > MAX_ARCHIVE:
                raise ValueError(f"archive {root} holds more than {MAX_ARCHIVE} bytes")
            yield root, path, archive.extractfile(entry).read().decode("utf-8", "replace"), ""


def archives(spark: SparkSession, path: str, scope: str | None = None) -> DataFrame:
    """(archive, root, commit, file, contents, skipped) of .tar.gz archives: source files under ``scope``.

    One archive is read by one task, entry by entry; archives are spread over the cluster by the binary source.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar.gz").option("recursiveFileLookup", "true").load(path)
    prefix = (scope or "").strip("/")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(name, *e) for e in _entries(content, prefix)]
                columns = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["archive", "root", "file", "contents", "skipped"])

    rows = found.select("path", "content").mapInArrow(run, "archive string, root string, file string, contents string, skipped string")
    commit = text.archive_root(F.concat("root", F.lit("/")))["commit"]
    return rows.where(text.is_source_path(F.col("file"))).withColumn("commit", F.coalesce(commit, F.lit("unknown")))


def source_tree(spark: SparkSession, path: str, max_file: int = MAX_FILE) -> DataFrame:
    """(file, contents, length, skipped) of a directory of sources; a file over the limit isn't read, but comes out with the reason."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(text.is_source_path(F.col("path")))
    read = found.where(F.col("length") <= max_file).select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("contents"), "length", F.lit("").alias("skipped"))
    left = found.where(F.col("length") > max_file).select(F.col("path").alias("file"), F.lit(None).cast("string").alias("contents"), "length", F.lit("too large").alias("skipped"))
    return read.unionByName(left)
