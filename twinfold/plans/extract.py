"""From source files to functions: a table-valued stage, one file in, any number of rows out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexer, text
from ..params import DEFAULTS
from ..runtime import width

_FIELDS = [
    ("name", T.StringType()),
    ("signature", T.StringType()),
    ("body", T.StringType()),
    ("start_line", T.IntegerType()),
    ("end_line", T.IntegerType()),
    ("params", T.ArrayType(T.StringType())),
    ("return_type_text", T.StringType()),
    ("imports", T.ArrayType(T.StringType())),
    ("is_exported", T.BooleanType()),
    ("is_accessor", T.BooleanType()),
    ("calls_external", T.BooleanType()),
    ("is_pure", T.BooleanType()),
    ("impure_reason", T.StringType()),
    ("preamble", T.StringType()),
    ("error", T.StringType()),
]


def functions_in(code: str | None) -> list[tuple]:
    """Rows of ``_FIELDS`` for one file; a file that can't be read gives one row with only an error."""
    if not code:
        return []
    try:
        file = lexer.read(code)
        rows = []
        for f in file.functions:
            body = file.text(f.first, f.body[1])
            end = file.tokens[f.body[1]]
            head = " ".join(file.text(f.first, max(f.first, f.body[0] - 1)).replace("=>", " ").split())
            last_line = end.line + end.text.count("\n")
            shown = lexer.preamble(file, f) if f.pure else None
            rows.append((f.name, head, body, file.tokens[f.first].line, last_line, f.params, f.return_type, file.imports, f.exported, f.accessor, f.external, f.pure, f.reason or None, shown, None))
        return rows
    except (IndexError, KeyError, RecursionError) as e:
        return [(None,) * (len(_FIELDS) - 1) + (f"{type(e).__name__}: {e}",)]


def raw_functions(files: DataFrame, id_col: str = "file_id", path_col: str = "file", code_col: str = "body") -> DataFrame:
    """(id, file, ...) of every function of every file, errors included."""
    source = files.select(id_col, path_col, code_col).repartition(width(files.sparkSession))
    schema = T.StructType([source.schema[0], T.StructField("file", T.StringType()), *[T.StructField(n, t) for n, t in _FIELDS]])

    def run(batches):
        import pyarrow as pa

        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            rows = [
                (key, path, *row)
                for key, path, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())
                for row in functions_in(code)
            ]
            columns = list(zip(*rows)) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return source.mapInArrow(run, schema)


def functions_of(files: DataFrame, min_loc: int = DEFAULTS.min_loc, **columns) -> DataFrame:
    """Functions worth comparing, with hash and lines; accessors, trivial and broken ones are left out."""
    rows = raw_functions(files, **columns).where(F.col("error").isNull()).drop("error")
    rows = rows.withColumn("loc", F.col("end_line") - F.col("start_line") + 1)
    reason = text.skip_reason(F.col("loc"), F.col("body"), F.col("is_accessor"), min_loc)
    return rows.where(reason.isNull()).drop("is_accessor").withColumn("body_hash", text.body_hash(F.col("body")))


def skipped(files: DataFrame, min_loc: int = DEFAULTS.min_loc, **columns) -> DataFrame:
    """(reason, functions): how many functions were left out, and why."""
    rows = raw_functions(files, **columns).withColumn("loc", F.col("end_line") - F.col("start_line") + 1)
    reason = F.when(F.col("error").isNotNull(), "unreadable").otherwise(text.skip_reason(F.col("loc"), F.col("body"), F.col("is_accessor"), min_loc))
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("functions")).where("reason is not null")
