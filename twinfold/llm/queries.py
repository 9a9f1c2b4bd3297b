"""The queries of this subpackage and, where SQL can say it, their equivalents."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import formatting_duplicates, match_groups, near_duplicates, packing, source_kinds, spectral, subjects, tokenizer, vector_search


#: Where the public tokenizer files lie; TWINFOLD_TOKENIZERS names another folder.
TOKENIZERS = os.environ.get("TWINFOLD_TOKENIZERS", "/opt/tokenizers")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting_duplicates.found(_table(spark, sf_dir, "cache_record"))


def p1_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting_duplicates.copies(_table(spark, sf_dir, "cache_record"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.found(_table(spark, sf_dir, "repo_function"))


def p2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spectral.describe(_table(spark, sf_dir, "repo_function"))
    return rows.select("cluster_key", "size", F.round("cohesion", 5).alias("cohesion"), F.array_join("typical_ids", " ").alias("typical_ids"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_groups.found(_table(spark, sf_dir, "labelled_pair"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_kinds.found(_table(spark, sf_dir, "source_file"), _table(spark, sf_dir, "library_file"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.found(_table(spark, sf_dir, "repo_function"))


def p5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(_table(spark, sf_dir, "repo_function"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.found(_table(spark, sf_dir, "repo_function"))


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(_table(spark, sf_dir, "repo_function"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.containers(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.found(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "subject_area"), _table(spark, sf_dir, "subject_label"))


QUERIES = {f.__name__: f for f in (p1_found, p1_copies, p2_found, p2_clusters, p3_found, p4_found, p5_found, p5_nearest, p6_found, p6_classes, p7_ids, p8_containers, p9_found)}

_P3_SQL = r"""
WITH RECURSIVE l AS (
  SELECT DISTINCT a AS s, b AS t FROM labelled_pair
  WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b AND lower(regexp_replace(label, '^\s+|\s+$', '', 'g')) = 'clone'
), e AS (SELECT s, t FROM l UNION SELECT t, s FROM l),
r AS (SELECT s AS v, s AS w FROM e UNION SELECT r.v, e.t FROM r JOIN e ON r.w = e.s)
SELECT min(w) AS group_id, v AS function_id FROM r GROUP BY v
"""

_PLAIN = "lower(regexp_replace({0}, '[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}\\x{{feff}}\\x{{200b}}''\"`;,]+', '', 'g'))"


def _plain(c: str) -> str:
    return _PLAIN.format(c)


_FIELDS = """'{"name":"VARCHAR","file":"VARCHAR","signature":"VARCHAR","params":["VARCHAR"],"returnTypeText":"VARCHAR","imports":["VARCHAR"],"isExported":"BOOLEAN","callsExternal":"BOOLEAN","isPure":"BOOLEAN"}'"""
_P1_SQL = f"""
r AS (SELECT record_id, body, from_json(attrs, {_FIELDS}) AS a FROM cache_record),
g AS (SELECT record_id, min(record_id) OVER (PARTITION BY {_plain("body")}, {_plain("a.name")}, {_plain("a.file")}, {_plain("a.signature")}, {_plain("a.returnTypeText")},
  list_transform(a.params, lambda x: {_plain("x")}), list_transform(a.imports, lambda x: {_plain("x")}), a.isExported, a.callsExternal, a.isPure) AS keep_id FROM r)"""

_USABLE = """u AS (SELECT function_id AS id, embedding AS v FROM repo_function WHERE embed_version = 'intent-v3' AND len(embedding) = 96 AND list_sum([abs(x) for x in embedding]) > 0
  QUALIFY row_number() OVER (PARTITION BY function_id ORDER BY updated_at DESC) = 1)"""
_VECTORS = _USABLE + """,
s AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS c FROM u a JOIN u b ON a.id <> b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.80)"""

_P6_RUNS = r"""f AS (SELECT function_id AS id, list_filter(string_split_regex(lower(coalesce(signature, '') || chr(10) || coalesce(body, '')), '[^a-z0-9_$]+'), lambda x: x <> '') AS t
  FROM repo_function QUALIFY row_number() OVER (PARTITION BY function_id ORDER BY updated_at DESC) = 1),
r AS (SELECT DISTINCT id, unnest(list_transform(range(1, greatest(len(t) - 1, 1)), lambda k: t[k] || ' ' || t[k + 1] || ' ' || t[k + 2])) AS run FROM f),
n AS (SELECT id, count(*) AS n FROM r GROUP BY id),
p AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM r x JOIN r y ON x.run = y.run AND x.id < y.id GROUP BY ALL)"""

_P6_SQL = f"WITH {_P6_RUNS} SELECT a AS function_a, b AS function_b FROM p JOIN n m ON m.id = a JOIN n o ON o.id = b WHERE 5 * c >= 3 * (m.n + o.n - c)"

ORACLE_SQL = {
    "p1_found": f"WITH {_P1_SQL} SELECT DISTINCT keep_id, record_id AS copy_id FROM g WHERE record_id <> keep_id",
    "p1_copies": f"WITH {_P1_SQL} SELECT keep_id, count(DISTINCT record_id) AS n_copies FROM g GROUP BY keep_id",
    "p2_found": f"WITH RECURSIVE {_VECTORS}, w AS (SELECT a AS v, a AS w FROM s UNION SELECT w.v, s.b FROM w JOIN s ON w.w = s.a) SELECT min(w) AS cluster_key, v AS function_id FROM w GROUP BY v",
    "p2_clusters": f"""WITH RECURSIVE {_VECTORS}, w AS (SELECT a AS v, a AS w FROM s UNION SELECT w.v, s.b FROM w JOIN s ON w.w = s.a), k AS (SELECT min(w) AS cluster_key, v AS id FROM w GROUP BY v),
p AS (SELECT x.cluster_key, list_cosine_similarity(a.v, b.v) AS c FROM k x JOIN k y ON x.cluster_key = y.cluster_key AND x.id < y.id JOIN u a ON a.id = x.id JOIN u b ON b.id = y.id),
c AS (SELECT cluster_key, round(avg(c), 5) AS cohesion FROM p GROUP BY 1), i AS (SELECT k.cluster_key, k.id, round(sum(s.c), 4) AS held FROM k JOIN s ON s.a = k.id GROUP BY ALL),
t AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY cluster_key ORDER BY held DESC, id) <= 3)
SELECT c.cluster_key, (SELECT count(*) FROM k WHERE k.cluster_key = c.cluster_key) AS size, c.cohesion, (SELECT string_agg(t.id, ' ' ORDER BY t.held DESC, t.id) FROM t WHERE t.cluster_key = c.cluster_key) AS typical_ids FROM c""",
    "p3_found": _P3_SQL,
    "p5_found": f"WITH {_VECTORS}, k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(c, 12) DESC, b) <= 5) SELECT DISTINCT least(a, b) AS function_a, greatest(a, b) AS function_b FROM k",
    "p5_nearest": f"""WITH {_USABLE}, c AS (SELECT a.id AS function_id, b.id AS neighbour_id, list_cosine_similarity(a.v, b.v) AS c FROM u a JOIN u b ON a.id <> b.id
  WHERE ('0x' || substr(a.id, 5, 8))::BIGINT % 50 = 0)
SELECT function_id, neighbour_id, row_number() OVER (PARTITION BY function_id ORDER BY round(c, 12) DESC, neighbour_id) AS place FROM c QUALIFY place <= 5""",
    "p6_found": _P6_SQL,
    "p6_classes": f"""WITH {_P6_RUNS}, k AS (SELECT id, list_sort(list(run)) AS runs FROM r GROUP BY id), g AS (SELECT id, min(id) OVER (PARTITION BY runs) AS class_id, count(*) OVER (PARTITION BY runs) AS n_members FROM k),
l AS (SELECT a, b FROM p JOIN n m ON m.id = a JOIN n o ON o.id = b WHERE 5 * c >= 3 * (m.n + o.n - c)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l)
SELECT g.id AS function_id, g.class_id, g.n_members, count(h.id) AS n_links FROM g LEFT JOIN (SELECT e.a, h.id FROM e JOIN g h ON h.id = e.b JOIN g x ON x.id = e.a AND x.class_id <> h.class_id) h ON h.a = g.id GROUP BY ALL""",
}
