"""Every operator as a query over the given tables, with the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..operators import clustering, diff, members, ordering, quality, similarity, stats
from ..params import DEFAULTS, Params
from ..sources import sinks, tables
from ..streaming import windows
from . import extract

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_SPACE = r"[\t\n\x0b\f\r\p{Z}\x{feff}]+"
_F = "f AS (SELECT * FROM repo_function QUALIFY row_number() OVER (PARTITION BY function_id ORDER BY updated_at DESC, start_line DESC) = 1)"



def _module(c: str) -> str:
    return f"CASE WHEN regexp_extract({c}, '(?s)^(.+)/[^/]*$', 1) = '' THEN '.' ELSE regexp_extract({c}, '(?s)^(.+)/[^/]*$', 1) END"


def _hash(c: str) -> str:
    return f"sha256(trim(regexp_replace({c}, '{_SPACE}', ' ', 'g')))"


def _normal(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({c}), '\\s*\\|\\s*(null|undefined)', '', 'g'), '\\?$', ''))"



def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that computes the same."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members.latest_functions(table(spark, sf_dir, "repo_function"))


# Scalar functions


@query(f"SELECT doc_id, {_hash('text')} AS body_hash FROM documents")
def fn_body_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.body_hash(F.col("text")).alias("body_hash"))


@query(f"SELECT function_id, {_module('file')} AS module, list_extract(string_split(file, '/'), -1) AS basename, array_to_string(string_split(file, '/')[1:3], '/') AS prefix FROM repo_function GROUP BY ALL")
def fn_paths(spark, sf):
    file = F.col("file")
    return table(spark, sf, "repo_function").select("function_id", text.module_of(file).alias("module"), text.basename(file).alias("basename"), text.path_prefix(file).alias("prefix")).distinct()


_EXCLUDED = ", ".join(f"'{d}'" for d in text.EXCLUDED_DIRECTORIES)


@query(
    "SELECT file_id, file, regexp_matches(file, '\\.(ts|tsx|js|jsx|mjs|cjs)$') AND NOT list_has_any(string_split(file, '/')[:-2], ["
    + _EXCLUDED
    + "]) AND NOT regexp_matches(file, '"
    + text.GENERATED_PATH
    + "') AND NOT regexp_matches(file, '"
    + text.TEST_PATH
    + "') AS is_source FROM source_file GROUP BY ALL"
)
def fn_source_paths(spark, sf):
    return table(spark, sf, "source_file").select("file_id", "file", text.is_source_path(F.col("file")).alias("is_source")).distinct()




@query(f"WITH {_F} SELECT {_normal('return_type_text')} AS type, least(len(params), 3) AS arity, count(*) AS functions FROM f GROUP BY ALL")
def fn_types(spark, sf):
    rows = functions(spark, sf).groupBy(text.normal_type(F.col("return_type_text")).alias("type"), text.arity_bucket(F.size("params")).alias("arity"))
    return rows.agg(F.count(F.lit(1)).alias("functions"))


@query(
    f"WITH {_F} SELECT function_id, fingerprint.intent || ' | domain: ' || fingerprint.domain || ' | ' || array_to_string(fingerprint.inputs, ',') || ' -> ' || "
    "array_to_string(fingerprint.outputs, ',') AS embed_text FROM f"
)
def fn_embed_text(spark, sf):
    p = F.col("fingerprint")
    return functions(spark, sf).select("function_id", text.embed_text(p["intent"], p["domain"], p["inputs"], p["outputs"]).alias("embed_text"))


_SQUEEZED = "trim(regexp_replace(body, '" + _SPACE + "', ' ', 'g'))"


_FORWARDS = f"""a AS (SELECT repo_id, loc, {_SQUEEZED} AS s FROM f),
b AS (SELECT *, trim(split_part(s, '(', 1)) AS h, ltrim(substr(s, strpos(s, ')') + 1)) AS r FROM a),
c AS (SELECT *, CASE WHEN starts_with(h || ' ', 'export ') THEN trim(substr(h, 7)) ELSE h END AS h2, CASE WHEN starts_with(r, '=>') THEN trim(substr(r, 3)) WHEN starts_with(r, '{{') THEN trim(substr(r, 2)) END AS i FROM b),
d AS (SELECT *, CASE WHEN starts_with(h2 || ' ', 'async ') THEN trim(substr(h2, 6)) ELSE h2 END AS h3, CASE WHEN ends_with(i, '}}') THEN rtrim(left(i, length(i) - 1)) ELSE i END AS i2 FROM c),
e AS (SELECT *, CASE WHEN ends_with(i2, ';') THEN rtrim(left(i2, length(i2) - 1)) ELSE i2 END AS i3 FROM d),
g AS (SELECT *, CASE WHEN starts_with(i3, 'return ') THEN substr(i3, 8) ELSE i3 END AS call FROM e),
w AS (SELECT repo_id, loc, coalesce(strpos(s, ')') > 0 AND (h3 = '' OR regexp_full_match(h3, 'function *[0-9A-Za-z_]*')) AND regexp_full_match(split_part(call, '(', 1), '[0-9A-Za-z_.]+')
  AND ends_with(substr(call, strpos(call, '(') + 1), ')') AND NOT regexp_matches(substr(call, strpos(call, '(') + 1), '[;{{}}]'), false) AS forwards FROM g)"""


@query(f"WITH {_F}, {_FORWARDS}, r AS (SELECT repo_id, CASE WHEN loc < 3 THEN 'under 3 lines' WHEN forwards THEN 'trivial wrapper' END AS reason FROM w) SELECT repo_id, reason, count(*) AS functions FROM r GROUP BY ALL")
def fn_skip_reasons(spark, sf):
    reason = text.skip_reason(F.col("loc"), F.col("body")).alias("reason")
    return functions(spark, sf).groupBy("repo_id", reason).agg(F.count(F.lit(1)).alias("functions"))


@query(
    f"WITH {_F} SELECT function_id, CASE WHEN length(body) > 400 THEN body[:400] || chr(10) || '/* ... truncated ... */' ELSE body END AS body, "
    f"trim(regexp_replace(regexp_extract(body, '(?s)^(.*?)(?:\\{{|=>|\\z)', 1), '{_SPACE}', ' ', 'g')) AS signature FROM f"
)
def fn_signatures(spark, sf):
    body = F.col("body")
    return functions(spark, sf).select("function_id", text.truncate_body(body, 400).alias("body"), text.signature_of(body).alias("signature"))


@query(
    f"WITH {_F}, s AS (SELECT function_id, name, unnest(list_append(fingerprint.behavior, 'calls  ' || name || ' twice')) AS step FROM f WHERE fingerprint.behavior IS NOT NULL) SELECT function_id, CASE WHEN contains(name, '_') OR contains(name, '$') OR regexp_matches(name, '^[A-Za-z]*[a-z][A-Z]') "
    "THEN trim(regexp_replace(regexp_replace(step, '\\b' || regexp_escape(name) || '\\b', '', 'g'), '[ \\t]{2,}', ' ', 'g')) ELSE step END AS step FROM s"
)
def fn_scrub(spark, sf):
    rows = functions(spark, sf).select("function_id", "name", F.explode(F.array_append("fingerprint.behavior", F.concat(F.lit("calls  "), F.col("name"), F.lit(" twice")))).alias("step"))
    return rows.select("function_id", text.scrub(F.col("step"), F.col("name")).alias("step"))


_URLS = """u AS (SELECT repo_id, unnest(['https://github.com/' || owner || '/' || name || '.git', 'http://www.github.com/' || owner || '/' || name || '/pull/' || (stats.functions + 1),
 'https://github.com/' || owner || '/' || name || '/tree/main', 'https://github.com/topics/' || name, 'https://example.org/' || owner || '/' || name]) AS url FROM repo_snapshot)"""


@query(
    f"WITH {_URLS}, p AS (SELECT repo_id, url, regexp_extract(url, '^https?://(www\\.)?github\\.com/([\\w.-]+)/([\\w.-]+)', 2) AS o, "
    "regexp_replace(regexp_extract(url, '^https?://(www\\.)?github\\.com/([\\w.-]+)/([\\w.-]+)', 3), '\\.git$', '') AS n FROM u) "
    "SELECT repo_id, url, CASE WHEN o NOT IN ('', 'topics') THEN o END AS owner, CASE WHEN o NOT IN ('', 'topics') THEN n END AS name, "
    "CASE WHEN url LIKE '%/tree/main' AND o NOT IN ('', 'topics') THEN 'main' END AS ref, "
    "CASE WHEN o NOT IN ('', 'topics') THEN try_cast(nullif(regexp_extract(url, '/pull/([1-9][0-9]{0,8})$', 1), '') AS INTEGER) END AS pr_number FROM p"
)
def fn_repo_urls(spark, sf):
    owner, name = F.col("owner"), F.col("name")
    base = F.concat(F.lit("https://github.com/"), owner, F.lit("/"), name)
    urls = F.array(
        F.concat(base, F.lit(".git")),
        F.concat(F.lit("http://www.github.com/"), owner, F.lit("/"), name, F.lit("/pull/"), (F.col("stats.functions") + 1).cast("string")),
        F.concat(base, F.lit("/tree/main")),
        F.concat(F.lit("https://github.com/topics/"), name),
        F.concat(F.lit("https://example.org/"), owner, F.lit("/"), name),
    )
    rows = table(spark, sf, "repo_snapshot").select("repo_id", F.explode(urls).alias("url"))
    parsed = rows.withColumn("p", text.repo_url(F.col("url")))
    return parsed.select("repo_id", "url", *[F.col(f"p.{c}").alias(c) for c in ("owner", "name", "ref", "pr_number")])


@query("SELECT cluster_id, floor(confidence * 100 + 0.5) / 100 AS confidence, least(greatest(confidence * 2 - 0.5, 0), 1) AS stretched FROM clone_cluster")
def fn_rounding(spark, sf):
    c = F.col("confidence")
    return table(spark, sf, "clone_cluster").select("cluster_id", text.round2(c).alias("confidence"), text.clamp(c * 2 - 0.5, 0.0, 1.0).alias("stretched"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events FROM events GROUP BY ALL")
def fn_days(spark, sf):
    return table(spark, sf, "events").groupBy(text.day_key(F.col("ts")).alias("day"), "event_type").agg(F.count(F.lit(1)).alias("events"))


@query(
    "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
)
def fn_cosine(spark, sf):
    left = table(spark, sf, "embeddings").select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    right = left.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("x").alias("y"))
    return left.join(right, "a").select("a", "b", F.round(vectors.cosine(F.col("x"), F.col("y")), 6).alias("similarity"))


# Scans, lookups and order


@query("SELECT owner, name, repo_id, indexed_at FROM repo_snapshot QUALIFY row_number() OVER (PARTITION BY owner, name ORDER BY indexed_at DESC NULLS LAST, repo_id) = 1")
def sc_latest_snapshots(spark, sf):
    return ordering.latest_snapshots(table(spark, sf, "repo_snapshot")).select("owner", "name", "repo_id", "indexed_at")


@query("SELECT repo_id, row_number() OVER (ORDER BY indexed_at DESC NULLS LAST, repo_id) AS place FROM repo_snapshot")
def sc_snapshot_order(spark, sf):
    order = [F.desc_nulls_last("indexed_at"), F.col("repo_id")]
    return ordering.placed(table(spark, sf, "repo_snapshot"), *order).select("repo_id", F.col("place").cast("bigint").alias("place"))


@query(f"WITH {_F} SELECT function_id, name, file, loc FROM f WHERE function_id IN (SELECT unnest(function_ids) FROM clone_cluster)")
def sc_functions_by_ids(spark, sf):
    ids = table(spark, sf, "clone_cluster").select(F.explode("function_ids").alias("function_id")).distinct()
    return functions(spark, sf).join(ids, "function_id", "left_semi").select("function_id", "name", "file", "loc")


@query(
    "SELECT body_hash, fingerprint.intent AS intent, len(embedding) AS dimensions, embed_version FROM repo_function WHERE fingerprint IS NOT NULL AND len(embedding) > 0 AND embed_version = 'intent-v3' "
    "QUALIFY row_number() OVER (PARTITION BY body_hash ORDER BY updated_at DESC, function_id DESC) = 1"
)
def sc_cached_derivations(spark, sf):
    rows = members.derivations(table(spark, sf, "repo_function"), DEFAULTS.embed_version)
    return rows.select("body_hash", F.col("fingerprint.intent").alias("intent"), F.size("embedding").alias("dimensions"), "embed_version")


@query(
    "SELECT repo_id, cluster_id, row_number() OVER (PARTITION BY repo_id ORDER BY confidence DESC NULLS LAST, cohesion DESC NULLS LAST, cluster_id) AS by_confidence, "
    "row_number() OVER (PARTITION BY repo_id ORDER BY CASE disagreement_risk WHEN 'semantic' THEN 0 WHEN 'cosmetic' THEN 1 ELSE 2 END, confidence DESC NULLS LAST, cohesion DESC NULLS LAST, cluster_id) AS by_risk FROM clone_cluster"
)
def sl_cluster_order(spark, sf):
    rows = ordering.placed(table(spark, sf, "clone_cluster"), *ordering.by_confidence(), by=["repo_id"], name="by_confidence")
    rows = ordering.placed(rows, *ordering.by_risk(), by=["repo_id"], name="by_risk")
    return rows.select("repo_id", "cluster_id", F.col("by_confidence").cast("bigint").alias("by_confidence"), F.col("by_risk").cast("bigint").alias("by_risk"))


@query(f"WITH {_F} SELECT repo_id, function_id, row_number() OVER (PARTITION BY repo_id ORDER BY file, start_line, function_id) AS place FROM f")
def sl_function_order(spark, sf):
    rows = ordering.placed(functions(spark, sf), F.col("file"), F.col("start_line"), F.col("function_id"), by=["repo_id"])
    return rows.select("repo_id", "function_id", F.col("place").cast("bigint").alias("place"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def sc_page(spark, sf):
    return ordering.page(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 3, 20)[0]


# Similarity and clusters


@query(
    "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS similarity "
    "FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.28"
)
def jn_similar_vectors(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("string").alias("block"))
    return similarity.similar_pairs(rows, 0.28, compatible=False).select("a", "b", F.round("similarity", 6).alias("similarity"))


_WILD = "IN ('unknown', 'any', '')"
_X, _Y = _normal("x"), _normal("y")
_SIMILAR = f"""{_F}, c AS (SELECT function_id AS id, embedding AS v, least(len(params), 3) AS arity, is_pure, file, coalesce(fingerprint.inputs, []) AS i, coalesce(fingerprint.outputs, []) AS o
  FROM f WHERE fingerprint IS NOT NULL AND len(embedding) > 0),
s AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS similarity, a.i AS ia, b.i AS ib, a.o AS oa, b.o AS ob FROM c a JOIN c b ON a.arity = b.arity AND a.is_pure = b.is_pure AND a.id < b.id
  WHERE len(a.v) = len(b.v) AND coalesce(nullif(list_cosine_similarity(a.v, b.v), 'NaN'::DOUBLE), 0) >= 0.70),
p AS (SELECT a, b, similarity FROM s WHERE (len(oa) = 0 OR len(ob) = 0 OR EXISTS (SELECT 1 FROM unnest(oa) AS t(x), unnest(ob) AS u(y) WHERE {_X} {_WILD} OR {_Y} {_WILD} OR {_X} = {_Y}))
  AND NOT EXISTS (SELECT 1 FROM generate_series(1, least(len(ia), len(ib))) AS g(k), LATERAL (SELECT ia[g.k] AS x, ib[g.k] AS y) WHERE NOT ({_X} {_WILD} OR {_Y} {_WILD} OR {_X} = {_Y})))"""


@query(f"WITH {_SIMILAR} SELECT a, b, round(similarity, 6) AS similarity FROM p")
def jn_similar_functions(spark, sf):
    rows = similarity.clusterable(functions(spark, sf))
    return similarity.similar_pairs(rows, DEFAULTS.edge_floor).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(
    f"WITH {_SIMILAR}, d AS (SELECT a AS id, b AS match, similarity FROM p UNION ALL SELECT b, a, similarity FROM p) "
    "SELECT id, match, round(similarity, 6) AS similarity, CASE WHEN similarity >= 0.8 THEN 'near' ELSE 'novel' END AS state FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(similarity, 9) DESC, match) = 1"
)
def jn_best_match(spark, sf):
    rows = similarity.clusterable(functions(spark, sf))
    best = similarity.best_match(similarity.similar_pairs(rows, DEFAULTS.edge_floor))
    state = F.when(F.col("similarity") >= DEFAULTS.match_floor, "near").otherwise("novel")
    return best.select("id", "match", F.round("similarity", 6).alias("similarity"), state.alias("state"))


@query(
    "WITH RECURSIVE e AS (SELECT DISTINCT a, b FROM labelled_pair WHERE a <> b), l AS (SELECT a AS s, b AS t FROM e UNION SELECT b, a FROM e), "
    "r AS (SELECT s AS v, s AS w FROM l UNION SELECT r.v, l.t FROM r JOIN l ON r.w = l.s) SELECT v AS id, min(w) AS component FROM r GROUP BY v"
)
def gc_components(spark, sf):
    return clustering.components(table(spark, sf, "labelled_pair").where("a <> b").select("a", "b"))


@query()
def gc_candidates(spark, sf):
    return clustering.candidates(similarity.clusterable(functions(spark, sf)))


@query()
def gc_candidates_of_vectors(spark, sf):
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("vector"),
        F.col("label").cast("string").alias("block"),
        F.array().cast("array<string>").alias("inputs"),
        F.array().cast("array<string>").alias("outputs"),
        F.concat_ws("/", F.col("label").cast("string"), F.lit("f")).alias("file"),
    )
    return clustering.candidates(rows, Params(edge_floor=0.33, merge_threshold=0.28), limit=False)


@query(
    f"""WITH {_F}, v AS (SELECT function_id, embedding FROM f WHERE embed_version = 'intent-v3' AND len(embedding) = 96 AND list_sum([abs(x) for x in embedding]) > 0),
m AS (SELECT DISTINCT cluster_id, unnest(function_ids) AS function_id FROM clone_cluster), h AS (SELECT cluster_id, function_id, embedding FROM m JOIN v USING (function_id)),
p AS (SELECT a.cluster_id, avg(list_cosine_similarity(a.embedding, b.embedding)) AS c FROM h a JOIN h b ON a.cluster_id = b.cluster_id AND a.function_id < b.function_id GROUP BY 1)
SELECT h.cluster_id, count(*) AS members, round(coalesce(any_value(p.c), 0), 6) AS cohesion FROM h LEFT JOIN p USING (cluster_id) GROUP BY h.cluster_id"""
)
def gc_cohesion(spark, sf):
    rows = functions(spark, sf).where((F.col("embed_version") == DEFAULTS.embed_version) & (F.size("embedding") == DEFAULTS.dimensions) & F.exists("embedding", lambda x: x != 0))
    out = clustering.cohesion(table(spark, sf, "clone_cluster"), rows.select(F.col("function_id").alias("id"), F.col("embedding").alias("vector")))
    return out.select("cluster_id", "members", F.round("cohesion", 6).alias("cohesion"))


# Joins with caches and members

_CACHE = f"k AS (SELECT DISTINCT coalesce(lower(body_hash), {_hash('body')}) AS body_hash FROM cache_record)"


@query(f"WITH {_F}, {_CACHE} SELECT repo_id, count(*) FILTER (WHERE body_hash IN (SELECT body_hash FROM k)) AS hits, count(*) FILTER (WHERE body_hash NOT IN (SELECT body_hash FROM k)) AS misses FROM f GROUP BY repo_id")
def jn_cache_lookup(spark, sf):
    cache = tables.record_functions(table(spark, sf, "cache_record"))
    rows = members.cache_lookup(functions(spark, sf), cache)
    return rows.groupBy("repo_id").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


@query(
    f"WITH {_F}, d AS (SELECT body_hash, fingerprint.domain AS domain, len(embedding) AS dimensions, round(list_sum(embedding), 6) AS total FROM repo_function WHERE fingerprint IS NOT NULL AND len(embedding) > 0 "
    "QUALIFY row_number() OVER (PARTITION BY body_hash ORDER BY updated_at DESC, function_id DESC) = 1) SELECT function_id, domain, dimensions, total FROM f LEFT JOIN d USING (body_hash)"
)
def jn_attach(spark, sf):
    derived = members.derivations(table(spark, sf, "repo_function"))
    rows = members.attach(functions(spark, sf), derived)
    return rows.select("function_id", F.col("fingerprint.domain").alias("domain"), F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dimensions"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


_EXPLODED = "x AS (SELECT cluster_id, canonical_id, unnest(function_ids) AS function_id, generate_subscripts(function_ids, 1) - 1 AS position FROM clone_cluster)"


@query(
    f"WITH {_F}, {_EXPLODED} SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY (function_id <> canonical_id)::INT, position) AS place, function_id, name, file, loc FROM x JOIN f USING (function_id)"
)
def jn_cluster_members(spark, sf):
    rows = members.member_rows(table(spark, sf, "clone_cluster"), functions(spark, sf))
    return rows.withColumn("place", F.col("place").cast("bigint"))


@query(f"WITH {_F}, {_EXPLODED} SELECT cluster_id, sum(CASE WHEN function_id <> canonical_id THEN coalesce(loc, 0) ELSE 0 END)::BIGINT AS lines_removable FROM x LEFT JOIN f USING (function_id) GROUP BY 1")
def ag_removable_lines(spark, sf):
    return members.removable_lines(table(spark, sf, "clone_cluster"), functions(spark, sf))


@query(
    f"WITH {_F}, {_EXPLODED}, h AS (SELECT function_id, {_module('file')} AS module FROM f), m AS (SELECT DISTINCT cluster_id, function_id FROM x), "
    "k AS (SELECT DISTINCT cluster_id, module FROM m JOIN h USING (function_id)), s AS (SELECT function_id, list_sort(list_distinct(list(module))) AS modules FROM m JOIN k USING (cluster_id) GROUP BY 1) "
    "SELECT function_id, array_to_string(coalesce(modules, [module]), ' ') AS modules FROM h LEFT JOIN s USING (function_id)"
)
def jn_used_by(spark, sf):
    rows = members.used_by(table(spark, sf, "clone_cluster"), functions(spark, sf))
    return rows.select("function_id", F.array_join("modules", " ").alias("modules"))


@query(
    f"WITH {_F}, {_EXPLODED}, h AS (SELECT function_id, {_module('file')} AS module FROM f) SELECT x.cluster_id, count(*) FILTER (WHERE h.module <> c.module) AS elsewhere "
    "FROM x JOIN h ON h.function_id = x.function_id JOIN h c ON c.function_id = x.canonical_id WHERE x.function_id <> x.canonical_id GROUP BY 1"
)
def jn_canonical_modules(spark, sf):
    return members.canonical_modules(table(spark, sf, "clone_cluster"), functions(spark, sf))


@query(f"WITH {_F} SELECT p.a, p.b, lower(trim(p.label)) AS label, x.fingerprint.domain AS domain_a, y.fingerprint.domain AS domain_b, p.labelled_at FROM labelled_pair p JOIN f x ON x.function_id = p.a JOIN f y ON y.function_id = p.b")
def jn_labelled(spark, sf):
    rows = members.labelled(table(spark, sf, "labelled_pair"), functions(spark, sf))
    return rows.select("a", "b", F.lower(F.trim("label")).alias("label"), "domain_a", "domain_b", "labelled_at")


@query(f"WITH {_F} SELECT function_id FROM f WHERE EXISTS (SELECT 1 FROM cache_record r WHERE r.repo_id = f.repo_id AND r.start_line <= f.end_line AND f.start_line <= r.end_line)")
def jn_overlapping(spark, sf):
    ranges = table(spark, sf, "cache_record").select("repo_id", F.col("start_line").alias("low"), F.col("end_line").alias("high"))
    return members.overlapping(functions(spark, sf), ranges, ["repo_id"]).select("function_id")


# Aggregates


REPO_STATS = f"""WITH {_F}, {_EXPLODED}, h AS (SELECT function_id, loc, {_module('file')} AS module FROM f), b AS (SELECT repo_id, count(*) AS functions, count(DISTINCT file) AS files, count(DISTINCT {_module('file')}) AS modules FROM f GROUP BY 1),
c AS (SELECT repo_id, count(*) FILTER (WHERE confidence >= 0.75) AS dup, count(*) FILTER (WHERE confidence >= 0.75 AND disagreement_risk = 'semantic') AS con, count(*) FILTER (WHERE NOT confidence >= 0.75) AS near FROM clone_cluster GROUP BY 1),
m AS (SELECT k.repo_id, sum(h.loc)::BIGINT AS lines, count(*) AS calls, count(*) FILTER (WHERE q.module IS NOT NULL AND q.module <> h.module) AS re FROM x JOIN clone_cluster k USING (cluster_id) JOIN h ON h.function_id = x.function_id
  LEFT JOIN h q ON q.function_id = x.canonical_id WHERE k.confidence >= 0.75 AND x.function_id <> x.canonical_id GROUP BY 1),
u AS (SELECT repo_id, count(*) AS reusable FROM f WHERE is_pure AND is_exported AND function_id NOT IN (SELECT unnest(function_ids) FROM clone_cluster WHERE confidence >= 0.75) GROUP BY 1),
a AS (SELECT repo_id, functions, files, modules, coalesce(dup, 0) AS duplicate_clusters, coalesce(con, 0) AS conflicts, coalesce(near, 0) AS near_duplicates, coalesce(lines, 0) AS lines_removable, coalesce(calls, 0) AS call_sites, coalesce(re, 0) AS reinvented, coalesce(reusable, 0) AS reusable
  FROM b LEFT JOIN c USING (repo_id) LEFT JOIN m USING (repo_id) LEFT JOIN u USING (repo_id)), w AS (SELECT *, 6 * conflicts + 2 * (duplicate_clusters - conflicts) + near_duplicates AS units FROM a)
SELECT * EXCLUDE (units), CASE WHEN units = 0 THEN 100 ELSE floor(100 * (1 - least(1.0::DOUBLE, (units::DOUBLE / greatest(functions, 50)) / 0.27::DOUBLE)) + 0.5) END::INTEGER AS health_score FROM w"""


@query(REPO_STATS)
def ag_repo_stats(spark, sf):
    return stats.repo_stats(functions(spark, sf), table(spark, sf, "clone_cluster"))


@query(
    f"SELECT repo_id, count(*) AS repos, sum(functions)::BIGINT AS functions, sum(duplicate_clusters)::BIGINT AS duplicate_clusters, sum(near_duplicates)::BIGINT AS near_duplicates, sum(conflicts)::BIGINT AS conflicts, "
    f"sum(lines_removable)::BIGINT AS lines_removable FROM ({REPO_STATS}) GROUP BY ROLLUP (repo_id)"
)
def ag_portfolio(spark, sf):
    out = stats.portfolio(stats.repo_stats(functions(spark, sf), table(spark, sf, "clone_cluster")))
    return out.select("repo_id", "repos", "functions", "duplicate_clusters", "near_duplicates", "conflicts", "lines_removable")


_JUDGED = "j AS (SELECT lower(trim(label)) = 'clone' AS is_clone, cosine FROM labelled_pair WHERE label IS NOT NULL AND cosine IS NOT NULL)"
_SWEEP = (
    f"{_JUDGED}, t AS (SELECT k, count(*) FILTER (WHERE is_clone AND floor(cosine * 100 + 1e-9) >= k) AS tp, count(*) FILTER (WHERE NOT is_clone AND floor(cosine * 100 + 1e-9) >= k) AS fp, "
    "count(*) FILTER (WHERE is_clone AND floor(cosine * 100 + 1e-9) < k) AS fn, count(*) FILTER (WHERE NOT is_clone AND floor(cosine * 100 + 1e-9) < k) AS tn FROM generate_series(60, 95) AS g(k), j GROUP BY k)"
)


def _judged(spark, sf):
    rows = table(spark, sf, "labelled_pair").where("label is not null and cosine is not null")
    return rows.select((F.lower(F.trim("label")) == "clone").alias("is_clone"), "cosine")


@query(f"WITH {_SWEEP} SELECT k::DOUBLE / 100 AS threshold, tp, fp, fn, tn, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1 FROM t")
def ag_sweep(spark, sf):
    out = stats.sweep(_judged(spark, sf))
    return out.select("threshold", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {_SWEEP} SELECT k::DOUBLE / 100 AS threshold, tp, fp FROM t ORDER BY 2.0::DOUBLE * tp / (2 * tp + fp + fn) DESC, k LIMIT 1")
def ag_best_threshold(spark, sf):
    return stats.best_threshold(stats.sweep(_judged(spark, sf))).select("threshold", "tp", "fp")


@query(
    f"WITH {_JUDGED}, r AS (SELECT *, row_number() OVER (PARTITION BY is_clone ORDER BY cosine) - 1 AS k, count(*) OVER (PARTITION BY is_clone) AS n FROM j) "
    "SELECT is_clone, count(*) AS n, min(cosine) AS least, max(cosine) FILTER (WHERE k = floor(n / 2)) AS median, round(avg(cosine), 6) AS mean, max(cosine) AS largest FROM r GROUP BY is_clone"
)
def ag_distribution(spark, sf):
    out = stats.distribution(_judged(spark, sf), "is_clone", "cosine")
    return out.select("is_clone", "n", "least", "median", F.round("mean", 6).alias("mean"), "largest")


@query(f"WITH {_F} SELECT repo_id, count(*) AS functions, count(*) FILTER (WHERE is_pure) AS pure, count(*) FILTER (WHERE is_exported) AS exported, count(*) FILTER (WHERE NOT is_exported) AS internal, count(DISTINCT file) AS files FROM f GROUP BY 1")
def ag_index_report(spark, sf):
    return stats.index_report(functions(spark, sf))


@query("SELECT event_type, count(*) AS calls, round(sum(value), 2) AS total FROM events GROUP BY 1")
def ag_usage(spark, sf):
    return stats.usage(table(spark, sf, "events"), "event_type", "value").select("event_type", "calls", F.round("total", 2).alias("total"))


_CELLS = (
    "c AS (SELECT strftime(ts, '%Y-%m-%d') AS group_id, event_type AS input, user_id AS member, CAST(floor(value / 50) AS BIGINT) AS output, event_id FROM events "
    "QUALIFY row_number() OVER (PARTITION BY group_id, event_type, user_id ORDER BY event_id) = 1)"
)


def _cells(spark, sf):
    rows = table(spark, sf, "events").select(text.day_key(F.col("ts")).alias("group_id"), F.col("event_type").alias("input"), F.col("user_id").alias("member"), F.floor(F.col("value") / 50).alias("output"), "event_id")
    first = rows.groupBy("group_id", "input", "member").agg(F.min_by("output", "event_id").alias("output"))
    return first.select("group_id", "input", "member", F.col("output").cast("string").alias("output"), F.lit("").alias("error"), F.col("output").cast("string").alias("key"), (F.col("member") % 97 == 0).alias("is_canonical"))


@query(f"WITH {_CELLS} SELECT group_id, input, string_agg(member || '=' || output, ' ' ORDER BY member) AS results, count(DISTINCT output) > 1 AS diverged FROM c GROUP BY ALL")
def ag_divergence(spark, sf):
    shown = F.array_join(F.transform("results", lambda r: F.concat_ws("=", r["member"].cast("string"), F.coalesce(r["error"], r["output"]))), " ")
    return stats.divergence(_cells(spark, sf)).select("group_id", "input", shown.alias("results"), "diverged")


@query(
    f"WITH {_CELLS}, k AS (SELECT group_id, input, output::VARCHAR AS key, count(*) AS n, max(CASE WHEN member % 97 = 0 THEN output::VARCHAR END) AS c FROM c GROUP BY ALL), "
    "r AS (SELECT group_id, input, key, n, max(c) OVER (PARTITION BY group_id, input) AS canonical, row_number() OVER (PARTITION BY group_id, input ORDER BY n DESC, key) AS p FROM k) "
    "SELECT group_id, input, coalesce(canonical, CASE WHEN n > 1 THEN key END) AS reference FROM r WHERE p = 1"
)
def ag_reference(spark, sf):
    return stats.reference_keys(_cells(spark, sf))


# Sets


@query(f"WITH {_F} SELECT body_hash, min(function_id) AS function_id, count(*) AS functions FROM f GROUP BY 1")
def so_distinct_bodies(spark, sf):
    return members.distinct_bodies(functions(spark, sf))


@query("SELECT array_to_string(list_sort(list_distinct(function_ids)), '|') AS member_key, count(*) AS clusters FROM clone_cluster GROUP BY 1")
def so_member_sets(spark, sf):
    return ordering.distinct_member_sets(table(spark, sf, "clone_cluster"))


@query(f"WITH {_F} SELECT function_id, array_to_string(list_sort(list_distinct(list_concat(imports, ['./log']))), ' ') AS imports FROM f")
def so_imports(spark, sf):
    return functions(spark, sf).select("function_id", F.array_join(ordering.distinct_imports(F.col("imports"), F.array(F.lit("./log"))), " ").alias("imports"))


@query(
    """WITH x AS (SELECT cluster_id, unnest(list_concat(coalesce(probe_inputs, []), ['{"a": 1}', 'not json', '[ 1,  2 ]', '[1,2]'])) AS t FROM clone_cluster),
p AS (SELECT cluster_id, json(t)::VARCHAR AS j FROM x WHERE json_valid(t) AND json_type(CASE WHEN json_valid(t) THEN t END) = 'ARRAY' GROUP BY ALL) SELECT cluster_id, string_agg(j, ' ' ORDER BY j) AS inputs FROM p GROUP BY 1"""
)
def so_probe_inputs(spark, sf):
    extra = F.array(F.lit('{"a": 1}'), F.lit("not json"), F.lit('[ 1,  2 ]'), F.lit("[1,2]"))
    given = F.concat(F.coalesce("probe_inputs", F.array().cast("array<string>")), extra)
    return table(spark, sf, "clone_cluster").select("cluster_id", F.array_join(F.array_sort(ordering.json_arrays(given)), " ").alias("inputs"))


# Quality


@query(
    f"WITH {_F}, r AS (SELECT function_id, unnest([CASE WHEN loc = end_line - start_line + 1 THEN NULL ELSE 'loc is the span of lines' END, CASE WHEN lower(body_hash) = {_hash('body')} THEN NULL ELSE 'hash is that of the body' END, "
    "CASE WHEN length(signature) > 0 THEN NULL ELSE 'signature is not empty' END]) AS rule FROM f) SELECT function_id, rule FROM r WHERE rule IS NOT NULL"
)
def dq_functions(spark, sf):
    return quality.violations(functions(spark, sf), "function_id", quality.function_rules())


@query(
    "WITH r AS (SELECT cluster_id, unnest([CASE WHEN len(function_ids) = len(list_distinct(function_ids)) THEN NULL ELSE 'members are distinct' END, CASE WHEN len(function_ids) >= 2 THEN NULL ELSE 'two members at least' END, "
    "CASE WHEN list_contains(function_ids, canonical_id) THEN NULL ELSE 'canonical is a member' END, CASE WHEN confidence BETWEEN 0 AND 1 THEN NULL ELSE 'confidence within 0 and 1' END, "
    "CASE WHEN cohesion BETWEEN -1 AND 1 THEN NULL ELSE 'cohesion within -1 and 1' END, CASE WHEN disagreement_risk IN ('none', 'cosmetic', 'semantic') THEN NULL ELSE 'risk is known' END]) AS rule FROM clone_cluster) "
    "SELECT cluster_id, rule FROM r WHERE rule IS NOT NULL"
)
def dq_clusters(spark, sf):
    return quality.violations(table(spark, sf, "clone_cluster"), "cluster_id", quality.cluster_rules())


@query("SELECT DISTINCT cluster_id, function_id FROM (SELECT cluster_id, unnest(function_ids) AS function_id FROM clone_cluster) WHERE function_id NOT IN (SELECT function_id FROM repo_function)")
def dq_missing_members(spark, sf):
    return quality.missing_members(table(spark, sf, "clone_cluster"), functions(spark, sf))


# Diffs and source analysis


def _patches(spark, sf):
    """A patch made of each file's lines: marked by their length as added, removed or kept, with a header each 40 lines."""
    lines = table(spark, sf, "source_file").select("file_id", "body").distinct().select("file_id", F.posexplode(F.split("body", "\n")).alias("n", "line"))
    mark = F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit(" ")), (F.length("line") % 3 + 1).cast("int"))
    head = F.concat(F.lit("@@ -1,9 +"), (F.col("n") * 3 + 10).cast("string"), F.lit(",9 @@"))
    rows = lines.select("file_id", "n", F.when(F.col("n") % 40 == 0, F.concat(head, F.lit("\n"))).otherwise("").alias("head"), F.concat(mark, "line").alias("line"))
    return rows.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat("head", "line").alias("t")))), lambda x: x["t"]), "\n").alias("patch"))


_RANGES = """WITH b AS (SELECT DISTINCT file_id, string_split(body, chr(10)) AS ls FROM source_file), l AS (SELECT file_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS n FROM b),
k AS (SELECT file_id, n, length(line) % 3 AS m, n // 40 AS h, (n // 40) * 120 + 10 AS first FROM l),
a AS (SELECT *, first + coalesce(sum((m <> 1)::INT) OVER (PARTITION BY file_id, h ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos,
  h * 100000 + sum((m <> 0)::INT) OVER (PARTITION BY file_id, h ORDER BY n) AS island FROM k)
SELECT file_id, min(pos)::INTEGER AS low, max(pos)::INTEGER AS high FROM a WHERE m = 0 GROUP BY file_id, island"""


@query(_RANGES)
def sl_added_ranges(spark, sf):
    return diff.added_ranges(_patches(spark, sf), ["file_id"])


@query()
def pf_added_declarations(spark, sf):
    return diff.added_declarations(_patches(spark, sf), ["file_id"])


@query()
def ex_functions(spark, sf):
    return extract.functions_of(table(spark, sf, "source_file").select("file_id", "file", "body").dropDuplicates(["file_id"]))


@query()
def ex_changed_functions(spark, sf):
    files = table(spark, sf, "source_file").select("file_id", "file", "body").dropDuplicates(["file_id"])
    found = extract.functions_of(files).withColumn("function_id", F.concat_ws(":", F.col("file_id").cast("string"), F.col("start_line").cast("string"), F.col("name")))
    return members.overlapping(found, diff.added_ranges(_patches(spark, sf), ["file_id"]), ["file_id"]).select("file_id", "name", "start_line", "end_line")


@query(
    "SELECT record_id, json_extract_string(attrs, '$.name') AS name, json_extract_string(attrs, '$.file') AS file, CAST(json_extract(attrs, '$.isPure') AS BOOLEAN) AS is_pure, "
    f"json_array_length(attrs, '$.params')::INTEGER AS arity, coalesce(lower(body_hash), {_hash('body')}) AS body_hash, coalesce(loc, len(string_split(body, chr(10))))::INTEGER AS loc FROM cache_record"
)
def sc_record_functions(spark, sf):
    return tables.record_functions(table(spark, sf, "cache_record")).select("record_id", "name", "file", "is_pure", F.size("params").alias("arity"), "body_hash", "loc")


@query(f"WITH {_F} SELECT s.repo_id, count(*) AS functions_total FROM repo_snapshot s JOIN f USING (repo_id) WHERE coalesce(s.stats.functions_total, 0) = 0 GROUP BY 1")
def sk_missing_totals(spark, sf):
    return sinks.missing_totals(table(spark, sf, "repo_snapshot"), functions(spark, sf))


# Windows over time


@query("SELECT user_id, time_bucket(INTERVAL 10 MINUTE, ts) AS window_start, count(*) AS requests FROM events GROUP BY ALL HAVING count(*) > 1")
def st_rate_windows(spark, sf):
    return windows.over_limit(table(spark, sf, "events"), "user_id", "ts", "10 minutes", 1)


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def st_first_submissions(spark, sf):
    return windows.first_of(table(spark, sf, "events"), ["user_id", "event_type"], "event_id")
