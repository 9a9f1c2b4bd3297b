"""Queries of the read path, the reports, the writers and the judgements, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text, vectors
from ..operators import diff, members, ordering, quality, reports, similarity, stats
from ..params import DEFAULTS
from ..runtime import shared_dir
from ..sources import sinks, tables
from ..streaming import windows
from . import analysis, judge
from .queries import _CELLS, _EXPLODED, _F, _RANGES, _WILD, _X, _Y, ORACLE_SQL, REPO_STATS, _cells, _patches, functions, query, table

# The tables hold no results of runs: a cluster counts as run if it has probe inputs, and all its rows as differing if its risk is semantic.
_PROVEN = "coalesce(len(probe_inputs) > 0 AND disagreement_risk = 'semantic', false)"
_LATEST = "SELECT repo_id, owner, name, commit_sha, indexed_at FROM repo_snapshot QUALIFY row_number() OVER (PARTITION BY owner, name ORDER BY indexed_at DESC NULLS LAST, repo_id) = 1"
_LINES = f"n AS (SELECT cluster_id, sum(CASE WHEN function_id <> canonical_id THEN coalesce(loc, 0) ELSE 0 END)::BIGINT AS lines_removable FROM x LEFT JOIN f USING (function_id) GROUP BY 1)"
_SUMMARY = (
    f"{_F}, {_EXPLODED}, {_LINES}, y AS (SELECT repo_id, cluster_id, domain, len(function_ids) AS member_count, confidence, disagreement_risk, {_PROVEN} AS proven, lines_removable, "
    "row_number() OVER (PARTITION BY repo_id ORDER BY confidence DESC NULLS LAST, cohesion DESC NULLS LAST, cluster_id) AS place FROM clone_cluster JOIN n USING (cluster_id))"
)


def _divergence():
    rows = F.transform("probe_inputs", lambda x: F.struct(x.alias("input"), (F.col("disagreement_risk") == "semantic").alias("diverged")))
    return F.struct((F.size("probe_inputs") > 0).alias("executed"), rows.alias("rows"))


def _proven():
    return reports.diverged(_divergence())


# The read path


@query(f"WITH l AS ({_LATEST}) SELECT *, row_number() OVER (ORDER BY indexed_at DESC NULLS LAST, repo_id) AS place FROM l")
def qy_repositories(spark, sf):
    return reports.repositories(table(spark, sf, "repo_snapshot"))


@query(f"WITH {_SUMMARY} SELECT * FROM y")
def qy_cluster_summaries(spark, sf):
    out = reports.cluster_summaries(table(spark, sf, "clone_cluster"), functions(spark, sf), _proven()).drop("behavior_summary")
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("member_count", "place")})


@query(
    f"WITH {_SUMMARY}, z AS (SELECT repo_id, string_agg(concat_ws(':', cluster_id, member_count::VARCHAR, proven::VARCHAR, lines_removable::VARCHAR), ' ' ORDER BY place) AS clusters FROM y GROUP BY 1) "
    "SELECT repo_id, owner, name, commit_sha, indexed_at, stats.functions AS functions, stats.health_score AS health_score, z.clusters FROM repo_snapshot LEFT JOIN z USING (repo_id)"
)
def qy_repository_detail(spark, sf):
    out = reports.repository_detail(table(spark, sf, "repo_snapshot"), table(spark, sf, "clone_cluster"), functions(spark, sf), _proven())
    shown = F.transform("clusters", lambda c: F.concat_ws(":", c["cluster_id"], *[c[x].cast("string") for x in ("member_count", "proven", "lines_removable")]))
    return out.select("repo_id", "owner", "name", "commit_sha", "indexed_at", F.col("stats.functions").alias("functions"), F.col("stats.health_score").alias("health_score"), F.array_join(shown, " ").alias("clusters"))


@query(
    f"WITH {_F}, {_EXPLODED} SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY (function_id <> canonical_id)::INT, position) AS place, function_id, name, file, start_line, end_line, loc, body, is_pure, "
    "function_id = canonical_id AS is_canonical FROM x JOIN f USING (function_id)"
)
def qy_cluster_detail(spark, sf):
    return reports.cluster_detail(table(spark, sf, "clone_cluster"), functions(spark, sf)).withColumn("place", F.col("place").cast("bigint"))


@query(
    f"WITH s AS ({REPO_STATS}), p AS (SELECT repo_id, count(*) FILTER (WHERE {_PROVEN}) AS proven FROM clone_cluster GROUP BY 1) SELECT r.repo_id, coalesce(proven, 0) AS proven, s.health_score, "
    "row_number() OVER (ORDER BY (s.health_score IS NULL)::INT, coalesce(proven, 0) DESC, s.duplicate_clusters DESC NULLS LAST, s.functions DESC NULLS LAST, r.owner || '/' || r.name, r.repo_id) AS place "
    "FROM repo_snapshot r LEFT JOIN s USING (repo_id) LEFT JOIN p USING (repo_id)"
)
def sl_repository_ranking(spark, sf):
    clusters = table(spark, sf, "clone_cluster")
    out = reports.ranked_repositories(stats.repo_stats(functions(spark, sf), clusters), table(spark, sf, "repo_snapshot"), clusters, _proven())
    return out.select("repo_id", "proven", "health_score", "place")


# Reports


_TOTALS = (
    "b AS (SELECT repo_id, count(*) AS functions FROM f GROUP BY 1), k AS (SELECT repo_id, max(stats.functions_total)::BIGINT AS known FROM repo_snapshot GROUP BY 1), "
    "o AS (SELECT repo_id, functions, functions AS functions_analyzed, CASE WHEN known > 0 THEN known ELSE functions END AS functions_total FROM b LEFT JOIN k USING (repo_id))"
)


@query(f"WITH {_F}, {_TOTALS} SELECT * FROM o")
def ag_totals(spark, sf):
    return stats.totals(functions(spark, sf), table(spark, sf, "repo_snapshot"))


@query(
    f"WITH s AS ({REPO_STATS}), p AS (SELECT repo_id, count(*) AS stored, count(*) FILTER (WHERE {_PROVEN}) AS proven FROM clone_cluster GROUP BY 1), r AS (SELECT s.*, coalesce(stored, 0) AS stored, coalesce(proven, 0) AS proven FROM s LEFT JOIN p USING (repo_id)) "
    + "SELECT repo_id, "
    + ", ".join(f"sum({c})::BIGINT AS {c}" for c in ("functions", "duplicate_clusters", "stored", "near_duplicates", "conflicts", "proven", "lines_removable"))
    + ", CASE WHEN grouping(repo_id) = 0 THEN max(health_score) END AS health_score FROM r GROUP BY ROLLUP (repo_id)"
)
def ag_reconciled(spark, sf):
    clusters = table(spark, sf, "clone_cluster")
    return stats.reconciled(stats.repo_stats(functions(spark, sf), clusters), clusters, _proven())


@query(
    f"WITH {_F}, {_EXPLODED}, l AS (SELECT DISTINCT cluster_id, function_id FROM x), o AS (SELECT function_id, cluster_id FROM l JOIN clone_cluster USING (cluster_id) "
    "QUALIFY row_number() OVER (PARTITION BY function_id ORDER BY confidence NULLS FIRST, cohesion NULLS FIRST, cluster_id DESC) = 1) "
    "SELECT o.function_id, o.cluster_id, r.start_line AS low, r.end_line AS high FROM o JOIN f USING (function_id) JOIN cache_record r ON r.repo_id = f.repo_id AND r.start_line <= f.end_line AND f.start_line <= r.end_line "
    "WHERE f.start_line <= f.end_line AND r.start_line <= r.end_line QUALIFY row_number() OVER (PARTITION BY o.function_id ORDER BY r.start_line, r.end_line) = 1"
)
def jn_known_overlaps(spark, sf):
    ranges = table(spark, sf, "cache_record").select("repo_id", F.col("start_line").alias("low"), F.col("end_line").alias("high"))
    return reports.known_overlaps(table(spark, sf, "clone_cluster"), functions(spark, sf), ranges, ["repo_id"])


def _changes(spark, sf):
    """Each repository's fetched files as one change."""
    files = table(spark, sf, "source_file").select("file_id", F.col("repo_id").alias("change_id"), "file").distinct()
    return files.groupBy("file_id").agg(F.max("change_id").alias("change_id"), F.min("file").alias("file"))


@query()
def qy_change_feasibility(spark, sf):
    files, clusters, known = _changes(spark, sf), table(spark, sf, "clone_cluster"), functions(spark, sf)
    patches = _patches(spark, sf).join(files, "file_id")
    ranges = diff.added_ranges(patches, ["change_id"]).withColumnRenamed("change_id", "repo_id")
    hits = reports.known_overlaps(clusters, known, ranges, ["repo_id"]).join(known.select("function_id", F.col("repo_id").alias("change_id")), "function_id")
    tree = known.join(clusters.select(F.explode("function_ids").alias("function_id")).distinct(), "function_id", "left_semi").select("file")
    return reports.feasibility(files, patches, diff.added_declarations(patches, ["change_id"]), hits, tree)


_FINDINGS = """n AS (SELECT strftime(labelled_at, '%Y-%m-%d') AS day, CASE WHEN lower(trim(label)) = 'clone' THEN CASE WHEN cosine >= 0.8 THEN 'duplicate' ELSE 'near-duplicate' END ELSE 'novel' END AS verdict, b AS match, rationale IS NOT NULL AS executed FROM labelled_pair),
s AS (SELECT *, CASE WHEN verdict = 'novel' OR match IS NULL THEN 'novel' WHEN executed THEN 'proven' ELSE 'suspected' END AS state FROM n)"""


def _findings(spark, sf):
    sure = F.when(F.col("cosine") >= 0.8, "duplicate").otherwise("near-duplicate")
    verdict = F.when(F.lower(F.trim("label")) == "clone", sure).otherwise("novel")
    return table(spark, sf, "labelled_pair").select(text.day_key(F.col("labelled_at")).alias("day"), verdict.alias("verdict"), F.col("b").alias("match"), F.col("rationale").isNotNull().alias("executed"))


@query(
    f"WITH {_FINDINGS} SELECT day, count(*) FILTER (WHERE verdict IN ('duplicate', 'near-duplicate')) AS duplicates, count(*) FILTER (WHERE executed) AS executed, count(*) FILTER (WHERE state = 'proven') AS proven, "
    "count(*) FILTER (WHERE state = 'suspected') AS suspected, count(*) FILTER (WHERE state = 'novel') AS novel, count(*) FILTER (WHERE verdict IN ('duplicate', 'near-duplicate')) > 0 AS fails_on_duplicate, count(*) FILTER (WHERE executed) > 0 AS fails_on_proven FROM s GROUP BY 1"
)
def ag_finding_counts(spark, sf):
    return reports.finding_counts(_findings(spark, sf), "day")


@query(f"WITH {_FINDINGS} SELECT day, state, verdict, count(*) AS findings, CASE state WHEN 'proven' THEN 0 WHEN 'suspected' THEN 1 ELSE 2 END AS place FROM s GROUP BY ALL")
def sl_finding_states(spark, sf):
    rows = _findings(spark, sf).withColumn("state", reports.finding_state(F.col("verdict"), F.col("match"), F.col("executed")))
    return rows.groupBy("day", "state", "verdict").agg(F.count(F.lit(1)).alias("findings")).withColumn("place", ordering.by_state()[0])


@query(
    f"SELECT cluster_id, CASE WHEN coalesce(confidence, 0) < 0.8 THEN 'lead' WHEN disagreement_risk = 'semantic' THEN CASE WHEN {_PROVEN} THEN 'conflict' ELSE 'suspected' END WHEN disagreement_risk = 'cosmetic' THEN 'cosmetic' ELSE 'none' END AS verdict, {_PROVEN} AS proven FROM clone_cluster"
)
def fn_verdicts(spark, sf):
    return table(spark, sf, "clone_cluster").select("cluster_id", reports.verdict(F.col("confidence"), F.col("disagreement_risk"), _proven()).alias("verdict"), _proven().alias("proven"))


@query("SELECT repo_id, CASE WHEN stats.health_score >= 80 THEN 'good' WHEN stats.health_score >= 50 THEN 'fair' ELSE 'poor' END AS band, coalesce(stats.functions_analyzed > 0 AND stats.functions_total > 0 AND stats.functions_analyzed < stats.functions_total, false) AS is_truncated FROM repo_snapshot")
def fn_health_bands(spark, sf):
    s = F.col("stats")
    rows = table(spark, sf, "repo_snapshot")
    return rows.select("repo_id", reports.health_band(s["health_score"]).alias("band"), text.is_truncated(s["functions_analyzed"], s["functions_total"]).alias("is_truncated"))


@query(f"WITH {_F} SELECT repo_id, count(*) AS functions FROM f WHERE contains(lower(name), 'get') GROUP BY 1")
def pf_named(spark, sf):
    return functions(spark, sf).where(text.name_contains(F.col("name"), "GET")).groupBy("repo_id").agg(F.count(F.lit(1)).alias("functions"))


@query(f"WITH {_F} SELECT repo_id, count(*) AS functions FROM f WHERE starts_with(file, 'src/') GROUP BY 1")
def pf_scope(spark, sf):
    return functions(spark, sf).where(text.in_scope(F.col("file"), "/src/")).groupBy("repo_id").agg(F.count(F.lit(1)).alias("functions"))


@query(f"WITH {_F} SELECT r.repo_id, coalesce(c.n, 0) AS functions FROM (SELECT DISTINCT repo_id FROM repo_snapshot) r LEFT JOIN (SELECT repo_id, count(*) AS n FROM f GROUP BY 1) c USING (repo_id)")
def sc_counts(spark, sf):
    return members.counts_with_zero(table(spark, sf, "repo_snapshot").select("repo_id").distinct(), functions(spark, sf), "repo_id", "functions")


@query(f"WITH {_F} SELECT s.repo_id FROM repo_snapshot s WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.repo_id = s.repo_id)")
def jn_not_indexed(spark, sf):
    return members.not_indexed(table(spark, sf, "repo_snapshot").select("repo_id"), functions(spark, sf), "repo_id")


@query(f"WITH {_F} SELECT repo_id, count(*) FILTER (WHERE len(embedding) > 0 AND embed_version IS DISTINCT FROM 'intent-v3') AS stale FROM f GROUP BY 1")
def pf_stale_vectors(spark, sf):
    stale = similarity.is_stale(DEFAULTS.embed_version)
    return functions(spark, sf).groupBy("repo_id").agg(F.count_if(stale).alias("stale"))


@query(
    f"WITH {_F}, {_EXPLODED}, p AS (SELECT x.cluster_id, x.position, x.function_id, coalesce(f.body, '') AS body, coalesce(f.fingerprint.domain, 'unknown') AS domain FROM x LEFT JOIN f USING (function_id)) "
    "SELECT cluster_id, string_agg(sha256(body), ' ' ORDER BY position) AS bodies, string_agg(domain, ' ' ORDER BY position) AS domains FROM p GROUP BY 1"
)
def jn_candidate_bodies(spark, sf):
    rows = members.candidate_bodies(table(spark, sf, "clone_cluster").select(F.col("cluster_id").alias("candidate_id"), F.col("function_ids").alias("member_ids")), functions(spark, sf))
    join = lambda f: F.array_join(F.transform("members", f), " ")
    return rows.select(F.col("candidate_id").alias("cluster_id"), join(lambda m: F.sha2(m["body"], 256)).alias("bodies"), join(lambda m: m["domain"]).alias("domains"))


_NAMED = "q AS (SELECT name FROM f WHERE len(embedding) > 0 GROUP BY 1 ORDER BY count(*) DESC, name LIMIT 1)"


@query(
    f"WITH {_F}, {_NAMED}, v AS (SELECT function_id AS id, embedding AS v FROM f WHERE name = (SELECT name FROM q) AND len(embedding) > 0) "
    "SELECT a.id AS a, b.id AS b, round(coalesce(nullif(list_cosine_similarity(a.v, b.v), 'NaN'::DOUBLE), 0), 6) AS similarity FROM v a JOIN v b ON a.id < b.id WHERE len(a.v) = len(b.v)"
)
def gc_diagnosis(spark, sf):
    """The most frequent name's functions, pair by pair."""
    rows = functions(spark, sf)
    name = rows.where(F.size("embedding") > 0).groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").head()
    pairs, _ = reports.diagnose(rows, name["name"] if name else "")
    return pairs.select("a", "b", F.round("similarity", 6).alias("similarity"))


# Quality


@query("WITH p AS (SELECT cluster_id, coalesce(confidence >= 0.75, false) AS proven, coalesce(len(probe_inputs) > 0, false) AS executed, coalesce(len(probe_inputs) > 0 AND disagreement_risk = 'semantic', false) AS ran_apart FROM clone_cluster), "
       "r AS (SELECT cluster_id, unnest([CASE WHEN proven AND NOT executed THEN 'proven was executed' END, CASE WHEN ran_apart AND NOT proven THEN 'executed and diverged is proven' END]) AS rule FROM p) SELECT cluster_id, rule FROM r WHERE rule IS NOT NULL")
def dq_proofs(spark, sf):
    """The rules on clusters that claim to be proven wherever they are confirmed."""
    rows = table(spark, sf, "clone_cluster").withColumns({"proven": F.coalesce(F.col("confidence") >= DEFAULTS.confirm_threshold, F.lit(False)), "divergence": _divergence()})
    return quality.violations(rows, "cluster_id", quality.proof_rules())


@query(
    f"WITH s AS ({REPO_STATS}), {_F}, {_EXPLODED}, {_LINES}, {_TOTALS}, c AS (SELECT repo_id, count(*) AS stored_clusters, count(*) FILTER (WHERE {_PROVEN}) AS stored_proven, sum(lines_removable)::BIGINT AS stored_lines FROM clone_cluster JOIN n USING (cluster_id) GROUP BY 1), "
    "j AS (SELECT s.*, coalesce(stored_clusters, 0) AS stored_clusters, coalesce(stored_proven, 0) AS stored_proven, coalesce(stored_lines, 0) AS stored_lines, functions_analyzed, functions_total FROM s LEFT JOIN c USING (repo_id) JOIN o USING (repo_id)), "
    "r AS (SELECT repo_id, unnest([CASE WHEN duplicate_clusters <> stored_clusters THEN 'clusters are those stored' END, CASE WHEN conflicts < stored_proven THEN 'suspected are at least those proven' END, "
    "CASE WHEN lines_removable <> stored_lines THEN 'removable lines are the sum' END, CASE WHEN health_score NOT BETWEEN 0 AND 100 THEN 'score within 0 and 100' END, CASE WHEN functions_analyzed > functions_total THEN 'analysed are at most all' END]) AS rule FROM j) SELECT repo_id, rule FROM r WHERE rule IS NOT NULL"
)
def dq_totals(spark, sf):
    clusters, known = table(spark, sf, "clone_cluster"), functions(spark, sf)
    stored = clusters.withColumn("proven", _proven()).join(members.removable_lines(clusters, known), "cluster_id").groupBy("repo_id")
    stored = stored.agg(F.count(F.lit(1)).alias("stored_clusters"), F.count_if("proven").alias("stored_proven"), F.sum("lines_removable").alias("stored_lines"))
    rows = stats.repo_stats(known, clusters).join(stored, "repo_id", "left").na.fill(0, ["stored_clusters", "stored_proven", "stored_lines"])
    rows = rows.join(stats.totals(known, table(spark, sf, "repo_snapshot")).drop("functions"), "repo_id")
    return quality.violations(rows, "repo_id", quality.total_rules())


@query(
    f"WITH {_CELLS}, m AS (SELECT group_id, count(DISTINCT member) AS members FROM c GROUP BY 1), t AS (SELECT group_id, input, count(*) AS n FROM c GROUP BY ALL) "
    "SELECT group_id, input, 'every member has a result' AS rule FROM t JOIN m USING (group_id) WHERE n <> members"
)
def dq_results(spark, sf):
    cells = _cells(spark, sf)
    rows = stats.divergence(cells).join(cells.groupBy("group_id").agg(F.countDistinct("member").alias("members")), "group_id")
    return quality.table_rules(rows)


# Judgements


@query(
    f"WITH {_F}, {_EXPLODED}, s AS (SELECT cluster_id AS candidate_id, list_distinct(function_ids) AS d, function_ids, canonical_id, same_behavior, confidence FROM clone_cluster), "
    "t AS (SELECT *, CASE WHEN len(function_ids) < 2 THEN 'rejected' WHEN len(function_ids) > 8 OR canonical_id IS NULL THEN 'failed' WHEN same_behavior AND len(d) >= 2 THEN 'kept' ELSE 'rejected' END AS status FROM s), "
    "u AS (SELECT *, CASE WHEN list_contains(function_ids, canonical_id) THEN canonical_id ELSE function_ids[1] END AS chosen FROM t) "
    "SELECT candidate_id, status, CASE WHEN status = 'kept' THEN array_to_string(list_sort(d), ' ') END AS members, CASE WHEN status = 'kept' THEN chosen END AS canonical_id, "
    "CASE WHEN status = 'kept' THEN coalesce(f.fingerprint.domain, 'unknown') END AS domain, CASE WHEN status = 'kept' THEN least(greatest(confidence, 0), 1) END AS confidence FROM u LEFT JOIN f ON f.function_id = u.chosen"
)
def ud_judgements(spark, sf):
    clusters = table(spark, sf, "clone_cluster")
    settled = judge.settle(judge.replay(clusters.select(F.col("cluster_id").alias("candidate_id"), F.col("function_ids").alias("member_ids")), clusters), functions(spark, sf))
    return settled.select("candidate_id", "status", F.array_join(F.array_sort("member_ids"), " ").alias("members"), "canonical_id", "domain", "confidence")


@query(
    "SELECT a, b, CASE WHEN label IS NULL THEN 0 WHEN lower(trim(label)) <> 'clone' THEN 0 ELSE floor(cosine * 100 + 0.5) / 100 END AS confidence, "
    "CASE WHEN label IS NULL THEN 'near-duplicate' WHEN lower(trim(label)) <> 'clone' THEN 'novel' WHEN cosine >= 0.75 THEN 'duplicate' ELSE 'near-duplicate' END AS verdict, labelled_at FROM labelled_pair"
)
def ud_pair_verdicts(spark, sf):
    status = F.when(F.col("label").isNull(), "failed").when(F.lower(F.trim("label")) != "clone", "rejected").otherwise("kept")
    return table(spark, sf, "labelled_pair").select("a", "b", reports.pair_verdict(status, F.col("cosine")).alias("v"), "labelled_at").select("a", "b", "v.confidence", "v.verdict", "labelled_at")


@query(
    "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id AS id, b.vec_id AS match, list_cosine_similarity(list_reverse(a.v), b.v) AS c FROM e a JOIN e b ON a.label = b.label) "
    "SELECT id, match, round(c, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(c, 9) DESC, match) = 1"
)
def ud_nearest(spark, sf):
    """Of every vector read backwards its nearest of the same label."""
    none = F.array().cast("array<string>")
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("string").alias("block"), none.alias("inputs"), none.alias("outputs"))
    return analysis.nearest(rows.withColumn("vector", F.reverse("vector")), rows).select("id", "match", F.round("similarity", 6).alias("similarity"))


_FITS = (
    f"(len(oa) = 0 OR len(ob) = 0 OR EXISTS (SELECT 1 FROM unnest(oa) AS t(x), unnest(ob) AS u(y) WHERE {_X} {_WILD} OR {_Y} {_WILD} OR {_X} = {_Y})) "
    f"AND NOT EXISTS (SELECT 1 FROM generate_series(1, least(len(ia), len(ib))) AS g(k), LATERAL (SELECT ia[g.k] AS x, ib[g.k] AS y) WHERE NOT ({_X} {_WILD} OR {_Y} {_WILD} OR {_X} = {_Y}))"
)


@query(
    f"WITH {_F}, c AS (SELECT function_id AS id, embedding AS v, least(len(params), 3) AS arity, is_pure, embed_version IS NOT DISTINCT FROM 'intent-v3' AS known, coalesce(fingerprint.inputs, []) AS i, coalesce(fingerprint.outputs, []) AS o FROM f "
    "WHERE fingerprint IS NOT NULL AND len(embedding) > 0), s AS (SELECT a.id, b.id AS match, coalesce(nullif(list_cosine_similarity(a.v, b.v), 'NaN'::DOUBLE), 0) AS c, a.i AS ia, b.i AS ib, a.o AS oa, b.o AS ob FROM c a JOIN c b "
    f"ON NOT a.known AND b.known AND a.arity = b.arity AND a.is_pure = b.is_pure AND len(a.v) = len(b.v)), m AS (SELECT id, match, c FROM s WHERE {_FITS} QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(c, 9) DESC, match) = 1) "
    "SELECT id, match, floor(c * 100 + 0.5) / 100 AS similarity, CASE WHEN c >= 0.8 THEN 'near' ELSE 'novel' END AS state FROM m UNION ALL SELECT id, NULL, NULL, 'novel' FROM c WHERE NOT known AND id NOT IN (SELECT id FROM m)"
)
def ud_guard(spark, sf):
    """Functions whose vector is of another recipe, as if they were new, against those of the current one."""
    rows = functions(spark, sf)
    known = F.col("embed_version").eqNullSafe(F.lit(DEFAULTS.embed_version))
    out = analysis.guard(rows.where(~known), rows.where(known), table(spark, sf, "clone_cluster"), emit_unmatched=True)
    return out.select("id", "match", "similarity", "state")


@query(f"SELECT r.file_id, s.file AS filename, r.low, r.high FROM ({_RANGES}) r JOIN ({ORACLE_SQL['fn_source_paths']}) s ON s.file_id = r.file_id WHERE s.is_source AND r.file_id % 7 <> 0")
def pf_changed_ranges(spark, sf):
    """Every seventh file counts as removed by the change."""
    files = table(spark, sf, "source_file").select("file_id", F.col("file").alias("filename")).distinct()
    status = F.when(F.col("file_id") % 7 == 0, "removed").otherwise("modified")
    return diff.changed_ranges(_patches(spark, sf).join(files, "file_id").withColumn("status", status), ["file_id"]).select("file_id", "filename", "low", "high")


@query(
    "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT vec_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first, "
    "round(list_sum(list_transform(v, lambda x: x * x)) / list_sum(list_transform(v, lambda x: x * x)), 6) AS length FROM e"
)
def fn_unit_vectors(spark, sf):
    unit = table(spark, sf, "embeddings").select("vec_id", vectors.unit(F.col("embedding").cast("array<double>")).alias("u"))
    return unit.select("vec_id", F.round(F.col("u")[0], 6).alias("first"), F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x), 6).alias("length"))


@query("SELECT doc_id, coalesce(strftime(created_at, '%d %b %Y'), 'unknown') AS created, lang AS other FROM documents")
def fn_shown_days(spark, sf):
    """Instants shown as days; what isn't an instant stays as it is."""
    rows = table(spark, sf, "documents")
    return rows.select("doc_id", text.shown_day(F.coalesce(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ssXXX"), F.lit("unknown"))).alias("created"), text.shown_day(F.col("lang")).alias("other"))


@query(f"WITH {_F}, r AS (SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY file, start_line, function_id) AS p FROM f) SELECT repo_id, count(*) FILTER (WHERE p <= 40) AS kept, count(*) FILTER (WHERE p > 40) AS left_out FROM r GROUP BY 1")
def sl_capped(spark, sf):
    """The functions that a cap of 40 a repository keeps, and those it reports as left out."""
    kept, rest = ordering.capped(functions(spark, sf), [F.col("file"), F.col("start_line"), F.col("function_id")], 40, ["repo_id"])
    both = kept.select("repo_id", F.lit(True).alias("k")).unionByName(rest.select("repo_id", F.lit(False).alias("k")))
    return both.groupBy("repo_id").agg(F.count_if("k").alias("kept"), F.count_if(~F.col("k")).alias("left_out"))


# Writers and readers, over tables in the work folder


def _fresh(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


_IN_SCOPE = "right(repo_id, 1) IN ('0', '1', '2', '3', '4', '5', '6', '7')"


@query(f"WITH {_F} SELECT function_id, repo_id, loc FROM f WHERE NOT {_IN_SCOPE} UNION ALL SELECT function_id, repo_id, loc + 1000 FROM f WHERE {_IN_SCOPE} AND loc >= 10")
def sk_replaced(spark, sf):
    """Functions of some repositories replaced by others, or by none."""
    path, rows = _fresh(spark, "replaced"), functions(spark, sf).select("function_id", "repo_id", "loc")
    sinks.replace_partitions(rows, path)
    scoped = rows.where(F.substring("repo_id", -1, 1) < "8")
    sinks.replace_partitions(scoped.where("loc >= 10").withColumn("loc", F.col("loc") + 1000), path, scope=scoped.select("repo_id").distinct())
    return spark.read.schema(rows.schema).parquet(path).select("function_id", "repo_id", "loc")


@query("SELECT cluster_id, CASE WHEN confidence < 0.5 THEN confidence + 2 ELSE confidence END AS confidence FROM clone_cluster WHERE cohesion IS NOT NULL")
def sk_upserted(spark, sf):
    """Clusters written, some updated twice in one delivery of which the later counts, some deleted."""
    path = _fresh(spark, "upserted")
    rows = table(spark, sf, "clone_cluster").select("cluster_id", "confidence", F.lit(0).alias("at"))
    sinks.upsert(rows, path, ["cluster_id"])
    low = rows.where("confidence < 0.5")
    sinks.upsert(low.selectExpr("cluster_id", "confidence + 2 as confidence", "2 as at").unionByName(low.selectExpr("cluster_id", "confidence + 9 as confidence", "1 as at")), path, ["cluster_id"], latest="at")
    sinks.delete(spark, path, table(spark, sf, "clone_cluster").where("cohesion is null").select("cluster_id"))
    return spark.read.parquet(path).select("cluster_id", "confidence")


@query(f"WITH {_F} SELECT repo_id AS owner, name, file, lower(body_hash) AS body_hash, loc, len(params) AS arity FROM f")
def sc_extractor_cache(spark, sf):
    """Functions written as the extractor's cache files, 500 a file at most, and read back."""
    path, rows = _fresh(spark, "caches"), functions(spark, sf)
    back = {v: k for k, v in tables.NAMES.items()}
    one = F.struct(*[F.col(c).alias(back.get(c, c)) for c in ("name", "file", "signature", "body", "start_line", "end_line", "is_exported", "calls_external", "is_pure", "params", "imports")], F.lower("body_hash").alias("bodyHash"), "loc")
    parts = rows.groupBy("repo_id").agg(F.ceil(F.count(F.lit(1)) / 500).cast("int").alias("_parts"))
    packed = rows.join(parts, "repo_id").groupBy("repo_id", F.pmod(F.xxhash64("function_id"), F.col("_parts")).alias("_part")).agg(F.collect_list(one).alias("functions"))
    written = packed.select(F.to_json(F.struct(F.col("repo_id").alias("owner"), F.lit("all").alias("name"), F.lit("c1").alias("commit"), "functions")).alias("value"))
    written.write.option("maxRecordsPerFile", 1).text(path)
    return tables.extractor_cache(spark, path).select("owner", "name", "file", "body_hash", "loc", F.size("params").alias("arity"))


# Streams


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def st_latest_state(spark, sf):
    return windows.latest_state(table(spark, sf, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")
