import datetime as dt
import io
import json
import math
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinfold.functions import lexer, text, vectors
from twinfold.operators import clustering, diff, members, ordering, probe, quality, similarity, stats
from twinfold.params import Params
from twinfold.plans import analysis, extract, providers
from twinfold.runtime import salted_lookup
from twinfold.sources import sinks, tables
from twinfold.streaming import windows

# Scalar functions


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).head()[0]


@pytest.mark.parametrize("path,module", [("src/a/b.ts", "src/a"), ("b.ts", "."), ("/b.ts", "."), ("a/", "a"), (None, None)])
def test_module_of(spark, path, module):
    assert one(spark, path, text.module_of) == module


@pytest.mark.parametrize(
    "path,good",
    [("src/a.ts", True), ("a.d.ts", False), ("vendor/a.ts", False), ("src/vendor", False), ("vendor.ts", True), ("tests/a.js", False), ("a.test.tsx", False), ("a.min.js", False), ("x/spec/y.js", False), ("a.py", False), ("src/a.stories.jsx", False)],
)
def test_source_paths(spark, path, good):
    assert one(spark, path, text.is_source_path) is good


def test_hash_knows_every_kind_of_space(spark):
    assert one(spark, "a  \n﻿b ", text.body_hash) == one(spark, "a b", text.body_hash)


@pytest.mark.parametrize("kind,normal", [("String | null", "string"), ("number | undefined | null", "number"), ("Date?", "date"), (" any ", "any")])
def test_normal_type(spark, kind, normal):
    assert one(spark, kind, text.normal_type) == normal


@pytest.mark.parametrize(
    "url,parsed",
    [
        ("https://github.com/o/n.git", ("o", "n", None, None)),
        (" http://www.GitHub.com/o/n/tree/a%2Fb ", ("o", "n", "a/b", None)),
        ("https://github.com/o/n/pull/12", ("o", "n", None, 12)),
        ("https://github.com/o/n/pull/0", ("o", "n", None, None)),
        ("https://github.com/topics/n", None),
        ("https://github.com/o", None),
        ("https://example.org/o/n", None),
        ("ftp://github.com/o/n", None),
        ("no url", None),
        (None, None),
    ],
)
def test_repo_urls(spark, url, parsed):
    got = one(spark, url, text.repo_url)
    assert (tuple(got) if got else None) == parsed


def test_scrub_removes_identifiers_only(spark):
    df = spark.createDataFrame([("runs fooBar  twice", "fooBar"), ("we format it", "format"), ("a.b $x", "$x"), ("t", None)], "t string, n string")
    assert [r[0] for r in df.select(text.scrub(F.col("t"), F.col("n"))).collect()][:2] == ["runs twice", "we format it"]


def test_round_half_up_and_archive_root(spark):
    assert one(spark, 0.125, text.round2, "double") == 0.13 and one(spark, -0.125, text.round2, "double") == -0.12
    assert tuple(one(spark, "n-0123abc/src/a.ts", text.archive_root)) == ("n-0123abc", "0123abc")


def test_skip_reasons(spark):
    rows = [(1, "x", False, "under 3 lines"), (9, "(a) => other(a)", False, "trivial wrapper"), (9, "x", True, "accessor"), (9, "function f(a) { return a + 1; }", False, None)]
    got = spark.createDataFrame(rows, "loc int, body string, acc boolean, want string").select("want", text.skip_reason(F.col("loc"), F.col("body"), F.col("acc")).alias("got"))
    assert all(r.want == r.got for r in got.collect())


def test_cosine_is_never_nan(spark):
    rows = [([1.0, 0.0], [1.0, 1.0], math.sqrt(0.5)), ([], [], 0.0), ([1.0], [1.0, 2.0], 0.0), ([0.0], [1.0], 0.0), (None, [1.0], 0.0)]
    got = spark.createDataFrame(rows, "a array<double>, b array<double>, want double").select("want", vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert all(r.c == pytest.approx(r.want) for r in got)


# Similarity and clusters

SHAPE = "id string, vector array<double>, block string, inputs array<string>, outputs array<string>, file string"


def shapes(spark, rows):
    full = [(i, v, o.get("block", "1:true"), o.get("inputs", []), o.get("outputs", []), o.get("file", "a/x.ts")) for i, v, o in rows]
    return spark.createDataFrame(full, SHAPE)


def angle(a):
    return [math.cos(a), math.sin(a), 0.0]


def groups_of(df):
    return sorted(sorted(r.member_ids) for r in df.collect())


def test_near_vectors_group_and_distant_ones_do_not(spark):
    df = shapes(spark, [("a", angle(0), {}), ("b", angle(0.1), {}), ("c", angle(0.2), {}), ("d", angle(1.5), {}), ("e", [], {})])
    assert groups_of(clustering.candidates(df.where("size(vector) > 0"))) == [["a", "b", "c"]]


def test_average_linkage_tolerates_one_weak_pair(spark):
    df = shapes(spark, [(n, angle(a), {}) for n, a in zip("abcd", (0, 0.35, 0.55, 0.75))])
    assert groups_of(clustering.candidates(df)) == [["a", "b", "c", "d"]]
    chain = shapes(spark, [(n, angle(a), {}) for n, a in zip("abc", (0, 0.6, 1.2))])
    assert all(not {"a", "c"} <= set(g) for g in groups_of(clustering.candidates(chain, Params(merge_threshold=0.8))))


def test_purity_types_and_size_split_groups(spark):
    rows = [("a", angle(0), {"outputs": ["string"]}), ("b", angle(0.01), {"outputs": ["number"]}), ("c", angle(0.02), {"outputs": ["String | null"]}), ("d", angle(0), {"block": "1:false", "outputs": ["string"]})]
    assert groups_of(clustering.candidates(shapes(spark, rows))) == [["a", "c"]]
    many = shapes(spark, [(f"{k:02}", angle(k / 1000), {}) for k in range(10)])
    assert max(map(len, groups_of(clustering.candidates(many)))) <= 8


def test_candidates_across_modules_come_first(spark):
    rows = [(f"p{k}", [1.0, 0.0, 0.0], {"file": "a/x.ts"}) for k in range(2)] + [(f"q{k}", [0.0, 1.0, 0.1 * k], {"file": f"m{k}/x.ts"}) for k in range(2)]
    best = clustering.candidates(shapes(spark, rows), Params(max_candidates=1)).collect()
    assert [sorted(r.member_ids) for r in best] == [["q0", "q1"]] and best[0].module_count == 2


@pytest.mark.parametrize("tile", [5, 2000])
def test_pairs_agree_with_brute_force_for_any_tile(spark, tile):
    rng = np.random.default_rng(1)
    rows = [(f"{k:03}", rng.standard_normal(4).tolist(), {"block": str(k % 2)}) for k in range(60)]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    truth = {(rows[i][0], rows[j][0]) for i in range(60) for j in range(i + 1, 60) if i % 2 == j % 2 and s[i, j] >= 0.5}
    got = {(r.a, r.b) for r in similarity.similar_pairs(shapes(spark, rows), 0.5, tile=tile).collect()}
    assert got == truth
    best = {r.id: r.similarity for r in similarity.best_match(similarity.similar_pairs(shapes(spark, rows), -1.0, tile=tile)).collect()}
    assert best["000"] == pytest.approx(max(s[0, j] for j in range(2, 60, 2)))


def test_a_component_of_any_size_is_linked(spark):
    many = shapes(spark, [(f"{k:04}", angle(0), {}) for k in range(3100)])
    groups = groups_of(clustering.candidates(many, limit=False))
    assert max(map(len, groups)) == 8 and sum(map(len, groups)) >= 3099 and len(set(sum(groups, []))) == sum(map(len, groups))


def test_linkage_by_the_rule():
    """Against the rule itself, all means anew for each merge."""
    rng = np.random.default_rng(6)
    for n in (2, 3, 8, 20, 40):
        for levels in (2, 4, 1000):
            s = np.triu(np.round(rng.random((n, n)) * levels) / levels, 1)
            s = s + s.T
            s[(apart := np.triu(rng.random((n, n)) < 0.1, 1)) | apart.T] = -np.inf
            np.fill_diagonal(s, -np.inf)
            groups = [[i] for i in range(n)]
            while True:
                mean = {(np.mean([s[x, y] for x in g for y in h]).round(9), i, j): 0 for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j and len(g) + len(h) <= 8}
                top, i, j = max(mean, default=(-1, 0, 0))
                if top < 0.45 - 1e-9:
                    break
                groups[i] += groups[j]
                del groups[j]
            assert clustering.linkage(s, 0.45, 8) == [g for g in groups if len(g) > 1]


def test_linkage_takes_the_last_of_tied_pairs():
    s = np.full((4, 4), -np.inf)
    for a, b in ((0, 1), (2, 3)):
        s[a, b] = s[b, a] = 0.9
    assert clustering.linkage(s, 0.75, 8) == [[0, 1], [2, 3]]
    s[0, 2] = s[2, 0] = 0.9
    assert clustering.linkage(s, 0.75, 2) == [[0, 1], [2, 3]]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(f"{k:03}", f"{k + 1:03}") for k in range(40)] + [("x", f"y{k}") for k in range(9)]
    got = {r.id: r.component for r in clustering.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[f"{k:03}"] for k in range(41)} == {"000"} and {got[f"y{k}"] for k in range(9)} == {"x"}


def test_salted_lookup_equals_a_join(spark):
    rows = spark.range(500).select(F.col("id"), (F.col("id") % 3).alias("k"))
    names = spark.createDataFrame([(0, "a"), (1, "b")], "k long, n string")
    got = {tuple(r) for r in salted_lookup(rows, names, "k", F.xxhash64("id"), 10, how="left").select("id", "n").collect()}
    assert got == {(i, {0: "a", 1: "b"}.get(i % 3)) for i in range(500)}


# Statistics

FUNCTION = "function_id string, repo_id string, file string, loc int, is_pure boolean, is_exported boolean"
CLUSTER = "cluster_id string, repo_id string, function_ids array<string>, canonical_id string, confidence double, disagreement_risk string"


def test_repo_stats(spark):
    f = spark.createDataFrame([("a", "r", "m1/a.ts", 10, True, True), ("b", "r", "m2/b.ts", 12, True, True), ("c", "r", "m3/c.ts", 11, True, False), ("d", "r", "m4/d.ts", 5, True, True), ("e", "r", "m4/d.ts", 5, False, True)], FUNCTION)
    c = spark.createDataFrame([("k1", "r", ["a", "b", "c", "gone"], "a", 0.9, "semantic"), ("k2", "r", ["d", "e"], "d", 0.5, "none")], CLUSTER)
    row = stats.repo_stats(f, c).head()
    assert (row.functions, row.files, row.modules, row.lines_removable, row.reinvented, row.reusable, row.call_sites) == (5, 4, 4, 23, 2, 1, 2)
    assert (row.duplicate_clusters, row.conflicts, row.near_duplicates, row.health_score) == (1, 1, 1, 48)
    total = stats.portfolio(stats.repo_stats(f, c)).where("repo_id is null").head()
    assert total.repos == 1 and total.functions == 5


def test_sweep_best_and_distribution(spark):
    pairs = spark.createDataFrame([(True, 0.9), (True, 0.8), (False, 0.85), (False, 0.3), (True, None)], "is_clone boolean, cosine double")
    table = {round(r.threshold, 2): r for r in stats.sweep(pairs).collect()}
    assert len(table) == 36 and (table[0.8].tp, table[0.8].fp, table[0.8].fn, table[0.8].tn) == (2, 1, 0, 1)
    assert table[0.95].precision is None and table[0.95].f1 == 0
    assert stats.best_threshold(stats.sweep(pairs)).head().threshold == 0.6
    row = stats.distribution(pairs.where("is_clone"), "is_clone", "cosine").head()
    assert (row.n, row.least, row.median, row.largest) == (2, 0.8, 0.9, 0.9)


def test_divergence_and_reference(spark):
    rows = [("g", "i", "a", "1", "", "return:1", True), ("g", "i", "b", "2", "", "return:2", False), ("g", "j", "a", None, "E: x", "throw:E", False), ("g", "j", "b", None, "E: y", "throw:E", False)]
    cells = spark.createDataFrame(rows, "group_id string, input string, member string, output string, error string, key string, is_canonical boolean")
    got = {r.input: r for r in stats.divergence(cells).collect()}
    assert got["i"].diverged and not got["j"].diverged and got["i"].results[0].error is None
    assert {r.input: r.reference for r in stats.reference_keys(cells).collect()} == {"i": "return:1", "j": "throw:E"}
    bad = stats.divergence(cells).withColumn("members", F.lit(3)).withColumn("diverged", F.lit(True))
    assert {(r.input, r.rule) for r in quality.table_rules(bad).collect()} >= {("i", "every member has a result"), ("j", "every member has a result")}


# Diffs

PATCH = "k string, patch string"


@pytest.mark.parametrize(
    "patch,want",
    [
        ("@@ -10,2 +10,4 @@\n a\n b\n+x\n+y\n c", [(12, 13)]),
        ("@@ -1,2 +1,3 @@\n+a\n-b\n c\n+d\n@@ -20,1 +30,1 @@ f()\n+z", [(1, 1), (3, 3), (30, 30)]),
        (None, []),
        ("", []),
        ("+x without a header", []),
    ],
)
def test_added_ranges(spark, patch, want):
    got = diff.added_ranges(spark.createDataFrame([("k", patch)], PATCH), ["k"]).collect()
    assert sorted((r.low, r.high) for r in got) == want


def test_changed_ranges_and_declarations(spark):
    rows = [("a.ts", "modified", "@@ -1 +1,2 @@\n+function f() {\n+if (x) {"), ("b.ts", "removed", "@@ -1 +1 @@\n+x"), ("c.md", "added", "@@ -1 +1 @@\n+x")]
    files = spark.createDataFrame(rows, "filename string, status string, patch string")
    assert [tuple(r) for r in diff.changed_ranges(files, []).collect()] == [("a.ts", 1, 2)]
    assert [r.line for r in diff.added_declarations(files, ["filename"]).collect()] == ["function f() {"]


def test_overlap_is_a_semi_join_over_bins(spark):
    f = spark.createDataFrame([("a", "x", 1, 200), ("b", "x", 210, 220), ("c", "y", 5, 5)], "function_id string, file string, start_line int, end_line int")
    r = spark.createDataFrame([("x", 100, 205), ("x", 100, 205), ("y", 6, 9), ("y", 4, 5)], "file string, low int, high int")
    assert {x.function_id for x in members.overlapping(f, r, ["file"]).collect()} == {"a", "c"}


# Source analysis and probing

CODE = """import { a } from './x';
import type { T } from './t';
const LIMIT = 3;
export const pad = (s: string, n = LIMIT): string => {
  const out = s.split('');
  while (out.length < n) out.push('0');
  return out.join('');
};
let counter = 0;
function bump() {
  counter += 1;
  return counter;
}
export function twice(x) {
  const y = bump();
  return y + x / 2 / LIMIT;
}
class K {
  get size() {
    return 1;
  }
  static add(x, y) {
    const z = x + y;
    return z * 2;
  }
  use(v) {
    v.items.push(1);
    return a(v);
  }
}
"""


def test_functions_of_a_file(spark):
    got = {f.name: f for f in lexer.read(CODE).functions}
    assert set(got) == {"pad", "bump", "twice", "size", "add", "use"}
    assert got["pad"].pure and got["add"].pure and not got["bump"].pure and not got["use"].pure
    assert got["twice"].reason == "calls bump, which is not pure"
    rows = {r.name: r for r in extract.functions_of(spark.createDataFrame([(1, "src/x.ts", CODE), (2, "y.ts", None), (3, "z.ts", "const f = (")], "file_id int, file string, body string")).collect()}
    assert set(rows) == {"pad", "bump", "twice", "add", "use"} and rows["pad"].preamble == "const LIMIT = 3;"
    assert (rows["pad"].start_line, rows["pad"].end_line, rows["pad"].params) == (4, 8, ["s", "n"]) and rows["pad"].is_exported


def test_lexer_tells_division_from_expressions():
    assert [t.text for t in lexer.tokenize("a / b / c") if t.kind == "regex"] == []
    assert [t.text for t in lexer.tokenize("x = /a[/]b/g.test(`t${1}`) // c") if t.kind == "regex"] == ["/a[/]b/g"]


def test_probe_runs_members_and_finds_differences(spark):
    ten = "def f(s):\n    return ''.join(c for c in s if c.isdigit())[-10:]"
    whole = "def f(s):\n    return ''.join(c for c in s if c.isdigit())"
    rows = [("g", "a", ten, None, True), ("g", "b", whole, None, True), ("g", "c", "def f(s): return MISSING", None, True), ("g", "d", ten, None, False), ("h", "a", ten, None, True), ("w", "a", "def f(s):\n  while True: pass", None, True), ("w", "b", ten, None, True)]
    inputs = [json.dumps(["+12 1234567890"]), json.dumps(["1234567890"])]
    df = spark.createDataFrame([(*r, inputs) for r in rows], "group_id string, member string, source string, preamble string, is_pure boolean, inputs array<string>")
    got = {(r.group_id, r.input): r for r in probe.tables(df).collect()}
    assert got["g", inputs[0]].diverged and not got["g", inputs[1]].diverged
    assert {x.member for x in got["g", inputs[0]].results} == {"a", "b"}
    assert got["w", inputs[0]].diverged and not any(g == "h" for g, _ in got)
    assert {r.group_id: (r.executed, r.diverged_rows) for r in probe.proven(df).collect()} == {"g": (True, 1), "h": (False, 0), "w": (True, 2)}


# Sources, sinks and order


def test_extractor_cache_takes_both_shapes(spark, tmp_path):
    f = {"name": "f", "file": "a.ts", "signature": "f()", "body": "x\ny", "returnTypeText": "", "startLine": 1, "endLine": 2, "isExported": True, "callsExternal": False, "isPure": True, "params": ["p"], "imports": []}
    (tmp_path / "a.json").write_text(json.dumps([f]))
    (tmp_path / "b.json").write_text(json.dumps({"repo": "o/n", "commit": "c", "functions": [f | {"loc": 7}]}, indent=1))
    got = {r.commit_sha: r for r in tables.extractor_cache(spark, str(tmp_path)).collect()}
    assert got["unknown"].loc == 2 and got["c"].loc == 7 and got["c"].owner == "o" and len(got["c"].body_hash) == 64


def test_archives_are_streamed_and_filtered(spark, tmp_path):
    with tarfile.open(tmp_path / "n.tar.gz", "w:gz") as t:
        for name, data in (("n-0123abc/src/a.ts", b"let a;"), ("n-0123abc/src/big.ts", b"x" * (tables.MAX_FILE + 1)), ("n-0123abc/readme.md", b"x"), ("n-0123abc/other/b.ts", b"y")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    got = {r.file: r for r in tables.archives(spark, str(tmp_path), "/src/").collect()}
    assert set(got) == {"src/a.ts", "src/big.ts"} and got["src/a.ts"].contents == "let a;" and got["src/big.ts"].skipped == "too large" and got["src/a.ts"].commit == "0123abc"


def test_replace_upsert_and_delete(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(x, "id int, v string, repo_id string")
    parts, path = str(tmp_path / "parts"), str(tmp_path / "table")
    sinks.replace_partitions(rows((1, "a", "r"), (2, "b", "s")), parts)
    sinks.replace_partitions(rows((3, "c", "r")), parts)
    assert {r.id for r in spark.read.parquet(parts).collect()} == {2, 3}
    sinks.upsert(rows((1, "a", "r"), (2, "b", "r")), path, ["id"])
    sinks.upsert(rows((2, "B", "r"), (3, "c", "r")), path, ["id"])
    assert {r.id: r.v for r in spark.read.parquet(path).collect()} == {1: "a", 2: "B", 3: "c"}
    sinks.delete(spark, path, rows((1, "", "")).select("id"))
    assert {r.id for r in spark.read.parquet(path).collect()} == {2, 3}


def test_pages_caps_and_refusals(spark):
    df = spark.range(45)
    rows, meta = ordering.page(df, [F.col("id")], 3, 20)
    assert [r.id for r in rows.collect()] == list(range(40, 45)) and meta["total_pages"] == 3
    assert ordering.page(df.limit(0), [F.col("id")])[1]["total_pages"] == 1
    kept, dropped = ordering.capped(df.withColumn("g", F.col("id") % 2), [F.col("id")], 3, ["g"])
    assert kept.count() == 6 and dropped.count() == 39
    with pytest.raises(ValueError):
        ordering.refuse_over(df, 44)


def test_json_arrays_are_canonical(spark):
    df = spark.createDataFrame([(["[1, 2]", "[1,2]", '{"a":1}', "x", None],)], "x array<string>")
    assert df.select(ordering.json_arrays(F.col("x"))).head()[0] == ["[1,2]"]


# Plans


def test_index_guard_and_change(spark):
    other = CODE.replace("bump", "hop").replace("LIMIT", "MOST")
    files = spark.createDataFrame([("r", "src/x.ts", CODE), ("r", "lib/y.ts", other)], "repo_id string, file string, body string")
    provider = providers.Heuristic()
    stored = analysis.index(files, provider).withColumn("updated_at", F.lit(dt.datetime(2025, 1, 1))).cache()
    assert stored.count() == 10 and stored.where("embedding is null").count() == 0
    out = analysis.analyse(stored)
    assert out["summary"].head().candidates >= 1
    clusters = spark.createDataFrame([], "cluster_id string, canonical_id string, function_ids array<string>")
    got = analysis.guard(stored, stored, clusters).collect()
    assert len(got) == 10 and all(r.state == "near" for r in got)
    with pytest.raises(ValueError):
        analysis.guard(stored, stored.withColumn("embed_version", F.lit("old")), clusters)
    patches = spark.createDataFrame([("r", "src/x.ts", "modified", "@@ -1,1 +5,1 @@\n+x")], "repo_id string, filename string, status string, patch string")
    touched = analysis.change(patches, files, stored, clusters, provider).collect()
    assert [r.state for r in touched] == ["near"]
    again = providers.derive(stored, members.derivations(stored), provider)
    assert {r.provenance for r in again.collect()} == {"replay"}
    row = providers.report(stored, again).head()
    assert row.calls == 0 and row.failed == 0


def test_windows_on_a_batch_and_a_stream(spark, tmp_path):
    at = dt.datetime(2025, 1, 1)
    rows = [(k, "u", at + dt.timedelta(minutes=k)) for k in range(12)] + [(99, "v", at)]
    df = spark.createDataFrame(rows, "event_id int, user_id string, ts timestamp")
    want = {("u", at, 10)}
    assert {tuple(r) for r in windows.over_limit(df, "user_id", "ts", "10 minutes", 5).collect()} == want
    assert {tuple(r) for r in windows.first_of(df, ["user_id"], "event_id").collect()} == {("u", 0), ("v", 99)}
    assert windows.latest_state(df, "user_id", "ts", "event_id").where("user_id = 'u'").head().event_id == 11
    source = str(tmp_path / "in")
    df.union(spark.createDataFrame([(1000, "z", at + dt.timedelta(days=1))], df.schema)).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    windows.run_to_table(windows.over_limit(stream, "user_id", "ts", "10 minutes", 5), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want
    windows.run_to_table(windows.first_of(stream, ["user_id"], "event_id", "ts"), str(tmp_path / "out2"), str(tmp_path / "cp2"))
    assert spark.read.parquet(str(tmp_path / "out2")).count() == 3


# Reports, judgements and what they rest on


def test_lines_that_open_functions():
    from twinfold.functions.lexer import opens_function as opens

    assert all(map(opens, ["function f() {", "export default async function* g(a) {", "const f = (x) => x", "let g: T = async (x): P<T> => {", "const h = x => x + 1", "  private run(a: B): C {", "add(a, b) {"]))
    assert not any(map(opens, ["const x = (a + b)", "const f = function (", "if (x) {", "for (;;) {", "call(x);", "return (a) => a", "", "}", "const s = 'function f() {'", "while (go()) {"]))


def test_forwarding_bodies(spark):
    from twinfold.functions import text

    yes = ["(a) => other(a)", "export async function f(a, b) { return this.g.h(a, b); }", "(x) { run(x) }", "async (x) =>  call()"]
    no = ["function f(a) { return a + 1; }", "(a) => { x(); y(); }", "f", "", "(a) => b", "class A { m() { return n(); } }", "function f(a) { if (a) { g(a); } }"]
    df = spark.createDataFrame([(t, True) for t in yes] + [(t, False) for t in no] + [(None, False)], "body string, want boolean")
    assert all(r.want == r.got for r in df.select("want", text.forwards(F.col("body")).alias("got")).collect())


def test_compound_names(spark):
    from twinfold.functions import text

    df = spark.createDataFrame([("normalizePhone", True), ("format_mobile", True), ("ParsePhone", True), ("format", False), ("Format", False), ("URL", False), ("$x", True), ("", False)], "n string, want boolean")
    assert all(r.want == r.got for r in df.select("want", text.is_compound(F.col("n")).alias("got")).collect())


def test_shown_days(spark):
    from twinfold.functions import text

    df = spark.createDataFrame([("2025-03-05T23:59:00Z",), ("soon",), (None,)], "t string")
    assert [r[0] for r in df.select(text.shown_day(F.col("t"))).collect()] == ["05 Mar 2025", "soon", None]


def test_places_without_a_group(spark):
    from twinfold.operators import ordering

    df = spark.range(1000).select("id", F.pmod(F.xxhash64("id"), F.lit(77)).alias("k")).repartition(7)
    got = [r.id for r in ordering.placed(df, F.desc("k"), F.col("id")).orderBy("place").collect()]
    assert got == [r.id for r in df.orderBy(F.desc("k"), "id").collect()]
    assert ordering.placed(df.limit(0), F.col("id")).count() == 0


def test_waits_grow_and_only_passing_failures_are_tried_again():
    from twinfold.plans import judge

    assert [judge.wait_before(k, chance=lambda: 1.0) for k in (0, 1, 9)] == [0.5, 1.0, 20.0]
    assert judge.wait_before(0, chance=lambda: 0.0) == 0.25 and judge.wait_before(3, asked=99) == 20.0
    slept, left = [], [judge.Transient(wait=2), judge.Transient()]

    def call(x):
        if left:
            raise left.pop(0)
        return x

    assert judge.tried(call, 7, sleep=slept.append) == 7 and len(slept) == 2 and slept[0] == 2
    with pytest.raises(ZeroDivisionError):
        judge.tried(lambda: 1 / 0, sleep=slept.append)

    def never():
        raise judge.Transient()

    with pytest.raises(judge.Transient):
        judge.tried(never, sleep=slept.append)
    assert len(slept) == 6


def test_judged_candidates(spark):
    from twinfold.plans import judge

    fns = spark.createDataFrame([(f"f{k}", f"body {k}", (f"d{k}",)) for k in range(12)], "function_id string, body string, fingerprint struct<domain:string>")
    cands = spark.createDataFrame([("one", ["f1"]), ("two", ["f2", "f3", "f4"]), ("no", ["f5", "f6"]), ("bad", ["f7", "f8"]), ("big", [f"f{k}" for k in range(9)]), ("few", ["f9", "f10"])], "candidate_id string, member_ids array<string>")

    def answer(bodies):
        if "body 7" in bodies:
            raise ValueError("no answer")
        same = "body 5" not in bodies
        return {"same_behavior": same, "equivalent": ["fn_1"] if "body 9" in bodies else ["fn_3", "fn_1", "fn_3", "fn_9"], "canonical_id": "fn_2", "confidence": 1.7, "probe_inputs": ["[1]", "{}", "x"]}

    got = {r.candidate_id: r for r in judge.settle(judge.ask(cands, fns, answer), fns).collect()}
    assert {k: r.status for k, r in got.items()} == {"one": "rejected", "two": "kept", "no": "rejected", "bad": "failed", "big": "failed", "few": "rejected"}
    two = got["two"]
    assert two.member_ids == ["f4", "f2"] and two.canonical_id == "f4" and two.domain == "d4" and two.confidence == 1.0 and two.probe_inputs == ["[1]"]
    assert judge.report(judge.settle(judge.ask(cands.limit(0), fns, answer), fns)).head().candidates == 0


def test_gates(spark):
    from twinfold.operators import reports

    rows = spark.createDataFrame([("novel", None, False), ("near-duplicate", "b", False)], "verdict string, match string, executed boolean")
    reports.gate(rows, "none")
    reports.gate(rows, "proven-divergence")
    with pytest.raises(ValueError):
        reports.gate(rows, "duplicate")
    with pytest.raises(ValueError):
        reports.gate(rows, "other")


def test_components_with_a_split_hub(spark):
    from twinfold.operators import clustering

    edges = [("hub", f"s{k}") for k in range(50)] + [("a", "b"), ("b", "c"), ("s3", "t")]
    df = spark.createDataFrame(edges, "a string, b string")
    plain, split = ({r.id: r.component for r in clustering.components(df, hot_rows=n).collect()} for n in (50_000, 4))
    assert plain == split and len(set(plain.values())) == 2


def test_tiled_and_shipped_search_agree(spark):
    import numpy as np

    from twinfold.plans import analysis

    rng = np.random.default_rng(3)
    types = [["number"], ["string"], ["unknown"], []]
    schema = "id string, block string, vector array<double>, inputs array<string>, outputs array<string>"
    rows = lambda p, n: spark.createDataFrame([(f"{p}{k}", f"b{k % 2}", rng.standard_normal(6).tolist(), types[k % 4], types[k // 4 % 4]) for k in range(n)], schema)
    asked, stored = rows("i", 30), rows("s", 90)
    one = {tuple(r) for r in analysis.nearest(asked, stored).collect()}
    two = {tuple(r) for r in analysis.nearest(asked, stored, shipped_rows=5, tile=7).collect()}
    assert {(a, b, round(c, 9)) for a, b, c in one} == {(a, b, round(c, 9)) for a, b, c in two} and len(one) == 30


def test_skipped_files_of_a_tree_come_out(spark, tmp_path):
    from twinfold.sources import tables

    (tmp_path / "a.ts").write_text("let a = 1")
    (tmp_path / "b.ts").write_text("x" * 200)
    got = {r.file.rsplit("/", 1)[1]: (r.contents, r.skipped) for r in tables.source_tree(spark, str(tmp_path), max_file=100).collect()}
    assert got == {"a.ts": ("let a = 1", ""), "b.ts": (None, "too large")}


def test_upserts_keep_the_latest_and_scope_empties(spark, tmp_path):
    from twinfold.sources import sinks

    path = str(tmp_path / "t")
    sinks.upsert(spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("b", 3, 1)], "k string, v int, at int"), path, ["k"], latest="at")
    assert {(r.k, r.v) for r in spark.read.parquet(path).collect()} == {("a", 2), ("b", 3)}
    sinks.delete(spark, path, spark.createDataFrame([("b",)], "k string"))
    assert [r.k for r in spark.read.parquet(path).collect()] == ["a"]
    parts = str(tmp_path / "p")
    rows = spark.createDataFrame([("x", "r1"), ("y", "r2")], "f string, repo_id string")
    sinks.replace_partitions(rows, parts)
    sinks.replace_partitions(rows.limit(0), parts, scope=rows.where("repo_id = 'r1'"))
    assert [r.f for r in spark.read.parquet(parts).collect()] == ["y"]


def test_salted_lookups_agree(spark, monkeypatch):
    from twinfold import runtime

    rows = spark.range(300).select("id", F.when(F.col("id") < 200, 0).otherwise(F.col("id") % 7).alias("k"))
    table = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    want = {tuple(r) for r in rows.join(table, "k", "left").select("id", "v").collect()}
    for shipped in (100_000, 0):
        monkeypatch.setattr(runtime, "HOT_SHIPPED", shipped)
        got = runtime.salted_lookup(rows, table, "k", F.xxhash64("id"), threshold=20, how="left")
        assert {tuple(r) for r in got.select("id", "v").collect()} == want
    staged = runtime.stage(rows, "t")
    runtime.free(staged, None, rows)
    with pytest.raises(Exception):
        spark.read.parquet(staged.inputFiles()[0]).collect()
