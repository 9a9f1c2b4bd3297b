"""Problem 4: generated, minified, third-party and data files among source files.

Two linear support-vector classifiers a kind. The masked one sees hashed character n-grams of the code, without the
leading comments, and hashed components of the path; the open one also sees the hashed words of the leading comments
and the share of the file's runs of five tokens that known third-party files hold. A file is of a kind if either says
so; no rule decides. No labels exist, so seeds are found by what a file says or how it is built: the rules of
:func:`seeds` serve for nothing else. Masking the giveaway comments makes the first classifier learn the code itself,
so that it also finds files without such a comment. Rows without a sign that look like a kind to a machine that wasn't
fitted on them leave the negatives. A fifth of the repositories is held out whole, and each threshold is set on them.

The sample for fitting is bounded (``PER_KIND``, ``NEGATIVES``; its features take some 20 kB a row); every file is
classified, over its whole text.

Defined results
    null or blank text    judged by its path alone
    null path             judged by its text alone; with neither, hand-written
    repeated rows         one identifier counts once, with its latest fetch
    null identifier       left out
    no third-party table  may be None or empty
    empty table           no rows
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import salted_lookup, stage, width

KINDS = ("generated", "minified", "third_party", "data")
#: Features: hashed n-grams of these lengths, hashed path components, hashed words of the leading comments.
#: One more is the share of runs in known files. The masked classifiers see the first ``MASKED``.
GRAMS, GRAM_DIMS, PATH_DIMS, HEAD_DIMS = (3, 4, 5), 1 << 13, 1 << 11, 1 << 10
#: Rows for fitting: of each kind, and of files without a sign of any kind.
PER_KIND, NEGATIVES = 500, 1600
#: Score from which a file without a sign is taken out of the negatives, and the highest threshold.
ALIKE = 0.3
#: How far into the margin a file must lie for the masked view, which has no word of the file about itself to go by.
MARGIN = 0.5
MASKED = GRAM_DIMS + PATH_DIMS
DIMS = MASKED + HEAD_DIMS + 1
#: Share of a file's five-token runs in known files from which it is a seed, and the number of known runs up to which
#: they are shipped to the workers (eight bytes each); more are met in a join.
CONTAINED, SHIPPED_RUNS = 0.5, 5_000_000

# What files say about themselves.
SAYS_GENERATED = re.compile(
    r"auto-?generated|@generated|machine output of|this file was written by|^\W*compiled from \S+ by|code produced by \S+.*do not modify"
    r"|automatisch erzeugt|g[ée]n[ée]r[ée] automatiquement|generado autom[áa]ticamente|generated by \S+.*(do not edit|changes will be lost)|do not edit\W*$",
    re.I | re.M,
)
SAYS_THIRD_PARTY = re.compile(
    r"@licen[sc]e|@preserve|released under the .* licen[sc]e|licensed under|\blicen[sc]e\b.*https?://|https?://\S*.*\blicen[sc]e\b"
    r"|\(c\) .*\b(authors|contributors)\b|^/\*!|\b(local copy|copied from|vendored|taken verbatim|patched copy)\b",
    re.I | re.M,
)
THIRD_PARTY_PARTS = {"vendor", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "node_modules", "bower_components", "external"}
GENERATED_PARTS = {"generated", "__generated__", "autogen", "autogenerated", "gen-src"}
GENERATED_ENDS = re.compile(r"\.(pb|g|gen|generated)\.[cm]?[jt]sx?$", re.I)
MINIFIED_ENDS = re.compile(r"[.\-](min|bundle)\.[cm]?js$", re.I)

_LEAD = re.compile(r"""\s*(?:(["'])use strict\1;?\s*|/\*.*?\*/\s*|//[^\n]*(?:\n\s*|$)|<!--.*?-->\s*)*""", re.S)
_CODE = re.compile(r"\b(?:function|return|if|for|while|switch|class|interface|await|throw|import)\b|=>")
_TOKEN = re.compile(r"[A-Za-z0-9_$]+")
_WORD = re.compile(r"@?[^\W\d_]+|/\*!")


def normal_path(path: str | None) -> str:
    path = (path or "").replace("\\", "/")
    return "/".join(p for p in path.split("/") if p not in ("", "."))


def lead_and_code(text: str | None) -> tuple[str, str]:
    """The leading comments, and the rest."""
    text = (text or "").replace("\r\n", "\n").lstrip("﻿")
    at = _LEAD.match(text).end()
    return text[:at], text[at:]


def marks(path: str, lead: str) -> set[str]:
    """The kinds that the path or the leading comments name outright."""
    parts, out = path.lower().split("/"), set()
    if GENERATED_PARTS & set(parts[:-1]) or GENERATED_ENDS.search(path) or SAYS_GENERATED.search(lead):
        out.add("generated")
    if MINIFIED_ENDS.search(path):
        out.add("minified")
    if THIRD_PARTY_PARTS & set(parts[:-1]) or SAYS_THIRD_PARTY.search(lead):
        out.add("third_party")
    return out


def seeds(path: str, lead: str, code: str, share: float = 0.0) -> set[str]:
    """:func:`marks`, and the kinds that the build of the code or a known file makes plain."""
    out = marks(path, lead)
    if len(code) >= 300:
        blank = sum(map(code.count, " \n\t")) / len(code)
        words = len(_CODE.findall(code))
        if blank < 0.06 and words * 150 > len(code):
            out.add("minified")
        if words * 600 < len(code):
            out.add("data")
    if share >= CONTAINED:
        out.add("third_party")
    return out


def _slot(text: str, dims: int) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=4).digest(), "big") % dims


def features(path: str, code: str, lead: str = "", share: float = 0.0) -> np.ndarray:
    out = np.zeros(DIMS, np.float32)
    data = np.frombuffer(code.encode("utf-8", "replace"), np.uint8).astype(np.uint64)
    for n in GRAMS:
        if len(data) >= n:
            h = np.full(len(data) - n + 1, n, np.uint64)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + data[k : len(data) - n + 1 + k]
            h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            out[:GRAM_DIMS] += np.bincount((h >> np.uint64(40)).astype(np.int64) % GRAM_DIMS, minlength=GRAM_DIMS)
    np.log1p(out, out=out)
    size = np.linalg.norm(out)
    if size:
        out /= size
    parts = path.lower().split("/")
    named = {f"d:{p}" for p in parts[:-1]} | {f"e:{e}" for e in parts[-1].split(".")[1:]} | {f"n:{e}" for e in re.split(r"[-_.]", parts[-1])[1:-1]}
    for p in named:
        out[GRAM_DIMS + _slot(p, PATH_DIMS)] = 0.35
    words = [w.lower() for w in _WORD.findall(lead)]
    said = {" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)}
    for w in said:
        out[MASKED + _slot(w, HEAD_DIMS)] = min(0.3, 2 / len(said) ** 0.5)
    out[-1] = share
    return out


def fit(x: np.ndarray, y: np.ndarray, rows: np.ndarray, dims: int, cost: float = 4.0, passes: int = 15) -> np.ndarray:
    """Weights and bias of the L2-regularised squared-hinge machine on ``rows`` and the first ``dims`` features.

    Dual coordinate descent; classes are balanced.
    """
    w, bias, alpha = np.zeros(dims, np.float32), 0.0, np.zeros(len(x))
    positive = max(1, int((y[rows] > 0).sum()))
    diagonal = np.where(y > 0, positive / max(1, len(rows) - positive), 1.0).clip(0.05) / (2 * cost)
    q = np.einsum("ij,ij->i", x[:, :dims], x[:, :dims]) + 1 + diagonal
    rng = np.random.default_rng(5)
    for _ in range(passes):
        for i in rng.permutation(rows):
            row = x[i, :dims]
            slope = y[i] * (float(row @ w) + bias) - 1 + alpha[i] * diagonal[i]
            new = max(alpha[i] - slope / q[i], 0.0)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w += np.float32(step) * row
                bias += step
                alpha[i] = new
    return np.append(w, np.float32(bias))


class Model:
    """Weights by kind and view with their thresholds, and precision and recall on the held-out repositories.

    ``weights``, ``thresholds`` and ``report`` are those of the masked view, ``opened`` holds the three of the open one.
    """

    def __init__(self, x: np.ndarray, kinds: list[set[str]], held: np.ndarray):
        clean = np.array([not k for k in kinds], bool)
        self.weights: dict[str, np.ndarray] = {}
        self.thresholds: dict[str, float] = {}
        self.report: dict[str, tuple[float, float]] = {}
        self.opened: tuple[dict, dict, dict] = ({}, {}, {})
        fold = np.arange(len(x)) % 2
        suspect = np.zeros(len(x), bool)  # without a sign, but alike to a kind in the eyes of a machine that didn't see them
        of = {kind: np.array([1.0 if kind in k else -1.0 for k in kinds]) for kind in KINDS}
        for _ in range(2):
            strange = np.zeros(len(x), bool)
            for y in of.values():
                use = ((y > 0) | clean) & ~suspect & ~held
                for f in (0, 1):
                    train = np.flatnonzero(use & (fold != f))
                    if (y[train] > 0).any() and (y[train] < 0).any():
                        strange |= (fold == f) & (self._score(x, fit(x, y, train, MASKED)) > ALIKE)
            suspect = clean & strange
        for kind, y in of.items():
            use = ((y > 0) | clean) & ~suspect
            if not (y[use] > 0).any() or not (y[use] < 0).any():
                continue
            train = use & ~held
            if not (y[train] > 0).any() or not (y[train] < 0).any():
                train = use
            for dims, view, share in ((MASKED, (self.weights, self.thresholds, self.report), MARGIN), (DIMS, self.opened, 0.0)):
                view[0][kind] = fit(x, y, np.flatnonzero(train), dims)
                self._settle(kind, view, self._score(x, view[0][kind])[use & held], y[use & held], share)

    @staticmethod
    def _score(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        return x[..., : len(w) - 1] @ w[:-1] + w[-1]

    @staticmethod
    def _settle(kind: str, view: tuple[dict, dict, dict], s: np.ndarray, y: np.ndarray, share: float) -> None:
        """The threshold: ``share`` of the way to the margin from what nearly all held-out negatives stay under, but not under 0. ``s``: the held-out scores."""
        _, thresholds, report = view
        worst = float(np.quantile(s[y < 0], 0.998)) if (y < 0).any() else 0.0
        worst = min(max(0.0, worst), ALIKE)
        thresholds[kind] = worst + share * (1 - worst)
        said = s > thresholds[kind]
        hit = int((said & (y > 0)).sum())
        report[kind] = (hit / max(1, int(said.sum())), hit / max(1, int((y > 0).sum())))

    def kinds_of(self, x: np.ndarray) -> dict[str, set[str]]:
        """By kind the views whose threshold a file passes; a file without any feature has none."""
        out: dict[str, set[str]] = {}
        if x.any():
            for name, (weights, thresholds, _) in (("masked", (self.weights, self.thresholds, None)), ("open", self.opened)):
                for k, w in weights.items():
                    if float(self._score(x, w)) > thresholds[k]:
                        out.setdefault(k, set()).add(name)
        return out


class _TokenHash(dict):
    def __missing__(self, token: str) -> int:
        h = int.from_bytes(hashlib.blake2b(token.encode("utf-8", "replace"), digest_size=8).digest(), "big")
        if len(self) < 500_000:
            self[token] = h
        return h


_HASHED = _TokenHash()


def _runs(code: str) -> np.ndarray:
    """Sorted hashes of the distinct runs of five tokens."""
    h = np.fromiter(map(_HASHED.__getitem__, _TOKEN.findall(code)), np.uint64)
    if len(h) < 5:
        return h[:0]
    out = np.full(len(h) - 4, 5, np.uint64)
    for k in range(5):
        out = (out ^ h[k : len(h) - 4 + k]) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(31)
    return np.unique(out)


def _held(own: np.ndarray, known: np.ndarray) -> int:
    """How many of ``own`` are in the sorted ``known``."""
    if not len(known):
        return 0
    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
    return int((known[at] == own).sum())


def latest(files: DataFrame) -> DataFrame:
    """One row a file identifier."""
    kept = files.where(F.col("file_id").isNotNull()).select("file_id", "repo_id", "file", "body", "fetched_at")
    order = F.struct("fetched_at", "file", "body", "repo_id")
    return kept.groupBy("file_id").agg(F.max_by(F.struct("repo_id", "file", "body"), order).alias("r")).select("file_id", "r.*")


def _run_rows(id_col: str):
    """(id, run as a signed number) of every distinct run."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for key, body in zip(batch.column(0), batch.column(1).to_pylist()):
                own = _runs(lead_and_code(body)[1]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(own), batch.schema.field(0).type), pa.array(own)], names=[id_col, "run"])

    return run


def _described(known):
    """Adds the kinds of which a file is a seed; with ``known`` also the share of its runs in known files."""

    def run(batches):
        import pyarrow as pa

        copied = known.value if known is not None else None
        for batch in batches:
            names, shares = [], []
            given = batch.column("share").to_pylist()
            for file, body, share in zip(batch.column("file").to_pylist(), batch.column("body").to_pylist(), given):
                lead, code = lead_and_code(body)
                if copied is not None:
                    own = _runs(code)
                    share = _held(own, copied) / len(own) if len(own) else 0.0
                names.append(sorted(seeds(normal_path(file), lead, code, share)))
                shares.append(share)
            columns = [batch.column(c) for c in ("file_id", "repo_id", "file", "body")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.list_(pa.string())), pa.array(shares, pa.float32())], names=["file_id", "repo_id", "file", "body", "kinds", "share"])

    return run


def describe(files: DataFrame, third_party: DataFrame | None = None, shipped_runs: int = SHIPPED_RUNS) -> DataFrame:
    """``files`` (one row an identifier) with ``kinds``, of which each is a seed, and ``share``, of its runs in known files."""
    spark, id_type = files.sparkSession, files.schema["file_id"].dataType.simpleString()
    files, known = files.select("file_id", "repo_id", "file", "body", F.lit(0.0).cast("float").alias("share")), None
    if third_party is not None:
        runs = third_party.where(F.col("body").isNotNull()).select(F.lit(0).alias("k"), "body").mapInArrow(_run_rows("k"), "k int, run long").select("run").distinct()
        runs = stage(runs, "p4-known")
        if runs.count() <= shipped_runs:
            known = spark.sparkContext.broadcast(np.sort(runs.toPandas()["run"].to_numpy(np.int64).view(np.uint64)))
        else:
            own = stage(files.select("file_id", "body").mapInArrow(_run_rows("file_id"), f"file_id {id_type}, run long"), "p4-runs")
            held = salted_lookup(own, runs.withColumn("known", F.lit(1)), "run", F.xxhash64("file_id"), how="left")
            held = held.groupBy("file_id").agg((F.count("known") / F.count(F.lit(1))).cast("float").alias("share"))
            files = files.drop("share").join(held, "file_id", "left").select("file_id", "repo_id", "file", "body", F.coalesce("share", F.lit(0.0)).cast("float").alias("share"))
    schema = f"file_id {id_type}, repo_id {files.schema['repo_id'].dataType.simpleString()}, file string, body string, kinds array<string>, share float"
    return stage(files.mapInArrow(_described(known), schema), "p4-files")


def _packed(batches):
    """Features as two-byte floats, for the driver."""
    import pyarrow as pa

    for batch in batches:
        rows = []
        for file, body, share in zip(*(batch.column(c).to_pylist() for c in ("file", "body", "share"))):
            lead, code = lead_and_code(body)
            rows.append(features(normal_path(file), code, lead, share or 0.0).astype(np.float16).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("held"), batch.column("kinds"), pa.array(rows, pa.binary())], names=["held", "kinds", "x"])


def learn(files: DataFrame, third_party: DataFrame | None = None) -> Model:
    """Fit the classifiers on a bounded sample of the seeds of ``files`` (one row an identifier, described or not)."""
    files = files if "share" in files.columns else describe(files, third_party)
    first = files.select("file_id", F.coalesce(F.try_element_at("kinds", F.lit(1)), F.lit("")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("first").orderBy(F.xxhash64("file_id"), "file_id"))
    most = F.when(F.col("first") == "", NEGATIVES).otherwise(PER_KIND)
    chosen = first.withColumn("r", rank).where(F.col("r") <= NEGATIVES).where(F.col("r") <= most).select("file_id")
    held = F.pmod(F.xxhash64(F.coalesce("repo_id", F.lit(""))), F.lit(5)) == 0
    sample = files.join(chosen, "file_id").select("file", "body", "share", "kinds", held.alias("held"))
    if third_party is not None:
        none = F.lit(None).cast("string")
        known = third_party.where(F.col("body").isNotNull()).orderBy(F.xxhash64("body")).limit(PER_KIND)
        sample = sample.unionByName(known.select(none.alias("file"), "body", F.lit(1.0).cast("float").alias("share"), F.array(F.lit("third_party")).alias("kinds"), F.lit(False).alias("held")))
    rows = sample.mapInArrow(_packed, "held boolean, kinds array<string>, x binary").toPandas()
    x = np.zeros((len(rows), DIMS), np.float32)
    for k, data in enumerate(rows["x"]):
        x[k] = np.frombuffer(data, np.float16)
    kinds, held = [set(k) for k in rows["kinds"]], rows["held"].to_numpy(bool)
    del rows
    return Model(x, kinds, held)


def classify(files: DataFrame, third_party: DataFrame | None = None, model: Model | None = None) -> DataFrame:
    """(``file_id``, ``kinds``, ``evidence``): every file with what the classifiers find; hand-written ones have no kind.

    ``evidence`` names the views that passed: ``masked`` (without the leading comments) and ``open``.
    """
    spark = files.sparkSession
    files = describe(latest(files), third_party)
    shipped = spark.sparkContext.broadcast(model or learn(files, third_party))
    kind_type = files.schema["file_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        machine = shipped.value
        for batch in batches:
            kinds, evidence = [], []
            for file, body, share in zip(*(batch.column(c).to_pylist() for c in ("file", "body", "share"))):
                lead, code = lead_and_code(body)
                seen = machine.kinds_of(features(normal_path(file), code, lead, share or 0.0))
                kinds.append(sorted(seen))
                evidence.append(sorted(set().union(*seen.values())))
            lists = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("file_id"), pa.array(kinds, lists), pa.array(evidence, lists)], names=["file_id", "kinds", "evidence"])

    spread = files.select("file_id", "file", "body", "share").repartition(width(spark))
    return spread.mapInArrow(run, f"file_id {kind_type}, kinds array<string>, evidence array<string>")


def found(files: DataFrame, third_party: DataFrame | None = None) -> DataFrame:
    """(``file_id``): the files that aren't hand-written source."""
    return classify(files, third_party).where(F.size("kinds") > 0).select("file_id")
