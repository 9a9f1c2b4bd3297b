"""Problem 9: subject areas of documents by latent Dirichlet topic models.

The unit is a paragraph or code block; identifiers are split into their words. The variational E-step runs on all
units in parallel, its expected counts are summed by topic and word as an ordinary aggregation. The fit is incremental:
the units are dealt into blocks, the topics are re-estimated after each block from the latest counts of all blocks, and
passes over all units follow each other until the topics stand still. Topics start from the words of labelled documents
(one topic a subject) and from the corpus (background topics), which settles their order but not their content. What the
labelled documents show of a word holds throughout the fit: a word that is not a subject's has no place in its topic, and
a word that is a subject's own has little in the background; on all other words the topics are free. Then each topic's
top terms are inspected: a topic stands for the subject with which the weight of these terms is associated in the
labelled documents, far more than with any other, or for none. A unit deals with a subject if the proportion of the subject's topics
among its different words makes up enough of them; a passing mention makes up one or two.

Defined results
    null, empty or blank text       no subjects
    labels in varied writing        compared without case and outer white space; unknown subjects are ignored
    documents labelled in conflict  don't take part in the start or the inspection
    repeated rows                   a document and a subject come out once
    no labels                       no topic can be mapped: no rows
    empty table                     no rows
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import free, stage, width

#: Background topics, blocks of units, passes over all units at most, and the change of a topic (as the share of its
#: words' probability that moves in a pass) at which the topics stand still.
BACKGROUND, BLOCKS, PASSES, STILL = 4, 4, 8, 0.05
#: Inner steps of a unit at most, and the change of its proportions at which it is left alone.
INNER, SETTLED = 12, 0.01
#: Share of the units from which a word starts fully in the background; rarer words start there by the square.
COMMON = 0.02
#: Dirichlet parameters of topics in a unit and of words in a topic.
ALPHA, ETA = 0.1, 0.01
#: Words kept: units that hold the word, at least and as a share at most, and the number of words with a place of their
#: own; where there are more, the rest share ``SLOTS`` places by a hash, so that none is dropped.
LEAST_UNITS, MOST_SHARE, WORDS, SLOTS = 4, 0.30, 20_000, 1 << 14
#: Frequency of a word in the documents labelled with a subject as a multiple of that in the others: the word is certainly
#: not the subject's if it is below the first, and its own if it is above the second, each by a standard error at least.
NOT_OWN, FIRM = 2.0, 4.0
#: Share of the occurrences of a subject's own word that the background may hold: passing mentions.
PASSING = 0.05
#: Top terms that are inspected, the share of their weight that is a subject's, and how often it is that of any other
#: subject. A share of all subjects' weight would depend on their number and on how many documents deal with several.
TOP_TERMS, LEAST_OWN, CLEAR = 25, 0.25, 2.0
#: Different words that the proportion of a subject must make up in a unit.
DIFFERENT = 2.6


def words_of_units(documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, words): a row for each paragraph or code block, with its words in order."""
    text = F.regexp_replace("text", r"\r\n?", "\n")
    unit = F.explode(F.split(text, r"\n[\s]*\n"))
    rows = documents.where(F.col(id_col).isNotNull() & F.col("text").isNotNull()).select(id_col, unit.alias("unit"))
    plain = F.lower(F.regexp_replace("unit", r"(?<=[\p{Ll}\d])(?=\p{Lu})", " "))
    words = F.filter(F.split(plain, r"[^\p{L}]+"), lambda w: F.length(w) >= 3)
    return rows.select(id_col, words.alias("words")).where(F.size("words") > 0)


class Vocabulary:
    """Words with a place of their own, whether the rest share hashed places, and words that are too frequent to count."""

    def __init__(self, words: list[str], shared: bool, frequent: list[str]):
        self.words, self.shared, self.frequent = words, shared, frequent

    def __len__(self) -> int:
        return len(self.words) + (SLOTS if self.shared else 0)


def vocabulary(units: DataFrame) -> Vocabulary:
    """The words in a fixed order, the ``WORDS`` most frequent at most; words too frequent are fewer than words a unit / MOST_SHARE."""
    n = units.count()
    counts = units.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    counts = stage(counts.where(F.col("n") >= LEAST_UNITS), "p9-counts")
    most = max(MOST_SHARE * n, LEAST_UNITS)
    kept = [r["w"] for r in counts.where(F.col("n") <= most).orderBy(F.col("n").desc(), "w").limit(WORDS + 1).collect()]
    frequent = [r["w"] for r in counts.where(F.col("n") > most).collect()]
    free(counts)
    return Vocabulary(kept[:WORDS], len(kept) > WORDS, frequent)


def _indexed(units: DataFrame, words: Vocabulary, id_col: str) -> DataFrame:
    shipped = units.sparkSession.sparkContext.broadcast(words)
    kind = units.schema[id_col].dataType.simpleString()

    def run(batches):
        import zlib

        import pyarrow as pa

        known = shipped.value
        index = {w: k for k, w in enumerate(known.words)}
        frequent, first = set(known.frequent), len(known.words)
        for batch in batches:
            keys, names, counts = [], [], []
            for key, unit in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen: dict[int, int] = {}
                for w in unit:
                    k = index.get(w)
                    if k is None and known.shared and w not in frequent:
                        k = first + zlib.crc32(w.encode()) % SLOTS
                    if k is not None:
                        seen[k] = seen.get(k, 0) + 1
                if seen:
                    keys.append(key)
                    names.append(list(seen))
                    counts.append(list(seen.values()))
            lists = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(names, lists), pa.array(counts, lists)], names=[id_col, "w", "n"])

    return units.select(id_col, "words").mapInArrow(run, f"{id_col} {kind}, w array<int>, n array<int>")


def _exp_digamma(x: np.ndarray) -> np.ndarray:
    """exp of the digamma function, by recurrence up to 5 and the asymptotic series there."""
    low = np.zeros_like(x)
    x = x.copy()
    for _ in range(5):
        low += 1.0 / x
        x += 1.0
    square = 1.0 / (x * x)
    return np.exp(np.log(x) - 0.5 / x - square * (1 / 12 - square * (1 / 120 - square / 252)) - low)


def _slices(batches, rows: int = 1500):
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            if not part.num_rows:
                continue
            w, n = (part.column(k).flatten().to_numpy() for k in ("w", "n"))
            sizes = np.diff(part.column("w").offsets.to_numpy())
            yield part, w, n.astype(np.float32), sizes


def expect(words: np.ndarray, sizes: np.ndarray, counts: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Probability of each topic for each word of each unit; ``beta`` is (words, topics).

    Units whose proportions have settled are left alone.
    """
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    of = np.repeat(np.arange(len(sizes)), sizes)
    chance = beta[words]
    theta = np.ones((len(sizes), beta.shape[1]), np.float32)
    live, t_of, t_chance, t_counts, t_first = np.arange(len(sizes)), of, chance, counts, first
    for step in range(INNER):
        now = theta[live]
        norm = np.einsum("tk,tk->t", t_chance, now[t_of]) + np.float32(1e-30)
        gamma = ALPHA + now * np.add.reduceat(t_chance * (t_counts / norm)[:, None], t_first, axis=0)
        new = _exp_digamma(gamma).astype(np.float32)
        theta[live] = new
        if step % 3 == 2 and step < INNER - 1:
            moved = np.abs(new / new.sum(1, keepdims=True) - now / now.sum(1, keepdims=True)).max(1) > SETTLED
            if not moved.any():
                break
            if moved.mean() < 0.8:
                keep = moved[t_of]
                live = live[moved]
                t_chance, t_counts = t_chance[keep], t_counts[keep]
                left = sizes[live]
                t_of = np.repeat(np.arange(len(live)), left)
                t_first = np.concatenate([[0], np.cumsum(left)[:-1]])
    phi = chance * theta[of]
    phi /= phi.sum(1, keepdims=True) + np.float32(1e-30)
    return phi


def _sums(units: DataFrame, beta: np.ndarray) -> np.ndarray:
    """(words, topics): expected counts over the units given."""
    shipped = units.sparkSession.sparkContext.broadcast(beta.astype(np.float32))

    def run(batches):
        import pyarrow as pa

        table = shipped.value
        total = np.zeros(table.shape, np.float64)
        for _, w, n, sizes in _slices(batches):
            order = np.argsort(w, kind="stable")
            first = np.flatnonzero(np.r_[True, w[order][1:] != w[order][:-1]])
            total[w[order[first]]] += np.add.reduceat((expect(w, sizes, n, table) * n[:, None])[order], first, axis=0)
        at, topic = np.nonzero(total > 1e-3)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(topic), pa.array(total[at, topic])], names=["w", "k", "v"])

    rows = units.select("w", "n").mapInArrow(run, "w long, k long, v double").groupBy("w", "k").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(beta.shape)
    out[rows["w"].to_numpy(int), rows["k"].to_numpy(int)] = rows["v"]
    return out


def _normal(counts: np.ndarray) -> np.ndarray:
    return counts / counts.sum(0, keepdims=True)


def association(units: DataFrame, labels: DataFrame, subjects: list[str], n_words: int, id_col: str) -> np.ndarray:
    """(words, subjects): labelled documents that hold the word, of those with a single subject.

    Units of a document aren't independent: in a language with few labelled documents one of them would settle its words.
    """
    clean = F.lower(F.trim(F.regexp_replace("subject", r"^\s+|\s+$", "")))
    known = labels.where(F.col(id_col).isNotNull()).select(id_col, clean.alias("s")).where(F.col("s").isin([s.lower() for s in subjects]))
    single = known.groupBy(id_col).agg(F.collect_set("s").alias("all")).where(F.size("all") == 1).select(id_col, F.col("all")[0].alias("s"))
    words = units.join(single, id_col).select(id_col, "s", F.explode("w").alias("w")).distinct()
    rows = words.groupBy("s", "w").agg(F.count(F.lit(1)).alias("n")).toPandas()
    out = np.zeros((n_words, len(subjects)))
    place = {s.lower(): k for k, s in enumerate(subjects)}
    for s, w, n in zip(rows["s"], rows["w"], rows["n"]):
        out[int(w), place[s]] += n
    return out


def lift(held: np.ndarray) -> np.ndarray:
    """(words, subjects): how far a word is a subject's own, from 0 to 1; rare words count less."""
    by_subject = held / np.maximum(held.sum(0, keepdims=True), 1.0)  # subjects have unequal numbers of labels
    own = by_subject / (by_subject.sum(1, keepdims=True) + 1e-12)
    return own * (held / (held + 1.5))


def evidence(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, subjects) twice: whether a word is certainly not a subject's, and whether it is certainly its own.

    ``held`` is compared with the other subjects' labelled documents; rare words are neither.
    """
    size, others = held.sum(0), held.sum(1, keepdims=True) - held
    size, size_of_others = np.maximum(size, 1.0), np.maximum(size.sum() - size, 1.0)
    not_own = (held + np.sqrt(held + 1)) / size < NOT_OWN * (others - np.sqrt(others)) / size_of_others
    firm = (held - np.sqrt(held)) / size > FIRM * (others + np.sqrt(others + 1)) / size_of_others
    return not_own, firm


class Topics:
    """The fitted topics: words, chances of the words, and the subject that each topic stands for."""

    def __init__(self, words: list[str], beta: np.ndarray, subjects: list[str], stands_for: list[int]):
        self.words, self.beta, self.subjects, self.stands_for = words, beta, subjects, stands_for

    def top_places(self, topic: int, n: int = TOP_TERMS) -> np.ndarray:
        own = self.beta[:, topic] ** 2 / (self.beta.sum(1) + 1e-12)
        return np.argsort(-own)[:n]

    def top_terms(self, topic: int, n: int = TOP_TERMS) -> list[str]:
        return [self.words[k] if k < len(self.words) else f"#{k}" for k in self.top_places(topic, n)]


def fit(units: DataFrame, words: list[str], held: np.ndarray, subjects: list[str]) -> Topics:
    """Topics of the ``units`` (with their ``block``), by incremental passes over all of them."""
    n_words, n_subjects = held.shape
    rng = np.random.default_rng(3)
    corpus = np.zeros(n_words)
    totals = units.select(F.explode(F.arrays_zip("w", "n")).alias("x")).groupBy("x.w").agg(F.sum("x.n").alias("n"), F.count(F.lit(1)).alias("units")).toPandas()
    n_units = max(units.count(), 1)
    common = np.zeros(n_words)
    common[totals["w"].to_numpy(int)] = np.minimum(1.0, totals["units"] / (COMMON * n_units)) ** 2
    corpus[totals["w"].to_numpy(int)] = totals["n"]
    own = lift(held)
    start = np.zeros((n_words, n_subjects + BACKGROUND))
    start[:, :n_subjects] = corpus[:, None] * np.where(own > 0.3, own, 0.0) ** 2 + 1e-3
    rest = corpus * common * (1 - own.max(1, initial=0.0)) + 1e-3
    start[:, n_subjects:] = rest[:, None] * rng.gamma(2.0, 0.5, (n_words, BACKGROUND))
    not_own, firm = evidence(held)
    known = firm.any(1)

    def topics_of(counts: np.ndarray) -> np.ndarray:
        counts = counts + ETA
        counts[:, :n_subjects][not_own] *= 1e-9
        counts[known, n_subjects:] *= np.minimum(1.0, PASSING * corpus[known] / counts[known, n_subjects:].sum(1))[:, None]
        return _normal(counts)

    beta = topics_of(start)
    blocks = [start / BLOCKS for _ in range(BLOCKS)]  # until a block is seen the start stands for it
    for _ in range(PASSES):
        before = beta
        for k in range(BLOCKS):
            blocks[k] = _sums(units.where(F.col("block") == k), beta)
            beta = topics_of(np.sum(blocks, axis=0))
        if not n_words or np.abs(beta - before).sum(0).max() < 2 * STILL:
            break
    topics = Topics(words, beta, subjects, [])
    for k in range(beta.shape[1]):
        terms = topics.top_places(k)
        weight = (beta[terms, k][:, None] * own[terms]).sum(0)
        best = int(weight.argmax())
        clear = weight[best] >= CLEAR * np.delete(weight, best).max(initial=0.0) and weight[best] >= LEAST_OWN * beta[terms, k].sum()
        topics.stands_for.append(best if clear else -1)
    return topics


def assign(units: DataFrame, topics: Topics, id_col: str = "doc_id", different: float = DIFFERENT) -> DataFrame:
    """(id_col, ``subject``): where the subject's proportion of a unit's different words makes up ``different`` of them."""
    shipped = units.sparkSession.sparkContext.broadcast((topics.beta.astype(np.float32), np.array(topics.stands_for), topics.subjects))
    kind = units.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        beta, stands_for, subjects = shipped.value
        of_subject = np.zeros((len(stands_for), len(subjects)), np.float32)
        for k, s in enumerate(stands_for):
            if s >= 0:
                of_subject[k, s] = 1.0
        for part, w, n, sizes in _slices(batches):
            of_words = np.add.reduceat(expect(w, sizes, n, beta) @ of_subject, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
            proportion = of_words / sizes[:, None]
            unit, subject = np.nonzero(proportion * sizes[:, None] >= different)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(unit)), pa.array([subjects[s] for s in subject], pa.string())], names=[id_col, "subject"])

    return units.select(id_col, "w", "n").mapInArrow(run, f"{id_col} {kind}, subject string").distinct()


def prepare(documents: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, Vocabulary]:
    units = stage(words_of_units(documents, id_col), "p9-words")
    words = vocabulary(units)
    indexed = _indexed(units, words, id_col).withColumn("block", F.pmod(F.xxhash64("w", "n", id_col), F.lit(BLOCKS)).cast("int"))
    indexed = stage(indexed.repartition(width(units.sparkSession)), "p9-units")
    free(units)
    return indexed, words


def found(documents: DataFrame, subject_area: DataFrame, subject_label: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(``doc_id``, ``subject``): each subject that a part of the document deals with."""
    units, words = prepare(documents, id_col)
    subjects = sorted(r["subject"] for r in subject_area.where(F.col("subject").isNotNull()).select("subject").distinct().collect())
    held = association(units, subject_label, subjects, len(words), id_col)
    return assign(units, fit(units, words.words, held, subjects), id_col)
