"""Problem 6: near-duplicate texts by anchor-point covering.

A text is the set of its runs of three tokens. Its fingerprint has one bit a hash function, taken from the smallest
token under that function (keywords and other short tokens take part in one function of eight), so two fingerprints
differ in few bits where the texts share most tokens. The fingerprint is cut into words of 23 bits. The anchors of a
word are the codewords of the binary Golay code, whose covering radius is 3: every word is at home at the one
codeword within 3 bits, and is replicated to every codeword within 3 + 1. Words that differ in one bit must meet,
words that differ in a few mostly do, and there are several words. Per anchor, homes are compared with all comers by
the bits of a sketch and met pairs by further bits; what passes is verified on the full sets.

Texts with the same set are collapsed into one class first. An anchor that is home to too many classes is split into
slices: each home lies in one slice, comers visit all of them.

Defined results
    null signature or body        as an empty one
    fewer than three tokens       no runs: like nothing, not even its equal
    repeated rows                 one identifier counts once, with its latest text
    null identifier               left out
    empty table                   no rows
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import free, salted_lookup, stage, width
from .vector_search import bytes_column, fixed_bytes, runs

TOKEN, RUN, LIKE = "[^a-z0-9_$]+", 3, 0.60
#: Bits, information bits, covering radius and generator of the binary Golay code (fixed values).
BITS, INFO, RADIUS, GENERATOR = 23, 12, 3, 0xC75
#: Bits by which words may differ and still surely meet.
THRESHOLD = 1
#: Words of a fingerprint, and words that form one anchor's name: the same at all sizes, so that no pair is lost by
#: other texts coming in. Comparisons a text grow with the number of texts.
PLAN = (6, 1)
#: Bits of the sketch and how many may differ: where a fifth of the bits differs in expectation, 0.998 pass.
SKETCH, SKETCH_DIFFER = 128, 39
#: Further bits that take no part in the anchors, and how many of sketch and further bits together may differ: again
#: where a fifth differs in expectation, 0.999 pass. Only what passes is joined with its full sets.
FURTHER, ALL_DIFFER = 128, 71
#: Length from which a token takes part in every hash function, and in how many others one of the rest does.
LONG, SHORT_SHARE = 8, 8
#: Homes of an anchor from which it is split.
HOT_HOMES = 4_000
#: Members of a class that one task expands with others.
TASK_MEMBERS = 2_000


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders by byte position, and by remainder the error patterns of weight <= 4, nearest first, and their number."""

    def remainder(word: int) -> int:
        for bit in range(BITS - 1, BITS - INFO - 1, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - (BITS - INFO))
        return word

    by_byte = np.array([[remainder(v << s) if v << s < 1 << BITS else 0 for v in range(256)] for s in (0, 8, 16)], np.int64)
    patterns: list[list[int]] = [[] for _ in range(1 << (BITS - INFO))]
    single = [remainder(1 << b) for b in range(BITS)]
    for weight in range(RADIUS + THRESHOLD + 1):
        for bits in combinations(range(BITS), weight):
            left = error = 0
            for b in bits:
                left ^= single[b]
                error |= 1 << b
            patterns[left].append(error)
    most = max(map(len, patterns))
    table = np.array([p + [-1] * (most - len(p)) for p in patterns], np.int64)
    return by_byte, table, np.array([len(p) for p in patterns])


def near_anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word the codewords (their 12 information bits) within radius + threshold, the home first; -1 pads."""
    by_byte, table, _ = golay()
    left = by_byte[0][words & 255] ^ by_byte[1][words >> 8 & 255] ^ by_byte[2][words >> 16]
    errors = table[left]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> (BITS - INFO)), errors >= 0


def _odd(n: int) -> np.ndarray:
    rng = np.random.default_rng(23)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def fingerprints(tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray, n_bits: int) -> np.ndarray:
    """(texts, n_bits) of 0 and 1. The lowest bit of a token's hash says whether it is long."""
    factors = _odd(2 * n_bits)
    text = np.repeat(np.arange(len(starts)), ends - starts)
    long = (tokens & np.uint64(1)).astype(bool)
    turn = (tokens >> np.uint64(1)) % np.uint64(SHORT_SHARE)
    out = np.zeros((len(starts), n_bits), np.uint8)
    for r in range(SHORT_SHARE):
        take = long | (turn == r)
        # one slot ahead of each text keeps its segment from being empty
        sizes = np.bincount(text[take], minlength=len(starts)) + 1
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        flat = np.zeros(int(sizes.sum()), np.uint64)
        slot = np.ones(len(flat), bool)
        slot[first] = False
        flat[slot] = tokens[take]
        for k in range(r, n_bits, SHORT_SHARE):
            mixed = flat * factors[k]
            mixed ^= mixed >> np.uint64(32)
            mixed *= factors[k]
            mixed[first] = np.uint64(0xFFFFFFFFFFFFFFFF)
            low = np.minimum.reduceat(mixed, first)
            out[:, k] = (low * factors[n_bits + k]) >> np.uint64(63)
    return out


def _describe(n_bits: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                column = part.column("tokens")
                flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                sizes = np.array([len(x) for x in column])
                ends = np.cumsum(sizes)
                starts = ends - sizes
                bits = fingerprints(flat, starts, ends, n_bits + FURTHER)
                marks = np.packbits(bits[:, :n_bits], axis=1)
                further = np.packbits(bits[:, n_bits:], axis=1).view(np.int64)
                mixed = flat * np.uint64(0x9E3779B97F4A7C15)
                if len(flat) >= RUN:
                    three = (mixed[:-2] ^ mixed[:-2] >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + (mixed[1:-1] ^ mixed[1:-1] >> np.uint64(31))
                    three = (three ^ three >> np.uint64(27)) * np.uint64(0x94D049BB133111EB) + (mixed[2:] ^ mixed[2:] >> np.uint64(33))
                    three = (three ^ three >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
                else:
                    three = flat[:0]
                sets, keys = [], []
                for a, b in zip(starts, ends):
                    # 40 bits of each run: two texts with other runs agree on one by chance once in 10**8 pairs
                    own = np.unique(three[a : max(a, b - RUN + 1)] >> np.uint64(24))
                    data = own.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()
                    sets.append(data)
                    keys.append(hashlib.blake2b(data, digest_size=16).digest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("_at"), pa.array(keys, pa.binary()), bytes_column(marks), pa.array(further[:, 0]), pa.array(further[:, 1]), pa.array(sets, pa.binary())],
                    names=["id", "_at", "k", "mark", "f0", "f1", "runs"],
                )

    return run


def _words(bits: np.ndarray, k: int) -> np.ndarray:
    return bits[:, k * BITS : (k + 1) * BITS].astype(np.int64) @ (1 << np.arange(BITS - 1, -1, -1))


def _anchors(n_words: int, fold: int, hot, homes_only: bool):
    def run(batches):
        import pyarrow as pa

        slices = hot.value if hot is not None else {}
        hot_names = np.array(sorted(slices), np.int64)
        hot_slices = np.array([slices[int(x)] for x in hot_names], np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 4000):
                part = batch.slice(start, 4000)
                c = part.column(0).to_numpy()
                marks = fixed_bytes(part, "mark", -(-n_words * BITS // 8))
                bits = np.unpackbits(marks, axis=1)
                sketch = np.ascontiguousarray(marks[:, : SKETCH // 8]).view(np.int64)
                for p in range(0, n_words, fold):
                    name, row, home = np.zeros(len(c), np.int64), np.arange(len(c)), np.ones(len(c), bool)
                    for k in range(p, p + fold):
                        near, there = near_anchors(_words(bits, k)[row])
                        at, nth = np.nonzero(there[:, :1] if homes_only else there)
                        name, row, home = name[at] << INFO | near[at, nth], row[at], home[at] & (nth == 0)
                    name |= p << 40
                    if homes_only:
                        yield pa.RecordBatch.from_arrays([pa.array(name)], names=["anchor"])
                        continue
                    part_of = np.zeros(len(name), np.int64)
                    if len(hot_names):
                        at = np.minimum(np.searchsorted(hot_names, name), len(hot_names) - 1)
                        count = np.where(hot_names[at] == name, hot_slices[at], 1)
                        own = (c[row] * 0x9E3779B1 >> 7) % count
                        name, row, home, own = (np.repeat(x, count) for x in (name, row, home, own))
                        part_of = np.arange(len(name)) - np.repeat(np.cumsum(count) - count, count)
                        home &= own == part_of
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(name), pa.array(part_of.astype(np.int32)), pa.array(home), pa.array(c[row]), pa.array(sketch[row, 0]), pa.array(sketch[row, 1])],
                        names=["anchor", "slice", "home", "c", "s0", "s1"],
                    )

    return run


def _compare(batches):
    import pyarrow as pa

    for whole in runs(batches):
        part_of = whole.column("slice").to_numpy()
        for s in np.unique(part_of) if part_of.any() else (None,):
            table = whole if s is None else whole.filter(pa.array(part_of == s))
            home = np.flatnonzero(table.column("home").to_numpy(zero_copy_only=False))
            if not len(home) or table.num_rows < 2:
                continue
            c = table.column("c").to_numpy()
            s0, s1 = (table.column(x).to_numpy().view(np.uint64) for x in ("s0", "s1"))
            step = max(1, 2_000_000 // table.num_rows)
            for start in range(0, len(home), step):
                rows = home[start : start + step]
                differ = np.bitwise_count(s0[rows, None] ^ s0[None, :]) + np.bitwise_count(s1[rows, None] ^ s1[None, :])
                at, other = np.nonzero(differ <= SKETCH_DIFFER)
                x, y = c[rows[at]], c[other]
                keep = x != y
                if keep.any():
                    x, y = x[keep], y[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(differ[at, other][keep].astype(np.int32))], names=["a", "b", "differ"])


def _verify(like: float):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep, value = [], []
            for n, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = x.as_py(), y.as_py()
                p, q = ({d[i : i + 5] for i in range(0, len(d), 5)} for d in (x, y))
                common = len(p & q)
                share = common / (len(p) + len(q) - common) if common else 0.0
                if share >= like:
                    keep.append(n)
                    value.append(share)
            index = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), pa.array(value, pa.float64())], names=["a", "b", "share"])

    return run


def near_pairs(texts: DataFrame, like: float = LIKE, plan: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """For ``texts`` (id, text, _at): (a, b, share) between classes with a < b, and (id, c), the members of the classes."""
    spark = texts.sparkSession
    n_words, fold = plan or PLAN
    split = F.filter(F.split(F.lower("text"), TOKEN), lambda x: x != "")
    hashed = F.transform(split, lambda x: F.shiftleft(F.shiftright(F.xxhash64(x), 1), 1) + F.when(F.length(x) >= LONG, 1).otherwise(0))
    described = (
        texts.where(F.col("id").isNotNull())
        .select("id", "_at", hashed.alias("tokens"))
        .mapInArrow(_describe(n_words * BITS), f"id {texts.schema['id'].dataType.simpleString()}, _at {texts.schema['_at'].dataType.simpleString()}, k binary, mark binary, f0 long, f1 long, runs binary")
        .where(F.length("runs") > 0)
        .withColumn("row", F.monotonically_increasing_id())
    )
    described = stage(described, "p6-described")
    latest = described.groupBy("id").agg(F.max_by("k", F.struct("_at", "k")).alias("k"))
    points = stage(described.groupBy("k").agg(F.min("row").alias("c"), *[F.first(c).alias(c) for c in ("mark", "f0", "f1")]), "p6-points")
    latest = stage(latest, "p6-latest")
    members = stage(salted_lookup(latest, points.select("k", "c"), "k", F.xxhash64("id")).select("id", "c"), "p6-members")
    free(latest)

    spread = points.select("c", "mark").repartition(width(spark))
    homes = spread.mapInArrow(_anchors(n_words, fold, None, True), "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("_n"))
    # all hot anchors: at most n_words / fold * 4096**fold exist, and at most texts * n_words / HOT_HOMES are hot
    hot = homes.where(F.col("_n") > HOT_HOMES).collect()
    hot = spark.sparkContext.broadcast({r["anchor"]: -(-r["_n"] // HOT_HOMES) for r in hot})
    parts = max(width(spark), points.count() * n_words // 60_000)
    met = (
        spread.mapInArrow(_anchors(n_words, fold, hot, False), "anchor long, slice int, home boolean, c long, s0 long, s1 long")
        .repartition(parts, "anchor", "slice")
        .sortWithinPartitions("anchor")
        .mapInArrow(_compare, "a long, b long, differ int")
        .groupBy("a", "b")
        .agg(F.max("differ").alias("differ"))
    )
    all_met = stage(met, "p6-met")
    more = points.select("c", "f0", "f1")
    ends = all_met.join(more.withColumnsRenamed({"c": "a", "f0": "a0", "f1": "a1"}), "a").join(more.withColumnsRenamed({"c": "b", "f0": "b0", "f1": "b1"}), "b")
    differ = F.col("differ") + F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))) + F.bit_count(F.col("a1").bitwiseXOR(F.col("b1")))
    met = stage(ends.where(differ <= ALL_DIFFER).select("a", "b"), "p6-near")
    free(all_met)
    sets = described.select(F.col("row").alias("c"), "runs")  # one exchange serves both joins
    both = met.join(sets.select(F.col("c").alias("a"), F.col("runs").alias("ra")), "a").join(sets.select(F.col("c").alias("b"), F.col("runs").alias("rb")), "b")
    pairs = both.select("a", "b", "ra", "rb").mapInArrow(_verify(like), "a long, b long, share double")
    return pairs, members


def _texts(functions: DataFrame) -> DataFrame:
    text = F.concat(F.coalesce("signature", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit("")))
    return functions.select(F.col("function_id").alias("id"), text.alias("text"), F.col("updated_at").alias("_at"))


def found(functions: DataFrame, task_members: int = TASK_MEMBERS) -> DataFrame:
    """(``function_a``, ``function_b``): each pair of different functions once, the smaller identifier first.

    The members of a class are dealt into slices of ``task_members``, and a pair of classes is expanded by slices, so
    that no task expands a class with all others of a large one.
    """
    pairs, members = near_pairs(_texts(functions))
    pairs = stage(pairs.select("a", "b"), "p6-pairs")
    sizes = members.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    slices = F.ceil(F.col("n") / task_members).cast("int")
    own = stage(sizes.where("n > 1").select("c", "n", slices.alias("s")), "p6-sizes")
    several = own.where("s > 1").select("c", "s")  # at most members / task_members rows
    dealt = members.join(several, "c", "left").select("id", "c", F.pmod(F.xxhash64("id"), F.coalesce("s", F.lit(1))).cast("int").alias("k"))
    part = F.explode(F.sequence(F.lit(0), F.coalesce("s", F.lit(1)) - 1))

    def met(rows: DataFrame) -> DataFrame:
        """Pairs of members for (a, b), pairs of classes or a class with itself."""
        for end, name in (("a", "x"), ("b", "y")):
            parts = rows.join(several.withColumnRenamed("c", end), end, "left").withColumn("k", part).drop("s")
            rows = parts.join(dealt.select(F.col("id").alias(name), F.col("c").alias(end), "k"), [end, "k"]).drop("k")
        return rows.select("x", "y")

    both = met(pairs).unionByName(met(own.select(F.col("c").alias("a"), F.col("c").alias("b"))).where("x < y"))
    return both.select(F.least("x", "y").alias("function_a"), F.greatest("x", "y").alias("function_b"))


def classes(functions: DataFrame) -> DataFrame:
    """(``function_id``, ``class_id``, ``n_members``, ``n_links``): one row a text with runs.

    A class holds the texts with the same runs and is named by its smallest identifier; ``n_links`` counts the texts
    outside of the class that are near duplicates of its members.
    """
    pairs, members = near_pairs(_texts(functions))
    named = stage(members.groupBy("c").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n_members")), "p6-named")
    ends = stage(pairs.select("a", "b"), "p6-pairs")
    ends = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = ends.join(named.select(F.col("c").alias("b"), "n_members"), "b").groupBy("a").agg(F.sum("n_members").alias("n_links"))
    named = named.join(links.withColumnRenamed("a", "c"), "c", "left").select("c", "class_id", "n_members", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return salted_lookup(members, named, "c", F.xxhash64("id")).select(F.col("id").alias("function_id"), "class_id", "n_members", "n_links")
