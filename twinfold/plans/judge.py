"""Judgement of candidate groups by stored judgements, a pluggable judge, and calls that are tried again."""

from __future__ import annotations

import random
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ordering
from ..params import DEFAULTS, Params

# Attempts at a call, and the first and longest wait between them, in seconds.
ATTEMPTS, FIRST_WAIT, LONGEST_WAIT = 5, 0.5, 20.0

ANSWER = "same_behavior boolean, equivalent array<string>, canonical_id string, behavior_summary string, differences string, disagreement_risk string, confidence double, probe_inputs array<string>"


class Transient(Exception):
    """A failure that may pass: too many requests, a timeout, a dropped connection. ``wait``: what the other side asks for, in seconds."""

    def __init__(self, message: str = "", wait: float | None = None):
        super().__init__(message)
        self.wait = wait


def wait_before(attempt: int, asked: float | None = None, chance: Callable[[], float] = random.random) -> float:
    """Seconds to wait: what was asked for, else half of a doubling ceiling and a random part of the other half."""
    if asked is not None:
        return min(asked, LONGEST_WAIT)
    ceiling = min(FIRST_WAIT * 2**attempt, LONGEST_WAIT)
    return ceiling * (1 + chance()) / 2


def tried(call: Callable, *args, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep):
    """The call's result; transient failures are tried again, any other goes through at once."""
    for attempt in range(attempts):
        try:
            return call(*args)
        except Transient as e:
            if attempt == attempts - 1:
                raise
            sleep(wait_before(attempt, e.wait))


def ask(candidates: DataFrame, functions: DataFrame, judge: Callable[[list[str]], dict], params: Params = DEFAULTS) -> DataFrame:
    """(candidate_id, status, answer): one isolated call a candidate (candidate_id, member_ids), by bodies under opaque labels.

    The judge gets the bodies in order and answers with labels ``fn_1``...; ``equivalent`` and ``canonical_id`` come
    back as identifiers. A call that fails makes its row ``failed`` and no other. Candidates are at most
    ``max_cluster_size`` members, so a task never holds more than that; larger ones fail, smaller than two are rejected.
    """
    listed = candidates.select("candidate_id", F.size("member_ids").alias("n"), F.posexplode("member_ids").alias("at", "function_id"))
    bodies = listed.join(functions.select("function_id", "body"), "function_id", "left").groupBy("candidate_id")
    small = F.array_sort(F.collect_list(F.struct("at", "function_id", F.coalesce("body", F.lit("")).alias("body"))))
    rows = bodies.agg(F.first("n").alias("n"), small.alias("members"))

    def run(batches):
        for batch in batches:
            out = []
            for key, n, members in zip(batch["candidate_id"], batch["n"], batch["members"]):
                if n < 2 or n > params.max_cluster_size:
                    out.append((key, "rejected" if n < 2 else "failed", None))
                    continue
                ids = {f"fn_{k + 1}": m["function_id"] for k, m in enumerate(members)}
                try:
                    answer = dict(tried(judge, [m["body"][: params.max_body_chars] for m in members]))
                except Exception:  # one bad group costs nothing but itself
                    out.append((key, "failed", None))
                    continue
                answer["equivalent"] = [ids[x] for x in answer.get("equivalent") or ids if x in ids]
                answer["canonical_id"] = ids.get(answer.get("canonical_id"))
                out.append((key, "answered", answer))
            yield pd.DataFrame(out, columns=["candidate_id", "status", "answer"])

    kind = candidates.schema["candidate_id"].dataType.simpleString()
    fields = ", ".join(f.replace(" ", ":", 1) for f in ANSWER.split(", "))
    return rows.mapInPandas(run, f"candidate_id {kind}, status string, answer struct<{fields}>")


def settle(answers: DataFrame, functions: DataFrame) -> DataFrame:
    """(candidate_id, status, member_ids, canonical_id, domain, confidence, probe_inputs, ...): what becomes of the answers.

    Members keep their order and come once. Kept are answers of the same behaviour with two members or more; the
    canonical one is a kept member, the domain is its own, confidence lies within 0 and 1, inputs are JSON arrays.
    """
    a = F.col("answer")
    rows = answers.withColumn("member_ids", F.array_distinct(a["equivalent"]))
    keeps = F.coalesce(a["same_behavior"] & (F.size("member_ids") >= 2), F.lit(False))
    status = F.when(F.col("status") != "answered", F.col("status")).when(keeps, "kept").otherwise("rejected")
    rows = rows.withColumn("status", status)
    chosen = F.when(F.array_contains("member_ids", a["canonical_id"]), a["canonical_id"]).otherwise(F.try_element_at("member_ids", F.lit(1)))
    rows = rows.withColumn("canonical_id", chosen)
    domain = functions.select(F.col("function_id").alias("canonical_id"), F.col("fingerprint.domain").alias("domain"))
    rows = rows.join(domain, "canonical_id", "left")
    kept = F.col("status") == "kept"
    return rows.select(
        "candidate_id",
        "status",
        *[F.when(kept, F.col(c)).alias(c) for c in ("member_ids", "canonical_id")],
        F.when(kept, F.coalesce("domain", F.lit("unknown"))).alias("domain"),
        *[F.when(kept, a[c]).alias(c) for c in ("behavior_summary", "differences", "disagreement_risk")],
        F.when(kept, F.least(F.greatest(a["confidence"], F.lit(0.0)), F.lit(1.0))).alias("confidence"),
        F.when(kept, ordering.json_arrays(a["probe_inputs"])).alias("probe_inputs"),
    )


def replay(candidates: DataFrame, clusters: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Answers as from :func:`ask`, from stored clusters with the same ``cluster_id``: no call is made."""
    n = F.size("member_ids")
    inside = F.filter("function_ids", lambda x: F.array_contains("member_ids", x))
    answer = F.struct(
        "same_behavior", inside.alias("equivalent"), "canonical_id", "behavior_summary", F.col("differences").cast("string").alias("differences"), "disagreement_risk", "confidence", "probe_inputs"
    )
    stored = clusters.withColumnRenamed("cluster_id", "candidate_id").drop("member_ids")
    rows = candidates.select("candidate_id", "member_ids").join(stored, "candidate_id", "left")
    status = F.when(n < 2, "rejected").when((n > params.max_cluster_size) | F.col("canonical_id").isNull(), "failed").otherwise("answered")
    return rows.select("candidate_id", status.alias("status"), answer.alias("answer"))


def report(settled: DataFrame) -> DataFrame:
    """One row: candidates, and how many were kept, rejected and failed."""
    return settled.agg(F.count(F.lit(1)).alias("candidates"), *[F.count_if(F.col("status") == s).alias(s) for s in ("kept", "rejected", "failed")])
