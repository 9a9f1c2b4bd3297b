"""Differential execution: the members of a group run on the same inputs, and their results are compared.

Members are Python functions and run in a separate, isolated interpreter with limits on time and memory. That keeps
accidents away; it is no sandbox for hostile code. Only members marked pure are run, a member that can't be loaded or
that lacks a name is left out, and with fewer than two runnable members there is no table.
"""

from __future__ import annotations

import json
import subprocess
import sys

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import divergence

#: Seconds a call, at most a group, and bytes of memory.
CALL_S, GROUP_S, MEMORY = 1, 30, 512 * 1024 * 1024
#: A longer value is compared by its hash and shown cut.
LONG_VALUE, SHOWN = 2_000, 200

_RUNNER = r'''
import hashlib, json, math, resource, signal, sys
memory, call_s, long_value, shown = map(int, sys.argv[1:5])
resource.setrlimit(resource.RLIMIT_AS, (memory, memory))
def plain(v, seen=()):
    if id(v) in seen: return "<circular>"
    if v is None or isinstance(v, bool): return repr(v)
    if isinstance(v, int): return str(v)
    if isinstance(v, float):
        if math.isnan(v): return "NaN"
        if math.isinf(v): return "Infinity" if v > 0 else "-Infinity"
        return "-0" if v == 0 and math.copysign(1, v) < 0 else repr(v)
    if isinstance(v, str): return json.dumps(v, ensure_ascii=False)
    s = (*seen, id(v))
    if isinstance(v, dict): return "{" + ",".join(sorted(plain(k, s) + ":" + plain(x, s) for k, x in v.items())) + "}"
    if isinstance(v, (set, frozenset)): return "set(" + ",".join(sorted(plain(x, s) for x in v)) + ")"
    if isinstance(v, (list, tuple)): return "[" + ",".join(plain(x, s) for x in v) + "]"
    return type(v).__name__ + ":" + (v.isoformat() if hasattr(v, "isoformat") else repr(v))
def late(*_): raise TimeoutError("timed out")
signal.signal(signal.SIGALRM, late)
job = json.load(sys.stdin)
cells = []
for m in job["members"]:
    try:
        space = {"__name__": "member"}
        exec(m["preamble"] or "", space)
        before = set(space)
        exec(m["source"], space)
        f = [space[k] for k in space if k not in before and callable(space[k])][-1]
    except BaseException:
        continue
    own, unresolved = [], 0
    for text in job["inputs"]:
        try:
            signal.alarm(call_s)
            value = plain(f(*json.loads(text)))
            signal.alarm(0)
            key = "return:" + (hashlib.sha256(value.encode()).hexdigest() if len(value) > long_value else value)
            own.append([text, m["member"], value[:shown], "", key])
        except BaseException as e:
            signal.alarm(0)
            unresolved += isinstance(e, NameError)
            own.append([text, m["member"], None, type(e).__name__ + ": " + str(e)[:shown], "throw:" + type(e).__name__])
    if unresolved < len(own):
        cells += own
json.dump(cells, sys.stdout)
'''


def _probe(rows: pd.DataFrame) -> pd.DataFrame:
    columns = ["group_id", "input", "member", "output", "error", "key"]
    pure = rows[rows["is_pure"]].sort_values("member")
    inputs = list(dict.fromkeys(x for xs in rows["inputs"] if xs is not None for x in xs))
    if len(pure) < 2 or not inputs:
        return pd.DataFrame(columns=columns)
    job = {"members": pure[["member", "source", "preamble"]].where(pure[["member", "source", "preamble"]].notna(), None).to_dict("records"), "inputs": inputs}
    most = min(GROUP_S, CALL_S * len(pure) * len(inputs) + 2)
    try:
        run = subprocess.run([sys.executable, "-I", "-c", _RUNNER, str(MEMORY), str(CALL_S), str(LONG_VALUE), str(SHOWN)], input=json.dumps(job), capture_output=True, text=True, timeout=most, env={})
        cells = json.loads(run.stdout) if run.returncode == 0 else []
    except (subprocess.TimeoutExpired, ValueError):
        cells = []
    if len({c[1] for c in cells}) < 2:
        return pd.DataFrame(columns=columns)
    return pd.DataFrame([(rows["group_id"].iloc[0], *c) for c in cells], columns=columns)


def cells(members: DataFrame) -> DataFrame:
    """(group_id, input, member, output, error, key) of ``members`` (group_id, member, source, preamble, is_pure, inputs).

    Groups are bounded by the cluster size, so one group is one task's work.
    """
    kinds = {c: members.schema[c].dataType.simpleString() for c in ("group_id", "member")}
    schema = f"group_id {kinds['group_id']}, input string, member {kinds['member']}, output string, error string, key string"
    return members.groupBy("group_id").applyInPandas(_probe, schema)


def tables(members: DataFrame) -> DataFrame:
    """(group_id, input, results, diverged): executed rows only; a group that couldn't be run has none."""
    return divergence(cells(members))


def proven(members: DataFrame) -> DataFrame:
    """(group_id, executed, diverged_rows)."""
    ran = tables(members).groupBy("group_id").agg(F.count_if("diverged").alias("diverged_rows")).withColumn("executed", F.lit(True))
    out = members.select("group_id").distinct().join(ran, "group_id", "left")
    return out.select("group_id", F.coalesce("executed", F.lit(False)).alias("executed"), F.coalesce("diverged_rows", F.lit(0)).alias("diverged_rows"))
