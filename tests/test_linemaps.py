"""Composed line maps against walks step by step."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from stratadiff.operators import diffs, linemaps


def histories(n, seed):
    """Versions of a file as lists of line identities, none of which comes twice."""
    r, fresh = random.Random(seed), iter(range(10**9))
    now = [next(fresh) for _ in range(30)]
    out = [now]
    for _ in range(n):
        now = list(now)
        for _ in range(r.randrange(4)):
            at = r.randrange(len(now) + 1)
            now[at : at + r.randrange(3)] = [next(fresh) for _ in range(r.randrange(3))]
        out.append(now)
    return out


def patches(versions, repo, context):
    rows = []
    for step, (a, b) in enumerate(zip(versions, versions[1:], strict=False)):
        lines = list(difflib.unified_diff([f"l{x}" for x in a], [f"l{x}" for x in b], "a/f", "b/f", lineterm="", n=context))
        rows.append((f"{repo}:{step}", "\n".join(lines)))
    return rows


def test_chains(spark):
    every = {f"r{i}": histories(n, i) for i, n in enumerate([1, 2, 7, 23, 40])}
    rows = [p for i, (repo, v) in enumerate(every.items()) for p in patches(v, repo, i % 4)]
    lines = diffs.diff_lines(spark.createDataFrame(rows, "case_id string, text string"))
    key = F.split("case_id", ":")
    lines = lines.withColumn("repo", key[0]).withColumn("step", key[1].cast("int"))
    steps = spark.createDataFrame([tuple(c.split(":")) for c, _ in rows], "repo string, step string").select("repo", F.col("step").cast("int").alias("step"))
    maps = linemaps.line_map(lines, ["repo", "step"])
    maps = maps.unionByName(linemaps.identity(steps.join(maps, ["repo", "step"], "left_anti")))
    r, asked, want = random.Random(1), [], {}
    for repo, v in every.items():
        for _ in range(60):
            a = r.randrange(len(v))
            b = r.randrange(a, len(v))
            at = r.randrange(len(v[a]))
            asked.append((len(asked), repo, a, b, at + 1))
            if v[a][at] in v[b]:  # a line that goes never comes back
                want[len(asked) - 1] = v[b].index(v[a][at]) + 1
    probes = spark.createDataFrame(asked, "q int, repo string, start int, upto int, line_no int")
    got = {x.q: x.new_no for x in linemaps.carried(probes, maps, ["repo"]).collect()}
    assert got == want and len(want) > 60


def test_one_map_is_transport(spark):
    v = histories(1, 9) + histories(3, 4)[2:]
    lines = diffs.diff_lines(spark.createDataFrame(patches([v[0], v[1]], "r", 2), "case_id string, text string"))
    numbers = spark.range(1, 41).select(F.lit("r:0").alias("case_id"), F.col("id").cast("int").alias("line_no"))
    one = {x.line_no: x.new_no for x in diffs.transport(numbers.withColumn("ord", F.lit(0)), lines, ["case_id"]).collect()}
    maps = linemaps.line_map(lines, ["case_id"]).withColumn("step", F.lit(0))
    two = {x.line_no: x.new_no for x in linemaps.carried(numbers.withColumn("start", F.lit(0)).withColumn("upto", F.lit(1)), maps, ["case_id"]).collect()}
    assert one == two


@pytest.mark.parametrize("n", [300, 10_000])
def test_thousands_of_commits(spark, n):
    """Step s puts a line in before line s % 100 + 1, and each tenth step removes line 500 too."""
    rows = []
    for s in range(n):
        at = s % 100 + 1
        cut = [(at, 499, 1), (501, None, 0)] if s % 10 == 0 else [(at, None, 1)]
        rows += [("r", s, *x) for x in [(1, at - 1, 0), *cut] if x[1] is None or x[0] <= x[1]]
    maps = spark.createDataFrame(rows, "repo string, step int, first int, last int, shift int")
    probes = spark.range(1, 200).select(F.lit("r").alias("repo"), F.lit(3).alias("start"), F.lit(n).alias("upto"), (F.col("id") * 7).cast("int").alias("line_no"))
    want = {}
    for line in range(7, 1400, 7):
        now = line
        for s in range(3, n):
            if s % 10 == 0 and now == 500:
                now = None
                break
            now += (now >= s % 100 + 1) - (s % 10 == 0 and now > 500)
        if now is not None:
            want[line] = now
    got = {x.line_no: x.new_no for x in linemaps.carried(probes, maps, ["repo"]).collect()}
    assert got == want
