"""Ranks, ancestry and ranges of histories without closures, against plain walks."""

import random

from pyspark.sql import functions as F

from stratadiff.operators import graphs, similarity
from stratadiff.plans import studies

SCHEMA = "commit_id long, parent_id long, parent_idx int"


def made(n: int, seed: int) -> list[tuple]:
    r, rows = random.Random(seed), [(0, None, 0)]
    for i in range(1, n):
        rows.append((i, max(0, i - r.choice([1, 1, 1, 2, 5])), 0))
        if r.random() < 0.15 and i > 3:
            rows.append((i, r.randrange(i - 1), 1))
    return rows


def test_branched_history(spark):
    rows = made(120, 3)
    up = {i: set() for i, _, _ in rows}
    depth = {}
    for i, p, _ in rows:
        if p is not None:
            up[i] |= up[p] | {p}
        depth[i] = max(depth.get(i, 0), depth[p] + 1 if p is not None else 0)
    edges = spark.createDataFrame(rows, SCHEMA)
    got = {r.commit_id: r for r in graphs.ranks(edges, "commit_id", "parent_id").collect()}
    assert {i: r.depth for i, r in got.items()} == depth
    assert [i for i, _ in sorted(depth.items(), key=lambda x: (x[1], x[0]))] == sorted(got, key=lambda i: got[i]["rank"])
    r = random.Random(5)
    pairs = sorted({(r.randrange(120), r.randrange(120)) for _ in range(40)})
    df = spark.createDataFrame(pairs, "a long, b long")
    assert {(x.a, x.b): (x.over, x.under) for x in graphs.ancestry(df, edges, "a", "b").collect()} == {(a, b): (a == b or a in up[b], a == b or b in up[a]) for a, b in pairs}
    want = {(a, b, c) for a, b in pairs for c in (up[b] | {b}) - (up[a] | {a})}
    assert {tuple(x) for x in graphs.commits_between(df, edges, "a", "b").collect()} == want
    assert {tuple(x) for x in graphs.between(graphs.closure(edges, "commit_id", "parent_id"), df, "a", "b").collect()} == want


def test_long_linear_history(spark):
    n = 100_000
    edges = spark.range(n).select(F.col("id").alias("commit_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    got = graphs.ranks(edges, "commit_id", "parent_id").agg(F.count("*").alias("n"), F.count_if(F.col("rank") == F.col("commit_id") + 1).alias("right")).first()
    assert (got.n, got.right) == (n, n)


def test_walked_history_ends(spark):
    start = spark.createDataFrame([("r", "c", 3)], "repo string, commit_id string, line_no int")
    blame = spark.createDataFrame([("r", "c", 3, "b"), ("r", "p", 2, "a"), ("r", "o", 2, "o")], "repo string, commit_id string, line_no int, origin_commit string")
    patch = "@@ -1,1 +1,2 @@\n+new\n one\n"
    from stratadiff.operators import diffs

    lines = diffs.diff_lines(spark.createDataFrame([("r", "--- a/x\n+++ b/x\n" + patch)], "repo string, text string"), "repo").select("*", F.lit("c").alias("commit_id"), F.lit("b").alias("origin_commit"))
    mapped = spark.createDataFrame([("r", "b", 4, 2), ("r", "a", 2, 2)], "repo string, commit_id string, line_no int, new_no int")
    edges = spark.createDataFrame([("r", "b", "p", 0), ("r", "a", "o", 0), ("r", "o", None, 0)], "repo string, commit_id string, parent_id string, parent_idx int")
    got = {(x.commit_id, x.line_no, x.depth) for x in studies.walked_history(start, blame, lines, mapped, edges, ["repo"]).collect()}
    assert got == {("b", 4, 0), ("a", 2, 1)}
    older = lambda *ids: spark.createDataFrame([("r", c) for c in ids], "repo string, commit_id string")
    walk = lambda *ids: {x.commit_id for x in studies.walked_history(start, blame, lines, mapped, edges, ["repo"], older(*ids)).collect()}
    assert walk("a") == {"b", "a"} and walk("a", "b") == {"b"}
    # Where the lines were last known before the version asked for: the first commit older than it.
    chain = studies.walked_history(start, blame, lines, mapped, edges, ["repo"], older("a")).groupBy("repo", "commit_id").agg(F.collect_list("line_no").alias("lines"))
    chain = chain.join(spark.createDataFrame([("a", 1), ("p", 2), ("b", 3)], "commit_id string, rank int"), "commit_id")
    none = lines.drop("commit_id", "origin_commit").withColumn("from_commit", F.lit("other"))
    found = studies.localized(spark.createDataFrame([("r", 2)], "repo string, rank int"), chain, none, ["repo"])
    assert [(x.repo, x.lines) for x in found.collect()] == [("r", [2])]


def test_nearest_vectors_in_blocks(spark):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(5)]) for i in range(60)] + [(60, [0.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = {}
    for x in similarity.nearest_vectors(df.where("vec_id % 10 = 0 AND vec_id < 60"), df, "vec_id", "v", 4, block=2).collect():
        got.setdefault(x.q, []).append((x.s, x.vec_id))
    size = lambda v: sum(a * a for a in v) ** 0.5
    for q in range(0, 60, 10):
        want = sorted(((round(sum(a * b for a, b in zip(rows[q][1], v, strict=True)) / (size(rows[q][1]) * size(v)), 6), i) for i, v in rows[:60] if i != q), key=lambda x: (-x[0], x[1]))[:4]
        assert sorted(got[q], key=lambda x: (-x[0], x[1])) == want


def test_true_then_false_over_many_ranges(spark):
    from stratadiff.operators import results

    rows = spark.range(300_000).select(F.col("id"), (F.col("id") % 3 == 0).alias("flag"), F.concat(F.lit("k"), F.hex(F.xxhash64("id"))).alias("key"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")}
    try:
        for size, parts in (("64m", "4"), ("200k", "60")):
            spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = results.true_then_false(rows, "flag", "key")
            n = got.agg(F.count("*").alias("n"), F.count_distinct("place").alias("p"), F.min("place").alias("a"), F.max("place").alias("b"), F.count_if(F.col("flag") != (F.col("place") <= 100_000)).alias("wrong")).first()
            assert tuple(n) == (300_000, 300_000, 1, 300_000, 0)
            want = [r.id for r in rows.where("NOT flag").orderBy("key").limit(3).collect()]
            assert [r.id for r in got.where("place BETWEEN 100001 AND 100003").orderBy("place").collect()] == want
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
