"""Steps that hold a bounded part of their input at a time."""

import hashlib
import math
import random

import pandas as pd
from pyspark.sql import types as T

from stratadiff.operators import diffs, edits, graphs, similarity
from stratadiff.plans import catalogue, graph_queries


class _Patches:
    """A stand-in for a table of one batch: what a worker would hand on, frame by frame."""

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])

    def __init__(self, texts):
        self.batch = pd.DataFrame({"id": range(len(texts)), "text": texts})

    def select(self, *names):
        return self

    def mapInPandas(self, run, schema):  # noqa: N802
        return list(run(iter([self.batch])))


def _patch(lines, line):
    return "--- a/x.js\n+++ b/x.js\n" + "".join(f"@@ -{20 * i + 1},1 +{20 * i + 1},1 @@\n-{line}\n+{line}\n" for i in range(lines))


def test_lines_of_patches_are_handed_on_in_parts():
    short = _Patches([_patch(3_000, "a")] * 10 + [None, ""])
    wide = _Patches([_patch(20, "b" * 500_000)])
    for work in (diffs.diff_lines, diffs.raw_hunks):
        name = "value" if work is diffs.diff_lines else "text"
        parts = work(short, "id")
        assert sum(map(len, parts)) == (60_000 if name == "value" else 30_000) and max(map(len, parts)) <= 10_000
        assert pd.concat(p for p in parts if len(p)).groupby("id").hunk_idx.nunique().tolist() == [3_000] * 10
        assert max(p[name].str.len().sum() for p in work(wide, "id") if len(p)) < 8_000_000


def test_nearest_vectors_by_products_of_blocks(spark):
    """No pair is a row, nothing is broadcast; copies, ties, nulls, other dimensions and vectors of length 0 as ever."""
    r = random.Random(5)
    rows = [(i, [float(r.randint(-2, 2)) for _ in range(3)]) for i in range(70)]
    rows += [(70, None), (71, [1.0, None, 2.0]), (72, [0.0] * 3), (73, [1.0, 2.0]), (74, [2.0, 1.0]), (None, [1.0, 0.0, 0.0])] + [(75 + i, [1.0, 2.0, 0.5]) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    out = similarity.nearest_vectors(df.where("id % 5 = 0 OR id = 72 OR id = 73"), df, "id", "v", 3, block=4, wide=16)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Broadcast" not in plan
    got = {}
    for x in out.collect():
        got.setdefault(x.q, []).append((x.s, x.id))

    def like(a, b):
        if not a or not b or None in a or None in b or len(a) != len(b) or not any(a) or not any(b):
            return None
        return round(sum(p * q for p, q in zip(a, b, strict=True)) / (math.hypot(*a) * math.hypot(*b)), 6)

    order = lambda x: (x[0] is None, -(x[0] or 0.0), x[1])
    for q, v in rows:
        if q is not None and (q % 5 == 0 or q in (72, 73)):
            assert sorted(got.pop(q), key=order) == sorted(((like(v, w), i) for i, w in rows if i is not None and i != q), key=order)[:3], q
    assert not got


def test_ancestors_are_counted_without_the_closure(spark, tmp_path, monkeypatch):
    r = random.Random(3)
    rows = [(k, str(i), None if i == 0 or r.random() < 0.1 else str(r.randrange(max(0, i - 6), i))) for k in "ab" for i in range(60)]
    merged = [(k, str(i), str(r.randrange(i))) for k in "b" for i in range(8, 60, 7)]
    for some in (rows, rows + merged + merged[:2]):
        edges = spark.createDataFrame(some, "repo string, commit_id string, parent_id string")
        up: dict = {}
        for k, c, p in sorted(some, key=lambda x: (x[0], int(x[1]))):
            up.setdefault((k, c), set()).update(set() if p is None else {p} | up[k, p])
        # A parent's own ancestors are known before its children's, as numbers grow.
        assert {(x.repo, x.commit_id): x.ancestors for x in graphs.ancestor_counts(edges, "commit_id", "parent_id", ["repo"]).collect()} == {x: len(y) for x, y in up.items()}

    monkeypatch.setattr(graphs, "closure", None)
    spark.range(1, 200).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    depth = {i: i.bit_length() - 1 for i in range(1, 200)}
    assert {x.commit_id: x.ancestors for x in catalogue.topological_depth(spark, str(tmp_path)).collect()} == depth
    assert {x.c_custkey: x.ancestors for x in catalogue.closure_count(spark, str(tmp_path)).collect()} == {i: n for i, n in depth.items() if n}


def test_components_pass_no_labels_through_the_driver(spark, monkeypatch):
    plans, cut = [], graphs._cut

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(graphs, "_cut", seen)
    edges = spark.range(1, 40).selectExpr("id AS a", "id + IF(id % 10 = 0, 0, 1) AS b")
    assert {x.v: x.c for x in graphs.components(edges).collect()} == {i: (i - 1) // 10 * 10 + 1 for i in range(1, 41)}
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)


def test_long_reports_are_digested_in_rounds(spark):
    rows = [(None if i % 5 == 0 else "ab"[i % 2] if i % 7 else "c", i, "é" * (i % 40) if i % 11 else "", "s") for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i long, t string, s string").repartition(5)
    want = {k: hashlib.md5("\n--\n".join(f"{t}\n{s}" for x, _, t, s in rows if x == k).encode()).hexdigest() for k in (None, "a", "b", "c")}
    out = edits.report_digests(df, "k", "i", ["t", "s"], "--", large=2_500, chunk=1_500)
    assert {r.k: r.report for r in out.collect()} == want
    assert {r.k: r.report for r in edits.report_digests(df, "k", "i", ["t", "s"], "--").collect()} == want
    # Only the short report of c is put together in one row.
    assert sum(len(t.encode()) + 6 for k, _, t, _ in rows if k == "c") < 2_500 and "state" not in out.columns


def test_walks_parse_patches_once(spark, tmp_path, monkeypatch):
    plans, cut = [], graphs._cut

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(graphs, "_cut", seen)
    spark.createDataFrame([(i, "\n".join(f"line {n}" for n in range(10 * i))) for i in range(1, 4)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = graph_queries.walked_chunks(spark, str(tmp_path))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert out.count() > 20 and sum(p.count("MapInPandas") for p in plans) == 1
