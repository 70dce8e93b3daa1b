"""The index of alike texts gives what all pairs give, and measures few of them."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from stratadiff.operators import likeness
from stratadiff.plans import result_queries

FOLDER = "/root/testdata/sf0.001"


def made(seed):
    r, same = random.Random(seed), random.Random(0)
    words = [same.choice(["let", "const", "if", "return"]) + " " + "".join(same.choice("abcdefgh_") for _ in range(same.randrange(3, 40))) for _ in range(60)]
    out = ["", None, "a", "ab", "aaaa", "aaaaa", "x" * 50, "x" * 52, "é" * 9, "é" * 10]
    for w in words:
        out.append(w)
        for _ in range(3):
            t = list(w)
            for _ in range(r.randrange(4)):
                i = r.randrange(len(t) + 1)
                t[i : i + r.randrange(2)] = [r.choice("abcxyz ")] * r.randrange(2)
            out.append("".join(t))
    r.shuffle(out)
    return [(i, r.choice(["k", "l", None]), t) for i, t in enumerate(out)]


@pytest.mark.parametrize(("least", "strict"), [(0.95, True), (0.9, False), (0.5, False), (1.0, False), (1.0, True), (0.75, True)])
def test_all_pairs(spark, least, strict):
    a, b = made(1), made(2)
    schema = "id int, k string, t string"
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b + b[:5], schema)
    got = sorted((x.l_id, x.r_id, round(x.similarity, 9)) for x in likeness.ratio_join(left, right, ["k"], "t", least, strict).collect())
    want = []
    for i, k, s in a:
        for j, m, t in b + b[:5]:
            if k == m and s is not None and t is not None:
                ratio = difflib.SequenceMatcher(None, s, t).ratio()
                if ratio > least or not strict and ratio == least:
                    want.append((i, j, round(ratio, 9)))
    assert got == sorted(want)
    assert len(want) > 20 or strict and least == 1


def test_runs_that_may_go():
    r = random.Random(6)
    for _ in range(3000):
        a = [r.choice("abc") for _ in range(r.randrange(2, 40))]
        b = list(a)
        for _ in range(r.randrange(6)):
            i = r.randrange(len(b) + 1)
            b[i : i + r.randrange(2)] = [r.choice("abc")] * r.randrange(2)
        a, b = "".join(a), "".join(b)
        least = difflib.SequenceMatcher(None, a, b).ratio()
        if least == 0:
            continue
        for x, y in ((a, b), (b, a)):
            assert likeness.possible(x, y, likeness.Counter(likeness.runs_of(x, 3)), likeness.Counter(likeness.runs_of(y, 3)), least)
            left = likeness.Counter(likeness.runs_of(x))
            left.subtract(likeness.runs_of(y))
            assert sum(n for n in left.values() if n > 0) <= likeness.most_gone(len(x), least)


def test_few_pairs_are_measured(spark):
    """On lines of documents, and on short lines as those of scripts."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    lines = sorted({v for r in docs.where("doc_id % 4 = 0").collect() for v in (r.text or "").split("\n") if v})
    r = random.Random(2)
    names = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 12))) for _ in range(200)]
    scripts = sorted({f"const {r.choice(names)} = {r.choice(names)}.{r.choice(names)}({r.choice(names)});" for _ in range(1500)})
    for texts, least, index, fewer in ((lines, 0.9, 1, 25), (scripts, 0.95, 8, 100)):
        table = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "id long, group long, text string")
        found = [(x.l_id, x.r_id) for x in likeness.candidates(table, table, least).collect()]
        near = sum(2 * min(len(a), len(b)) >= least * (len(a) + len(b)) for a in texts for b in texts)
        runs = [likeness.Counter(likeness.runs_of(t, likeness.CHECKED)) for t in texts]
        measured = sum(likeness.possible(texts[a], texts[b], runs[a], runs[b], least) for a, b in found if a != b)
        assert len(found) * index <= near and measured * fewer < near


def test_query(spark, tmp_path):
    r = random.Random(8)
    base = ["the same old line of text here", "another line that is long enough", "x", ""]
    rows = [(i, "en" if i % 3 else "fr", "\n".join(r.choice(base) + r.choice(["", "!", "??"]) for _ in range(r.randrange(1, 5)))) for i in [0, 1, 2, 3, 100, 200, 201]] + [(300, "en", None), (400, None, "x\nx")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lines = [(d, g, n, v) for d, g, t in rows if t is not None for n, v in enumerate(t.split("\n"))]
    want = {}
    for d, g, n, v in lines:
        hits = [difflib.SequenceMatcher(None, v, w).ratio() for e, h, m, w in lines if g == h and (d, n) != (e, m) and d % 100 == 0]
        hits = [x for x in hits if x >= 0.9]
        if hits:
            want[d, n] = (len(hits), round(max(hits), 6))
    got = {(x.doc_id, x.line_no): (x.others, x.best) for x in result_queries.alike_lines(spark, str(tmp_path)).collect()}
    assert got == want and len(want) > 3
