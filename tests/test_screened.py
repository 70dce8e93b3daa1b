"""Alike texts by blocks of lengths: the same pairs as all pairs measured, and few of them measured."""

import difflib
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_likeness import made

from stratadiff.operators import likeness


def long_texts(seed):
    r, same = random.Random(seed), random.Random(5)
    words = ["".join(same.choice("abcdefghij") for _ in range(same.randrange(2, 7))) for _ in range(400)]
    out = []
    for size in (30, 90, 170, 260):
        base = " ".join(same.choice(words) for _ in range(size))
        for _ in range(4):
            t = list(base)
            for _ in range(r.randrange(len(t) // 5)):
                i = r.randrange(len(t))
                t[i : i + r.randrange(2)] = [r.choice("abc ")] * r.randrange(2)
            out.append("".join(t))
    return [(1000 + i, r.choice(["k", None]), t) for i, t in enumerate(out)]


@pytest.mark.parametrize(("least", "strict"), [(0.95, True), (0.9, False), (0.5, False), (1.0, False), (0.75, True)])
def test_all_pairs(spark, monkeypatch, least, strict):
    monkeypatch.setattr(likeness, "BLOCK", 7)
    a, b = made(1) + long_texts(1), made(2) + long_texts(2)
    schema = "id int, k string, t string"
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b + b[:5], schema)
    got = sorted((x.l_id, x.r_id, round(x.similarity, 9)) for x in likeness.ratio_join(left, right, ["k"], "t", least, strict, screen=True).collect())
    want = []
    for i, k, s in a:
        for j, m, t in b + b[:5]:
            if k == m and s is not None and t is not None:
                ratio = difflib.SequenceMatcher(None, s, t).ratio()
                if ratio > least or not strict and ratio == least:
                    want.append((i, j, round(ratio, 9)))
    assert got == sorted(want) and len(want) > 20


def test_few_are_measured(monkeypatch):
    """Lines of prose of one language, as long as each other: none of these pairs reaches the subsequence, before all were measured by runs."""
    r, asked = random.Random(3), []
    words = ["".join(r.choice("etaoinshrd") for _ in range(r.randrange(2, 7))) for _ in range(300)]
    texts = [" ".join(r.choice(words) for _ in range(60))[:260] for _ in range(400)]
    monkeypatch.setattr(likeness, "_indel", lambda a, b: asked.append(a) or 0.0)
    rows = pd.DataFrame({"id": range(len(texts)), "text": texts})
    assert list(likeness._compared(rows[:20], rows, 0.9, False)) == [] and len(asked) < 80


def test_a_band_goes_to_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(likeness, "BLOCK", 50)
    texts = lambda n: spark.range(n).select("id", F.lit(0).cast("long").alias("group"), F.concat(F.lit("line "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("text"))
    got = likeness.screened(texts(10), texts(1000), 0.9, False)
    want = sum(difflib.SequenceMatcher(None, f"line {i:06d}", f"line {j:06d}").ratio() >= 0.9 for i in range(10) for j in range(1000) if i != j)
    assert got.count() == want > 50
