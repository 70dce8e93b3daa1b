"""Periodic runs against brute force: every stretch of every period, by comparing words."""

import hashlib
import random
import zlib

import pytest

from stratadiff.llm import periods, queries

FOLDER = "/root/testdata/sf0.001"


def brute_runs(t, least=periods.LEAST):
    """Each period's longest stretches, those with a smaller period left out."""
    out, n = {}, len(t)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if t[i] != t[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and t[i] == t[i + q]:
                i += 1
            b = i + q  # past the stretch
            if b - a >= 2 * q and not any(s <= a and b <= e and q % p == 0 for s, e, p in out):
                out[a, b, q] = None
    return sorted(((a, b - a, q) for a, b, q in out if b - a >= least), key=lambda r: (r[0], r[2]))


def split(text):
    words, at = [], []
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            if at:
                words.append("".join(at))
            at = []
        else:
            at.append(c)
    return [*words, "".join(at)] if at else words


def collapsed(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


def rows():
    r = random.Random(4)
    out = [(None, "a b"), (1, None), (2, ""), (3, " \n\t "), (3, "a " * 40), (3, "a " * 40), (4, "x y " * 6), (5, "a b c d e f " * 2), (6, "a b c d e f " * 2 + "a")]
    for i in range(7, 140):
        size = r.choice([1, 2, 3, 8])
        words = [r.choice("abcdefgh"[:size]) + ("é" if size == 8 else "") for _ in range(r.randrange(90))]
        block = words[: r.randrange(1, 12)]
        words += block * r.randrange(1, 5) + block[: r.randrange(3)]
        out.append((i, r.choice([" ", "  ", "\n", "\x0c"]).join(words)))
    return out


@pytest.mark.parametrize("least", [4, 12, 13])
def test_runs_of_words(least):
    r = random.Random(least)
    for i in range(400):
        t = [r.randrange(r.choice([1, 2, 3, 20])) for _ in range(r.randrange(70))]
        if i % 2:
            t += t[: r.randrange(20)] * r.randrange(5)
        assert periods.runs_of(t, least) == brute_runs(t, least), t


def test_many_ends():
    t = [0] * 5000 + [1] + [0, 2] * 3000
    assert periods.runs_of(t) == [(0, 5000, 1), (5001, 6000, 2)]


def test_rows(spark):
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows()], "doc_id long, text string, runs int")
    got = sorted(((x.doc_id, x.n_words, [tuple(r) for r in x.runs], x.collapsed) for x in periods.find_runs(docs).collect()), key=repr)
    want = []
    for d, t in rows():
        words = split(t)
        found = brute_runs(words)
        want.append((d, len(words), found, collapsed(words, found)))
    assert got == sorted(want, key=repr)
    assert sum(bool(w[2]) for w in want) > 60
    assert periods.find_runs(docs.limit(0)).count() == 0


def test_long_text(spark):
    words = [f"w{i % 700}" for i in range(30_000)] + [f"u{i}" for i in range(30_000)] + ["z"] * 30_000
    got = periods.find_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert [tuple(r) for r in got.runs] == [(0, 30_000, 700), (60_000, 30_000, 1)]
    assert got.collapsed.split(" ") == words[:700] + words[30_000:60_001]


def contract(doc_id, text):
    words = split(text)
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = min(((-ln, s, q) for s, ln, q in runs), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    four = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, sha("".join(f"{s},{ln},{q}\n" for s, ln, q in runs)), sha(collapsed(words, runs)))


def test_query(spark, tmp_path):
    spark.createDataFrame([(d, t) for d, t in rows()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_suffix_automaton"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((contract(d, t) for d, t in rows()), key=repr)


def test_query_on_given_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op13_suffix_automaton"](spark, FOLDER).collect()}
    assert len(got) == len(docs)
    short = [r for r in docs if len(split(r.text)) < 1500]
    assert len(short) > 100
    for r in short:
        assert got[r.doc_id] == contract(r.doc_id, r.text)
