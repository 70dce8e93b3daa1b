"""The perfect hash, and phrases against a plain count with exact numbers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from stratadiff.llm import perfect, phrases, queries

SCHEMA = "doc_id long, text string, lang string, n long, rank string"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 5000])
@pytest.mark.parametrize("parts", [1, 7])
def test_perfect_hash(n, parts):
    r = random.Random(n)
    keys = np.array(sorted({r.getrandbits(64) for _ in range(n)} | set(range(n // 2))), np.uint64)
    of = perfect.part_of(keys, parts)
    some = [perfect.build(keys[of == p]) for p in range(parts)]
    known = perfect.PerfectHash.of(perfect.PerfectHash(some, parts).arrays())
    slots = known.slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys))) and len(known) == len(keys)
    assert np.array_equal(known.keys[slots], keys)
    others = np.array([x for x in (r.getrandbits(64) for _ in range(3000)) if x not in set(keys.tolist())], np.uint64)
    assert (known.slots(others) == -1).all()
    some_parts = perfect.PerfectHash(some[:1], parts, 0)
    assert ((some_parts.slots(keys) >= 0) == (of == 0)).all()


def test_mixed_keys_come_back():
    keys = np.random.default_rng(1).integers(0, 1 << 64, 1000, dtype=np.uint64)
    assert np.array_equal(phrases.unmix(phrases.mix(keys)), keys)


def brute(rows, most=5, least=100, top=2000):
    counts, total = defaultdict(Counter), Counter()
    lower = {i: i + 32 for i in range(65, 91)}
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = set()
        for p, a in found.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    q = p[i:j]
                    if len(q) < len(p) and 100 * a >= 100 * found[q]:
                        covered.add(q)
        rated = []
        for p, a in found.items():
            if p not in covered:
                score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rated.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (s, a, p, x, y) in enumerate(sorted(rated)[:top], 1):
            out.append((lang, i, p.decode(), -a, x, y, total[lang], -s))
    return sorted(out)


def made():
    r = random.Random(3)
    fixed = ["new york city", "of the", "In The Beginning", "one two three four five six", "ça va", "a b a b a b a", "x"]
    out = [(None, "en"), ("", "en"), (" .. ,;\n\t", "en"), ("Alone", None), ("alone", "und"), ("x\x1cy", "xx")]
    for i in range(260):
        lang = r.choice(["en", "fr", None, "und", "de"])
        words = [r.choice(fixed) if r.random() < 0.5 else f"w{int(r.paretovariate(0.6))}" for _ in range(r.randrange(60))]
        out.append((r.choice([" ", "\t", "  "]).join(w + r.choice(["", "", "", ".", ",", "\n", "!?", "\r\n"]) for w in words), lang))
    out += [("the same line again and again", "en")] * 120
    return [(i, t, x, i, "z") for i, (t, x) in enumerate(out)]


def test_collocations(spark, tmp_path):
    docs = spark.createDataFrame(made(), SCHEMA).repartition(3)
    got = phrases.collocations(docs, str(tmp_path / "t"))
    assert got.columns == COLUMNS
    want = brute([r[1:3] for r in made()])
    assert sorted(map(tuple, got.collect())) == want
    assert len(want) > 3


def test_many_passes(spark, tmp_path, monkeypatch):
    """Several groups of keys, and several ranges of buckets."""
    for name, value in (("AT_ONCE", 500), ("RANGE_BITS", 10), ("BLOCK", 16)):
        monkeypatch.setattr(phrases, name, value)
    got = phrases.collocations(spark.createDataFrame(made(), SCHEMA).repartition(3), str(tmp_path / "t"), least=6, top=40, keys=64, part=16)
    assert sorted(map(tuple, got.collect())) == brute([r[1:3] for r in made()], least=6, top=40)


def test_nothing(spark, tmp_path):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA), str(tmp_path / "a")).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, "a b c", "en", 1, "")], SCHEMA), str(tmp_path / "b")).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("text", "lang").collect()
    got = queries.QUERIES["op12_perfect_hash"](spark, folder)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == brute(docs)
