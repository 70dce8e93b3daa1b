"""Matching blocks and subsequences, found by bits or from rare characters, are those of the library and of plain steps."""

import difflib
import random

from stratadiff.operators import similarity
from stratadiff.plans import catalogue


def plain(a, b):
    """Twice the longest common subsequence over both lengths, cell by cell."""
    row = [0] * (len(b) + 1)
    for c in a:
        before = row[:]
        for j, e in enumerate(b, 1):
            row[j] = before[j - 1] + 1 if c == e else max(before[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b)) if a or b else 1.0


def made():
    r = random.Random(3)
    many = "".join(chr(0x4E00 + i) for i in range(600))
    texts = lambda kind, n: "".join(r.choice(kind) for _ in range(n))
    out = [("", ""), ("", "x"), ("x", ""), ("a" * 64, "a" * 65), ("ab" * 200, "ba" * 150), ("x" * 6000, "y" + "x" * 199), (many, many[::-1]), (many * 2, "x" + many), ("é😀x’" * 3, "’x")]
    for kind in ("ab", "abcdef", "abcdefghijklmnopqrstuvwxyz   eeeettt", "é😀x", "eeettaoin" * 8 + "abcdfghjkmpqvwxyz0123456789ABCDEFGHIJ"):
        for longest in (30, 199, 420):
            for _ in range(25):
                a = texts(kind, r.randrange(longest))
                b = texts(kind, r.randrange(longest)) if r.random() < 0.4 else "".join(c for c in a if r.random() > 0.1) + texts(kind, r.randrange(9))
                out.append((a, b))
    return out


def test_pairs(monkeypatch):
    pairs = made()
    want = [difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    assert [similarity._sequence(a, b) for a, b in pairs] == want
    monkeypatch.setattr(similarity, "MOST_BITS", 1000)
    assert [similarity._sequence(a, b) for a, b in pairs] == want
    assert [similarity._indel(a, b) for a, b in pairs if len(a) * len(b) < 30_000] == [plain(a, b) for a, b in pairs if len(a) * len(b) < 30_000]


def test_the_library_is_not_walked_for_lines(monkeypatch):
    """Its blocks are searched in steps of Python, which was most of the time."""
    asked = []
    monkeypatch.setattr(similarity.difflib, "SequenceMatcher", lambda *a: asked.append(a))
    for a, b in made():
        if len(a) * len(b) <= similarity.MOST_BITS:
            similarity._sequence(a, b)
    assert not asked


def test_query(spark, tmp_path):
    pairs = made()[::9]
    spark.createDataFrame([(i, f"{a}\n{b}") for i, (a, b) in enumerate(pairs)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.ratio, r.indel) for r in catalogue.seqmatch_ratio(spark, str(tmp_path)).collect()}
    assert {i: r for i, (r, _) in got.items()} == {i: round(difflib.SequenceMatcher(None, a, b).ratio(), 6) for i, (a, b) in enumerate(pairs)}
