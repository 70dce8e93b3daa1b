"""Screening of long lines, and lines that very many documents have."""

import difflib
import random

import numpy as np
import pandas as pd

from stratadiff.operators import likeness
from stratadiff.plans import result_queries


def prose(r, size, letters="eeeeeetttttaaaaooooiiiinnnnsssshhhrrrddllcumwfgypbvk,."):
    words = ["".join(r.choice(letters) for _ in range(r.randrange(2, 9))) for _ in range(500)]
    out = ""
    while len(out) < size:
        out += r.choice(words) + " "
    return "".join(chr(0x400 + r.randrange(60)) if r.random() < 0.03 else c for c in out[:size])


def test_blocks_that_the_library_finds():
    r = random.Random(1)
    for size in (200, 260, 700, 1500):
        for _ in range(10):
            b = prose(r, size)
            a = "".join(c for c in b if r.random() > 0.1) if r.random() < 0.5 else b[: size // 3] + prose(r, size // 2)
            found = sum(m.size > 0 for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks())
            most = likeness._most_blocks(*likeness._codes(["x", b, a * 2]))
            assert found <= most[1] < size / 2 and most[0] == np.iinfo(np.int64).max


def test_long_lines_are_screened(monkeypatch):
    """Unlike lines of 180, 300 and 1,500 characters, in one language: hardly any goes to the subsequence."""
    r, asked, real = random.Random(2), [], likeness._indel
    monkeypatch.setattr(likeness, "_indel", lambda a, b: asked.append(a) or real(a, b))
    for size in (180, 300, 1500):
        texts = [prose(r, size) for _ in range(200)]
        near = texts[0][:50] + texts[0][55:]
        rows = pd.DataFrame({"id": range(201), "text": [*texts, near]})
        asked.clear()
        got = {(i, j) for i, j, _ in likeness._compared(rows[:20], rows, 0.9, False)}
        assert {(i, j) for i in range(20) for j in range(201) if i != j and difflib.SequenceMatcher(None, rows.text[i], rows.text[j]).ratio() >= 0.9} == got == {(0, 200)}
        assert len(asked) < 20


def test_copies_are_counted_not_paired(spark, tmp_path, monkeypatch):
    """Rows with the same line never meet one by one, so a line that all documents have costs no square of them."""
    monkeypatch.setattr(likeness, "ratio_join", lambda *a, **k: 1 / 0)
    rows = [(i, None if i % 200 else "en", "the line that every document has\nthe line that every document had" + "\n!" * (i == 300)) for i in range(0, 20_000, 50)]
    spark.createDataFrame([*rows, rows[0]], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(x.doc_id, x.line_no): (x.others, x.best) for x in result_queries.alike_lines(spark, str(tmp_path)).collect()}
    none, en = [x for x in rows if x[1] is None], [x for x in rows if x[1] == "en"]
    # Document 0 stands there twice: two lines, each like all others of the language but for those of its own number.
    want = {(i, n): (2 * (2 * len(en) + 2) - 4 if i == 0 else 2 * (len(en) + 1) - 1 if g else 2 * len(none) - 1, 1.0) for i, g, _ in rows if i % 100 == 0 for n in (0, 1)}
    assert got == want
