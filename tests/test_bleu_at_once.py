"""BLEU and its form for code, counted for many pairs at once, are those of single pairs."""

import random
import re

from stratadiff.operators import similarity

ODD = ["", "x", "let a = b; a = c", "A = B a = b", "ΑΣ'Α ΣΑΣ", "İstanbul İ i", "if if for x = y = z", "é É ß ẞ", " \t", "=", "a =", "= a =", "a = b = c", "Ⓐ x", "the The THE"]


def test_all_pairs_at_once():
    r = random.Random(1)
    made = lambda: "".join(r.choice("ab =iIf. ") for _ in range(r.randrange(30)))
    pairs = [(a, b) for a in ODD for b in ODD] + [(made(), made()) for _ in range(1500)] + [("foo " * 400 + "bar", "foo " * 300 + "baz = 1")]
    tokens = similarity._TOKEN.findall
    want = [(similarity._bleu(tokens(a.lower()), tokens(b.lower())), similarity._code_bleu(a, b)) for a, b in pairs]
    assert similarity._bleus(pairs) == want
    assert [similarity._bleus([p])[0] for p in pairs[:60]] == want[:60]


def test_numbers_that_are_too_large_to_multiply():
    words = [f"w{i}" for i in range(60_000)]
    pairs = [(" ".join(words[i : i + 30]), " ".join(words[i + 2 : i + 33])) for i in range(0, 59_000, 30)]
    tokens = similarity._TOKEN.findall
    assert similarity._bleus(pairs) == [(similarity._bleu(tokens(a), tokens(b)), similarity._code_bleu(a, b)) for a, b in pairs]


def test_lower_case_of_single_tokens():
    """One letter becomes two characters; all others stay words or none."""
    others = [c for i in range(0x110000) if (c := chr(i)).lower() != c and (len(c.lower()) != 1 or bool(re.match(r"\w", c)) != bool(re.match(r"\w", c.lower())))]
    assert others == ["İ"]


def test_texts_are_read_once():
    known = similarity._Tokens()
    assert known.of("A b") is known.of("A b") and len(known.words) == 2


def test_nulls(spark):
    rows = [(1, "a b c", "a b d"), (2, None, "x"), (3, "x y", None), (4, "", ""), (5, "A b c d", "a b c d")]
    out = spark.createDataFrame(rows, "i int, a string, b string").coalesce(1).select("i", similarity.bleu("a", "b").alias("x"), similarity.code_bleu("a", "b").alias("y")).collect()
    tokens = similarity._TOKEN.findall
    assert {r.i: (r.x, r.y) for r in out} == {i: (None, None) if a is None or b is None else (similarity._bleu(tokens(a.lower()), tokens(b.lower())), similarity._code_bleu(a, b)) for i, a, b in rows}
