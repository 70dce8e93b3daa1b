"""Repeats of many words at any word position, against brute force."""

import random

from stratadiff.llm import spans

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(r: random.Random, n: int) -> list[str]:
    return [f"w{r.randint(0, 99_999)}" for _ in range(n)]


def marked(r: random.Random, some: list[str], longest: int) -> list[str]:
    out, left = [], 0
    for w in some:
        left = left or r.randint(1, longest)
        left -= 1
        out.append(w if left else w + ".")
    return out


def test_repeats_at_any_word(spark):
    r, rows, planted = random.Random(5), [], {}
    for longest in (None, 8, 20, 38, 60):
        mark = lambda some, most=longest: marked(r, some, most) if most else some
        for n in (51, 52, 58, 75, 140):
            for _ in range(4):
                passage = mark(words(r, n))
                for _ in range(2):
                    a, b = mark(words(r, r.randint(1, 90))), mark(words(r, r.randint(1, 90)))
                    if len(rows) % 2:
                        planted[len(rows)] = (a, passage, b)
                    rows.append((len(rows), " ".join(a + passage + b), "en", "s", 0))
    twice = words(r, 55)
    both = words(r, 7) + twice + words(r, 30)
    rows += [(900, " ".join(both + twice + words(r, 9)), "en", "s", 0), (901, " ".join(words(r, 3) + both[7:56] + words(r, 3)), "en", "s", 0)]
    left = {x.row.doc_id: x.left for x in spans.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, (a, passage, b) in planted.items():
        assert left[i - 1].n_removed == 0 and left[i - 1].text == rows[i - 1][1]
        kept = left[i].text.split()
        assert left[i].n_removed > 0 and kept[: len(a)] == a and kept[len(kept) - len(b) :] == b, i
        stays = len(kept) - len(a) - len(b)
        assert stays <= 2 * (spans.LEAST_PART - 1), (i, len(passage), stays)
        if all(w[-1] != "." for w in a + passage + b):
            assert stays == 0, i
    assert left[900].n_removed and left[900].text.split() == both + rows[-2][1].split()[-9:]
    assert left[901].n_removed in (0, 1, 2)
