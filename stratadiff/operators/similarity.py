"""Measures of likeness between texts and vectors, and joins by them."""

from __future__ import annotations

import difflib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratadiff.functions import sets


# --- built from columns -----------------------------------------------------------------------------------------------
def edit_similarity(a: Column, b: Column) -> Column:
    """One minus the edit distance over the longer length; two empty texts are alike."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / F.nullif(longer, F.lit(0)))


def edit_share(a: Column, b: Column) -> Column:
    """The edit distance over the sum of lengths."""
    return F.try_divide(F.levenshtein(a, b).cast("double"), F.char_length(a) + F.char_length(b))


def hunk_similarity(removed_a: Column, added_a: Column, removed_b: Column, added_b: Column) -> Column:
    """Removed and added texts of two hunks at once: one minus both distances over both longer lengths; null if all are empty."""
    apart = F.levenshtein(removed_a, removed_b) + F.levenshtein(added_a, added_b)
    whole = F.greatest(F.char_length(removed_a), F.char_length(removed_b)) + F.greatest(F.char_length(added_a), F.char_length(added_b))
    return 1 - F.try_divide(apart.cast("double"), whole)


def token_jaccard(a: Column, b: Column) -> Column:
    words = lambda x: F.array_remove(F.split(x, r"(?U)\s+"), "")
    return sets.jaccard(words(a), words(b))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def changed_share(added: Column, removed: Column, lines_a: Column, lines_b: Column) -> Column:
    """One minus changed lines over all lines of two versions, lines kept counted once; 1 for binary files, whose counts are null."""
    binary = added.isNull() | removed.isNull()
    return F.when(binary, 1.0).otherwise(1 - F.try_divide((added + removed).cast("double"), lines_a + lines_b + lines_a - removed))


# --- in Python, by Arrow batches ----------------------------------------------------------------------------------------
#: For each byte a table that makes it 1 and all others 0, in ASCII.
_ONE = [bytes(48 + (i == c) for i in range(256)) for c in range(256)]


def _places(a: str, b: str) -> dict[str, int]:
    """For each character of ``b`` the places where ``a`` has it, as bits."""
    kinds = list(set(b))
    if not a:
        return dict.fromkeys(kinds, 0)
    try:
        codes = a[::-1].encode("latin-1")
        return {c: int(codes.translate(_ONE[ord(c)]), 2) if ord(c) < 256 else 0 for c in kinds}
    except UnicodeEncodeError:
        if len(kinds) < 256:
            named = {c: i for i, c in enumerate(kinds, 1)}
            codes = bytes([named.get(c, 0) for c in reversed(a)])
            return {c: int(codes.translate(_ONE[i]), 2) for c, i in named.items()}
    at = dict.fromkeys(kinds, 0)
    for i, c in enumerate(a):
        if c in at:
            at[c] |= 1 << i
    return at


def _indel(a: str, b: str) -> float:
    """Twice the longest common subsequence over the sum of lengths, by bit vectors: a step for each character of the shorter text."""
    if a == b:
        return 1.0
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    at = _places(a, b)
    full = rows = (1 << len(a)) - 1
    for hit in map(at.__getitem__, b):
        hit &= rows
        rows = (rows + hit | rows - hit) & full
    return 2 * (len(a) - rows.bit_count()) / (len(a) + len(b))


#: From this length on of the second text the library starts blocks only at characters that aren't popular in it (its ``autojunk``).
POPULAR = 200
#: Places of two texts, compared as bits at once.
MOST_BITS = 1 << 20


def _sequence(a: str, b: str) -> float:
    """``difflib.SequenceMatcher(None, a, b).ratio()``."""
    if a == b:
        return 1.0
    if len(b) >= POPULAR:
        return 2.0 * _matched_from_rare(a, b) / (len(a) + len(b))
    return 2.0 * _matched_bits(a, b) / (len(a) + len(b)) if len(a) * len(b) <= MOST_BITS else difflib.SequenceMatcher(None, a, b).ratio()


def _matched_bits(a: str, b: str) -> int:
    """Characters in matching blocks, where all may start a block. Equal characters are bits of one number, a row for each place of ``a``, with
    a free column at the end of each; runs on diagonals are found by shifting it by a row and a column."""
    width = len(b) // 8 * 8 + 8
    at: dict[str, int] = {}
    for j, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << j
    lines, none, ones = {c: x.to_bytes(width // 8, "little") for c, x in at.items()}, bytes(width // 8), {}

    def columns(rows: int, low: int, high: int) -> int:
        if rows not in ones:
            ones[rows] = int.from_bytes((b"\x01" + none[1:]) * rows, "little")
        return ones[rows] * ((1 << high - low) - 1 << low)

    found, todo = 0, [(int.from_bytes(b"".join([lines.get(c, none) for c in a]), "little"), len(a), 0, len(b))]
    while todo:
        grid, rows, low, high = todo.pop()
        if not grid:
            continue
        # Ends of runs of 1, 2, ... characters; the first of the longest is the one that the library takes.
        size, last = 1, grid
        while longer := last << width + 1 & grid:
            size, last = size + 1, longer
        i, j = divmod((last & -last).bit_length() - 1, width)
        found += size
        if i >= size and j - size + 1 > low:
            todo.append((grid & columns(i - size + 1, low, j - size + 1), i - size + 1, low, j - size + 1))
        if i + 1 < rows and j + 1 < high:
            todo.append((grid >> (i + 1) * width & columns(rows - i - 1, j + 1, high), rows - i - 1, j + 1, high))
    return found


def _matched_from_rare(a: str, b: str) -> int:
    """Characters in matching blocks, where only characters that are not popular in ``b`` start one, as in the library: only these are visited."""
    at: dict[str, list[int]] = {}
    for j, c in enumerate(b):
        at.setdefault(c, []).append(j)
    rare = {c: js for c, js in at.items() if len(js) <= len(b) // 100 + 1}
    seeds = [(i, rare[c]) for i, c in enumerate(a) if c in rare]
    places = [i for i, _ in seeds]
    found, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        a_low, a_high, b_low, b_high = todo.pop()
        i, j, size, ends, before = a_low, b_low, 0, {}, -1
        for at_a, js in seeds[bisect_left(places, a_low) : bisect_left(places, a_high)]:
            known, ends = ends if at_a == before + 1 else {}, {}
            before = at_a
            for at_b in js:
                if b_low <= at_b < b_high:
                    k = ends[at_b] = known.get(at_b - 1, 0) + 1
                    if k > size:
                        i, j, size = at_a - k + 1, at_b - k + 1, k
        while i > a_low and j > b_low and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < a_high and j + size < b_high and a[i + size] == b[j + size]:
            size += 1
        if size:
            found += size
            if a_low < i and b_low < j:
                todo.append((a_low, i, b_low, j))
            if i + size < a_high and j + size < b_high:
                todo.append((i + size, a_high, j + size, b_high))
    return found


_TOKEN = re.compile(r"\w+|[^\w\s]")
_NAME = re.compile(r"[A-Za-z_$]")


def _bleu(reference: list[str], found: list[str], most: int = 4) -> float:
    """Sentence BLEU of uniform weights; orders without a match are smoothed by the length of the text (Chen and Cherry, method 4)."""
    grams = lambda t, n: Counter(zip(*(t[i:] for i in range(n)), strict=False))
    return _bleu_of([sum((grams(found, n) & grams(reference, n)).values()) for n in range(1, most + 1)], len(reference), len(found))


def _bleu_of(hits: list[int], reference: int, found: int) -> float:
    """BLEU by the matches of each order and the tokens of both texts."""
    if not found or not hits[0]:
        return 0.0
    logs, misses, most = 0.0, 1, len(hits)
    for n, hit in enumerate(hits, 1):
        total = max(1, found - n + 1)
        if hit:
            logs += math.log(hit / total) / most
        elif found > 1:
            logs += math.log(1 / (2**misses * 5 / math.log(found)) / total) / most
            misses += 1
        else:
            return 0.0
    return math.exp(logs + min(0.0, 1 - reference / found))


def _udf(f, kind: str = "double"):
    """A pandas UDF of two columns that gives null where either is null."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return F.pandas_udf(run, kind)


def indel_ratio(a: Column, b: Column) -> Column:
    return _udf(_indel)(a, b)


def sequence_ratio(a: Column, b: Column) -> Column:
    """Matching blocks over lengths (Ratcliff and Obershelp) of characters; which text comes first matters."""
    return _udf(_sequence)(a, b)


def line_ratio(a: Column, b: Column) -> Column:
    return _udf(lambda x, y: difflib.SequenceMatcher(None, x.split("\n"), y.split("\n")).ratio())(a, b)


def bleu(reference: Column, found: Column) -> Column:
    return bleus(reference, found)["bleu"]


#: Words of the language that weigh more in code_bleu.
KEYWORDS = "break case catch class const continue default delete do else export extends finally for function if import in instanceof let new return super switch this throw try typeof var void while with yield async await".split()


def _code_bleu(x: str, y: str) -> float:
    a, b = _TOKEN.findall(x), _TOKEN.findall(y)
    plain = _bleu(a, b)
    weigh = lambda t: Counter({w: n * (5 if w in KEYWORDS else 1) for w, n in Counter(t).items()})
    weighted = sum((weigh(a) & weigh(b)).values()) / max(1, sum(weigh(b).values()))
    shape = lambda t: Counter(zip(*(["i" if re.match(r"[A-Za-z_$]", w) and w not in KEYWORDS else w for w in t][i:] for i in range(3)), strict=False))
    trees = sum((shape(a) & shape(b)).values()) / max(1, sum(shape(a).values()))
    flow = lambda t: Counter((w, v) for w, op, v in zip(t, t[1:], t[2:], strict=False) if op == "=")
    flows = sum((flow(a) & flow(b)).values()) / max(1, sum(flow(a).values())) if flow(a) else 1.0
    return (plain + weighted + trees + flows) / 4


def code_bleu(reference: Column, found: Column) -> Column:
    """A quarter each: BLEU, matches of words with keywords counted fivefold, runs of three tokens with names masked (for the syntax
    tree) and assignments in common (for the data flow). The last two stand in for a parser, which is not at hand."""
    return bleus(reference, found)["code_bleu"]


class _Tokens:
    """Numbers of the tokens of texts; each text and token is looked at once."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}
        self.known: dict[str, tuple[list[int], list[int] | None]] = {}

    def numbers(self, tokens: list[str]) -> list[int]:
        words = self.words
        return [words[t] if t in words else words.setdefault(t, len(words)) for t in tokens]

    def of(self, text: str) -> tuple[list[int], list[int] | None]:
        """Tokens of a text, and of the text in lower case unless each is the same token in lower case (two letters depend on others)."""
        if text not in self.known:
            alone = "\u0130" in text or "\u03a3" in text
            self.known[text] = self.numbers(_TOKEN.findall(text)), self.numbers(_TOKEN.findall(text.lower())) if alone else None
        return self.known[text]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By number: that of the token in lower case, its weight, and its number in the shape of a text."""
        every = list(self.words)
        lower = np.array(self.numbers([t.lower() for t in every]), dtype=np.int64)
        keys, name = set(KEYWORDS), self.numbers(["i"])[0]
        weight = np.array([5 if t in keys else 1 for t in every], dtype=np.int64)
        shape = np.array([name if _NAME.match(t) and t not in keys else k for k, t in enumerate(every)], dtype=np.int64)
        return lower, weight, shape


def _ids(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A number for each (x, y), in their order."""
    if len(x) and (int(x.max()) + 1) * (int(y.max()) + 1) >= 1 << 61:
        x, y = np.unique(x, return_inverse=True)[1], np.unique(y, return_inverse=True)[1]
    return x * (int(y.max()) + 1 if len(y) else 1) + y


def _grams_of(side: np.ndarray, token: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each order, the text and the number of every run of so many tokens of a text. Texts come in order, two to a pair; a run has the same
    number in both, and numbers are in order of pairs."""
    at, runs = np.arange(len(side)), _ids(side >> 1, token)
    yield side, runs
    for n in range(1, most):
        keep = at + n < len(side)
        keep[keep] = side[at[keep] + n] == side[at[keep]]
        at = at[keep]
        runs = _ids(runs[keep], token[at + n])
        yield side[at], runs


def _clipped(row: np.ndarray, runs: np.ndarray, found: np.ndarray, many: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Runs that both sides of a row have, each as often as the side with fewer; ``found`` tells sides apart. ``weight`` by run, as they stand."""
    if not len(runs):
        return np.zeros(many, dtype=np.int64)
    key = runs * 2 + found
    if weight is None:
        key = np.sort(key, kind="quicksort")
    else:
        order = np.argsort(key, kind="stable")
        key, weight = key[order], weight[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count, key = np.diff(starts, append=len(key)), key[starts]
    both = np.flatnonzero((key[:-1] >> 1) == (key[1:] >> 1))
    hits = np.minimum(count[both], count[both + 1])
    if weight is not None:
        hits = hits * weight[starts[both]]
    # Runs are numbered in order of rows, so what stands at a place of the sorted ones is of the row that stands there among sorted rows.
    rows = np.repeat(np.arange(many), np.bincount(row, minlength=many))
    return np.bincount(rows[starts[both]], weights=hits, minlength=many).astype(np.int64)


def _bleus(pairs: list[tuple[str, str]]) -> list[tuple[float, float]]:
    """_bleu in lower case and _code_bleu of every pair, all counted at once."""
    known, many = _Tokens(), len(pairs)
    sides = [known.of(t) for p in pairs for t in p]
    flat = lambda some: (np.repeat(np.arange(2 * many), [len(x) for x in some]), np.fromiter((k for x in some for k in x), dtype=np.int64))
    side, token = flat([x for x, _ in sides])
    lower, weight, shape = known.tables()
    if any(x for _, x in sides):
        side_low, token_low = flat([x if low is None else low for x, low in sides])
        token_low = np.where(np.repeat([low is None for _, low in sides], [len(x if low is None else low) for x, low in sides]), lower[token_low], token_low)
    else:
        side_low, token_low = side, lower[token]

    def matches(side: np.ndarray, token: np.ndarray, most: int) -> Iterator[np.ndarray]:
        # Runs are made within a text, and are the same for both texts of a pair.
        for at, runs in _grams_of(side, token, most):
            yield _clipped(at >> 1, runs, at & 1, many)

    sizes = np.bincount(side, minlength=2 * many).reshape(many, 2)
    sizes_low = np.bincount(side_low, minlength=2 * many).reshape(many, 2)
    plain = np.array(list(matches(side_low, token_low, 4))).T.tolist()
    code = np.array(list(matches(side, token, 4))).T.tolist()
    weighted = _clipped(side >> 1, _ids(side >> 1, token), side & 1, many, weight[token])
    whole = np.bincount(side, weights=weight[token], minlength=2 * many).reshape(many, 2)[:, 1].astype(np.int64)
    trees = list(matches(side, shape[token], 3))[2]
    equals = known.words.get("=", -1)
    at = np.flatnonzero((token[1:-1] == equals) & (side[2:] == side[:-2]))
    flows = _clipped(side[at] >> 1, _ids(_ids(side[at] >> 1, token[at]), token[at + 2]), side[at] & 1, many)
    flow = np.bincount(side[at], minlength=2 * many).reshape(many, 2)[:, 0]
    out = []
    for i, ((n, m), (n_low, m_low), w, w_all, t, f, f_all) in enumerate(zip(sizes.tolist(), sizes_low.tolist(), weighted.tolist(), whole.tolist(), trees.tolist(), flows.tolist(), flow.tolist(), strict=True)):
        like = _bleu_of(code[i], n, m) + w / max(1, w_all) + t / max(1, n - 2) + (f / f_all if f_all else 1.0)
        out.append((_bleu_of(plain[i], n_low, m_low), like / 4))
    return out


#: Characters of the pairs whose tokens are counted at once.
AT_ONCE = 1 << 22


def bleus(reference: Column, found: Column) -> Column:
    """Both measures of a pair, null where either text is null."""

    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out: list[tuple] = [(None, None)] * len(a)
        some: list[int] = []
        x, y, held = a.tolist(), b.tolist(), 0

        def done() -> None:
            for i, both in zip(some, _bleus([(x[i], y[i]) for i in some]) if some else [], strict=True):
                out[i] = both
            some.clear()

        for i, (s, t) in enumerate(zip(x, y, strict=True)):
            if s is None or t is None:
                continue
            some.append(i)
            held += len(s) + len(t)
            if held >= AT_ONCE:
                done()
                held = 0
        done()
        return pd.DataFrame(out, columns=["bleu", "code_bleu"], dtype="float64")

    return F.pandas_udf(run, "bleu double, code_bleu double")(reference, found)


def likeness(a: Column, b: Column) -> Column:
    """Six measures at once: edit, jaccard, lines, bleu, code, and embedding, which is 0."""
    return F.struct(indel_ratio(a, b).alias("edit"), token_jaccard(a, b).alias("jaccard"), line_ratio(a, b).alias("lines"), bleu(a, b).alias("bleu"), code_bleu(a, b).alias("code"), F.lit(0.0).alias("embedding"))


# --- joins --------------------------------------------------------------------------------------------------------------
def edit_join(left: DataFrame, right: DataFrame, keys: list[str], text: str, least: float, pairs: Column | None = None) -> DataFrame:
    """Pairs within equal keys whose edit similarity is above ``least``: columns of both sides with l_ and r_, and ``similarity``.

    ``pairs``: a condition on l_ and r_ columns, e.g. an order, so that each pair of one table comes once. Only different texts of a key
    are compared, each two once, however many rows have them; what is alike is then dealt to its rows by key and text, which no
    broadcast may do, as few rows of a small file can have very many pairs. Lengths are compared first: a distance is at least the
    difference of lengths, so unlike lengths cost nothing.
    """
    a = left.select([F.col(c).alias(f"l_{c}") for c in left.columns])
    b = right.select([F.col(c).alias(f"r_{c}") for c in right.columns])
    texts = lambda rows, p: rows.where(F.col(text).isNotNull()).select(*(F.col(c).alias(f"__{p}_{c}") for c in dict.fromkeys([*keys, text]))).distinct()
    x, y = f"__l_{text}", f"__r_{text}"
    longer = F.greatest(F.char_length(x), F.char_length(y))
    near = F.abs(F.char_length(x) - F.char_length(y)) <= (1 - least) * longer
    known = texts(left, "l").hint("merge").join(texts(right, "r"), [*(F.col(f"__l_{k}").eqNullSafe(F.col(f"__r_{k}")) for k in keys), near])
    # The distance stops at its bound and is -1 then.
    distance = _bounded(F.col(x), F.col(y), least)
    rated = known.withColumn("similarity", F.when(longer == 0, 1.0).when(distance >= 0, 1 - distance / F.nullif(longer, F.lit(0)))).where(F.col("similarity") > least)
    on = lambda p: [F.col(f"__{p}_{k}").eqNullSafe(F.col(f"{p}_{k}")) for k in keys] + [F.col(f"__{p}_{text}") == F.col(f"{p}_{text}")]
    sides = rated.hint("merge").join(a, on("l")).hint("merge").join(b, [*on("r"), *([pairs] if pairs is not None else [])])
    return sides.select(*a.columns, *b.columns, "similarity")


def _bounded(a: Column, b: Column, least: float) -> Column:
    """The edit distance, -1 for one that no similarity above ``least`` allows. A threshold is a constant, so there is one for each power of two of lengths."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    out = F.levenshtein(a, b)
    for bits in range(16, -1, -1):
        out = F.when(longer < (1 << bits), F.levenshtein(a, b, math.ceil((1 - least) * (1 << bits)))).otherwise(out)
    return out


def nearest_vectors(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, block: int = 1024, digits: int = 6, wide: int = 4096) -> DataFrame:
    """q, key, s: for each query vector the ``k`` rows of greatest cosine, ties by key, itself left out.

    Queries are gathered in blocks of some ``block``, rows in blocks of some ``wide``; each pair of blocks is measured as a product of
    matrices, a few queries at a time, and gives k rows for a query. Nothing is broadcast. Pairs are all measured, so the work grows with
    queries times rows. Vectors that are null, have a null in them, length 0 or another dimension are like nothing and come last.
    """
    whole = F.when(~F.exists(vector, lambda x: x.isNull()), F.col(vector))

    def gathered(some: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
        some = some.where(F.col(key).isNotNull())
        many = max(1, -(-some.count() // size))
        dealt = some.select(F.pmod(F.xxhash64(key), F.lit(many)).alias("block"), F.struct(F.col(key).alias("key"), whole.alias("v")).alias("x"))
        return dealt.groupBy("block").agg(F.array_sort(F.collect_list("x")).alias(name)), many

    known, many = gathered(rows, wide, "known")
    asked = gathered(queries, block, "asked")[0].select("asked", F.explode(F.sequence(F.lit(0), F.lit(many - 1).cast("long"))).alias("block"))
    kind, schema = rows.schema[key].dataType.simpleString(), ["q", key, "s"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch["asked"], batch["known"], strict=True):
                i, j, s = _nearest(a.values, b.values, k, digits)
                yield pa.RecordBatch.from_arrays([a.values.field("key").take(i), b.values.field("key").take(j), s], names=schema)

    best = known.hint("merge").join(asked, "block").select("asked", "known").mapInArrow(run, f"q {kind}, `{key}` {kind}, s double")
    w = W.partitionBy("q").orderBy(F.desc_nulls_last("s"), key)
    return best.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")


def _matrix(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors as rows, their dimensions (-1 for null) and lengths."""
    sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), max(int(sizes.max(initial=0)), 1)))
    out[np.arange(out.shape[1]) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out, sizes, np.sqrt((out * out).sum(axis=1))


def _nearest(asked: pa.StructArray, known: pa.StructArray, k: int, digits: int, few: int = 64) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Places of the k nearest of ``known`` (in order of key) for each of ``asked``, with their cosines, ``few`` queries at a time."""
    nothing, itself = -8.0, -np.inf
    (a, a_size, a_long), (b, b_size, b_long) = _matrix(asked.field("v")), _matrix(known.field("v"))
    most = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, most - x.shape[1]))) for x in (a, b))
    own: dict = {}
    for j, x in enumerate(known.field("key").to_pylist()):
        own.setdefault(x, []).append(j)
    names, found = asked.field("key").to_pylist(), []
    for at in range(0, len(names), few):
        with np.errstate(all="ignore"):
            s = (a[at : at + few] @ b.T) / (a_long[at : at + few, None] * b_long)
        s[np.isnan(s)] = np.inf  # as Spark orders them
        s[(a_size[at : at + few, None] != b_size) | (a_long[at : at + few, None] == 0) | (b_long == 0)] = nothing
        for i, x in enumerate(names[at : at + few]):
            s[i, own.get(x, [])] = itself
        least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), itself)
        for i, row in enumerate(s):
            near = np.flatnonzero(row >= least[i] - 10.0**-digits)
            near = near[np.argsort(-np.round(row[near], digits), kind="stable")][:k]
            found += [(at + i, j, row[j]) for j in near if row[j] != itself]
    i, j, s = (np.array([x[c] for x in found], dtype=kind) for c, kind in enumerate(("int64", "int64", "float64")))
    rounded = np.where(np.isposinf(s), np.nan, np.round(s, digits) + 0.0)
    return pa.array(i), pa.array(j), pa.array(rounded, mask=s == nothing)


def best_match(pairs: DataFrame, keys: list[str], score: str, order: list[str]) -> DataFrame:
    """Of each key the pair of greatest score, the first of equal ones in ``order``."""
    w = W.partitionBy(*keys).orderBy(F.desc(score), *order)
    return pairs.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def moving_match(probes: pd.DataFrame, lines: list[str], least: float = 0.0) -> list[int]:
    """For each probe in order the line (from 0) most like it, searched from the last match on; -1 without one above ``least``."""
    start, out = 0, []
    for text in probes:
        best, at = least, -1
        for i in range(start, len(lines)):
            r = difflib.SequenceMatcher(None, text, lines[i]).ratio()
            if r > best:
                best, at = r, i
        out.append(at)
        start = at if at >= 0 else start
    return out


def moving_matches(probes: DataFrame, lines: DataFrame, keys: list[str], least: float = 0.0, shortest: int = 0) -> DataFrame:
    """moving_match for each key: probes (keys, ord, value) → ord and line_no (from 1; -1 without a match) among lines (keys, line_no,
    value). Probes of fewer characters than ``shortest``, stripped, are left out. A key's texts are one group, as the search is in order."""
    kinds = ", ".join(f"{k} {probes.schema[k].dataType.simpleString()}" for k in keys)
    asked = probes.where(F.char_length(F.trim("value")) >= shortest).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("p"))
    known = lines.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda x: x["value"]).alias("l"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *key, p, found in batch[[*keys, "p", "l"]].itertuples(index=False):
                at = moving_match([x["value"] for x in p], list(found) if found is not None else [], least)
                rows += [(*key, x["ord"], i + 1 if i >= 0 else -1) for x, i in zip(p, at, strict=True)]
            yield pd.DataFrame(rows, columns=[*keys, "ord", "line_no"])

    return asked.join(known, keys, "left").select(*keys, "p", "l").mapInPandas(run, f"{kinds}, ord {probes.schema['ord'].dataType.simpleString()}, line_no int")


def hunk_sets_match(pairs: DataFrame, keys: list[str], loose: float = 0.5, exact: float = 0.96, gap: int = 3) -> DataFrame:
    """Whether two sets of hunks are one change. pairs: keys, a_hunk, b_hunk, similarity, message (whether messages match).

    Either every hunk of one side has one above ``exact``; or messages match, counts differ by ``gap`` at most, and every
    hunk of one side has one above ``loose``. Sides without hunks have no pair and no row.
    """

    def side(x: str) -> DataFrame:
        best = pairs.groupBy(*keys, f"{x}_hunk").agg(F.max(F.coalesce("similarity", F.lit(0.0))).alias("s"), F.bool_or("message").alias("m"))
        return best.groupBy(*keys).agg(F.count("*").alias(f"{x}_n"), F.bool_and(F.col("s") > loose).alias(f"{x}_loose"), F.bool_and(F.col("s") > exact).alias(f"{x}_exact"), F.bool_or("m").alias(f"{x}_m"))

    both = side("a").join(side("b"), keys)
    like = (F.col("a_loose") | F.col("b_loose")) & (F.abs(F.col("a_n") - F.col("b_n")) <= gap) & F.col("a_m")
    return both.select(*keys, (like | F.col("a_exact") | F.col("b_exact")).alias("match"))


def message_matches(message: Column, patch: Column, case: Column, patch_message: Column, least: float = 0.96) -> Column:
    """A message that names the patch or the case and is neither revert nor merge, or is nearly the patch's own."""
    text = F.lower(message)
    names = (F.contains(message, patch) | F.contains(message, case)) & ~F.contains(text, F.lit("revert")) & ~F.contains(text, F.lit("merge"))
    return F.coalesce(names, F.lit(False)) | F.coalesce(edit_similarity(message, patch_message) > least, F.lit(False))
