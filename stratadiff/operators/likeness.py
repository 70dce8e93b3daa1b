"""Joins of alike texts by an index: few pairs reach the measure, and none that counts is missed.

The measure is twice the characters in matching blocks (Ratcliff and Obershelp) over both lengths. Blocks are in order, so where it is t or more, one
text comes from the other by at most (1 - t)(n + m) single characters put in or taken out. Taking one out destroys at most q runs of q
characters, putting one in at most q - 1; so of a text of n characters at most K(n) of its runs are missing in any text that is
alike (``most_gone``). If each text is known by its K + 1 rarest runs, in one order for all, two alike texts have one of them in common. Texts
with no more than K runs ("loose": short ones, or all for a low t) are compared by length instead. The order only has to be the same
for all, so counts of the ``COUNTED`` most frequent runs are enough, and any other run counts as rare.

Equal texts are settled first and stand for all their rows until the end. What is left is bounded by the runs that both texts have, and only
then measured, in Arrow batches. Long texts share some rare run with most others, so of these the bound, not the index, is what counts.
"""

from __future__ import annotations

import difflib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratadiff.operators.graphs import _cut, _dealt
from stratadiff.operators.similarity import _indel

#: Characters of a run of the index, and of one that pairs are checked by; runs whose counts are known to all tasks.
Q, CHECKED, COUNTED = 2, 3, 20_000


def runs_of(text: str, q: int = Q) -> list[str]:
    return [text[i : i + q] for i in range(len(text) - q + 1)]


def most_gone(n: int, least: float, q: int = Q) -> int:
    """The most runs of a text of n characters that a text alike may not have. With D characters taken out and I put in,
    D (2 - t) + I t <= 2 n (1 - t), and q D + (q - 1) I runs go."""
    if least <= 0:
        return n
    return math.floor(2 * n * (1 - least) * max(q / (2 - least), (q - 1) / least) + 1e-9)


def tokens_of(text: str, least: float, order: dict[str, int], q: int = Q) -> list[str] | None:
    """The rarest runs of a text, the i-th equal one with its number; None for a loose text."""
    gone, seen, every = most_gone(len(text), least, q), Counter(), []
    for run in runs_of(text, q):
        seen[run] += 1
        every.append((order.get(run, 0), -seen[run], run))
    if len(every) <= gone:
        return None
    every.sort()
    return [f"{-i}{run}" for _, i, run in every[: gone + 1]]


def possible(a: str, b: str, runs_a: Counter, runs_b: Counter, least: float, q: int = CHECKED) -> bool:
    """Whether texts may be alike, by how many runs of each (``runs_of``, counted) the other one has."""
    n, m = len(a), len(b)
    edits = (1 - least) * (n + m) + 1e-9
    out, in_ = max(0.0, (edits + n - m) / 2), max(0.0, (edits - n + m) / 2)
    common = sum((runs_a & runs_b).values())
    return n - q + 1 - common <= q * out + (q - 1) * in_ and m - q + 1 - common <= q * in_ + (q - 1) * out


def _counts(texts: DataFrame) -> dict[str, int]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: Counter = Counter()
            for t in batch["text"]:
                found.update(runs_of(t))
            yield pd.DataFrame(list(found.items()), columns=["run", "n"])

    counted = texts.select("text").mapInPandas(run, "run string, n long").groupBy("run").agg(F.sum("n").alias("n"))
    return {r["run"]: r["n"] for r in counted.orderBy(F.desc("n"), "run").limit(COUNTED).collect()}


def _tokens(texts: DataFrame, least: float, order: dict[str, int]) -> DataFrame:
    """id, group, size, token of each distinct text; a loose one has one null token."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, g, len(t), token) for i, g, t in batch[["id", "group", "text"]].itertuples(index=False) for token in tokens_of(t, least, order) or [None]]
            yield pd.DataFrame(rows, columns=["id", "group", "size", "token"])

    return texts.select("id", "group", "text").mapInPandas(run, "id long, group long, size int, token string")


def _measured(pairs: DataFrame, least: float, strict: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept, known = [], {}

            def counted(t: str, known: dict[str, Counter] = known) -> Counter:
                if t not in known:
                    known[t] = Counter(runs_of(t, CHECKED))
                return known[t]

            for row in batch[["l_id", "r_id", "l_text", "r_text"]].itertuples(index=False):
                if possible(row.l_text, row.r_text, counted(row.l_text), counted(row.r_text), least):
                    ratio = difflib.SequenceMatcher(None, row.l_text, row.r_text).ratio()
                    if ratio > least or (not strict and ratio == least):
                        kept.append((row.l_id, row.r_id, ratio))
            yield pd.DataFrame(kept, columns=["l_id", "r_id", "similarity"])

    return pairs.mapInPandas(run, "l_id long, r_id long, similarity double")


def near_lengths(a: Column, b: Column, least: float) -> Column:
    return 2 * F.least(a, b) >= least * (a + b)


def candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """l_id, r_id of the pairs of distinct texts (id, group, text) that must be measured: same group, unlike, no pair that counts is missing."""
    order = _counts(left.unionByName(right))
    side = lambda texts, p: _cut(_tokens(texts, least, order)).select(*(F.col(c).alias(f"{p}_{c}") for c in ("id", "size", "token")), "group")
    a, b = side(left, "l"), side(right, "r")
    near = near_lengths(F.col("l_size"), F.col("r_size"), least)
    known = lambda rows, p: rows.where(F.col(f"{p}_token").isNotNull())
    loose = lambda rows, p: rows.where(F.col(f"{p}_token").isNull())
    same = known(a, "l").withColumnRenamed("l_token", "token").join(known(b, "r").withColumnRenamed("r_token", "token"), ["group", "token"]).where(near)
    whole = lambda rows, p: rows.select("group", f"{p}_id", f"{p}_size").distinct()
    short = loose(a, "l").join(whole(b, "r"), "group").where(near).select("l_id", "r_id")
    other = whole(known(a, "l"), "l").join(loose(b, "r"), "group").where(near).select("l_id", "r_id")
    return same.select("l_id", "r_id").unionByName(short).unionByName(other).distinct()


#: Rows and characters of a block of texts.
BLOCK, BLOCK_SIZE = 1 << 16, 1 << 24
#: From this length on of the right text the library starts blocks only at characters that aren't popular in it (its ``autojunk``).
POPULAR = 200
#: By length of the texts of a block, from ``POPULAR`` on: the characters and bins of the runs that all texts are screened by, and of those for
#: what is left. Shorter texts are told apart by single characters first, as their blocks may be many.
BINS, BINS_SHORT = ((480, 3, 128, 3, 512), (1200, 3, 256, 4, 2048), (2400, 3, 512, 4, 2048), (math.inf, 3, 1024, 4, 8192)), (1, 64, 3, 1024)
#: Counters held at once while a block is binned.
COUNTERS = 1 << 22


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, one after another, and where each text begins (and the last ends)."""
    ends = np.cumsum([0, *map(len, texts)])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), ends


def _counted(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, many: int, kind: type) -> np.ndarray:
    """How often each of ``many`` values stands in values[start:end] of each text, a row for each, made some rows at a time."""
    out, step = [], max(1, COUNTERS // many)
    for at in range(0, len(starts), step):
        a, b = starts[at : at + step], ends[at : at + step]
        sizes = np.maximum(b - a, 0)
        place = np.repeat(a - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        rows = np.repeat(np.arange(len(a)) * many, sizes)
        out.append(np.bincount(rows + values[place], minlength=len(a) * many).reshape(len(a), many).astype(kind))
    return np.concatenate(out)


def binned(codes: np.ndarray, ends: np.ndarray, q: int, many: int, kind: type) -> np.ndarray:
    """How many runs of q characters of each text fall into each bin. Two texts have at most as many runs in common as their bins have."""
    if q == 1:
        return _counted(codes % np.uint32(many), ends[:-1], ends[1:], many, kind)
    mixed = np.zeros(max(0, len(codes) - q + 1), dtype=np.uint32)
    for i in range(q):
        mixed = (mixed + codes[i : len(codes) - q + 1 + i]) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
    return _counted(mixed % np.uint32(many), ends[:-1], ends[1:] - q + 1, many, kind)


def _most_blocks(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The most matching blocks that the library can find in each text as the right one. In one of ``POPULAR`` characters or more each
    block holds a character that isn't popular there, but for one at the start of both texts. Shorter ones may have any number."""
    sizes = np.diff(ends)
    out = np.full(len(sizes), np.iinfo(np.int64).max)
    long = np.flatnonzero(sizes >= POPULAR)
    if not len(long):
        return out
    names = np.zeros(int(codes.max()) + 1, dtype=np.uint32)
    names[codes] = 1
    many, names = int(names.sum()), (np.cumsum(names) - 1).astype(np.uint32)
    named, rare = names[codes], sizes // 100 + 1
    step = max(1, COUNTERS // many)
    for at in range(0, len(long), step):
        some = long[at : at + step]
        held = _counted(named, ends[some], ends[some + 1], many, np.int64)
        out[some] = 1 + np.where(held <= rare[some, None], held, 0).sum(axis=1)
    return out


def _compared(left: pd.DataFrame, right: pd.DataFrame, least: float, strict: bool) -> Iterator[tuple]:
    """(l_id, r_id, ratio) of the alike, unlike texts of two blocks.

    Matching blocks of M characters in k blocks hold M - k (q - 1) runs of q characters or more, and M is least (n + m) / 2 at least where
    texts are alike. There is a gap of a character or more between two blocks, so there are at most 1 + n + m - 2 M, and no more than
    ``_most_blocks``. All texts of the right block are screened at once by few bins of short runs, what is left by more bins, then by the
    longest common subsequence, which holds all matching blocks, and only then measured.
    """
    right = right.assign(size=right["text"].str.len()).sort_values("size")
    left = left.assign(size=left["text"].str.len()).sort_values("size")
    sizes, texts, ids = right["size"].to_numpy(np.int64), right["text"].tolist(), right["id"].tolist()
    widest = (2 - least) / least
    q, many, q2, many2 = BINS_SHORT if sizes[0] < POPULAR else next(x[1:] for x in BINS if sizes[-1] < x[0])
    kind = np.uint8 if q == 1 and sizes[-1] < 256 else np.int16 if sizes[-1] < 1 << 15 else np.int32
    codes, ends = _codes(texts)
    blocks = _most_blocks(codes, ends)
    coarse = np.ascontiguousarray(binned(codes, ends, q, many, kind).T)
    fine = binned(codes, ends, q2, many2, kind)
    del codes
    # Half of the least sum of lengths for each side apart, so that a text's bound is one number; both rounded down.
    gaps = np.floor((1 - least) * sizes * (1 + widest) + 1e-6).astype(np.int64)
    bound = np.floor(least * sizes / 2 - 1e-6).astype(np.int64) - (q - 1) * (1 + np.minimum(blocks - 1, gaps))
    bound = np.maximum(bound, 0 if q == 1 else np.iinfo(kind).min // 2).astype(kind)
    room, one = np.empty(len(texts), dtype=kind), np.empty(len(texts), dtype=kind)
    for l_id, text, n in zip(left["id"].tolist(), left["text"].tolist(), left["size"].tolist(), strict=True):
        a, b = np.searchsorted(sizes, n / widest - 1e-6), np.searchsorted(sizes, n * widest + 1e-6, "right")
        if a >= b:
            continue
        own_codes, own_ends = _codes([text])
        own = np.minimum(binned(own_codes, own_ends, q, many, np.int64)[0], np.iinfo(kind).max)
        common, one_ = room[: b - a], one[: b - a]
        common[:] = 0
        for j in np.flatnonzero(own):
            np.minimum(coarse[j, a:b], kind(own[j]), out=one_)
            np.add(common, one_, out=common)
        np.add(bound[a:b], kind(max(0, math.floor(least * n / 2 - 1e-6))), out=one_)
        found = np.flatnonzero(common >= one_) + a
        if not len(found):
            continue
        own = np.minimum(binned(own_codes, own_ends, q2, many2, np.int64)[0], np.iinfo(kind).max)
        held = np.flatnonzero(own)
        for some in np.array_split(found, 1 + len(found) // 4096):
            m = sizes[some]
            shared = np.minimum(fine[some[:, None], held], own[held].astype(kind)).sum(axis=1, dtype=np.int64)
            most = np.minimum(blocks[some], 1 + np.floor((1 - least) * (n + m) + 1e-6).astype(np.int64))
            for i in some[shared + (q2 - 1) * most >= least * (n + m) / 2 - 1e-6]:
                if texts[i] != text and _indel(text, texts[i]) >= least:
                    ratio = difflib.SequenceMatcher(None, text, texts[i]).ratio()
                    if ratio > least or (not strict and ratio == least):
                        yield l_id, ids[i], ratio


def screened(left: DataFrame, right: DataFrame, least: float, strict: bool) -> DataFrame:
    """l_id, r_id, similarity of alike texts (id, group, text) of a group, equal ones left out: for few texts against very many of few
    groups, where runs of the index are too common to tell anything. ``least`` is above 0.

    Texts are dealt by bands of length, each as wide as alike texts may differ, so a text of the left side meets its own band and
    its two neighbours. A band of the right side is dealt to blocks, each of which gets all left texts of the band.
    """
    width = math.log(1.01 * (2 - least) / least)
    band = F.floor(F.log(F.char_length("text").cast("double")) / width).cast("int")
    many = right.where("text <> ''").withColumn("band", band)
    blocks = many.groupBy("group", "band").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.char_length("text")) / BLOCK_SIZE)).cast("int").alias("blocks"))
    dealt = many.join(blocks, ["group", "band"]).select("group", "band", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id", "text")
    few = left.where("text <> ''").select("group", F.explode(F.array(band - 1, band, band + 1)).alias("band"), "id", "text")
    asked = few.join(blocks, ["group", "band"]).select("group", "band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "text")
    by = ["group", "band", "block"]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(_compared(a, b, least, strict)) if len(a) and len(b) else [], columns=["l_id", "r_id", "similarity"])

    return _dealt(asked, *by).groupBy(*by).cogroup(_dealt(dealt, *by).groupBy(*by)).applyInPandas(run, "l_id long, r_id long, similarity double")


def alike(left: DataFrame, right: DataFrame, keys: list[str], text: str, least: float, strict: bool = True, screen: bool = False) -> DataFrame:
    """l_id, r_id, similarity and the tables of distinct texts as (pairs, left texts, right texts): texts have keys, id, text, rows (how many).

    ``pairs`` are all pairs of texts of equal keys (null is equal to null) whose measure is above ``least`` (or equal, if not
    strict); null texts are like nothing, two empty ones are equal. ``screen``: by blocks of lengths (``screened``), not by the index.
    """
    of = lambda rows: rows.where(F.col(text).isNotNull()).groupBy(*keys, F.col(text).alias("text")).agg(F.count("*").alias("rows"))
    numbered = lambda rows: _cut(of(rows).withColumn("id", F.monotonically_increasing_id()).withColumn("group", F.xxhash64(*keys) if keys else F.lit(0).cast("long")))
    a, b = numbered(left), numbered(right)
    x, y = a.select(*(F.col(c).alias(f"l_{c}") for c in a.columns)), b.select(*(F.col(c).alias(f"r_{c}") for c in b.columns))
    agree = [x[f"l_{k}"].eqNullSafe(y[f"r_{k}"]) for k in keys]
    equal = x.join(y, [*agree, x["l_text"] == y["r_text"]]).select("l_id", "r_id", F.lit(1.0).alias("similarity"))
    same_keys = lambda rows: rows.where(F.lit(True) if not keys else F.forall(F.array(*(F.col(f"l_{k}").eqNullSafe(F.col(f"r_{k}")) for k in keys)), lambda same: same))  # noqa: E731  # groups are hashes of keys
    if screen and least > 0:
        found = same_keys(_cut(screened(a, b, least, strict)).join(x.drop("l_text"), "l_id").join(y.drop("r_text"), "r_id")).select("l_id", "r_id", "similarity")
    else:
        tried = same_keys(candidates(a, b, least).join(x, "l_id").join(y, "r_id").where("l_text <> r_text"))
        found = _measured(tried.select("l_id", "r_id", "l_text", "r_text"), least, strict)
    return found.unionByName(equal if not strict or least < 1 else equal.limit(0)), a, b


def alike_rows(left: DataFrame, right: DataFrame, keys: list[str], text: str, least: float, strict: bool = True, screen: bool = False) -> DataFrame:
    """The left rows whose texts are alike to that of any right row, with ``same`` and ``near``: how many right rows have the same text and how
    many an alike, unlike one, and ``nearest``, the greatest similarity of the latter. Pairs of texts are counted, never pairs of rows."""
    pairs, a, b = alike(left, right, keys, text, least, strict, screen)
    same = F.col("similarity") == 1
    held = pairs.join(b.select(F.col("id").alias("r_id"), "rows"), "r_id").groupBy(F.col("l_id").alias("id"))
    found = held.agg(F.sum(F.when(same, F.col("rows")).otherwise(0)).alias("same"), F.sum(F.when(same, 0).otherwise(F.col("rows"))).alias("near"), F.max(F.when(~same, F.col("similarity"))).alias("nearest"))
    texts = found.join(a, "id").select(*(F.col(c).alias(f"__{c}") for c in [*keys, "text"]), "same", "near", "nearest")
    return left.join(texts, [*(left[k].eqNullSafe(texts[f"__{k}"]) for k in keys), left[text] == texts["__text"]]).drop(*(f"__{c}" for c in [*keys, "text"]))


def ratio_join(left: DataFrame, right: DataFrame, keys: list[str], text: str, least: float, strict: bool = True, screen: bool = False) -> DataFrame:
    """All pairs of rows of equal keys whose texts are alike: columns of both sides with l_ and r_, and ``similarity``."""
    pairs, a, b = alike(left, right, keys, text, least, strict, screen)

    def rows(table: DataFrame, texts: DataFrame, p: str) -> DataFrame:
        named = table.select([F.col(c).alias(f"{p}_{c}") for c in table.columns])
        ids = texts.select("id", *(F.col(c).alias(f"__{c}") for c in [*keys, "text"])).withColumnRenamed("id", f"__{p}_id")
        on = [named[f"{p}_{k}"].eqNullSafe(ids[f"__{k}"]) for k in keys]
        return named.hint("merge").join(ids, [*on, named[f"{p}_{text}"] == ids["__text"]]).drop(*(f"__{c}" for c in [*keys, "text"]))

    by = pairs.select(F.col("l_id").alias("__l_id"), F.col("r_id").alias("__r_id"), "similarity")
    # Few bytes of a file can have very many pairs, so rows are dealt by text, not sent whole to the few tasks that read the file.
    joined = by.hint("merge").join(rows(left, a, "l"), "__l_id").hint("merge").join(rows(right, b, "r"), "__r_id")
    return joined.select(*(f"l_{c}" for c in left.columns), *(f"r_{c}" for c in right.columns), "similarity")
