"""Substring dedup by sliding sentence spans.

A span is a run of consecutive sentences (long ones cut into parts): from each sentence on, the least number of sentences, two at
least, that have ``LEAST_WORDS`` words together, and likewise back from each sentence (so the end of a repeated passage is
covered). Every longer run is made up of these, so what repeats over more sentences is found by its parts. All spans are hashed
and joined globally; a span's first place is that in the document of the lowest key, and sentences that any later place covers
are removed.

Repeats of ``LEAST_RUN`` words or more are found wherever they begin, sentences or not: of any ``STEP`` windows of
``WINDOW`` words in a row the one of the least hash is chosen, so equal runs have an equal window, and each is compared
word by word with its first place, as far to both sides as the next chosen window can be. What a run covers beyond
removed sentences is removed too, also parts of sentences, if it has ``LEAST_PART`` words together.

1. One Python pass writes a row of hashes for each document; documents and hashes are aggregated on each partition before the
   shuffle that tells which hashes two documents have.
2. Bit arrays of bounded size pick the documents that may hold such a hash. Only these are read again, with the places of their
   spans; a bit array drops most spans that occur once, and a join, which splits a hash that a third of all documents have,
   settles the rest.
3. Chosen windows that sentences don't explain already, with all words that could be found from them, are compared with
   their first places: only these are read a third time, with the words around them.
4. Texts of documents that lose something, and of few others, are shuffled to their places; all others stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_array, bit_set, bits_for, cut, let, table
from .words import Runs, Words, raw, slices

LEAST_WORDS, LEAST_SENTENCES = 24, 2
#: A sentence of more words is cut after each so many, so a passage without marks is several sentences too.
MOST_WORDS = 20
#: Words of a run that is a repeat at any place, of its hashed windows, windows of which one is chosen, words to compare beyond one.
LEAST_RUN, WINDOW = 50, 24
STEP = LEAST_RUN - WINDOW + 1
REACH = STEP - 1
#: Fewer words together than this, at the edge of a run beside removed sentences, stay.
LEAST_PART = 10
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in ".!?"]] = True


class Layout(Words):
    """Words and sentences of some texts, one after another.

    firsts: the first word of each sentence, and the number of words after the last; text: that of each word. A sentence ends with a
    word that ends in . ! or ?, with a line, and after ``MOST_WORDS`` words. Case does not count.
    """

    def __init__(self, texts: list[str | None]):
        super().__init__([raw(t.lower()) if t else b"" for t in texts])
        n = len(self.hashes)
        new = np.ones(n, bool)
        if n:
            lines = np.cumsum(self.bytes == 10)
            new[1:] = _MARKS[self.bytes[self.ends[:-1] - 1]] | (lines[self.starts[1:]] > lines[self.starts[:-1]])
        at = np.arange(n)
        new |= (at - np.maximum.accumulate(np.where(new, at, 0))) % MOST_WORDS == 0
        self.firsts = np.append(np.flatnonzero(new), n)
        self.text = np.repeat(np.arange(len(texts)), self.upto - self.begin)
        self.runs = Runs(self.hashes)

    def spans(self, least_words: int, least_sentences: int) -> tuple[np.ndarray, np.ndarray]:
        """The first word of each span and the one after its last, in order."""
        f, m = self.firsts, len(self.firsts) - 1
        a = np.arange(m)
        b = np.maximum(np.searchsorted(f, f[:-1] + least_words), a + least_sentences)
        fits = b <= m
        fits[fits] = f[b[fits]] <= self.upto[self.text[f[a[fits]]]]
        e = np.arange(1, m + 1)
        back = np.minimum(np.searchsorted(f, f[1:] - least_words, side="right") - 1, e - least_sentences)
        well = back >= 0
        well[well] = f[back[well]] >= self.begin[self.text[f[e[well] - 1]]]
        both = np.unique(np.concatenate([a[fits] * (m + 1) + b[fits], back[well] * (m + 1) + e[well]]))
        return f[both // (m + 1)], f[both % (m + 1)]

    def window_hashes(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the windows, never that of a span of the same words."""
        return ~self.runs.hashes(at, at + WINDOW)

    def windows(self) -> np.ndarray:
        """The first words of the chosen windows, in order."""
        n = len(self.hashes)
        if n < LEAST_RUN:
            return np.zeros(0, np.int64)
        at = np.arange(n - WINDOW + 1)
        h = self.runs.hashes(at, at + WINDOW) | np.uint64(1)
        least = _slid(h, STEP, np.minimum)
        least[at[: len(least)] + LEAST_RUN > self.upto[self.text[: len(least)]]] = 0  # over the end of a text
        edge = np.zeros(REACH, np.uint64)
        return np.flatnonzero(_slid(np.concatenate([edge, least, edge]), STEP, np.maximum) == h)

    def around(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the words before each window (nearest first) and after it; 0 where the text ends."""
        near = np.concatenate([-1 - np.arange(REACH), WINDOW + np.arange(REACH)]) + at[:, None]
        text = self.text[at][:, None]
        inside = (near >= self.begin[text]) & (near < self.upto[text])
        return np.where(inside, (self.hashes >> np.uint64(32)).astype(np.uint32)[np.where(inside, near, 0)] | np.uint32(1), np.uint32(0))


def _slid(x: np.ndarray, n: int, f: Callable) -> np.ndarray:
    """``f`` over each ``n`` neighbours."""
    size = 1
    while 2 * size <= n:
        x, size = f(x[:-size], x[size:]), 2 * size
    return f(x[: len(x) - n + size], x[n - size :]) if size < n else x


def _alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words in common before and after windows, from their surroundings."""
    same = (a == b) & (a != 0)
    return np.logical_and.accumulate(same[:, :REACH], axis=1).sum(axis=1), np.logical_and.accumulate(same[:, REACH:], axis=1).sum(axis=1)


def _firsts(text: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each place, the number of the first one with its hash in its text."""
    order = np.lexsort((h, text))  # stable, so equal ones stay in order
    new = np.ones(len(h), bool)
    new[1:] = (text[order][1:] != text[order][:-1]) | (h[order][1:] != h[order][:-1])
    first = np.empty(len(h), np.int64)
    first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
    return first


def _hashes(docs: DataFrame, least_words: int, least_sentences: int) -> DataFrame:
    """k, r, hashes (of spans and chosen windows) and own (whether the document repeats itself) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for some in slices(batches, 2):
                x = Layout(some.column(2).to_pylist())
                a, b = x.spans(least_words, least_sentences)
                at = x.windows()
                text = np.concatenate([x.text[a], x.text[at]])
                h = np.concatenate([x.runs.hashes(a, b), x.window_hashes(at)])
                order = np.lexsort((h, text))
                text, h = text[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
                own = np.zeros(some.num_rows, bool)
                own[text[~new]] = True
                ends = np.concatenate([[0], np.cumsum(np.bincount(text[new], minlength=some.num_rows))])
                lists = pa.ListArray.from_arrays(ends.astype(np.int32), h[new].view(np.int64))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), lists, pa.array(own)], ["k", "r", "hashes", "own"])

    return docs.select(*_keys(docs), F.col("text")).mapInArrow(run, "k long, r long, hashes array<long>, own boolean")


#: What a row of ``_exploded`` is.
SPAN, PLACE, OWN = 0, 1, 2


def _exploded(docs: DataFrame, least_words: int, least_sentences: int) -> DataFrame:
    """h, k, r, first, n, size, kind, own for each span and chosen window, and for each run that a text has before. k: the document's
    place in order; r: the row; first and n: words; size: words of the text. A text's own run (kind OWN) is one that begins
    ``LEAST_RUN`` words or more after its first place; own: whether the text has the span before."""
    names = ["h", "k", "r", "first", "n", "size", "kind", "own"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for some in slices(batches, 2):
                x = Layout(some.column(2).to_pylist())
                k, r = (some.column(i).to_numpy() for i in (0, 1))

                def rows(text: np.ndarray, h: np.ndarray, first: np.ndarray, n: np.ndarray, kind: int, own: np.ndarray) -> pa.RecordBatch:
                    numbers = (pa.array(v, pa.int32()) for v in (first - x.begin[text], n, (x.upto - x.begin)[text], np.full(len(h), kind)))  # noqa: B023
                    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(k[text]), pa.array(r[text]), *numbers, pa.array(own)], names)  # noqa: B023

                a, b = x.spans(least_words, least_sentences)
                text, h = x.text[a], x.runs.hashes(a, b)
                yield rows(text, h, a, b - a, SPAN, _firsts(text, h) < np.arange(len(h)))
                at = x.windows()
                text, h = x.text[at], x.window_hashes(at)
                yield rows(text, h, at, np.full(len(at), WINDOW), PLACE, np.zeros(len(at), bool))
                first = _firsts(text, h)
                own = np.flatnonzero(at - at[first] >= LEAST_RUN)
                left, right = _alike(x.around(at[own]), x.around(at[first[own]]))
                long = left + WINDOW + right >= LEAST_RUN
                own, left, right = own[long], left[long], right[long]
                yield rows(text[own], np.zeros(len(own), np.uint64), at[own] - left, left + WINDOW + right, OWN, np.ones(len(own), bool))

    return docs.select(*_keys(docs), F.col("text")).mapInArrow(run, "h long, k long, r long, first int, n int, size int, kind int, own boolean")


def _around(docs: DataFrame) -> DataFrame:
    """h, k, r, first and around (words on both sides, see Layout) of each chosen window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for some in slices(batches, 2):
                x = Layout(some.column(2).to_pylist())
                at = x.windows()
                text = x.text[at]
                k, r = (pa.array(some.column(i).to_numpy()[text]) for i in (0, 1))
                around, size = x.around(at), 8 * REACH
                bytes_ = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.arange(len(at) + 1) * size).astype(np.int32).tobytes()), pa.py_buffer(around.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(x.window_hashes(at).view(np.int64)), k, r, pa.array(at - x.begin[text], pa.int32()), bytes_], ["h", "k", "r", "first", "around"])

    return docs.select(*_keys(docs), F.col("text")).mapInArrow(run, "h long, k long, r long, first int, around binary")


def _unexplained(size: pd.Series, spans: pd.Series, windows: pd.Series) -> pd.Series:
    """The windows (struct h, first) from which words outside of ``spans`` (struct first, n) could be found."""
    out = []
    for n, some, places in zip(size, spans, windows, strict=True):
        change = np.zeros(n + 1, np.int64)
        for s in some:
            change[s["first"]] += 1
            change[s["first"] + s["n"]] -= 1
        stays = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) == 0)])
        out.append([w for w in places if stays[min(n, w["first"] + WINDOW + REACH)] > stays[max(0, w["first"] - REACH)]])
    return pd.Series(out)


def _run(first: pd.Series, around: pd.Series, other: pd.Series) -> pd.DataFrame:
    """The words from first on that a window and its first place have in common; n is 0 for fewer than ``LEAST_RUN``."""
    sides = (np.frombuffer(b"".join(x), np.uint32).reshape(-1, 2 * REACH) for x in (around, other))
    before, after = _alike(*sides)
    n = before + WINDOW + after
    return pd.DataFrame({"first": (first.to_numpy() - before).astype(np.int32), "n": np.where(n >= LEAST_RUN, n, 0).astype(np.int32)})


def _keys(docs: DataFrame) -> tuple[Column, Column]:
    """Order of documents: doc_id, then those without by the hash of their text. And what tells rows apart."""
    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 2))
    return k.alias("k"), F.xxhash64("doc_id", "text").alias("r")


def without(text: str, places: list[dict]) -> tuple[str, int, int]:
    """The text without ``places`` (kind, first, n), its sentences, and how many of them went. Parts of a sentence count as sentences."""
    x, data = Layout([text]), raw(text)
    n = len(x.hashes)
    gone, fresh = np.zeros(n, bool), np.zeros(n, bool)
    for p in places:
        (gone if p["kind"] == SPAN else fresh)[p["first"] : p["first"] + p["n"]] = True
    fresh &= ~gone
    edges = np.flatnonzero(np.diff(fresh, prepend=False, append=False))
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        if b - a < LEAST_PART:
            fresh[a:b] = False
    gone |= fresh
    parts = np.union1d(x.firsts[:-1], np.flatnonzero(np.diff(gone)) + 1)
    at = Words([data]).starts if n else np.zeros(0, np.int64)  # in the text as it is: lower case may have other bytes
    at = np.concatenate([[0], at[1:], [len(data)]])
    edges = np.flatnonzero(np.diff(~gone, prepend=False, append=False))
    kept = b"".join(data[at[a] : at[b]] for a, b in zip(edges[::2], edges[1::2], strict=True)) if n else data
    return kept.decode("utf-8", "surrogatepass"), max(len(parts), 1), int(gone[parts].sum()) if n else 0


def _without(text: pd.Series, places: pd.Series) -> pd.DataFrame:
    with np.errstate(over="ignore"):
        rows = [without(t, some) if t else (t, 0, 0) for t, some in zip(text, places, strict=True)]
    return pd.DataFrame(rows, columns=["text", "n_sentences", "n_removed"])


def _count(texts: pd.Series) -> pd.Series:
    """Sentences of each text."""
    out = []
    with np.errstate(over="ignore"):
        for at in range(0, len(texts), 200):
            some = texts.iloc[at : at + 200].tolist()
            x = Layout(some)
            counts = np.diff(np.searchsorted(x.firsts[:-1], np.append(x.begin, len(x.hashes))))
            out.append(np.maximum(counts, [bool(t) for t in some]))
    return pd.Series(np.concatenate(out) if out else np.zeros(0, np.int64), dtype="int64")


def _where_bits(rows: DataFrame, key: Column, among: DataFrame, column: str, each: int = 16) -> DataFrame:
    """``rows`` whose ``key`` may be among the values of ``column``: a bit array of bounded size tells, with few wrong hits."""
    size = bits_for(among.count(), each, 1 << 16)
    marked = rows.select("*", key.alias("_key"), bit_array(among, column, size).scalar().alias("_bits"))
    return marked.where(bit_set(F.col("_bits"), F.col("_key"), size)).drop("_key", "_bits")


def _runs(docs: DataFrame, again: DataFrame) -> DataFrame:
    """k, r, kind, first, n of the runs of ``LEAST_RUN`` words or more that a document before also has, beyond what spans explain."""
    later = again.where(F.col("later") & (F.col("kind") != OWN) | F.col("own"))
    spans = F.collect_list(F.when(F.col("kind") != PLACE, F.struct("first", "n"))).alias("spans")
    windows = F.collect_list(F.when(F.col("kind") == PLACE, F.struct("h", "first"))).alias("windows")
    each = later.groupBy("k", "r").agg(F.max("size").alias("size"), spans, windows).where(F.size("windows") > 0)
    unexplained = F.pandas_udf(_unexplained, "array<struct<h long, first int>>")
    asked = cut(each.select("k", "r", F.explode(unexplained("size", "spans", "windows")).alias("x")).select("k", "r", "x.h", "x.first"))
    wanted = cut(asked.groupBy("h").agg(F.count("*").alias("asked")))
    firsts = again.where((F.col("kind") == PLACE) & ~F.col("later")).join(wanted, "h").groupBy("h").agg(F.min(F.struct("k", "r", "first")).alias("x"))
    firsts = cut(firsts.select("h", "x.k", "x.r", "x.first"))
    place = F.xxhash64("k", "r", "first")
    places = asked.select("r", place.alias("at")).unionByName(firsts.select("r", place.alias("at")))
    some = _where_bits(docs.select("doc_id", "text", _keys(docs)[1]), F.col("r"), cut(places.select("r").distinct()), "r")
    around = cut(_where_bits(_around(some.select("doc_id", "text")), place, cut(places.select("at").distinct()), "at"))
    other = cut(around.join(firsts, ["h", "k", "r", "first"]).select("h", F.col("around").alias("other")).dropDuplicates(["h"]))
    both = around.join(asked, ["h", "k", "r", "first"], "left_semi").select("h", "k", "r", "first", "around").join(other, "h")
    run = F.pandas_udf(_run, "first int, n int")
    return both.select("k", "r", run("first", "around", "other").alias("x")).where("x.n > 0").select("k", "r", F.lit(PLACE).alias("kind"), "x.first", "x.n")


def remove_repeats(docs: DataFrame, least_words: int = LEAST_WORDS, least_sentences: int = LEAST_SENTENCES) -> DataFrame:
    """Each row of ``docs`` (all columns, as struct ``row``) with what is left, in struct ``left``: text, n_sentences, n_removed.

    Of equal spans the one of the lowest doc_id stays (without doc_id: after all others), in a document the first.
    Rows with the same doc_id count as one document: they lose what other documents have before and what they repeat
    themselves, not what they share. Null and empty texts have no sentence and stay; a text without words is one sentence and
    stays; an empty table stays empty. Where a run of words begins or ends inside a sentence and the part in it goes, each part
    counts as a sentence. Memory of a task grows with the longest text alone. Other columns may have any names.
    """
    hashes = cut(_hashes(docs, least_words, least_sentences))
    known = hashes.select(F.explode("hashes").alias("h"), "k").groupBy("h").agg(F.min("k").alias("low"), F.max("k").alias("high"))
    known = cut(known.where("low < high").select("h", "low"))
    size = bits_for(known.count(), 16, 1 << 16)
    marked = hashes.select("r", "own", "hashes", bit_array(known, "h", size).scalar().alias("bits"))
    held = cut(marked.where(F.col("own") | let(F.col("bits"), lambda bits: F.exists("hashes", lambda h: bit_set(bits, h, size)))).select("r"))
    some = _where_bits(docs.select("doc_id", "text", _keys(docs)[1]), F.col("r"), held, "r").select("doc_id", "text")
    every = _exploded(some, least_words, least_sentences)
    maybe = every.select("*", bit_array(known, "h", size).scalar().alias("bits")).where(F.col("own") | bit_set(F.col("bits"), F.col("h"), size)).drop("bits")
    again = maybe.join(known, "h", "left").select("h", "k", "r", "first", "n", "size", "kind", "own", (F.col("low") < F.col("k")).alias("later"))
    again = cut(again.where(F.col("own") | F.col("later") | (F.col("kind") == PLACE) & F.col("later").isNotNull()).withColumn("later", F.coalesce("later", F.lit(False))))
    names = ["k", "r", "kind", "first", "n"]  # k and r together tell rows apart
    places = again.where((F.col("kind") != PLACE) & (F.col("later") | F.col("own"))).select(*names).unionByName(_runs(docs, again).select(*names))
    places = cut(places.groupBy("k", "r").agg(F.collect_set(F.struct("kind", "first", "n")).alias("places")))
    losers = bits_for(places.count(), 16, 1 << 16)
    rows = docs.select(F.struct("*").alias("row"), *_keys(docs), bit_array(places, "r", losers).scalar().alias("bits"))
    doubtful = bit_set(F.col("bits"), F.col("r"), losers)
    count, cleaned = F.pandas_udf(_count, "long"), F.pandas_udf(_without, "text string, n_sentences long, n_removed long")
    whole = lambda text: F.struct(text.alias("text"), count(text).alias("n_sentences"), F.lit(0).cast("long").alias("n_removed"))
    tried = rows.where(doubtful).select("row", "k", "r").join(places, ["k", "r"], "left")
    stay = rows.where(~doubtful).select("row").unionByName(tried.where("places IS NULL").select("row")).select("row", whole(F.col("row.text")).alias("left"))
    return stay.unionByName(tried.where("places IS NOT NULL").select("row", cleaned("row.text", "places").alias("left")))


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("row.doc_id", "left.n_sentences", "left.n_removed", "left.text")
