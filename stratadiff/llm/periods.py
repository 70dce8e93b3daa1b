"""Periodic runs of words: stretches that repeat a block of words at least twice in a row, and texts without the repeats.

A run is a stretch of words of smallest period q and at least max(LEAST, 2 q) words that no neighbouring word extends.

Where a run has L words, its words but the last q come again q words later, and these are at least LEAST / 2. So every word of a run lies
in a window of LEAST / 2 words that the text has twice. Stretches of such words are found first, for many texts at once and with no loop
over words; all else of a text has no run in it.

In a stretch, a suffix automaton has the distinct runs of words as states, each with the ends of its places. Ends are kept in order and
merged along suffix links, the smaller set into the larger. Of a run, the words but the last q end at two places q apart, and these are
neighbours in the state of those words (a place between would give the run a smaller period). So all runs are found from ends that are new
neighbours in a state and no further apart than its longest words: two such places make a square, which is extended to both sides until
the period breaks. Conversely a square between neighbours has no smaller period, or a place between them would have been found.
Texts are worked on where they are: nothing is shuffled, and a lost task is run again.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table, words_of
from .words import M1, Runs, Words, mix, raw, slices

LEAST = 12
#: Ends in one list; a larger set has several.
IN_LIST = 1024


class Ends:
    """A set of places in order, as lists of bounded length."""

    __slots__ = ("lists", "tops", "size")

    def __init__(self, first: int):
        self.lists, self.tops, self.size = [[first]], [first], 1

    def add(self, x: int) -> None:
        j = min(bisect_left(self.tops, x), len(self.tops) - 1)
        some = self.lists[j]
        insort(some, x)
        self.size += 1
        self.tops[j] = some[-1]
        if len(some) > IN_LIST:
            half = len(some) // 2
            self.lists[j : j + 1] = [some[:half], some[half:]]
            self.tops[j : j + 1] = [some[half - 1], some[-1]]

    def neighbours(self, x: int) -> tuple[int | None, int | None]:
        """The places before and after a place of the set."""
        j = bisect_left(self.tops, x)
        some = self.lists[j]
        i = bisect_left(some, x)
        before = some[i - 1] if i else self.lists[j - 1][-1] if j else None
        after = some[i + 1] if i + 1 < len(some) else self.lists[j + 1][0] if j + 1 < len(self.lists) else None
        return before, after

    def __iter__(self) -> Iterator[int]:
        for some in self.lists:
            yield from some


def automaton(t: Sequence) -> tuple[list[int], list[int], list[int]]:
    """Of the suffix automaton of ``t``: each state's suffix link, longest length, and own end (-1 where it has none)."""
    ways: list[dict] = [{}]
    link, longest, own = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(t):
        new = len(ways)
        ways.append({})
        link.append(0)
        longest.append(i + 1)
        own.append(i)
        at = last
        while at >= 0 and c not in ways[at]:
            ways[at][c] = new
            at = link[at]
        if at >= 0:
            to = ways[at][c]
            if longest[to] == longest[at] + 1:
                link[new] = to
            else:
                copy = len(ways)
                ways.append(ways[to].copy())
                link.append(link[to])
                longest.append(longest[at] + 1)
                own.append(-1)
                link[to] = link[new] = copy
                while at >= 0 and ways[at].get(c) == to:
                    ways[at][c] = copy
                    at = link[at]
        last = new
    return link, longest, own


def seeds(t: Sequence, shortest: int) -> Iterator[tuple[int, int, int]]:
    """(end, distance, length): the ``length`` words that end at ``end`` are those that end ``distance`` later, which is no more than
    ``length``. States of less than ``shortest`` words are left out: a run has a seed in a longer one."""
    link, longest, own = automaton(t)
    sets: list[Ends | None] = [Ends(e) if e >= 0 else None for e in own]
    fresh: list[list[int] | None] = [None] * len(own)
    for v in sorted(range(1, len(own)), key=longest.__getitem__, reverse=True):
        most = longest[v]
        if most < shortest:
            break
        ends, new = sets[v], fresh[v]
        if new:  # all that belongs to this state is in: its new neighbours are final
            for x in new:
                before, after = ends.neighbours(x)
                if before is not None and x - before <= most:
                    yield before, x - before, most
                if after is not None and after - x <= most:
                    yield x, after - x, most
        sets[v] = fresh[v] = None
        u = link[v]
        if longest[u] < shortest:
            continue
        have = sets[u]
        if have is None:
            sets[u] = ends
            continue
        if have.size < ends.size:
            have, ends = ends, have
        moved = list(ends)
        for x in moved:
            have.add(x)
        sets[u] = have
        if fresh[u] is None:
            fresh[u] = moved
        else:
            fresh[u] += moved


def runs_of(t: Sequence, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``t``, by start, then period."""
    known: dict[int, tuple[list[int], list[int]]] = {}  # for each period the starts and ends of its runs, in order
    out, n = [], len(t)
    for x, d, length in seeds(t, (least + 1) // 2):
        starts, ends = known.setdefault(d, ([], []))
        i = bisect_right(starts, x) - 1
        if i >= 0 and ends[i] >= x + d:  # runs of one period share less than a period
            continue
        a, b = x - length + 1, x + d
        while a > 0 and t[a - 1] == t[a - 1 + d]:
            a -= 1
        while b + 1 < n and t[b + 1] == t[b + 1 - d]:
            b += 1
        starts.insert(i + 1, a)
        ends.insert(i + 1, b)
        if b - a + 1 >= least:
            out.append((a, b - a + 1, d))
    return sorted(out, key=lambda r: (r[0], r[2]))


def stretches(hashes: np.ndarray, begin: np.ndarray, upto: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """(text, first, past its last word) of the longest stretches whose words all lie in windows that their text has twice."""
    count = np.maximum(upto - begin - window + 1, 0)
    text = np.repeat(np.arange(len(begin)), count)
    if not len(text):
        return []
    at = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + begin[text]
    key = Runs(hashes).hashes(at, at + window) ^ mix((text + 1).astype(np.uint64) * M1)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    edges = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edges, at[twice], 1)
    np.add.at(edges, at[twice] + window, -1)
    inside = np.cumsum(edges[:-1]) > 0
    inner = np.concatenate([[False], inside, [False]])
    starts, ends = np.flatnonzero(inner[1:] & ~inner[:-1]), np.flatnonzero(inner[:-1] & ~inner[1:])
    out = []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):  # a stretch never passes from one text to the next
        d = int(np.searchsorted(upto, a, side="right"))
        while a < b:
            out.append((d, a, min(b, int(upto[d]))))
            a, d = out[-1][2], d + 1
    return out


def _found(batches: Iterator[pa.RecordBatch], kind: pa.DataType, least: int) -> Iterator[pa.RecordBatch]:
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for batch in slices(batches, 1):
        texts = [raw(t) for t in batch.column(1).to_pylist()]
        words = Words(texts)
        every = [t.split() for t in texts]
        runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for d, a, b in stretches(words.hashes, words.begin, words.upto, (least + 1) // 2):
            if b - a >= least:
                first = a - int(words.begin[d])
                runs[d] += [(first + s, n, q) for s, n, q in runs_of(every[d][first : first + b - a], least)]
        kept = []
        for some, found in zip(every, runs, strict=True):
            if found:
                stays = np.ones(len(some), bool)
                for s, n, q in found:
                    stays[s + q : s + n] = False
                some = [some[i] for i in np.flatnonzero(stays)]
            kept.append(b" ".join(some).decode("utf-8", "replace"))
        rows = [[{"start": s, "length": n, "period": q} for s, n, q in found] for found in runs]
        columns = [batch.column(0).cast(kind), pa.array([len(w) for w in every], pa.int64()), pa.array(rows, pa.list_(run)), pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """For each row of ``docs``: doc_id, n_words, runs (start, length, period, by start, then period) and the text ``collapsed``: its words,
    joined by one blank, without those that any run holds after its first period.

    Words are separated by white space of ASCII. Null and empty texts have no words, no runs and an empty collapsed text. Runs that
    overlap are all reported, of ties in length too; a word goes if any of them repeats it. Repeated rows each have a row, a null doc_id
    stays null, other columns may have any names, an empty table gives no rows. Texts are read whole: memory grows with the longest alone.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(F.col("doc_id"), F.col("text"))
    kind = rows.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)
    schema = f"doc_id {kind.simpleString()}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return rows.mapInArrow(lambda batches: _found(batches, arrow, least), schema)


def made_periodic(doc_id: Column, text: Column) -> Column:
    """The text; of each tenth document (by the checksum h of its id) its words from the a-th on as repeats of the p words there."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, at(i).cast("int"))), " ")

    some = let(words_of(text), lambda words: F.when(F.size(words) > 0, repeated(words)).otherwise(""))
    return F.when(F.coalesce(h % 10 == 0, F.lit(False)), some).otherwise(text)


def op13_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", made_periodic(F.col("doc_id"), F.col("text")).alias("text"))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    found = find_runs(docs).select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.array_join(lines, "").alias("lines"), "collapsed")
    return found.select(
        "doc_id", "n_runs", F.col("b.s").alias("start"), (-F.col("b.l")).alias("length"), F.col("b.p").alias("period"), F.floor(-1000 * F.col("b.l") / F.col("b.p")).alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
