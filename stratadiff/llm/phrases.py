"""Collocations: phrases of several words that stand together more often than their parts let expect, counted exactly.

Words are counted first. Texts then become arrays of slots, the numbers of their frequent words, with gaps for all else; a phrase of k words is
a pair of slots of k - 1 words, its first and its last ones, so its key of 64 bits is exact and a phrase without both of them frequent is
never looked at (Apriori). For each k, over these arrays:
1. buckets: mappers send the distinct keys of many texts with their counts to ranges of hash buckets; totals of buckets bound counts of keys
   from above;
2. candidates: the distinct keys in buckets of ``least`` or more, each found by the one task that has its range;
3. a minimal perfect hash of the candidates with stored keys (``perfect``), which mappers get in groups of ``KEYS`` keys at most;
4. counts: mappers bincount slots into arrays, which are summed in two rounds; candidates of ``least`` or more are the frequent phrases;
5. the arrays of slots for the next k, where only phrases that are frequent have one.
Counts of a phrase's cuts are read by the slots of its first and last words. Keys of words alone are hashes of 64 bits.

Arrays are tables in a folder of the shared one, so lost executors repeat single tasks; the folder goes when the result stands. Nothing
that grows with the corpus is sent at once: ``KEYS`` keys in a pass; beyond that there are more passes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, shared_folder, table
from .perfect import PerfectHash, build, part_of
from .words import _BYTES, M2, M3, Runs, mix, raw, slices

MOST_WORDS, LEAST, TOP = 5, 100, 2000
#: Keys that mappers hold at a time, keys of a part of the hash (built by one task), buckets of a range (summed at a time), slots of a block.
KEYS, PART, RANGE_BITS, BLOCK = 1 << 20, 1 << 14, 18, 1 << 13
#: Tasks that ranges are dealt to at most; each has few ranges, so what it is handed at once stays small.
DEALT = 1 << 13
#: Keys that a task gathers before it counts them or tells them apart.
AT_ONCE = 1 << 21

_BACK2, _BACK3 = (np.uint64(pow(int(m), -1, 1 << 64)) for m in (M2, M3))
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

Source = Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]


class Pieces:
    """The words of texts in lower case: starts and ends (bytes), texts they are of, whether a new piece begins, and keys by language."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        self.bytes = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
        kind = _KIND[self.bytes]
        edge = np.flatnonzero(np.diff(kind > 0, prepend=True))
        self.starts, self.ends = edge[::2], edge[1::2]
        piece = np.cumsum(kind == 2)[self.starts]
        self.new = np.diff(piece, prepend=-1) != 0
        upto = np.cumsum([len(t) + 1 for t in texts])
        self.text = np.searchsorted(upto, self.starts, side="right")
        of = {x: int.from_bytes(hashlib.blake2b(raw(x), digest_size=8).digest(), "little") for x in set(langs)}
        lang = np.array([of[x] for x in langs], np.uint64)
        self.keys = mix(Runs(_BYTES[self.bytes]).hashes(self.starts, self.ends) ^ lang[self.text])

    def word(self, i: int) -> bytes:
        return self.bytes[self.starts[i] : self.ends[i]].tobytes()


def _texts(batch: pa.RecordBatch) -> tuple[list[bytes], list[str]]:
    return [raw(t) for t in batch.column(0).to_pylist()], batch.column(1).to_pylist()


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, n of each slice, and with a null word all words of a language."""
    for batch in slices(batches, 0):
        texts, langs = _texts(batch)
        found = Pieces(texts, langs)
        _, first, n = np.unique(found.keys, return_index=True, return_counts=True)
        words, of = [found.word(i) for i in first], [langs[i] for i in found.text[first]]
        all_: dict[str, int] = {}
        for x, k in zip(of, n.tolist(), strict=True):
            all_[x] = all_.get(x, 0) + k
        columns = [pa.array([*of, *all_], pa.string()), pa.array([*words, *([None] * len(all_))], pa.binary()), pa.array([*n.tolist(), *all_.values()], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "n"])


#: Where an array of keys has none.
GAP = np.uint64((1 << 64) - 1)


def keys_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The words' keys, with a gap between pieces."""
    for batch in slices(batches, 0):
        found = Pieces(*_texts(batch))
        if len(found.keys):
            out = np.full(len(found.keys) + int(found.new.sum()), GAP)
            out[np.arange(len(found.keys)) + np.cumsum(found.new)] = found.keys
            yield out


def _packed(numbers: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(numbers.tobytes())


def _unpacked(payload: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), kind)


def keys_of_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Of each two slots in a row the key of both."""
    for batch in batches:
        for payload in batch.column(0):
            slots = _unpacked(payload.as_py(), "<i4").astype(np.int64)
            a, b = slots[:-1], slots[1:]
            yield np.where((a >= 0) & (b >= 0), (a << 32 | b).astype(np.uint64), GAP)


def _gathered(arrays: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """Keys without gaps, many at a time."""
    some, held = [], 0
    for keys in arrays:
        keys = keys[keys != GAP]
        some.append(keys)
        held += len(keys)
        if held >= AT_ONCE:
            yield np.concatenate(some)
            some, held = [], 0
    if held:
        yield np.concatenate(some)


def unmix(x: np.ndarray) -> np.ndarray:
    """What ``mix`` gives these numbers for."""
    x = (x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))) * _BACK3
    x = (x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))) * _BACK2
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def _buckets(batches: Iterator[pa.RecordBatch], source: Source, bits: int) -> Iterator[pa.RecordBatch]:
    """range, and the mixed keys in its buckets, in order, with their counts. A bucket is what keys with the same first bits are in."""
    each = min(bits, RANGE_BITS)
    for keys in _gathered(source(batches)):
        mixed, n = np.unique(mix(keys), return_counts=True)
        of = (mixed >> np.uint64(64 - bits) >> np.uint64(each)).astype(np.int64)
        edges = np.flatnonzero(np.diff(of, prepend=-1))
        for a, b in zip(edges, [*edges[1:], len(of)], strict=True):
            row = [pa.array([int(of[a])], pa.int64()), pa.array([_packed(mixed[a:b])], pa.binary()), pa.array([_packed(n[a:b].astype("<u4"))], pa.binary())]
            yield pa.RecordBatch.from_arrays(row, ["range", "keys", "counts"])


def _candidates(batches: Iterator[pa.RecordBatch], bits: int, least: int) -> Iterator[pa.RecordBatch]:
    """key: of each range (rows come by range) the distinct keys in buckets that ``least`` keys or more are in."""
    each = min(bits, RANGE_BITS)
    at, total, some, held = None, None, [], 0
    bucket = lambda mixed: ((mixed >> np.uint64(64 - bits)) & np.uint64((1 << each) - 1)).astype(np.int64)

    def done() -> pa.RecordBatch:
        mixed = np.unique(np.concatenate(some))
        keys = unmix(mixed[total[bucket(mixed)] >= least])
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64), pa.int64())], ["key"])

    for batch in batches:
        for range_, keys, counts in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            if range_ != at:
                if at is not None:
                    yield done()
                at, total, some, held = range_, np.zeros(1 << each, np.int64), [], 0
            mixed = _unpacked(keys, "<u8")
            np.add.at(total, bucket(mixed), _unpacked(counts, "<u4").astype(np.int64))
            some.append(mixed)
            held += len(mixed)
            if held >= AT_ONCE:
                some = [np.unique(np.concatenate(some))]
                held = 0
    if at is not None:
        yield done()


def _parts(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(part_of(keys.view(np.uint64), parts), pa.int64()), batch.column(0)], ["part", "key"])


def _built(rows: pa.Table) -> pa.Table:
    arrays = build(rows.column("key").to_numpy().view(np.uint64))
    return pa.table({"part": rows.column("part")[:1], **{n: pa.array([x.tobytes()], pa.binary()) for n, x in zip(("sizes", "bits", "keys"), arrays, strict=True)}})


class Level:
    """The phrases of one length: for each group of keys the slot of its first, and what mappers get: its perfect hash and, once counted, a
    mark for each slot that is frequent."""

    def __init__(self, groups: list[tuple[int, tuple, np.ndarray | None]], context):
        self.groups = [(first, context.broadcast((arrays, marks))) for first, arrays, marks in groups]

    def drop(self) -> None:
        for _, sent in self.groups:
            sent.unpersist()


def _filled(batches: Iterator[pa.RecordBatch], source: Source | None, first: int, sent: Broadcast, last: bool) -> Iterator[pa.RecordBatch]:
    """Slots for keys of one group: of all groups together arrays of slots, without gaps in a row; before, the keys and the slots so far."""
    arrays, marks = sent.value
    known = PerfectHash.of(arrays)

    def rows():
        if source:
            for keys in source(batches):
                yield keys, np.full(len(keys), -1, np.int64)
        else:
            for batch in batches:
                for keys, now in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    yield _unpacked(keys, "<u8"), _unpacked(now, "<i8").copy()

    for keys, now in rows():
        asked = np.flatnonzero((keys != GAP) & (now < 0))
        slots = known.slots(keys[asked])
        if marks is not None:
            slots[~marks[slots]] = -1  # a slot of -1 takes the last mark, and is -1 again
        found = slots >= 0
        now[asked[found]] = slots[found] + first
        if not last:
            yield pa.RecordBatch.from_arrays([pa.array([_packed(keys)], pa.binary()), pa.array([_packed(now)], pa.binary())], ["keys", "now"])
            continue
        held = now >= 0
        kept = held | np.concatenate([[False], held[:-1]])
        if held.any():
            yield pa.RecordBatch.from_arrays([pa.array([_packed(now[kept].astype("<i4"))], pa.binary())], ["slots"])


def _counted(batches: Iterator[pa.RecordBatch], source: Source, sent: Broadcast) -> Iterator[pa.RecordBatch]:
    """block, part, counts: how often each slot of a group comes in a task, in blocks of slots."""
    known = PerfectHash.of(sent.value[0])
    counts = np.zeros(len(known), np.int64)
    for keys in _gathered(source(batches)):
        slots = known.slots(keys)
        counts += np.bincount(slots[slots >= 0], minlength=len(counts))
    part = TaskContext.get().partitionId()
    for at in range(0, len(counts), BLOCK):
        some = counts[at : at + BLOCK]
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.array([at // BLOCK], pa.int64()), pa.array([part], pa.int64()), pa.array([some.tobytes()], pa.binary())], ["block", "part", "counts"])


def _summed(rows: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(b.as_py(), np.int64) for b in rows.column("counts")], axis=0)
    return pa.table({"block": rows.column("block")[:1], "part": rows.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def _frequent(batches: Iterator[pa.RecordBatch], first: int, sent: Broadcast, least: int) -> Iterator[pa.RecordBatch]:
    """slot, p and s (slots of the first and of the last words), a: candidates that come ``least`` times."""
    keys = PerfectHash.of(sent.value[0]).keys
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            counts = np.frombuffer(counts, np.int64)
            at = np.flatnonzero(counts >= least)
            slot = at + block * BLOCK
            key = keys[slot]
            columns = [slot + first, (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64), counts[at]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["slot", "p", "s", "a"])


def _word_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = Pieces(batch.column("word").to_pylist(), batch.column("lang").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("word"), batch.column("n"), pa.array(found.keys.view(np.int64), pa.int64())], ["lang", "word", "n", "key"])


def _word_slots(batches: Iterator[pa.RecordBatch], first: int, sent: Broadcast) -> Iterator[pa.RecordBatch]:
    known = PerfectHash.of(sent.value[0])
    for batch in batches:
        slots = known.slots(batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64))
        at = np.flatnonzero(slots >= 0)
        some = batch.take(pa.array(at))
        yield pa.RecordBatch.from_arrays([pa.array(slots[at] + first, pa.int64()), some.column("lang"), some.column("word"), some.column("n")], ["slot", "lang", "word", "a"])


class Miner:
    """One corpus (text and lang, neither null) and the folder of its tables."""

    def __init__(self, rows: DataFrame, folder: str, least: int, keys: int, part: int):
        self.rows, self.folder, self.least, self.group, self.part = rows, folder, least, max(1, keys // part), part
        self.spark, self.tables = rows.sparkSession, 0

    def kept(self, df: DataFrame) -> DataFrame:
        """The rows, written and read again."""
        self.tables += 1
        df.write.parquet(f"{self.folder}/{self.tables}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.tables}")

    def hashed(self, keys: DataFrame) -> list[tuple[int, tuple, None]]:
        """Groups of a perfect hash of distinct keys: the first slot and the arrays of each."""
        parts = max(1, -(-keys.count() // self.part))
        dealt = keys.mapInArrow(lambda batches: _parts(batches, parts), "part long, key long")
        built = self.kept(dealt.groupBy("part").applyInArrow(_built, "part long, sizes binary, bits binary, keys binary"))
        out, first = [], 0
        for at in range(0, parts, self.group):
            rows = {r["part"]: r for r in built.where(F.col("part").between(at, at + self.group - 1)).collect()}
            upto = min(parts, at + self.group)
            none = {"sizes": b"", "bits": b"", "keys": b""}
            each = [tuple(np.frombuffer(bytes(rows.get(p, none)[c]), k) for c, k in (("sizes", np.int64), ("bits", np.uint64), ("keys", np.uint64))) for p in range(at, upto)]
            known = PerfectHash(each, parts, at)
            out.append((first, known.arrays(), None))
            first += len(known)
        return out

    def slots(self, rows: DataFrame, source: Source, level: Level) -> DataFrame:
        for i, (first, sent) in enumerate(level.groups):
            last = i + 1 == len(level.groups)
            of = source if i == 0 else None
            rows = self.kept(rows.mapInArrow(lambda b, of=of, first=first, sent=sent, last=last: _filled(b, of, first, sent, last), "slots binary" if last else "keys binary, now binary"))
        return rows

    def words(self) -> tuple[DataFrame, DataFrame, Level]:
        """Frequent words (slot, lang, phrase, a), the number of words of each language, and their level."""
        found = self.rows.mapInArrow(_word_counts, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
        found = self.kept(found.where(F.col("word").isNull() | (F.col("n") >= self.least)))
        sizes = found.where("word IS NULL").select("lang", "n")
        keyed = self.kept(found.where("word IS NOT NULL").mapInArrow(_word_keys, "lang string, word binary, n long, key long"))
        level = Level(self.hashed(keyed.select("key")), self.spark.sparkContext)
        each = [keyed.mapInArrow(lambda b, first=first, sent=sent: _word_slots(b, first, sent), "slot long, lang string, word binary, a long") for first, sent in level.groups]
        for more in each[1:]:
            each[0] = each[0].unionByName(more)
        return self.kept(each[0].select("slot", "lang", F.col("word").cast("string").alias("phrase"), "a")), sizes, level

    def longer(self, rows: DataFrame, many: int) -> tuple[DataFrame, Level]:
        """Frequent phrases (slot, p, s, a) of one word more than the slots in ``rows``, of which there are ``many`` at most."""
        context, source, least = self.spark.sparkContext, keys_of_slots, self.least
        bits = min(40, max(16, (many // 8).bit_length()))
        ranges = rows.mapInArrow(lambda b: _buckets(b, source, bits), "range long, keys binary, counts binary").repartition(min(DEALT, 1 << max(0, bits - RANGE_BITS)), "range").sortWithinPartitions("range")
        keys = self.kept(ranges.mapInArrow(lambda b: _candidates(b, bits, least), "key long"))
        groups, frequent, marked = self.hashed(keys), None, []
        level = Level(groups, context)
        for (first, sent), (_, arrays, _) in zip(level.groups, groups, strict=True):
            counts = rows.mapInArrow(lambda b, sent=sent: _counted(b, source, sent), "block long, part long, counts binary")
            some = counts.withColumn("part", F.col("part") % 64).groupBy("block", "part").applyInArrow(_summed, "block long, part long, counts binary")
            total = some.withColumn("part", F.lit(0).cast("long")).groupBy("block").applyInArrow(_summed, "block long, part long, counts binary")
            found = self.kept(total.mapInArrow(lambda b, first=first, sent=sent: _frequent(b, first, sent, least), "slot long, p long, s long, a long"))
            frequent = found if frequent is None else frequent.unionByName(found)
            of = np.zeros(len(arrays[3]) + 1, bool)  # the last mark is that of no slot
            of[found.select("slot").toArrow().column(0).to_numpy() - first] = True
            marked.append((first, arrays, of))
        level.drop()
        return frequent, Level(marked, context)


def collocations(docs: DataFrame, folder: str, most_words: int = MOST_WORDS, least: int = LEAST, top: int = TOP, keys: int = KEYS, part: int = PART) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the ``top`` phrases of 2 to ``most_words`` words that come ``least`` times.

    Texts are taken in lower case (A-Z), split into pieces at ``.,;:!?`` and line ends and these into words at blanks and tabs; a null text is
    empty, a null language ``und``. n counts all words of the language, a the phrase, l and r the two parts of the cut with the lowest score
    floor(1000 a n / (l r)), of equal ones the first. A phrase that lies in a longer one that comes as often is left out. Order: score and a from the
    highest, then the phrase by its bytes. Repeated rows count each time; other columns may have any names; an empty table gives no
    rows. Tables are written below ``folder``. Memory of a task grows with the longest text alone.
    """
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    mine = Miner(rows, folder, least, keys, part)
    words, sizes, level = mine.words()
    empty = F.array().cast("array<long>")
    info = words.select("slot", "lang", "phrase", F.col("phrase").alias("final"), "a", empty.alias("pre"), empty.alias("suf"))
    many = sizes.agg(F.sum("n")).first()[0] or 0
    slots = mine.slots(rows, keys_of_texts, level)
    out = None
    for k in range(2, most_words + 1):
        level.drop()
        frequent, level = mine.longer(slots, many)
        side = lambda p: info.select(F.col("slot").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in info.columns if c != "slot"))  # noqa: E731, B023
        joined = frequent.join(side("p"), "p").join(side("s"), "s")
        longer = mine.kept(joined.select(
            "slot", F.col("p_lang").alias("lang"), F.concat_ws(" ", "p_phrase", "s_final").alias("phrase"), F.col("s_final").alias("final"), "a",
            F.concat("p_pre", F.array("p_a")).alias("pre"), F.concat("s_suf", F.array("s_a")).alias("suf"), "p", "s",
        ))
        if k > 2:  # a longer one that comes as often has one of one word more in it that does
            inside = longer.select(F.col("p").alias("slot"), "a").unionByName(longer.select(F.col("s").alias("slot"), "a")).distinct()
            shorter = info.join(inside, ["slot", "a"], "left_anti").select("lang", "phrase", "a", "pre", "suf")
            out = shorter if out is None else out.unionByName(shorter)
        info = longer.drop("p", "s")
        many = longer.agg(F.sum("a")).first()[0] or 0
        if not many or k == most_words:
            break
        slots = mine.slots(slots, keys_of_slots, level)
    level.drop()
    last = info.select("lang", "phrase", "a", "pre", "suf") if most_words > 1 else info.limit(0).select("lang", "phrase", "a", "pre", "suf")
    found = (last if out is None else out.unionByName(last)).join(sizes, "lang")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = found.select("lang", "phrase", "a", "n", F.posexplode("pre").alias("k", "l"), "suf").withColumn("r", F.element_at("suf", F.size("suf") - F.col("k"))).drop("suf")
    high, low = exact("a") * exact("n") * F.lit(1000).cast("decimal(4,0)"), exact("l") * exact("r")
    scored = cuts.withColumn("high", high.cast("decimal(38,0)")).withColumn("low", low.cast("decimal(38,0)")).withColumn("score", F.expr("high div low"))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part_ = F.pmod(F.xxhash64("phrase"), F.lit(64))
    first = lowest.withColumn("part", part_).withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_perfect_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/phrases-{uuid.uuid4()}"
    found = cut(collocations(table(spark, sf_dir, "documents"), folder))
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    return found
