"""Token ids of a corpus in binary chunks: fixed-size blocks of ids, transposed into planes, each plane compressed, with an index.

Ids stand in ascending order of doc_id (rows of one doc_id by their text's hash). Rows are dealt to files by ranges of that order, so each
task writes the ids of its range, ``CHUNK`` at a time. A chunk is a binary value that needs nothing else to be read:

    4 bytes "BPL1" | 1 byte kind of planes (1 bytes, 2 bits) | 3 bytes 0 | 4 bytes number of ids n
    | 4 bytes number of planes k | 4 bytes length of each of k planes | planes, each compressed by zstandard

all numbers little-endian and unsigned. Of ids as n numbers of 32 bits, byte plane j (of 4) has byte j of every id, bit plane j (of 32)
has bit j of every id, eight in a byte, the first id in the lowest bit. Planes of zeros only have length 0 and are not stored.

Below a folder, ``chunks`` is a table of chunks (file, chunk, first: ids before it in its file, n_ids, payload, and the documents with
ids in it), written by Spark, so any store will do and a lost or repeated task leaves no half files; ``index`` has the same without
payload but with the chunk's place in the whole corpus, so that a reader opens only the chunks of the documents it wants.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import uuid
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_folder, table
from .packing import END, WordTokens

#: Ids of a chunk.
CHUNK = 1 << 16
MAGIC = b"BPL1"
KINDS = {"byte": 1, "bit": 2}
_HEAD = "<4sB3xII"


def planes_of(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """The planes of ids (unsigned numbers of 32 bits), the lowest first."""
    each = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4).T
    if kind == "byte":
        return [p.tobytes() for p in each]
    bits = np.unpackbits(np.ascontiguousarray(each), axis=1, bitorder="little").reshape(4, -1, 8)
    return [np.packbits(bits[j, :, b], bitorder="little").tobytes() for j in range(4) for b in range(8)]


def ids_of(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    """The ids again; an empty plane is one of zeros."""
    out = np.zeros((n, 4), np.uint8)
    for j, plane in enumerate(planes):
        if not plane:
            continue
        if kind == "byte":
            out[:, j] = np.frombuffer(plane, np.uint8)
        else:
            out[:, j // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little") << np.uint8(j % 8)
    return out.reshape(-1).view("<u4")


def pack_chunk(ids: np.ndarray, kind: str = "byte", level: int = 1) -> bytes:
    press = zstandard.ZstdCompressor(level=level)
    planes = [press.compress(p) if p.strip(b"\0") else b"" for p in planes_of(ids, kind)]
    return b"".join([struct.pack(_HEAD, MAGIC, KINDS[kind], len(ids), len(planes)), struct.pack(f"<{len(planes)}I", *map(len, planes)), *planes])


def open_chunk(payload: bytes) -> np.ndarray:
    magic, number, n, k = struct.unpack_from(_HEAD, payload)
    if magic != MAGIC:
        raise ValueError("not a chunk of ids")
    kind = next(name for name, x in KINDS.items() if x == number)
    at, planes, press = struct.calcsize(_HEAD) + 4 * k, [], zstandard.ZstdDecompressor()
    whole = n if kind == "byte" else -(-n // 8)
    for size in struct.unpack_from(f"<{k}I", payload, struct.calcsize(_HEAD)):
        planes.append(press.decompress(payload[at : at + size], max_output_size=whole) if size else b"")
        at += size
    return ids_of(planes, n, kind)


class Known(dict):
    """The ids of parts of texts, as bytes, each found when it is first asked for. A part of letters alone is one word to the tokenizer's
    splitter, so it goes to the model, its bytes as the letters that stand for them there."""

    LETTERS = re.compile("[a-z\xdf-\xf6\xf8-\xff]+")

    def __init__(self, tokenizer):
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__({"": b""})
        self.tokenizer, self.model = tokenizer, tokenizer.model
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}

    def __missing__(self, part: str) -> bytes:
        if self.LETTERS.fullmatch(part):
            ids = [t.id for t in self.model.tokenize(part.translate(self.letters))]
        else:
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        self[part] = out = np.array(ids, "<u4").tobytes()
        return out


class KeptTokens(WordTokens):
    """WordTokens that look each part up once."""

    #: Parts that are kept; beyond it the store is emptied.
    MOST = 600_000

    def __init__(self, path: str, specials_are_text: bool = False):
        super().__init__(path, specials_are_text)
        self.known = Known(self.tokenizer)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        find, out = self.known.__getitem__, []
        for t in texts:
            if self.whole or any(s in t for s in self.specials):
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4"))
            else:
                out.append(np.frombuffer(b"".join(map(find, self.parts(t))), "<u4"))
            if len(self.known) > self.MOST:
                self.known.clear()
                self.known[""] = b""
        return out


def _kept(path: str, specials_are_text: bool) -> KeptTokens:
    """One for all tasks of a worker process. Functions come to workers by value, with module variables of their own, so it is kept in a
    module that the process has."""
    store = sys.modules.setdefault("_stratadiff_tokens", ModuleType("_stratadiff_tokens")).__dict__
    key = f"{path} {specials_are_text}"
    if key not in store:
        store[key] = KeptTokens(path, specials_are_text)
    return store[key]


_CHUNKS = "file int, chunk long, first long, n_ids int, payload binary, doc_ids array<long>, starts array<long>, lengths array<long>"
_NAMES = [x.split()[0] for x in _CHUNKS.split(", ")]
_LONGS = pa.list_(pa.int64())
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), _LONGS, _LONGS, _LONGS]


def _encoded(batches: Iterator[pa.RecordBatch], path: str | None, kind: str, size: int, specials_are_text: bool) -> Iterator[pa.RecordBatch]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    words, file, chunk, first, held = _kept(path, specials_are_text), TaskContext.get().partitionId(), 0, 0, 0
    some: list[np.ndarray] = []  # ids that are in no chunk yet
    docs: list[tuple[int | None, int, int]] = []  # doc_id, start, length of documents that have ids among them
    end = np.array([END], "<u4")

    def flush(least: int) -> Iterator[pa.RecordBatch]:
        nonlocal chunk, first, held
        ids, at, d = np.concatenate(some), 0, 0
        while held >= least and held:
            n = min(size, held)
            upto = first + n
            e = d
            while e < len(docs) and docs[e][1] < upto:
                e += 1
            row = [file, chunk, first, n, pack_chunk(ids[at : at + n], kind), *([x[i] for x in docs[d:e]] for i in range(3))]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES, strict=True)], _NAMES)
            while d < e and docs[d][1] + docs[d][2] <= upto:
                d += 1
            chunk, first, held, at = chunk + 1, upto, held - n, at + n
        some[:], docs[:] = [ids[at:]], docs[d:]

    for batch in batches:
        for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
            encoded = words.encode([t or "" for t in part.column(1).to_pylist()])
            for doc, x in zip(part.column(0).to_pylist(), encoded, strict=True):
                docs.append((doc, first + held, len(x) + 1))
                some += [x, end]
                held += len(x) + 1
            if held >= size:
                yield from flush(size)
    if held:
        yield from flush(1)


def write_ids(docs: DataFrame, folder: str, path: str | None = None, kind: str = "byte", size: int = CHUNK, specials_are_text: bool = False) -> None:
    """Encodes every row of ``docs`` (doc_id, text; other columns may have any names), appends the end id, and writes chunks and index.

    ``path`` is the tokenizer's file on every executor (None: that of the installed package), ``kind`` that of planes. A null or empty
    text is the end id alone. Rows without a doc_id come first; rows of one doc_id are in order of their texts' hashes, so that equal
    rows are neighbours and a table always gives the same ids. An empty table gives empty tables. Rows of one doc_id, also a third of all
    rows, are dealt to many files, as the range covers hash and place too. Memory of a task grows with the longest text alone.
    """
    order = ["doc_id", "h", "at"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("at"))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    dealt.mapInArrow(lambda batches: _encoded(batches, path, kind, size, specials_are_text), _CHUNKS).write.parquet(f"{folder}/chunks")
    chunks = docs.sparkSession.read.schema(_CHUNKS).parquet(f"{folder}/chunks").select(*(n for n in _NAMES if n != "payload"))
    # Files are as many as tasks wrote them: their sizes are few.
    upto = F.sum("ids").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, 0))
    before = chunks.groupBy("file").agg(F.sum("n_ids").alias("ids")).select("file", (upto - F.col("ids")).alias("before"))
    chunks.join(F.broadcast(before), "file").withColumn("start", F.col("before") + F.col("first")).write.parquet(f"{folder}/index")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """file, chunk, first, n_ids, before (ids of files before), start (ids of the corpus before the chunk), doc_ids, starts, lengths."""
    return spark.read.schema(f"{_CHUNKS.replace('payload binary, ', '')}, before long, start long").parquet(f"{folder}/index")


_PIECES = "file int, doc_start long, n_tokens long, doc_id long, piece long, ids binary"


def _pieces(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Of each chunk the documents that lie in it (``whole``), or the pieces of those that lie in several: file, the document's start and
    length in its file, its id, the piece's first id and ids."""
    names = [x.split()[0] for x in _PIECES.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    for batch in batches:
        for i in range(batch.num_rows):
            file, first, n, docs, starts, lengths = (batch.column(c)[i].as_py() for c in ("file", "first", "n_ids", "doc_ids", "starts", "lengths"))
            some = [(d, s, k) for d, s, k in zip(docs, starts, lengths, strict=True) if (first <= s and s + k <= first + n) == whole]
            if not some:
                continue
            ids = open_chunk(batch.column("payload")[i].as_py()).tobytes()
            rows = [(file, s, k, d, max(first, s), ids[4 * max(0, s - first) : 4 * max(0, s + k - first)]) for d, s, k in some]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_ids(spark: SparkSession, folder: str, wanted: DataFrame | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary, unsigned 32-bit little-endian) of each document.

    ``wanted`` (doc_id): only these (null is none of them), and only their chunks are opened. Documents that lie in one chunk are given as they are read; those
    of several chunks are put together by their place, so what is shuffled is the pieces at edges of chunks.
    """
    index = read_index(spark, folder)
    before = index.groupBy("file").agg(F.first("before").alias("before"))
    chunks = spark.read.schema(_CHUNKS).parquet(f"{folder}/chunks")
    if wanted is not None:
        asked = wanted.select("doc_id").distinct()
        places = index.select("file", "chunk", F.explode("doc_ids").alias("doc_id")).join(asked, "doc_id", "left_semi")
        chunks = chunks.join(places.select("file", "chunk").distinct(), ["file", "chunk"], "left_semi")
    opened = chunks.select("file", "first", "n_ids", "payload", "doc_ids", "starts", "lengths")
    parts = F.array_sort(F.collect_list(F.struct("piece", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda s, p: F.concat(s, p["ids"])).alias("ids")
    merged = opened.mapInArrow(lambda batches: _pieces(batches, False), _PIECES).groupBy("file", "doc_start", "n_tokens", "doc_id").agg(joined)
    both = opened.mapInArrow(lambda batches: _pieces(batches, True), _PIECES).select(*merged.columns).unionByName(merged)
    if wanted is not None:
        both = both.join(asked, "doc_id", "left_semi")
    return both.join(F.broadcast(before), "file").select("doc_id", (F.col("before") + F.col("doc_start")).alias("start"), "n_tokens", "ids")


def op11_plane_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/token-ids-{uuid.uuid4()}"
    write_ids(table(spark, sf_dir, "documents"), folder)
    return read_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
