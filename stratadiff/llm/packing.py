"""Cost-balanced packing of tokenised documents into sequences of a fixed length.

A piece of n tokens costs LINEAR * n + QUADRATIC * n * n (attention within the piece). A task reads its rows in blocks
of about ``BLOCK`` tokens, so its memory is bounded whatever the input. Of a block's tokens, whole multiples of the
capacity fill full sequences: pieces, longest first, go to the sequence of lowest cost that has room for them; what
fits nowhere is cut at the room that is left. The rest of a block, less than one sequence, is laid out in sequences
whose lengths are powers of two, so nothing is padded. No shuffle takes place, and a lost task is simply run again.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

CAPACITY, END, BLOCK = 4096, 2, 1 << 22
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Words whose ids a Python worker keeps; beyond it the store is emptied and filled anew.
KEPT_WORDS = 1_000_000
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def cost(length: int) -> float:
    return LINEAR * length + QUADRATIC * length * length


class WordTokens:
    """The ids of texts, from the ids of parts, each encoded once and kept.

    A tokenizer of word pieces lowers case, drops white space, and never joins letters with what is no letter (``RULES``). So a
    text's ids are those of its parts between blanks and line feeds in order, also with a blank put before marks that end a part
    after a letter or digit (apostrophes stay), and, where all characters are of Latin-1, with case lowered before. Texts that
    hold one of the tokenizer's special strings are encoded whole, as are all texts by a tokenizer of other rules.
    """

    #: The normalizer and splitter that parts rely on. Fixed values.
    RULES = (
        [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
        {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
    )

    #: A word that is one id, and is in no other word's ids: new parts are encoded together with it in between.
    BETWEEN = "\U0001f602"
    _MARKS = re.compile(r"(?<=[0-9a-z\xdf-\xf6\xf8-\xff])([!-&(-/:-@\[-`{-~]+)(?=[ \n]|$)")

    def __init__(self, path: str, specials_are_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = specials_are_text
        told = json.loads(self.tokenizer.to_str())
        self.specials = [] if specials_are_text else [t["content"] for t in told["added_tokens"]]
        split = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.whole = ((told.get("normalizer") or {}).get("normalizers"), split[0].get("pattern")) != self.RULES
        self.known: dict[str, bytes] = {"": b""}
        self.between = self.tokenizer.encode(self.BETWEEN, add_special_tokens=False).ids

    def parts(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.replace("\n", " ").split(" ")
        return self._MARKS.sub(r" \1", text.lower()).replace("\n", " ").split(" ")

    def learn(self, new: list[str]) -> None:
        alone = [p for p in new if self.BETWEEN in p or len(self.between) != 1]
        for p, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            self.known[p] = np.array(e.ids, "<u4").tobytes()
        new = [p for p in new if p not in self.known]
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {self.BETWEEN} ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            edges = [-1, *np.flatnonzero(ids == self.between[0]), len(ids)]
            raw = ids.tobytes()
            self.known.update((p, raw[4 * a + 4 : 4 * b]) for p, a, b in zip(some, edges[:-1], edges[1:], strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        alone = {i for i, t in enumerate(texts) if self.whole or any(s in t for s in self.specials)}
        direct = self.tokenizer.encode_batch_fast([texts[i] for i in sorted(alone)], add_special_tokens=False)
        found = {i: np.array(e.ids, "<u4") for i, e in zip(sorted(alone), direct, strict=True)}
        parts = [[] if i in alone else self.parts(t) for i, t in enumerate(texts)]
        known = self.known
        new = list({p for some in parts for p in some if p not in known})
        if len(known) + len(new) > KEPT_WORDS:
            known.clear()
            new = list({p for some in parts for p in some})
        if new:
            self.learn(new)
        return [found[i] if i in alone else np.frombuffer(b"".join(map(known.__getitem__, some)), "<u4") for i, some in enumerate(parts)]


def assign(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that lay out documents of these lengths without padding.

    Ties go to the document and the sequence of lower number. Sequences are full, but for some of the last, whose lengths are
    powers of two below the capacity. Documents of length 0 get no piece.
    """
    total = sum(lengths)
    full, rest = divmod(total, capacity)
    heap = [(-n, d, 0) for d, n in enumerate(lengths) if n]
    heapq.heapify(heap)
    pieces: list[tuple[int, int, int, int, int]] = []
    open_, room = [(0.0, s) for s in range(full)], [capacity] * full
    aside: list[tuple[int, int, float]] = []  # sequences too full for the piece at hand: (-room, sequence, cost)
    while heap and (open_ or aside):
        n, d, start = heapq.heappop(heap)
        n = -n
        while aside and -aside[0][0] >= min(n, capacity):
            _, s, c = heapq.heappop(aside)
            heapq.heappush(open_, (c, s))
        take, c, s = min(n, capacity), 0.0, -1
        while open_:
            c, s = heapq.heappop(open_)
            if room[s] >= take:
                break
            heapq.heappush(aside, (-room[s], s, c))
            s = -1
        if s < 0:  # fits nowhere: the sequence with most room takes what it can
            most, s, c = heapq.heappop(aside)
            take = -most
        pieces.append((d, start, take, s, capacity - room[s]))
        room[s] -= take
        if room[s]:
            heapq.heappush(open_, (c + cost(take), s))
        if n > take:
            heapq.heappush(heap, (take - n, d, start + take))
    s, size, left = full, capacity, 0
    for n, d, start in sorted(heap):  # what is left: rest tokens
        n = -n
        while n:
            if not left:
                while size > rest:
                    size //= 2
                left, s = size, s + 1
                rest -= size
            take = min(n, left)
            pieces.append((d, start, take, s - 1, size - left))
            n, start, left = n - take, start + take, left - take
    return pieces


def _pack(batches: Iterator[pa.RecordBatch], path: str | None, capacity: int, specials_are_text: bool) -> Iterator[pa.RecordBatch]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    words, part, at, held = WordTokens(path, specials_are_text), TaskContext.get().partitionId(), 0, 0
    ids: list[np.ndarray] = []
    docs: list[int | None] = []
    end = np.array([END], "<u4")

    def flush() -> pa.RecordBatch:
        nonlocal at, held
        pieces = assign([len(x) for x in ids], capacity)
        rows = [(docs[d], start, n, zlib.crc32(ids[d][start : start + n].tobytes()), len(ids[d]), (part << 40) + at + s, offset) for d, start, n, s, offset in pieces]
        at += 1 + max((p[3] for p in pieces), default=-1)
        held = 0
        ids.clear()
        docs.clear()
        return pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in zip(*rows, strict=True)], NAMES)

    for batch in batches:
        for some in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
            encoded = words.encode([t or "" for t in some.column(1).to_pylist()])
            for doc, x in zip(some.column(0).to_pylist(), encoded, strict=True):
                docs.append(doc)
                ids.append(np.concatenate([x, end]))
                held += len(x) + 1
                if held >= BLOCK:
                    yield flush()
    if ids:
        yield flush()


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, specials_are_text: bool = False) -> DataFrame:
    """A row for each piece of a row of ``docs``: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Rows are packed as they come, repeated rows each on their own; a null
    doc_id stays null. ``path`` is the tokenizer's file on every executor (None: that of the installed package). Its special
    strings in a text get their own ids, as the tokenizer gives them, or with ``specials_are_text`` those of ordinary text. An empty table gives no pieces. Only doc_id and text are read, other columns may have any names.
    Ties go as in ``assign``. Memory of a task grows with the longest text alone.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(lambda batches: _pack(batches, path, capacity, specials_are_text), ", ".join(f"{n} long" for n in NAMES))


def op2_cost_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
