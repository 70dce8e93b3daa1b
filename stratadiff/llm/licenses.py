"""License scans: exact phrases, and short notices with a bounded number of edits.

A notice with at most e edits holds, unchanged, at least one of e + 1 parts it is split into (pigeonhole), so an
Aho-Corasick automaton over all parts finds every place where a notice can be. Around each, the regex library matches
the whole notice with at most e edits and gives the span and the edits. Work in a row is bounded by its text; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short notices as words of lower case: (label, notice, most edits).
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", 6),
    ("mit", "released under the mit license", 2),
    ("apache", "licensed under the apache license version 2 0", 3),
    ("gpl", "gnu general public license", 2),
    ("gpl", "this program is free software you can redistribute it and or modify it", 4),
    ("lgpl", "gnu lesser general public license", 3),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 6),
    ("bsd", "licensed under the bsd license", 2),
    ("mpl", "mozilla public license", 2),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", 5),
    ("cc", "licensed under cc by", 1),
    ("cc", "creative commons attribution", 2),
    ("cc0", "creative commons zero", 1),
    ("unlicense", "this is free and unencumbered software released into the public domain", 4),
    ("epl", "eclipse public license", 2),
    ("proprietary", "all rights reserved", 1),
]
#: A-Z to a-z; all of ASCII but letters and digits to a blank; other bytes as they are.
_CLEAN = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
#: What ``scan`` finds.
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label string, first_word long, last_word long, edits int>>"


def clean(text: str | None) -> str:
    """The words, each between single blanks, with a blank before the first and after the last."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_CLEAN).split()
    return f" {b' '.join(words).decode('utf-8', 'surrogatepass')} " if words else " "


def seeds(notice: str, edits: int) -> list[tuple[int, str]]:
    """``edits`` + 1 parts (offset, part) that make up the notice."""
    n, k = len(notice), edits + 1
    cuts = [i * n // k for i in range(k + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Search:
    """An automaton over the parts of all notices, and a pattern for each notice; built once in each task."""

    def __init__(self, notices: list[tuple[str, str, int]]):
        import ahocorasick
        import regex

        self.notices, self.machine, where = notices, ahocorasick.Automaton(), {}
        for i, (_, notice, edits) in enumerate(notices):
            for at, part in seeds(notice, edits):
                where.setdefault(part, []).append((i, at))
        for part, places in where.items():
            self.machine.add_word(part, (len(part), places))
        self.machine.make_automaton()
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(notice)}){{e<={edits}}}") for _, notice, edits in notices]

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) of the places in a cleaned text where a notice stands with its edits, by place."""
        windows: dict[int, list[list[int]]] = {}
        for last, (n, places) in self.machine.iter(text):
            for i, at in places:
                _, notice, edits = self.notices[i]
                a, b = max(0, last + 1 - n - at - edits), min(len(text), last + 1 - n - at + len(notice) + edits)
                some = windows.setdefault(i, [])
                if some and a <= some[-1][1]:
                    some[-1][0], some[-1][1] = min(a, some[-1][0]), max(b, some[-1][1])
                else:
                    some.append([a, b])
        found = []
        for i, some in windows.items():
            for a, b in some:
                left = [(a, b)]  # the best place of each stretch, then what is before and after it
                while left:
                    a, b = left.pop()
                    if a < b and (m := self.patterns[i].search(text, a, b)):
                        found.append((i, m.start(), m.end(), sum(m.fuzzy_counts)))
                        left += [(a, m.start()), (max(m.end(), m.start() + 1), b)]
        return sorted(found, key=lambda x: (x[1], x[0]))


def scan(text: str | None, search: Search) -> dict:
    """What SCHEMA names, for one text."""
    text = clean(text)
    starts, base = [], set()
    for phrase, label in PHRASES.items():
        at = text.find(f" {phrase} ")
        while at >= 0:
            starts.append(at)
            base.add(label)
            at = text.find(f" {phrase} ", at + 1)
    spans, score, at, before = [], 1.0 if starts else 0.0, 0, 0
    for i, a, b, edits in search.find(text):
        label, notice, _ = search.notices[i]
        before, at = before + text.count(" ", at, a + 1), a + 1  # places come in order, so blanks are counted once
        spans.append({"label": label, "first_word": before - 1, "last_word": before - 1 + text.count(" ", a + 1, b) - (text[b - 1] == " "), "edits": edits})
        score = max(score, 1.0 - edits / len(notice))
    labels = base | {s["label"] for s in spans}
    first, last = (min(starts), max(starts)) if starts else (None, None)
    word = lambda at: None if at is None else text.count(" ", 0, at)
    return {"n_words": max(0, text.count(" ") - 1), "n_base": len(starts), "first_word": word(first), "last_word": word(last), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": score, "spans": spans}


def scan_licenses(docs: DataFrame, notices: list[tuple[str, str, int]] = NOTICES) -> DataFrame:
    """doc_id and the columns of SCHEMA for each row of ``docs`` (doc_id, text; others are not read, whatever their names).

    n_base counts places of the exact phrases, first_word and last_word are their least and greatest first word (else null).
    labels adds those of notices found with few edits; spans gives each such place. score: 1 for an exact phrase, else
    one minus the least share of edited characters, 0 without a find. Null and empty texts have no words and no label.
    Repeated rows each have a row; ties of labels do not arise, as they are sets; an empty table gives no row. Texts are searched whole:
    memory of a task grows with the longest alone.
    """
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(notices)
        for batch in batches:
            for some in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                found = [scan(t, search) for t in some.column(1).to_pylist()]
                columns = [some.column(0), *(pa.array([x[n] for x in found], t) for n, t in TYPES.items())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *TYPES])

    return docs.select(F.col("doc_id"), F.col("text")).mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


TYPES = {
    "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(),
    "spans": pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())])),
}


def op7_fuzzy_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
