"""Unified diffs as tables: parsing, change blocks, line transport, reduction to essential hunks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@ ?(.*)$")
#: What a Python worker hands on at once: rows, or characters of their texts.
ROWS, CHARACTERS = 5_000, 1 << 22
LINES = "file_idx int, path string, is_new boolean, is_deleted boolean, hunk_idx int, src_start int, src_len int, tgt_start int, tgt_len int, section string, pos int, line_type string, value string, src_no int, tgt_no int"


def parse_patch(text: str | None) -> Iterator[dict]:
    """The lines of all hunks. Their lengths tell where hunks end, so lines that look like headers inside one are lines.

    A file header may come again before each hunk; hunks of one path are hunks of one file. Markers of a missing
    final line feed are no lines. What is outside hunks and headers is skipped.
    """
    files: dict[str, int] = {}
    old = path = ""
    fresh = dropped = False
    hunk, lines, i = -1, (text or "").split("\n"), 0
    while i < len(lines):
        line = lines[i]
        i += 1
        if line.startswith("diff --git"):
            fresh = dropped = False
        elif line.startswith("new file mode"):
            fresh = True
        elif line.startswith("deleted file mode"):
            dropped = True
        elif line.startswith("--- "):
            old = line[4:].split("\t")[0].strip()
        elif line.startswith("+++ "):
            new = line[4:].split("\t")[0].strip()
            fresh, dropped = fresh or old == "/dev/null", dropped or new == "/dev/null"
            path = re.sub(r"^[ab]/", "", old if new == "/dev/null" else new)
        elif m := _HUNK.match(line):
            a, n, b, k = int(m[1]), int(m[2] or 1), int(m[3]), int(m[4] or 1)
            if path not in files:
                files[path] = len(files)
            hunk += 1
            src, tgt, pos = a, b, 0
            left, right = n, k
            while (left > 0 or right > 0) and i < len(lines):
                line = lines[i]
                i += 1
                kind = line[:1] or " "
                if kind == "\\":
                    continue
                if kind not in " +-":
                    i -= 1
                    break
                yield {
                    "file_idx": files[path], "path": path, "is_new": fresh, "is_deleted": dropped, "hunk_idx": hunk, "src_start": a, "src_len": n, "tgt_start": b, "tgt_len": k, "section": m[5],
                    "pos": pos, "line_type": kind, "value": line[1:], "src_no": src if kind != "+" else None, "tgt_no": tgt if kind != "-" else None,
                }
                pos, left, right = pos + 1, left - (kind != "+"), right - (kind != "-")
                src, tgt = src + (kind != "+"), tgt + (kind != "-")


def in_parts(rows: Iterable[tuple[int, dict | tuple]], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows, each with the characters of its texts, as frames of bounded size, so that a worker holds few of the lines of a batch of texts."""
    part, held = [], 0
    for size, row in rows:
        part.append(row)
        held += size
        if len(part) >= ROWS or held >= CHARACTERS:
            yield pd.DataFrame(part, columns=columns)
            part, held = [], 0
    yield pd.DataFrame(part, columns=columns)


def diff_lines(patches: DataFrame, key: str = "case_id", text: str = "text") -> DataFrame:
    """A row for each hunk line of each patch. Rows are parsed where they are; nothing is shuffled. A worker holds a batch of patches and a
    bounded part of their lines."""
    kind = patches.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in LINES.split(", ")]
        for batch in batches:
            rows = ((len(line["value"]), {key: k} | line) for k, t in zip(batch[key], batch[text], strict=True) for line in parse_patch(t))
            for part in in_parts(rows, [key, *names]):
                yield part.astype({"src_no": "Int32", "tgt_no": "Int32"})

    return patches.select(key, text).mapInPandas(run, f"{key} {kind}, {LINES}")


def split_hunks(text: str | None) -> Iterator[tuple[str, bool, str]]:
    """(path, is_new, text) of each hunk, the text with the file's headers before it as they stand in the patch."""
    head: list[str] = []
    body: list[str] = []
    lines, i, path, fresh = (text or "").split("\n"), 0, "", False
    while i < len(lines):
        line = lines[i]
        i += 1
        if m := _HUNK.match(line):
            left, right, body = int(m[2] or 1), int(m[4] or 1), [line]
            while i < len(lines) and (left > 0 or right > 0 or lines[i].startswith("\\")):
                kind = lines[i][:1] or " "
                if kind not in " +-\\":
                    break
                left, right = left - (kind in " -"), right - (kind in " +")
                body.append(lines[i])
                i += 1
            yield path, fresh, "\n".join([*head, *body])
            continue
        if line.startswith("diff --git") or (line.startswith("--- ") and body):
            head, body = [], []
            fresh = False
        head.append(line)
        fresh = fresh or line.startswith("new file mode") or line == "--- /dev/null"
        if line.startswith("+++ "):
            path = re.sub(r"^[ab]/", "", line[4:].split("\t")[0].strip())


def raw_hunks(patches: DataFrame, key: str = "case_id", text: str = "text") -> DataFrame:
    """key, hunk_idx, path, is_new, text: each hunk of a patch as a patch of its own, headers and all."""
    kind = patches.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = ((len(h[2]), (k, i, *h)) for k, t in zip(batch[key], batch[text], strict=True) for i, h in enumerate(split_hunks(t)))
            yield from in_parts(rows, [key, "hunk_idx", "path", "is_new", "text"])

    return patches.select(key, text).mapInPandas(run, f"{key} {kind}, hunk_idx int, path string, is_new boolean, text string")


def hunks(lines: DataFrame, key: str = "case_id") -> DataFrame:
    """A row for each hunk, with its removed and added line numbers and counts."""
    return lines.groupBy(key, "file_idx", "path", "is_new", "is_deleted", "hunk_idx", "src_start", "src_len", "tgt_start", "tgt_len", "section").agg(
        F.count_if(F.col("line_type") == "+").alias("added"),
        F.count_if(F.col("line_type") == "-").alias("removed"),
        F.array_sort(F.collect_list(F.when(F.col("line_type") == "-", F.col("src_no")))).alias("removed_lines"),
        F.array_sort(F.collect_list(F.when(F.col("line_type") == "+", F.col("tgt_no")))).alias("added_lines"),
    )


def source_range(hunk: DataFrame) -> DataFrame:
    """Hunks with every old line number they span."""
    return hunk.withColumn("lines", F.when(F.col("src_len") > 0, F.sequence("src_start", F.col("src_start") + F.col("src_len") - 1)).otherwise(F.array().cast("array<int>")))


def islands(rows: DataFrame, keys: list[str], order: list[str], inside: Column, name: str = "island") -> DataFrame:
    """``rows`` where ``inside`` holds, with the number (from 0) of the unbroken run they are in."""
    w = W.partitionBy(*keys).orderBy(*order)
    broken = rows.withColumn("__in", inside).withColumn("__new", F.col("__in") & ~F.coalesce(F.lag("__in").over(w), F.lit(False)))
    return broken.withColumn(name, F.sum(F.col("__new").cast("int")).over(w) - 1).where("__in").drop("__in", "__new")


def chunks(lines: DataFrame, key: str = "case_id") -> DataFrame:
    """The change chunks of each hunk: runs of added and removed lines, a context line between two.

    kind is change, delete or add; numbers are those of its removed lines. first and last are the removed old lines; for an addition the old line that follows,
    or the line after the hunk where none follows in it.
    """
    by = [key, "file_idx", "hunk_idx"]
    w = W.partitionBy(*by).orderBy("pos").rowsBetween(1, W.unboundedFollowing)
    following = F.first(F.when(F.col("line_type") == " ", F.col("src_no")), ignorenulls=True).over(w)
    found = islands(lines.withColumn("next_no", F.coalesce(following, F.col("src_start") + F.col("src_len"))), by, ["pos"], F.col("line_type") != " ", "chunk_idx")
    removed, added = F.count_if(F.col("line_type") == "-"), F.count_if(F.col("line_type") == "+")
    texts = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("line_type") == kind, F.struct("pos", "value")))), lambda x: x["value"])
    out = found.groupBy(*by, "path", "chunk_idx").agg(removed.alias("removed"), added.alias("added"), F.min("src_no").alias("first"), F.max("src_no").alias("last"), F.max("next_no").alias("next_no"), F.array_sort(F.collect_list(F.when(F.col("line_type") == "-", F.col("src_no")))).alias("numbers"), texts("-").alias("old_lines"), texts("+").alias("new_lines"))
    kind = F.when((F.col("removed") > 0) & (F.col("added") > 0), "change").when(F.col("removed") > 0, "delete").otherwise("add")
    return out.select(*by, "path", "chunk_idx", kind.alias("kind"), F.coalesce("first", "next_no").alias("first"), F.coalesce("last", "next_no").alias("last"), "numbers", "old_lines", "new_lines")


def anchored(chunk: DataFrame, files: DataFrame, key: str = "case_id") -> DataFrame:
    """Chunks with additions anchored at the next line of the old file (key, path, line_no, value) that isn't blank; at its end: -1."""
    from .lines import next_full

    adds = chunk.where("kind = 'add'").select(key, "path", F.col("first").alias("line_no")).distinct()
    found = next_full(adds, files, [key, "path"]).select(key, "path", F.lit("add").alias("kind"), F.col("line_no").alias("first"), F.col("full_no").alias("anchor"))
    both = chunk.join(found, [key, "path", "kind", "first"], "left")
    return both.select(*(F.coalesce("anchor", c).alias(c) if c in ("first", "last") else c for c in chunk.columns))


def transport(numbers: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Old line numbers (keys, ord, line_no) as new ones, in column ``new_no``. Removed lines give no row.

    A line in a hunk's context has its new number there; any other moves by what the hunks wholly before it add.
    """
    at = lines.where(F.col("line_type") != "+").select(*keys, F.col("src_no").alias("line_no"), F.col("line_type").alias("kind"), "tgt_no").groupBy(*keys, "line_no").agg(F.min_by("kind", "tgt_no").alias("kind"), F.min("tgt_no").alias("tgt_no"), F.max(F.col("kind") == "-").alias("gone"))
    each = lines.select(*keys, "hunk_idx", "src_start", "src_len", "tgt_len").distinct()
    # Shifts as rows among the numbers: a hunk counts for lines after its last old line.
    ends = each.select(*keys, F.when(F.col("src_len") == 0, F.col("src_start") + 1).otherwise(F.col("src_start") + F.col("src_len")).alias("line_no"), (F.col("tgt_len") - F.col("src_len")).alias("shift"), F.lit(0).alias("probe"), F.lit(None).cast("long").alias("ord"))
    probes = numbers.select(*keys, "line_no", F.lit(0).alias("shift"), F.lit(1).alias("probe"), F.col("ord").cast("long").alias("ord"))
    w = W.partitionBy(*keys).orderBy("line_no", "probe").rowsBetween(W.unboundedPreceding, 0)
    moved = ends.unionByName(probes).withColumn("moved", F.sum("shift").over(w)).where("probe = 1").select(*keys, "ord", "line_no", "moved")
    out = moved.join(at, [*keys, "line_no"], "left").where(~F.coalesce("gone", F.lit(False)))
    return out.select(*keys, "ord", "line_no", F.coalesce("tgt_no", F.col("line_no") + F.col("moved")).cast("int").alias("new_no"))


def merged_runs(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Runs of consecutive distinct numbers as first and last."""
    w = W.partitionBy(*keys).orderBy(number)
    return rows.select(*keys, number).distinct().withColumn("run", F.col(number) - F.row_number().over(w)).groupBy(*keys, "run").agg(F.min(number).alias("first"), F.max(number).alias("last")).drop("run")


def blocks_with_neighbours(rows: DataFrame, keys: list[str], order: list[str], kind: str, text: str) -> DataFrame:
    """Runs of rows of one kind as blocks (block, kind, text), with the texts of the block before and after."""
    w = W.partitionBy(*keys).orderBy(*order)
    changed = rows.withColumn("__new", (~F.col(kind).eqNullSafe(F.lag(kind).over(w)) | (F.row_number().over(w) == 1)).cast("int"))
    numbered = changed.withColumn("block", F.sum("__new").over(w) - 1)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda x: x[text]), "\n")
    blocks = numbered.groupBy(*keys, "block").agg(F.first(kind).alias(kind), joined.alias(text))
    b = W.partitionBy(*keys).orderBy("block")
    return blocks.withColumn("before", F.lag(text).over(b)).withColumn("after", F.lead(text).over(b))


def hunk_texts(lines: DataFrame, key: str = "case_id", keep: Column | None = None) -> DataFrame:
    """Each hunk as text again, of the lines for which ``keep`` holds; lengths in the header follow."""
    kept = lines if keep is None else lines.where(keep)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat("line_type", "value").alias("line")))), lambda x: x["line"]), "\n")
    old, new = F.count_if(F.col("line_type") != "+"), F.count_if(F.col("line_type") != "-")
    out = kept.groupBy(key, "file_idx", "path", "hunk_idx", "src_start", "tgt_start").agg(old.alias("old"), new.alias("new"), body.alias("body"))
    return out.select(key, "file_idx", "path", "hunk_idx", F.concat(F.format_string("@@ -%d,%d +%d,%d @@\n", "src_start", "old", "tgt_start", "new"), "body").alias("text"))


def patch_texts(texts: DataFrame, key: str = "case_id") -> DataFrame:
    """Hunk texts put together as one patch for each key, each with its file header."""
    each = F.struct("file_idx", "hunk_idx", F.format_string("--- a/%s\n+++ b/%s\n%s", "path", "path", "text").alias("text"))
    return texts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["text"]), "\n").alias("patch"))


def leave_one_out(parts: DataFrame, key: str, index: str, value: str) -> DataFrame:
    """For each part of a key, all others in order: key, left_out, rest (array)."""
    all_ = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(index, value))).alias("parts"))
    one = all_.select(key, F.explode(F.transform("parts", lambda p: p[index])).alias("left_out"), "parts")
    return one.select(key, "left_out", F.transform(F.filter("parts", lambda p: p[index] != F.col("left_out")), lambda p: p[value]).alias("rest"))


def essential_hunks(found: DataFrame, runs: DataFrame, key: str = "case_id", index: str = "hunk_idx") -> DataFrame:
    """Hunks without which a run's status has False in it; a single hunk is essential, and if none is, all are.

    found: key, index. runs: key, index (the hunk left out), status.
    """
    n = F.count("*").over(W.partitionBy(key))
    tried = found.join(runs.groupBy(key, index).agg(F.bool_or(F.contains("status", F.lit("False"))).alias("needed")), [key, index], "left")
    tried = tried.withColumn("needed", (n == 1) | F.coalesce("needed", F.lit(False)))
    return tried.withColumn("any", F.bool_or("needed").over(W.partitionBy(key))).where(F.col("needed") | ~F.col("any")).drop("needed", "any")


def changed_lines(lines: DataFrame, key: str = "case_id") -> DataFrame:
    """Added plus removed lines, hunks and chunks of each key."""
    total = lines.groupBy(key).agg(F.count_if(F.col("line_type").isin("+", "-")).alias("changed"), F.count_distinct("hunk_idx").alias("hunks"))
    return total.join(chunks(lines, key).groupBy(key).agg(F.count("*").alias("chunks")), key, "left").na.fill(0, ["chunks"])


def unique_moves(removed: DataFrame, added: DataFrame, keys: list[str]) -> DataFrame:
    """Removed lines whose text stands once among the removed and once among the added: where they moved. Blank lines don't count."""
    once = lambda rows, c: rows.where(F.col("value").rlike(r"[^ \t\n\x0B\f\r]")).groupBy(*keys, "value").agg(F.count("*").alias("n"), F.min(c).alias(c)).where("n = 1").drop("n")
    return once(removed, "src_no").join(once(added, "tgt_no"), [*keys, "value"])


def placed_additions(lines: DataFrame, key: str = "case_id") -> DataFrame:
    """For each added line the old line before and after it in its hunk (null at an edge)."""
    by = W.partitionBy(key, "file_idx", "hunk_idx").orderBy("pos")
    before = F.last("src_no", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, -1))
    after = F.first("src_no", ignorenulls=True).over(by.rowsBetween(1, W.unboundedFollowing))
    return lines.select("*", before.alias("old_before"), after.alias("old_after")).where("line_type = '+'")
