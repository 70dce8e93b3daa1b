"""Questions about lines of diffs and files (case keys, path, line_no, value) and about lists of files, texts and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratadiff.functions import text as T


def of_sources(lines: DataFrame) -> DataFrame:
    """Diff lines of script files alone."""
    return lines.where(T.script_source(F.col("path")))


def with_text(lines: DataFrame) -> DataFrame:
    """Diff lines that aren't blank, of scripts that aren't new."""
    return lines.where(F.endswith("path", F.lit(".js")) & ~F.col("is_new") & (T.stripped(F.col("value")) != ""))


def removed_between(lines: DataFrame, first: Column, last: Column) -> DataFrame:
    """Removed lines with old numbers in a range, both ends included, without a bound on the numbers."""
    return lines.where((F.col("line_type") == "-") & F.col("src_no").between(first, last))


def removed_numbers(lines: DataFrame, keys: list[str]) -> DataFrame:
    return lines.where("line_type = '-'").groupBy(*keys).agg(F.array_sort(F.collect_list("src_no")).alias("lines"))


def added_among(lines: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Added lines whose new numbers are wanted (keys, tgt_no)."""
    return lines.where("line_type = '+'").join(wanted, [*keys, "tgt_no"], "left_semi")


def added_by_commit(lines: DataFrame, keys: list[str]) -> DataFrame:
    return lines.where("line_type = '+'").groupBy(*keys).agg(F.array_sort(F.collect_list("tgt_no")).alias("lines"))


def content_at(lines: DataFrame, keys: list[str], number: Column) -> DataFrame:
    """The text of the removed line of a number."""
    return lines.where((F.col("line_type") == "-") & (F.col("src_no") == number)).groupBy(*keys).agg(F.min_by("value", "pos").alias("value"))


def numbers_containing(lines: DataFrame, keys: list[str], part: Column) -> DataFrame:
    """Numbers of the lines that contain a text."""
    return lines.where(F.contains("value", part)).groupBy(*keys).agg(F.array_sort(F.collect_list("line_no")).alias("lines"))


def first_equal(lines: DataFrame, keys: list[str], text: Column, start: Column) -> DataFrame:
    """For each key the first line from ``start`` on that equals a text but for blanks, -1 without one."""
    hit = F.when((T.normalized(F.col("value")) == T.normalized(text)) & (F.col("line_no") >= start), F.col("line_no"))
    return lines.groupBy(*keys).agg(F.coalesce(F.min(hit), F.lit(-1)).cast("int").alias("line_no"))


def next_full(numbers: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Each number moved on to the next line that isn't blank; -1 at the end of the file."""
    full = lines.where(T.stripped(F.col("value")) != "").select(*keys, F.col("line_no").alias("__at"), F.lit(0).alias("__probe"), F.lit(None).cast("int").alias("line_no"))
    probes = numbers.select(*keys, F.col("line_no").alias("__at"), F.lit(1).alias("__probe"), F.col("line_no").cast("int").alias("line_no"))
    w = W.partitionBy(*keys).orderBy(F.desc("__at"), "__probe").rowsBetween(W.unboundedPreceding, 0)
    moved = F.last(F.when(F.col("__probe") == 0, F.col("__at")), ignorenulls=True).over(w)
    out = full.unionByName(probes).withColumn("full_no", F.coalesce(moved, F.lit(-1)).cast("int")).where("__probe = 1")
    return out.select(*keys, "line_no", "full_no")


def context_after(lines: DataFrame, keys: list[str], last_target: Column) -> DataFrame:
    """The old number of the first context line after a new line number in each hunk."""
    after = lines.where((F.col("line_type") == " ") & (F.col("tgt_no") > last_target))
    return after.groupBy(*keys).agg(F.min_by("src_no", "tgt_no").alias("src_no"))


def place_of_block(lines: DataFrame, block: DataFrame, keys: list[str]) -> DataFrame:
    """Where in a file a block of texts (keys, ord, value) stands one line after another: number of its first line, the first of several."""
    size = block.groupBy(*keys).agg(F.count("*").alias("n"), F.min("ord").alias("low"))
    same = lines.join(block, [*keys, "value"]).select(*keys, (F.col("line_no") - F.col("ord")).alias("shift"), "ord").distinct()
    return same.groupBy(*keys, "shift").agg(F.count("*").alias("hits")).join(size, keys).where("hits = n").groupBy(*keys).agg((F.min(F.col("shift") + F.col("low"))).alias("line_no"))


def exact_matches(lines: DataFrame, candidates: DataFrame, keys: list[str], first: Column, last: Column, least: float = 0.95) -> DataFrame:
    """Numbers of file lines in a range that are nearly a candidate line, once for each candidate."""
    from .likeness import ratio_join

    near = lines.where(F.col("line_no").between(first, last))
    return ratio_join(near, candidates, keys, "value", least).select(*(F.col(f"l_{k}").alias(k) for k in keys), F.col("l_line_no").alias("line_no"))


def renamed_lines(removed: DataFrame, target: DataFrame, keys: list[str], files: DataFrame, least: float = 0.9) -> DataFrame:
    """Removed lines that stand in another file of the commit, nearly the same; only where it has two script files or more."""
    from .likeness import ratio_join

    several = files.where(F.endswith("path", F.lit(".js"))).groupBy(*keys).agg(F.count_distinct("path").alias("n")).where("n >= 2").select(*keys)
    return ratio_join(removed.join(several, keys, "left_semi"), target, keys, "value", least, strict=False)


def without_own_commit(commits: DataFrame, patch: Column) -> DataFrame:
    """Commits but for the patch's own: those whose id the patch's id contains."""
    return commits.where(~F.contains(patch, F.col("commit_id")))


def has_tests(files: DataFrame, keys: list[str]) -> DataFrame:
    return files.groupBy(*keys).agg(F.bool_or(T.is_test_path(F.col("path"))).alias("tested"))


def changed_outside(files: DataFrame, month: int) -> DataFrame:
    """Files last changed in another month."""
    return files.where(F.month("changed") != month)


def shrunk(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Entries that are shorter than they were."""
    both = before.select(*keys, F.char_length(value).alias("was")).join(after.select(*keys, F.char_length(value).alias("now")), keys)
    return both.where("now < was")


def of_model(documents: DataFrame, model: str, version: str | None = None) -> DataFrame:
    rows = documents.where(F.contains("model", F.lit(model)))
    return rows if version is None else rows.where(F.col("version") == version)


def matching_text(rows: DataFrame, columns: list[str], pattern: str) -> DataFrame:
    """Rows in which a column contains a text."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(c, F.lit(pattern)), F.lit(False))
    return rows.where(hit)


def ordered_versions(tags: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct cleaned version tags as text in order of characters."""
    return tags.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.collect_list(T.clean_tag(F.col("tag"))))).alias("versions"))
