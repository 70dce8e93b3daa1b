"""Line numbers carried over many commits: a diff as a map of ranges of lines, and chains of maps composed by jumps that double.

A map has rows (keys, step, first, last, shift): old lines first to last (null: without an end) become line + shift; lines in no row are
removed. Composing two maps meets ranges of the first, moved, with those of the second, so it is associative, and a chain of n maps is
composed in a logarithm of n rounds. Each round writes its rows, so a lost executor repeats none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratadiff.operators.graphs import _cut


def line_map(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The maps of diffs, from their lines (keys, hunk_idx, src_start, src_len, tgt_start, tgt_len, line_type, src_no, tgt_no): keys, first, last,
    shift. Context keeps its place in the new hunk, lines outside of hunks move by what the hunks before them add. Ranges do not overlap.

    Keys without hunks have no row: such a diff changes nothing, see ``identity``.
    """
    w = W.partitionBy(*keys).orderBy("at", "src_len")
    hunks = lines.select(*keys, "hunk_idx", "src_start", "src_len", "tgt_len").distinct()
    # A hunk without old lines stands behind the line that its header names.
    placed = hunks.withColumn("at", F.when(F.col("src_len") == 0, F.col("src_start") + 1).otherwise(F.col("src_start")))
    moved = F.sum(F.col("tgt_len") - F.col("src_len")).over(w.rowsBetween(W.unboundedPreceding, 0))
    after = placed.select(*keys, (F.col("at") + F.col("src_len")).alias("first"), (F.lead("at").over(w) - 1).alias("last"), moved.alias("shift"))
    first = placed.groupBy(*keys).agg((F.min("at") - 1).alias("last")).select(*keys, F.lit(1).alias("first"), "last", F.lit(0).alias("shift"))
    kept = lines.where("line_type = ' '").select(*keys, "src_no", (F.col("tgt_no") - F.col("src_no")).alias("shift")).distinct()
    run = F.col("src_no") - F.row_number().over(W.partitionBy(*keys, "shift").orderBy("src_no"))
    inside = kept.withColumn("run", run).groupBy(*keys, "shift", "run").agg(F.min("src_no").alias("first"), F.max("src_no").alias("last"))
    columns = [*keys, *(F.col(c).cast("int").alias(c) for c in ("first", "last", "shift"))]
    every = after.select(*columns).unionByName(first.select(*columns)).unionByName(inside.select(*columns))
    return every.where("last IS NULL OR first <= last")


def identity(steps: DataFrame) -> DataFrame:
    """Maps that change nothing, one for each row."""
    return steps.select("*", F.lit(1).alias("first"), F.lit(None).cast("int").alias("last"), F.lit(0).alias("shift"))


def composed(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """``a``, then ``b``: rows of both (``on``, first, last, shift) whose ranges meet, as ranges of ``a``'s old lines. Other columns of ``a`` stay."""
    other = b.select(*on, *(F.col(c).alias(f"b_{c}") for c in ("first", "last", "shift")))
    no_end = F.lit((1 << 31) - 1)
    first = F.greatest(F.col("first"), F.col("b_first") - F.col("shift"))
    last = F.least(F.coalesce("last", no_end), F.coalesce(F.col("b_last") - F.col("shift"), no_end))
    columns = [c for c in a.columns if c not in ("first", "last", "shift")]
    met = F.struct(*columns, first.alias("first"), F.when(last < no_end, last).alias("last"), (F.col("shift") + F.col("b_shift")).alias("shift"))
    return a.join(other, on).select(_if(first <= last, met))


def _if(rule: Column, row: Column) -> Column:
    """The fields of ``row`` where the rule holds, else no row. A filter would do, but Spark keeps what filters say of columns, also of written
    ones, and infers more from it each round, until rounds of computed columns have filters of unbounded size."""
    return F.inline(F.when(rule, F.array(row)))


def _written(rows: DataFrame) -> DataFrame:
    """The rows, written, and all columns made anew from them, so that the next round's plan knows nothing of what this round's filters, joins
    and sums said of its columns (see ``_if``)."""
    written = _cut(rows)
    return written.select(F.inline(F.array(F.struct(*written.columns))))


def jumps(maps: DataFrame, keys: list[str], steps: int) -> list[DataFrame]:
    """Of chains of maps (keys, step: 0, 1, ... without gaps, first, last, shift) the compositions of 1, 2, 4, ... steps in a row, up to ``steps``
    steps, that begin at a multiple of their number of steps. So however many ranges a composition has, each round has no more rows than
    there are ranges in all maps."""
    out = [_written(maps.select(*keys, "step", "first", "last", "shift"))]
    size = 1
    while 2 * size <= steps:
        near, far = out[-1].where(F.col("step") % (2 * size) == 0), out[-1].withColumnRenamed("step", "far")
        doubled = composed(near.withColumn("far", F.col("step") + size), far, [*keys, "far"]).drop("far")
        out.append(_written(doubled.select(*keys, "step", "first", "last", "shift")))
        size *= 2
    return out


def carried(lines: DataFrame, maps: DataFrame, keys: list[str], start: str = "start", upto: str = "upto") -> DataFrame:
    """Lines (keys, ``start``, ``upto``, line_no; other columns stay) through all maps from step ``start`` up to the one before step
    ``upto``: with ``new_no``, lines that some step removes left out. ``upto`` not above ``start`` changes nothing.

    First small jumps up to where a greater one begins, then the greatest that fit and smaller ones down to the end: n steps are at most
    two joins for each binary digit of n.
    """
    left = F.greatest(F.col(upto) - F.col(start), F.lit(0))
    rows = _written(lines.withColumn("__at", F.col(start)).withColumn("__left", left).withColumn("new_no", F.col("line_no")))
    most = rows.agg(F.max("__left")).first()[0] or 0
    every = jumps(maps, keys, most) if most else []
    columns = rows.columns

    def taken(rows: DataFrame, i: int, take) -> DataFrame:
        jump = every[i].select(*keys, F.col("step").alias("__at"), *(F.col(c).alias(f"__{c}") for c in ("first", "last", "shift")))
        inside = (F.col("new_no") >= F.col("__first")) & (F.col("__last").isNull() | (F.col("new_no") <= F.col("__last")))
        went = F.struct((F.col("new_no") + F.col("__shift")).alias("new_no"), (F.col("__at") + (1 << i)).alias("__at"), (F.col("__left") - (1 << i)).alias("__left"))
        same = [c for c in columns if c not in ("new_no", "__at", "__left")]
        moved = rows.where(take).join(jump, [*keys, "__at"]).select(*same, _if(inside, went))
        stay = rows.select(*same, _if(~take, F.struct("new_no", "__at", "__left")))
        return _written(moved.unionByName(stay))

    for i in range(len(every)):
        rows = taken(rows, i, (F.col("__left") >= (1 << i)) & (F.col("__at") % (1 << i + 1) != 0))
    for i in reversed(range(len(every))):
        rows = taken(rows, i, F.col("__left") >= (1 << i))
    return rows.drop("__at", "__left")
