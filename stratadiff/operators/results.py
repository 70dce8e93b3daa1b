"""Comparison of locations with the truth, and analysis of run results: counts, shares, distributions, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratadiff.functions import sets
from stratadiff.operators.graphs import _cut

#: Buckets of counts (label, least, greatest); None is without end. Fixed values.
BUCKETS = [("1-2", 1, 2), ("3-4", 3, 4), ("5-6", 5, 6), ("7-8", 7, 8), ("9-10", 9, 10), ("11-20", 11, 20), ("21-50", 21, 50), ("51-100", 51, 100), (">100", 101, None)]


# --- locations ----------------------------------------------------------------------------------------------------------
def compared(truth: DataFrame, found: DataFrame, tools: DataFrame, keys: list[str], lines: str = "lines") -> DataFrame:
    """For each tool and true location how the found lines relate to it; a tool that found nothing there is Disjoint.

    ``tools`` is a small dimension (one row a tool); every tool meets every location.
    """
    named = [c for c in tools.columns]
    want = truth.select(*keys, F.col(lines).alias("__want"))
    every = want.withColumn("__tools", tools.agg(F.collect_set(named[0])).scalar()).select(*keys, "__want", F.explode("__tools").alias(named[0]))
    got = every.join(found.select(*keys, named[0], F.col(lines).alias("__got")), [*keys, named[0]], "left")
    return got.select(*keys, named[0], F.when(F.col("__got").isNull(), "Disjoint").otherwise(sets.relation(F.col("__want"), F.col("__got"))).alias("relation"))


def rolled_up(parts: DataFrame, keys: list[str]) -> DataFrame:
    return parts.groupBy(*keys).agg(sets.rolled_up(F.collect_set("relation")).alias("relation"))


def relation_counts(parts: DataFrame, by: str) -> DataFrame:
    """A row for each tool with the count of each relation, 0 where there is none."""
    return parts.groupBy(by).agg(*(F.count_if(F.col("relation") == r).alias(r.lower()) for r in sets.RELATIONS))


# --- counts and shares ----------------------------------------------------------------------------------------------------
def distribution(rows: DataFrame, value: Column, buckets: list = BUCKETS) -> DataFrame:
    """bucket, n and percent of all counted values, a row for each bucket in order. Values that are null or below 1 don't count."""
    rules = [(value >= low) & (F.lit(True) if high is None else value <= high) for _, low, high in buckets]
    place = F.coalesce(*(F.when(rule, F.lit(i)) for i, rule in enumerate(rules)))
    counted = rows.select(place.alias("place")).where("place IS NOT NULL").groupBy("place").agg(F.count("*").alias("n"))
    spark = rows.sparkSession
    names = spark.range(len(buckets)).select(F.col("id").cast("int").alias("place"), F.element_at(F.array(*(F.lit(b[0]) for b in buckets)), (F.col("id") + 1).cast("int")).alias("bucket"))
    filled = names.join(counted, "place", "left").na.fill(0, ["n"])
    return filled.select("place", "bucket", "n", F.coalesce(F.round(F.try_divide(F.col("n") * 100.0, F.sum("n").over(W.partitionBy(F.lit(1)))), 2), F.lit(0.0)).alias("percent"))


def accuracy(rows: DataFrame, keys: list[str], good: Column, digits: int = 3) -> DataFrame:
    """right, total and their ratio for each key, worst first when ordered by ``accuracy``."""
    out = rows.groupBy(*keys).agg(F.count_if(good).alias("right"), F.count("*").alias("total"))
    return out.withColumn("accuracy", F.round(F.try_divide(F.col("right").cast("double"), F.col("total")), digits))


def conditional_shares(part: DataFrame, whole: DataFrame, by: list[str], digits: int = 6) -> DataFrame:
    """Counts of ``part`` over counts of ``whole`` for each value of ``by``, whose rows come from another table."""
    a, b = part.groupBy(*by).agg(F.count("*").alias("n")), whole.groupBy(*by).agg(F.count("*").alias("of"))
    return b.join(a, by, "left").na.fill(0, ["n"]).withColumn("share", F.round(F.try_divide(F.col("n").cast("double"), F.col("of")), digits))


def fixed_shares(rows: DataFrame, by: str, values: list, good: Column, of: dict | int, digits: int = 6) -> DataFrame:
    """Counts of good rows for each of ``values``, 0 where there is none, over fixed denominators: one for all, or one for each value."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(v, int(of[v] if isinstance(of, dict) else of), i) for i, v in enumerate(values)], f"{by} {rows.schema[by].dataType.simpleString()}, of long, ord int")
    counted = rows.groupBy(by).agg(F.count_if(good).alias("n"))
    return F.broadcast(names).join(counted, by, "left").na.fill(0, ["n"]).withColumn("share", F.round(F.try_divide(F.col("n").cast("double"), F.col("of")), digits)).select("ord", by, "n", "of", "share")


def mean_of(numbers: DataFrame, column: str) -> DataFrame:
    """One row: the mean of a column; null for no row."""
    return numbers.agg(F.avg(column).alias("mean"), F.count(column).alias("n"))


def distinct_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Each line once, in no order."""
    return lines.select(value).distinct()


def new_repositories(addresses: DataFrame, there: DataFrame, column: str = "url") -> DataFrame:
    """owner, repo and address of each repository that addresses name, once, but for those in ``there`` (owner, repo)."""
    parts = F.split(column, "/")
    named = addresses.where(F.size(parts) >= 5).select(F.get(parts, 3).alias("owner"), F.get(parts, 4).alias("repo"), F.array_join(F.slice(parts, 1, 5), "/").alias("address"))
    return named.distinct().join(there.select("owner", "repo").distinct(), ["owner", "repo"], "left_anti")


def counted(rows: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias(name))


def true_then_false(rows: DataFrame, flag: str, key: str) -> DataFrame:
    """Rows with their place (from 1) when the true ones come first, each part in order of ``key``. Places are numbered without one task
    for all rows: counts of key ranges first, then within each range. Ranges are written with their numbers before, as bounds that are
    sampled twice differ."""
    ranged = _cut(rows.repartitionByRange(F.desc(flag), F.asc(key)).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    starts = sizes.withColumn("__before", F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, 0)) - F.col("__n"))
    placed = ranged.withColumn("__k", F.row_number().over(W.partitionBy("__part").orderBy(F.desc(flag), F.asc(key))))
    return placed.join(starts, "__part").withColumn("place", F.col("__before") + F.col("__k")).drop("__part", "__n", "__before", "__k")


def first_long_history(history: DataFrame, keys: list[str], order: str, more_than: int = 2) -> DataFrame:
    """Of each key the first file in ``order`` whose history (array commits) has more commits than that."""
    return first_of(history.where(F.size("commits") > more_than), keys, [F.asc(order)])


def context_with_status(contexts: DataFrame, statuses: DataFrame, keys: list[str]) -> DataFrame:
    """Contexts (keys, model, name) with the status of the first result (keys, ord, part_of_model, part_of_name, status) whose two
    parts are in them; null without one."""
    joined = contexts.join(statuses, keys, "left")
    hit = F.contains("model", F.col("part_of_model")) & F.contains("name", F.col("part_of_name"))
    return joined.groupBy(*keys, "model", "name").agg(F.min_by(F.when(hit, F.col("status")), F.when(hit, F.col("ord"))).alias("status"))


def repeated(rows: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Of each key the first row in ``order``."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def last_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return first_of(rows, keys, [F.desc(order)])


def disagreeing(a: DataFrame, b: DataFrame, key: str, status: str) -> DataFrame:
    """Keys that both tables have with different statuses."""
    both = a.select(key, F.col(status).alias("a_status")).join(b.select(key, F.col(status).alias("b_status")), key)
    return both.where("a_status <> b_status")


def links_by_key(rows: DataFrame, key: str, link: str) -> DataFrame:
    """The distinct links of each key, in order."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(link)).alias("links"))


def paired_rows(rows: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    """Rows 2k and 2k+1 as one: first and second."""
    return rows.withColumn("pair", F.floor(F.col(pos) / 2)).groupBy(*keys, "pair").agg(F.min_by(value, pos).alias("first"), F.max_by(value, pos).alias("second"), F.count("*").alias("__n")).where("__n = 2").drop("__n")


def commit_sizes(commits: DataFrame, keys: list[str]) -> DataFrame:
    """Commits, mean changed lines, and changed lines of each commit as a map."""
    return commits.groupBy(*keys).agg(F.count_distinct("commit_id").alias("commits"), F.avg("changed").alias("mean_changed"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("commit_id", "changed")))).alias("sizes"))


def touched_files(paths: DataFrame, keys: list[str], is_source: Column) -> DataFrame:
    return paths.groupBy(*keys).agg(F.count_if(is_source).alias("files"))


def most_changed(rows: DataFrame, keys: list[str], files: str, order: str) -> DataFrame:
    """Of each key the patch that touches most source files, the first of equal ones."""
    return first_of(rows, keys, [F.desc(files), F.asc(order)])


def latest_half(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Without the first half of each key's rows."""
    w = W.partitionBy(*keys)
    numbered = rows.withColumn("__k", F.row_number().over(w.orderBy(order))).withColumn("__n", F.count("*").over(w))
    return numbered.where(F.col("__k") > F.floor(F.col("__n") / 2)).drop("__k", "__n")


# --- lookups and containment -------------------------------------------------------------------------------------------
def looked_up(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``dimension``; a key that it lacks is an error and not a lost row."""
    found = rows.join(dimension.withColumn("__there", F.lit(True)), key, "left")
    missing = F.raise_error(F.concat(F.lit("no entry for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return found.where(F.when(F.col("__there"), True).otherwise(missing.cast("boolean"))).drop("__there")


def first_by_order(rows: DataFrame, lookup: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The value that the first entry of a key has, null without one."""
    one = first_of(lookup, [key], [order]).select(key, value)
    return rows.join(one, key, "left")


def innermost(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, open_start: bool = False, default: str | None = None, bin_size: int = 64) -> DataFrame:
    """Each point (keys, at) with the name of the shortest range (keys, start_line, end_line, name) around it.

    Ranges without a name don't count. Ranges are dealt into bins of ``bin_size`` lines, so points meet only ranges near them.
    ``open_start``: the first line of a range is outside.
    """
    named = ranges.where("name IS NOT NULL AND name <> ''")
    bins = F.sequence(F.floor(F.col("start_line") / bin_size), F.floor(F.col("end_line") / bin_size))
    dealt = named.select(*keys, "start_line", "end_line", "name", F.explode(bins).alias("__bin"))
    p = points.withColumn("__bin", F.floor(F.col(at) / bin_size))
    inside = (F.col(at) > F.col("start_line") if open_start else F.col(at) >= F.col("start_line")) & (F.col(at) <= F.col("end_line"))
    best = p.join(dealt, [*keys, "__bin"]).where(inside).groupBy(*keys, at).agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("span"), F.col("start_line"), F.col("name"))).alias("x"))
    out = points.join(best.select(*keys, at, F.col("x.name").alias("name")), [*keys, at], "left")
    return out.withColumn("name", F.coalesce("name", F.lit(default))) if default is not None else out


def outside_all(points: DataFrame, ranges: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Points in no range at all."""
    return innermost(points, ranges.withColumn("name", F.lit("x")), keys, at).where("name IS NULL").drop("name")


def in_both(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b, keys, "left_semi").select(*keys).distinct()


def unprocessed(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys were not processed yet."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


#: Names that are always there. Fixed values.
AMBIENT = ["Error", "Object", "Array", "isNaN", "parseInt", "require", "console", "TypeError", "JSON"]


def dependency_labels(parts: DataFrame, keys: list[str], index: str) -> DataFrame:
    """label of each chunk (pre_def, pre_use, post_def, post_use: arrays): 2 if it needs no name from elsewhere, 1 if all
    that it needs are in other names of the same patch, else 0."""
    need = F.array_except(F.array_except(F.array_except(F.array_except(F.array_distinct("post_use"), F.col("post_def")), F.array(*map(F.lit, AMBIENT))), F.col("pre_use")), F.col("pre_def"))
    tried = parts.select(*keys, index, need.alias("need"), F.array_union(F.array_union("pre_use", "post_def"), F.col("pre_def")).alias("has"))
    offered = tried.select(*keys, F.explode("has").alias("name")).distinct().withColumn("there", F.lit(True))
    wants = tried.select(*keys, index, F.explode("need").alias("name")).join(offered, [*keys, "name"], "left")
    met = wants.groupBy(*keys, index).agg(F.bool_and(F.col("there").isNotNull()).alias("met"))
    return tried.select(*keys, index).join(met, [*keys, index], "left").withColumn("label", F.when(F.col("met").isNull(), 2).when(F.col("met"), 1).otherwise(0)).drop("met")
