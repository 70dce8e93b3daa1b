"""Commit graphs as edge tables (repo, commit_id, parent_id, parent_idx): ancestry, order, history, as-of lookups."""

from __future__ import annotations

import tempfile
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _cut(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder of spark.checkpoint.dir, so a lost executor repeats no rounds. On one machine, where
    the session names no folder, a temporary one."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="stratadiff-checkpoints-"))
    return df.checkpoint()


def _dealt(df: DataFrame, *by: str) -> DataFrame:
    """The rows dealt by columns to several tasks for each core, before work in Python that takes long: a small file is read by one or two
    tasks, however many rows come of it. The number is given, so that few bytes aren't put together again."""
    session = df.sparkSession
    return df.repartition(max(int(session.conf.get("spark.sql.shuffle.partitions")), 8 * session.sparkContext.defaultParallelism), *by)


def closure(edges: DataFrame, child: str, parent: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Every (keys, child, ancestor) pair, themselves not included. Paths double in each round, so depth d takes log d rounds."""
    step = _cut(edges.where(F.col(parent).isNotNull()).select(*keys, F.col(child).alias("child"), F.col(parent).alias("ancestor")).distinct())
    count = step.count()
    while True:
        a, b = step.select(*keys, "child", F.col("ancestor").alias("mid")), step.select(*keys, F.col("child").alias("mid"), "ancestor")
        step = _cut(step.unionByName(a.join(b, [*keys, "mid"]).select(*keys, "child", "ancestor")).distinct())
        before, count = count, step.count()
        if count == before:
            return step


def chains(edges: DataFrame, child: str, parent: str, keys: list[str] = []) -> tuple[DataFrame, DataFrame]:  # noqa: B006
    """A history with its unbranched stretches as one: each commit's chain (keys, commit_id, head, dist: steps from the chain's oldest
    commit), and the links of chains (keys, head, parent_head, parent_dist), one for each parent of an oldest commit.

    A commit continues its parent's chain if it has no other parent and the parent no other child. Chains are followed by
    jumps that double, so a linear history of n commits takes log n rounds.
    """
    every = _cut(edges.select(*keys, F.col(child).alias("commit_id"), F.col(parent).alias("parent")).distinct())
    known = every.where("parent IS NOT NULL")
    nodes = every.select(*keys, "commit_id").unionByName(known.select(*keys, F.col("parent").alias("commit_id"))).distinct()
    only = known.groupBy(*keys, "commit_id").agg(F.count("*").alias("parents"), F.min("parent").alias("parent")).where("parents = 1")
    heirs = known.groupBy(*keys, "parent").agg(F.count("*").alias("children")).where("children = 1").select(*keys, "parent")
    inner = only.join(heirs, [*keys, "parent"], "left_semi").select(*keys, "commit_id", F.col("parent").alias("head"), F.lit(1).cast("long").alias("dist"))
    jumps = _cut(nodes.join(inner, [*keys, "commit_id"], "left").select(*keys, "commit_id", F.coalesce("head", "commit_id").alias("head"), F.coalesce("dist", F.lit(0)).alias("dist")))
    for _ in range(64):
        on = jumps.select(*keys, F.col("commit_id").alias("head"), F.col("head").alias("far"), F.col("dist").alias("more"))
        jumped = _cut(jumps.join(on, [*keys, "head"]).select(*keys, "commit_id", F.col("far").alias("head"), (F.col("dist") + F.col("more")).alias("dist"), "more"))
        jumps = jumped.drop("more")
        if jumped.where("more > 0").isEmpty():
            break
    else:
        raise ValueError("the history has a cycle")
    tops = known.join(jumps.where("dist = 0").select(*keys, "commit_id"), [*keys, "commit_id"], "left_semi")
    links = tops.join(jumps.select(*keys, F.col("commit_id").alias("parent"), F.col("head").alias("parent_head"), F.col("dist").alias("parent_dist")), [*keys, "parent"])
    return jumps, _cut(links.select(*keys, F.col("commit_id").alias("head"), "parent_head", "parent_dist"))


def depths(edges: DataFrame, child: str, parent: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """keys, commit_id, depth: the length of the longest way back to a commit without a parent. Chains whose parents are all known are
    peeled in rounds, as many as there are branchings on one way."""
    members, links = chains(edges, child, parent, keys)
    heads = members.where("dist = 0").select(*keys, "head")
    known = _cut(heads.join(links, [*keys, "head"], "left_anti").withColumn("depth", F.lit(0).cast("long")))
    left = _cut(links)
    while not left.isEmpty():
        above = left.join(known.select(*keys, F.col("head").alias("parent_head"), F.col("depth").alias("above")), [*keys, "parent_head"], "left")
        deep = above.groupBy(*keys, "head").agg(F.max(F.col("above") + F.col("parent_dist") + 1).alias("depth"), F.bool_and(F.col("above").isNotNull()).alias("ready"))
        fresh = _cut(deep.where("ready").select(*keys, "head", "depth"))
        if fresh.isEmpty():
            raise ValueError("the history has a cycle")
        known, left = _cut(known.unionByName(fresh)), _cut(left.join(fresh, [*keys, "head"], "left_anti"))
    return members.join(known, [*keys, "head"]).select(*keys, "commit_id", (F.col("depth") + F.col("dist")).alias("depth"))


def ranks(edges: DataFrame, child: str, parent: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Topological rank of each commit (from 1): by depth, ties by id. Ancestors always rank lower.

    Ranks are numbered in two steps, over counts of depths and within a depth, so no task sorts a whole history.
    """
    rows = _cut(depths(edges, child, parent, keys))
    sizes = rows.groupBy(*keys, "depth").agg(F.count("*").alias("n"))
    upto = F.sum("n").over((W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))).orderBy("depth").rowsBetween(W.unboundedPreceding, 0))
    starts = sizes.select(*keys, "depth", (upto - F.col("n")).alias("before"))
    within = F.row_number().over(W.partitionBy(*keys, "depth").orderBy("commit_id"))
    return rows.withColumn("k", within).join(starts, [*keys, "depth"]).select(*keys, "commit_id", "depth", (F.col("before") + F.col("k")).alias("rank"))


def reached(asked: DataFrame, members: DataFrame, links: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """keys, commit_id, head, upto: from each asked commit the chains (see ``chains``) it comes from, itself included, each up to the
    distance ``upto``. One row for each chain, not for each ancestor."""
    seen = _cut(asked.select(*keys, "commit_id").distinct().join(members, [*keys, "commit_id"]).select(*keys, "commit_id", "head", F.col("dist").alias("upto")))
    edge = seen
    while True:
        back = edge.select(*keys, "commit_id", "head").join(links, [*keys, "head"]).select(*keys, "commit_id", F.col("parent_head").alias("head"), F.col("parent_dist").alias("upto"))
        found = back.groupBy(*keys, "commit_id", "head").agg(F.max("upto").alias("upto"))
        before = seen.select(*keys, "commit_id", "head", F.col("upto").alias("was"))
        edge = _cut(found.join(before, [*keys, "commit_id", "head"], "left").where("was IS NULL OR upto > was"))
        if edge.isEmpty():
            return seen
        seen = _cut(seen.unionByName(edge.select(*keys, "commit_id", "head", "upto")).groupBy(*keys, "commit_id", "head").agg(F.max("upto").alias("upto")))
        edge = edge.where("was IS NULL").select(*keys, "commit_id", "head")


def ancestry(pairs: DataFrame, edges: DataFrame, a: str, b: str, keys: list[str] = [], child: str = "commit_id", parent: str = "parent_id") -> DataFrame:  # noqa: B006
    """``pairs`` with over (a is b or an ancestor of b) and under (b is a or an ancestor of a), without the closure of the history: only asked commits are followed."""
    members, links = chains(edges, child, parent, keys)
    ends = pairs.select(*keys, F.col(a).alias("commit_id")).unionByName(pairs.select(*keys, F.col(b).alias("commit_id"))).distinct()
    from_ = reached(ends, members, links, keys)

    def holds(rows: DataFrame, low: str, high: str, name: str) -> DataFrame:
        at = members.select(*keys, F.col("commit_id").alias(low), "head", "dist")
        hit = rows.select(*keys, a, b).distinct().join(at, [*keys, low]).join(from_.withColumnRenamed("commit_id", high), [*keys, high, "head"]).where("dist <= upto")
        return rows.join(hit.select(*keys, a, b, F.lit(True).alias(name)).distinct(), [*keys, a, b], "left").withColumn(name, F.coalesce(name, F.lit(False)))

    return holds(holds(pairs, a, b, "over"), b, a, "under")


def commits_between(pairs: DataFrame, edges: DataFrame, low: str, high: str, keys: list[str] = [], child: str = "commit_id", parent: str = "parent_id") -> DataFrame:  # noqa: B006
    """As ``between``, without the closure: of each chain that ``high`` reaches, the commits beyond what ``low`` reaches of it."""
    members, links = chains(edges, child, parent, keys)
    ends = pairs.select(*keys, F.col(low).alias("commit_id")).unionByName(pairs.select(*keys, F.col(high).alias("commit_id"))).distinct()
    from_ = reached(ends, members, links, keys)
    side = lambda end, name: pairs.select(*keys, low, high).distinct().join(from_.select(*keys, F.col("commit_id").alias(end), "head", F.col("upto").alias(name)), [*keys, end])
    both = side(high, "to").join(side(low, "from_").select(*keys, low, high, "head", "from_"), [*keys, low, high, "head"], "left")
    return both.join(members, [*keys, "head"]).where((F.col("dist") <= F.col("to")) & (F.col("dist") > F.coalesce("from_", F.lit(-1)))).select(*keys, low, high, "commit_id")


def ancestor_counts(edges: DataFrame, child: str, parent: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """keys, commit_id, ancestors: of how many other commits each comes, for all commits of the edges, without the closure of the history.

    Commits are followed by jumps that double to the nearest one that has no parent or several. From one without a parent on, each step is
    one ancestor more; for those with several (merges) the chains they come from are counted (see ``reached``).
    """
    every = _cut(edges.select(*keys, F.col(child).alias("commit_id"), F.col(parent).alias("parent")).distinct())
    known = every.where("parent IS NOT NULL")
    both = every.select(*keys, "commit_id", "parent").unionByName(known.select(*keys, F.col("parent").alias("commit_id"), F.lit(None).cast(every.schema["parent"].dataType).alias("parent")))
    steps = _cut(both.groupBy(*keys, "commit_id").agg(F.count("parent").alias("parents"), F.min("parent").alias("head")))
    done = steps.where("parents <> 1").select(*keys, "commit_id", F.col("commit_id").alias("head"), F.lit(0).cast("long").alias("dist"))
    left = steps.where("parents = 1").select(*keys, "commit_id", "head", F.lit(1).cast("long").alias("dist"))
    for _ in range(64):
        on = done.withColumn("ends", F.lit(True)).unionByName(left.withColumn("ends", F.lit(False)))
        on = on.select(*keys, F.col("commit_id").alias("head"), F.col("head").alias("far"), F.col("dist").alias("more"), "ends")
        jumped = _cut(left.hint("merge").join(on, [*keys, "head"]).select(*keys, "commit_id", F.col("far").alias("head"), (F.col("dist") + F.col("more")).alias("dist"), "ends"))
        done, left = done.unionByName(jumped.where("ends").drop("ends")), jumped.where("NOT ends").drop("ends")
        if left.isEmpty():
            break
    else:
        raise ValueError("the history has a cycle")
    merges = steps.where("parents > 1").select(*keys, "commit_id")
    if merges.isEmpty():
        return done.select(*keys, "commit_id", F.col("dist").alias("ancestors"))
    more = reached(merges, *chains(edges, child, parent, keys), keys).groupBy(*keys, F.col("commit_id").alias("head")).agg((F.sum(F.col("upto") + 1) - 1).alias("more"))
    return done.join(more, [*keys, "head"], "left").select(*keys, "commit_id", (F.col("dist") + F.coalesce("more", F.lit(0))).alias("ancestors"))


def files_of(versions: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct paths of each asked commit (keys, commit_id) in order, as an array; a commit without files has an empty one."""
    found = versions.join(asked.select(*keys, "commit_id").distinct(), [*keys, "commit_id"], "left_semi").groupBy(*keys, "commit_id").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    return asked.select(*keys, "commit_id").distinct().join(found, [*keys, "commit_id"], "left").withColumn("paths", F.coalesce("paths", F.array().cast("array<string>")))


def file_at(versions: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """The text of each asked file (keys, commit_id, path); empty where the commit has none."""
    return asked.join(versions.select(*keys, "commit_id", "path", "text"), [*keys, "commit_id", "path"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def earlier(pairs: DataFrame, ancestors: DataFrame, a: str, b: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """``pairs`` with ``earlier``: the ids are equal or one is part of the other, or b is no ancestor of a. So commits of
    branches that diverge are earlier both ways. ``strictly``: a is an ancestor of b."""
    up = ancestors.select(*keys, F.col("child").alias(a), F.col("ancestor").alias(b), F.lit(True).alias("__over"))
    down = ancestors.select(*keys, F.col("child").alias(b), F.col("ancestor").alias(a), F.lit(True).alias("__under"))
    same = F.contains(F.col(a), F.col(b)) | F.contains(F.col(b), F.col(a))
    joined = pairs.join(up, [*keys, a, b], "left").join(down, [*keys, a, b], "left")
    return joined.withColumn("earlier", same | F.col("__over").isNull()).withColumn("strictly", F.col("__under").isNotNull()).drop("__over", "__under")


def diverged(pairs: DataFrame, ancestors: DataFrame, a: str, b: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Pairs of which neither is the other's ancestor: not merged into one another."""
    both = earlier(pairs, ancestors, a, b, keys)
    back = ancestors.select(*keys, F.col("child").alias(a), F.col("ancestor").alias(b))
    return both.where("NOT strictly").drop("earlier", "strictly").join(back, [*keys, a, b], "left_anti").where(F.col(a) != F.col(b))


def first_parents(edges: DataFrame) -> DataFrame:
    return edges.where("parent_idx = 0 AND parent_id IS NOT NULL").drop("parent_idx")


def between(ancestors: DataFrame, pairs: DataFrame, low: str, high: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Commits reachable from ``high`` but not from ``low`` (themselves included in what is reachable), for each pair."""
    asked = pairs.select(*keys, low, high)
    reach = lambda end: asked.join(ancestors.select(*keys, F.col("child").alias(end), F.col("ancestor").alias("commit_id")), [*keys, end]).select(*keys, low, high, "commit_id").unionByName(asked.select(*keys, low, high, F.col(end).alias("commit_id")))
    return reach(high).join(reach(low), [*keys, low, high, "commit_id"], "left_anti").distinct()


def nearest_earlier(probes: DataFrame, marks: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """As-of lookup backwards: each probe with the values of the last mark at or before it in ``order``; null without one.

    Both sides are one sequence in a window, so there is no join of inequalities.
    """
    mark = F.struct(*values)
    tagged = probes.select(*keys, order, F.lit(1).alias("__probe"), F.struct(*[c for c in probes.columns if c not in keys]).alias("__row"), F.lit(None).cast(marks.select(mark.alias("m")).schema["m"].dataType).alias("__mark"))
    known = marks.select(*keys, order, F.lit(0).alias("__probe"), F.lit(None).cast(tagged.schema["__row"].dataType).alias("__row"), mark.alias("__mark"))
    w = W.partitionBy(*keys).orderBy(order, "__probe").rowsBetween(W.unboundedPreceding, 0)
    out = tagged.unionByName(known).withColumn("__mark", F.last("__mark", ignorenulls=True).over(w)).where("__probe = 1")
    return out.select(*keys, "__row.*", *(F.col(f"__mark.{v}").alias(f"mark_{v}") for v in values))


def nearest_by_distance(probes: DataFrame, marks: DataFrame, keys: list[str], at: str, mark_at: str, order: list[str]) -> DataFrame:
    """Each probe with the mark at the least distance, the first in ``order`` of equal ones."""
    p = probes.withColumn("__id", F.monotonically_increasing_id())
    joined = p.join(marks, keys, "left")
    w = W.partitionBy("__id").orderBy(F.abs(F.col(at) - F.col(mark_at)).asc_nulls_last(), *order)
    return joined.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank", "__id")


def by_rank(rows: DataFrame, rank: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Rows with their commits' ranks; commits without one come last when ordered by ``place``."""
    return rows.join(rank.select(*keys, "commit_id", "rank"), [*keys, "commit_id"], "left").withColumn("place", F.coalesce("rank", F.lit((1 << 31) - 1))).drop("rank")


def name_history(names: DataFrame, rank: DataFrame, keys: list[str]) -> DataFrame:
    """The names (keys, commit_id, path) that a file had, from the oldest on, as an array; commits without a rank come last."""
    placed = by_rank(names, rank, [k for k in keys if k in rank.columns])
    ordered = F.array_sort(F.collect_list(F.struct("place", "commit_id", "path")))
    return placed.groupBy(*keys).agg(F.transform(ordered, lambda x: x["path"]).alias("paths"))


def blamed(lines: DataFrame, blame: DataFrame, rank: DataFrame, keys: list[str], latest: bool = True) -> DataFrame:
    """The latest (else the oldest) of the commits that lines (keys, path, line_no) come from, by topological rank."""
    found = by_rank(lines.join(blame, [*keys, "path", "line_no"]).select(*keys, "path", F.col("origin_commit").alias("commit_id")), rank, [k for k in keys if k in rank.columns])
    w = W.partitionBy(*keys).orderBy(F.desc("place") if latest else F.asc("place"), "commit_id")
    return found.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "place")


def earliest_per_version(commits: DataFrame, rank: DataFrame, keys: list[str]) -> DataFrame:
    """Of each version the commit of least rank."""
    w = W.partitionBy(*keys, "version").orderBy("place", "commit_id")
    return by_rank(commits, rank, [k for k in keys if k in rank.columns]).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "place")


def version_changes(commits: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Commits (keys, commit_id, version) whose version is not that of their first parent; a version that appears or goes counts."""
    parent = commits.select(*keys, F.col("commit_id").alias("parent_id"), F.col("version").alias("parent_version"))
    with_parent = commits.join(first_parents(edges).select(*keys, "commit_id", "parent_id"), [*keys, "commit_id"]).join(parent, [*keys, "parent_id"], "left")
    return with_parent.where(~F.col("version").eqNullSafe(F.col("parent_version")))


def consecutive(history: DataFrame, keys: list[str], order: str, all_pairs: bool = False) -> DataFrame:
    """Pairs of neighbours in a file's history; the last pair is left out unless ``all_pairs``."""
    w = W.partitionBy(*keys).orderBy(order)
    paired = history.withColumn("next_commit", F.lead("commit_id").over(w)).withColumn("__after", F.lead("commit_id", 2).over(w)).where("next_commit IS NOT NULL")
    return (paired if all_pairs else paired.where("__after IS NOT NULL")).drop("__after")


def walk_back(start: DataFrame, steps: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """Follows lines back through history: start and steps have keys, commit_id, line_no; steps also from_commit, from_line.

    A step leads from (from_commit, from_line) to the earlier (commit_id, line_no). Returns every (keys, commit_id, line_no) reached with
    its depth. Stops when a round reaches nothing new, so cycles end; a walk of more than ``most`` rounds, where given, is an error.
    """
    seen = _cut(start.select(*keys, "commit_id", "line_no", F.lit(0).alias("depth")).distinct())
    edge = seen
    for depth in count(1):
        back = edge.select(*keys, F.col("commit_id").alias("from_commit"), F.col("line_no").alias("from_line")).join(steps, [*keys, "from_commit", "from_line"])
        edge = _cut(back.select(*keys, "commit_id", "line_no").distinct().join(seen, [*keys, "commit_id", "line_no"], "left_anti").withColumn("depth", F.lit(depth)))
        if edge.isEmpty():
            return seen
        if most is not None and depth > most:
            raise ValueError(f"more than {most} rounds of history")
        seen = _cut(seen.unionByName(edge))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """v, c for each vertex: c is the least vertex of its component, by least labels of neighbours and jumps to their labels. Joins are
    merged: a broadcast of labels would pass through the driver in each round."""
    both = _cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).unionByName(edges.select(F.col(b).alias("a"), F.col(a).alias("b"))).distinct())
    labels = _cut(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("c")))
    while True:
        near = both.hint("merge").join(labels, both["b"] == labels["v"]).groupBy(F.col("a").alias("v")).agg(F.min("c").alias("near"))
        lower = labels.hint("merge").join(near, "v").select("v", F.least("c", "near").alias("c"), F.col("c").alias("was"))
        jump = lower.select(F.col("v").alias("c"), F.col("c").alias("far"))
        labels = _cut(lower.hint("merge").join(jump, "c").select("v", F.col("far").alias("c"), "was"))
        if labels.where("c <> was").isEmpty():
            return labels.select("v", "c")
        labels = labels.select("v", "c")


def overlapping_sets(rows: DataFrame, keys: list[str], index: str, lines: str) -> DataFrame:
    """Sets of lines that overlap, directly or through others, as one: its key is their indices in order joined by @."""
    each = rows.select(*keys, index, F.explode(lines).alias("line"))
    name = F.concat_ws("\x00", *(F.col(k).cast("string") for k in keys), F.format_string("%010d", F.col(index).cast("int")))
    vertex = each.withColumn("v", name)
    first = vertex.groupBy(*keys, "line").agg(F.min("v").alias("b"))
    label = components(vertex.join(first, [*keys, "line"]).select(F.col("v").alias("a"), "b"))
    named = rows.withColumn("v", name).join(label, "v", "left").withColumn("c", F.coalesce("c", "v"))
    out = named.groupBy(*keys, "c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.col(index).cast("int"))), lambda i: i.cast("string")), "@").alias("key"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(lines)))).alias(lines))
    return out.drop("c")
