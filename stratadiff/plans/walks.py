"""Chunks of lines followed back through history, commit by commit, by a map that each commit's own diff gives.

A walk is a set of lines with a kind ('add' or 'remove') in one file. In each round it goes to the latest commit that blame names for
its lines, carried over by the diff to that commit, and from there to that commit's first parent: lines that the commit did not touch go by
its diff, touched ones by what was meant (see ``places``), else by a rename, else to where additions begin. Rounds go on
until no walk is left, with what they found written, so a lost executor repeats none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratadiff.functions import text as T
from stratadiff.operators import diffs, graphs, likeness, results

MEANT, RENAMED = 0, 1


def reversed_lines(lines: DataFrame) -> DataFrame:
    """Diff lines of the way back."""
    swap = {"src_start": "tgt_start", "src_len": "tgt_len", "src_no": "tgt_no"}
    swap |= {b: a for a, b in swap.items()}
    kind = F.translate("line_type", "+-", "-+").alias("line_type")
    return lines.select(*(kind if c == "line_type" else F.col(swap[c]).alias(c) if c in swap else c for c in lines.columns))


def added_places(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The added lines of each diff (keys): line_no, value, place (the old line in front of which the line stands) and next_kept (the old number
    of the next line that stays, null without one)."""
    order = W.partitionBy(*keys).orderBy("hunk_idx", "pos")
    whole = order.rowsBetween(W.unboundedPreceding, 0)
    # In each hunk old lines count on from its header, of which a hunk without any names the line before it.
    first = F.when(F.col("src_len") == 0, F.col("src_start") + 1).otherwise(F.col("src_start"))
    inside = W.partitionBy(*keys, "hunk_idx").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    place = (first + F.count_if(F.col("line_type") != "+").over(inside)).cast("int")
    after = F.first(F.when(F.col("line_type") == " ", F.col("src_no")), ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing))
    rows = changes.select("*", place.alias("place"), after.alias("next_kept"), F.row_number().over(whole).alias("__n"))
    return rows.where("line_type = '+'").select(*keys, F.col("tgt_no").alias("line_no"), "value", "place", "next_kept")


def places(changes: DataFrame, meant: DataFrame, before: DataFrame, functions: DataFrame, elsewhere: DataFrame, keys: list[str], alike: float = 0.95, renamed: float = 0.9) -> DataFrame:
    """Where added lines stood before their commit, by what is meant and by renames: keys, path, commit_id, line_no, by (MEANT or RENAMED),
    to_path, new_no.

    changes: diff lines of keys, path and commit_id, from the first parent on. meant: keys, path, commit_id, line_no, value: what was said of
    an added line to mean the same before. It is looked for (more alike than ``alike``, texts normalized) in ``before`` (keys, path, commit_id,
    line_no, value: the file in the parent), and there, if lines were removed from it, in the function of the same name. functions: keys, path,
    commit_id, old (in the parent or not), name, start_line, end_line. elsewhere: keys, commit_id, path, line_no, value: lines that the commit
    removes from other files; the last path with a text as alike as ``renamed`` counts.
    """
    at = [*keys, "path", "commit_id"]
    plain = lambda rows: rows.withColumn("value", T.normalized(F.col("value")))
    found = likeness.ratio_join(plain(meant.select(*at, "line_no", "value")), plain(before.select(*at, "line_no", "value")), at, "value", alike)
    pairs = found.select(*(F.col(f"l_{c}").alias(c) for c in at), F.col("l_line_no").alias("line_no"), F.col("r_line_no").alias("new_no")).distinct()
    named = results.innermost(pairs.select(*at, "line_no").distinct(), functions.where("NOT old"), at, "line_no")
    removed = changes.where("line_type = '-'").select(*at, F.col("src_no").alias("gone_no")).distinct()
    old = functions.where("old").groupBy(*at, "name").agg(F.min_by(F.struct("start_line", "end_line"), "start_line").alias("r")).select(*at, "name", "r.*")
    inside = old.join(removed, at).where("gone_no BETWEEN start_line AND end_line").select(*at, "name", "start_line", "end_line").distinct()
    ranged = pairs.join(named, [*at, "line_no"]).join(inside, [*at, "name"], "left")
    by_meaning = ranged.where("start_line IS NULL OR new_no BETWEEN start_line AND end_line").select(*at, "line_no", F.lit(MEANT).alias("by"), F.col("path").alias("to_path"), "new_no")

    added = changes.where("line_type = '+'").select(*at, F.col("tgt_no").alias("line_no"), F.trim("value").alias("value"))
    on = [*keys, "commit_id"]
    gone = elsewhere.select(*on, F.col("path").alias("to_path"), F.col("line_no").alias("new_no"), F.trim("value").alias("value"))
    likes = likeness.ratio_join(added.select(*at, "line_no", "value"), gone, on, "value", renamed, strict=False)
    likes = likes.select(*(F.col(f"l_{c}").alias(c) for c in at), F.col("l_line_no").alias("line_no"), F.lit(RENAMED).alias("by"), F.col("r_to_path").alias("to_path"), F.col("r_new_no").alias("new_no"))
    return by_meaning.unionByName(likes.where("to_path <> path").distinct())


def walked_chunks(starts: DataFrame, blame: DataFrame, rank: DataFrame, between: DataFrame, changes: DataFrame, known: DataFrame, before: DataFrame, edges: DataFrame, keys: list[str], older: DataFrame | None = None) -> DataFrame:
    """Each commit that changed what a walk's lines hold, with its lines there: keys, walk, path, commit_id, line_no, kind, depth.

    starts: keys, walk, path, commit_id, line_no, kind. blame: keys, path, commit_id, line_no, origin_commit. rank: keys, commit_id, rank.
    between: diff lines of keys, path, commit_id and origin_commit, from the one to the other. changes: diff lines of keys, path, commit_id,
    from its first parent; known: what ``places`` makes of them. A path names a file at all commits (as its newest name does).

    Of the lines that a commit touched the walk takes all places by meaning, without any all of the last renamed file, and without these
    one place: for kind 'add' the line in front of which its last line was put (-1: at the end of the file or before a blank last line), else
    the next line that stays, and its kind is 'add' from there on. Other lines go by the diff, but not into another file after a rename.

    A walk ends where blame names no commit or the same, where the commits between removed all of its lines, behind the first commit of
    ``older`` (keys, commit_id: older than the one asked for), which is still told, at commits whose parent has no such file (no row in
    ``before``, see ``places``), where no place is left, and with a line -1, which is told of the parent with the walk's other lines.
    Repeated rows of the tables count once; lines that are null are followed nowhere.
    """
    at = [*keys, "path", "commit_id"]
    walk = [*keys, "walk"]
    edge = graphs._cut(starts.select(*walk, "path", "commit_id", "line_no", "kind").where("line_no IS NOT NULL").distinct())
    ends = graphs._cut(before.groupBy(*at).agg(F.max(F.struct("line_no", "value")).alias("x")).select(*at, F.col("x.line_no").alias("last_no"), (T.stripped(F.col("x.value")) == "").alias("blank")))
    at_end = (F.col("place") > F.col("last_no")) | ((F.col("place") == F.col("last_no")) & F.col("blank"))
    touched = added_places(changes, at).join(ends, at).withColumn("place", F.when(at_end, F.lit(-1)).otherwise(F.col("place")))
    touched = graphs._cut(touched.select(*at, "line_no", "place", "next_kept").distinct())
    known = graphs._cut(known.select(*at, "line_no", "by", "to_path", "new_no").distinct())
    back = reversed_lines(changes)
    parents = graphs.first_parents(edges).select(*keys, "commit_id", "parent_id").distinct()
    ranked = rank.select(*keys, F.col("commit_id").alias("origin_commit"), "rank").distinct()
    found, depth = None, 0

    def carried(rows: DataFrame, lines: DataFrame, on: list[str]) -> DataFrame:
        numbers = rows.select(*on, "line_no").distinct().withColumn("ord", F.lit(0))
        near = lines.join(numbers.select(*on).distinct(), on, "left_semi")
        return rows.join(diffs.transport(numbers, near, on).select(*on, "line_no", "new_no"), [*on, "line_no"])

    while not edge.isEmpty():
        done = edge.join(edge.where("line_no = -1").select(*walk).distinct(), walk, "left_semi").withColumn("depth", F.lit(depth))
        named = edge.join(blame.select(*at, "line_no", "origin_commit").distinct(), [*at, "line_no"]).join(ranked, [*keys, "origin_commit"])
        latest = named.groupBy(*walk, "commit_id").agg(F.max(F.struct("rank", "origin_commit")).alias("x")).select(*walk, "commit_id", "x.origin_commit")
        going = edge.join(done.select(*walk).distinct(), walk, "left_anti").join(latest.where("origin_commit <> commit_id"), [*walk, "commit_id"])
        here = carried(going, between, [*at, "origin_commit"]).select(*walk, "path", F.col("origin_commit").alias("commit_id"), F.col("new_no").alias("line_no"), "kind", F.lit(depth).alias("depth"))
        here = graphs._cut(here.distinct() if found is None else here.distinct().join(found.select(*walk, "path", "commit_id").distinct(), [*walk, "path", "commit_id"], "left_anti"))
        told = here.unionByName(done.select(*here.columns))
        found = graphs._cut(told if found is None else found.unionByName(told))
        more = here.drop("depth").join(parents, [*keys, "commit_id"]).join(ends.select(*at), at, "left_semi")
        more = more if older is None else more.join(older.select(*keys, "commit_id").distinct(), [*keys, "commit_id"], "left_anti")
        more = graphs._cut(more.join(touched, [*at, "line_no"], "left").withColumn("hit", F.col("place").isNotNull()))

        options = more.where("hit").join(known, [*at, "line_no"])
        best = options.groupBy(*walk).agg(F.min("by").alias("by"), F.max(F.when(F.col("by") == RENAMED, F.col("to_path"))).alias("last_path"))
        chosen = options.join(best, [*walk, "by"]).where((F.col("by") == MEANT) | (F.col("to_path") == F.col("last_path")))
        chosen = chosen.select(*walk, F.col("to_path").alias("path"), F.col("parent_id").alias("commit_id"), F.col("new_no").alias("line_no"), "kind")
        last = more.where("hit").join(best, walk, "left_anti").groupBy(*walk, "path", "commit_id", "parent_id", "kind").agg(F.max_by(F.struct("place", "next_kept"), "line_no").alias("x"))
        anchor = F.when(F.col("kind") == "add", F.col("x.place")).otherwise(F.col("x.next_kept"))
        placed = last.withColumn("anchor", anchor).where("anchor IS NOT NULL")
        lost = last.where(anchor.isNull()).select(*walk)
        anchored = placed.select(*walk, "path", F.col("parent_id").alias("commit_id"), F.col("anchor").alias("line_no"), F.lit("add").alias("kind"))
        moved_away = best.where(F.col("by") == RENAMED).select(*walk)
        turned = more.where("hit").select(*walk).distinct().join(best, walk, "left_anti").withColumn("turned", F.lit(True))
        rest = more.where("NOT hit").join(lost.unionByName(moved_away), walk, "left_anti").join(turned, walk, "left")
        rest = carried(rest, back, at).select(*walk, "path", F.col("parent_id").alias("commit_id"), F.col("new_no").alias("line_no"), F.when(F.col("turned"), "add").otherwise(F.col("kind")).alias("kind"))
        edge = graphs._cut(chosen.unionByName(anchored).unionByName(rest).distinct())
        depth += 1
    return found if found is not None else edge.withColumn("depth", F.lit(0))
