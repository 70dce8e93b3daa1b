"""Whole studies put together from operators: localisation, porting results, origin of removed lines, change metrics, back-port search.

Commands, test runs and model answers are input tables; nothing outside Spark is called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratadiff.functions import sets
from stratadiff.functions import text as T
from stratadiff.operators import code, diffs, graphs, results, similarity


def localized(targets: DataFrame, chain: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of a commit carried over to the target version: the nearest earlier commit of the chain tells where they were last known,
    and the diff from it to the target moves them.

    targets: keys, rank (of the target commit). chain: keys, rank, commit_id, lines. lines: diff lines of keys and from_commit.
    Returns keys, lines (sorted, distinct).
    """
    known = graphs.nearest_earlier(targets, chain, keys, "rank", ["commit_id", "lines"])
    numbers = known.select(*keys, F.col("mark_commit_id").alias("from_commit"), F.posexplode("mark_lines").alias("ord", "line_no"))
    moved = diffs.transport(numbers.withColumn("ord", F.col("ord").cast("long")), lines, [*keys, "from_commit"])
    return moved.groupBy(*keys).agg(F.array_sort(F.collect_set("new_no")).alias("lines"))


def mapped_lines(exact: DataFrame, semantic: DataFrame, renamed: DataFrame, anchored: DataFrame, keys: list[str]) -> DataFrame:
    """One place for each line (keys, line_no, new_no in each table): carried over, else by meaning, else renamed, else the anchor of what was added.

    What is by meaning is best restricted with ``of_same_function`` before.
    """
    tagged = [t.select(*keys, "line_no", "new_no", F.lit(i).alias("by")) for i, t in enumerate((exact, semantic, renamed, anchored))]
    every = tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).unionByName(tagged[3]).where("new_no IS NOT NULL")
    return results.first_of(every, [*keys, "line_no"], [F.asc("by"), F.asc("new_no")]).drop("by")


def of_same_function(pairs: DataFrame, old_functions: DataFrame, new_functions: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of lines (keys, line_no, new_no) that lie in functions of one name on both sides, or outside of all on both."""
    old = results.innermost(pairs.select(*keys, "line_no").distinct(), old_functions, keys, "line_no", open_start=True, default="")
    new = results.innermost(pairs.select(*keys, "new_no").distinct(), new_functions, keys, "new_no", open_start=True, default="").withColumnRenamed("name", "new_name")
    return pairs.join(old, [*keys, "line_no"]).join(new, [*keys, "new_no"]).where("name = new_name").drop("name", "new_name")


def walked_history(start: DataFrame, blame: DataFrame, lines: DataFrame, mapped: DataFrame, edges: DataFrame, keys: list[str], newest_known: DataFrame | None = None) -> DataFrame:
    """Lines followed back through history: keys, commit_id, line_no of each commit that changed what the lines hold, and depth.

    start: keys, commit_id, line_no. blame: keys, commit_id, line_no, origin_commit. lines: diff lines of keys, commit_id and
    origin_commit, which carry a line over to the commit it comes from. mapped: keys, commit_id, line_no, new_no: where a changed
    line stood in the first parent (see ``mapped_lines``). A line's walk ends where blame has no commit or the line's own one, where
    the line is new, and behind commits of ``newest_known`` (keys, commit_id), which are older than what is asked for: the first of them is
    still told, as it is what a lookup of the nearest earlier commit needs. Each commit and line is followed once, so walks end.
    """
    parents = graphs.first_parents(edges).select(*keys, F.col("commit_id"), "parent_id")
    pairs = [*keys, "commit_id", "origin_commit"]
    edge = graphs._cut(start.select(*keys, "commit_id", "line_no").distinct())
    followed, found, depth = edge, None, 0
    while not edge.isEmpty():
        named = edge.join(blame, [*keys, "commit_id", "line_no"]).where("origin_commit <> commit_id")
        moved = diffs.transport(named.withColumn("ord", F.lit(0)), lines, pairs)
        at = moved.select(*keys, F.col("origin_commit").alias("commit_id"), F.col("new_no").alias("line_no"), F.lit(depth).alias("depth")).distinct()
        found = graphs._cut(at if found is None else found.unionByName(at.join(found, [*keys, "commit_id", "line_no"], "left_anti")))
        further = at if newest_known is None else at.join(newest_known.select(*keys, "commit_id"), [*keys, "commit_id"], "left_anti")
        before = further.join(mapped, [*keys, "commit_id", "line_no"]).where("new_no > 0").join(parents, [*keys, "commit_id"])
        edge = graphs._cut(before.select(*keys, F.col("parent_id").alias("commit_id"), F.col("new_no").alias("line_no")).distinct().join(followed, [*keys, "commit_id", "line_no"], "left_anti"))
        followed = graphs._cut(followed.unionByName(edge))
        depth += 1
    return found if found is not None else edge.withColumn("depth", F.lit(0))


def localized_by_likeness(source: DataFrame, target: DataFrame, keys: list[str], least: float = 0.0) -> DataFrame:
    """Where the lines of a change stand in another version, by likeness alone: keys and lines (sorted, distinct) of the target's lines most
    like them, searched in order. source: keys, ord, value. target: keys, line_no, value. Lines of fewer than three characters don't count."""
    found = similarity.moving_matches(source, target, keys, least, shortest=3)
    return found.where("line_no > 0").groupBy(*keys).agg(F.array_sort(F.collect_set("line_no")).alias("lines"))


def contiguous(found: DataFrame, lines: str = "lines") -> DataFrame:
    """Lines filled up to one range."""
    return found.withColumn(lines, sets.filled_range(F.col(lines)))


def origins(lines: DataFrame, blame: DataFrame, rank: DataFrame, keys: list[str]) -> DataFrame:
    """The oldest commit that any removed line of a patch comes from."""
    removed = lines.where("line_type = '-'").select(*keys, "path", F.col("src_no").alias("line_no"))
    return graphs.blamed(removed, blame, rank, keys, latest=False)


def still_open(versions: DataFrame, patch: DataFrame, ancestors: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Versions (keys, commit_id, version) that the patch (keys, patch_commit) isn't earlier than and whose test run still passes the attack."""
    pairs = versions.join(patch, keys)
    judged = graphs.earlier(pairs, ancestors, "patch_commit", "commit_id", [k for k in keys if k in ancestors.columns])
    passed = runs.where(T.run_status(F.col("stderr")) == "False#0").select(*keys, "commit_id")
    return judged.where("NOT earlier").join(passed, [*keys, "commit_id"], "left_semi").select(*keys, "commit_id", "version")


def unapplied(files: DataFrame, applied: DataFrame, keys: list[str]) -> DataFrame:
    """Files to which the patch applies neither cleanly nor with tolerance. applied: keys, path, mode, ok."""
    fine = applied.where("ok").select(*keys, "path").distinct()
    return files.join(fine, [*keys, "path"], "left_anti")


def port_results(answers: DataFrame, runs: DataFrame, keys: list[str], most: int = 500) -> DataFrame:
    """A status for each answer (keys, text): that of its run, or of its size where it has none."""
    joined = answers.join(runs, keys, "left")
    gate = T.gate_status(F.col("text").isNotNull(), F.size(T.lines_of(F.col("text"))), most)
    return joined.select(*keys, F.coalesce(gate, T.run_status(F.col("stderr")), F.lit("Check")).alias("status"))


def effectiveness(statuses: DataFrame, types: DataFrame, by: str = "type") -> DataFrame:
    """Shares of fixed, broken and open cases by porting type, or by another column of ``types`` (the weakness). Every package must be there."""
    typed = results.looked_up(statuses, types, "pkg")
    counts = typed.groupBy(by).agg(F.count("*").alias("total"), F.sum(T.status_bit(F.col("status"))).alias("fixed"), F.count_if(F.col("status") == "False#1").alias("broken"), F.count_if(F.col("status") == "False#0").alias("open"))
    share = lambda c: F.round(F.try_divide(F.col(c).cast("double"), F.col("total")), 6).alias(f"{c}_share")
    return counts.select("*", share("fixed"), share("broken"), share("open"))


def function_targets(lines: DataFrame, functions: DataFrame, keys: list[str]) -> DataFrame:
    """Changed old lines by file and innermost function around them; what is outside all is 'global'."""
    changed = lines.where("line_type = '-'").select(*keys, "path", F.col("src_no").alias("line_no")).distinct()
    named = results.innermost(changed, functions, [*keys, "path"], "line_no", default="global")
    return named.groupBy(*keys, "path", "name").agg(F.array_sort(F.collect_list("line_no")).alias("lines"))


def changed_functions(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Functions that both versions have, with different bodies."""
    both = results.in_both(old, new, [*keys, "name"])
    body = lambda rows, c: rows.groupBy(*keys, "name").agg(F.min_by("body", "start_line").alias(c))
    return both.join(body(old, "old_body"), [*keys, "name"]).join(body(new, "new_body"), [*keys, "name"]).where("old_body <> new_body")


def function_metrics(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """What changed in the signatures of matched functions, and how alike their bodies are, in six measures."""
    matched = code.matched_functions(old, new, keys)
    names = lambda rows, p: rows.select(*keys, *(F.col(c).alias(f"{p}_{c}") for c in ("name", "params", "ret")))
    full = matched.join(names(old, "old").dropDuplicates([*keys, "old_name"]), [*keys, "old_name"]).join(names(new, "new").dropDuplicates([*keys, "new_name"]), [*keys, "new_name"], "left")
    return code.signature_changes(full).withColumn("likeness", similarity.likeness(F.col("old_body"), F.col("new_body")))


def version_metrics(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Two versions of a project (keys, committed_at, package: JSON, files: array): days apart, likeness of dependencies and of
    file lists, and whether the licence changed."""
    side = lambda rows, p: rows.select(*keys, *(F.col(c).alias(f"{p}_{c}") for c in ("committed_at", "package", "files")))
    both = side(a, "a").join(side(b, "b"), keys)
    licence = lambda p: T.package_field(F.col(f"{p}_package"), "license", "Unknown")
    return both.select(
        *keys, T.day_gap(F.col("a_committed_at"), F.col("b_committed_at")).alias("days"), sets.jaccard(T.package_dependencies(F.col("a_package")), T.package_dependencies(F.col("b_package"))).alias("dependency_similarity"),
        (~licence("a").eqNullSafe(licence("b"))).alias("license_change"), sets.jaccard(F.col("a_files"), F.col("b_files")).alias("file_list_similarity"),
    )


def commit_distance(ancestors: DataFrame, pairs: DataFrame, touched: DataFrame, keys: list[str]) -> DataFrame:
    """Commits between two versions, and how many of them on average touch one of the files (keys, path, commit_id; files may
    repeat and then weigh more)."""
    steps = graphs.between(ancestors, pairs, "low", "high", keys)
    all_ = steps.groupBy(*keys).agg(F.count("*").alias("commits"))
    each = touched.groupBy(*keys, "path").agg(F.collect_set("commit_id").alias("ids"), F.count_distinct("commit_id").alias("n"))
    own = steps.join(touched.select(*keys, "path", "commit_id").distinct(), [*keys, "commit_id"]).groupBy(*keys, "path").agg(F.count("*").alias("n"))
    mean = each.select(*keys, "path").join(own, [*keys, "path"], "left").na.fill(0, ["n"]).groupBy(*keys).agg(F.avg("n").alias("file_commits"))
    return all_.join(mean, keys, "left").na.fill(0.0, ["file_commits"])


def back_ports(patches: DataFrame, commits: DataFrame, keys: list[str], patch_id: Column) -> DataFrame:
    """Commits that carry a patch over, by their hunks and messages: keys, commit_id.

    patches: keys, hunk, removed, added, message, patch_id, case_id. commits: keys, commit_id, hunk, removed, added, message.
    """
    a = patches.select(*keys, F.col("hunk").alias("a_hunk"), F.col("removed").alias("a_removed"), F.col("added").alias("a_added"), F.col("message").alias("a_message"), "patch_id", "case_id")
    b = commits.select(*keys, "commit_id", F.col("hunk").alias("b_hunk"), F.col("removed").alias("b_removed"), F.col("added").alias("b_added"), F.col("message").alias("b_message"))
    pairs = a.join(b, keys).where(~F.contains(patch_id, F.col("commit_id")))
    rated = pairs.select(*keys, "commit_id", "a_hunk", "b_hunk", similarity.hunk_similarity(F.col("a_removed"), F.col("a_added"), F.col("b_removed"), F.col("b_added")).alias("similarity"), similarity.message_matches(F.col("b_message"), F.col("patch_id"), F.col("case_id"), F.col("a_message")).alias("message"))
    return similarity.hunk_sets_match(rated, [*keys, "commit_id"]).where("match").select(*keys, "commit_id").distinct()
