"""Queries over histories (commits made of customers and orders), blame, versions, and functions of source texts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratadiff.operators import code, edits, graphs, similarity, syntax
from stratadiff.plans import studies, walks
from stratadiff.plans.registry import DIFFS, FULL, LINES, document_diffs, document_lines, query
from stratadiff.sources.readers import table

# A history of customers: the first parent is half of the id, and each third id has the next lower id as a second parent.
_EDGES = "e AS (SELECT c_custkey AS id, c_custkey // 2 AS parent, 0 AS idx FROM customer WHERE c_custkey > 1 UNION ALL SELECT c_custkey, c_custkey - 1, 1 FROM customer WHERE c_custkey > 3 AND c_custkey % 3 = 0)"
#: Ancestors of a few asked commits and of all that are a multiple of ten up to 200, by walking up.
_ASKED = "asked AS (SELECT c_custkey AS a, c_custkey + 7 AS b FROM customer WHERE c_custkey % 10 = 0 AND c_custkey <= 100 AND c_custkey + 7 <= (SELECT max(c_custkey) FROM customer))"
_UP = "up AS (SELECT v AS id, v AS anc FROM (SELECT a AS v FROM asked UNION SELECT b FROM asked) UNION SELECT up.id, e.parent FROM up JOIN e ON e.id = up.anc)"


def _edges(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("commit_id"))
    first = c.where("commit_id > 1").select("commit_id", F.floor(F.col("commit_id") / 2).alias("parent_id"), F.lit(0).alias("parent_idx"))
    return first.unionByName(c.where("commit_id > 3 AND commit_id % 3 = 0").select("commit_id", (F.col("commit_id") - 1).alias("parent_id"), F.lit(1).alias("parent_idx")))


def _asked(spark, d):
    c = table(spark, d, "customer")
    most = c.agg(F.max("c_custkey")).scalar()
    return c.where("c_custkey % 10 = 0 AND c_custkey <= 100").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 7).alias("b")).where(F.col("b") <= most)


@query("""WITH RECURSIVE c AS (SELECT c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS depth FROM customer), d_ AS (SELECT depth, count(*) AS n FROM c GROUP BY 1),
s AS (SELECT depth, sum(n) OVER (ORDER BY depth) - n AS before FROM d_) SELECT id AS commit_id, depth::BIGINT AS depth, (before + row_number() OVER (PARTITION BY depth ORDER BY id))::BIGINT AS rank FROM c JOIN s USING (depth)""")
def topological_rank(spark, d):
    """Linear histories, one for each nation."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("commit_id"), F.lag("c_custkey").over(W.partitionBy("c_nationkey").orderBy("c_custkey")).alias("parent_id"))
    return graphs.ranks(c, "commit_id", "parent_id")


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS id, c_custkey // 2 AS parent FROM customer WHERE c_custkey > 1 UNION ALL SELECT c_custkey, c_custkey // 4 FROM customer WHERE c_custkey >= 4 AND c_custkey % 3 = 0),
w AS (SELECT 1::BIGINT AS id, 0::BIGINT AS depth UNION SELECT e.id, w.depth + 1 FROM w JOIN e ON e.parent = w.id) SELECT id AS commit_id, max(depth) AS depth FROM w GROUP BY 1""")
def longest_way(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("commit_id"))
    half = c.where("commit_id > 1").select("commit_id", F.floor(F.col("commit_id") / 2).alias("parent_id"))
    return graphs.depths(half.unionByName(c.where("commit_id >= 4 AND commit_id % 3 = 0").select("commit_id", F.floor(F.col("commit_id") / 4).alias("parent_id"))), "commit_id", "parent_id")


@query(f"WITH RECURSIVE {_EDGES}, {_ASKED}, {_UP} SELECT a, b, EXISTS (SELECT 1 FROM up WHERE up.id = asked.b AND up.anc = asked.a) AS over, EXISTS (SELECT 1 FROM up WHERE up.id = asked.a AND up.anc = asked.b) AS under FROM asked")
def ancestry(spark, d):
    return graphs.ancestry(_asked(spark, d), _edges(spark, d), "a", "b")


@query(f"WITH RECURSIVE {_EDGES}, {_ASKED}, {_UP} SELECT a, b, u.anc AS commit_id FROM asked JOIN up u ON u.id = b WHERE NOT EXISTS (SELECT 1 FROM up w WHERE w.id = asked.a AND w.anc = u.anc)")
def commits_between(spark, d):
    return graphs.commits_between(_asked(spark, d), _edges(spark, d), "a", "b")


@query(f"""WITH RECURSIVE {_EDGES}, {_ASKED}, {_UP} SELECT a, b, contains(a::VARCHAR, b::VARCHAR) OR contains(b::VARCHAR, a::VARCHAR) OR NOT EXISTS (SELECT 1 FROM up WHERE id = a AND anc = b AND anc <> id) AS earlier, EXISTS (SELECT 1 FROM up WHERE id = b AND anc = a AND anc <> id) AS strictly FROM asked""")
def earlier_commits(spark, d):
    """The closure of the first hundred and seven commits."""
    small = _edges(spark, d).where("commit_id <= 107")
    up = graphs.closure(small.select(F.col("commit_id").cast("string").alias("commit_id"), F.col("parent_id").cast("string").alias("parent_id")), "commit_id", "parent_id")
    pairs = _asked(spark, d).select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))
    return graphs.earlier(pairs, up, "a", "b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "earlier", "strictly")


@query(f"WITH RECURSIVE {_EDGES}, {_ASKED}, {_UP} SELECT a, b FROM asked WHERE a <> b AND NOT EXISTS (SELECT 1 FROM up WHERE id = b AND anc = a) AND NOT EXISTS (SELECT 1 FROM up WHERE id = a AND anc = b)")
def diverged_commits(spark, d):
    small = _edges(spark, d).where("commit_id <= 107")
    return graphs.diverged(_asked(spark, d), graphs.closure(small, "commit_id", "parent_id"), "a", "b").select("a", "b")


@query("SELECT c_custkey AS commit_id, c_custkey // 2 AS parent_id FROM customer WHERE c_custkey > 1")
def first_parents(spark, d):
    return graphs.first_parents(_edges(spark, d))


@query("SELECT o_custkey AS commit_id, string_agg(DISTINCT 'p' || (l_partkey % 50), ',' ORDER BY 'p' || (l_partkey % 50)) AS paths FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 UNION ALL SELECT c_custkey, '' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey)")
def files_of_commit(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("commit_id"))
    versions = o.join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("commit_id", F.concat(F.lit("p"), (F.col("l_partkey") % 50).cast("string")).alias("path"))
    return graphs.files_of(versions, table(spark, d, "customer").select(F.col("c_custkey").alias("commit_id")), []).select("commit_id", F.array_join("paths", ",").alias("paths"))


@query("SELECT doc_id AS commit_id, 'src/' || lang AS path, md5(CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END) AS text FROM documents")
def file_at_commit(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("commit_id"), F.concat(F.lit("src/"), "lang").alias("path"), "text")
    return graphs.file_at(docs.where("commit_id % 2 = 0"), docs.select("commit_id", "path"), []).select("commit_id", "path", F.md5("text").alias("text"))


# --- blame and versions -----------------------------------------------------------------------------------------------------
_BLAME = f"{DIFFS}, g AS (SELECT doc_id, max((src_no * 7) % 100 + 1) AS latest, min((src_no * 7) % 100 + 1) AS oldest FROM dl WHERE line_type = '-' GROUP BY 1)"


def _chain(spark):
    return spark.range(1, 101).select(F.format_string("c%03d", "id").alias("commit_id"), F.when(F.col("id") > 1, F.format_string("c%03d", F.col("id") - 1)).alias("parent_id"))


@query(f"WITH {_BLAME} SELECT doc_id, 'c' || lpad(latest::VARCHAR, 3, '0') AS latest, 'c' || lpad(oldest::VARCHAR, 3, '0') AS oldest FROM g")
def origins_of_removed_lines(spark, d):
    dl = document_diffs(spark, d)
    blame = document_lines(spark, d).select("doc_id", "path", "line_no", F.format_string("c%03d", (F.col("line_no") * 7) % 100 + 1).alias("origin_commit"))
    rank = graphs._cut(graphs.ranks(_chain(spark), "commit_id", "parent_id"))
    removed = dl.where("line_type = '-'").select("doc_id", "path", F.col("src_no").alias("line_no"))
    latest = graphs.blamed(removed, blame, rank, ["doc_id"]).select("doc_id", F.col("commit_id").alias("latest"))
    return studies.origins(dl, blame, rank, ["doc_id"]).select("doc_id", F.col("commit_id").alias("oldest")).join(latest, "doc_id")


@query("SELECT user_id, event_type AS version, min(event_id % 100 + 1) AS first FROM events GROUP BY 1, 2")
def earliest_of_version(spark, d):
    commits = table(spark, d, "events").select("user_id", F.col("event_type").alias("version"), F.format_string("c%03d", F.col("event_id") % 100 + 1).alias("commit_id"))
    found = graphs.earliest_per_version(commits, graphs.ranks(_chain(spark), "commit_id", "parent_id"), ["user_id"])
    return found.select("user_id", "version", F.substring("commit_id", 2, 3).cast("long").alias("first"))


@query("SELECT event_id, CASE WHEN event_id % 150 + 1 <= 100 THEN event_id % 150 + 1 ELSE 2147483647 END AS place FROM events")
def topological_place(spark, d):
    rows = table(spark, d, "events").select("event_id", F.format_string("c%03d", F.col("event_id") % 150 + 1).alias("commit_id"))
    return graphs.by_rank(rows, graphs.ranks(_chain(spark), "commit_id", "parent_id")).select("event_id", F.col("place").cast("long").alias("place"))


@query("SELECT conv_id, turn, 2 * (turn + 3) % 5 AS status, conv_id % 60 + 1 AS version FROM conversations WHERE conv_id % 60 + 1 < 40 AND turn % 2 = 0")
def still_open_versions(spark, d):
    v = table(spark, d, "conversations").select("conv_id", "turn", F.format_string("c%03d", F.col("conv_id") % 60 + 1).alias("commit_id"), (F.col("conv_id") % 60 + 1).alias("version"))
    up = graphs.closure(_chain(spark), "commit_id", "parent_id")
    patch = v.select("conv_id", "turn").distinct().withColumn("patch_commit", F.lit("c040"))
    runs = v.select("conv_id", "turn", "commit_id", F.when(F.col("turn") % 2 == 0, "PASS").otherwise("Expected Received").alias("stderr"))
    found = studies.still_open(v, patch, up, runs, ["conv_id", "turn"])
    return found.select("conv_id", "turn", (2 * (F.col("turn") + 3) % 5).alias("status"), "version")


@query(f"WITH {DIFFS} SELECT doc_id, string_agg(DISTINCT (n + b)::VARCHAR, ',' ORDER BY (n + b)::VARCHAR) AS lines FROM x WHERE k NOT IN (3, 5) AND n % 4 = 2 GROUP BY 1")
def localized_lines(spark, d):
    """Lines known at rank 2 of a chain, asked for at rank 5."""
    of = document_lines(spark, d).where("line_no % 4 = 2").groupBy("doc_id").agg(F.collect_list("line_no").alias("lines"))
    chain = of.select("doc_id", F.lit(2).alias("rank"), F.lit("k").alias("commit_id"), "lines").unionByName(of.select("doc_id", F.lit(9).alias("rank"), F.lit("z").alias("commit_id"), F.array(F.lit(1)).alias("lines")))
    found = studies.localized(of.select("doc_id", F.lit(5).alias("rank")), chain, document_diffs(spark, d).withColumn("from_commit", F.lit("k")), ["doc_id"])
    return found.select("doc_id", F.array_join(F.array_sort(F.transform("lines", lambda x: x.cast("string"))), ",").alias("lines"))


@query(f"WITH {LINES}, m AS (SELECT doc_id, n, CASE WHEN n % 2 = 0 THEN n + 1 WHEN n % 3 = 0 THEN n + 2 WHEN n % 5 = 0 THEN n + 3 WHEN n % 7 = 0 THEN -1 END AS new_no FROM l) SELECT doc_id, n AS line_no, new_no::INT AS new_no FROM m WHERE new_no IS NOT NULL")
def mapped_lines(spark, d):
    n = F.col("line_no")
    of = document_lines(spark, d).select("doc_id", "line_no")
    by = lambda rule, new: of.select("doc_id", "line_no", F.when(rule, new).cast("int").alias("new_no"))
    return studies.mapped_lines(by(n % 2 == 0, n + 1), by(n % 3 == 0, n + 2), by(n % 5 == 0, n + 3), by(n % 7 == 0, F.lit(-1)), ["doc_id"])


@query(f"WITH {LINES} SELECT doc_id, n AS line_no, n + 2 AS new_no FROM l WHERE (n > 1 AND n <= 10) = (n + 2 > 3 AND n + 2 <= 8)")
def lines_of_same_function(spark, d):
    of = document_lines(spark, d)
    pairs = of.select("doc_id", "line_no", (F.col("line_no") + 2).alias("new_no"))
    range_ = lambda a, b: of.select("doc_id").distinct().select("doc_id", F.lit(a).alias("start_line"), F.lit(b).alias("end_line"), F.lit("f").alias("name"))
    return studies.of_same_function(pairs, range_(1, 10), range_(3, 8), ["doc_id"]).select("doc_id", "line_no", "new_no")


@query(f"""WITH {LINES} SELECT doc_id, 'b' AS commit_id, n AS line_no, 0 AS depth FROM l WHERE n % 3 = 0 UNION ALL SELECT doc_id, 'a', n - 1, 1 FROM l WHERE n % 3 = 0 AND (n - 1) % 2 = 0""")
def walked_history(spark, d):
    """Lines of commit c come from b, where they stood at the same place; each stood one higher in its parent p, whose even lines come from a."""
    of = document_lines(spark, d).select("doc_id", "line_no")
    at = lambda c, rows=of: rows.withColumn("commit_id", F.lit(c))
    blame = at("c").withColumn("origin_commit", F.lit("b")).unionByName(at("p").withColumn("origin_commit", F.when(F.col("line_no") % 2 == 0, "a").otherwise("p")))
    none = document_diffs(spark, d).limit(0).select("*", F.lit("").alias("commit_id"), F.lit("").alias("origin_commit"))
    mapped = at("b").withColumn("new_no", F.col("line_no") - 1)
    edges = of.select("doc_id").distinct().select("doc_id", F.lit("b").alias("commit_id"), F.lit("p").alias("parent_id"), F.lit(0).alias("parent_idx"))
    return studies.walked_history(at("c", of.where("line_no % 3 = 0")), blame, none, mapped, edges, ["doc_id"]).select("doc_id", "commit_id", "line_no", "depth")


_KIND = "CASE WHEN g % 4 < 2 THEN 'add' ELSE 'remove' END"


@query(f"""WITH {DIFFS},
y AS (SELECT *, n // 9 AS g, min(CASE WHEN k >= 0 AND k NOT IN (3, 5) THEN n END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS kept,
    max(n) OVER (PARTITION BY doc_id) AS last_no, last_value({FULL.format("v")}) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_full FROM x),
context AS (SELECT *, n + b AS t FROM y WHERE k >= 0 AND k NOT IN (3, 5)),
added AS (SELECT *, CASE k WHEN 5 THEN n + b ELSE n + b + 1 END AS t, k = 5 AND n % 2 = 0 AS m, CASE WHEN n + 1 > last_no OR (n + 1 = last_no AND NOT last_full) THEN -1 ELSE n + 1 END AS place FROM y WHERE k IN (5, 7)),
rated AS (SELECT *, bool_or(m) OVER (PARTITION BY doc_id, g) AS any_m, row_number() OVER (PARTITION BY doc_id, g ORDER BY t DESC) AS r FROM added),
at_a AS (SELECT doc_id, path, 2 * g AS walk, n AS line_no, {_KIND} AS kind FROM context UNION ALL SELECT doc_id, path, 2 * g + 1, n, {_KIND} FROM rated WHERE m
    UNION ALL SELECT doc_id, path, 2 * g + 1, CASE WHEN g % 4 < 2 THEN place ELSE kept END, 'add' FROM rated WHERE NOT any_m AND r = 1 AND (g % 4 < 2 OR kept IS NOT NULL)),
whole AS (SELECT *, bool_and(line_no // 9 % 2 = 0) OVER (PARTITION BY doc_id, walk) AS z FROM at_a)
SELECT doc_id, walk, path, 'b' AS commit_id, t AS line_no, kind, 0 AS depth FROM (SELECT doc_id, path, 2 * g AS walk, t, {_KIND} AS kind FROM context UNION ALL SELECT doc_id, path, 2 * g + 1, t, {_KIND} FROM added)
UNION ALL SELECT doc_id, walk, path, CASE WHEN line_no = -1 THEN 'a' ELSE 'z' END, line_no, kind, 1 FROM whole WHERE line_no = -1 OR z""")
def walked_chunks(spark, d):
    """A document is a file in commit a; b applies its patch, c takes it back, d leaves the file as b made it. Nine lines of a are a group: in
    c a walk starts at those that b kept, in d at those that it added, of which every second new one was said to mean the old one."""
    # Patches are parsed once, not in each round. What is meant is known, so no text of a line is asked for.
    every, rows = graphs._cut(document_diffs(spark, d).withColumn("value", F.lit(""))), document_lines(spark, d)
    at = lambda c, rows: rows.withColumn("commit_id", F.lit(c))
    changes = at("b", every)
    group = lambda n: F.floor(F.col(n) / 9).cast("int")
    start = every.where("line_type = ' '").select("doc_id", "path", F.lit("c").alias("commit_id"), F.col("src_no").alias("line_no"), group("src_no").alias("g"), F.lit(0).alias("odd"))
    # A line is added behind the old one that the patch names before it.
    above = F.max("src_no").over(W.partitionBy("doc_id", "hunk_idx").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    added = every.withColumn("above", above).where("line_type = '+'").select("doc_id", "path", F.lit("d").alias("commit_id"), F.col("tgt_no").alias("line_no"), "above", (F.col("above") % 9 == 5).alias("new"))
    start = start.unionByName(added.select("doc_id", "path", "commit_id", "line_no", group("above").alias("g"), F.lit(1).alias("odd")))
    starts = start.select("doc_id", (2 * F.col("g") + F.col("odd")).alias("walk"), "path", "commit_id", "line_no", F.when(F.col("g") % 4 < 2, "add").otherwise("remove").alias("kind"))
    known = added.where("new AND above % 2 = 0").select("doc_id", "path", F.lit("b").alias("commit_id"), "line_no", F.lit(walks.MEANT).alias("by"), F.col("path").alias("to_path"), F.col("above").alias("new_no"))
    numbers = rows.select("doc_id", "path", "line_no")
    named = start.select("doc_id", "path", "commit_id", "line_no", F.lit("b").alias("origin_commit"))
    blame = named.unionByName(at("a", numbers).withColumn("origin_commit", F.when(F.floor(F.col("line_no") / 9) % 2 == 0, "z").otherwise("a")))
    docs = rows.select("doc_id").distinct()
    ranked = docs.select("doc_id", F.inline(F.array(*(F.struct(F.lit(c).alias("commit_id"), F.lit(i).alias("rank")) for i, c in enumerate("zabcd")))))
    edges = docs.select("doc_id", F.inline(F.array(*(F.struct(F.lit(c).alias("commit_id"), F.lit(p).cast("string").alias("parent_id"), F.lit(0).alias("parent_idx")) for c, p in (("b", "a"), ("a", "z"), ("z", None))))))
    between = at("c", every).withColumn("origin_commit", F.lit("b"))
    return walks.walked_chunks(starts, blame, ranked, between, changes, known, at("b", rows), edges, ["doc_id"])


@query("SELECT c_custkey AS a, c_custkey % 7 AS line_no, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS steps FROM customer")
def walk_back(spark, d):
    c = table(spark, d, "customer")
    start = c.select("c_custkey", F.lit("x").alias("commit_id"), (F.col("c_custkey") % 7).alias("line_no"))
    steps = c.where("c_custkey % 2 = 0").select("c_custkey", F.lit("x").alias("from_commit"), (F.col("c_custkey") % 7).alias("from_line"), F.lit("w").alias("commit_id"), (F.col("c_custkey") % 7).alias("line_no"))
    found = graphs.walk_back(start, steps, ["c_custkey"])
    return found.groupBy(F.col("c_custkey").alias("a"), "line_no").agg(F.max("depth").alias("steps"))


@query("WITH x AS (SELECT l_orderkey AS k, l_linenumber AS i, l_partkey % 12 AS a FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem WHERE l_linenumber <= 2 ORDER BY l_orderkey, l_linenumber, l_partkey)), p AS (SELECT u.k, u.i AS i, u.a AS a, v.i AS j, v.a AS b FROM x u LEFT JOIN x v ON u.k = v.k AND u.i <> v.i) SELECT DISTINCT k AS l_orderkey, CASE WHEN j IS NOT NULL AND abs(a - b) <= 2 THEN '1@2' ELSE i::VARCHAR END AS key FROM p")
def overlapping_sets(spark, d):
    rows = table(spark, d, "lineitem").where("l_linenumber <= 2").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    start = (F.col("p") % 12).cast("int")
    found = graphs.overlapping_sets(rows.select("l_orderkey", "l_linenumber", F.sequence(start, start + 2).alias("lines")), ["l_orderkey"], "l_linenumber", "lines")
    return found.select("l_orderkey", "key")


@query("SELECT p_partkey, p_name FROM part WHERE NOT (p_partkey % 3 = 0 OR p_partkey % 5 = 0)")
def unapplied_files(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("path"))
    applied = p.select("p_partkey", "path", F.lit("plain").alias("mode"), (F.col("p_partkey") % 3 == 0).alias("ok")).unionByName(p.select("p_partkey", "path", F.lit("fuzz").alias("mode"), (F.col("p_partkey") % 5 == 0).alias("ok")))
    return studies.unapplied(p, applied, ["p_partkey"]).select("p_partkey", F.col("path").alias("p_name"))


@query(f"WITH RECURSIVE {_EDGES}, {_ASKED}, {_UP}, s AS (SELECT a, b, u.anc AS c FROM asked JOIN up u ON u.id = b WHERE NOT EXISTS (SELECT 1 FROM up w WHERE w.id = asked.a AND w.anc = u.anc)) SELECT a, count(*) AS commits, round(count(*) FILTER (WHERE c % 2 = 0) / 2.0::DOUBLE + count(*) FILTER (WHERE c % 3 = 0) / 2.0::DOUBLE, 6) AS file_commits FROM s GROUP BY 1")
def commit_distance(spark, d):
    small = _edges(spark, d).where("commit_id <= 107")
    pairs = _asked(spark, d).select("a", F.col("a").alias("low"), F.col("b").alias("high"))
    up = graphs.closure(small, "commit_id", "parent_id")
    every = small.select("commit_id").distinct()
    files = every.where("commit_id % 2 = 0").withColumn("path", F.lit("x")).unionByName(every.where("commit_id % 3 = 0").withColumn("path", F.lit("y")))
    touched = pairs.select("a").join(files.withColumn("j", F.lit(1)), F.lit(True)).select("a", "path", "commit_id")
    with_key = pairs.select("a").join(up.withColumn("j", F.lit(1)), F.lit(True)).select("a", "child", "ancestor")
    return studies.commit_distance(with_key, pairs, touched, ["a"]).select("a", "commits", F.round("file_commits", 6).alias("file_commits"))


# --- functions of source texts -----------------------------------------------------------------------------------------------
# Each part is a script that its key and size vary: a function with destructured parameters and one or two functions in it, a class where the
# size is a multiple of 3, and an assigned function. i and j say which parts are there. A C file has its key and size too.
def _scripts(spark, d):
    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    if_ = lambda rule, text: F.when(rule, F.lit(text)).otherwise("")
    js = F.concat(
        F.lit("function f"), k, F.lit("({ a, b: [c] }, ...rest) {\n  const x = a + "), size, F.lit(";\n"), if_(F.col("i") == 1, "  const g = (y) => { return y * x; };\n"),
        F.lit("  return rest.map(function (z) { return z + c + x; });\n}\n"), if_(F.col("j") == 1, "class K {\n  static m(p = {}) { return p; }\n}\n"),
        F.lit("mod.run"), size, F.lit(' = async function () { let x = "}"; return x; };\n'),
    )
    c = F.concat(F.lit("int h"), k, F.lit("(int a) {\n  return a + "), size, F.lit(";\n}\n"))
    flags = [F.when(F.col("p_size") % 2 == 0, 1).otherwise(0).alias("i"), F.when(F.col("p_size") % 3 == 0, 1).otherwise(0).alias("j")]
    return table(spark, d, "part").select("p_partkey", "p_size", *flags).select("p_partkey", "p_size", "i", "j", js.alias("js"), c.alias("c"))


_SCRIPTS = "s AS (SELECT p_partkey, p_size, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS i, CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS j FROM part)"


@query(f"""WITH {_SCRIPTS} SELECT p_partkey, 'f' || p_partkey AS name, 1 AS start_line, (4 + i)::INT AS end_line, '{{ a, b: [c] }}, ...rest' AS params, 'rest.map(function (z) {{ return z + c + x; }})' AS ret, (2 + i)::INT AS place FROM s
UNION ALL SELECT p_partkey, 'g', 3, 3, 'y', 'y * x', 1 FROM s WHERE i = 1 UNION ALL SELECT p_partkey, '', 3 + i, 3 + i, 'z', 'z + c + x', 1 + i FROM s
UNION ALL SELECT p_partkey, 'm', 6 + i, 6 + i, 'p = {{}}', 'p', 3 + i FROM s WHERE j = 1 UNION ALL SELECT p_partkey, 'mod.run' || p_size, 5 + i + 3 * j, 5 + i + 3 * j, '', 'x', 3 + i + j FROM s
UNION ALL SELECT p_partkey, 'h' || p_partkey, 1, 3, 'int a', 'int', 1 FROM s""")
def functions_of_texts(spark, d):
    s = _scripts(spark, d)
    columns = ["p_partkey", "name", "start_line", "end_line", "params", "ret", "place"]
    js = syntax.functions(s, ["p_partkey"], "js", syntax.syntax(s, ["p_partkey"], "js")).select(*columns)
    return js.unionByName(code.functions(s, ["p_partkey"], "c", "c").withColumn("place", F.lit(1)).select(*columns))


@query(f"""WITH {_SCRIPTS}, a AS (SELECT *, unnest([2, 3, 4]) AS line_no FROM s) SELECT p_partkey, line_no::INT AS line_no, CASE WHEN line_no = 4 AND i = 0 THEN 1 ELSE line_no END::INT AS first, line_no::INT AS last FROM a""")
def statements_around(spark, d):
    """Lines 2 to 4: a declaration, another one or a return, and a return or the end of the function's block."""
    s = _scripts(spark, d)
    places = s.select("p_partkey", F.explode(F.array(F.lit(2), F.lit(3), F.lit(4))).alias("line_no"))
    return syntax.statements_around(places, s, ["p_partkey"], "js", syntax.syntax(s, ["p_partkey"], "js")).drop("text")


@query(f"""WITH {_SCRIPTS} SELECT p_partkey, 0 AS r, CASE WHEN i = 1 THEN 'x,g,y,z' ELSE 'x,z' END AS defs, 'a,rest,c' AS uses FROM s UNION ALL SELECT p_partkey, 1, 'x', 'mod' FROM s
UNION ALL SELECT p_partkey, 2, 'z', 'rest,c,x' FROM s""")
def names_in_ranges(spark, d):
    """The inner lines of the first function; the last line, whose x is another one; and the first function's return alone."""
    s = _scripts(spark, d)
    last = F.col("i") + 3 * F.col("j") + 5
    range_ = lambda r, a, b: F.struct(F.lit(r).alias("r"), a.cast("int").alias("first"), b.cast("int").alias("last"))
    inner = F.col("i") + 3
    asked = s.select("p_partkey", F.inline(F.array(range_(0, F.lit(2), inner), range_(1, last, last), range_(2, inner, inner))))
    found = syntax.names_in_ranges(asked, syntax.names(syntax.syntax(s, ["p_partkey"], "js"), ["p_partkey"]), ["p_partkey"], ["r"])
    return found.select("p_partkey", "r", F.array_join("def", ",").alias("defs"), F.array_join("use", ",").alias("uses"))


@query("SELECT a.p_partkey, 'f' AS old_name, 'f' AS new_name, a.p_size <> b.p_size AS changed, false AS params_changed FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def matched_functions(spark, d):
    f = lambda rows: rows.select("p_partkey", F.lit("f").alias("name"), F.lit("a").alias("params"), F.lit("").alias("ret"), F.concat(F.lit("return "), F.col("p_size").cast("string")).alias("body"))
    p = table(spark, d, "part").select("p_partkey", "p_size")
    new = p.select((F.col("p_partkey") - 1).alias("p_partkey"), "p_size")
    both = f(p.join(new.select("p_partkey"), "p_partkey", "left_semi"))
    matched = code.matched_functions(both, f(new), ["p_partkey"]).withColumn("old_params", F.lit("a")).withColumn("new_params", F.lit("a")).withColumn("old_ret", F.lit("")).withColumn("new_ret", F.lit(""))
    return code.signature_changes(matched).select("p_partkey", "old_name", "new_name", (F.col("old_body") != F.col("new_body")).alias("changed"), "params_changed")


@query("SELECT a.p_partkey, 'f' AS name FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_size <> b.p_size")
def changed_functions(spark, d):
    f = lambda rows: rows.select("p_partkey", F.lit("f").alias("name"), F.lit(1).alias("start_line"), F.concat(F.lit("return "), F.col("p_size").cast("string")).alias("body"))
    p = table(spark, d, "part").select("p_partkey", "p_size")
    return studies.changed_functions(f(p), f(p.select((F.col("p_partkey") - 1).alias("p_partkey"), "p_size")), ["p_partkey"]).select("p_partkey", "name")


@query(f"WITH {DIFFS}, c AS (SELECT doc_id, path, CASE WHEN src_no BETWEEN 1 AND 30 THEN CASE WHEN src_no BETWEEN 5 AND 9 THEN 'inner' ELSE 'outer' END ELSE 'global' END AS name, src_no FROM dl WHERE line_type = '-') SELECT doc_id, path, name, string_agg(src_no::VARCHAR, ',' ORDER BY src_no) AS lines FROM c GROUP BY 1, 2, 3")
def function_targets(spark, d):
    of = document_lines(spark, d).select("doc_id", "path").distinct()
    f = lambda a, b, name: of.select("doc_id", "path", F.lit(a).alias("start_line"), F.lit(b).alias("end_line"), F.lit(name).alias("name"))
    found = studies.function_targets(document_diffs(spark, d), f(1, 30, "outer").unionByName(f(5, 9, "inner")), ["doc_id"])
    return found.select("doc_id", "path", "name", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


# --- edits --------------------------------------------------------------------------------------------------------------------
@query(f"WITH {LINES} SELECT doc_id, md5(string_agg(CASE WHEN n = 2 THEN 'X' || v ELSE v END, chr(10) ORDER BY n)) AS text FROM l WHERE doc_id IN (SELECT doc_id FROM l GROUP BY 1 HAVING max(n) >= 2) GROUP BY 1")
def applied_edits(spark, d):
    numbered = table(spark, d, "documents").select("doc_id", "text", F.split("text", "\n").alias("l")).where("size(l) >= 2")
    text = F.concat(F.lit("\n"), F.array_join(F.transform("l", lambda v, i: F.concat(F.lit("@"), (i + 1).cast("string"), F.lit("@"), v)), "\n"))
    rows = numbered.select("doc_id", text.alias("text"), F.lit("\n@2@").alias("old"), F.lit("\n@2@X").alias("new"), F.lit(3).alias("line"), F.lit(0).alias("ord"))
    done = edits.applied_edits(rows, ["doc_id"])
    plain = F.regexp_replace(F.substring("text", F.lit(2), F.char_length("text")), r"(?m)^@\d+@", "")
    return done.select("doc_id", F.md5(plain).alias("text"))


@query(f"WITH {LINES}, f AS (SELECT doc_id, n FROM l WHERE trim(v, ' ' || chr(9) || chr(13)) <> ''), p AS (SELECT DISTINCT doc_id FROM f WHERE n = 3) SELECT doc_id, 0 AS ord, coalesce((SELECT max(n) FROM f WHERE f.doc_id = p.doc_id AND f.n < 3), coalesce(NULL, -1))::INT AS line_no FROM p UNION ALL SELECT doc_id, 1, 3 FROM p UNION ALL SELECT doc_id, 2, coalesce((SELECT min(n) FROM f WHERE f.doc_id = p.doc_id AND f.n > 3), -1)::INT FROM p")
def repaired_lines(spark, d):
    of = document_lines(spark, d).where("line_no = 3").where(F.trim(F.regexp_replace("value", r"[\t\r]", " ")) != "").select("doc_id")
    docs = table(spark, d, "documents").join(of, "doc_id", "left_semi").select("doc_id", "text", F.posexplode(F.array(F.lit(-1), F.lit(3), F.lit(-1))).alias("ord", "line_no"))
    return edits.repaired_lines(docs, ["doc_id"])


@query("WITH x AS (SELECT o_custkey AS k, o_orderkey AS i, repeat('a', (o_orderkey % 5)::INT) AS c FROM orders) SELECT k AS o_custkey, string_agg(i::VARCHAR, ',' ORDER BY length(c) DESC, i) AS hunks, max(c) AS context FROM x WHERE c <> '' GROUP BY 1 UNION ALL SELECT k, i::VARCHAR, '' FROM x WHERE c = ''")
def merged_prompts(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("ord"), F.col("o_orderkey").cast("string").alias("prompt"), F.repeat(F.lit("a"), (F.col("o_orderkey") % 5).cast("int")).alias("context"))
    return edits.merged_prompts(rows, ["o_custkey"]).select("o_custkey", F.array_join("hunks", ",").alias("hunks"), "context")


@query("SELECT p_partkey, 0 AS ord, least(p_size, 7)::INT AS line_no FROM part UNION ALL SELECT p_partkey, 1, CASE WHEN p_size >= 7 THEN 7 ELSE least(p_size, 7) END::INT FROM part")
def moving_matches(spark, d):
    """Lines are runs of 1 to 7 equal characters; the probe is as long as the part's size, up to seven."""
    n = F.least(F.col("p_size"), F.lit(7)).cast("int")
    p = table(spark, d, "part").select("p_partkey", n.alias("n"))
    lines = p.select("p_partkey", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("line_no")).withColumn("value", F.repeat(F.lit("x"), F.col("line_no")))
    probes = p.select("p_partkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("ord"), F.repeat(F.lit("x"), F.col("n")).alias("value"))
    return similarity.moving_matches(probes, lines, ["p_partkey"])


@query("SELECT p_partkey, least(p_size, 7)::VARCHAR AS lines FROM part WHERE p_size >= 3")
def localized_by_likeness(spark, d):
    n = F.least(F.col("p_size"), F.lit(7)).cast("int")
    p = table(spark, d, "part").select("p_partkey", n.alias("n"))
    lines = p.select("p_partkey", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("line_no")).withColumn("value", F.repeat(F.lit("x"), F.col("line_no")))
    source = p.select("p_partkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("ord"), F.repeat(F.lit("x"), F.col("n")).alias("value"))
    return studies.localized_by_likeness(source, lines, ["p_partkey"]).select("p_partkey", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY event_id % 100, event_type) AS paths FROM (SELECT DISTINCT user_id, event_id % 100 AS event_id, event_type FROM events) GROUP BY 1")
def name_history(spark, d):
    names = table(spark, d, "events").select("user_id", F.format_string("c%03d", F.col("event_id") % 100 + 1).alias("commit_id"), F.col("event_type").alias("path")).distinct()
    found = graphs.name_history(names, graphs.ranks(_chain(spark), "commit_id", "parent_id"), ["user_id"])
    return found.select("user_id", F.array_join("paths", ",").alias("paths"))


@query("SELECT p_partkey, 'f' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN 1 END AS start_line, CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN p_size % 2 = 0 THEN 5 ELSE 4 END END AS end_line FROM part")
def function_by_name(spark, d):
    s = _scripts(spark, d)
    found = code.functions(s.where("p_partkey % 2 = 0"), ["p_partkey"], "js")
    return code.function_by_name(s.select("p_partkey", F.format_string("f%d", "p_partkey").alias("name")), found, ["p_partkey"]).select("p_partkey", "name", "start_line", "end_line")
