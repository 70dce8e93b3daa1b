"""Queries over diffs: parsing, chunks, transport, reduction, questions about their lines. Patches are made of the documents (see registry)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratadiff.functions import text as T
from stratadiff.operators import diffs, lines
from stratadiff.plans.registry import DIFFS, FULL, LINES, document_diffs, document_lines, document_patches, query
from stratadiff.sources.readers import table


def _joined(numbers):
    return F.array_join(F.transform(numbers, lambda x: x.cast("string")), ",")


@query(f"WITH {DIFFS} SELECT doc_id, path, hunk_idx, pos, line_type, md5(value) AS value, src_no, tgt_no FROM dl")
def diff_parse(spark, d):
    return document_diffs(spark, d).select("doc_id", "path", "hunk_idx", "pos", "line_type", F.md5("value").alias("value"), "src_no", "tgt_no")


@query(f"""WITH {DIFFS} SELECT doc_id, hunk_idx, count(*) FILTER (WHERE line_type = '+') AS added, count(*) FILTER (WHERE line_type = '-') AS removed,
coalesce(string_agg(src_no::VARCHAR, ',' ORDER BY src_no) FILTER (WHERE line_type = '-'), '') AS removed_lines, coalesce(string_agg(tgt_no::VARCHAR, ',' ORDER BY tgt_no) FILTER (WHERE line_type = '+'), '') AS added_lines FROM dl GROUP BY 1, 2""")
def diff_hunks(spark, d):
    return diffs.hunks(document_diffs(spark, d), "doc_id").select("doc_id", "hunk_idx", "added", "removed", _joined("removed_lines").alias("removed_lines"), _joined("added_lines").alias("added_lines"))


@query(f"WITH {DIFFS} SELECT doc_id, hunk_idx, string_agg(src_no::VARCHAR, ',' ORDER BY src_no) AS lines FROM dl WHERE src_no IS NOT NULL GROUP BY 1, 2")
def hunk_source_range(spark, d):
    return diffs.source_range(diffs.hunks(document_diffs(spark, d), "doc_id")).select("doc_id", "hunk_idx", _joined("lines").alias("lines"))


@query(f"""WITH {DIFFS} SELECT doc_id, hunk_idx, (row_number() OVER (PARTITION BY doc_id, h ORDER BY n) - 1)::BIGINT AS chunk_idx, CASE k WHEN 3 THEN 'delete' WHEN 5 THEN 'change' ELSE 'add' END AS kind,
CASE k WHEN 7 THEN n + 1 ELSE n END AS first, CASE k WHEN 7 THEN n + 1 ELSE n END AS last, CASE k WHEN 7 THEN '' ELSE n::VARCHAR END AS numbers FROM (SELECT *, h::INT AS hunk_idx FROM x WHERE k IN (3, 5, 7))""")
def diff_chunks(spark, d):
    return diffs.chunks(document_diffs(spark, d), "doc_id").select("doc_id", "hunk_idx", "chunk_idx", "kind", "first", "last", _joined("numbers").alias("numbers"))


@query(f"""WITH {DIFFS}, a AS (SELECT x.doc_id, x.h, x.n, min(f.n) AS anchor FROM x LEFT JOIN l f ON f.doc_id = x.doc_id AND f.n > x.n AND {FULL.format("f.v")} WHERE k = 7 GROUP BY 1, 2, 3)
SELECT doc_id, h::INT AS hunk_idx, n + 1 AS wanted, coalesce(anchor, -1)::INT AS first FROM a""")
def anchored_chunks(spark, d):
    chunk = diffs.chunks(document_diffs(spark, d), "doc_id").withColumn("wanted", F.col("first"))
    return diffs.anchored(chunk.where("kind = 'add'"), document_lines(spark, d), "doc_id").select("doc_id", "hunk_idx", "wanted", "first")


@query(f"WITH {DIFFS} SELECT doc_id, n AS line_no, (n + b)::INT AS new_no FROM x WHERE k NOT IN (3, 5)")
def line_transport(spark, d):
    numbers = document_lines(spark, d).select("doc_id", F.col("line_no").alias("ord"), "line_no")
    return diffs.transport(numbers, document_diffs(spark, d), ["doc_id"]).select("doc_id", "line_no", "new_no")


@query(f"""WITH {DIFFS}, t AS (SELECT doc_id, path, h, '@@ -' || min(n) || ',' || count(*) FILTER (WHERE line_type <> '+') || ' +' || (min(n) + max(CASE WHEN pos = 0 THEN b END)) || ',' || count(*) FILTER (WHERE line_type <> '-') || ' @@' || chr(10) || string_agg(line_type || value, chr(10) ORDER BY pos) AS text
    FROM dl JOIN (SELECT doc_id, n, b FROM x) USING (doc_id, n) GROUP BY 1, 2, 3)
SELECT doc_id, md5(string_agg('--- a/' || path || chr(10) || '+++ b/' || path || chr(10) || text, chr(10) ORDER BY h)) AS patch FROM t GROUP BY 1""")
def patch_texts(spark, d):
    return diffs.patch_texts(diffs.hunk_texts(document_diffs(spark, d), "doc_id"), "doc_id").select("doc_id", F.md5("patch").alias("patch"))


@query(f"""WITH {DIFFS} SELECT doc_id, h::INT AS hunk_idx, md5(string_agg(line_type || value, chr(10) ORDER BY pos)) AS body FROM dl WHERE line_type <> '+' GROUP BY 1, 2""")
def hunk_kept_lines(spark, d):
    kept = diffs.hunk_texts(document_diffs(spark, d), "doc_id", F.col("line_type") != "+")
    return kept.select("doc_id", "hunk_idx", F.md5(F.substring("text", F.locate("@@\n", "text") + 3, F.char_length("text"))).alias("body"))


@query(f"""WITH {DIFFS}, t AS (SELECT doc_id, path, h, string_agg(line_type || value, chr(10) ORDER BY pos) AS body FROM dl GROUP BY 1, 2, 3)
SELECT doc_id, h::INT AS hunk_idx, path, md5('diff --git a/' || path || ' b/' || path || chr(10) || '--- a/' || path || chr(10) || '+++ b/' || path || chr(10) || body) AS text FROM t""")
def raw_hunks(spark, d):
    found = diffs.raw_hunks(document_patches(spark, d), "doc_id").where(T.patchable_source(F.col("path"), F.col("is_new")))
    return found.select("doc_id", "hunk_idx", "path", F.md5(F.regexp_replace("text", r"(?m)^@@ -\d+,\d+ \+\d+,\d+ @@\n", "")).alias("text"))


@query(f"WITH {DIFFS}, n_ AS (SELECT doc_id, count(DISTINCT h) AS hunks, count(DISTINCT h) FILTER (WHERE h % 3 = 1) AS needed FROM dl GROUP BY 1) SELECT DISTINCT doc_id, hunk_idx FROM dl JOIN n_ USING (doc_id) WHERE needed = 0 OR hunks = 1 OR h % 3 = 1")
def essential_hunks(spark, d):
    found = document_diffs(spark, d).select("doc_id", "hunk_idx").distinct()
    runs = found.withColumn("status", F.when(F.col("hunk_idx") % 3 == 1, "False#0").otherwise("True"))
    return diffs.essential_hunks(found, runs, "doc_id").select("doc_id", "hunk_idx")


@query(f"WITH {DIFFS} SELECT doc_id, count(*) FILTER (WHERE line_type IN ('+', '-')) AS changed, count(DISTINCT h) AS hunks, count(DISTINCT CASE WHEN line_type <> ' ' THEN n END) AS chunks FROM dl GROUP BY 1")
def changed_lines(spark, d):
    return diffs.changed_lines(document_diffs(spark, d), "doc_id")


@query(f"""WITH {DIFFS}, r AS (SELECT doc_id, value, min(src_no) AS src_no FROM dl WHERE line_type = '-' GROUP BY 1, 2 HAVING count(*) = 1), a AS (SELECT doc_id, substr(value, 5) AS value, min(tgt_no) AS tgt_no FROM dl WHERE line_type = '+' GROUP BY 1, 2 HAVING count(*) = 1)
SELECT doc_id, src_no, tgt_no FROM r JOIN a USING (doc_id, value) WHERE {FULL.format("value")}""")
def unique_moves(spark, d):
    dl = document_diffs(spark, d)
    added = dl.where("line_type = '+'").withColumn("value", F.substring("value", F.lit(5), F.char_length("value")))
    return diffs.unique_moves(dl.where("line_type = '-'"), added, ["doc_id"]).select("doc_id", "src_no", "tgt_no")


@query(f"""WITH {DIFFS} SELECT a.doc_id, a.tgt_no, max(s.src_no) AS old_before, min(t.src_no) AS old_after FROM dl a LEFT JOIN dl s ON s.doc_id = a.doc_id AND s.h = a.h AND s.pos < a.pos LEFT JOIN dl t ON t.doc_id = a.doc_id AND t.h = a.h AND t.pos > a.pos
WHERE a.line_type = '+' GROUP BY 1, 2""")
def placed_additions(spark, d):
    return diffs.placed_additions(document_diffs(spark, d), "doc_id").select("doc_id", "tgt_no", "old_before", "old_after")


# --- questions about lines of diffs -----------------------------------------------------------------------------------------
@query(f"WITH {DIFFS} SELECT doc_id, count(*) AS n FROM dl WHERE {FULL.format('value')} GROUP BY 1")
def diff_lines_with_text(spark, d):
    return lines.with_text(lines.of_sources(document_diffs(spark, d))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"WITH {DIFFS} SELECT doc_id, src_no, md5(value) AS value FROM dl WHERE line_type = '-' AND src_no BETWEEN 4 AND 60")
def removed_between(spark, d):
    return lines.removed_between(document_diffs(spark, d), F.lit(4), F.lit(60)).select("doc_id", "src_no", F.md5("value").alias("value"))


@query(f"WITH {DIFFS} SELECT doc_id, string_agg(src_no::VARCHAR, ',' ORDER BY src_no) AS lines FROM dl WHERE line_type = '-' GROUP BY 1")
def removed_numbers(spark, d):
    return lines.removed_numbers(document_diffs(spark, d), ["doc_id"]).select("doc_id", _joined("lines").alias("lines"))


@query(f"WITH {DIFFS} SELECT doc_id, string_agg(tgt_no::VARCHAR, ',' ORDER BY tgt_no) AS lines FROM dl WHERE line_type = '+' GROUP BY 1")
def added_numbers(spark, d):
    return lines.added_by_commit(document_diffs(spark, d), ["doc_id"]).select("doc_id", _joined("lines").alias("lines"))


@query(f"WITH {DIFFS} SELECT doc_id, tgt_no, md5(value) AS value FROM dl WHERE line_type = '+' AND tgt_no % 2 = 0 AND EXISTS (SELECT 1 FROM l WHERE l.doc_id = dl.doc_id AND l.n = dl.tgt_no)")
def added_among(spark, d):
    wanted = document_lines(spark, d).where("line_no % 2 = 0").select("doc_id", F.col("line_no").alias("tgt_no"))
    return lines.added_among(document_diffs(spark, d), wanted, ["doc_id"]).select("doc_id", "tgt_no", F.md5("value").alias("value"))


@query(f"WITH {DIFFS} SELECT doc_id, md5(value) AS value FROM dl WHERE line_type = '-' AND src_no = 5")
def removed_content(spark, d):
    return lines.content_at(document_diffs(spark, d), ["doc_id"], F.lit(5)).select("doc_id", F.md5("value").alias("value"))


@query(f"WITH {DIFFS} SELECT doc_id, hunk_idx, min(src_no) AS src_no FROM dl WHERE line_type = ' ' AND tgt_no > 8 GROUP BY 1, 2")
def context_after(spark, d):
    return lines.context_after(document_diffs(spark, d), ["doc_id", "hunk_idx"], F.lit(8)).select("doc_id", "hunk_idx", "src_no")


# --- questions about lines of files ------------------------------------------------------------------------------------------
@query(f"WITH {LINES} SELECT doc_id, string_agg(n::VARCHAR, ',' ORDER BY n) AS lines FROM l WHERE contains(v, 'the') GROUP BY 1")
def numbers_containing(spark, d):
    return lines.numbers_containing(document_lines(spark, d), ["doc_id"], F.lit("the")).select("doc_id", _joined("lines").alias("lines"))


@query(f"WITH {LINES} SELECT doc_id, coalesce(min(CASE WHEN replace(v, ' ', '') = '' AND n >= 2 THEN n END), -1)::INT AS line_no FROM l GROUP BY 1")
def first_equal_line(spark, d):
    return lines.first_equal(document_lines(spark, d), ["doc_id"], F.lit(" "), F.lit(2))


@query(f"WITH {LINES} SELECT a.doc_id, a.n AS line_no, coalesce(min(b.n), -1)::INT AS full_no FROM l a LEFT JOIN l b ON b.doc_id = a.doc_id AND b.n >= a.n AND {FULL.format('b.v')} GROUP BY 1, 2")
def next_full_line(spark, d):
    of = document_lines(spark, d)
    return lines.next_full(of.select("doc_id", "line_no"), of, ["doc_id"])


@query(f"""WITH {LINES}, t AS (SELECT doc_id, n, v, lead(v) OVER (PARTITION BY doc_id ORDER BY n) AS w FROM l), b AS (SELECT doc_id, v, w FROM t WHERE n = 2 AND w IS NOT NULL)
SELECT t.doc_id, min(t.n)::INT AS line_no FROM t JOIN b ON b.doc_id = t.doc_id AND b.v = t.v AND b.w = t.w GROUP BY 1""")
def place_of_block(spark, d):
    of = document_lines(spark, d)
    two = of.where("line_no IN (2, 3)").select("doc_id", F.col("line_no").alias("ord"), "value")
    whole = two.groupBy("doc_id").agg(F.count("*").alias("n")).where("n = 2").select("doc_id")
    return lines.place_of_block(of, two.join(whole, "doc_id", "left_semi"), ["doc_id"]).select("doc_id", F.col("line_no").cast("int").alias("line_no"))


@query(f"WITH {LINES} SELECT doc_id, md5(coalesce(string_agg(v, chr(10) ORDER BY n) FILTER (WHERE n BETWEEN 2 AND 4), '')) AS part, md5(coalesce(min(v) FILTER (WHERE n = 1), '')) AS line FROM l GROUP BY 1")
def lines_by_number(spark, d):
    every = T.lines_of(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(F.array_join(T.line_slice(every, F.lit(2), F.lit(4)), "\n")).alias("part"), F.md5(F.get(T.lines_at(every, F.array(F.lit(1))), F.lit(0))).alias("line"))
