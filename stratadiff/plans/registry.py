"""Where queries and their SQL are registered, and the made inputs that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratadiff.operators import diffs
from stratadiff.sources.readers import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- patches of documents ------------------------------------------------------------------------------------------------
# Of every 20 lines of a document the first 12 are a hunk. In hunks, of the lines counted from 1, each 9k + 3 is removed, each 9k + 5
# replaced, and one is added after each 9k + 7.
BLOCK, INSIDE = 20, 12


def document_lines(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, path, line_no (from 1), value of each line of each document."""
    docs = table(spark, d, "documents")
    path = F.concat(F.lit("src/f"), (F.col("doc_id") % 5).cast("string"), F.lit(".js"))
    lines = docs.select("doc_id", path.alias("path"), F.posexplode(F.split("text", "\n")).alias("at", "value"))
    return lines.select("doc_id", "path", (F.col("at") + 1).alias("line_no"), "value")


def document_patches(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and text: a patch of each document, as a version-control system writes it."""
    n, v = F.col("line_no"), F.col("value")
    kind = F.when((n - 1) % BLOCK < INSIDE, n % 9).otherwise(-1)
    rows = document_lines(spark, d).select("doc_id", "path", n.alias("n"), v.alias("v"), F.floor((n - 1) / BLOCK).alias("h"), kind.alias("k")).where("k >= 0")
    text = F.when(F.col("k") == 3, F.concat(F.lit("-"), "v")).when(F.col("k") == 5, F.concat(F.lit("-"), "v", F.lit("\n+new "), "v")).when(F.col("k") == 7, F.concat(F.lit(" "), "v", F.lit("\n+add "), "v")).otherwise(F.concat(F.lit(" "), "v"))
    more = F.count_if(F.col("k") == 7) - F.count_if(F.col("k") == 3)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", text.alias("t")))), lambda x: x["t"]), "\n")
    hunks = rows.groupBy("doc_id", "path", "h").agg(F.count("*").alias("old"), more.alias("more"), body.alias("body"))
    before = F.coalesce(F.sum("more").over(W.partitionBy("doc_id").orderBy("h").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    start = F.col("h") * BLOCK + 1
    head = F.format_string("@@ -%d,%d +%d,%d @@\n", start, F.col("old"), start + before, F.col("old") + F.col("more"))
    whole = hunks.select("doc_id", "path", "h", F.concat(head, "body").alias("t")).groupBy("doc_id", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("h", "t"))), lambda x: x["t"]), "\n").alias("t"))
    return whole.select("doc_id", F.concat(F.format_string("diff --git a/%s b/%s\n--- a/%s\n+++ b/%s\n", "path", "path", "path", "path"), "t").alias("text"))


def document_diffs(spark: SparkSession, d: str) -> DataFrame:
    return diffs.diff_lines(document_patches(spark, d), "doc_id")


#: The same in SQL: l has the lines; x those with hunk h, kind k and the shift b before them; dl the diff lines.
LINES = "l AS (SELECT doc_id, 'src/f' || (doc_id % 5) || '.js' AS path, unnest(range(1, len(a) + 1))::INT AS n, unnest(a) AS v FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents))"
DIFFS = f"""{LINES}, k_ AS (SELECT *, (n - 1) // {BLOCK} AS h, CASE WHEN (n - 1) % {BLOCK} < {INSIDE} THEN n % 9 ELSE -1 END AS k FROM l),
x AS (SELECT *, coalesce(sum(CASE k WHEN 3 THEN -1 WHEN 7 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS b FROM k_),
e AS (SELECT doc_id, path, h, n, 0 AS o, CASE WHEN k IN (3, 5) THEN '-' ELSE ' ' END AS line_type, v AS value, n AS src_no, CASE WHEN k NOT IN (3, 5) THEN n + b END AS tgt_no FROM x WHERE k >= 0
    UNION ALL SELECT doc_id, path, h, n, 1, '+', 'new ' || v, NULL, n + b FROM x WHERE k = 5 UNION ALL SELECT doc_id, path, h, n, 1, '+', 'add ' || v, NULL, n + b + 1 FROM x WHERE k = 7),
dl AS (SELECT *, h::INT AS hunk_idx, (row_number() OVER (PARTITION BY doc_id, h ORDER BY n, o) - 1)::INT AS pos FROM e)
"""
#: Whether a line of SQL has text in it.
FULL = "trim({}, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) <> ''"
