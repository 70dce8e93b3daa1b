"""Benchmark decontamination by winnowing (DataFrame functions only).

A text's fingerprints are the smallest k-gram hash of every sliding window of ``window - k + 1`` k-grams, so two texts
that share ``window`` consecutive words share a fingerprint. Each document keeps, of its windows, those whose
fingerprint may be one of the benchmark's (a bit array of bounded size tells; wrong hits fall to the join). These are
joined on the fingerprint, and each hit is extended to the windows that it stands for, word by word.
An item of fewer than ``window`` words is one window, its hash the fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_ALNUM, ascii_lower, bit_array, bit_set, bits_for, cut, let, rows_without, table, words_of

WINDOW, K = 10, 5
#: Repeated rows that are given back from one row at a time.
REPEATS = 1 << 12


def _fingerprints(words: Column, window: int, k: int) -> Column:
    """For each window of ``window`` words, in order, its fingerprint; none if there are fewer words."""

    def least(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, k)))
        return let(grams, lambda g: F.transform(F.sequence(F.lit(1), F.size(g) - (window - k)), lambda i: F.array_min(F.slice(g, i, window - k + 1))))

    return F.when(F.size(words) >= window, least(words)).otherwise(F.array().cast("array<bigint>"))


def _short(words: Column, length: int) -> Column:
    """For each run of ``length`` words, in order, its hash."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - (length - 1)), lambda i: F.xxhash64(F.slice(words, i, length), F.lit(length)))
    return F.when(F.size(words) >= length, runs).otherwise(F.array().cast("array<bigint>"))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """The distinct windows of all items: fingerprint, words (joined by spaces), length and the items that hold them."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(ascii_lower(F.col("text")), NOT_ALNUM).alias("w")).where(F.size("w") > 0)
    full = items.where(F.size("w") >= window).select("item", let(F.col("w"), lambda w: F.transform(_fingerprints(w, window, k), lambda f, i: F.struct(f.alias("fingerprint"), F.array_join(F.slice(w, i + 1, window), " ").alias("run"), F.lit(window).alias("length")))).alias("x"))
    short = items.where(F.size("w") < window).select("item", F.array(F.struct(F.xxhash64("w", F.size("w")).alias("fingerprint"), F.array_join("w", " ").alias("run"), F.size("w").alias("length"))).alias("x"))
    return full.unionByName(short).select("item", F.explode("x").alias("x")).groupBy("x.fingerprint", "x.run", "x.length").agg(F.collect_set("item").alias("items"))


def _candidates(docs: DataFrame, known: DataFrame, window: int, k: int) -> DataFrame:
    """A row for each window of a document whose fingerprint may be known, or one row for a document without."""
    size = bits_for(known.count(), 64, 1 << 16)
    lengths = sorted(x[0] for x in known.where(F.col("length") < window).select("length").distinct().collect())  # fewer than window numbers
    rows = docs.select("doc_id", "text", bit_array(known, "fingerprint", size).scalar().alias("bits"))

    def candidates(w: Column, bits: Column) -> Column:
        def of(fingerprints: Column, length: int) -> Column:
            found = F.filter(F.transform(fingerprints, lambda f, i: F.when(bit_set(bits, f, size), F.struct(f.alias("fingerprint"), (i + 1).alias("start")))), lambda x: x.isNotNull())
            return F.transform(found, lambda x: F.struct(x["fingerprint"].alias("fingerprint"), F.array_join(F.slice(w, x["start"], length), " ").alias("run"), x["start"].alias("start")))

        full = of(_fingerprints(w, window, k), window)
        return F.concat(full, *(of(_short(w, n), n) for n in lengths)) if lengths else full

    def both(w: Column) -> Column:
        return let(F.col("bits"), lambda bits: F.struct(F.size(w).alias("n_words"), candidates(w, bits).alias("found")))

    tried = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), let(words_of(ascii_lower(F.col("text")), NOT_ALNUM), both).alias("x"))
    out = tried.select("doc_id", "text_hash", F.col("x.n_words").alias("n_words"), F.posexplode_outer("x.found").alias("pos", "f"))
    # Without a window, keys that no window has, so that these rows do not meet in one task.
    return out.select("doc_id", "text_hash", "n_words", "pos", F.coalesce("f.fingerprint", F.xxhash64("doc_id", "text_hash")).alias("fingerprint"), F.coalesce("f.run", F.lit("")).alias("run"), F.col("f.start").alias("start"))


def per_document(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_hash, n_words, n_hit, n_items, items (array of strings).

    Null and empty texts have no words and no hit; null item_ids count as the item ''; items of one id are one item.
    Rows with the same doc_id and text are judged together, and each gets the result. An empty table gives no row, an empty
    benchmark no hit. Memory of a task grows with the longest text alone; other columns may have any names.
    """
    known = cut(benchmark_windows(benchmark, window, k))
    joined = _candidates(docs, known, window, k).join(known, ["fingerprint", "run"], "left")
    start = F.when(F.col("length").isNotNull(), F.struct(F.col("start").cast("long").alias("start"), (F.col("start") + F.col("length")).cast("long").alias("end")))
    grouped = joined.groupBy("doc_id", "text_hash").agg(F.max("n_words").cast("long").alias("n_words"), F.count_if(F.coalesce("pos", F.lit(0)) == 0).alias("rows"), F.array_sort(F.collect_set(start)).alias("spans"), F.collect_set("items").alias("lists"))
    state = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("end"))
    covered = F.aggregate("spans", state, lambda s, x: F.struct((s["hit"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], s["end"]))).alias("hit"), F.greatest(s["end"], x["end"]).alias("end")))["hit"]
    out = grouped.select("doc_id", "text_hash", "n_words", covered.alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("lists"))).alias("items"), "rows")
    # A row for each repeated one, by blocks, so no array grows with their number.
    blocks = out.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(REPEATS).cast("long"))).alias("block"))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(REPEATS), F.col("rows") - F.col("block"))))
    return blocks.select("doc_id", "text_hash", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", each).drop("col")


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = per_document(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
runs AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS run FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM runs),
places AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS run FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT p.doc_id, p.i, p.n, r.item FROM places p JOIN runs r ON p.n = r.n AND p.run = r.run),
hits AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(t.list, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits h ON h.doc_id IS NOT DISTINCT FROM d.doc_id LEFT JOIN items t ON t.doc_id IS NOT DISTINCT FROM d.doc_id
"""


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """The rows of ``docs`` (all columns as they are) that share no window with ``benchmark``.

    Nulls, empty texts and tables are taken as in ``per_document``; repeated rows fare alike, all that stay as often as they were.
    """
    known = cut(benchmark_windows(benchmark, window, k))
    hit = _candidates(docs, known, window, k).join(known.select("fingerprint", "run"), ["fingerprint", "run"], "left_semi")
    gone = cut(hit.select(F.xxhash64("doc_id", "text_hash").alias("row"), F.col("text_hash").alias("row2")).distinct())
    return rows_without(docs, gone, [F.xxhash64("doc_id", F.xxhash64("text")).alias("row"), F.xxhash64("text").alias("row2")])
