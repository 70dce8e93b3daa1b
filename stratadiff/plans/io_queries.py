"""Queries that write tables through the sinks and read them back through the readers, in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from stratadiff.plans.registry import query
from stratadiff.sources import readers, sinks
from stratadiff.sources.readers import table


def _folder(spark, name: str) -> str:
    """A new folder below spark.checkpoint.dir; on one machine without one, a temporary folder."""
    home = spark.conf.get("spark.checkpoint.dir", "")
    if not home:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        home = tempfile.gettempdir()
    return f"{home.rstrip('/')}/queries/{name}-{uuid.uuid4()}"


def _written(spark, rows, name: str, text, by=None) -> str:
    """Rows as lines of text; ``by``: a folder with one file for each value."""
    path = _folder(spark, name)
    if by is None:
        sinks.overwrite_text(rows.select(text.alias("value")), path, "value")
    else:
        rows.select(text.alias("value"), by.alias("case")).repartition("case").write.mode("overwrite").partitionBy("case").text(path)
    return path


def _case():
    return F.regexp_extract("case_id", r"case=(.*)", 1)


@query("SELECT '/data/part' || p_partkey || '_' || p_size || '.0' AS path, 'part' || p_partkey AS name, p_size || '.0' AS version FROM part")
def read_case_paths(spark, d):
    path = _written(spark, table(spark, d, "part"), "cases", F.format_string("/data/part%d_%d.0", "p_partkey", "p_size"))
    return readers.case_paths(spark, path)


@query("SELECT n_nationkey::VARCHAR AS case_id, 'CVE-' || n_nationkey AS id, n_name AS sink, 'x:' || n_regionkey AS dependencies FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT '3', NULL, NULL, NULL")
def read_case_metadata(spark, d):
    n = table(spark, d, "nation")
    doc = F.when(F.col("n_nationkey") == 3, "{broken").otherwise(F.to_json(F.struct(F.concat(F.lit("CVE-"), F.col("n_nationkey").cast("string")).alias("id"), F.create_map(F.lit("x"), F.col("n_regionkey").cast("string")).alias("dependencies"), F.col("n_name").alias("sink"))))
    path = _written(spark, n, "metadata", doc, F.col("n_nationkey"))
    entry = F.nullif(F.array_join(F.transform(F.map_entries("dependencies"), lambda e: F.concat_ws(":", e["key"], e["value"])), ","), F.lit(""))
    return readers.case_metadata(spark, f"{path}/*/*.txt").select(_case().alias("case_id"), "id", "sink", entry.alias("dependencies"))


@query("SELECT n_nationkey::VARCHAR AS case_id, md5(n_name || chr(10) || n_name || chr(10)) AS text FROM nation")
def read_whole_texts(spark, d):
    n = table(spark, d, "nation")
    path = _written(spark, n, "whole", F.concat_ws("\n", "n_name", "n_name"), F.col("n_nationkey"))
    return readers.whole_texts(spark, f"{path}/*/*.txt").select(_case().alias("case_id"), F.md5("text").alias("text"))


@query("SELECT n_nationkey::VARCHAR AS case_id, 3 AS lines, 0 AS missing FROM nation")
def read_line_counts(spark, d):
    n = table(spark, d, "nation")
    path = _written(spark, n, "counts", F.concat("n_name", F.lit("\n\n"), "n_name"), F.col("n_nationkey"))
    none = readers.case_metadata(spark, f"{path}/none/*.txt", missing_ok=True).agg(F.count("*")).scalar()
    return readers.line_counts(spark, f"{path}/*/*.txt").select(_case().alias("case_id"), "lines", none.alias("missing"))


_VERSIONS = "SELECT n_regionkey::VARCHAR AS case_id, 'c' || n_nationkey AS commit_id, n_name[1] || '.' || n_nationkey AS version, n_nationkey AS k FROM nation"


def _version_files(spark, d):
    n = table(spark, d, "nation")
    line = F.format_string("c%d  %s.%d", F.col("n_nationkey"), F.substring("n_name", 1, 1), F.col("n_nationkey"))
    lines = n.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("t")))), lambda x: x["t"]), "\n\n").alias("t"))
    return f"{_written(spark, lines, 'versions', F.col('t'), F.col('n_regionkey'))}/*/*.txt"


@query(f"SELECT case_id, commit_id, version FROM ({_VERSIONS})")
def read_version_map(spark, d):
    return readers.version_map(spark, _version_files(spark, d)).select(_case().alias("case_id"), "commit_id", "version")


@query(f"SELECT case_id, max_by(commit_id, k) AS commit_id, max_by(version, k) AS version FROM ({_VERSIONS}) GROUP BY 1")
def read_oldest_version(spark, d):
    return readers.oldest(readers.version_map(spark, _version_files(spark, d))).select(_case().alias("case_id"), "commit_id", "version")


@query("SELECT r_regionkey::VARCHAR AS case_id, r_name AS version FROM region")
def read_one_token(spark, d):
    path = _written(spark, table(spark, d, "region"), "token", F.concat(F.lit(" "), "r_name", F.lit(" ")), F.col("r_regionkey"))
    return readers.one_token(spark, f"{path}/*/*.txt").select(_case().alias("case_id"), "version")


@query("SELECT n_regionkey::VARCHAR AS case_id, 'c' || (n_nationkey % 2) AS commit_id, '0' AS chunk_idx, max_by(n_nationkey || ',' || (n_nationkey + 1), n_nationkey) AS lines FROM nation GROUP BY 1, 2")
def read_locations(spark, d):
    n = table(spark, d, "nation")
    line = F.format_string("c%d##[%d, %d]##0", F.col("n_nationkey") % 2, F.col("n_nationkey"), F.col("n_nationkey") + 1)
    lines = n.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("t")))), lambda x: x["t"]), "\n").alias("t"))
    path = _written(spark, lines, "locations", F.col("t"), F.col("n_regionkey"))
    found = readers.locations(spark, f"{path}/*/*.txt")
    return found.select(_case().alias("case_id"), "commit_id", "chunk_idx", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


@query("SELECT 'p' || p_partkey AS pkg, 't' || (p_size % 4) AS type FROM part")
def read_porting_types(spark, d):
    return readers.porting_types(spark, _written(spark, table(spark, d, "part"), "types", F.format_string("p%d,t%d", F.col("p_partkey"), F.col("p_size") % 4)))


@query("SELECT 'p' || n_nationkey AS pkg, 'cwe' || n_regionkey AS cwe, n_name AS status FROM nation")
def read_paired_results(spark, d):
    n = table(spark, d, "nation").coalesce(1)
    path = _written(spark, n, "paired", F.format_string("/x/cwe%d/p%d\n\n%s", "n_regionkey", "n_nationkey", "n_name"))
    return readers.paired_results(spark, f"{path}/*.txt")


@query("SELECT 'p' || p_partkey AS pkg, 'False#' || (p_size % 2) AS status FROM part")
def read_single_results(spark, d):
    return readers.single_results(spark, _written(spark, table(spark, d, "part"), "single", F.format_string("/x/p%d False#%d", F.col("p_partkey"), F.col("p_size") % 2)))


@query("SELECT 'CVE-' || o_custkey AS cve, string_agg('u' || o_orderkey, ',' ORDER BY o_orderkey) AS urls FROM orders GROUP BY 1")
def read_ragged_links(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    line = F.concat(F.lit("CVE-"), F.col("o_custkey").cast("string"), F.lit(","), F.array_join(F.transform("k", lambda k: F.concat(F.lit("u"), k.cast("string"))), ", "), F.lit(","))
    return readers.ragged_links(spark, _written(spark, o, "ragged", line)).select("cve", F.array_join("urls", ",").alias("urls"))


@query("SELECT 'CVE-' || p_partkey AS cve, 'u' || p_size AS patch FROM part")
def read_spaced_pairs(spark, d):
    return readers.spaced_pairs(spark, _written(spark, table(spark, d, "part"), "pairs", F.format_string("CVE-%d u%d", "p_partkey", "p_size")))


@query("SELECT 'CVE-' || n_nationkey AS cve, n_name AS repo, n_regionkey::VARCHAR AS owner FROM nation")
def read_keyed_object(spark, d):
    n = table(spark, d, "nation")
    one = n.agg(F.map_from_entries(F.collect_list(F.struct(F.format_string("CVE-%d", "n_nationkey").alias("k"), F.struct(F.col("n_name").alias("repo"), F.col("n_regionkey").cast("string").alias("owner")).alias("v")))).alias("m"))
    path = _written(spark, one, "object", F.to_json("m"))
    return readers.keyed_object(spark, f"{path}/*.txt").select("cve", "repo", "owner")


@query("SELECT p_partkey, p_size FROM part UNION ALL SELECT p_partkey, p_size FROM part WHERE p_size > 25")
def append_then_read_results(spark, d):
    path, p = _folder(spark, "results"), table(spark, d, "part").select("p_partkey", "p_size")
    missing = readers.results(spark, f"{path}/none", "p_partkey long, p_size long")
    sinks.append_rows(p, path)
    sinks.append_rows(p.where("p_size > 25"), path)
    return readers.results(spark, path, f"p_partkey long, p_size {p.schema['p_size'].dataType.simpleString()}", lines=True).unionByName(missing.withColumn("p_size", F.col("p_size").cast(p.schema["p_size"].dataType)))


@query("SELECT p_size % 2 = 0 AS flag, '/x/' || p_partkey AS path FROM part")
def read_flagged_paths(spark, d):
    line = F.concat(F.when(F.col("p_size") % 2 == 0, "(True, '/x/").otherwise("(False, '/x/"), F.col("p_partkey").cast("string"), F.lit("')"))
    return readers.flagged_paths(spark, _written(spark, table(spark, d, "part"), "flags", line))


@query("SELECT p_size::BIGINT AS n FROM part WHERE p_partkey % 5 <> 0")
def read_numbers(spark, d):
    return readers.numbers(spark, _written(spark, table(spark, d, "part"), "numbers", F.when(F.col("p_partkey") % 5 == 0, "no number").otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string")))))


@query("SELECT r_regionkey::VARCHAR AS case_id, (length(r_name) + 1)::BIGINT AS size FROM region")
def read_listing(spark, d):
    path = _written(spark, table(spark, d, "region"), "listing", F.col("r_name"), F.col("r_regionkey"))
    return readers.listing(spark, f"{path}/*/*.txt").select(F.regexp_extract("path", r"case=(\d+)", 1).alias("case_id"), "size")


@query("SELECT 'v' || (p_size % 3) AS version, 'm' || (p_partkey % 2) AS model, count(*) AS n, sum(p_partkey)::BIGINT AS keys FROM part GROUP BY 1, 2")
def write_prompts(spark, d):
    path = _folder(spark, "prompts")
    sinks.write_prompts(table(spark, d, "part").select(F.format_string("v%d", F.col("p_size") % 3).alias("version"), F.format_string("m%d", F.col("p_partkey") % 2).alias("model"), "p_partkey"), path)
    back = spark.read.schema("p_partkey long, version string, model string").json(path)
    return back.groupBy("version", "model").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new2' ELSE c_name END AS c_name FROM customer UNION ALL SELECT -1, 'new2'")
def upsert_by_key(spark, d):
    path, c = _folder(spark, "upsert"), table(spark, d, "customer").select("c_custkey", "c_name")
    keys = c.where("c_custkey % 3 = 0").select("c_custkey").unionByName(spark.createDataFrame([(-1,)], "c_custkey long").select(F.col("c_custkey").cast(c.schema["c_custkey"].dataType)))
    new = keys.select("c_custkey", F.explode(F.array(F.struct(F.lit("new1").alias("c_name"), F.lit(1).alias("at")), F.struct(F.lit("new2").alias("c_name"), F.lit(2).alias("at")))).alias("x")).select("c_custkey", "x.c_name", "x.at")
    sinks.upsert(c, new, ["c_custkey"], path, ["at"])
    return spark.read.parquet(path).select("c_custkey", "c_name")


@query("SELECT r_name AS value FROM region UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation")
def append_and_concatenate(spark, d):
    a, b, out = (_folder(spark, n) for n in ("lines", "more", "all"))
    sinks.append_text(table(spark, d, "region"), a, "r_name")
    sinks.append_text(table(spark, d, "region"), a, "r_name")
    sinks.append_text(table(spark, d, "nation"), b, "n_name")
    sinks.concatenated(spark, [a, b], out)
    return spark.read.text(out)


@query("SELECT r_regionkey::VARCHAR AS case_id, r_name || chr(10) AS content FROM region WHERE r_regionkey IN (1, 2)")
def copy_matching_files(spark, d):
    path, out = _written(spark, table(spark, d, "region"), "tree", F.col("r_name"), F.col("r_regionkey")), _folder(spark, "copies")
    sinks.copy_matching(spark, f"{path}/case={{1,2}}", out, r"\.txt$")
    return spark.read.parquet(out).select(F.regexp_extract("path", r"case=(\d+)", 1).alias("case_id"), F.col("content").cast("string").alias("content"))


@query("SELECT c_custkey, 'c' || c_nationkey AS commit_id FROM customer")
def commit_list_cache(spark, d):
    path = _folder(spark, "commits")
    made = lambda: table(spark, d, "customer").select("c_custkey", F.format_string("c%d", "c_nationkey").alias("commit_id"))
    readers.read_through(spark, path, made)
    return readers.read_through(spark, path, lambda: made().limit(0))


@query("SELECT p_partkey, p_size % 3 AS hunk, 'before ' || p_partkey AS target_before FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, p_size % 3, NULL FROM part WHERE p_partkey % 2 = 1")
def hunk_content_lookup(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 3).alias("hunk"))
    known = p.where("p_partkey % 2 = 0").select(F.format_string("p%d#mystique-%d", "p_partkey", "hunk").alias("id"), F.format_string("before %d", "p_partkey").alias("target_before"))
    asked = p.withColumn("case_id", F.format_string("p%d", "p_partkey"))
    return readers.hunk_contents(asked, known, "case_id", "hunk", ["target_before"]).select("p_partkey", "hunk", "target_before")
