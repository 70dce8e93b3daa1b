"""Joins of alike texts where few bytes of a file have very many pairs."""

from pyspark.sql import functions as F

from stratadiff.operators import similarity
from stratadiff.plans import catalogue, result_queries


def test_copies_are_compared_once(spark, tmp_path):
    """Distances are of different texts, and no side is broadcast."""
    rows = spark.range(600).select(F.col("id").alias("p_partkey"), F.lit("b").alias("p_brand"), F.lit(1).alias("p_size"), F.concat(F.lit("old ring "), (F.col("id") % 2).cast("string")).alias("p_name"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    out = catalogue.levenshtein_join(spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    # What is measured is made of distinct texts: two of each side.
    assert plan.index("levenshtein") > 0 and plan.count("HashAggregate") >= 2
    assert out.count() == 600 * 599 // 2


def test_nulls_and_a_key_that_is_the_text(spark):
    rows = spark.createDataFrame([(1, None, "abcdefghij"), (2, None, "abcdefghix"), (3, "k", "abcdefghij"), (4, "k", None), (5, "k", "")], "id int, k string, t string")
    pairs = lambda keys: sorted((r.l_id, r.r_id, round(r.similarity, 6)) for r in similarity.edit_join(rows, rows, keys, "t", 0.8, F.col("l_id") <= F.col("r_id")).collect())
    assert pairs(["k"]) == [(1, 1, 1.0), (1, 2, 0.9), (2, 2, 1.0), (3, 3, 1.0), (5, 5, 1.0)]
    assert pairs(["t"]) == [(1, 1, 1.0), (1, 3, 1.0), (2, 2, 1.0), (3, 3, 1.0), (5, 5, 1.0)]


def test_likeness_of_lines_in_many_tasks(spark, tmp_path):
    """A file that one task reads is measured by several."""
    spark.range(200).select(F.col("id").alias("doc_id"), F.lit("a b\nc d").alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(200).select(F.col("id").alias("p_partkey"), F.lit("b").alias("p_brand"), F.lit(3).alias("p_size")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for query in (catalogue.seqmatch_ratio, catalogue.bleu, result_queries.ratio_forms):
        assert query(spark, str(tmp_path)).select(F.spark_partition_id()).distinct().count() > 8
