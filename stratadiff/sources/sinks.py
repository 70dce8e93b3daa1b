"""Sinks: each writes through Spark's commit protocol, so parallel writers need no lock and a failed one leaves nothing half done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overwrite_text(rows: DataFrame, path: str, column: str) -> None:
    rows.select(column).write.mode("overwrite").text(path)


def append_text(rows: DataFrame, path: str, column: str) -> None:
    rows.select(column).write.mode("append").text(path)


def append_rows(rows: DataFrame, path: str, kind: str = "json") -> None:
    rows.write.mode("append").format(kind).save(path)


def write_prompts(rows: DataFrame, path: str) -> None:
    """A folder for each version and model."""
    rows.write.mode("overwrite").partitionBy("version", "model").json(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Old rows with new ones in the place of those with equal keys. Of several new rows of a key the last in ``order`` counts
    (of all columns, where none is given)."""
    both = old.withColumn("__age", F.lit(0)).unionByName(new.withColumn("__age", F.lit(1)), allowMissingColumns=True)
    names = order or sorted(c for c in both.columns if c not in (*keys, "__age"))
    last = both.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("__age"), *(F.desc(c) for c in names))))
    return last.where("__n = 1").drop("__n", "__age")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], path: str, order: list[str] | None = None) -> None:
    """``upserted`` as a new table at ``path`` (another than the old one's)."""
    upserted(old, new, keys, order).write.mode("overwrite").parquet(path)


def copy_matching(spark, source: str, target: str, names: str) -> None:
    """Files whose names match a regular expression, as a table of path and content."""
    found = spark.read.format("binaryFile").load(source).where(F.element_at(F.split("path", "/"), -1).rlike(names))
    found.select("path", "content").write.mode("overwrite").parquet(target)


def concatenated(spark, paths: list[str], target: str) -> None:
    """Text files of equal kind as one table of lines."""
    spark.read.text(paths).write.mode("overwrite").text(target)
