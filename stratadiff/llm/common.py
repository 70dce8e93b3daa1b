"""Helpers that the training-data operators share: text to words, in-row bindings, bit arrays, lineage cuts, rows told apart."""

from __future__ import annotations

import gc
import os
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: What separates words: white space of ASCII, or all of ASCII but digits and lower-case letters.
SPACES = r"[\x20\x09-\x0D]+"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder of spark.checkpoint.dir; later jobs read them instead of the plan."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only on one machine, where the session names none, a temporary one; a cluster without one fails."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named or os.path.join(tempfile.gettempdir(), "stratadiff-checkpoints")


def release(df: DataFrame) -> None:
    """Lets Spark drop the files of shuffles and checkpoints that nothing refers to any more: its cleaner acts when the driver
    collects garbage, and Python's references go first."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, nothing else changed. Texts of ASCII alone take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column, separators: str = SPACES) -> Column:
    """The words of a text in order; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once a row, however often the body uses it (also inside lambdas)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def bit_array(hashes: DataFrame, column: str, bits: int) -> DataFrame:
    """One row with ``bits``: array<bigint> of ``bits`` / 64 words in which each hash's bit (hash mod bits) is set.

    The last task holds ``bits`` / 64 rows, whatever the number of hashes.
    """
    at = F.pmod(F.col(column), F.lit(bits))
    words = hashes.select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("bit"))
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bit"))
    every = hashes.sparkSession.range(0, bits // 64, 1, 1).withColumnRenamed("id", "word")
    filled = words.unionByName(every.select("word", F.lit(0).cast("long").alias("bit"))).groupBy("word").agg(F.bit_or("bit").alias("bit"))
    return filled.agg(F.array_sort(F.collect_list(F.struct("word", "bit"))).alias("pairs")).select(F.transform("pairs", lambda p: p["bit"]).alias("bits"))


def bit_set(bits: Column, value: Column, size: int) -> Column:
    at = F.pmod(value, F.lit(size))
    return F.call_function("shiftright", F.element_at(bits, (F.shiftright(at, 6) + 1).cast("int")), (at % 64).cast("int")).bitwiseAND(1) == 1


def bits_for(keys: int, each: int, least: int = 1 << 12, most: int = 1 << 26) -> int:
    """A power of two of at least ``each`` bits a key, between bounds: what a task is sent never exceeds most / 8 bytes."""
    size = least
    while size < each * keys and size < most:
        size *= 2
    return size


#: The most rows of some 300 bytes that a join sends to all tasks: 6 MB.
MOST_SENT = 20_000


def sent(few: DataFrame) -> DataFrame:
    """``few``, cut or cheap to count, marked for broadcast if it has ``MOST_SENT`` rows at most; else Spark chooses the join."""
    return F.broadcast(few) if few.count() <= MOST_SENT else few


def row_ids(*names: str) -> list[Column]:
    """row and row2: two hashes of the named columns, 128 bits together, that tell rows apart."""
    return [F.xxhash64(*names).alias("row"), F.xxhash64(F.lit(1), *names).alias("row2")]


def rows_without(docs: DataFrame, gone: DataFrame, ids: list[Column]) -> DataFrame:
    """The rows of ``docs`` (all columns as they are) whose ``ids`` (row and row2) are not in ``gone`` (row, row2).

    A bit array of bounded size tells most rows that stay, and these are not shuffled; a join decides on the others.
    """
    size = bits_for(gone.count(), 16, 1 << 16)
    rows = docs.select(F.struct("*").alias("all"), *ids, bit_array(gone, "row", size).scalar().alias("bits"))
    maybe = bit_set(F.col("bits"), F.col("row"), size)
    tried = rows.where(maybe).select("all", "row", "row2").join(gone, ["row", "row2"], "left_anti")
    return rows.where(~maybe).select("all.*").unionByName(tried.select("all.*"))
