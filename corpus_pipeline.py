"""From raw documents to packed training sequences, in five stages.

Each stage gets what its predecessor kept, as a table with the columns of ``documents`` (others may be there, of any names), and
writes what it keeps; texts of any length are worked on whole:
1. quality rules and robust outliers: rejected documents go;
2. near duplicates (shingles of five words, similarity 0.8): of each group the document of the lowest id stays;
3. repeated spans of sentences: all places but the first lose them, and documents with nothing left go;
4. decontamination: documents that share ten consecutive words with a benchmark item go;
5. packing into sequences of 4096 tokens.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratadiff.llm import decontaminate, jaccard, packing, quality, spans
from stratadiff.llm.common import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules and are no outliers of their language and source. Null, empty and very short texts go;
    equal rows fare alike; an empty table stays empty."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the lowest id (those without one last), and one of rows repeated in full. Texts
    without a word all stay; an empty table stays empty."""
    return jaccard.one_of_each(docs)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated spans; n_chars follows the text. Documents with nothing left go; null and empty texts stay."""
    done = spans.remove_repeats(docs).where("left.n_removed = 0 OR left.n_removed < left.n_sentences")
    changed = F.col("left.n_removed") > 0
    new = {
        "text": F.when(changed, F.col("left.text")).otherwise(F.col("row.text")),
        "n_chars": F.when(changed, F.char_length("left.text").cast("long")).otherwise(F.col("row.n_chars")),
    }
    return done.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten consecutive words with a benchmark item. Null and empty texts stay; an empty benchmark drops none."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens; a null or empty text is the end token alone."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_spans", repeated_spans),
    ("decontamination", decontamination),
    ("packing", packed_sequences),
]

#: Robust estimates, similarity groups and a tokenizer are beyond SQL: tests/llm compares the stages with brute force.
ORACLE_SQL = None


def _at(spark: SparkSession, path: str):
    """Hadoop's path and file system, which reach every folder that Spark's readers do."""
    context = spark.sparkContext
    found = context._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(context._jsc.hadoopConfiguration())


def run(spark: SparkSession, sf_dir: str, home: str | None = None) -> DataFrame:
    """The packed pieces. Each stage is written and read again below ``home``, in the shared folder of spark.checkpoint.dir if None.

    With a ``home`` of the caller's, stages that an earlier run has finished there are not repeated, and all stay; else a stage's
    folder is removed once the next one is written, and only the last is left.
    """
    own = home is None
    home = home or f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        folder = f"{home}/{i}-{name}"
        done, files = _at(spark, f"{folder}/_SUCCESS")
        if not files.exists(done):
            out = stage(spark, docs, sf_dir)
            out.write.mode("overwrite").parquet(folder)
        docs = spark.read.parquet(folder)
        if own and before:
            path, files = _at(spark, before)
            files.delete(path, True)
        before = folder
    return docs
