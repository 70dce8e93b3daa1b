"""Sharding by balanced label propagation (DataFrame functions only).

Documents with equal texts are linked. Linked documents start in shards by hash, as cells: the documents of one text
that fall into one of ``BLOCKS`` blocks of ids, so a text that a third of all rows have is ``BLOCKS`` cells and no
task gathers it. In each round, a join of cells with the weights of their text in each shard tells every cell the shard
where it would have most neighbours; it moves there if that cuts fewer links, as far as the shard's quota allows (moves
go down in even rounds and up in odd ones, so two cells don't swap for ever). A text that a quota has left in several shards then
moves as a whole to one with room for it. Documents without a link fill what is left.

Law ``rows``: counts differ by one at most. Places in a shard are numbered in two steps, over counts of small
buckets and within a bucket, and what is beyond a quota goes to the free places in order.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import text_crc32, cut, table

SHARDS, ROUNDS, BLOCKS, BUCKETS = 16, 6, 64, 256


def _pick(shard: Column, values: list[int]) -> Column:
    """values[shard], for as many numbers as there are shards."""
    return F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), shard + 1)


def _per_shard(rows: DataFrame, shards: int, value: Column) -> list[int]:
    got = {r[0]: int(r[1]) for r in rows.groupBy("shard").agg(value.alias("n")).collect()}  # one number a shard
    return [got.get(s, 0) for s in range(shards)]


def propagate(cells: DataFrame, quotas: list[int], rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (g, crc, block, weight, shard) with shards after ``rounds`` rounds; no shard takes more than its quota."""
    shards = len(quotas)
    for turn in range(rounds):
        load = _per_shard(cells, shards, F.sum("weight"))
        slack = [max(0, q - n) for q, n in zip(quotas, load, strict=True)]
        there = cells.groupBy("g", "crc", F.col("shard").alias("target")).agg(F.sum("weight").alias("there"))
        tried = cells.join(there, ["g", "crc"])
        own = there.select("g", "crc", F.col("target").alias("shard"), F.col("there").alias("here"))
        tried = tried.join(own, ["g", "crc", "shard"]).withColumn("gain", F.col("there") - F.col("here") + F.col("weight"))
        allowed = (F.col("target") < F.col("shard")) if turn % 2 == 0 else (F.col("target") > F.col("shard"))
        tried = tried.where(allowed & (F.col("gain") > 0) & (_pick(F.col("target"), slack) >= F.col("weight")))
        best = tried.groupBy("g", "crc", "block", "weight").agg(F.max(F.struct("gain", (-F.col("target")).alias("to"))).alias("x"))
        best = cut(best.select("g", "crc", "block", "weight", (-F.col("x.to")).alias("to"), F.pmod(F.xxhash64("g", "block", F.lit(turn)), F.lit(BUCKETS)).alias("bucket")))
        run = best.groupBy("to", "bucket").agg(F.sum("weight").alias("n")).withColumn("upto", F.sum("n").over(W.partitionBy("to").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)))
        fits = run.where(F.col("upto") <= _pick(F.col("to"), slack)).select("to", "bucket")
        moves = best.join(fits, ["to", "bucket"], "left_semi").select("g", "crc", "block", "to")
        cells = cut(cells.join(moves, ["g", "crc", "block"], "left").select("g", "crc", "block", "weight", F.coalesce("to", "shard").alias("shard")))
        if best.isEmpty() and turn % 2:
            break
    for turn in range(rounds):
        before = cells
        cells = _gathered(cells, quotas, turn)
        if cells is before:
            break
    return cells


def _gathered(cells: DataFrame, quotas: list[int], turn: int) -> DataFrame:
    """``cells`` with texts that are still in several shards moved as a whole to one with room for all of them, as far as quotas
    allow: where a quota stops single cells, the whole text may fit elsewhere. The same frame if there is nothing to move."""
    load = _per_shard(cells, len(quotas), F.sum("weight"))
    slack = [max(0, q - n) for q, n in zip(quotas, load, strict=True)]
    split = cells.groupBy("g", "crc").agg(F.sum("weight").alias("weight"), F.count_distinct("shard").alias("parts")).where("parts > 1")
    roomy = F.filter(F.array(*(F.struct(F.lit(s).alias("to"), F.lit(n).cast("long").alias("slack")) for s, n in enumerate(slack))), lambda x: x["slack"] >= F.col("weight"))
    chosen = F.get(roomy, F.pmod(F.xxhash64("g", F.lit(turn)), F.greatest(F.size(roomy), F.lit(1))).cast("int"))["to"]
    wish = cut(split.select("g", "crc", "weight", chosen.alias("to"), F.pmod(F.xxhash64("g", "crc", F.lit(turn)), F.lit(BUCKETS)).alias("bucket")).where("to IS NOT NULL"))
    run = wish.groupBy("to", "bucket").agg(F.sum("weight").alias("n")).withColumn("upto", F.sum("n").over(W.partitionBy("to").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)))
    moves = cut(wish.join(run.where(F.col("upto") <= _pick(F.col("to"), slack)).select("to", "bucket"), ["to", "bucket"], "left_semi").select("g", "crc", "to"))
    if moves.isEmpty():
        return cells
    return cut(cells.join(moves, ["g", "crc"], "left").select("g", "crc", "block", "weight", F.coalesce("to", "shard").alias("shard")))


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for each row of ``docs`` (doc_id, text; other columns are not read).

    size: bytes of the text in UTF-8 plus 1; a null text is an empty one. Rows in shards differ by one at most in number;
    slots count from 0 in each shard. Ties go by doc_id, those without first; repeated rows each have a slot; an empty table gives no row. Of a text only its
    size and hashes are kept, however long it is.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(BLOCKS)).cast("int")
    base = cut(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), text_crc32(text).alias("crc"), F.xxhash64(text).alias("g"), block.alias("block")))
    rows = base.count()
    quotas = [rows // shards + (s < rows % shards) for s in range(shards)]
    start = F.pmod(F.col("block"), F.lit(shards)).cast("int")
    linked = base.groupBy("g", "crc").agg(F.count("*").alias("n")).where("n > 1").select("g", "crc")
    cells = base.groupBy("g", "crc", "block").agg(F.count("*").alias("weight")).join(linked, ["g", "crc"], "left_semi").select("*", start.alias("shard"))
    placed = propagate(cut(cells), quotas, rounds).select("g", "crc", "block", F.col("shard").alias("to"))
    # Linked documents first, then the others; in small buckets of ids.
    buckets = max(1, -(-rows // shards // 4000))
    labelled = base.join(placed, ["g", "crc", "block"], "left").select("doc_id", "size", "crc", "g", F.coalesce("to", start).alias("shard"), F.col("to").isNull().alias("free"), F.pmod(F.xxhash64("doc_id", "g", F.lit(1)), F.lit(buckets)).alias("bucket"))
    key = ["shard", "free", "bucket"]
    counts = cut(labelled.groupBy(*key).agg(F.count("*").alias("n")))
    have = _per_shard(counts, shards, F.sum("n"))
    kept = [min(a, b) for a, b in zip(have, quotas, strict=True)]
    over = [0, *accumulate(a - b for a, b in zip(have, kept, strict=True))]
    room = [0, *accumulate(a - b for a, b in zip(quotas, kept, strict=True))]
    before = counts.select(*key, (F.sum("n").over(W.partitionBy("shard").orderBy("free", "bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    ranked = labelled.select("*", F.row_number().over(W.partitionBy(*key).orderBy("doc_id", "g", "crc", "size")).alias("k")).join(before, key)
    ranked = ranked.select("doc_id", "size", "crc", "shard", (F.col("before") + F.col("k") - 1).alias("rank"))
    stays = F.col("rank") < _pick(F.col("shard"), quotas)
    spare = F.col("rank") - _pick(F.col("shard"), kept) + _pick(F.col("shard"), over[:-1])
    moved = F.lit(0)
    for s in range(shards - 1, -1, -1):
        moved = F.when((F.col("spare") >= room[s]) & (F.col("spare") < room[s + 1]), F.lit(s)).otherwise(moved)
    ranked = ranked.select("doc_id", "size", "crc", "shard", "rank", stays.alias("stays"), spare.alias("spare")).withColumn("moved", moved)
    shard_, slot = F.when(F.col("stays"), F.col("shard")).otherwise(F.col("moved")), F.when(F.col("stays"), F.col("rank")).otherwise(_pick(F.col("moved"), kept) + F.col("spare") - _pick(F.col("moved"), room[:-1]))
    return ranked.select("doc_id", "size", F.col("crc").alias("text_crc32"), shard_.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def op5_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
