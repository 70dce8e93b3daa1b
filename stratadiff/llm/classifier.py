"""Quality classifier by Bradley-Terry pairwise ranking.

Texts become vectors of bounded size: shares of kinds of characters, lines and repeated words, and hashed parts of
words. From a bounded sample of labelled rows, preference pairs (a good text over a bad one) are drawn, and a weight
vector is learned by logistic loss on feature differences. A document's rank is its weighted sum; the threshold is the
quantile of ranks at the labelled share of bad rows, and the score is the logistic function of the distance from it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The most labelled rows that are fitted, those with the least hashes of doc_id.
MOST_ROWS = 8_000
HASHED, PAIRS, STEPS, DECAY = 256, 20_000, 250, 1e-3
_KINDS = np.zeros((256, 8), np.float32)
for _b in range(256):
    _c = chr(_b)
    _k = 0 if _b >= 0x80 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _b <= 32 else 5 if _c in "#*$%&|<>~^=+@\\_{}[]" else 6 if _c in "!?" else 7
    _KINDS[_b, _k] = 1


def features(text: str | None) -> np.ndarray:
    """The vector of a text: 24 shares and logarithms, and signed shares of hashed words."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.float32) @ _KINDS
    words = raw.split()
    lines = raw.split(b"\n")
    n, m, k = max(1, len(words)), max(1, len(lines)), max(1, len(raw))
    distinct = len(set(words))
    twice = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lengths = np.fromiter(map(len, words), np.float32, len(words)) if words else np.zeros(1, np.float32)
    out = np.zeros(24 + HASHED, np.float32)
    out[:8] = counts / k
    out[8:16] = np.log1p(100 * counts / n) / 5
    out[16] = math.log1p(len(words)) / 10
    out[17] = distinct / n
    out[18] = twice / n
    out[19] = (m - len(set(lines))) / m
    out[20] = float(lengths.mean()) / 10
    out[21] = float(lengths.std()) / 10
    out[22] = raw.count(b" | ") / n
    out[23] = raw.count(b"!!") / n
    for w in words:
        h = zlib.crc32(w)
        out[24 + h % HASHED] += 1 if h & 0x10000 else -1
    out[24:] *= 1 / n
    return out


def learn(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """Weights, means, deviations, threshold and scale, from vectors and labels 0 and 1; alike at each run.

    With labels of one kind alone there is no pair: weights are 0, and every score is 0.5 or above (only 1) or below (only 0).
    """
    means, spread = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(24 + HASHED, np.float32), np.ones(24 + HASHED, np.float32))
    z = np.clip((x - means) / spread, -8, 8)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    weights = np.zeros(x.shape[1] if len(x) else 24 + HASHED, np.float64)
    if not len(good) or not len(bad):
        return weights, means, spread, 0.0 if len(good) or not len(y) else 1.0, 1.0
    pick = np.random.default_rng(7)
    d = z[pick.choice(good, pairs)] - z[pick.choice(bad, pairs)]
    speed, step = np.zeros_like(weights), 0.5
    for _ in range(steps):  # P(good over bad) = 1 / (1 + exp(-w d))
        p = 1 / (1 + np.exp(np.clip(d @ weights, -30, 30)))
        slope = -(p @ d) / pairs + DECAY * weights
        speed = 0.9 * speed - step * 0.1 * slope
        weights = weights + speed
    ranks = z @ weights
    # The quantile at the share of bad rows: the middle between the ranks on its two sides.
    ordered, at = np.sort(ranks), len(bad)
    threshold = float((ordered[at - 1] + ordered[at]) / 2)
    return weights, means, spread, threshold, float(max(np.abs(ranks - threshold).mean(), 1e-6))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> tuple:
    """Learns from labelled rows whose crc32 of doc_id (as text) mod 3 is not 1, at most ``most_rows``, least hashes first.

    Null labels, null doc_ids and labels but 0 and 1 are left out; of two labels of a document the greater counts. Vectors are computed where the rows are; the driver gets most_rows of them.
    """
    known = labels.select(F.col("doc_id"), F.col("quality")).where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(most_rows)
    rows = docs.select("doc_id", "text").join(known, "doc_id").select(F.xxhash64("doc_id", "text").alias("h"), "quality", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([features(t).tobytes() for t in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), values], ["h", "quality", "x"])

    got = sorted(rows.mapInArrow(vectors, "h long, quality int, x binary").dropDuplicates().collect())
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in got]) if got else np.zeros((0, 24 + HASHED), np.float32)
    return learn(x, np.array([r["quality"] for r in got]))


def held_out(doc_id) -> object:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score(docs: DataFrame, model: tuple) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``. A null text is an empty one; a null doc_id is not held out.

    Only the text enters a score; equal texts score alike, and other columns may have any names. Repeated rows each have a row; a score
    at the threshold, 0.5, counts as 1; an empty table gives no row. Texts are read whole: memory grows with the longest alone.
    """
    weights, means, spread, threshold, scale = model
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                x = np.stack([features(t) for t in some.column(2).to_pylist()])
                z = np.clip((x - means) / spread, -8, 8)
                ranks = (z * weights).sum(1)  # row by row: a product of matrices may round equal rows differently
                value = np.round(1 / (1 + np.exp(-np.clip((ranks - threshold) * 2 / scale, -30, 30))), 12)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(value, pa.float64()), pa.array((value >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text"))
    return rows.mapInArrow(scored, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op10_pairwise_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
