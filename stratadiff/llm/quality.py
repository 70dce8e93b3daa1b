"""Quality rules by robust multivariate outliers (DataFrame functions only).

Base rules count words, symbols, repeated lines and repeated runs. Rows that pass them get a vector of transformed
statistics. For each language and source a minimum-covariance-determinant estimate gives centre and scatter: concentration
steps from three robust starts at once (medians and MADs; covariance of squashed values; covariance of spatial signs), of
which the one that ends with the least determinant counts. Vectors with a squared Mahalanobis distance above a
chi-squared quantile go.

A step sums counts and products for each bin of distance, on each partition first, so it reads the rows once, shuffles some
hundred bins for each group, and no task gathers a group. All sums are over whole numbers and all quantiles over counted bins,
so results do not depend on how rows are dealt out.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, let, row_ids, rows_without, sent, table, total, words_of

#: Vector: length, word length, symbols, repeated runs, repeated lines. FLOORS: the least standard deviation each may have.
NAMES = ["x_words", "x_length", "x_symbols", "x_repeats", "x_lines"]
FLOORS = [1.0, 0.1, 0.5, 1.0, 1.0]
UNIT, BIN = 1024, 64
#: Robust starts of the concentration steps, and the least share of a squared scale that the last two leave each direction.
STARTS, LEAST_SPREAD = 3, 0.05
#: The group of all rows; others begin with = or null.
EVERY = "every"
CELLS = [(i, j) for i in range(len(NAMES)) for j in range(i + 1)]


def _chi2_cdf(x: float, p: int) -> float:
    """P(chi squared of p degrees <= x), by the series of the incomplete gamma function."""
    a, h = p / 2, x / 2
    term = math.exp(a * math.log(h) - h - math.lgamma(a + 1)) if h > 0 else 0.0
    out, k = term, 1
    while term > 1e-16 or k < h:
        term *= h / (a + k)
        out, k = out + term, k + 1
    return out


def _chi2_quantile(q: float, p: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, p) < q else (low, mid)
    return high


def _repeats(words: Column, run: int = 5) -> Column:
    """How many words lie in a run of ``run`` words that the text has twice or more."""

    def places(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        same = let(ordered, lambda s: F.sort_array(F.filter(F.transform(s, lambda x, j: F.when((F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]), x["at"])), lambda x: x.isNotNull())))
        return let(same, lambda s: total(F.transform(s, lambda x, j: F.least(F.lit(run), F.coalesce(F.get(s, j + 1) - x, F.lit(run))).cast("long"))))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (run - 1)), lambda i: F.xxhash64(F.slice(words, i, run)))
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), places(h)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) > run, found).otherwise(F.lit(0).cast("long"))


def statistics(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))

    def of(words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            (F.char_length(text) - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeats(words).alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
        )

    with_words = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(words_of(text), lambda words: let(with_words, lambda lines: of(words, lines)))


def base_failed(q: Column, least_words: int = 10, most_repeats: int = 20) -> Column:
    return (q["n_words"] < least_words) | (100 * q["n_repeat_words"] > most_repeats * q["n_words"])


def _vector(q: Column) -> dict[str, Column]:
    """The transformed statistics as whole numbers of 1 / UNIT."""
    n = F.greatest(q["n_words"], F.lit(1))
    share = lambda x, of: F.log1p(100 * x / of)
    values = [F.log1p(q["n_words"].cast("double")), F.log(F.greatest(q["word_chars"], F.lit(1)) / n), share(q["n_symbols"], n), share(q["n_repeat_words"], n), share(q["n_dup_lines"], F.greatest(q["n_lines"], F.lit(1)))]
    return {name: F.round(v * UNIT).cast("long") for name, v in zip(NAMES, values, strict=True)}


def _group(lang: Column, source: Column) -> Column:
    part = lambda x: F.coalesce(F.concat(F.lit("="), x.cast("string")), F.lit("null"))
    return F.concat(part(lang), F.lit("\x00"), part(source))


def _quantile_bin(counts: DataFrame, keys: list[str], share: float, name: str) -> DataFrame:
    """For each of ``keys``, the least bin at or below which ``share`` of the rows lie. counts: keys, bin, n."""
    w = W.partitionBy(*keys)
    run = counts.withColumn("upto", F.sum("n").over(w.orderBy("bin").rowsBetween(W.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))
    return run.where(F.col("upto") >= F.ceil(F.col("all") * share)).groupBy(*keys).agg(F.min("bin").alias(name))


def _distance(params: Column) -> Column:
    """The squared distance of the vector columns, by forward substitution with the Cholesky factor in ``params``."""
    z: list[Column] = []
    for i, name in enumerate(NAMES):
        rest = F.col(name) / UNIT - params[f"m{i}"]
        for j in range(i):
            rest = rest - params[f"l{i}{j}"] * z[j]
        z.append(rest / params[f"l{i}{i}"])
    return sum((x * x for x in z[1:]), z[0] * z[0])


def _factored(centres: DataFrame, cell: Callable[[int, int], Column]) -> DataFrame:
    """g, start, params (centre m, Cholesky factor l of the scatter with ``cell`` at i, j) and the logarithm of its determinant."""
    out = centres
    for i, j in CELLS:
        rest = cell(i, j)
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-6))) if i == j else rest / F.col(f"l{j}{j}"))
    det = sum((2 * F.log(f"l{i}{i}") for i in range(1, len(NAMES))), 2 * F.log("l00"))
    return out.select("g", "start", F.struct(*(f"m{i}" for i in range(len(NAMES))), *(f"l{i}{j}" for i, j in CELLS)).alias("params"), det.alias("det"))


def _products(values: list[Column]) -> list[Column]:
    """The count, sums s and sums of products p of whole numbers."""
    return [F.count("*").alias("n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(values)), *(F.sum(values[i] * values[j]).alias(f"p{i}{j}") for i, j in CELLS)]


def _covariance(i: int, j: int, unit: int) -> Column:
    n = F.col("n").cast("double")
    return F.col(f"p{i}{j}") / (unit * unit) / n - (F.col(f"s{i}") / unit / n) * (F.col(f"s{j}") / unit / n)


def _starts(rows: DataFrame) -> DataFrame:
    """The robust starts for each group: g, start, params, det. rows: g and the vector."""
    p, step, fine = len(NAMES), UNIT // BIN, 4096
    long = rows.select("g", F.posexplode(F.array(*NAMES)).alias("i", "x"))
    mids = cut(_quantile_bin(long.groupBy("g", "i", F.floor(F.col("x") / step).alias("bin")).agg(F.count("*").alias("n")), ["g", "i"], 0.5, "mid"))
    away = long.join(sent(mids), ["g", "i"]).groupBy("g", "i", F.abs(F.floor(F.col("x") / step) - F.col("mid")).alias("bin")).agg(F.count("*").alias("n"))
    both = mids.join(_quantile_bin(away, ["g", "i"], 0.5, "mad"), ["g", "i"])
    scale = [F.sqrt((F.max(F.when(F.col("i") == i, F.col("mad"))) / BIN * 1.4826) ** 2 + FLOORS[i] ** 2).alias(f"d{i}") for i in range(p)]
    middle = cut(both.groupBy("g").agg(*(F.max(F.when(F.col("i") == i, F.col("mid") / BIN)).alias(f"m{i}") for i in range(p)), *scale))
    plain = _factored(middle.withColumn("start", F.lit(0)), lambda i, j: F.col(f"d{i}") ** 2 if i == j else F.lit(0.0))

    z = [(F.col(name) / UNIT - F.col(f"m{i}")) / F.col(f"d{i}") for i, name in enumerate(NAMES)]
    norm = F.greatest(F.sqrt(sum((x * x for x in z[1:]), z[0] * z[0])), F.lit(1e-9))
    whole = lambda x: F.round(x * fine).cast("long")
    placed = rows.join(sent(middle), "g")
    out = plain
    for start, values in ((1, [F.tanh(x) for x in z]), (2, [x / norm for x in z])):
        named = placed.select("g", *(whole(x).alias(f"y{i}") for i, x in enumerate(values)))
        sums = named.groupBy("g").agg(*_products([F.col(f"y{i}") for i in range(p)])).join(middle, "g").withColumn("start", F.lit(start))
        cell = lambda i, j: F.col(f"d{i}") * F.col(f"d{j}") * (_covariance(i, j, fine) + (LEAST_SPREAD if i == j else 0.0))
        out = out.unionByName(_factored(sums, cell))
    return out


def _concentrated(rows: DataFrame, params: DataFrame, share: float) -> DataFrame:
    """``params`` after one step: from the ``share`` of each group's rows that are nearest (whole bins of distance, ties included)."""
    near = rows.join(sent(params.select("g", "start", "params")), "g").select("g", "start", *NAMES, F.floor(F.log1p(_distance(F.col("params"))) * BIN).alias("bin"))
    bins = near.groupBy("g", "start", "bin").agg(*_products([F.col(x) for x in NAMES]))
    w = W.partitionBy("g", "start")
    before = F.sum("n").over(w.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    kept = bins.select("*", before.alias("before"), F.sum("n").over(w).alias("all")).where(F.col("before") < F.ceil(F.col("all") * share))
    sums = kept.groupBy("g", "start").agg(*(F.sum(c).alias(c) for c in ["n", *(f"s{i}" for i in range(len(NAMES))), *(f"p{i}{j}" for i, j in CELLS)]))
    centres = sums.select("*", *((F.col(f"s{i}") / UNIT / F.col("n")).alias(f"m{i}") for i in range(len(NAMES))))
    return _factored(centres, lambda i, j: F.greatest(_covariance(i, j, UNIT), F.lit(0.0)) + FLOORS[i] ** 2 if i == j else _covariance(i, j, UNIT))


def fit(stats: DataFrame, share: float = 0.75, steps: int = 5, least_rows: int = 50) -> DataFrame:
    """Centre and scatter for each language and source: lang, source, params. stats: lang, source, q (see statistics).

    Groups are a language and source; null is a value of its own. Sources with fewer than ``least_rows`` rows that pass
    the base rules are taken together within their language; where these are still fewer, the estimate is that of the whole
    table. ``share`` of a group's rows enter each of ``steps`` concentration steps, from each of ``STARTS`` starts;
    the least determinant wins, the lower start where they tie. Squared ``FLOORS`` are added to each variance, so that
    a statistic that is the same in all rows has a scale. Without a row that passes the base rules there is no estimate.
    """
    passed = stats.where(~base_failed(F.col("q")))
    sizes = passed.groupBy("lang", "source").agg(F.count("*").alias("n"))
    large, rest = F.col("n") >= least_rows, F.concat(_group(F.col("lang"), F.lit(None)), F.lit("\x00rest"))
    own = sizes.select("lang", "source", "n", F.when(large, _group(F.col("lang"), F.col("source"))).otherwise(rest).alias("g"))
    own = own.withColumn("all", F.sum("n").over(W.partitionBy("g")))
    own = cut(own.select("lang", "source", F.when(F.col("all") >= least_rows, F.col("g")).otherwise(F.lit(EVERY)).alias("g")))
    same = F.col("p.lang").eqNullSafe(F.col("o.lang")) & F.col("p.source").eqNullSafe(F.col("o.source"))
    rows = passed.alias("p").join(sent(own).alias("o"), same)
    rows = cut(rows.select("g", *(v.alias(k) for k, v in _vector(F.col("p.q")).items())))
    if not own.where(F.col("g") == EVERY).isEmpty():
        rows = rows.where(F.col("g") != EVERY).unionByName(rows.select(F.lit(EVERY).alias("g"), *NAMES))
    params = cut(_starts(rows))
    for _ in range(steps):
        params = cut(_concentrated(rows, params, share))
    best = params.groupBy("g").agg(F.min(F.struct("det", "start", "params")).alias("x")).select("g", "x.params")
    return cut(own.join(best, "g").select("lang", "source", "params"))


def judge(stats: DataFrame, params: DataFrame, share: float = 0.75, quantile: float = 0.99999) -> DataFrame:
    """``stats`` with base_failed and kept. A row that passes the base rules goes if its squared distance, with the scatter
    made consistent for ``share``, is above the chi-squared ``quantile``."""
    p = len(NAMES)
    consistent = share / _chi2_cdf(_chi2_quantile(share, p), p + 2)
    limit = _chi2_quantile(quantile, p) * consistent
    same = F.col("s.lang").eqNullSafe(F.col("o.lang")) & F.col("s.source").eqNullSafe(F.col("o.source"))
    joined = stats.alias("s").join(sent(params).alias("o"), same, "left")
    joined = joined.select("s.*", "o.params", *(v.alias(k) for k, v in _vector(F.col("s.q")).items()))
    failed = base_failed(F.col("q"))
    far = F.coalesce(_distance(F.col("params")) > limit, F.lit(False))
    return joined.select(*stats.columns, failed.alias("base_failed"), (~failed & ~far).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns as they are) that pass the base rules and are no outliers of their group.

    Null and empty texts fail the base rules; an empty table stays empty; equal rows fare alike. A text's statistics are computed
    once, and memory grows with the longest text alone.
    """
    ids = row_ids("doc_id", "text", "lang", "source")
    stats = cut(docs.select(*ids, "lang", "source", statistics(F.col("text")).alias("q")))
    gone = cut(judge(stats, fit(stats)).where("NOT kept").select("row", "row2").distinct())
    return rows_without(docs, gone, ids)


def op4_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stats = cut(docs.select("doc_id", "lang", "source", statistics(F.col("text")).alias("q")))
    return judge(stats, fit(stats)).select("doc_id", *(f"q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "kept")
