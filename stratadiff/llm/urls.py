"""URL filters by Bloom filter cascade (DataFrame functions only).

Level 1 of a cascade holds the listed keys, level 2 the unlisted keys of the corpus that level 1 lets through, level 3
the listed keys that level 2 lets through, and so on until nothing gets through. A key of the corpus is listed if the
first level that lacks it is an even one: exact for every key of the universe it was built over, and a row needs only
the bit arrays, no join. Two cascades are built: of rules among all candidate keys (host or parent domain, and path up
to a rule's path length), and of hosts that only have blocked pages among all hosts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, bit_array, bit_set, bits_for, cut, let, table

#: (verdict, rule): a rule is a host, and a path that begins with a slash.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
HASHES, EACH = 4, 12  # bits set for a key, bits of a level for a key
#: A level that would need more than this is not sent to the tasks; see ``Cascade``.
MOST_BITS = 1 << 26


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


class Cascade:
    """Exact membership in ``listed`` for every key of ``universe``. Both have a column ``key`` without nulls.

    A level takes ``EACH`` bits a key, up to ``most_bits`` (8 MB, what a task is sent at most). Beyond it the bits get
    denser and the levels more; membership stays exact, as levels are added until nothing passes. If a level no
    longer thins out what passes, the keys are too many for arrays of this size: then, and only then, ``mark`` joins on the key.
    """

    def __init__(self, listed: DataFrame, universe: DataFrame, seed: int = 0, most_bits: int = MOST_BITS):
        self.levels: list[tuple[DataFrame, int, int]] = []
        self.crowded = False
        self.listed = inside = cut(listed.select("key").distinct())
        outside = cut(universe.select("key").distinct().join(inside, "key", "left_anti"))
        n, others, depth = inside.count(), outside.count(), 0
        while n:
            size, level = bits_for(n * HASHES, EACH // HASHES, 1 << 10, most_bits), seed + depth
            positions = inside.select(F.explode(F.array(*(self._hash(F.col("key"), level, i) for i in range(HASHES)))).alias("h"))
            bits = cut(bit_array(positions, "h", size))
            self.levels.append((bits, size, level))
            passed = cut(self._with(outside, [self.levels[-1]]).where(F.col("in")[0]).select("key"))
            inside, outside, before = passed, inside, others
            n, others, depth = passed.count(), n, depth + 1
            if n > 0.9 * before and before > most_bits // EACH:
                self.crowded = True
                break

    @staticmethod
    def _hash(key: Column, level: int, i: int) -> Column:
        return F.xxhash64(key, F.lit(level * HASHES + i))

    @classmethod
    def _in(cls, key: Column, bits: Column, size: int, level: int) -> Column:
        return reduce(lambda a, b: a & b, (bit_set(bits, cls._hash(key, level, i), size) for i in range(HASHES)))

    @classmethod
    def _with(cls, rows: DataFrame, levels: list) -> DataFrame:
        names = rows.columns
        rows = rows.select("*", F.array(*(bits.scalar() for bits, _, _ in levels)).alias("bits"))
        return rows.select(*names, let(F.col("bits"), lambda b: F.array(*(cls._in(F.col("key"), b[i], size, level) for i, (_, size, level) in enumerate(levels)))).alias("in"))

    def _joined(self, rows: DataFrame, keys: str, into: str) -> DataFrame:
        """As ``mark``, by a join; rows are numbered and written first, so a task that is run again numbers them alike."""
        numbered = cut(rows.select(F.monotonically_increasing_id().alias("id"), F.struct("*").alias("row")))
        each = numbered.select("id", F.posexplode(f"row.{keys}").alias("pos", "key")).join(self.listed.withColumn("hit", F.lit(True)), "key", "left")
        marks = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("hit", F.lit(False)).alias("hit")))).alias("marks"))
        out = numbered.join(marks, "id", "left")
        return out.select("row.*", F.coalesce(F.transform("marks", lambda m: m["hit"]), F.array().cast("array<boolean>")).alias(into))

    def mark(self, rows: DataFrame, keys: str, into: str) -> DataFrame:
        """``rows`` with a column ``into``: for each key of the array column ``keys``, whether it is listed."""
        if self.crowded:
            return self._joined(rows, keys, into)
        if not self.levels:
            return rows.select("*", F.transform(F.col(keys), lambda k: F.lit(False)).alias(into))
        names = rows.columns

        def listed(key: Column, b: Column) -> Column:
            out = F.lit(len(self.levels) % 2 == 1)
            for i, (_, size, level) in reversed(list(enumerate(self.levels))):
                out = F.when(~self._in(key, b[i], size, level), F.lit(i % 2 == 1)).otherwise(out)
            return out

        rows = rows.select("*", F.array(*(bits.scalar() for bits, _, _ in self.levels)).alias("bits"))
        return rows.select(*names, let(F.col("bits"), lambda b: F.transform(F.col(keys), lambda k: listed(k, b))).alias(into))


def _candidates(host: Column, path: Column, depth: int, lengths: list[int]) -> Column:
    """Keys by which a rule could be found, the longest first: host and each parent, with each length of path."""
    parents = F.transform(F.sequence(F.lit(1), F.least(F.lit(depth), F.size(F.split(host, r"\.")))), lambda n: F.call_function("substring_index", host, F.lit("."), -n))
    keys = F.flatten(F.transform(parents, lambda h: F.filter(F.array(*(F.when(F.char_length(path) >= n, F.concat(h, F.substring(path, 1, n))) for n in lengths)), lambda x: x.isNotNull())))
    ordered = F.sort_array(F.transform(F.array_distinct(keys), lambda k: F.struct(F.char_length(k).alias("n"), F.instr(k, "/").alias("host"), k.alias("key"))), asc=False)
    return F.transform(ordered, lambda x: x["key"])


def rules_frame(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({quoted(v)}, {quoted(r)})" for v, r in rules) + " AS t(verdict, key)")


def filter_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages`` (page_id, url), under ``rules`` (verdict, key).

    The longest rule that fits decides (of equally long ones, that of the longer host). Where none fits, a page is
    blocked if rules block pages of its host and allow none, else allowed. A null url or one without "://" has an
    empty host and path, no rule, and is allowed; equal rows fare alike; an empty table stays empty.
    """
    shape = rules.agg(F.max(F.size(F.split(F.substring_index("key", "/", 1), r"\."))).alias("depth"), F.array_sort(F.collect_set(F.char_length("key") - F.instr("key", "/") + 1)).alias("lengths")).first()
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.select("*", _candidates(F.col("host"), F.col("path"), shape["depth"] or 0, shape["lengths"] or [0]).alias("keys"))
    universe = cut(rows.select(F.explode("keys").alias("key")).distinct())
    listed = rules.select("key").join(universe, "key", "left_semi")
    any_rule = Cascade(listed, universe)
    blocks = Cascade(rules.where("verdict = 'block'").select("key").join(universe, "key", "left_semi"), listed, seed=1000)

    def ruled(of: DataFrame) -> DataFrame:
        of = any_rule.mark(of, "keys", "fits")
        of = of.select("page_id", "host", "path", F.get(F.filter("keys", lambda k, i: F.get("fits", i)), 0).alias("rule"))
        of = blocks.mark(of.select("*", F.array("rule").alias("one")), "one", "blocked")
        return of.select("page_id", "host", "path", "rule", (F.col("rule").isNotNull() & F.col("blocked")[0]).alias("blocked"))

    judged = ruled(rows)
    hosts = cut(judged.groupBy(F.col("host").alias("key")).agg(F.bool_or("blocked").alias("blocked"), F.bool_or(F.col("rule").isNotNull() & ~F.col("blocked")).alias("allowed")))
    shut = Cascade(hosts.where("blocked AND NOT allowed"), hosts, seed=2000)
    out = shut.mark(judged.select("*", F.array("host").alias("own")), "own", "shut")
    verdict = F.when(F.col("blocked") | (F.col("rule").isNull() & F.col("shut")[0]), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op3_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rules_frame(spark, RULES))


ORACLE_SQL = r"""
WITH rules AS (SELECT * FROM (VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')) AS t(verdict, rule, h, p)),
parts AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
    FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id, host, path),
shut AS (SELECT host FROM ruled GROUP BY host HAVING coalesce(bool_or(verdict = 'block'), false) AND NOT coalesce(bool_or(verdict = 'allow'), false))
SELECT page_id, host, path, rule, CASE WHEN verdict IS NOT NULL THEN verdict WHEN host IN (SELECT host FROM shut) THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""
