"""N-gram Jaccard join by token-group matrix: exact links between documents whose shingle sets are similar.

1. One Python pass turns each text into its set of shingle hashes (64 bits; sets are told apart by 128). Hashes in a fixed share
   of their range are counted over all documents: a set with more tokens of its own than similar sets can differ in has no
   partner and leaves.
2. Equal sets are one node. Of the nodes that remain, tokens are counted and ordered rarest first; a node's prefix is
   so long that two similar nodes have a common token in their prefixes. Tokens of one node alone need no row.
3. Groups: each node is compared with one leader, the node with fewest tokens of its own among those that share its
   prefix tokens; nodes joined by verified links are a group, so near copies are partitioned with one comparison for
   each node and not one for each pair. Links inside a group need no more search: its nodes are one component already.
4. Token-group matrix: a row for each token and group holds the union of the members' sets, with the least size of the members
   that have the token; tokens of one node alone are left out, as no other can share them. A node nominates the foreign groups that share a prefix token; the overlap of its
   whole set with a group's union bounds what any member can share with it, and only groups where that is enough for a
   similar member are opened. Their members are verified on the whole sets.
5. Components of all links, by least labels and pointer jumps.

All joins are on hashes or nodes with counts aggregated before the shuffle; the driver sees counts only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_array, bit_set, bits_for, cut, let, release, row_ids, rows_without, sent, table
from .words import Runs, Words, raw, slices

#: Counts of nodes from which a token is in a later class of the order.
CLASSES = [2, 4, 16, 64, 512]
#: A group's union of as many tokens is one array beside its queries; a larger one is joined token by token.
MOST_UNION = 4096
#: Documents without an id come after all others: from here on keys are made of the hash of their text.
NO_ID = 1 << 62


def shingles(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted hashes of the distinct runs of ``k`` words of each text; of fewer words, one of them all; of none, none."""
    words = Words([raw(t).lower() for t in texts])  # of bytes: A-Z alone
    runs = Runs(words.hashes)
    at = np.arange(max(0, len(words.hashes) - k + 1))
    every, out = runs.hashes(at, at + k), []
    for a, b in zip(words.begin, words.upto, strict=True):
        if b - a >= k:
            out.append(np.unique(every[a : b - k + 1]))
        else:
            out.append(runs.hashes(np.array([a]), np.array([b])) if b > a else np.zeros(0, np.uint64))
    return out


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64("text"), 2))


def _sampled(docs: DataFrame, k: int, share: float) -> DataFrame:
    """doc_id, key, row and row2 (see row_ids), n (size of the set), node and node2 (hashes of the set) and some (its hashes
    below ``share`` of their range) of each document."""
    below = np.uint64(min(share, 1) * (2**64 - 2**12))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        with np.errstate(over="ignore"):
            for rows in slices(batches, 4):
                sets = shingles(rows.column(4).to_pylist(), k)
                some = [s[: np.searchsorted(s, below)].view(np.int64) for s in sets]
                digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in some])]).astype(np.int32), np.concatenate(some))
                columns = [*(rows.column(i) for i in range(4)), pa.array([len(s) for s in sets], pa.int32()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "row", "row2", "n", "node", "node2", "some"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("key"), *row_ids("doc_id", "text"), F.col("text"))
    return rows.mapInArrow(run, "doc_id long, key long, row long, row2 long, n int, node long, node2 long, some array<long>")


def _screened(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, key, row, row2, n, node and maybe (false: surely without a partner) of each document.

    A set can do without (den - num) / den of its tokens at most if it has a similar one. So tokens of one document alone are
    counted, among twice that share of all hashes: where they are too many, there is no partner. Copies of a text
    have no token alone and stay, as one node.
    """
    every = cut(_sampled(docs, k, 2 * (den - num) / den))
    often = cut(every.select(F.explode("some").alias("t")).groupBy("t").agg(F.count("*").alias("df")).where("df > 1").select("t"))
    size = bits_for(many := often.count(), 16, 1 << 16)
    names = ["doc_id", "key", "row", "row2", "n", "node", "node2"]
    if many * 6 <= size:  # a wrong hit of the bit array only lets a set stay
        marked = every.select(*names, "some", bit_array(often, "t", size).scalar().alias("bits"))
        hits = let(F.col("bits"), lambda bits: F.size(F.filter("some", lambda t: bit_set(bits, t, size))))
        counted = marked.select(*names, F.size("some").alias("tried"), hits.alias("hits"))
    else:
        found = every.select("row", "row2", F.explode("some").alias("t")).join(often, "t", "left_semi").groupBy("row", "row2").agg(F.count("*").alias("hits"))
        counted = every.select(*names, F.size("some").alias("tried")).join(found, ["row", "row2"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    screened = cut(counted.select(*names, ((F.col("n") - F.col("tried") + F.col("hits")) * den >= F.col("n").cast("long") * num).alias("maybe")))
    del every, often, counted
    release(docs)
    # Sets that differ and agree in 64 bits get a number of their own.
    unlike = cut(screened.where("n > 0").groupBy("node").agg(F.min("node2").alias("a"), F.max("node2").alias("b")).where("a <> b").select("node", F.lit(True).alias("unlike")))
    if not unlike.isEmpty():
        fresh = F.when(F.col("unlike"), F.xxhash64("node", "node2")).otherwise(F.col("node")).alias("node")
        screened = cut(screened.join(unlike, "node", "left").select(*names[:5], fresh, "maybe"))
    return screened.select(*names[:6], "maybe")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """node, n, s (the set) of each row of ``docs`` (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for some in slices(batches, 1):
                sets = [x.view(np.int64) for x in shingles(some.column(1).to_pylist(), k)]
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32), np.concatenate(sets))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([len(s) for s in sets], pa.int32()), lists], ["node", "n", "s"])

    return docs.mapInArrow(run, "node long, n int, s array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets have num / den of their union in common."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("s").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("s_a", "s_b")).cast("long")
    return both.where(den * common >= num * (F.size("s_a") + F.size("s_b") - common)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """v, c for each node of ``edges`` (a, b): c is the least node that v is linked with, over any number of links."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("b")).select("v", F.least("v", "b").alias("c")))
    while True:
        near = both.join(labels, both["b"] == labels["v"]).groupBy(F.col("a").alias("v")).agg(F.min("c").alias("near"))
        lower = labels.join(near, "v").select("v", F.least("c", "near").alias("c"), F.col("c").alias("was"))
        far = lower.select(F.col("v").alias("c"), F.col("c").alias("far"))
        labels = cut(lower.join(far, "c").select("v", F.col("far").alias("c"), "was"))
        if labels.where("c <> was").isEmpty():
            return labels.select("v", "c")
        labels = labels.select("v", "c")


def _prefixes(sets: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """t, node, n, own (tokens that no other node has) and at (position) of the tokens in each node's prefix, rarest first; and the
    tokens (t) that several nodes have.

    The order is by classes of counts told by bit arrays: the same for all nodes; a wrong hit only moves a token to a later
    class everywhere. Where the arrays would be crowded, the counts themselves are joined to the tokens.
    """
    often = cut(sets.select(F.explode("s").alias("t")).groupBy("t").agg(F.count("*").alias("df")).where("df > 1"))
    counts = often.agg(*(F.count_if(F.col("df") >= c).alias(f"c{c}") for c in CLASSES)).first()
    sizes = [bits_for(counts[f"c{c}"], 16, 1 << 12) for c in CLASSES]
    if counts[f"c{CLASSES[0]}"] * 4 <= sizes[0]:
        arrays = F.array(*(bit_array(often.where(F.col("df") >= c), "t", n).scalar() for c, n in zip(CLASSES, sizes, strict=True)))

        def ordered(tokens: Column, bits: Column) -> Column:
            rank = lambda t: sum((F.when(bit_set(bits[i], t, n), 1).otherwise(0) for i, n in enumerate(sizes)), F.lit(0))
            known = F.filter(tokens, lambda t: bit_set(bits[0], t, sizes[0]))
            return F.sort_array(F.transform(known, lambda t: F.struct(rank(t).alias("rank"), t.alias("t"))))

        placed = sets.select("node", "n", "s", arrays.alias("bits")).select("node", "n", let(F.col("bits"), lambda bits: ordered(F.col("s"), bits)).alias("known"))
    else:
        known = sets.select("node", F.explode("s").alias("t")).join(often, "t").groupBy("node").agg(F.sort_array(F.collect_list(F.struct(F.col("df").alias("rank"), F.col("t")))).alias("known"))
        placed = sets.select("node", "n").join(known, "node")  # a node without a token of another has no row
    reach = F.col("n") - F.ceil(F.col("n") * num / den - F.lit(1e-9)).cast("int")  # greatest position, from 0
    own = (F.col("n") - F.size("known")).alias("own")
    listed = placed.select("node", "n", own, F.posexplode(F.slice("known", F.lit(1), F.greatest(F.lit(0), reach - own + 1))).alias("at", "x"))
    return cut(listed.select("x.t", "node", "n", "own", (F.col("at") + F.col("own")).alias("at"))), often.select("t")


def _opened(prefix: DataFrame, often: DataFrame, sets: DataFrame, groups: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of nodes of different groups (v, c; others are groups of their own) that may be similar, by the token-group matrix.

    Of two groups, nodes of the one with fewer members ask.
    """
    least_of = lambda n: F.ceil(n * num / den - F.lit(1e-9))  # noqa: E731  sizes that a similar set has at least
    needed = lambda n, m: F.ceil((n + m) * num / (num + den) - F.lit(1e-9))  # noqa: E731  tokens that similar sets of these sizes share at least
    sizes = cut(groups.groupBy("c").agg(F.count("*").alias("members")))
    member = cut(groups.select(F.col("v").alias("node"), "c").join(sent(sizes), "c"))
    grouped = prefix.join(member, "node", "left").select("t", "node", "n", (F.col("n") - F.col("at")).alias("room"), F.coalesce("c", "node").alias("c"), F.coalesce("members", F.lit(1)).alias("members"))
    mixed = grouped.groupBy("t").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("t")
    asked = cut(grouped.join(mixed, "t", "left_semi"))
    # Nominated by a prefix token: positions in prefixes still allow the overlap, and some member's size fits.
    offers = asked.groupBy("t", F.col("c").alias("g"), F.col("members").alias("g_members")).agg(F.max("room").alias("g_room"), F.min("n").alias("g_least"), F.max("n").alias("g_most"))

    def fits(least: str, most: str, other: str) -> Column:
        smallest = F.greatest(F.col(least), least_of(F.col("n")))
        overlap = needed(F.col("n"), smallest)
        return (smallest <= F.col(most)) & (F.col("n") * den >= F.col(least) * num) & (F.col("room") >= overlap) & (F.col(other) >= overlap)

    smaller = (F.col("members") < F.col("g_members")) | (F.col("members") == F.col("g_members")) & (F.col("c") > F.col("g"))
    nominated = cut(asked.join(offers, "t").where((F.col("c") != F.col("g")) & smaller & fits("g_least", "g_most", "g_room")).select("t", "node", "n", "room", "g").distinct())
    # The matrix of the nominated groups, without tokens that one node alone has, and the overlap of each query with the unions.
    wanted = cut(nominated.select("g").distinct())
    whole = sets.join(member.select("node", "c"), "node", "left").select(F.coalesce("c", "node").alias("g"), "n", "s").join(sent(wanted), "g", "left_semi")
    size = bits_for(often.count(), 16, 1 << 12)
    marked = whole.select("g", "n", "s", bit_array(often, "t", size).scalar().alias("bits"))
    shared = let(F.col("bits"), lambda bits: F.filter("s", lambda t: bit_set(bits, t, size)))
    matrix = cut(marked.select("g", "n", F.explode(shared).alias("t")).groupBy("g", "t").agg(F.min("n").alias("least")))
    unions = cut(matrix.groupBy("g").agg(F.count("*").alias("tokens"), F.min("least").alias("least")))
    small = matrix.select("g", "t").join(unions.where(F.col("tokens") <= MOST_UNION), "g").groupBy("g", "least").agg(F.collect_list("t").alias("union"))
    asking = nominated.select("node", "g").distinct().join(sets, "node").select("node", "g", "n", "s")
    enough = lambda overlap: overlap >= needed(F.col("n"), F.greatest(F.col("least"), least_of(F.col("n"))))
    opened = asking.join(small, "g").where(enough(F.size(F.array_intersect("s", "union")))).select("node", "g")
    large = unions.where(F.col("tokens") > MOST_UNION).select("g", "least")
    if not large.isEmpty():
        tokens = asking.join(large, "g").select("node", "g", "n", "least", F.explode("s").alias("t")).join(matrix.select("g", "t"), ["g", "t"])
        opened = opened.unionByName(tokens.groupBy("node", "g", "n", "least").agg(F.count("*").alias("overlap")).where(enough(F.col("overlap"))).select("node", "g"))
    ask = nominated.join(opened, ["node", "g"], "left_semi")
    others = asked.select("t", F.col("c").alias("g"), F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("room").alias("room_b"))
    return ask.join(others, ["t", "g"]).where(fits("n_b", "n_b", "room_b")).select(F.col("node").alias("a"), "b").distinct()


def similar(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, key, row, row2, n_shingles, least, least_id, component for each row of ``docs``: key is doc_id, or for a null doc_id
    a number from NO_ID on; row and row2 tell rows apart (see row_ids); least and least_id are the least key and the least
    doc_id (null if no row has one) in the row's component; component is a number of its own (null without a shingle), as
    components can have their least key in common where keys repeat.

    Two rows link if their sets of distinct shingles of ``k`` words have num / den or more of their union in common.
    Null and empty texts have no shingle and link with nothing. Repeated rows are equal sets; an empty table gives no row. Other
    columns are not read, whatever their names. Memory of a task grows with the longest text alone.
    """
    # 1. The nodes that may have a partner, each with one row's text.
    screened = _screened(docs, k, num, den)
    filled = screened.where("n > 0")
    picked = cut(filled.where("maybe").groupBy("node").agg(F.min(F.struct("row", "row2")).alias("x")).select("node", "x.row", "x.row2"))
    size = bits_for(many := picked.count(), 16, 1 << 16)
    texts = docs.select(*row_ids("doc_id", "text"), "text", bit_array(picked, "row", size).scalar().alias("bits")).where(bit_set(F.col("bits"), F.col("row"), size)).select("row", "row2", "text")
    sets = cut(_sets(texts.join(picked, ["row", "row2"]).select("node", "text"), k))
    if sets.count() > many:  # only where rows repeat in full
        sets = cut(sets.dropDuplicates(["node"]))
    release(docs)
    prefix, often = _prefixes(sets, num, den)
    release(docs)
    # 3. One leader for each node.
    order = F.struct((F.col("own") / F.col("n")).alias("share"), F.col("node").alias("node"))
    leaders = prefix.groupBy("t").agg(F.min(order).alias("leader")).select("t", "leader.share", F.col("leader.node").alias("leader"))
    votes = prefix.select("t", "node").join(leaders, "t").where("node <> leader").groupBy("node", "leader", "share").agg(F.count("*").alias("votes"))
    best = votes.groupBy("node").agg(F.max(F.struct(F.col("votes"), (-F.col("share")).alias("share"), (-F.col("leader").cast("decimal(20,0)")).alias("less"), F.col("leader"))).alias("x"))
    near = cut(_verified(best.select(F.col("node").alias("a"), F.col("x.leader").alias("b")), sets, num, den))
    groups = components(near)
    # 4. The groups that may hold a set similar to a query, by the matrix of tokens and groups.
    links = _verified(_opened(prefix, often, sets, groups, num, den), sets, num, den)
    linked = components(near.unionByName(cut(links)))
    release(docs)
    # 5. From nodes back to documents.
    own = cut(filled.groupBy("node").agg(F.min("key").alias("key"), F.min("doc_id").alias("id")))
    placed = linked.select(F.col("v").alias("node"), "c").join(own, "node")
    leasts = cut(placed.groupBy("c").agg(F.min("key").alias("least"), F.min("id").alias("least_id")))
    placed = placed.select("node", "c").join(sent(leasts), "c")
    nodes = own.join(placed, "node", "left").select("node", F.coalesce("c", "node").alias("c"), F.coalesce("least", "key").alias("least"), F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("least_id")).alias("least_id"), F.lit(True).alias("full"))
    found = screened.select("doc_id", "key", "row", "row2", "n", F.when(F.col("n") > 0, F.col("node")).otherwise(F.col("row")).alias("node"), (F.col("n") > 0).alias("full"))
    out = found.join(nodes, ["node", "full"], "left")
    return out.select("doc_id", "key", "row", "row2", F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "key").alias("least"), F.when(F.col("n") > 0, F.col("least_id")).otherwise(F.col("doc_id")).alias("least_id"), F.col("c").alias("component"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` (all columns as they are) without near duplicates: of each component the row of the lowest doc_id.

    Rows without a doc_id come last. Of rows repeated in full (doc_id and text) one stays; of rows with one doc_id but different
    texts in one component, those of the least text hash. Rows without a word all stay; an empty table stays empty.
    """
    found = cut(similar(docs, k, num, den).where("n_shingles > 0").select("key", "row", "row2", "least", "component"))
    firsts = found.where("key = least").groupBy("component").agg(F.min(F.struct("row", "row2")).alias("first"))
    gone = found.join(firsts, "component").where(F.struct("row", "row2") != F.col("first")).select("row", "row2").distinct()
    again = cut(found.groupBy("row", "row2").agg(F.count("*").alias("rows")).where("rows > 1").select("row", "row2"))
    ids = row_ids("doc_id", "text")
    if again.isEmpty():
        return rows_without(docs, cut(gone), ids)
    # Rows repeated in full leave the others, and one of each comes back, unless it goes.
    others = rows_without(docs, cut(gone.unionByName(again).distinct()), ids)
    once = docs.select(F.struct("*").alias("all"), *ids).join(again.join(gone, ["row", "row2"], "left_anti"), ["row", "row2"], "left_semi")
    return others.unionByName(once.dropDuplicates(["row", "row2"]).select("all.*"))


def op1_token_group_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"), k=3, num=90, den=100).select("doc_id", "n_shingles", F.col("least_id").alias("component_id"))
