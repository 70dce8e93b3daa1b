"""Registered queries and whole results against brute force: packing, outliers, notices, links, shards, the SQL texts, the pipeline."""

import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratadiff.llm import chat, decontaminate, licenses, packing, quality, queries, shards, urls

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and edan thing reand onst that whou erion ésté schön ia lo".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 40)) + ("." if i % 8 == 7 else "") for i in range(n))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("pages", "conversations", "documents", "benchmark"):
        db.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    r = db.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in r.description]
    got = queries.QUERIES[name](spark, FOLDER).select(*sorted(names))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((tuple(x[names.index(c)] for c in sorted(names)) for x in r.fetchall()), key=repr)


# --- 1 --------------------------------------------------------------------------------------------------------------------
def test_links_of_the_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    sets = {}
    for r in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * (both := len(sets[a] & sets[b])) >= 90 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    got = queries.QUERIES["op1_token_group_matrix"](spark, FOLDER).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(d, len(s), find(d)) for d, s in sets.items()} and len(got) == len(rows)


def test_large_and_missing_ids(spark):
    from stratadiff.llm import jaccard

    big = (1 << 62) + 5
    docs = spark.createDataFrame([(big, prose(1, 60)), (None, prose(1, 60)), (None, prose(2, 60)), (big + 1, "")], "doc_id long, text string")
    got = {(r.doc_id, r.least_id) for r in jaccard.similar(docs).collect()}
    assert got == {(big, big), (None, big), (None, None), (big + 1, big + 1)}


def test_crowded_order_is_joined(spark, monkeypatch):
    from stratadiff.llm import jaccard

    docs = spark.createDataFrame([(i, prose(i // 3, 80) + (f" x{i}" if i % 3 else "")) for i in range(30)], "doc_id long, text string")
    want = sorted((r.doc_id, r.least_id) for r in jaccard.similar(docs).collect())
    assert len({x[1] for x in want}) == 10
    monkeypatch.setattr(jaccard, "bits_for", lambda *a: 64)
    assert sorted((r.doc_id, r.least_id) for r in jaccard.similar(docs).collect()) == want


# --- 2 --------------------------------------------------------------------------------------------------------------------
def test_every_piece(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(i, random.Random(i).choice([prose(i, i * 7), "", None, f"a <|endoftext|> b{i}", "É́ 日本語。 don't,, "])) for i in range(60)]
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), capacity=256).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for some in sequences.values():
        at = 0
        for offset, n in sorted(some):
            assert offset == at
            at += n
        assert at == 256 or at < 256 and at & (at - 1) == 0


# --- 4 --------------------------------------------------------------------------------------------------------------------
def kept_by_brute_force(rows: list[tuple]) -> dict:
    """rows: id, lang, source, q; the estimate as the module describes it, with plain loops over groups."""
    floors, p, share = np.array(quality.FLOORS), len(quality.NAMES), 0.75
    failed = {i: q["n_words"] < 10 or 100 * q["n_repeat_words"] > 20 * q["n_words"] for i, _, _, q in rows}

    def vector(q):
        n = max(1, q["n_words"])
        x = [np.log1p(q["n_words"]), np.log(max(1, q["word_chars"]) / n), np.log1p(100 * q["n_symbols"] / n), np.log1p(100 * q["n_repeat_words"] / n), np.log1p(100 * q["n_dup_lines"] / max(1, q["n_lines"]))]
        return [int(np.floor(v * quality.UNIT + 0.5)) for v in x]

    good = [(i, lang, source, vector(q)) for i, lang, source, q in rows if not failed[i]]
    by = defaultdict(list)
    for r in good:
        by[r[1], r[2]].append(r)
    group, rest = {}, defaultdict(int)
    for (lang, source), some in by.items():
        if len(some) < 50:
            rest[lang] += len(some)
    for lang, source in by:
        group[lang, source] = (lang, source) if len(by[lang, source]) >= 50 else (lang,) if rest[lang] >= 50 else ()

    def quantile(bins, s):
        return sorted(bins)[int(np.ceil(len(bins) * s)) - 1]

    def distance(x, m, cov):
        z = np.linalg.solve(np.linalg.cholesky(cov), (x - m).T)
        return (z * z).sum(0)

    limit = quality._chi2_quantile(0.99999, p) * share / quality._chi2_cdf(quality._chi2_quantile(share, p), p + 2)
    out = dict.fromkeys(failed, False)
    for g in set(group.values()):
        members = [r for r in good if not g or group[r[1], r[2]] == g]
        x = np.array([r[3] for r in members], float) / quality.UNIT
        bins = np.floor(x * quality.BIN).astype(int)
        mid = np.array([quantile(bins[:, j], 0.5) for j in range(p)])
        mad = np.array([quantile(abs(bins - mid)[:, j], 0.5) for j in range(p)])
        m, d = mid / quality.BIN, np.sqrt((mad / quality.BIN * 1.4826) ** 2 + floors**2)
        z = (x - m) / d
        starts = [np.diag(d**2)]
        for y in (np.tanh(z), z / np.maximum(np.sqrt((z * z).sum(1)), 1e-9)[:, None]):
            y = np.floor(abs(y) * 4096 + 0.5) * np.sign(y) / 4096
            starts.append(np.outer(d, d) * (y.T @ y / len(y) - np.outer(y.mean(0), y.mean(0)) + quality.LEAST_SPREAD * np.eye(p)))
        ends = []
        for cov in starts:
            c = m
            for _ in range(5):
                b = np.floor(np.log1p(distance(x, c, cov)) * quality.BIN)
                near = x[b <= quantile(b, share)]
                c, cov = near.mean(0), near.T @ near / len(near) - np.outer(near.mean(0), near.mean(0)) + np.diag(floors**2)
            ends.append((np.linalg.slogdet(cov)[1], c, cov))
        _, c, cov = min(ends, key=lambda e: round(e[0], 9))
        for r, far in zip(members, distance(x, c, cov) > limit, strict=True):
            if group[r[1], r[2]] == g:
                out[r[0]] = not far
    return out


def test_robust_outliers(spark):
    r, rows = random.Random(4), []
    for i in range(420):
        text = prose(i, r.randint(15, 400))
        if i % 37 == 0:
            text = " ".join(w + "#$%" for w in text.split())
        if i % 41 == 0:
            text = text.replace(" ", "\n")
        if i % 53 == 0:
            text = "\n".join([text] + [text.split(".")[0]] * 2)
        rows.append((i, text, r.choice(["en", "en", "fr", None]), "s0" if i % 3 else f"s{i % 9}", 0))
    rows += [(900 + i, prose(900 + i, 60 + i), "xx", "rare", 0) for i in range(6)] + [(950, "###$$$ " * 30 + prose(950, 40), "xx", "rare", 0), (951, "short", "xx", "rare", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    stats = docs.select("doc_id", "lang", "source", quality.statistics(F.col("text")).alias("q")).cache()
    got = {x.doc_id: x.kept for x in quality.judge(stats, quality.fit(stats)).collect()}
    want = kept_by_brute_force([(x.doc_id, x.lang, x.source, x.q.asDict()) for x in stats.collect()])
    assert got == want and not got[950] and got[900] and 0 < sum(not k for k in got.values()) < 60


# --- 5 --------------------------------------------------------------------------------------------------------------------
def test_no_link_is_cut_where_quotas_allow(spark):
    d = spark.range(480).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, F.concat(F.lit("t"), (F.col("id") % 40).cast("string"))).otherwise(F.col("id").cast("string")).alias("text"))
    where = defaultdict(set)
    for r in shards.shard(d).collect():
        if r.doc_id % 4 == 0:
            where[r.doc_id % 40].add(r.shard)
    assert len(where) == 10 and all(len(s) == 1 for s in where.values())


# --- 7 --------------------------------------------------------------------------------------------------------------------
def least_edits(notice: str, text: str) -> int:
    """The least edit distance between the notice and any part of the text (Sellers)."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(notice, 1):
        before, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != t))
    return min(row)


def test_notices_with_edits():
    r, search = random.Random(7), licenses.Search(licenses.NOTICES)
    for i in range(60):
        _, notice, most = licenses.NOTICES[i % len(licenses.NOTICES)]
        changed = list(notice)
        for _ in range(r.randint(0, most + 2)):
            at = r.randrange(len(changed))
            changed[at : at + 1] = r.choice([[], ["q"], [changed[at], "z"]])
        text = f"{prose(i, 6)} {''.join(changed)} {prose(i + 99, 6)}"
        clean, found = licenses.clean(text), licenses.scan(text, search)
        edits = [(label, n, least_edits(n, clean)) for label, n, e in licenses.NOTICES if least_edits(n, clean) <= e]
        assert set(found["labels"].split(",")) - {""} == {x[0] for x in edits} | (set(found["base_labels"].split(",")) - {""}), text
        if not found["n_base"]:
            assert abs(found["score"] - max((1 - e / len(n) for _, n, e in edits), default=0)) < 1e-9


# --- pipeline -------------------------------------------------------------------------------------------------------------
def written(spark, tmp_path, rows, items):
    d = str(tmp_path / "sf")
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(["row", "key", "bits", "all", "left", "q", "kept"]))).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_each_stage_takes_effect(spark, tmp_path):
    rows = [(i, prose(i, 120), "en", "s", 0) for i in range(60)]
    passage = prose(777, 70)
    rows[10] = (10, rows[10][1] + " " + passage, "en", "s", 0)
    rows[20] = (20, rows[20][1] + " " + passage, "en", "s", 0)
    rows += [(100, rows[5][1] + " tail", "en", "s", 0), (101, rows[6][1], "en", "s", 0), (102, "one two", "en", "s", 0), (103, None, "en", "s", 0)]
    d = written(spark, tmp_path, rows, [(1, " ".join(rows[30][1].split()[40:60]))])
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        out.write.parquet(f"{tmp_path}/{name}")
        names, docs = docs.columns, spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "packing" or docs.columns == names
        seen[name] = {r.doc_id: r for r in docs.collect()}
    everyone = {r[0] for r in rows}
    assert set(seen["quality_rules"]) == everyone - {102, 103}
    assert set(seen["near_duplicates"]) == everyone - {100, 101, 102, 103}
    left = seen["repeated_spans"]
    assert left[10].text == rows[10][1] and passage[20:-20] not in left[20].text and left[20].text.startswith(rows[20][1][:200]) and left[20].n_chars == len(left[20].text)
    assert all(left[i].text == rows[i][1] for i in range(60) if i != 20)
    assert set(seen["decontamination"]) == set(range(60)) - {30} == set(seen["packing"])
    home = f"{tmp_path}/home"
    first = sorted(map(tuple, corpus_pipeline.run(spark, d, home).collect()))
    assert first == sorted(map(tuple, spark.read.parquet(f"{tmp_path}/packing").collect())) or {x[0] for x in first} == set(seen["packing"])
    assert sorted(map(tuple, corpus_pipeline.run(spark, d, home).collect())) == first


def test_pipeline_of_nothing(spark, tmp_path):
    d = written(spark, tmp_path, [], [(1, "a")])
    assert corpus_pipeline.run(spark, d).count() == 0


def test_modules_have_their_sql():
    assert {urls.ORACLE_SQL, chat.ORACLE_SQL, decontaminate.ORACLE_SQL} == set(queries.ORACLE_SQL.values())


def test_large_unions_are_joined_by_token(spark, monkeypatch):
    from stratadiff.llm import jaccard

    r = random.Random(9)
    rows = []
    for i in range(40):
        words = prose(i // 20, 90).split()
        for _ in range(i % 6):
            words[r.randrange(len(words))] = f"y{r.randint(0, 9)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((x.doc_id, x.least_id) for x in jaccard.similar(docs).collect())
    monkeypatch.setattr(jaccard, "MOST_UNION", 3)
    assert sorted((x.doc_id, x.least_id) for x in jaccard.similar(docs).collect()) == want
