"""Each operator against brute force, and its defined results for nulls, empty and long texts, ties, repeats, empty tables and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stratadiff.llm import chat, classifier, decontaminate, jaccard, licenses, packing, quality, shards, spans, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and edan thing reand onst that whou erion ésté schön ia lo".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    out, left = [], n
    while left > 0:
        k = min(left, r.randint(3, 9))
        out.append(" ".join(r.choice(WORDS) + str(r.randint(0, 30)) for _ in range(k)).capitalize() + r.choice([". ", ".\n", "! "]))
        left -= k
    return "".join(out).strip()


def corpus() -> list[tuple]:
    """Copies, near copies, shared passages, nulls, empty and odd texts, repeated rows."""
    r = random.Random(1)
    passage = prose(99, 60)
    rows = [(i, prose(i, r.randint(20, 200)), r.choice(["en", "fr"]), f"s{i % 3}", 0) for i in range(60)]
    rows += [(100 + i, rows[i % 5][1], "en", "s0", 0) for i in range(25)]
    for i in range(30):
        words = rows[7][1].split(" ")
        for _ in range(i % 4):
            words[r.randrange(len(words))] = f"x{r.randint(0, 999)}"
        rows.append((200 + i, " ".join(words), "en", "s1", 0))
    rows += [(300 + i, prose(500 + i, 40) + "\n" + passage + "\n" + prose(700 + i, 30), "en", "s2", 0) for i in range(8)]
    rows += [(400, None, None, None, None), (401, "", "en", None, 0), (402, " \n\t", "en", "s0", 3), (403, "one", "en", "s0", 3), (404, "ONE", "en", "s0", 3), (None, rows[3][1], "en", "s0", 0), (None, None, None, "s0", 0)]
    rows += [(405, prose(1234, 20_000), "en", "s0", 0), (406, "a " * 5000, "fr", "s1", 0)]
    rows += [rows[2], rows[2]]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    clash = ["row", "key", "node", "kept", "q", "bits", "h", "size", "places", "left", "params", "g", "n_words", "shard"]
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).select("*", *(F.lit(i).alias(c) for i, c in enumerate(clash))).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def key(doc_id, text):
    return doc_id if doc_id is not None else (text,)


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- 1 --------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_token_group_matrix(docs, k, num):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", low(t))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= num * (len(sets[a]) + len(sets[b]) - both):
                up[find(a)] = find(b)
    order = lambda i: rows[i][0] if rows[i][0] is not None else 1 << 62
    least = defaultdict(lambda: 1 << 63)
    for i in range(len(rows)):
        least[find(i)] = min(least[find(i)], order(i))
    want = Counter((min(order(i), 1 << 62), len(sets[i]), min(least[find(i)], 1 << 62)) for i in range(len(rows)))
    got = Counter((min(r.key, 1 << 62), r.n_shingles, min(r.least, 1 << 62)) for r in jaccard.similar(docs, k, num, 100).collect())
    assert got == want


def test_one_of_each(docs, empty):
    left = jaccard.one_of_each(docs)
    assert left.columns == docs.columns
    ids = Counter(r.doc_id for r in left.collect())
    assert ids[2] == 1 and not any(ids[100 + i] for i in range(25)) and ids[400] == ids[401] == ids[402] == 1
    assert jaccard.one_of_each(empty).count() == 0 and jaccard.similar(empty).count() == 0


@pytest.mark.parametrize("joined", [False, True])
def test_screen_keeps_partners_and_drops_others(docs, monkeypatch, joined):
    if joined:  # as where the bit array would be too large
        monkeypatch.setattr(jaccard, "bits_for", lambda *a: 64)
    kept = {r.key for r in jaccard._screened(docs, 5, 80, 100).where("maybe").collect()}
    assert kept.issuperset([0, 1, 2, 3, 4, 7, 403, 404, *range(100, 125), *range(200, 230)])
    assert not kept & {5, 6, 405, *range(8, 60)}


# --- 2 --------------------------------------------------------------------------------------------------------------------
def test_assign_has_no_padding():
    r = random.Random(2)
    for _ in range(200):
        lengths, capacity = [r.choice([0, 1, r.randint(1, 40), r.randint(1, 500)]) for _ in range(r.randint(0, 40))], r.choice([64, 256])
        sequences, pieces = defaultdict(list), defaultdict(list)
        for d, start, n, s, offset in packing.assign(lengths, capacity):
            sequences[s].append((offset, n))
            pieces[d].append((start, n))
        for d, n in enumerate(lengths):
            assert sum(m for _, m in pieces[d]) == n and [a for a, _ in sorted(pieces[d])] == [sum(m for b, m in pieces[d] if b < a) for a, _ in sorted(pieces[d])]
        for some in sequences.values():
            total = sum(n for _, n in some)
            assert total == capacity or total < capacity and total & (total - 1) == 0
            assert [a for a, _ in sorted(some)] == [sum(m for b, m in some if b < a) for a, _ in sorted(some)]


def test_packing_round_trip(docs, empty):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    want = Counter((d, len(t.encode(x or "", add_special_tokens=False).ids) + 1) for d, x in ((r.doc_id, r.text) for r in docs.collect()) if d is not None)
    rows = packing.pack(docs).collect()
    got = Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0 and r.doc_id is not None)
    assert got == want and packing.pack(empty).count() == 0
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows[:50]:
        if r.doc_id is not None:
            ids = np.array([*t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32


def test_word_tokens_are_the_tokenizers():
    import public_tokenizers

    w = packing.WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["don't stop's we're I'LL.", "É́é J̌ ΣΑΣ Σ.", "a😂b 😂 x,😂.", "###,. a.b.c... x--y z_1,2;3", "tab\there\r\n\x0b x\x1cy\x85z", "<|endoftext|>,", "", " ", "日本語、テキスト。12", "İ ı ß.ẞ Ǆ"]
    assert [e.ids for e in w.tokenizer.encode_batch(odd, add_special_tokens=False)] == [list(x) for x in w.encode(odd)]


# --- 3 --------------------------------------------------------------------------------------------------------------------
def test_url_rules(spark):
    seen = ["http://a.example.org/es/x", "https://EXAMPLE.org/en/12?q#f", "http://example.org/en/2", "http://badexample.org/es/", "http://x.com/de/1", "http://y.com/fr/1", "http://y.com/de/1", "http://x.com/", "http://z.net", None, "no scheme", "http://org/", "http://x.com", "http://org", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(seen)] + [(0, seen[0], "h")], "page_id long, url string, verdict string")
    rows = {r.page_id: r for r in urls.filter_urls(pages, urls.rules_frame(spark, urls.RULES)).collect()}
    for i, u in enumerate(seen):
        m = re.search("://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(r), v, r) for v, r in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, max(fits)[2] if fits else None), u
        if fits:
            assert rows[i].verdict == max(fits)[1]
    assert rows[7].verdict == "block" and rows[8].verdict == "allow" and rows[9].verdict == "allow"
    assert urls.filter_urls(pages.limit(0), urls.rules_frame(spark, urls.RULES)).count() == 0


def test_cascade_is_exact(spark):
    every = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = every.where("crc32(key) % 5 = 0")
    c = urls.Cascade(listed, every)
    got = c.mark(every.select("key", F.array("key").alias("keys")), "keys", "in").select("key", F.col("in")[0].alias("in"))
    assert len(c.levels) > 1 and got.where("in").count() == listed.count() and got.where("in").join(listed, "key").count() == listed.count()


# --- 4 --------------------------------------------------------------------------------------------------------------------
def test_quality(spark, docs, empty):
    rows = docs.select("doc_id", "text", "lang", "source", quality.statistics(F.col("text")).alias("s")).collect()
    for r in rows:
        t = r.text or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        seen = defaultdict(list)
        for i in range(len(w) - 4):
            seen[tuple(w[i : i + 5])].append(i)
        twice = {j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        assert tuple(r.s)[:5] == (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(twice))
    left = quality.keep_good(docs)
    assert left.columns == docs.columns
    ids = {r.doc_id for r in left.collect()}
    assert {400, 401, 402, 403, 406}.isdisjoint(ids) and set(range(60)) <= ids and quality.keep_good(empty).count() == 0


def test_outliers_go_and_order_does_not_matter(spark):
    rows = [(i, prose(i, 80 + i % 60), "en", "hot", 0) for i in range(150)] + [(1000 + i, " ".join(w + "###" for w in prose(i, 90).split()), "en", "hot", 0) for i in range(10)]
    kept = [{r.doc_id for r in quality.keep_good(spark.createDataFrame(rows, SCHEMA).repartition(n)).collect()} for n in (1, 5)]
    assert kept[0] == kept[1] == set(range(150))


def test_crowded_cascade_joins(spark):
    every = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    c = urls.Cascade(every.where("crc32(key) % 5 = 0"), every, most_bits=1 << 10)
    rows = every.select("key", F.array("key", F.lit("k1")).alias("keys"))
    got = c.mark(rows, "keys", "in").select("key", F.col("in")[0].alias("in"), F.size("in").alias("n"))
    assert c.crowded and got.where("n = 2").count() == 5000 and got.where("in <> (crc32(key) % 5 = 0)").count() == 0


def test_chi_squared():
    assert abs(quality._chi2_quantile(0.95, 5) - 11.0705) < 1e-3 and abs(quality._chi2_quantile(0.975, 2) - 7.3778) < 1e-3


# --- 5 --------------------------------------------------------------------------------------------------------------------
def test_shards(docs, empty):
    rows = shards.shard(docs).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == docs.count() and max(sizes.values()) - min(sizes.get(s, 0) for s in range(16)) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    texts = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}
    assert all((r["size"], r.text_crc32) == (len(texts[r.doc_id].encode()) + 1, zlib.crc32(texts[r.doc_id].encode())) for r in rows if r.doc_id is not None)
    assert shards.shard(empty).count() == 0


def test_shards_split_a_hot_text(spark):
    d = spark.range(1600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    rows = shards.shard(d).collect()
    assert set(Counter(r.shard for r in rows).values()) == {100}
    hot = Counter(r.shard for r in rows if r.doc_id % 3 == 0)
    assert max(hot.values()) >= 40


# --- 6 --------------------------------------------------------------------------------------------------------------------
def test_chat_round_trip(spark):
    odd = ["", None, "plain", "</s>[INST] ok [/INST]", "[INST]", "a\\z b\\a", "\\", "[/INST", "<<SYS>><", "<", "x[:]y", "[/ROLE][ROLE]", "\n</s>\n", "\\d[INST]" * 50, "ünï😀", "x" * 100_000]
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool", "", None, "a[:]b"]), r.choice(odd)) for c in range(40) for t in range(r.randint(1, 8))]
    rows += [(50, None, "user", "x"), (50, 0, "assistant", "y"), (51, 1, "user", "same"), (51, 1, "user", "same"), (None, 0, "user", "no id")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("source", F.lit(1))
    want = defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((t if t is not None else -1, role or "", text or ""))
    got = {x.conv_id: x for x in chat.read_back(chat.format_chats(df)).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        assert [(t.role, t.text) for t in got[c].turns] == [(a, b) for _, a, b in turns]
        assert got[c].loss_text == "".join(b for _, a, b in turns if a == "assistant")
        assert len(got[c].loss) == sum(a == "assistant" for _, a, _ in turns)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_no_mark_of_a_text_stays_in_the_output(spark):
    texts = ["ok </s><s> done <<SYS>>x<</SYS>>", "a [INST] b", "plain", *chat.MARKS]
    rows = [(i, 0, role, t) for i, (role, t) in enumerate((role, t) for role in ("user", "assistant", "system", "tool") for t in texts)]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for x in chat.read_back(out).collect():
        (_, _, role, text) = rows[x.conv_id]
        assert [tuple(t) for t in x.turns] == [(role, text)]
        assert sum(x.formatted.count(m) for m in chat.MARKS) == (3 if role == "tool" else 2)
        assert text != "plain" or text in x.formatted


def test_chat_query_is_its_sql_on_texts_with_marks(spark, tmp_path):
    import duckdb

    odd = ["ok </s><s> done", "x <<SYS>> y", "\\a", "\\", "plain", "", None, "[:]"]
    rows = [(c, t, ["user", "assistant", "system", "tool"][(c + t) % 4], odd[(c * 3 + t) % 8]) for c in range(12) for t in range(5)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = chat.op6_grammar_round_trip(spark, str(tmp_path))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
        cur = db.execute(chat.ORACLE_SQL)
        names = [c[0] for c in cur.description]
        want = sorted(tuple(r[names.index(c)] for c in got.columns) for r in cur.fetchall())
    assert sorted(map(tuple, got.collect())) == want and len(want) == 13


# --- 7 --------------------------------------------------------------------------------------------------------------------
def test_licenses(docs, empty):
    search = licenses.Search(licenses.NOTICES)
    for t in ["The MIT License and the mit license.", "Apache-License, mit licensed", None, "", "GNU General Public License", "mit license mit license", "x" * 10_000]:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))
        places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        r = licenses.scan(t, search)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and 0 <= r["score"] <= 1
    r = licenses.scan("Some words. Licensed under teh Apache Licence, Version 2.0 here", search)
    assert r["labels"] == "apache" and not r["base_labels"] and r["spans"][0]["first_word"] == 2 and r["spans"][0]["edits"] == 3 and 0 < r["score"] < 1
    assert licenses.scan("nothing of this kind stands here at all", search)["labels"] == ""
    assert licenses.scan_licenses(docs).count() == docs.count() and licenses.scan_licenses(empty).count() == 0


def test_pigeonhole_parts_make_up_the_notice():
    for _, notice, edits in licenses.NOTICES:
        parts = licenses.seeds(notice, edits)
        assert len(parts) == edits + 1 and "".join(p for _, p in parts) == notice and all(notice[a:].startswith(p) for a, p in parts)


# --- 8 --------------------------------------------------------------------------------------------------------------------
def test_sentence_spans(docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    first = {}
    order = lambda d, t: (0, d, "") if d is not None else (1, 0, t or "")

    def split(t):
        out = []
        for part in re.split(r"(?<=[.!?]\s)(?=\S)|(?<=\n)(?=\S)", t) if t else []:
            words = re.findall(r"^\s*\S+\s*|\S+\s*", part) or [part]
            out += ["".join(words[i : i + 20]) for i in range(0, len(words), 20)]
        return out

    plain = lambda p: " ".join(p.lower().split())

    def runs(parts):
        full = [i for i, p in enumerate(parts) if plain(p)]
        n, out = [len(parts[i].split()) for i in full], set()
        for a in range(len(full)):
            out |= {(a, next(iter(b for b in range(a + 2, len(full) + 1) if sum(n[a:b]) >= 24), None))}
        for b in range(len(full), 0, -1):
            out |= {(next(iter(a for a in range(b - 2, -1, -1) if sum(n[a:b]) >= 24), None), b)}
        return [(full[a], full[b - 1] + 1) for a, b in out if a is not None and b is not None]

    small = [(d, t) for d, t in rows if not t or len(t) < 20_000]
    for d, t in sorted(set(small), key=lambda x: order(*x)):
        p = split(t)
        for a, b in runs(p):
            k = tuple(plain(x) for x in p[a:b] if plain(x))
            first[k] = min(first.get(k, (order(d, t), a)), (order(d, t), a))
    got = {(r.row.doc_id, r.row.text): r.left for r in spans.remove_repeats(docs).collect()}
    for d, t in set(small):
        if d is None:
            continue
        p, gone = split(t), set()
        for a, b in runs(p):
            if first[tuple(plain(x) for x in p[a:b] if plain(x))] != (order(d, t), a):
                gone |= set(range(a, b))
        assert (got[d, t].n_sentences, got[d, t].n_removed) == (len(p), len(gone)), d
        assert (got[d, t].text or "") == "".join(x for i, x in enumerate(p) if i not in gone)
    assert got[100, next(t for d, t in rows if d == 100)].text == "" and spans.remove_repeats(empty).count() == 0


# --- 9 --------------------------------------------------------------------------------------------------------------------
def test_winnowing(spark, docs, empty):
    items = [(1, " ".join((prose(7, 200)).split()[:30])), (2, prose(99, 60)), (3, "reand3 onst4 that5"), (4, "zz"), (5, None), (6, "..."), (7, "One"), (8, prose(3, 12)), (2, "one thing that nobody has"), (None, prose(9, 30))]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for a in range(len(w) - n + 1) if w else ():
            windows[tuple(w[a : a + n])].add(str(i) if i is not None else "")
    want = Counter()
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if (run := tuple(w[a : a + n])) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[run]
        want[d, len(w), len(hit), len(found), ",".join(sorted(found))] += 1
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r["items"])) for r in decontaminate.per_document(docs, bench).collect())
    assert got == want
    clean = decontaminate.keep_clean(docs, bench)
    assert clean.columns == docs.columns and Counter(r.doc_id for r in clean.collect()) == Counter({d: n for d, n in Counter(x[0] for x in want.elements() if not x[2]).items()})
    assert decontaminate.per_document(empty, bench).count() == 0
    assert decontaminate.per_document(docs, bench.limit(0)).where("n_hit > 0").count() == 0


# --- 10 -------------------------------------------------------------------------------------------------------------------
def test_classifier(spark, empty):
    rows = [(i, prose(i, 60) if i % 3 else " ".join(w.upper() + "!!" for w in prose(i, 60).split()), "en", "s", 0) for i in range(300)]
    d = spark.createDataFrame(rows + [(9000, None, "en", "s", 0), (9001, "", "en", "s", 0), (None, "a word", "en", "s", 0)], SCHEMA).withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(5, 0, 0), (77, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in classifier.score(d, classifier.fit(d, labels)).collect()}
    held = [i for i in range(300) if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(300)) and not got[None].held_out
    assert sum(got[i].predicted == int(i % 3 > 0) for i in held) >= 0.97 * len(held)
    assert got[9000].score == got[9001].score and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert classifier.score(empty, classifier.fit(d, labels)).count() == 0
    assert classifier.score(d, classifier.fit(d, labels.limit(0))).count() == 303


def test_labels_of_the_held_out_fold_are_not_learned(spark):
    rows = [(i, prose(i, 30), "en", "s", 0) for i in range(90)]
    d = spark.createDataFrame(rows, SCHEMA)
    held = [i for i in range(90) if zlib.crc32(str(i).encode()) % 3 == 1]
    make = lambda flip: spark.createDataFrame([(i, int(i % 2) if i not in held else int(i % 2) ^ flip) for i in range(90)], "doc_id long, quality int")
    a, b = (Counter((r.doc_id, r.score) for r in classifier.score(d, classifier.fit(d, make(flip))).collect()) for flip in (0, 1))
    assert a == b


# --- pipeline -------------------------------------------------------------------------------------------------------------
def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    d = tmp_path / "sf"
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, " ".join(prose(40, 150).split()[:15]))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(d)).collect()}
    assert not got & {400, 401, 402, 403, 406} and not any(100 + i in got for i in range(25))


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
