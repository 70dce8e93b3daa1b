"""Files of token ids: exact round trips, places, and the query against the tokenizer itself."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratadiff.llm import packing, queries, tokenfiles

SCHEMA = "doc_id long, text string, file int, ids string"


def rows():
    r = random.Random(9)
    words = "The quick <|endoftext|> über naïve don't 42% x_y 漢字 😂 ﬁn\n\tend.".split(" ")
    out = [(None, "a b", 1, "x"), (3, None, 1, "x"), (4, "", 1, "x"), (7, "same text", 1, "x"), (7, "same text", 1, "x"), (7, "other", 1, "x")]
    return out + [(i, " ".join(r.choice(words) for _ in range(r.randrange(400 if i % 9 else 4000))), 1, "x") for i in range(10, 150)]


def encoded(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, packing.END], "<u4") for x in texts]


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 5000])
def test_chunk_round_trip(kind, n):
    for most in (1, 2, 300, 50_000, 1 << 32):
        ids = np.random.default_rng(n).integers(0, most, n, dtype=np.uint32)
        payload = tokenfiles.pack_chunk(ids, kind)
        assert np.array_equal(tokenfiles.open_chunk(payload), ids)
    with pytest.raises(ValueError):
        tokenfiles.open_chunk(b"XXXX" + payload[4:])


def test_planes_are_what_they_say():
    ids = np.array([0x01020304, 0x80000001, 2], "<u4")
    assert tokenfiles.planes_of(ids) == [bytes([4, 1, 2]), bytes([3, 0, 0]), bytes([2, 0, 0]), bytes([1, 0x80, 0])]
    bits = tokenfiles.planes_of(ids, "bit")
    assert len(bits) == 32
    assert [b[0] for b in bits] == [sum(((int(x) >> j) & 1) << i for i, x in enumerate(ids)) for j in range(32)]


@pytest.mark.parametrize(("kind", "size"), [("byte", 256), ("bit", 1000), ("byte", 1 << 16)])
def test_written_and_read(spark, tmp_path, kind, size):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    tokenfiles.write_ids(docs, str(tmp_path / "t"), kind=kind, size=size)
    got = sorted(tokenfiles.read_ids(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    ids = encoded([t for _, t, _, _ in rows()])
    want = sorted(((-1 if d is None else d, x.tobytes()) for (d, _, _, _), x in zip(rows(), ids, strict=True)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, bytes(r.ids)) for r in got) == want
    assert [-1 if r.doc_id is None else r.doc_id for r in got] == [d for d, _ in want]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    assert all(len(r.ids) == 4 * r.n_tokens for r in got)
    index = tokenfiles.read_index(spark, str(tmp_path / "t"))
    assert index.agg(F.sum("n_ids")).first()[0] == sum(map(len, ids))
    assert index.where(F.col("n_ids") > size).isEmpty()
    some = tokenfiles.read_ids(spark, str(tmp_path / "t"), spark.createDataFrame([(7,), (18,), (999,), (None,)], "doc_id long")).collect()
    assert sorted((r.doc_id, r.start, bytes(r.ids)) for r in some) == sorted((r.doc_id, r.start, bytes(r.ids)) for r in got if r.doc_id in (7, 18))


def test_empty_table(spark, tmp_path):
    tokenfiles.write_ids(spark.createDataFrame([], SCHEMA), str(tmp_path / "t"))
    assert tokenfiles.read_ids(spark, str(tmp_path / "t")).count() == 0


@pytest.mark.parametrize("given", [True, False])
def test_query(spark, tmp_path, given):
    folder = "/root/testdata/sf0.001" if given else str(tmp_path)
    if not given:
        spark.createDataFrame([r[:2] for r in rows()], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = queries.QUERIES["op11_plane_shuffle"](spark, folder)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    got = sorted(got.collect(), key=lambda r: r.start)
    want = sorted((-1 if d.doc_id is None else d.doc_id, len(x), zlib.crc32(x.tobytes())) for d, x in zip(docs, encoded([d.text for d in docs]), strict=True))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r, w in zip(got, want, strict=True):
        assert ((-1 if r.doc_id is None else r.doc_id), r.start) == (w[0], at)
        at += r.n_tokens
