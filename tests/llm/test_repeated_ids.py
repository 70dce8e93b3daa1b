"""One doc_id on unlike texts: each is a component of its own."""

from stratadiff.llm import jaccard


def test_one_id_on_two_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    docs = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b)], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.one_of_each(docs).collect())) == [(1, a), (1, b)]
