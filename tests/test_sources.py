import json

from pyspark.sql import functions as F

from stratadiff.sources import readers, sinks
from stratadiff.streaming import ingest


def put(path, name, text):
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text(text)
    return str(path / name)


def test_readers(spark, tmp_path):
    put(tmp_path / "pkg_1.0.0", "package.json", json.dumps({"id": "X-1", "dependencies": {"a": "1"}, "links": {}, "fixCommit": "c"}))
    put(tmp_path / "bad_2.0.0", "package.json", "{")
    meta = {r.case_id: r.id for r in readers.case_metadata(spark, f"{tmp_path}/*/package.json").collect()}
    assert meta == {"pkg_1.0.0": "X-1", "bad_2.0.0": None}
    put(tmp_path / "pkg_1.0.0", "versions.txt", "aaa 2.0\nbbb 1.0\n\n")
    v = readers.version_map(spark, f"{tmp_path}/*/versions.txt")
    assert [(r.ord, r.commit_id, r.version) for r in v.orderBy("ord").collect()] == [(0, "aaa", "2.0"), (1, "bbb", "1.0")] and readers.oldest(v).first().commit_id == "bbb"
    put(tmp_path / "pkg_1.0.0", "tool.csv", "aaa##[1, 2]##0\naaa##[3]##0\nbroken\n")
    loc = readers.locations(spark, f"{tmp_path}/*/tool.csv").collect()
    assert [(r.tool, r.commit_id, r.chunk_idx, r.lines) for r in loc] == [("tool", "aaa", "0", [3])]
    pairs = put(tmp_path, "results.txt", "x/CWE-1/p1\nTrue\n\nx/CWE-2/p2\nFalse#0\n")
    assert sorted(tuple(r) for r in readers.paired_results(spark, pairs).collect()) == [("p1", "CWE-1", "True"), ("p2", "CWE-2", "False#0")]
    assert readers.ragged_links(spark, put(tmp_path, "l.csv", "CVE-1,u1,u2\nCVE-2\n")).orderBy("cve").collect()[0].urls == ["u1", "u2"]
    assert readers.keyed_object(spark, put(tmp_path, "o.json", '{"CVE-1": {"repo": "r", "owner": "o"}}')).first().repo == "r"
    assert [tuple(r) for r in readers.flagged_paths(spark, put(tmp_path, "t.txt", "(True, 'a/b')\n")).collect()] == [(True, "a/b")]
    assert [r.n for r in readers.numbers(spark, put(tmp_path, "n.txt", "3\nx\n")).collect()] == [3]
    assert readers.results(spark, f"{tmp_path}/none.json", "a int").count() == 0
    put(tmp_path / "prompts", "1.0@m@tracking.json", json.dumps({"prj_path": "p", "prompt": [{"prompt": "x", "context": "y", "line": [1]}], "m-output": ["z"]}))
    p = readers.prompts(spark, f"{tmp_path}/prompts/*.json").first()
    assert (p.version, p.model, p.method, p.outputs) == ("1.0", "m", "tracking", {"m-output": ["z"]})


def test_sinks(spark, tmp_path):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    sinks.upsert(old, new, ["k"], f"{tmp_path}/u")
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/u").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    sinks.append_text(old.select(F.col("v")), f"{tmp_path}/t", "v")
    sinks.append_text(new.select(F.col("v")), f"{tmp_path}/t", "v")
    assert spark.read.text(f"{tmp_path}/t").count() == 4


def test_incremental_ingest(spark, tmp_path):
    put(tmp_path / "in", "a.json", '{"k": 1}\n')
    for n in (1, 1, 2):
        if n == 2:
            put(tmp_path / "in", "b.json", '{"k": 2}\n')
        ingest.append_new(spark, f"{tmp_path}/in", "k int", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(60)
        assert spark.read.schema("k int").parquet(f"{tmp_path}/out").count() == n
