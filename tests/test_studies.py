from pyspark.sql import functions as F

from stratadiff.operators import diffs, graphs, lines
from stratadiff.plans import studies

PATCH = "--- a/a.js\n+++ b/a.js\n@@ -1,3 +1,4 @@\n+new\n one\n-two\n+TWO\n three\n"


def test_lines(spark):
    d = diffs.diff_lines(spark.createDataFrame([("c", PATCH)], "case_id string, text string"))
    assert lines.removed_numbers(d, ["case_id"]).first().lines == [2] and lines.added_by_commit(d, ["case_id"]).first().lines == [1, 3]
    assert lines.of_sources(d).count() == 5 and lines.with_text(d).count() == 5
    assert lines.removed_between(d, F.lit(1), F.lit(2)).count() == 1 and lines.content_at(d, ["case_id"], F.lit(2)).first().value == "two"
    assert lines.context_after(d, ["case_id"], F.lit(3)).first().src_no == 3
    assert lines.added_among(d, spark.createDataFrame([("c", 3)], "case_id string, tgt_no int"), ["case_id"]).first().value == "TWO"
    f = spark.createDataFrame([("c", i, v) for i, v in enumerate(["a", "", " b x", "a", "c"], 1)], "case_id string, line_no int, value string")
    assert lines.numbers_containing(f, ["case_id"], F.lit("a")).first().lines == [1, 4]
    assert lines.first_equal(f, ["case_id"], F.lit("bx"), F.lit(1)).first().line_no == 3 and lines.first_equal(f, ["case_id"], F.lit("a"), F.lit(5)).first().line_no == -1
    n = spark.createDataFrame([("c", 2), ("c", 5), ("c", 9)], "case_id string, line_no int")
    assert {r.line_no: r.full_no for r in lines.next_full(n, f, ["case_id"]).collect()} == {2: 3, 5: 5, 9: -1}
    block = spark.createDataFrame([("c", 0, "a"), ("c", 1, "c")], "case_id string, ord int, value string")
    assert lines.place_of_block(f, block, ["case_id"]).first().line_no == 4
    assert [r.line_no for r in lines.exact_matches(f, spark.createDataFrame([("c", "a")], "case_id string, value string"), ["case_id"], F.lit(2), F.lit(5)).collect()] == [4]
    files = spark.createDataFrame([("c", "a.js"), ("c", "test/b.js")], "case_id string, path string")
    assert lines.has_tests(files, ["case_id"]).first().tested
    gone, there = spark.createDataFrame([("c", "x = 1;")], "case_id string, value string"), spark.createDataFrame([("c", "x = 1;")], "case_id string, value string")
    assert lines.renamed_lines(gone, there, ["case_id"], files).count() == 1 and lines.renamed_lines(gone, there, ["case_id"], files.limit(1)).count() == 0
    tags = spark.createDataFrame([("c", "v1.10.0"), ("c", "v1.2.0"), ("c", "1.2.0-rc")], "case_id string, tag string")
    assert lines.ordered_versions(tags, ["case_id"]).first().versions == ["1.10.0", "1.2.0"]
    assert lines.shrunk(tags, tags.withColumn("tag", F.lit("v")), ["case_id"], "tag").count() == 9
    assert lines.matching_text(tags, ["tag"], "rc").count() == 1 and lines.without_own_commit(spark.createDataFrame([("ab",), ("zz",)], "commit_id string"), F.lit("abc")).count() == 1


def test_studies(spark):
    edges = spark.createDataFrame([("c", x, y, 0) for x, y in (("a", None), ("b", "a"), ("p", "b"))], "case_id string, commit_id string, parent_id string, parent_idx int")
    up = graphs.closure(edges, "commit_id", "parent_id", ["case_id"])
    rank = graphs.ranks(edges, "commit_id", "parent_id", ["case_id"])
    versions = spark.createDataFrame([("c", "a", "1"), ("c", "b", "2"), ("c", "p", "3")], "case_id string, commit_id string, version string")
    runs = spark.createDataFrame([("c", "a", "PASS"), ("c", "b", "Expected Received"), ("c", "p", "PASS")], "case_id string, commit_id string, stderr string")
    got = studies.still_open(versions, spark.createDataFrame([("c", "p")], "case_id string, patch_commit string"), up, runs, ["case_id"])
    assert [r.version for r in got.collect()] == ["1"]
    d = diffs.diff_lines(spark.createDataFrame([("c", PATCH)], "case_id string, text string"))
    blame = spark.createDataFrame([("c", "a.js", 2, "b")], "case_id string, path string, line_no int, origin_commit string")
    assert studies.origins(d, blame, rank, ["case_id"]).first().commit_id == "b"
    chain = spark.createDataFrame([("c", 1, "a", [1, 2, 3])], "case_id string, rank int, commit_id string, lines array<int>")
    found = studies.localized(spark.createDataFrame([("c", 2)], "case_id string, rank int"), chain, d.withColumn("from_commit", F.lit("a")), ["case_id"])
    assert found.first().lines == [2, 4] and studies.contiguous(found).first().lines == [2, 3, 4]
    fn = spark.createDataFrame([("c", "a.js", 1, 3, "f", "x", "", "return x;")], "case_id string, path string, start_line int, end_line int, name string, params string, ret string, body string")
    assert [(r.name, r.lines) for r in studies.function_targets(d, fn, ["case_id"]).collect()] == [("f", [2])]
    new = fn.withColumn("body", F.lit("return y;"))
    assert studies.changed_functions(fn, new, ["case_id", "path"]).count() == 1
    m = studies.function_metrics(fn, new, ["case_id", "path"]).first()
    assert not m.name_changed and 0 < m.likeness.edit < 1
    pkg = '{"license": "MIT", "dependencies": {"a": "1"}}'
    v = lambda day, p, files: spark.createDataFrame([("c", day, p, files)], "case_id string, committed_at string, package string, files array<string>").withColumn("committed_at", F.to_date("committed_at"))
    r = studies.version_metrics(v("2020-01-01", pkg, ["a", "b"]), v("2020-01-11", "{}", ["b", "c"]), ["case_id"]).first()
    assert (r.days, r.dependency_similarity, r.license_change, round(r.file_list_similarity, 3)) == (10, 0.0, True, 0.333)
    steps = studies.commit_distance(up, spark.createDataFrame([("c", "a", "p")], "case_id string, low string, high string"), spark.createDataFrame([("c", "a.js", "b"), ("c", "b.js", "a")], "case_id string, path string, commit_id string"), ["case_id"]).first()
    assert (steps.commits, steps.file_commits) == (2, 0.5)
    patch = spark.createDataFrame([("r", 0, "bad();", "good();", "fix", "ppp", "X-1")], "repo string, hunk int, removed string, added string, message string, patch_id string, case_id string")
    others = spark.createDataFrame([("r", "q1", 0, "bad();", "good();", "port fix"), ("r", "q2", 0, "else", "where", "x"), ("r", "ppp", 0, "bad();", "good();", "fix")], "repo string, commit_id string, hunk int, removed string, added string, message string")
    assert [r.commit_id for r in studies.back_ports(patch, others, ["repo"], F.col("patch_id")).collect()] == ["q1"]
    answers = spark.createDataFrame([("p1", "x"), ("p2", None), ("p3", "y\n" * 600)], "pkg string, text string")
    runs = spark.createDataFrame([("p1", "Expected Received")], "pkg string, stderr string")
    s = studies.port_results(answers, runs, ["pkg"])
    assert {r.pkg: r.status for r in s.collect()} == {"p1": "True", "p2": "False#3", "p3": "False#4"}
    types = spark.createDataFrame([("p1", "1"), ("p2", "1"), ("p3", "2")], "pkg string, type string")
    assert {r.type: (r.total, r.fixed, r.fixed_share) for r in studies.effectiveness(s, types).collect()} == {"1": (2, 1, 0.5), "2": (1, 0, 0.0)}
    maps = [spark.createDataFrame(x, "k string, line_no int, new_no int") for x in ([("a", 1, 5)], [("a", 1, 6), ("a", 2, 7)], [], [("a", 3, 9)])]
    assert {r.line_no: r.new_no for r in studies.mapped_lines(*maps, ["k"]).collect()} == {1: 5, 2: 7, 3: 9}
