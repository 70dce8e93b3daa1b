import pytest
from pyspark.sql import functions as F

from stratadiff.operators import code, diffs, edits, graphs, likeness, results, similarity

PATCH = """diff --git a/lib/a.js b/lib/a.js
--- a/lib/a.js
+++ b/lib/a.js
@@ -1,5 +1,5 @@ function f() {
 one
-two
+TWO
+2
 three
--- four
 five
@@ -10,2 +10,3 @@
 ten
+ten and a half
 eleven
\\ No newline at end of file
diff --git a/new.js b/new.js
new file mode 100644
--- /dev/null
+++ b/new.js
@@ -0,0 +1,2 @@
+x
+y
"""


@pytest.fixture(scope="module")
def lines(spark):
    return diffs.diff_lines(spark.createDataFrame([("c1", PATCH), ("c2", None), ("c3", "")], "case_id string, text string")).cache()


def test_parse(lines):
    rows = lines.orderBy("file_idx", "hunk_idx", "pos").collect()
    assert [(r.file_idx, r.hunk_idx, r.line_type, r.src_no, r.tgt_no) for r in rows] == [
        (0, 0, " ", 1, 1), (0, 0, "-", 2, None), (0, 0, "+", None, 2), (0, 0, "+", None, 3), (0, 0, " ", 3, 4), (0, 0, "-", 4, None), (0, 0, " ", 5, 5),
        (0, 1, " ", 10, 10), (0, 1, "+", None, 11), (0, 1, " ", 11, 12), (1, 2, "+", None, 1), (1, 2, "+", None, 2),
    ]
    assert rows[5].value == "-- four" and rows[0].section == "function f() {" and rows[-1].is_new and not rows[0].is_new


def test_chunks_and_counts(lines, spark):
    got = [(r.hunk_idx, r.chunk_idx, r.kind, r["first"], r["last"]) for r in diffs.chunks(lines).orderBy("hunk_idx", "chunk_idx").collect()]
    assert got == [(0, 0, "change", 2, 2), (0, 1, "delete", 4, 4), (1, 0, "add", 11, 11), (2, 0, "add", 0, 0)]
    r = diffs.changed_lines(lines).first()
    assert (r.changed, r.hunks, r.chunks) == (7, 3, 4)
    old = spark.createDataFrame([("c1", "lib/a.js", i, v) for i, v in [(10, "ten"), (11, " "), (12, "twelve")]], "case_id string, path string, line_no int, value string")
    anchors = {(x.hunk_idx, x.kind): x["first"] for x in diffs.anchored(diffs.chunks(lines), old).collect() if x.kind == "add"}
    assert anchors == {(1, "add"): 12, (2, "add"): -1}


def test_transport(lines, spark):
    numbers = spark.createDataFrame([("c1", 0, i, n) for i, n in enumerate([1, 2, 3, 4, 5, 7, 10, 11, 30, 3])], "case_id string, file_idx int, ord long, line_no int")
    got = [(r.ord, r.new_no) for r in diffs.transport(numbers, lines, ["case_id", "file_idx"]).orderBy("ord").collect()]
    assert got == [(0, 1), (2, 4), (4, 5), (5, 7), (6, 10), (7, 12), (8, 31), (9, 4)]


def test_hunks_back_to_text(lines):
    texts = diffs.hunk_texts(lines.where("file_idx = 0"))
    patch = diffs.patch_texts(texts).first().patch
    again = [(r["line_type"], r["value"]) for r in diffs.parse_patch(patch)]
    assert again == [(r.line_type, r.value) for r in lines.where("file_idx = 0").orderBy("hunk_idx", "pos").collect()]


def test_leave_one_out_and_essential(spark):
    parts = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z"), ("c", 0, "p"), ("c", 1, "q")], "case_id string, hunk_idx int, t string")
    assert {(r.case_id, r.left_out): r.rest for r in diffs.leave_one_out(parts, "case_id", "hunk_idx", "t").collect()}[("a", 0)] == ["y"]
    runs = spark.createDataFrame([("a", 0, "False#0"), ("a", 1, "True"), ("c", 0, "True"), ("c", 1, "True")], "case_id string, hunk_idx int, status string")
    got = sorted((r.case_id, r.hunk_idx) for r in diffs.essential_hunks(parts.drop("t"), runs).collect())
    assert got == [("a", 0), ("b", 0), ("c", 0), ("c", 1)]


def test_similarity(spark):
    a, b = F.lit("kitten"), F.lit("sitting")
    row = spark.range(1).select(similarity.edit_similarity(a, b), similarity.edit_share(a, b), similarity.indel_ratio(a, b), similarity.sequence_ratio(a, b), similarity.token_jaccard(F.lit(" a b "), F.lit("b c")), similarity.bleu(F.lit("a b c d e"), F.lit("a b c d e")), similarity.code_bleu(F.lit("x = y + 1;"), F.lit("x = y + 1;"))).first()
    assert tuple(row) == pytest.approx((1 - 3 / 7, 3 / 13, 8 / 13, 2 * 4 / 13, 1 / 3, 1.0, 1.0), abs=1e-9)
    v = F.array(*map(F.lit, (1.0, 2.0)))
    assert spark.range(1).select(similarity.cosine(v, v), similarity.hunk_similarity(F.lit(""), F.lit(""), F.lit(""), F.lit(""))).first()[:] == (pytest.approx(1.0), None)
    assert similarity._indel("", "") == 1 and similarity._bleu([], ["a"]) == 0 and similarity.moving_match(["b", "a", "c"], ["a", "b", "c"]) == [1, -1, 2]


def test_similarity_joins(spark):
    left = spark.createDataFrame([(1, "return value;"), (2, "zzz")], "id int, t string")
    right = spark.createDataFrame([(5, "return values;"), (6, "return"), (7, "zzz")], "id int, t string")
    assert sorted((r.l_id, r.r_id) for r in similarity.edit_join(left, right, [], "t", 0.9).collect()) == [(1, 5), (2, 7)]
    assert sorted((r.l_id, r.r_id) for r in likeness.ratio_join(left, right.withColumn("k", F.lit(1)), [], "t", 0.95).collect()) == [(1, 5), (2, 7)]
    best = similarity.best_match(spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.9), ("a", 3, 0.9)], "k string, n int, s double"), ["k"], "s", ["n"])
    assert best.first().n == 2
    pairs = spark.createDataFrame([("m", 0, 0, 0.97, False), ("n", 0, 0, 0.6, True), ("n", 0, 1, 0.1, True), ("o", 0, 0, 0.6, False)], "k string, a_hunk int, b_hunk int, similarity double, message boolean")
    assert {r.k: r.match for r in similarity.hunk_sets_match(pairs, ["k"]).collect()} == {"m": True, "n": True, "o": False}
    said = spark.range(1).select(similarity.message_matches(F.lit("fix abc"), F.lit("abc"), F.lit("CVE-1"), F.lit("x")), similarity.message_matches(F.lit("Revert abc"), F.lit("abc"), F.lit("CVE-1"), F.lit("x")))
    assert tuple(said.first()) == (True, False)


@pytest.fixture(scope="module")
def edges(spark):
    #   a - b - d - e ; b - c - d (merge)
    rows = [("r", "a", None, 0), ("r", "b", "a", 0), ("r", "c", "b", 0), ("r", "d", "b", 0), ("r", "d", "c", 1), ("r", "e", "d", 0), ("r", "x", "a", 0)]
    return spark.createDataFrame(rows, "repo string, commit_id string, parent_id string, parent_idx int")


def test_graphs(spark, edges):
    up = graphs.closure(edges, "commit_id", "parent_id", ["repo"])
    assert {r.ancestor for r in up.where("child = 'e'").collect()} == {"a", "b", "c", "d"}
    rank = {r.commit_id: r["rank"] for r in graphs.ranks(edges, "commit_id", "parent_id", ["repo"]).collect()}
    assert rank["a"] < rank["b"] < rank["c"] < rank["d"] < rank["e"]
    pairs = spark.createDataFrame([("r", p, q) for p, q in ("ae", "ea", "xe", "ex", "aa")], "repo string, p string, q string")
    got = {(r.p, r.q): (r.earlier, r.strictly) for r in graphs.earlier(pairs, up, "p", "q", ["repo"]).collect()}
    assert got == {("a", "e"): (True, True), ("e", "a"): (False, False), ("x", "e"): (True, False), ("e", "x"): (True, False), ("a", "a"): (True, False)}
    assert {(r.p, r.q) for r in graphs.diverged(pairs, up, "p", "q", ["repo"]).collect()} == {("x", "e"), ("e", "x")}
    between = graphs.between(up, spark.createDataFrame([("r", "b", "e")], "repo string, lo string, hi string"), "lo", "hi", ["repo"])
    assert {r.commit_id for r in between.collect()} == {"c", "d", "e"}


def test_history(spark, edges):
    rank = graphs.ranks(edges, "commit_id", "parent_id", ["repo"])
    touched = spark.createDataFrame([("r", "f", 1), ("r", "f", 2)], "repo string, path string, line_no int")
    blame = spark.createDataFrame([("r", "f", 1, "b"), ("r", "f", 2, "d")], "repo string, path string, line_no int, origin_commit string")
    assert graphs.blamed(touched, blame, rank, ["repo"]).first().commit_id == "d" and graphs.blamed(touched, blame, rank, ["repo"], latest=False).first().commit_id == "b"
    versions = spark.createDataFrame([("r", "a", "1"), ("r", "b", "1"), ("r", "c", "2"), ("r", "d", None)], "repo string, commit_id string, version string")
    assert {(r.commit_id, r.version) for r in graphs.version_changes(versions, edges, ["repo"]).collect()} == {("c", "2"), ("d", None)}
    assert graphs.earliest_per_version(versions.where("version = '1'"), rank, ["repo"]).first().commit_id == "a"
    steps = spark.createDataFrame([("r", "e", 5, "d", 4), ("r", "d", 4, "b", 2), ("r", "b", 2, "e", 5)], "repo string, from_commit string, from_line int, commit_id string, line_no int")
    walked = graphs.walk_back(spark.createDataFrame([("r", "e", 5)], "repo string, commit_id string, line_no int"), steps, ["repo"])
    assert {(r.commit_id, r.line_no, r.depth) for r in walked.collect()} == {("e", 5, 0), ("d", 4, 1), ("b", 2, 2)}
    marks = spark.createDataFrame([("r", 1, "m1"), ("r", 5, "m5")], "repo string, at int, m string")
    found = graphs.nearest_earlier(spark.createDataFrame([("r", 0), ("r", 5), ("r", 9)], "repo string, at int"), marks, ["repo"], "at", ["m"])
    assert {r["at"]: r.mark_m for r in found.collect()} == {0: None, 5: "m5", 9: "m5"}
    sets = spark.createDataFrame([("p", 10, [1, 2]), ("p", 2, [2, 3]), ("p", 7, [9]), ("q", 2, [2])], "k string, i int, lines array<int>")
    got = {(r.k, r.key): r.lines for r in graphs.overlapping_sets(sets, ["k"], "i", "lines").collect()}
    assert got == {("p", "2@10"): [1, 2, 3], ("p", "7"): [9], ("q", "2"): [2]}


def test_results(spark):
    d = results.distribution(spark.createDataFrame([(n,) for n in (0, -1, None, 1, 2, 3, 101, 100)], "n int"), F.col("n")).orderBy("place").collect()
    assert [(r.bucket, r.n, r.percent) for r in d][:2] == [("1-2", 2, 40.0), ("3-4", 1, 20.0)] and d[-1].n == d[-2].n == 1 and len(d) == 9
    truth = spark.createDataFrame([("c", 0, [1, 2]), ("c", 1, [3])], "case_id string, idx int, lines array<int>")
    found = spark.createDataFrame([("c", 0, "t", [1, 2]), ("c", 1, "t", [3, 4])], "case_id string, idx int, tool string, lines array<int>")
    parts = results.compared(truth, found, spark.createDataFrame([("t",), ("u",)], "tool string"), ["case_id", "idx"])
    assert {(r.tool, r.idx): r.relation for r in parts.collect()} == {("t", 0): "Equal", ("t", 1): "Subset", ("u", 0): "Disjoint", ("u", 1): "Disjoint"}
    assert {r.tool: r.relation for r in results.rolled_up(parts, ["case_id", "tool"]).collect()} == {"t": "Intersecting", "u": "Disjoint"}
    ranges = spark.createDataFrame([(1, 200, "outer"), (10, 20, "inner"), (12, 13, None)], "start_line int, end_line int, name string").withColumn("f", F.lit("a"))
    points = spark.createDataFrame([("a", 12), ("a", 10), ("a", 150), ("a", 500)], "f string, line_no int")
    assert {r.line_no: r.name for r in results.innermost(points, ranges, ["f"], "line_no", default="global").collect()} == {12: "inner", 10: "inner", 150: "outer", 500: "global"}
    assert {r.line_no: r.name for r in results.innermost(points, ranges, ["f"], "line_no", open_start=True).collect()}[10] == "outer"
    with pytest.raises(Exception, match="no entry for"):
        results.looked_up(points, spark.createDataFrame([("b", 1)], "f string, x int"), "f").collect()
    parts = spark.createDataFrame([("p", 0, [], [], [], ["console"]), ("p", 1, [], [], ["x"], []), ("p", 2, [], [], [], ["x"]), ("p", 3, [], [], [], ["nowhere"])], "p string, i int, pre_def array<string>, pre_use array<string>, post_def array<string>, post_use array<string>")
    assert {r.i: r.label for r in results.dependency_labels(parts, ["p"], "i").collect()} == {0: 2, 1: 2, 2: 1, 3: 0}


def test_code(spark):
    js = 'function foo(x) {\n  return "}" + x;\n}\nconst bar = (a, b) => {\n  return a; // }\n};\nobj = { m: function () { return /}/; } };\nclass A {\n  run(q) {\n    return q;\n  }\n}\n'
    rows = code.functions(spark.createDataFrame([("f", js), ("g", None)], "file string, text string"), ["file"], "text").collect()
    assert {f.name: (f.start_line, f.end_line, f.params) for f in rows} == {"foo": (1, 3, "x"), "bar": (4, 6, "a, b"), "m": (7, 7, ""), "run": (9, 11, "q")}
    assert [f["name"] for f in code.c_functions("static int f(char *p)\n{\n  if (p) { return 1; }\n  return g(p);\n}\nint h;\n")] == ["f"]
    pair = spark.createDataFrame([("f", "int", "a", "g", "int", None)], "old_name string, old_ret string, old_params string, new_name string, new_ret string, new_params string")
    r = code.signature_changes(pair).first()
    assert (r.name_changed, r.params_changed, r.ret_changed) == (True, True, False)


def test_edits(spark):
    assert edits.offsets("aaa", "aa") == [0, 1] and edits.nth_replaced("a a a", "a", "b", 1) == "a b a" and edits.replaced_nearest("x\ny\nx\n", "x", "z", 3) == "x\ny\nz\n"
    assert edits.repaired([-1, 5, -1], ["a", "", "b", "", "c", "", "d"]) == [3, 5, 7]
    assert edits.absorbed([("p1", "b"), ("p2", "a b c"), ("p3", "x")]) == [(["p2", "p1"], "a b c"), (["p3"], "x")]
    assert edits.absorbed([("p1", ""), ("p2", ""), ("p1", "a"), ("p1", "ab"), ("p4", "b")]) == [(["p1", "p4"], "ab"), (["p1"], ""), (["p2"], "")]
    rows = spark.createDataFrame([("k", "x\ny\nx", "x", "z", 3, 0), ("k", "x\ny\nx", "y", "w", 2, 1)], "k string, text string, old string, new string, line int, ord int")
    assert edits.applied_edits(rows, ["k"]).first().text == "x\nw\nz"
    p = spark.range(1).select(edits.porting_prompt(F.lit("+a"), F.lit("code")), edits.rendered("{a}-{b}", a=F.lit("1"), b=F.lit(None))).first()
    assert "<add here>\ncode" in p[0] and p[1] == "1-"
