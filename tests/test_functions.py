import pytest
from pyspark.sql import functions as F

from stratadiff.functions import sets
from stratadiff.functions import text as T


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(str(i)) for i, c in enumerate(columns))).first())


def ints(*x):
    return F.array(*(F.lit(v) for v in x)).cast("array<int>")


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [((), (), "Equal"), ((), (1,), "Subset"), ((1,), (), "Disjoint"), ((1, 2), (2, 1), "Equal"), ((1,), (1, 2), "Subset"), ((1, 2), (1,), "Superset"), ((1, 2), (2, 3), "Intersecting"), ((1,), (2,), "Disjoint"), ((-1, 3), (-1, 4), "Intersecting")],
)
def test_relation(spark, a, b, want):
    assert one(spark, sets.relation(ints(*a), ints(*b))) == (want,)


def test_rollup_and_measures(spark):
    s = lambda *x: F.array(*(F.lit(v) for v in x)).cast("array<string>")
    assert one(spark, sets.rolled_up(s()), sets.rolled_up(s("Subset", "Subset")), sets.rolled_up(s("Equal", "Subset"))) == ("Equal", "Subset", "Intersecting")
    assert one(spark, sets.jaccard(s(), s()), sets.jaccard(s("a", "b"), s("b", "c"))) == (1.0, pytest.approx(1 / 3))
    assert one(spark, sets.same_bag(ints(1, 1, 2), ints(2, 1, 1)), sets.same_bag(ints(1, 2), ints(1, 1, 2))) == (True, False)
    assert one(spark, sets.without(ints(3, 1, 3, 2), ints(2)), sets.filled_range(ints(5, 2)), sets.filled_range(ints())) == ([3, 1, 3], [2, 3, 4, 5], [])
    assert one(spark, sets.merged_contexts(s("abc", "b", "d")), sets.holds_part(s("abc"), F.lit("b"))) == ("abc\nd", True)


def test_lines(spark):
    t = F.lit("a\n\tb \nc\n")
    assert one(spark, T.lines_of(t), T.lines_of(t, False), T.normalized(F.lit("\t a\tb c "))) == (["a", "\tb ", "c", ""], ["a", "\tb ", "c"], "a\tbc")
    lines = T.lines_of(F.lit("a\nb\nc\nd"))
    assert one(spark, T.line_slice(lines, F.lit(2), F.lit(3)), T.replaced_lines(lines, F.lit(2), F.lit(3), F.array(F.lit("x"))), T.replaced_lines(lines, F.lit(-1), F.lit(-1), F.array(F.lit("x")))) == (["b", "c"], ["a", "x", "d"], ["a", "b", "c", "x"])
    assert one(spark, T.trivial_line(F.lit("  });")), T.trivial_line(F.lit(" // note")), T.trivial_line(F.lit("return x"))) == (True, True, False)
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX"):
        one(spark, T.lines_at(lines, ints(9)))


def test_names(spark):
    assert one(spark, *(T.patchable_source(F.lit(p), F.lit(a)) for p, a in [("src/a.js", False), ("src/a.min.js", False), ("latest/a.js", False), ("a.ts", False), ("a.js", True), ("a.json", False)])) == (True, False, False, True, False, False)
    assert one(spark, T.candidate_file(F.lit("lib/a.js")), T.candidate_file(F.lit("dist/a.js")), T.script_source(F.lit("a.ts")), T.c_source(F.lit("x/a.c"))) == (True, False, False, True)
    assert one(spark, T.commit_address(F.lit("https://github.com/o/r/pull/12/commits/abc#x")), T.patch_id(F.lit("https://h/o/r/commit/abc#diff-1")), T.without_fragment(F.lit("x")), T.owner_and_repo(F.lit("https://h/o/r/commit/abc"))) == ("https://github.com/o/r/commit/abc", "abc", "x", "o@r")
    assert one(spark, T.blame_commit(F.lit("^abc12 (x) 3")), T.log_commit(F.lit("x\ncommit abcdef1\n")), F.size(T.split_log(F.lit("commit abcdef1\na\ncommit abcdef2\nb"))), T.clean_tag(F.lit("v1.2.0-rc1"))) == ("abc12", "abcdef1", 2, "1.2.0")
    assert [tuple(r) for r in one(spark, T.rename_rows(F.lit("R100\ta\tb\nM\tc\nA\td")))[0]] == [("R", "b"), ("A", "d")]
    assert tuple(one(spark, T.case_name(F.lit("x/y/pkg_1.0.2")))[0]) == ("pkg", "1.0.2")
    assert one(spark, T.path_part(F.lit("a/b/c"), 2), T.path_part(F.lit("a"), 2)) == ("b", None)


def test_statuses(spark):
    assert one(spark, *(T.run_status(F.lit(t)) for t in ("Expected: 1\nReceived: 2", "PASS a.test.js", "x is not a function", "?"))) == ("True", "False#0", "False#1", "Check")
    assert one(spark, T.status_bit(F.lit("Check")), T.status_bit(F.lit("False#0"))) == (1, 0)
    assert one(spark, T.gate_status(F.lit(False), F.lit(1)), T.gate_status(F.lit(True), F.lit(501)), T.gate_status(F.lit(True), F.lit(500))) == ("False#3", "False#4", None)
    assert one(spark, T.locating_method(F.lit("v@m@tracking")), T.locating_method(F.lit("v@m@similarity-file")), T.locating_method(F.lit("x"))) == ("tracking", "similarity", None)


def test_fences(spark):
    cases = {"plain": "plain", "a\n```\nx\n```\nb": "x", "```javascript\nx\ny\n```": "x\ny", "```\nx\n```\nand\n```\ny\n```": "x\n```\nand\n```\ny", "see ```\nopen": "\nopen", "``````": ""}
    assert one(spark, *(T.fenced(F.lit(t)) for t in cases)) == tuple(cases.values())


def test_location_rows(spark):
    got = one(spark, *(T.location_row(F.lit(t)) for t in ("abc##[3, 1, 3]##0", "abc##[]##1", "abc##x##2", "a##[b]##0", "a##b")))
    assert [g and (g["id"], g["lines"]) for g in got] == [("abc##0", [3, 1]), ("abc##1", []), ("abc##2", []), None, None]


def test_json_and_numbers(spark):
    doc = F.lit('{"version": "1.0", "dependencies": {"a": "^1"}, "devDependencies": {"b": "2"}}')
    assert one(spark, T.package_dependencies(doc), T.package_field(doc, "license", "Unknown"), T.package_field(doc, "version")) == (["a:^1", "b:2"], "Unknown", "1.0")
    assert one(spark, T.first_weakness(F.lit('{"vulnerabilities":[{"cve":{"weaknesses":[{"description":[{"value":"CWE-79"}]}]}}]}'))) == ("CWE-79",)
    assert one(spark, T.table_cell(F.lit(11), F.lit(112)), T.day_gap(F.lit("2020-01-03").cast("date"), F.lit("2020-01-10").cast("date"))) == ("& 11 (9.82%)", 7)
    assert one(spark, T.port_message(F.lit("Backport of x")), T.port_message(F.lit("support"))) == (True, False)
    assert one(spark, T.is_pure_addition(F.lit("+a\n+b")), T.is_pure_addition(F.lit("+a\n-b"))) == (True, False)
