"""Syntax trees of scripts: stated trees, functions, statements and names by scope."""

import pytest

from stratadiff.operators import syntax


def short(code):
    """The tree as nested text: kinds of named nodes, names and literals as they are."""
    rows = syntax.tree(code)
    below = {}
    for r in rows:
        below.setdefault(r[2], []).append(r)

    def show(r):
        inner = " ".join(show(b) for b in below.get(r[0], []))
        word = r[10] if r[10] is not None and not inner else r[4]
        return f"({word} {inner})" if inner else word

    return " ".join(show(b) for b in below.get(0, []))


TREES = {
    "": "",
    ";": "empty_statement",
    "a": "(expression_statement a)",
    "a + b * c - d": "(expression_statement (binary_expression (binary_expression a (binary_expression b c)) d))",
    "a ** b ** c": "(expression_statement (binary_expression a (binary_expression b c)))",
    "x = y ? 1 : 'z'": "(expression_statement (assignment_expression x (ternary_expression y 1 'z')))",
    "a.b?.c[d](e, ...f)": "(expression_statement (call_expression (subscript_expression (member_expression (member_expression a b) c) d) (arguments e (spread_element f))))",
    "var a = 1, b": "(variable_declaration (variable_declarator a 1) (variable_declarator b))",
    "let {a, b: [c = 2], ...d} = e": "(lexical_declaration (variable_declarator (object_pattern a (pair_pattern b (array_pattern (assignment_pattern c 2))) (rest_pattern d)) e))",
    "let\nx": "(lexical_declaration (variable_declarator x))",
    "let = 3": "(expression_statement (assignment_expression let 3))",
    "function f(a, b = 1, ...c) { return a }": "(function_declaration f (formal_parameters a (assignment_pattern b 1) (rest_pattern c)) (statement_block (return_statement a)))",
    "async function* g() {}": "(generator_function_declaration g formal_parameters statement_block)",
    "x => x": "(expression_statement (arrow_function x x))",
    "(a, {b}) => { }": "(expression_statement (arrow_function (formal_parameters a (object_pattern b)) statement_block))",
    "() => ({})": "(expression_statement (arrow_function formal_parameters (parenthesized_expression object)))",
    "async (a) => await a": "(expression_statement (arrow_function (formal_parameters a) (await_expression a)))",
    "(a, b)": "(expression_statement (parenthesized_expression (sequence_expression a b)))",
    "return\nx": "return_statement (expression_statement x)",
    "a\n++b": "(expression_statement a) (expression_statement (update_expression b))",
    "if (a) b; else { c }": "(if_statement (parenthesized_expression a) (expression_statement b) (else_clause (statement_block (expression_statement c))))",
    "for (const a of b) c": "(for_in_statement (lexical_declaration (variable_declarator a)) b (expression_statement c))",
    "for (var i = 0, n; i < n; i++) ;": "(for_statement (variable_declaration (variable_declarator i 0) (variable_declarator n)) (binary_expression i n) (update_expression i) empty_statement)",
    "for (;;) {}": "(for_statement statement_block)",
    "do a(); while (b)": "(do_statement (expression_statement (call_expression a arguments)) (parenthesized_expression b))",
    "try { a } catch { b } finally { c }": "(try_statement (statement_block (expression_statement a)) (catch_clause (statement_block (expression_statement b))) (finally_clause (statement_block (expression_statement c))))",
    "switch (a) { case 1: b; break; default: c }": "(switch_statement (parenthesized_expression a) (switch_body (switch_case 1 (expression_statement b) break_statement) (switch_default (expression_statement c))))",
    "l: while (1) continue l": "(labeled_statement l (while_statement (parenthesized_expression 1) (continue_statement l)))",
    "class A extends B { static x = 1; #p; get y() { } static { z } [k]() { } *g() {} }": "(class_declaration A B (class_body (field_definition x 1) (field_definition #p) (method_definition y formal_parameters statement_block) "
    "(class_static_block (statement_block (expression_statement z))) (method_definition (computed_property_name k) formal_parameters statement_block) (method_definition g formal_parameters statement_block)))",
    "({a, b: 1, c() {}, get d() { }, async e() { }, get: 2, ...f, [g]: h, 'i': j})": "(expression_statement (parenthesized_expression (object a (pair b 1) (method_definition c formal_parameters statement_block) (method_definition d formal_parameters statement_block) "
    "(method_definition e formal_parameters statement_block) (pair get 2) (spread_element f) (pair (computed_property_name g) h) (pair 'i' j))))",
    "`a${b + `c${d}`}e`": "(expression_statement (template_string (template_substitution (binary_expression b (template_string (template_substitution d))))))",
    "a = /[/}]{/g.test(b) / c": "(expression_statement (assignment_expression a (binary_expression (call_expression (member_expression /[/}]{/g test) (arguments b)) c)))",
    "// }\na /* { */": "comment (expression_statement a) comment",
    "new a.b(c).d": "(expression_statement (member_expression (new_expression (member_expression a b) (arguments c)) d))",
    "import a, {b as c} from 'd'": "(import_statement a (import_specifier b c) 'd')",
    "export default function () {}": "(export_statement (function_declaration formal_parameters statement_block))",
    "export const a = 1": "(export_statement (lexical_declaration (variable_declarator a 1)))",
    "[a, , b] = [b, a]": "(expression_statement (assignment_expression (array_pattern a b) (array b a)))",
    "a ) ; b": "ERROR (expression_statement b)",
    "if (\nx = 1\n": "ERROR",
    "typeof a === 'b' && !c": "(expression_statement (binary_expression (binary_expression (unary_expression a) 'b') (unary_expression c)))",
}


@pytest.mark.parametrize("code", TREES)
def test_tree(code):
    assert short(code) == TREES[code]


def test_intervals():
    rows = syntax.tree("function f() {\n  return [1, {a: () => 2}];\n}\n// end\n")
    for r in rows:
        inside = [x for x in rows if r[0] < x[0] <= r[1]]
        assert all(r[6] <= x[6] and x[7] <= r[7] and r[8] <= x[8] and x[9] <= r[9] for x in inside)
        assert {x[0] for x in rows if x[2] == r[0]} <= {x[0] for x in inside}
    assert [(r[4], r[8], r[9]) for r in rows if r[3] == 1] == [("function_declaration", 1, 3), ("comment", 4, 4)]


def test_deep_and_long():
    assert len(syntax.tree("(" * 300 + "a" + ")" * 300)) == 303
    assert len(syntax.tree(" + ".join("a" for _ in range(5000)))) == 2 + 9999
    assert syntax.tree("a(" * 100_000)[1][4] == "ERROR"


CODE = """function outer({ a, b: [c] }, ...rest) {
  const inner = (y) => { return y * c; };
  return rest.map(function (z) {
    return z + a;
  });
}
class K {
  static m(p = {}) { return p; }
}
mod.run = async function named() { return "}" + `${outer({})}`; };
let o = { key: function () {}, short() { } };
"""


def frames(spark, *codes):
    files = spark.createDataFrame([(f"s{i}", c) for i, c in enumerate(codes)], "id string, code string").repartition(2)
    return files, syntax.syntax(files, ["id"], "code")


def test_functions(spark):
    files, nodes = frames(spark, CODE, "", None, "f = 1")
    got = sorted(syntax.functions(files, ["id"], "code", nodes).collect(), key=lambda r: r.place)
    assert {r.id for r in got} == {"s0"}
    assert [(r.name, r.start_line, r.end_line, r.params, r.ret) for r in got] == [
        ("inner", 2, 2, "y", "y * c"), ("", 3, 5, "z", "z + a"), ("outer", 1, 6, "{ a, b: [c] }, ...rest", "rest.map(function (z) {\n    return z + a;\n  })"),
        ("m", 8, 8, "p = {}", "p"), ("mod.run", 10, 10, "", '"}" + `${outer({})}`'), ("short", 11, 11, "", ""),
    ]
    assert got[0].body == "(y) => { return y * c; }"


def test_statements_around(spark):
    code = "/* one\n two */\nif (a) {\n  b(\n    c,\n  );\n\n  d();\n}\n"
    files, nodes = frames(spark, code)
    places = spark.createDataFrame([("s0", n) for n in range(1, 12)], "id string, line_no int")
    got = {r.line_no: (r.first, r.last) for r in syntax.statements_around(places, files, ["id"], "code", nodes).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 9), 4: (4, 6), 5: (4, 6), 6: (4, 6), 8: (8, 8), 9: (3, 9)}


SCOPES = """var x = 1;
function f(y) {
  x = y + g;
  { let x = 2; use(x); }
  return () => x + late;
  var late;
}
try { q() } catch (e) { e.x = x; }
for (let i = 0; i < x; i++) { i; }
const h = function h2() { return h2 + h; };
undeclared = 5;
({ x: x, y }) ;
"""


def test_names_by_scope(spark):
    _, nodes = frames(spark, SCOPES)
    kinds = {r.node: (r.kind, r.first_line) for r in nodes.collect()}
    got = {}
    for r in syntax.names(nodes, ["id"]).collect():
        got.setdefault((r.name, r.line_no), []).append((r.role, kinds[r.binding] if r.binding is not None else None))
    program, f = ("program", 1), ("function_declaration", 2)
    assert got["x", 1] == [("var", program)]
    assert got["f", 2] == [("function", program)] and got["y", 2] == [("parameter", f)]
    assert got["x", 3] == [("assign", program)] and got["g", 3] == [("", None)] and got["y", 3] == [("", f)]
    assert sorted(got["x", 4]) == [("", ("statement_block", 4)), ("let", ("statement_block", 4))]
    assert got["x", 5] == [("", program)] and got["late", 5] == [("", f)] and got["late", 6] == [("var", f)]
    assert sorted(got["e", 8]) == [("", ("catch_clause", 8)), ("catch", ("catch_clause", 8))] and got["x", 8] == [("", program)]
    assert {b for _, b in got["i", 9]} == {("for_statement", 9)}
    assert sorted(got["h2", 10]) == [("", ("function_expression", 10)), ("self", ("function_expression", 10))]
    assert sorted(got["h", 10]) == [("", program), ("const", program)]
    assert got["undeclared", 11] == [("assign", program)]
    assert got["x", 12] == [("", program)] and got["y", 12] == [("", None)]


def test_names_in_ranges(spark):
    _, nodes = frames(spark, SCOPES, "a")
    ranges = spark.createDataFrame([("s0", 0, 3, 5), ("s0", 1, 1, 1), ("s0", 2, 50, 60), ("s1", 3, 1, 1)], "id string, r int, first int, last int")
    got = {r.r: (r["def"], r.use, r.def_bindings, r.use_bindings) for r in syntax.names_in_ranges(ranges, syntax.names(nodes, ["id"]), ["id"], ["r"]).collect()}
    block = next(r.node for r in nodes.where("id = 's0' AND kind = 'statement_block' AND first_line = 4").collect())
    f = next(r.node for r in nodes.where("id = 's0' AND kind = 'function_declaration'").collect())
    assert got[0] == (["x", "x"], ["y", "g", "use", "late"], [0, block], [f, -1, -1, f])
    assert got[1] == (["x"], [], [0], []) and got[2] == ([], [], [], []) and got[3] == ([], ["a"], [], [-1])
