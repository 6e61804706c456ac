"""JavaScript tokens in context: what begins a regular expression, templates, methods, statements."""

import pytest

from sparkwarden.functions.javascript import javascript_facts, tokens


def kinds(source, kind):
    return [t.text for t in tokens(source) if t.kind == kind]


@pytest.mark.parametrize("source,regexes", [
    ("a = /\"/; b", ['/"/']), ("a / b / c", []), ("a = b\n/ c / d", []), ("f(/[/\"]\\//g, 1)", ["/[/\"]\\//g"]), ("return /x/.test(y)", ["/x/"]),
    ("if (a) /x/.test(b)", ["/x/"]), ("(a) / b / c", []), ("a[0] / b / c", []), ("x = {a: 1} / 2 / 3", []), ("{ a }\n/x/.test(b)", ["/x/"]), ("a++ / b / c", []),
    ("typeof /x/", ["/x/"]), ("o.return / b / c", []), ("`${a / b}${/x/.y}` / 2", ["/x/"]), ("x = function () {} / 2 / 1", []), ("function f() {}\n/x/.y", ["/x/"]), ("1 / 2 / 3 / .5", []),
    ("a = b ? /x/ : /y/", ["/x/", "/y/"]), ("while (a) /x/.exec(b)", ["/x/"]), ("a.if(b) / c / d", []), ("// a /x/\n/* /y/ */ 'c' / 2", []), ("({a: /x/, b: [/y/]})", ["/x/", "/y/"]), ("a /= /x/", ["/x/"]),
])
def test_slashes(source, regexes):
    assert kinds(source, "regex") == regexes


def test_templates_to_any_depth():
    source = "a = `x ${ b(`y ${ c('}') } \\` $ {`) } z` + d`e`"
    assert kinds(source, "name") == ["a", "b", "c", "d"] and kinds(source, "string") == ["'}'"] and len(kinds(source, "template")) == 3
    assert [t.line for t in tokens("`a\n${b}\n`\nc") if t.kind == "name"] == [2, 4]


def facts(source):
    f = javascript_facts(source)
    return [(x["name"], x["lineno"], x["length"], x["nesting"], x["validation"]) for x in f["functions"]], [(c["callee"], c["lineno"]) for c in f["calls"]]


@pytest.mark.parametrize("body,n", [
    ("", 0), (";", 1), ("a; b; c", 3), ("a\nb\nc", 3), ("a +\nb\n.c()\n(d)", 1), ("let x = {\n a: 1,\n b() { return 1; }\n}\nlet y = [1,\n2]", 2), ("if (a) b; else c; d", 2), ("if (a) { b; c } else if (d) e\nelse { f }\ng", 2),
    ("for (let i = 0; i < n; i++) { a; b }\nfor (;;) c;", 2), ("do { a } while (b)\nc", 2), ("do a; while (b); c", 2), ("try { a } catch (e) { b } finally { c } d", 2), ("switch (a) { case 1: b; break; default: c } d", 2),
    ("function g() { a; b; c }\nclass C extends B { m() { a; b } }\nasync function h() { }", 3), ("return\na", 2), ("return a\n+ b", 1), ("x: for (;;) { break x }\ny", 2), ("a = function () { b; c; };\nd = () => { e; f };", 2),
    ("const t = `;\n;${ a;b }`\nu", 2), ("a = /;/\nb = 'x;y'", 2), ("i\n++\nj", 2), ("const {a, b} = c; let d", 2), ("while (a) if (b) c; else d\ne", 2), ("{ a; b } c", 2), ("throw new Error(a)\n", 1), ("import('x').then(y => { z; })", 1), ("a\n/ b / c", 1),
])
def test_statements(body, n):
    assert facts(f"function f(p, q = {{r: [1]}}) {{\n{body}\n}}")[0][0] == ("f", 1, n, facts(f"function f() {{\n{body}\n}}")[0][0][3], [])


def test_kinds_of_functions():
    source = """const a = function () { x; };
class C {
  m(q) { escape(q); }
  static async *gen() { y; z }
  get v() { return this.x }
  [w]() { }
  'k'() { }
}
const o = { r() { eval(s); }, t: function named() { ; }, u: (b) => { sanitize(b); c; }, setTimeout() { } };
(function () { unescape(d) })();
async function e() { }
x.function = 1; x.eval(y); new Function(z); if (f) { g() }
foo()
{ bar }
"""
    functions, calls = facts(source)
    assert functions == [
        ("<anonymous>", 1, 1, 0, []), ("<anonymous>", 3, 1, 0, ["escape"]), ("<anonymous>", 4, 2, 0, []), ("<anonymous>", 5, 1, 0, []), ("<anonymous>", 6, 0, 0, []), ("<anonymous>", 7, 0, 0, []),
        ("<anonymous>", 9, 1, 0, []), ("named", 9, 1, 0, []), ("<anonymous>", 9, 0, 0, []), ("<anonymous>", 10, 1, 0, ["unescape"]), ("e", 11, 0, 0, []),
    ]
    assert calls == [("eval", 9)]


def test_nesting_counts_blocks_not_values():
    source = "function f() { if (a) { for (;;) { b({c: {d: 1}}) } } g(() => { if (x) { y } }) }"
    assert facts(source)[0][0][3] == 2
    assert facts("function f() { function g() { if (a) { } } }")[0] == [("f", 1, 1, 2, []), ("g", 1, 1, 1, [])]


def test_calls_in_templates_and_not_in_literals():
    assert facts("a = `${eval(b)} eval(c)`; '/* eval(d) */'; /eval(e)/; // eval(f)\n/\"/; setTimeout(g, '\"')")[1] == [("eval", 1), ("setTimeout", 2)]


@pytest.mark.parametrize("source", [None, "", "}", ")))", "function", "function f(", "function f() {", "`${", "`${`", "'abc", "/* x", "/", "a = /x", "class", "if (", "{" * 3000, "(" * 3000 + ")" * 3000, "`${" * 500, "x ? y : " * 2000, "\\", "\x00", "do", "if", "else else", "try catch"])
def test_any_text_gives_something(source):
    javascript_facts(source)


def test_long_files_cost_linear_time():
    import time

    source = "function f(a) { if (a) { return a / 2 } }\nx = { m() { y; } };\n"
    start = time.perf_counter()
    javascript_facts(source * 500)
    first = time.perf_counter() - start
    start = time.perf_counter()
    assert len(javascript_facts(source * 4000)["functions"]) == 8000
    assert time.perf_counter() - start < 40 * first + 1
