"""Detectors on small files: what each must find, and what it must leave alone."""

import pytest

from sparkwarden.functions import catalog as C
from sparkwarden.functions.facts import PythonFacts, javascript, javascript_facts, python_facts
from sparkwarden.operators import patterns as P
from sparkwarden.operators import python_code as PY
from sparkwarden.sources import readers as R


@pytest.fixture
def files(spark):
    return lambda *rows: spark.createDataFrame(list(rows), "file string, content string")


def found(df):
    return sorted((r.file, r.line, r.rule_id) for r in df.collect())


def test_line_rules_skip_comments_and_count_a_line_once(files):
    f = files(("a.js", "a.__proto__ = b; c['__proto__'] = d\r\n// a.__proto__ = b\n  /* x.__proto__ = */\nx.__proto__ = y"), ("b.ts", "// @ts-ignore\nlet é: any = ñ!.x"))
    assert found(P.line_findings(R.lines(f), C.JS_RULES)) == [("a.js", 1, "VP-JS-001"), ("a.js", 4, "VP-JS-001")]
    assert found(P.line_findings(R.lines(f), C.TS_RULES)) == [("b.ts", 1, "VP-TS-004"), ("b.ts", 2, "VP-TS-001"), ("b.ts", 2, "VP-TS-003")]


def test_redos_back_reference(files):
    f = files(("a.js", "new RegExp('(a+)' + '+')\nconst r = /(a+)+b/;"))
    assert ("a.js", 2, "VP-JS-002") in found(P.line_findings(R.lines(f), C.JS_RULES))


@pytest.mark.parametrize(("gap", "safe"), [(1, True), (20, True), (21, False)])
def test_origin_check_within_twenty_lines(files, gap, safe):
    f = files(("a.js", "addEventListener('message', h)\n" + "x\n" * (gap - 1) + "if (event.origin)"))
    assert (P.postmessage_findings(f).count() == 0) == safe


def test_go_offsets(files):
    text = 'a\n\n\nx, _ := os.Open(p)\nhttp.Get(a); http.Get(b)\nquery := "S" + x\ndb.Query("a" + b)'
    f = files(("a.go", text), ("empty.go", ""), ("none.go", None))
    got = found(P.content_findings(f, C.GO_RULES))
    assert got == [("a.go", 2, "VP-GO-014"), ("a.go", 5, "VP-GO-015"), ("a.go", 5, "VP-GO-015"), ("a.go", 6, "VP-GO-001")]


def test_go_secure_code_has_nothing_severe(files):
    f = files(("a.go", 'import "crypto/sha256"\nc := exec.Command("ls")\nrows, err := db.Query("SELECT ?", id)\ntls.Config{MinVersion: tls.VersionTLS12}'))
    assert [r for r in P.content_findings(f, C.GO_RULES).collect() if r.severity in ("high", "critical")] == []


def test_terraform_blocks():
    text = 'resource "a" "b" {\n  x {\n  }\n}\n  resource "c" "d" {}\n}\nresource "e" "f" {\n  never'
    assert [(b["start_line"], b["end_line"]) for b in P.terraform_blocks(text)] == [(1, 4), (5, 6)]


def test_infrastructure(files):
    tf = files(("a.tf", 'resource "aws_s3_bucket" "b" {\n}\nresource "aws_db_instance" "d" {\n storage_encrypted = true\n}\n cidr_blocks = ["0.0.0.0/0"]'))
    assert found(P.terraform_findings(tf, R.lines(tf))) == [("a.tf", 1, "VP-TF-001"), ("a.tf", 6, "VP-TF-002")]
    d = files(("d/Dockerfile", "FROM x:latest\nUSER root"), ("e/Dockerfile", "FROM x:1\nuser app"), ("f/Dockerfile", "# FROM x:latest"))
    assert found(P.dockerfile_findings(R.lines(d))) == [("d/Dockerfile", 1, "VP-DF-001"), ("d/Dockerfile", 1, "VP-DF-002"), ("d/Dockerfile", 2, "VP-DF-006")]
    k = files(("a.yaml", "apiVersion: 1\nkind: x\ncontainers:\nprivileged: true"), ("b.yaml", "privileged: true"))
    assert found(P.kubernetes_findings(k)) == [("a.yaml", 1, "VP-K8-005"), ("a.yaml", 4, "VP-K8-001")]


def test_scanners_pick_files(files):
    f = files(*[(n, "") for n in ("a/x.go", "a/x_test.go", "vendor/x.go", "a/y.tsx", "node_modules/y.ts", "Dockerfile.dev", "a/B.TF", "a/Containerfile", "a/z.yml", "p.py")])
    names = lambda s: sorted(r.file for r in R.scanned(f, s).collect())
    assert names("go") == ["a/x.go"] and names("typescript") == ["a/y.tsx"]
    assert names("iac") == ["Dockerfile.dev", "a/B.TF", "a/Containerfile", "a/z.yml"]
    assert R.scannable_count(f).first()[0] == 3


TAINT = [
    ("direct", "x = input()\neval(x)", [("x", "eval", 2, 1)]), ("alias", "x = input()\ny = x\neval(y)", []), ("reassigned", "x = input()\nx = 1\neval(x)", [("x", "eval", 3, 1)]),
    ("cleaned", "x = int(input())\neval(x)", []), ("twice", "x = input()\nx = open(p)\neval(x, x)", [("x", "eval", 3, 2)] * 2), ("late", "eval(x)\nx = input()", []),
    ("annotated", "x: str = input()\neval(x)", []), ("keyword", "x = input()\neval(source=x)", []), ("wrapped", "x = input()\neval(str(x))", []),
]


@pytest.mark.parametrize(("name", "code", "want"), TAINT)
def test_file_taint(files, name, code, want):
    got = PY.taint_findings(PythonFacts(files((name, code)))).collect()
    assert sorted((r.variable, r.sink, r.sink_line, r.source.line) for r in got) == want


def test_flows_stay_in_a_function_unless_propagated(files):
    code = "def a():\n    x = input()\n    b(1, x)\n\ndef b(p, q):\n    c(q)\n    os.popen(p)\n\ndef c(z):\n    eval(z)\n    a()"
    facts = PythonFacts(files(("m.py", code)))
    assert PY.flow_findings(facts).count() == 0
    got = PY.flow_findings(facts, propagate=True).collect()
    assert [(r.source_func, r.sink_func, r.sink, r.tainted_var, list(r.call_chain)) for r in got] == [("m.py::a", "m.py::c", "eval", "z", ["m.py::a", "m.py::b", "m.py::c"])]


def test_python_facts():
    f = python_facts("def f(api_key):\n    try:\n        with x:\n            for a in b: yaml.load(c, Loader=yaml.CSafeLoader)\n    except E:\n        monkey = g().h(u)\n")
    fn = f["functions"][0]
    assert (fn["cyclomatic"], fn["nesting"], fn["sensitive"], fn["length"]) == (5, 4, ["api_key", "monkey"], 1)
    assert [(c["callee"], c["safe_loader"]) for c in f["calls"]] == [("yaml.load", True), (".h", False), ("g", False)]
    assert python_facts("def (")["error"].startswith("SyntaxError") and python_facts(None)["calls"] == []


def test_javascript_facts(files):
    f = javascript_facts("function a(x) {\n  if (x) { escape(x); }\n  eval('eval(1)'); // eval(2)\n}\nconst b = function () { setTimeout(f); };\nnew Function(x); o.eval(y);")
    assert [(g["name"], g["lineno"], g["nesting"], g["validation"]) for g in f["functions"]] == [("a", 1, 1, ["escape"]), ("<anonymous>", 5, 0, [])]
    assert [(c["callee"], c["lineno"]) for c in f["calls"]] == [("eval", 3), ("setTimeout", 5)]
    assert javascript(files(("a.js", None)))[1].count() == 0


def test_calls_go_to_the_own_file_then_the_module_then_the_only_name(files):
    from sparkwarden.functions.facts import PythonFacts
    from sparkwarden.operators import python_code as PY

    main = "def run():\n    a = input()\n    helper(a)\n    util.clean(a)\n    lonely(a)\n    shared(a)\n\ndef helper(p):\n    eval(p)\n"
    util = "def clean(q):\n    exec(q)\n\ndef helper(p):\n    compile(p)\n\ndef shared(s):\n    eval(s)\n"
    other = "def clean(q):\n    eval(q)\n\ndef lonely(z):\n    deeper(z)\n\ndef deeper(w):\n    execfile(w)\n\ndef shared(s):\n    eval(s)\n"
    f = PythonFacts(files(("main.py", main), ("pkg/util.py", util), ("other.py", other)))
    got = {(r.sink_func, r.sink, len(r.call_chain)) for r in PY.flow_findings(f, propagate=True).collect()}
    assert got == {("main.py::helper", "eval", 2), ("pkg/util.py::clean", "exec", 2), ("other.py::deeper", "execfile", 3)}
