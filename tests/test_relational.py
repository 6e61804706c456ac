"""Scores, suppression, dependencies, advisories, reports, rules, learning, store, configuration and streaming."""

import json

import pytest
from pyspark.sql import functions as F

from sparkwarden.operators import advisories as A
from sparkwarden.operators import learning as L
from sparkwarden.operators import reports as R
from sparkwarden.operators import rules as RU
from sparkwarden.operators import scoring as S
from sparkwarden.operators import suppression as SU
from sparkwarden.operators.store import FindingStore
from sparkwarden.plans import config
from sparkwarden.sources.sinks import render
from sparkwarden.plans.scan import scan
from sparkwarden.sources import readers as SRC
from sparkwarden.streaming.incremental import new_findings


def test_scores(spark):
    df = spark.createDataFrame([("CRITICAL", "high", 0.9), ("odd", None, None), (None, "low", 1.0), ("low", "low", 0.03125)], "s string, c string, m double")
    got = [tuple(r) for r in df.select(S.severity_of(F.col("s")), S.confidence_of(F.col("c")), S.combined_score(S.severity_of(F.col("s")), S.confidence_of(F.col("c")), F.col("m"))).collect()]
    assert got == [(4, 3, 0.96), (2, 2, 0.4), (1, 1, 0.45), (1, 1, 0.062)]


def test_classification_takes_the_best_and_the_first(spark):
    schema = "dangerous_calls array<string>, weak_crypto_calls array<string>, cyclomatic_complexity int"
    df = spark.createDataFrame([(["execfile"], ["md5"], 20), (["input"], [], 3), ([], ["DES.new", "md5"], 0), (["os.system", "eval"], [], 0)], schema)
    assert [r.rule_id for r in S.classified(df).collect()] == ["PY-EXEC-001", "UNKNOWN", "PY-CRYPTO-002", "PY-CMDI-001"]


@pytest.mark.parametrize(("pattern", "path", "hit"), [
    ("build/", "src/build/x.py", True), ("build/", "my_build/x.py", False), ("build/", "build", False), ("*.log", "a/b.log", True), ("src/*.py", "src/a/b.py", True), ("**/test_*", "a/b/test_x", True),
    ("**/test_*", "test_x", True), ("src/**/x.py", "src/x.py", False), ("?.py", "a/b.py", True), ("[ab].py", "c.py", False), ("A.py", "a.py", False),
])
def test_ignore_patterns(spark, pattern, path, hit):
    assert spark.range(1).select(SU.ignored(F.lit(path), [pattern])).first()[0] == hit


def test_baseline_bounds(spark):
    f = spark.createDataFrame([(1, "a", 10, "R", "m"), (2, "a", 15, "R", "m"), (3, "a", 16, "R", "m"), (4, "b", 10, "R", "m"), (5, "a", None, "R", "m")], "ordinal int, file string, line int, rule_id string, message string")
    old = spark.createDataFrame([("a", 10, "R", "m")], "file string, line int, rule_id string, message string")
    assert {r.ordinal for r in SU.known(f, old).collect()} == {1, 2}
    assert {r.ordinal for r in SU.known(f, old, kind="left_anti").collect()} == {3, 4, 5}
    assert {r.ordinal for r in SU.known(f, old, 0).collect()} == {1}


def test_manifests(spark):
    rows = spark.createDataFrame([(1, x) for x in ("requests==2.0", "# no", "", "a.b==1", "x")], "project int, line string")
    assert sorted((r.name, r.version) for r in SRC.requirements(rows).collect()) == [("a", None), ("requests", "2.0"), ("x", None)]
    pkg = spark.createDataFrame([(1, '{"dependencies": {"a": "^1"}, "devDependencies": {"a": "~2"}}'), (2, "{")], "project int, json string")
    assert [(r.name, r.version) for r in SRC.package_json(pkg).collect()] == [("a", "2")]


def test_advisories(spark):
    rows = spark.createDataFrame([("a", 1, "low"), ("a", 2, "critical"), ("a", 3, "critical"), ("b", 4, "odd")], "name string, i int, severity string").withColumn("vuln_id", F.col("i").cast("string")).withColumn("cvss_score", F.lit(1.0))
    assert {r.name: (r.vuln_id, r.total_vulnerabilities) for r in A.most_severe(rows, ["name"], "i").collect()} == {"a": ("2", 3), "b": ("4", 1)}
    q = spark.createDataFrame([("k",), ("l",), ("m",)], "key string")
    cache = spark.createDataFrame([("k", 100.0), ("l", 0.0)], "key string, ts double")
    hit, ask = A.cached(q, cache, F.lit(86_450.0))
    assert [r.key for r in hit.collect()] == ["k"] and {r.key for r in ask.collect()} == {"l", "m"}


@pytest.fixture
def findings(spark):
    rows = [(i, f"src/f{i % 3}.py", i, "dangerous_function" if i % 2 else "taint_analysis", ["High", "low", None][i % 3], f"m|{i}", "eval", None if i % 4 else 0.9, "x", "R1", "CWE-1") for i in range(1, 31)]
    return spark.createDataFrame(rows, "ordinal bigint, file string, line bigint, type string, severity string, message string, sink string, vuln_score double, variable string, rule_id string, cwe string")


def test_reports(findings):
    report = json.loads(render(findings, "json", "p", 4))
    assert report["summary"]["total_findings"] == 30 == len(report["findings"]) and report["findings"][9]["id"] == "VP-0010"
    assert sum(report["summary"]["by_severity"].values()) == 30 and report["summary"]["suppressed_findings"] == 4 and report["metadata"]["scan_path"] == "p"
    assert report["findings"][1] == {"id": "VP-0002", "type": "taint_analysis", "severity": "high", "file": "src/f2.py", "line": 2, "message": "Tainted variable 'x' flows from source to dangerous sink 'eval'", "sink": "eval", "variable": "x"}
    text = render(findings, "markdown", "p", 3)
    assert text.count("| `src/") == 20 and "*10 more*" in text and "m\\|" in text and "**Suppressed**: 3" in text
    assert text.count("\n#### ") == 30 and " · CWE-1 · score 0.90" in text and text.count(" · `src/") == 30
    page = render(findings, "html")
    assert "&lt;" not in page and page.count("<tr>") == 30


def test_sarif(spark):
    rows = [
        (1, "taint_analysis", "a.py", 3, "x", None, None, "eval", ["1: input", "3: eval"], None, None), (2, "interprocedural_taint", "a.py", None, None, "y", None, "exec", None, ["f", "g"], 0.4),
        (3, "hardcoded_secret", "b.py", 9, "key", None, None, None, None, None, 0.9), (4, "function_analysis", None, None, None, None, "run", None, None, None, None),
    ]
    f = spark.createDataFrame(rows, "ordinal bigint, type string, file string, line bigint, variable string, tainted_var string, function string, sink string, trace array<string>, call_chain array<string>, vuln_score double")
    lines = spark.createDataFrame([("a.py", i, f"line {i}") for i in range(1, 6)], "file string, line_no bigint, line string")
    d = R.sarif_document(f, lines)
    doc = json.loads(d.head + d.sep.join(r["text"] for r in d.rows.orderBy("position").collect()) + d.tail)
    run = doc["runs"][0]
    assert doc["version"] == "2.1.0" and [r["id"] for r in run["tool"]["driver"]["rules"]] == ["VP001", "VP002", "VP003", "VP004"]
    one, two, three, four = run["results"]
    place = one["locations"][0]["physicalLocation"]
    assert place["artifactLocation"] == {"uri": "a.py", "uriBaseId": "%SRCROOT%"} and place["region"] == {"startLine": 3, "startColumn": 1, "snippet": {"text": "line 3"}}
    assert place["contextRegion"] == {"startLine": 1, "endLine": 5, "snippet": {"text": "line 1\nline 2\nline 3\nline 4\nline 5"}}
    assert one["properties"]["trace"] == ["1: input", "3: eval"] and one["fingerprints"] == {"sparkwarden/v1": "VP001/a.py/3/x"} and one["level"] == "error"
    assert two["message"]["text"] == "Interprocedural taint: 'y' reaches 'exec' via f -> g" and two["properties"] == {"confidence": 0.4, "callChain": ["f", "g"]} and two["ruleIndex"] == 1
    assert three["ruleId"] == "VP004" and "snippet" not in three["locations"][0]["physicalLocation"]["region"]
    assert four["fingerprints"]["sparkwarden/v1"] == "VP003///run" and "properties" not in four


@pytest.mark.parametrize("form", ["json", "sarif", "html", "text", "markdown"])
def test_written_reports_are_the_rendered_ones(findings, tmp_path, form):
    import re

    from sparkwarden.sources.sinks import write_report

    path = tmp_path / "r"
    for f in (findings, findings.limit(1), findings.limit(0)):
        write_report(f, str(path), form, "p")
        stamp = lambda x: re.sub(r'"scan_timestamp": "[^"]*"', "", x)
        assert stamp(path.read_text()) == stamp(render(f, form, "p"))


def test_ids_follow_the_order_over_partitions(spark):
    df = spark.range(2000).select((F.lit(5000) - F.col("id")).alias("ordinal"))
    got = sorted((r.ordinal, r.id) for r in R.numbered(df, splits=7).collect())
    assert [i for _, i in got] == [f"VP-{k:04d}" for k in range(1, 2001)]


def test_store(spark, findings, tmp_path):
    s = FindingStore(spark, str(tmp_path / "store"))
    assert s.stats()["total_scans"] == 0 and not s.delete_scan("none")
    a, b = s.add_scan(findings, "one", 3), s.add_scan(findings.limit(4), "two")
    assert [r.total_findings for r in s.get_scan(a).collect()] == [30]
    assert [r.id for r in s.get_findings(a, severity="low", number=2, size=3).collect()] == [10, 13, 16] or s.get_findings(a, severity="low", number=2, size=3).count() == 3
    assert s.list_scans(1, 1).count() == 1 and s.stats()["total_findings"] == 34
    stats = s.stats()
    assert stats["severity_distribution"] == {r["severity"]: r["n"] for r in s.findings.groupBy("severity").agg(F.count("*").alias("n")).collect()} and len(stats["recent_scans"]) == 2
    assert s.delete_scan(a) and s.stats()["total_findings"] == 4 and s.get_scan(b).count() == 1
    with pytest.raises(ValueError):
        s.list_scans(0)


def test_rules(tmp_path, spark):
    assert len(RU.load_all()) == 24 and RU.rule_table(spark).count() == 24
    (tmp_path / "a.yml").write_text("rules:\n- {id: VP-PY-001, name: x, severity: low, message: m, pattern: {type: function_call, name: eval}}\n- {id: bad, name: x}\n- {id: off, name: x, severity: low, message: m, enabled: false, pattern: {type: function_call, name: f}}\n")
    merged = RU.load_all([str(tmp_path)])
    assert len(merged) == 24 and next(r for r in merged if r["id"] == "VP-PY-001")["severity"] == "low"
    with pytest.raises(RU.RuleError):
        RU.load_folder(str(tmp_path), strict=True)


def test_learning(spark):
    rows = spark.createDataFrame([(i, "function_analysis", ["eval"] * (i % 2), i % 20) for i in range(60)], "i int, type string, dangerous_calls array<string>, cyclomatic_complexity int")
    x = L.features(rows, ["i"]).withColumn("label", F.col("i") % 2)
    assert x.columns[1:-1] == L.FEATURES
    scored = L.predict(L.train(x, L.FEATURES, trees=5), x)
    assert scored.where("vuln_score > 0.5 AND label = 1").count() == 30
    c = L.confusion(spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 1)], "d int, y int"), "d", "y").first()
    assert (c.tp, c.fp, c.tn, c.fn, c.precision, c.accuracy) == (1, 1, 1, 1, 0.5, 0.5)


def test_configuration(tmp_path):
    assert config.profile("DEEP").ml_scoring and not config.profile().ml_scoring
    with pytest.raises(ValueError):
        config.profile("none")
    (tmp_path / ".sparkwarden.yml").write_text("severity: {minimum: odd}\nscan: {languages: [cobol]}\n")
    raw, warn = config.load_config(str(tmp_path))
    assert raw["severity"]["minimum"] == "odd" and raw["scan"]["paths"] == ["."] and len(warn) == 2
    assert config.overridden(raw, {"output.format": "json", "output.file": None})["output"] == {"format": "json", "file": None}


def test_scan_end_to_end(spark, tmp_path):
    (tmp_path / "web").mkdir()
    (tmp_path / "a.py").write_text("def f():\n    x = input()\n    eval(x)\n")
    (tmp_path / "bad.py").write_text("def (\n")
    (tmp_path / "web" / "b.js").write_text("a.__proto__ = b; // sparkwarden-ignore-line\neval(c)\n")
    (tmp_path / "Dockerfile").write_text("FROM x:latest\n")
    got = scan(spark, str(tmp_path), show_suppressed=True).collect()
    kinds = {(r.type, r.suppression_reason) for r in got}
    assert {("function_analysis", None), ("taint_analysis", None), ("interprocedural_taint", None), ("prototype_pollution", "inline_ignore_line"), ("dangerous_call", None), ("iac_misconfiguration", None)} <= kinds
    assert got[0].rule_id == "PY-EVAL-001" and got[0].severity == "Critical"
    assert {r.file for r in got} == {"a.py", "web/b.js", "Dockerfile"}
    assert scan(spark, str(tmp_path), minimum="high", ignore=["*.py"]).count() == 0


def test_incremental_findings(spark, tmp_path):
    from sparkwarden.functions import catalog as C
    from sparkwarden.operators.patterns import line_findings

    rows = spark.createDataFrame([("a.js", "x.__proto__ = 1\ny.__proto__ = 2")], "file string, content string")
    rows.write.parquet(str(tmp_path / "in"))
    detect = lambda df: line_findings(SRC.lines(df), C.JS_RULES)
    old = detect(rows).where("line = 99")
    q = new_findings(spark, str(tmp_path / "in"), detect, str(tmp_path / "out"), str(tmp_path / "state"), old)
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_baseline_lines_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    f = [(i, rng.choice("ab"), rng.choice([None, *range(60)]), "t", rng.choice("mn")) for i in range(120)]
    old = [(rng.choice("ab"), rng.choice([None, *range(60)]), "t", rng.choice("mn")) for _ in range(25)]
    df, base = spark.createDataFrame(f, "ordinal int, file string, line bigint, type string, message string"), spark.createDataFrame(old, "file string, line bigint, type string, message string")
    for within in (0, 1, 5, 7):
        want = {i for i, a, n, t, m in f if any((a, t, m) == (x, y, z) and abs((n or 0) - (k or 0)) <= within for x, k, y, z in old)}
        assert {r.ordinal for r in SU.known(df, base, within).collect()} == want
        assert {r.ordinal for r in SU.known(df, base, within, "left_anti").collect()} == set(range(120)) - want


def test_rule_lookups(spark):
    t = RU.rule_table(spark)
    assert RU.rule_by_id(t, "VP-PY-001").first().names == ["eval"] and t.where(F.size("references") > 0).count() == 10
    assert RU.rules_for(t, "Python").count() + RU.rules_for(t, "javascript").count() == 24
    assert {r.id for r in RU.callees(t, "python").where("callee = 'eval'").collect()} == {"VP-PY-001"}
