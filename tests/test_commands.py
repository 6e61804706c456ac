"""Command line and sinks."""

import json

from pyspark.sql import functions as F

from sparkwarden.__main__ import main
from sparkwarden.operators import learning as L
from sparkwarden.sources import readers, sinks


def test_scan_writes_reports_and_knows_its_baseline(spark, tmp_path, capsys):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.py").write_text("def f():\n    x = input()\n    eval(x)\n")
    path, out, base = str(tmp_path / "p"), str(tmp_path / "r.json"), str(tmp_path / "base")
    assert main(["scan", path, "--format", "json", "--output", out, "--save-baseline", base, "--fail-on", "critical"]) == 1
    report = json.load(open(out))
    assert report["summary"]["total_findings"] == 3 and {f["type"] for f in report["findings"]} == {"function_analysis", "taint_analysis", "interprocedural_taint"}
    assert spark.read.parquet(base).count() == 3
    assert main(["scan", path, "--format", "text"]) == 0 and "function_analysis" in capsys.readouterr().out
    assert main(["scan", path, "--profile", "none"]) == 2


def test_init_train_and_nvd(spark, tmp_path):
    assert main(["init", str(tmp_path)]) == 0 and main(["init", str(tmp_path)]) == 2
    (tmp_path / "l.csv").write_text("type,commit_count,label\ntaint_analysis,3,1\nbandit,0,0\nbandit,1,0\ntaint_analysis,2,1\n")
    assert main(["train", str(tmp_path / "l.csv"), str(tmp_path / "m")]) == 0
    (tmp_path / "n.json").write_text('{"vulnerabilities": [{"cve": {"id": "CVE-1", "descriptions": [{"lang": "en", "value": "d"}]}}]}')
    assert main(["extract-nvd", str(tmp_path / "n.json"), str(tmp_path / "n")]) == 0
    assert spark.read.csv(str(tmp_path / "n"), header=True).first().cve_id == "CVE-1"


def test_datasets_and_benchmark(spark, tmp_path):
    s = L.synthetic_samples(spark, {"a": (["bad1", "bad2"], ["good"]), "b": (["bad"], ["good", "fine"])}, 10)
    assert sinks.write_dataset(s, str(tmp_path / "d")) == {"total": 20, "vulnerable": 10, "types": {"a": 10, "b": 10}}
    assert readers.read_labelled(spark, str(tmp_path / "d" / "data")).count() == 20
    x = spark.createDataFrame([(1, 1, "a"), (2, 0, "a"), (3, 1, "b")], "id int, label int, type string")
    got = {r.grp: (r.tp, r.fp, r.tn, r.fn) for r in sinks.benchmark(x, spark.createDataFrame([(1,), (1,), (2,)], "id int")).collect()}
    assert got == {"a": (1, 1, 0, 0), "b": (0, 0, 0, 1), None: (1, 1, 0, 1)}
    p = sinks.synthetic_project(spark, 100)
    assert {r[0]: r[1] for r in p.groupBy(F.element_at(F.split("file", r"\."), -1)).count().collect()} == {"py": 60, "js": 30, "go": 10}


def test_labelled_findings(spark, tmp_path):
    f = spark.createDataFrame([("function_analysis", ["eval"], 3), ("bandit", [], 1)], "type string, dangerous_calls array<string>, cyclomatic_complexity int")
    sinks.write_labelled(f, str(tmp_path / "l"))
    assert sorted((r.type, r.label) for r in readers.read_labelled(spark, str(tmp_path / "l")).collect()) == [("bandit", 0), ("function_analysis", 1)]


def test_reports_list_all_findings(spark):
    import json

    from pyspark.sql import functions as F

    from sparkwarden.sources.sinks import render

    found = spark.range(5200).select(F.col("id").alias("ordinal"), F.concat(F.lit("f"), "id").alias("file"), F.lit(1).alias("line"), F.lit("R1").alias("rule_id"), F.lit("x").alias("type"), F.lit("high").alias("severity"), F.lit("m").alias("message"))
    assert len(json.loads(render(found, "sarif"))["runs"][0]["results"]) == 5200
    assert render(found, "html").count("<tr>") == 5200
    assert render(found, "text").count("[high] ") == 5200


def test_scan_with_all_that_is_known(spark, tmp_path, capsys, caplog):
    root = tmp_path / "pr(oj)+ x"
    (root / "build").mkdir(parents=True)
    (root / "a.py").write_text("def f():\n    x = input()\n    eval(x)\n")
    (root / "build" / "b.py").write_text("def g(y):\n    eval(y)\n")
    (root / "broken.py").write_text("def (:\n")
    (root / "w.js").write_text("a.__proto__ = b;\n")
    (root / "requirements.txt").write_text("left==1.0\nright>=2.0\n# no\n")
    (root / "package.json").write_text('{"dependencies": {"npm-one": "^1.0.0"}}')
    (root / "more").mkdir()
    (root / "more" / "r.yml").write_text("rules:\n- {id: OWN-1, name: own, severity: high, message: own rule, pattern: {type: function_call, name: input}}\n")
    (root / ".sparkwarden.yml").write_text(f"scan: {{exclude: ['build/*']}}\nrules: {{additional_dirs: ['{root / 'more'}'], disabled: [vp-js-001]}}\n")
    (tmp_path / "latest.csv").write_text("name,latest\nleft,2.0\nnpm-one,9.9\n")
    (tmp_path / "adv.json").write_text('{"name": "left", "version": "1.0", "severity": "high"}\n{"name": "npm-one", "version": "1.0.0", "severity": "low"}\n')
    (tmp_path / "commits.csv").write_text("file,author,ts\na.py,ann,2020-01-01 00:00:00\na.py,bob,2020-01-02 00:00:00\n")
    (tmp_path / "bandit.json").write_text('{"results": [{"filename": "a.py", "line_number": 3, "test_id": "B307", "issue_text": "eval", "issue_severity": "MEDIUM"}]}')
    out = str(tmp_path / "out.json")
    path = str(root / ".." / root.name)
    tables = ["--latest", str(tmp_path / "latest.csv"), "--advisories", str(tmp_path / "adv.json"), "--commits", str(tmp_path / "commits.csv"), "--bandit", str(tmp_path / "bandit.json")]
    assert main(["scan", path, "--format", "json", "--output", out, *tables]) == 0
    report = json.load(open(out))
    found = {(f["type"], f.get("file")) for f in report["findings"]}
    assert ("rule_match", "a.py") in found and ("bandit", "a.py") in found and {f for t, f in found if t == "dependencies"} == {"requirements.txt", "package.json"}
    assert not any(f and f.startswith("build/") for _, f in found) and not any(f == "w.js" and t == "prototype_pollution" for t, f in found)
    assert report["summary"]["suppressed_findings"] > 0
    assert "broken.py" in caplog.text
    # either form of a baseline knows every finding again
    for base in (str(tmp_path / "base"), str(tmp_path / "base.json")):
        assert main(["scan", path, "--format", "json", "--output", out, "--save-baseline", base, *tables]) == 0
        assert main(["scan", path, "--format", "json", "--output", str(tmp_path / "again.json"), "--baseline", base, *tables]) == 0
        again = json.load(open(tmp_path / "again.json"))
        assert again["findings"] == [] and again["summary"]["suppressed_findings"] >= len(report["findings"])


def test_dependencies_and_churn(spark, tmp_path):
    from pyspark.sql import functions as F

    from sparkwarden.plans.scan import scan_project

    (tmp_path / "requirements.txt").write_text("left==1.0\nright>=2.0\nplain\n")
    (tmp_path / "a.py").write_text("def f(x):\n    eval(x)\n")
    latest = spark.createDataFrame([("left", "2.0"), ("right", "2.0")], "name string, latest string")
    advisories = spark.createDataFrame([("left", "1.0", "medium"), ("left", "1.0", "critical")], "name string, version string, severity string")
    commits = spark.createDataFrame([("a.py", "x", "2020-01-01"), ("a.py", "y", "2020-01-03")], "file string, author string, ts string").withColumn("ts", F.to_timestamp("ts"))
    found, errors = scan_project(spark, str(tmp_path), latest=latest, advisories=advisories, commits=commits, now=F.lit("2020-01-13").cast("timestamp"))
    assert errors.isEmpty()
    rows = {r.type: r for r in found.collect()}
    d = rows["dependencies"]
    assert (d.num_vulnerable_dependencies, d.num_outdated_dependencies, d.max_dependency_severity, len(d.dependencies)) == (1, 1, "critical", 3)
    f = rows["function_analysis"]
    assert (f.commit_count, f.unique_authors, f.last_modified_days, d.commit_count) == (2, 2, 10, 0)


def test_each_file_is_parsed_once(spark, tmp_path):
    from sparkwarden.functions.facts import PythonFacts

    files = spark.createDataFrame([("a.py", "def f(x):\n    eval(x)\n")], "file string, content string")
    facts = PythonFacts(files)
    for table in (facts.functions, facts.calls, facts.assigns, facts.errors):
        assert "Python" not in table._jdf.queryExecution().executedPlan().toString()


def test_training_benchmark_and_timings(spark, tmp_path):
    from sparkwarden.plans import training as T

    summary = T.training_run(spark, str(tmp_path / "t"), 10)
    assert summary["dataset_metadata"]["total"] == 70 and summary["dataset_metadata"]["vulnerable"] == 35
    assert json.load(open(tmp_path / "t" / "cwe_mapping.json"))["CWE-89"]["severity"] and json.load(open(tmp_path / "t" / "pipeline_summary.json"))["pipeline_version"] == "1.0.0"
    result, details = T.benchmark_run(T.benchmark_samples(spark, 4), str(tmp_path / "b"))
    assert details.count() == 28 and {r.outcome for r in details.collect()} == {"TP", "TN", "FN"} and all(len(r.code_preview) <= 80 for r in details.collect())
    assert spark.read.json(str(tmp_path / "b" / "summary")).count() == 8
    run = T.timed_scans(spark, ["small_quick"])[0]
    assert run["file_count"] == 50 and run["passed"] == (run["elapsed_seconds"] <= 5.0) and run["files_per_second"] > 0


def test_advisory_cache(spark, tmp_path):
    from sparkwarden.operators.advisories import AdvisoryCache, answered

    cache = AdvisoryCache(spark, str(tmp_path / "cache"))
    asked = []

    def ask(open_):
        asked.append(sorted(r.key for r in open_.collect()))
        return open_.where("key <> 'c'").select("key", F.concat(F.lit("v"), "key").alias("vulns"))

    q = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, "c")], "position int, key string")
    get = lambda now: [(r.position, r.vulns) for r in answered(q, cache, ask, now).orderBy("position").collect()]
    assert get(100) == get(200) == [(0, "vb"), (1, "va"), (2, "vb"), (3, None)]
    assert asked == [["a", "b", "c"], ["c"]]
    assert get(100 + 90_000) and asked[-1] == ["a", "b", "c"]
    cache.clear()
    assert cache.rows().count() == 0


def test_vectors_and_own_embeddings(spark):
    rows = spark.createDataFrame([(1, "ab", 2.0, [0.5, 1.5]), (2, None, 3.0, None)], "id int, code string, length double, embedding array<float>")
    assert [r.vector for r in L.with_vectors(rows, ["length"]).orderBy("id").collect()] == [[2.0, 0.5, 1.5], [3.0]]
    made = L.embedded(rows.drop("embedding"), lambda texts: [[len(t), 1] for t in texts], 2)
    assert [list(r.embedding) for r in made.orderBy("id").collect()] == [[2.0, 1.0], [0.0, 1.0]]


def test_deep_scan_trains_on_its_own_findings(spark, tmp_path):
    from sparkwarden.plans.scan import scan

    for i in range(12):
        (tmp_path / f"f{i}.py").write_text("def f(x):\n    eval(x)\n" if i % 2 else "def f(x):\n    open(x)\n")
    rows = scan(spark, str(tmp_path), "deep", auto_train=True).where("type = 'function_analysis'").collect()
    assert len(rows) == 12 and min(r.vuln_score for r in rows if r.dangerous_calls) > max(r.vuln_score for r in rows if not r.dangerous_calls)
