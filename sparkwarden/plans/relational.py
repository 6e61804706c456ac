"""Queries over findings, dependencies, advisories and the store, with their SQL.

Findings are derived from the documents table by expressions that Spark and DuckDB share, so they grow with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.functions import catalog as C
from sparkwarden.functions.facts import PythonFacts
from sparkwarden.operators import advisories as A
from sparkwarden.operators import learning as L
from sparkwarden.operators import reports as R
from sparkwarden.operators import scoring as S
from sparkwarden.operators import store as ST
from sparkwarden.operators.rules import SCHEMA, merged_rules, parsed
from sparkwarden.operators.suppression import known
from sparkwarden.sources import readers as SRC
from sparkwarden.streaming.incremental import windowed_events

from .corpus import CODE_SQL, SNIPPETS, files, quoted
from .training import TEMPLATES, as_files, benchmark_run

#: column -> expression over documents
FINDING = {
    "ordinal": "doc_id",
    "file": "concat('src/', source, '/f', CAST(doc_id % 97 AS STRING), '.py')",
    "line": "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id % 400 + 1 END",
    "type": "CASE doc_id % 8 WHEN 0 THEN 'taint_analysis' WHEN 1 THEN 'interprocedural_taint' WHEN 2 THEN 'hardcoded_secret' WHEN 3 THEN 'dangerous_function' WHEN 4 THEN 'high_complexity' WHEN 5 THEN 'js_vulnerability' WHEN 6 THEN 'eval_usage_py' ELSE 'function_analysis' END",
    "severity": "CASE doc_id % 7 WHEN 0 THEN 'Critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'LOW' WHEN 4 THEN 'info' WHEN 5 THEN NULL ELSE 'weird' END",
    "confidence": "CASE doc_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'Medium' WHEN 2 THEN 'low' ELSE NULL END",
    "sink": "CASE doc_id % 6 WHEN 0 THEN 'eval' WHEN 1 THEN 'open' WHEN 2 THEN 'yaml.load' WHEN 3 THEN 'cursor.execute' WHEN 4 THEN 'print' ELSE NULL END",
    "variable": "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE concat('v', CAST(doc_id % 10 AS STRING)) END",
    "message": "concat('m', CAST(doc_id % 50 AS STRING))",
    "vuln_score": "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST(doc_id % 101 AS DOUBLE) / CAST(100 AS DOUBLE) END",
}
_F = "f AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in FINDING.items()) + " FROM documents)"


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(*[F.expr(e).alias(n) for n, e in FINDING.items()])


# fixed attributes by id, for classification and features
_CALLS = ["eval", "os.system", "execfile", "subprocess.Popen", "compile"]


def _attributes(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id")
    k = F.col("doc_id")
    none = F.array().cast("array<string>")
    call = F.element_at(F.array(*map(F.lit, _CALLS)), (k % 5 + 1).cast("int"))
    return d.select(
        "doc_id", F.lit("function_analysis").alias("type"), F.when(k % 4 == 0, F.array(call)).otherwise(none).alias("dangerous_calls"),
        F.when(k % 9 == 0, F.array(F.lit("dill.loads"))).otherwise(none).alias("deserialization_calls"), F.when(k % 6 == 0, F.array(F.lit("hashlib.md5"), F.lit("Crypto.Cipher.DES.new"))).otherwise(none).alias("weak_crypto_calls"),
        F.when(k % 10 == 0, F.array(F.lit("redirect"))).otherwise(none).alias("open_redirect_calls"), (k % 25).alias("cyclomatic_complexity"), (k % 8).alias("max_nesting_depth"), (k % 13 == 0).alias("sensitive_data_involved"),
        F.when(k % 5 != 0, (k % 101).cast("double") / 100).alias("vuln_score"),
    )


# in SQL, rules by rank: the first that holds and beats (low, low); ranks go severity, confidence, then order of matching
_RANKED = """CASE WHEN doc_id % 4 = 0 AND doc_id % 5 = 0 THEN 'PY-EVAL-001' WHEN doc_id % 4 = 0 AND doc_id % 5 = 1 THEN 'PY-CMDI-001' WHEN doc_id % 4 = 0 AND doc_id % 5 = 2 THEN 'PY-EXEC-001' WHEN doc_id % 4 = 0 AND doc_id % 5 = 3 THEN 'PY-CMDI-001'
  WHEN doc_id % 9 = 0 THEN 'PY-DESER-002' WHEN doc_id % 13 = 0 THEN 'PY-SECRET-001' WHEN doc_id % 6 = 0 THEN 'PY-CRYPTO-001' WHEN doc_id % 10 = 0 THEN 'PY-REDIR-001' WHEN doc_id % 25 > 15 THEN 'PY-COMPLEX-001' WHEN doc_id % 8 > 5 THEN 'PY-NESTING-001' ELSE 'UNKNOWN' END"""
_REGISTRY = "reg(rule_id, s, c, rule_description) AS (VALUES " + ", ".join(f"('{k}', {s}, {c}, {quoted(d)})" for k, (s, c, d) in {**C.REGISTRY, "UNKNOWN": (1, 1, "Unclassified finding")}.items()) + ")"


def classify_findings(spark, sf_dir):
    return S.classified(_attributes(spark, sf_dir)).select("doc_id", "rule_id", "severity", "confidence", "rule_description", "combined_score")


def combined_score(spark, sf_dir):
    f = findings(spark, sf_dir)
    return f.select("ordinal", S.combined_score(S.severity_of(F.col("severity")), S.confidence_of(F.col("confidence")), F.col("vuln_score")).alias("score"))


_SEV = "CASE WHEN severity IS NULL THEN 1 WHEN lower(severity) = 'low' THEN 1 WHEN lower(severity) = 'high' THEN 3 WHEN lower(severity) = 'critical' THEN 4 ELSE 2 END"
_CONF = "CASE WHEN lower(confidence) = 'low' THEN 1 WHEN lower(confidence) = 'high' THEN 3 ELSE 2 END"


def severity_views(spark, sf_dir):
    f, c = findings(spark, sf_dir), F.col
    return f.select(
        "ordinal", S.json_severity(c("type"), c("sink"), c("vuln_score")).alias("json"), S.markdown_severity(c("severity"), c("vuln_score")).alias("markdown"), S.html_severity(c("severity"), c("confidence")).alias("html"),
        S.sarif_level(c("type"), c("vuln_score")).alias("level"), S.sarif_rule(c("type")).alias("rule"), S.remediation(c("type")).alias("remediation"),
    )


def _score_sql(a, b, c, other):
    return f"CASE WHEN vuln_score >= 0.8 THEN '{a}' WHEN vuln_score >= 0.5 THEN '{b}' WHEN vuln_score IS NOT NULL THEN '{c}' ELSE {other} END"


_MD = f"CASE WHEN lower(severity) IN ('critical', 'high', 'medium', 'low', 'info') THEN lower(severity) ELSE {_score_sql('high', 'medium', 'low', chr(39) + 'medium' + chr(39))} END"
_JSON = _score_sql("high", "medium", "low", "CASE WHEN type = 'interprocedural_taint' OR sink IN ('eval', 'exec', 'os.system', 'subprocess.call', 'cursor.execute') THEN 'high' WHEN sink IN ('open', 'pickle.loads', 'yaml.load', 'marshal.loads') THEN 'medium' WHEN type = 'hardcoded_secret' THEN 'high' WHEN type = 'dangerous_function' THEN 'medium' ELSE 'low' END")
_HTML = "CASE WHEN lower(severity) IN ('critical', 'high', 'medium', 'low', 'info', 'unknown') THEN lower(severity) WHEN lower(confidence) = 'high' THEN 'high' ELSE 'medium' END"
_LEVEL = _score_sql("error", "warning", "note", "CASE WHEN type IN ('taint_analysis', 'interprocedural_taint', 'hardcoded_secret') THEN 'error' WHEN type = 'high_complexity' THEN 'note' ELSE 'warning' END")
_RULE = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.SARIF_RULES.items()) + " ELSE 'VP003' END"
_FIX = "CASE " + " ".join(f"WHEN contains(type, '{k}') THEN {quoted(v)}" for k, v in C.REMEDIATION.items()) + f" ELSE {quoted(C.REMEDIATION_DEFAULT)} END"


def messages(spark, sf_dir):
    f, c = findings(spark, sf_dir), F.col
    names = {"variable": c("variable"), "sink": c("sink"), "tainted_var": c("variable"), "function": c("sink")}
    return f.select("ordinal", R.message(c("type"), names, c("message")).alias("text"), R.location(c("file"), c("line")).alias("at"))


def min_severity_filter(spark, sf_dir):
    return S.at_least(findings(spark, sf_dir), "high").select("ordinal", "severity")


def top_findings(spark, sf_dir):
    return R.top_findings(findings(spark, sf_dir)).select("ordinal", "level", "file", "line")


def finding_details(spark, sf_dir):
    """The findings that Markdown tells in detail."""
    return R.finding_details(findings(spark, sf_dir)).select("ordinal", "level", "at", "text", "type", F.round("vuln_score", 4).alias("vuln_score"))


def severity_chart(spark, sf_dir):
    f = findings(spark, sf_dir)
    levels = ["critical", "high", "medium", "low", "info", "unknown"]
    return R.severity_counts(f, S.html_severity(F.col("severity"), F.lit(None).cast("string")), levels).where("n > 0")


def sarif_lines(spark, sf_dir):
    """SARIF results of the report, their fields read back."""
    rows = R.sarif_rows(findings(spark, sf_dir))
    schema = "ruleId string, ruleIndex bigint, level string, message struct<text:string>, locations array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:bigint>>>>, fingerprints map<string,string>, properties struct<confidence:double>"
    r = rows.select("ordinal", "position", F.from_json("json", schema).alias("r"))
    place = F.col("r.locations")[0]["physicalLocation"]
    return r.select(
        "ordinal", "position", F.col("r.ruleId").alias("rule"), F.col("r.ruleIndex").alias("rule_index"), F.col("r.level").alias("level"), F.col("r.message.text").alias("text"), place["artifactLocation"]["uri"].alias("uri"),
        place["region"]["startLine"].alias("line"), F.element_at("r.fingerprints", "sparkwarden/v1").alias("fingerprint"), F.col("r.properties.confidence").alias("confidence"),
    )


def top_files(spark, sf_dir):
    return R.top_counts(findings(spark, sf_dir), F.col("file"), R.TOP_FILES)


def top_types(spark, sf_dir):
    return R.top_counts(findings(spark, sf_dir), F.col("type"), R.TOP_TYPES)


def report_ids(spark, sf_dir):
    return R.numbered(findings(spark, sf_dir)).select("ordinal", "id")


def severity_counts(spark, sf_dir):
    f = findings(spark, sf_dir)
    return R.severity_counts(f, S.markdown_severity(F.col("severity"), F.col("vuln_score")), ["critical", "high", "medium", "low"])


def json_report(spark, sf_dir):
    return R.json_rows(findings(spark, sf_dir)).select("ordinal", "json")


def sarif_results(spark, sf_dir):
    return R.sarif_results(findings(spark, sf_dir)).select("ordinal", "rule", "rule_index", "level", "fingerprint")


def sarif_context(spark, sf_dir):
    fs = files(spark, sf_dir)
    f = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), F.replace(F.element_at(F.array(*[F.lit(n) for n, _ in SNIPPETS]), (F.col("doc_id") % len(SNIPPETS) + 1).cast("int")), F.lit("{}"), F.col("doc_id").cast("string")).alias("file"), (F.col("doc_id") % 6 + 1).alias("line"))
    return R.snippets(f, SRC.lines(fs))


def _halves(spark, sf_dir):
    f = findings(spark, sf_dir).select("ordinal", "file", "line", F.col("type"), "message")
    old = f.where("ordinal % 3 = 0").select("file", (F.col("line") + F.col("ordinal") % 12).alias("line"), "type", "message")
    return f, old


def baseline_exact(spark, sf_dir):
    f, old = _halves(spark, sf_dir)
    return known(f, old, 0).select("ordinal")


def baseline_fuzzy(spark, sf_dir):
    f, old = _halves(spark, sf_dir)
    return known(f, old).select("ordinal")


def baseline_new(spark, sf_dir):
    f, old = _halves(spark, sf_dir)
    return known(f, old, kind="left_anti").select("ordinal")


_OLD = f"WITH {_F}, o AS (SELECT file, type, message, coalesce(line + ordinal % 12, 0) AS line FROM f WHERE ordinal % 3 = 0) SELECT ordinal FROM f WHERE {{}} EXISTS (SELECT 1 FROM o WHERE o.file = f.file AND o.type = f.type AND o.message = f.message AND abs(coalesce(f.line, 0) - o.line) <= {{}})"
_REQUIREMENTS = ["requests==2.19.0", "flask>=1.0", "# comment", "", "numpy", "Django[argon2]==3.2", "pyyaml~=5.3.1  ", "  left-pad==1.0"]
_REQ_OUT = [("requests", "2.19.0"), ("flask", "1.0"), ("numpy", None), ("Django", None), ("pyyaml", "5.3.1"), ("left-pad", "1.0")]
_LATEST = [("requests", "2.31.0"), ("flask", "1.0"), ("numpy", "2.0"), ("pyyaml", "6.0")]
_ADVISORIES = [("requests", "2.19.0", "high"), ("requests", "2.19.0", "critical"), ("pyyaml", "5.3.1", "medium"), ("left-pad", "1.0", "unknown")]


def _projects(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("project"))


def deps_requirements(spark, sf_dir):
    """Packages of manifests: lines that all have, and two of each document's own."""
    own = F.expr("array(concat('lib', project, '==', project % 9, '.', project % 4, '  # pinned'), concat('dyn_', project % 13, CASE project % 3 WHEN 0 THEN concat('>=', project) WHEN 1 THEN concat('~=', project, ',<9') ELSE '' END))")
    rows = _projects(spark, sf_dir).select("project", F.explode(F.concat(F.array(*map(F.lit, _REQUIREMENTS)), own)).alias("line"))
    return SRC.requirements(rows)


def deps_package_json(spark, sf_dir):
    """Packages of JSON manifests: some that all have, and of each document's own one, in which the later section wins."""
    own = F.expr("concat(', \"p', project, '\": \"^', project % 5, '.1\"')")
    whole = F.concat(F.lit('{"dependencies": {"a": "^1.2.3", "b": "~2.0"'), own, F.lit('}, "devDependencies": {"b": ">=3.1", "c": "*"'), F.when(F.col("project") % 2 == 0, F.replace(own, F.lit("^"), F.lit("~9."))).otherwise(""), F.lit("}}"))
    rows = _projects(spark, sf_dir).select("project", F.when(F.col("project") % 7 == 0, "{broken").otherwise(whole).alias("json"))
    return SRC.package_json(rows)


def _report(spark, sf_dir):
    latest = F.broadcast(spark.createDataFrame(_LATEST, "name string, latest string"))
    adv = F.broadcast(spark.createDataFrame(_ADVISORIES, "name string, version string, severity string"))
    return A.dependency_report(deps_requirements(spark, sf_dir), latest, adv)


def dependency_report(spark, sf_dir):
    return _report(spark, sf_dir)


def dependency_summary(spark, sf_dir):
    return A.dependency_summary(_report(spark, sf_dir))


_OSV = [
    ("p0", '{"id": "GHSA-1", "summary": "s1", "aliases": ["CVE-1", "X-2", "CVE-3"], "database_specific": {"cvss_score": 9.1}, "references": [{"url": "u1"}, {"url": ""}, {"url": "u2"}, {"url": "u3"}, {"url": "u4"}], "affected": [{"ranges": [{"events": [{"introduced": "0"}, {"fixed": "1.2"}, {"fixed": "1.3"}]}, {"events": []}]}]}',
     ("GHSA-1", "s1", "CVE-1,CVE-3", "critical", 9.1, "u1,u2,u3", "0-1.3")),
    ("p1", '{"id": "GHSA-2", "details": "d2", "database_specific": {"severity": "MODERATE"}}', ("GHSA-2", "d2", "", "medium", None, "", "")),
    ("p2", '{"database_specific": {"score": 4.5}, "affected": [{"ranges": [{"events": [{"introduced": "2"}]}]}]}', ("UNKNOWN", "No description available", "", "medium", 4.5, "", "2-")),
]


def osv_parse(spark, sf_dir):
    texts = F.element_at(F.array(*[F.lit(j) for _, j, _ in _OSV]), (F.col("project") % 3 + 1).cast("int"))
    p = A.parsed_advisories(_projects(spark, sf_dir).select("project", texts.alias("json")))
    ranges = F.array_join(F.transform("affected_ranges", lambda r: F.concat(F.coalesce(r["introduced"], F.lit("")), F.lit("-"), F.coalesce(r["fixed"], F.lit("")))), ";")
    return p.select("project", "vuln_id", "summary", F.array_join("cve_ids", ",").alias("cves"), "severity", "cvss_score", F.array_join("advisory_urls", ",").alias("urls"), F.coalesce(ranges, F.lit("")).alias("ranges"))


def most_severe(spark, sf_dir):
    f = findings(spark, sf_dir).select(F.col("file").alias("package"), F.col("ordinal"), F.concat(F.lit("V"), F.col("ordinal").cast("string")).alias("vuln_id"), F.lower(F.coalesce("severity", F.lit("unknown"))).alias("severity"), F.col("vuln_score").alias("cvss_score"))
    return A.most_severe(f, ["package"], "ordinal").drop("cvss_score")


_NVD = '{"vulnerabilities": [{"cve": {"id": "CVE-1", "descriptions": [{"lang": "en", "value": "d1"}, {"lang": "es", "value": "x"}], "weaknesses": [{"description": [{"lang": "en", "value": "CWE-79"}, {"lang": "en", "value": "CWE-89"}]}, {"description": [{"lang": "en", "value": "CWE-1"}]}], "configurations": [{"nodes": [{"cpeMatch": [{"vulnerable": true, "criteria": "c1"}]}, {"cpeMatch": [{"vulnerable": true, "criteria": "c2"}]}]}]}}, {"cve": {"id": "CVE-2", "descriptions": [{"lang": "en", "value": "d2"}]}}]}'


def nvd_patterns(spark, sf_dir):
    rows = _projects(spark, sf_dir).select("project", F.lit(_NVD).alias("json"))
    p = SRC.nvd_patterns(rows)
    return p.groupBy("cve_id", "description", F.array_join("cwes", ",").alias("cwes"), F.array_join("products", ",").alias("products")).agg(F.count("*").alias("n"))


def cwe_map(spark, sf_dir):
    keys = [*C.CWE_RULES, "CWE-0"]
    k = F.element_at(F.array(*map(F.lit, keys)), (F.col("project") % len(keys) + 1).cast("int"))
    r = _projects(spark, sf_dir).select("project", k.alias("cwe")).withColumn("r", S.cwe_rule(F.col("cwe")))
    return r.select("project", "cwe", "r.rule_id", "r.type", "r.severity")


def cache_ttl(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    key = A.cache_key(F.lit("PyPI"), F.concat(F.lit("Pkg"), F.col("user_id").cast("string")), F.lit("1.0"))
    cache = e.groupBy("user_id").agg(F.max(F.unix_timestamp("ts")).alias("ts"))
    now = cache.agg(F.max("ts").alias("now")).withColumn("now", F.col("now"))
    rows = cache.select(key.alias("key"), "ts").crossJoin(F.broadcast(now))  # one row
    asked = rows.select("key", "now").withColumn("ask", F.lit(1))
    fresh, _ = A.cached(asked, rows.select("key", "ts"), F.col("now"))
    return rows.join(fresh.select("key", F.lit(True).alias("hit")), "key", "left").select("key", "ts", F.coalesce("hit", F.lit(False)).alias("hit"))


def churn_features(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(F.concat(F.lit("f"), (F.col("event_id") % 200).cast("string")).alias("file"), F.col("user_id").alias("author"), "ts")
    return SRC.churn(e, F.lit("2030-01-01 00:00:00").cast("timestamp"))


def auto_label(spark, sf_dir):
    a = _attributes(spark, sf_dir)
    return a.select("doc_id", S.auto_label(F.col("dangerous_calls"), F.col("cyclomatic_complexity"), F.col("max_nesting_depth"), F.col("type")).alias("label"))


def features_matrix(spark, sf_dir):
    return L.features(_attributes(spark, sf_dir), ["doc_id"])


def features_findings(spark, sf_dir):
    """Features of findings of every type, with traces, chains, churn and dependencies."""
    k = F.col("ordinal")
    some = lambda n: F.transform(F.slice(F.array(*map(F.lit, "abcd")), 1, (k % n).cast("int")), lambda x: x)
    f = findings(spark, sf_dir).withColumn("type", F.when(k % 9 == 8, "dependencies").otherwise(F.col("type")))
    f = f.withColumns({
        "trace": some(4), "call_chain": some(3), "var_trace": some(5), "dependencies": some(4), "input_validation": some(2), "length": F.when(k % 6 == 0, float("nan")).when(k % 6 == 1, float("inf")).otherwise(k % 60),
        "commit_count": k % 17, "unique_authors": k % 5, "last_modified_days": F.when(k % 7 != 0, k % 400), "num_vulnerable_dependencies": k % 3, "num_outdated_dependencies": k % 2,
        "max_dependency_severity": F.element_at(F.array(*map(F.lit, ("critical", "high", "medium", "low", "unknown"))), (k % 5 + 1).cast("int")), "num_sensitive_vars": k % 8,
    })
    return L.features(f, ["ordinal"])


def rf_score(spark, sf_dir):
    """Scores of the held part of the findings by a model of the others, with their automatic labels."""
    rows = L.labelled_features(_attributes(spark, sf_dir), ["doc_id"])
    model = L.train(rows, L.FEATURES, trees=20)
    return L.predict(model, L.split(rows, L.FEATURES)[1]).select("doc_id", "label", F.round("vuln_score", 6).alias("vuln_score"))


def confusion_by_lang(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id").select("lang", "toxic", (F.col("doc_id") % 3 == 0).cast("int").alias("detected"))
    return L.confusion(d, "detected", "toxic", "lang")


def synthetic_samples(spark, sf_dir):
    """A labelled sample of code for each document."""
    return L.samples_of(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", TEMPLATES)


def benchmark_detection(spark, sf_dir):
    """What the scan finds in these samples, by kind and in all."""
    samples = synthetic_samples(spark, sf_dir).withColumn("id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    return benchmark_run(as_files(samples))[0].select("grp", "tp", "fp", "tn", "fn")


def embedding_vectors(spark, sf_dir):
    """Static features and embedding in one vector, its length and sum."""
    e = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    rows = L.features(_attributes(spark, sf_dir), ["doc_id"]).join(e, "doc_id", "left")
    v = L.with_vectors(rows, L.FEATURES)
    return v.select("doc_id", F.size("vector").cast("bigint").alias("size"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


def code_context(spark, sf_dir):
    fs = SRC.scanned(files(spark, sf_dir), "python")
    n = F.element_at(F.array(*[F.lit(n) for n, _ in SNIPPETS]), (F.col("doc_id") % len(SNIPPETS) + 1).cast("int"))
    f = _table(spark, sf_dir, "documents").select("doc_id", n.alias("n")).where("n LIKE '%.py'")
    f = f.select(F.col("doc_id").alias("ordinal"), F.replace("n", F.lit("{}"), F.col("doc_id").cast("string")).alias("file"), (F.col("doc_id") % 9 + 1).alias("line"))
    return L.code_context(f, SRC.lines(fs), PythonFacts(fs).functions)


def embedding_join(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ordinal"), "embedding")
    f = L.with_embeddings(findings(spark, sf_dir).select("ordinal"), e, "ordinal", 64)
    return f.select("ordinal", F.size("embedding").cast("bigint").alias("size"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 4).alias("norm"))


def _stored(spark, sf_dir):
    """Events as findings of scans (one for each user)."""
    e = _table(spark, sf_dir, "events")
    sev = F.element_at(F.array(*map(F.lit, ("critical", "high", "medium", "low", "odd"))), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("s"), (F.col("user_id") % 50).cast("string")).alias("scan_id"), sev.alias("severity"), F.col("event_type").alias("type"))


_E = "e AS (SELECT event_id AS id, 's' || CAST(user_id % 50 AS VARCHAR) AS scan_id, CASE event_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'odd' END AS severity, event_type AS type FROM events)"


def store_scan_counts(spark, sf_dir):
    return ST.scan_counts(_stored(spark, sf_dir), "scan_id")


def store_stats(spark, sf_dir):
    return ST.stat_rows(_stored(spark, sf_dir))


def store_page(spark, sf_dir):
    rows = ST.filtered(_stored(spark, sf_dir), "high", "click")
    return ST.page(rows, [F.col("id")], 3, 20)


def store_pages(spark, sf_dir):
    return ST.pages(ST.filtered(_stored(spark, sf_dir), "high"), 50)


def store_delete(spark, sf_dir):
    s = _stored(spark, sf_dir)
    gone = spark.createDataFrame([("s1",), ("s7",)], "scan_id string")
    return ST.without(s, F.broadcast(gone), "scan_id").groupBy("scan_id").agg(F.count("*").alias("n"))


def union_analyzers(spark, sf_dir):
    a = _table(spark, sf_dir, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), F.length("text").cast("bigint").alias("size"))
    b = _table(spark, sf_dir, "pages").select(F.lit("pages").alias("source"), F.col("page_id").alias("id"), "url")
    c = _table(spark, sf_dir, "conversations").select(F.lit("conversations").alias("source"), F.col("conv_id").alias("id"), F.length("text").cast("bigint").alias("size"))
    u = a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)
    return u.groupBy("source").agg(F.count("*").alias("n"), F.count("url").alias("with_url"), F.sum("size").alias("size"))


def rules_merge(spark, sf_dir):
    one = {"id": "A", "name": "a", "severity": "high", "message": "m", "pattern": {"type": "function_call", "name": "f"}}
    base = spark.createDataFrame([parsed(one), parsed({**one, "id": "B"})], SCHEMA)
    user = spark.createDataFrame([parsed({**one, "id": "B", "severity": "low"}), parsed({**one, "id": "C"})], SCHEMA)
    m = merged_rules(base, user).select("id", "severity", F.explode("names").alias("callee"))
    return _projects(spark, sf_dir).crossJoin(F.broadcast(m)).groupBy("id", "severity", "callee").agg(F.count("*").alias("n"))  # three rules


def events_windowed(spark, sf_dir):
    return windowed_events(_table(spark, sf_dir, "events"), "1 day")


_NAMES = """classify_findings combined_score severity_views messages min_severity_filter top_findings finding_details severity_chart sarif_lines top_files top_types report_ids severity_counts json_report sarif_results sarif_context baseline_exact
    baseline_fuzzy baseline_new deps_requirements deps_package_json dependency_report dependency_summary osv_parse most_severe nvd_patterns cwe_map cache_ttl churn_features auto_label features_matrix features_findings rf_score confusion_by_lang
    synthetic_samples benchmark_detection code_context embedding_join embedding_vectors store_scan_counts store_stats store_page store_pages store_delete union_analyzers rules_merge events_windowed""".split()
QUERIES = {k: globals()[k] for k in _NAMES}


def _lit(v) -> str:
    return "NULL" if v is None else quoted(v) if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else f"CAST({v} AS BIGINT)"


def _rows(rows) -> str:
    return ", ".join("(" + ", ".join(_lit(x) for x in r) + ")" for r in rows)


_REQ = f"r(name, version) AS (VALUES {_rows(_REQ_OUT)}), d AS (SELECT doc_id AS project, name, version FROM documents, r UNION ALL SELECT doc_id, 'lib' || doc_id, (doc_id % 9) || '.' || (doc_id % 4) FROM documents UNION ALL SELECT doc_id, 'dyn_' || (doc_id % 13), CASE WHEN doc_id % 3 < 2 THEN CAST(doc_id AS VARCHAR) END FROM documents)"
_REP = f"""{_REQ}, l(name, latest) AS (VALUES {_rows(_LATEST)}), a(name, version, severity, k) AS (VALUES {_rows([(*x, A.RANK[x[2]]) for x in _ADVISORIES])}), w AS (SELECT name, version, arg_min(severity, k) AS severity FROM a GROUP BY 1, 2),
x AS (SELECT project, d.name, d.version, coalesce(latest IS NOT NULL AND d.version IS NOT NULL AND latest <> d.version, FALSE) AS outdated, severity IS NOT NULL AS vulnerable, severity FROM d LEFT JOIN l ON d.name = l.name LEFT JOIN w ON d.name = w.name AND d.version = w.version)"""
_RANKS = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'unknown' THEN 4 ELSE 99 END"
_ratio = lambda a, b: f"round(CASE WHEN {b} = 0 THEN 0 ELSE CAST({a} AS DOUBLE) / ({b}) END, 4)"
_P, _R = "CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fp) END", "CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fn) END"
_SAMPLES = f"""t(kind, label, template, size, type, code) AS (VALUES {_rows([(i, y, t, len(g), k, code) for i, (k, (bad, good)) in enumerate(TEMPLATES.items()) for y, g in ((1, bad), (0, good)) for t, code in enumerate(g)])}),
x AS (SELECT doc_id, code, label, type, template FROM documents JOIN t ON doc_id % {len(TEMPLATES)} = kind AND doc_id // {len(TEMPLATES)} % 2 = label AND doc_id // {2 * len(TEMPLATES)} % size = template)"""
_FEATURE = {"dangerous_calls": "CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END", "cyclomatic_complexity": "doc_id % 25", "max_nesting_depth": "doc_id % 8", "sensitive_data_involved": "CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END"}
_KIND = "CASE WHEN ordinal % 9 = 8 THEN 'dependencies' ELSE type END"
_of = lambda kind, v: f"CASE WHEN kind = '{kind}' THEN {v} ELSE 0 END"
_VALUES = {
    "length": "CASE WHEN ordinal % 6 < 2 THEN 0 ELSE ordinal % 60 END", "input_validation": "ordinal % 2", "dependency_count": _of("dependencies", "ordinal % 4"), "taint_path_to_sink": _of("taint_analysis", 1),
    "taint_path_length": _of("taint_analysis", "ordinal % 4"), "interprocedural_taint_path": _of("interprocedural_taint", 1), "interprocedural_call_chain_length": _of("interprocedural_taint", "ordinal % 3"),
    "interprocedural_var_trace_length": _of("interprocedural_taint", "least(ordinal % 5, 4)"), "commit_count": "ordinal % 17", "unique_authors": "ordinal % 5", "last_modified_days": "CASE WHEN ordinal % 7 <> 0 THEN ordinal % 400 ELSE 0 END",
    "num_vulnerable_dependencies": _of("dependencies", "ordinal % 3"), "num_outdated_dependencies": _of("dependencies", "ordinal % 2"), "max_dependency_severity": _of("dependencies", "4 - ordinal % 5"), "num_sensitive_vars": "ordinal % 8",
    "taint_finding_count": "(SELECT count(*) FROM g WHERE kind = 'taint_analysis')",
}
_FEATURES_SQL = f"WITH {_F}, g AS (SELECT *, {_KIND} AS kind FROM f) SELECT ordinal, " + ", ".join(f"CAST({_VALUES.get(n, 0)} AS DOUBLE) AS {n}" for n in L.FEATURES) + " FROM g"
#: What the scan does not find: SQL by name alone is in no dictionary of calls.
_MISSED = "type = 'sql_injection' AND template = 0"
_ONE = f"{_F}, s AS (SELECT *, {_SEV} AS sv, {_CONF} AS cf FROM f)"

def _field(name: str, value: str, text: bool = True) -> str:
    """A field of a JSON object in SQL, left out if it is null."""
    shown = f"""'"' || {value} || '"'""" if text else f"CAST({value} AS VARCHAR)"
    return f"""CASE WHEN {value} IS NULL THEN '' ELSE ',"{name}":' || {shown} END"""


_MESSAGE = """CASE type WHEN 'taint_analysis' THEN 'Tainted variable ''' || coalesce(variable, 'unknown') || ''' flows from source to dangerous sink ''' || coalesce(sink, 'unknown') || ''''
  WHEN 'interprocedural_taint' THEN 'Interprocedural taint flow: ? reaches sink ''' || coalesce(sink, '?') || ''' via call chain' WHEN 'dangerous_function' THEN 'Dangerous function call: unknown'
  WHEN 'hardcoded_secret' THEN 'Hardcoded secret detected: ' || coalesce(variable, '?') WHEN 'high_complexity' THEN 'High cyclomatic complexity: ?' ELSE message END"""
_JSON_PARTS = " || ".join([
    _field("type", "type"), _field("severity", _JSON), _field("file", "file"), _field("line", "line", False), _field("message", _MESSAGE),
    _field("sink", "CASE WHEN type IN ('taint_analysis', 'interprocedural_taint') THEN coalesce(sink, 'unknown') END"),
    _field("variable", "CASE type WHEN 'interprocedural_taint' THEN 'unknown' WHEN 'taint_analysis' THEN coalesce(variable, 'unknown') WHEN 'hardcoded_secret' THEN coalesce(variable, 'unknown') END"),
    _field("function", "CASE WHEN type = 'dangerous_function' THEN 'unknown' END"), _field("confidence", "vuln_score", False),
])

ORACLE = {
    "classify_findings": f"WITH {_REGISTRY}, x AS (SELECT doc_id, {_RANKED} AS rule_id, CASE WHEN doc_id % 5 = 0 THEN 0.5 ELSE CAST(doc_id % 101 AS DOUBLE) / 100 END AS ml FROM documents) SELECT doc_id, x.rule_id, ['Low', 'Medium', 'High', 'Critical'][s] AS severity, ['Low', 'Medium', 'High'][c] AS confidence, rule_description, round_even(CAST(0.05 AS DOUBLE) * s * c + CAST(0.4 AS DOUBLE) * ml, 3) AS combined_score FROM x JOIN reg ON x.rule_id = reg.rule_id",
    "combined_score": f"WITH {_ONE} SELECT ordinal, round_even(greatest(0.0, least(1.0, CAST(0.05 AS DOUBLE) * sv * cf + CAST(0.4 AS DOUBLE) * coalesce(vuln_score, 0.5))), 3) AS score FROM s",
    "severity_views": f"WITH {_F} SELECT ordinal, {_JSON} AS json, {_MD} AS markdown, {_HTML} AS html, {_LEVEL} AS level, {_RULE} AS rule, {_FIX} AS remediation FROM f",
    "messages": f"""WITH {_F} SELECT ordinal, CASE type WHEN 'taint_analysis' THEN 'Tainted variable ''' || coalesce(variable, 'unknown') || ''' flows from source to dangerous sink ''' || coalesce(sink, 'unknown') || ''''
  WHEN 'interprocedural_taint' THEN 'Interprocedural taint flow: ' || coalesce(variable, '?') || ' reaches sink ''' || coalesce(sink, '?') || ''' via call chain' WHEN 'dangerous_function' THEN 'Dangerous function call: ' || coalesce(sink, 'unknown')
  WHEN 'hardcoded_secret' THEN 'Hardcoded secret detected: ' || coalesce(variable, '?') ELSE message END AS text, '`' || file || CASE WHEN line IS NULL THEN '' ELSE ':' || CAST(line AS VARCHAR) END || '`' AS at FROM f""",
    "min_severity_filter": f"WITH {_ONE} SELECT ordinal, severity FROM s WHERE sv >= 3",
    "top_findings": f"WITH {_F}, m AS (SELECT *, {_MD} AS level FROM f) SELECT ordinal, level, file, line FROM m ORDER BY CASE level WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, coalesce(vuln_score, 0) DESC, ordinal LIMIT 20",
    "finding_details": f"WITH {_F}, m AS (SELECT *, {_MD} AS level FROM f) SELECT ordinal, level, '`' || file || CASE WHEN line IS NULL THEN '' ELSE ':' || CAST(line AS VARCHAR) END || '`' AS at, message AS text, type, round(vuln_score, 4) AS vuln_score FROM m ORDER BY CASE level WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, coalesce(vuln_score, 0) DESC, ordinal LIMIT 50",
    "severity_chart": f"WITH {_F} SELECT level AS severity, count(*) AS n FROM (SELECT CASE WHEN lower(severity) IN ('critical', 'high', 'medium', 'low', 'info', 'unknown') THEN lower(severity) ELSE 'medium' END AS level FROM f) GROUP BY level",
    "sarif_lines": f"""WITH {_F}, r AS (SELECT *, {_RULE} AS rule, {_LEVEL} AS level FROM f) SELECT ordinal, row_number() OVER (ORDER BY ordinal) AS position, rule, dense_rank() OVER (ORDER BY rule) - 1 AS rule_index, level,
  CASE type WHEN 'taint_analysis' THEN 'Tainted variable ''' || coalesce(variable, 'unknown') || ''' flows to dangerous sink ''' || coalesce(sink, 'unknown') || '''' WHEN 'interprocedural_taint' THEN 'Interprocedural taint: ''unknown'' reaches ''' || coalesce(sink, 'unknown') || ''' via '
    WHEN 'dangerous_function' THEN 'Dangerous function call: unknown' WHEN 'hardcoded_secret' THEN 'Hardcoded secret detected in variable ''' || coalesce(variable, 'unknown') || '''' WHEN 'high_complexity' THEN 'High cyclomatic complexity: ?' ELSE message END AS text,
  file AS uri, coalesce(line, 1) AS line, rule || '/' || file || '/' || coalesce(CAST(line AS VARCHAR), '') || '/' || coalesce(variable, '') AS fingerprint, vuln_score AS confidence FROM r""",
    "top_files": f"WITH {_F} SELECT file AS label, count(*) AS n FROM f GROUP BY file ORDER BY n DESC, min(ordinal) LIMIT 10",
    "top_types": f"WITH {_F} SELECT type AS label, count(*) AS n FROM f GROUP BY type ORDER BY n DESC, min(ordinal) LIMIT 8",
    "report_ids": "SELECT doc_id AS ordinal, 'VP-' || CASE WHEN row_number() OVER (ORDER BY doc_id) < 10000 THEN lpad(CAST(row_number() OVER (ORDER BY doc_id) AS VARCHAR), 4, '0') ELSE CAST(row_number() OVER (ORDER BY doc_id) AS VARCHAR) END AS id FROM documents",
    "severity_counts": f"WITH {_F}, m AS (SELECT {_MD} AS level FROM f) SELECT v.severity, count(level) AS n FROM (VALUES ('critical'), ('high'), ('medium'), ('low')) v(severity) LEFT JOIN m ON level = v.severity GROUP BY v.severity",
    "json_report": f"""WITH {_F}, n AS (SELECT *, row_number() OVER (ORDER BY ordinal) AS i FROM f) SELECT ordinal, '{{"id":"VP-' || CASE WHEN i < 10000 THEN lpad(CAST(i AS VARCHAR), 4, '0') ELSE CAST(i AS VARCHAR) END || '"' || {_JSON_PARTS} || '}}' AS json FROM n""",
    "sarif_results": f"WITH {_F}, r AS (SELECT *, {_RULE} AS rule, {_LEVEL} AS level FROM f) SELECT ordinal, rule, dense_rank() OVER (ORDER BY rule) - 1 AS rule_index, level, rule || '/' || file || '/' || coalesce(CAST(line AS VARCHAR), '') || '/' || coalesce(variable, '') AS fingerprint FROM r",
    "sarif_context": f"WITH {CODE_SQL} SELECT doc_id AS ordinal, string_agg(l.line, chr(10) ORDER BY l.line_no) AS snippet FROM code JOIN lines l USING (file) WHERE l.line_no BETWEEN doc_id % 6 - 1 AND doc_id % 6 + 3 GROUP BY doc_id",
    "baseline_exact": _OLD.format("", 0), "baseline_fuzzy": _OLD.format("", 5), "baseline_new": _OLD.format("NOT", 5),
    "deps_requirements": f"WITH {_REQ} SELECT project, name, version FROM d",
    "deps_package_json": "SELECT doc_id AS project, name, version FROM documents, (VALUES ('a', '1.2.3'), ('b', '3.1'), ('c', '*')) v(name, version) WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id, 'p' || doc_id, CASE WHEN doc_id % 2 = 0 THEN '9.' ELSE '' END || (doc_id % 5) || '.1' FROM documents WHERE doc_id % 7 <> 0",
    "dependency_report": f"WITH {_REP} SELECT * FROM x",
    "dependency_summary": f"WITH {_REP} SELECT project, count(*) AS n_dependencies, count(*) FILTER (WHERE vulnerable) AS num_vulnerable_dependencies, count(*) FILTER (WHERE outdated) AS num_outdated_dependencies, arg_min(severity, {_RANKS}) FILTER (WHERE severity IS NOT NULL) AS max_dependency_severity FROM x GROUP BY project",
    "osv_parse": f"WITH v(k, vuln_id, summary, cves, severity, cvss_score, urls, ranges) AS (VALUES {_rows([(i, *out) for i, (_, _, out) in enumerate(_OSV)])}) SELECT doc_id AS project, vuln_id, summary, cves, severity, cvss_score, urls, ranges FROM documents JOIN v ON doc_id % 3 = k",
    "most_severe": f"WITH {_F}, v AS (SELECT file AS package, ordinal, 'V' || CAST(ordinal AS VARCHAR) AS vuln_id, lower(coalesce(severity, 'unknown')) AS severity FROM f), q AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY {_RANKS}, ordinal) AS i, count(*) OVER (PARTITION BY package) AS total_vulnerabilities FROM v) SELECT package, vuln_id, severity, total_vulnerabilities FROM q WHERE i = 1",
    "nvd_patterns": "SELECT cve_id, description, cwes, products, count(*) AS n FROM documents, (VALUES ('CVE-1', 'd1', 'CWE-79,CWE-89', 'c1,c2'), ('CVE-2', 'd2', '', '')) v(cve_id, description, cwes, products) GROUP BY ALL",
    "cwe_map": f"WITH m(i, cwe, rule_id, type, severity) AS (VALUES {_rows([(i, k, *C.CWE_RULES.get(k, (None, None, None))) for i, k in enumerate([*C.CWE_RULES, 'CWE-0'])])}) SELECT doc_id AS project, cwe, rule_id, type, severity FROM documents JOIN m ON doc_id % {len(C.CWE_RULES) + 1} = i",
    "cache_ttl": "WITH c AS (SELECT user_id, CAST(floor(max(epoch(ts))) AS BIGINT) AS ts FROM events GROUP BY user_id) SELECT sha256(lower('PyPI:Pkg' || CAST(user_id AS VARCHAR) || ':1.0')) AS key, ts, (SELECT max(ts) FROM c) - ts <= 86400 AS hit FROM c",
    "churn_features": "SELECT 'f' || CAST(event_id % 200 AS VARCHAR) AS file, count(*) AS commit_count, count(DISTINCT user_id) AS unique_authors, CAST(floor((epoch(TIMESTAMP '2030-01-01') - floor(epoch(max(ts)))) / 86400) AS BIGINT) AS last_modified_days FROM events GROUP BY 1",
    "auto_label": "SELECT doc_id, CAST(doc_id % 4 = 0 OR doc_id % 25 > 10 OR doc_id % 8 > 5 AS INTEGER) AS label FROM documents",
    "features_matrix": "SELECT doc_id, " + ", ".join(f"CAST({_FEATURE.get(n, 0)} AS DOUBLE) AS {n}" for n in L.FEATURES) + " FROM documents",
    "features_findings": _FEATURES_SQL,
    "confusion_by_lang": f"WITH d AS (SELECT lang, toxic = 1 AS y, doc_id % 3 = 0 AS d FROM documents JOIN labels USING (doc_id)), g AS (SELECT lang AS grp, count(*) FILTER (WHERE d AND y) AS tp, count(*) FILTER (WHERE d AND NOT y) AS fp, count(*) FILTER (WHERE NOT d AND NOT y) AS tn, count(*) FILTER (WHERE NOT d AND y) AS fn FROM d GROUP BY GROUPING SETS ((lang), ())) SELECT *, round({_P}, 4) AS precision, round({_R}, 4) AS recall, round(CASE WHEN ({_P}) + ({_R}) = 0 THEN 0 ELSE 2 * ({_P}) * ({_R}) / (({_P}) + ({_R})) END, 4) AS f1_score, {_ratio('fp', 'fp + tn')} AS false_positive_rate, {_ratio('tp + tn', 'tp + fp + tn + fn')} AS accuracy FROM g",
    "synthetic_samples": f"WITH {_SAMPLES} SELECT doc_id, code, CAST(label AS INTEGER) AS label, type FROM x",
    "benchmark_detection": f"WITH {_SAMPLES} SELECT type AS grp, count(*) FILTER (WHERE label = 1 AND NOT ({_MISSED})) AS tp, CAST(0 AS BIGINT) AS fp, count(*) FILTER (WHERE label = 0) AS tn, count(*) FILTER (WHERE label = 1 AND {_MISSED}) AS fn FROM x GROUP BY ROLLUP (type)",
    "embedding_vectors": "SELECT doc_id, CAST(" + str(len(L.FEATURES)) + " + coalesce(len(embedding), 0) AS BIGINT) AS size, round(" + " + ".join(f"CAST({v} AS DOUBLE)" for v in _FEATURE.values()) + " + coalesce(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 0.0), 3) AS total FROM documents LEFT JOIN embeddings ON doc_id = vec_id",
    "code_context": f"WITH {CODE_SQL}, n AS (SELECT file, max(line_no) AS n FROM lines GROUP BY file), g(sid, a, b) AS (VALUES (0, 1, 4), (1, 1, 2), (2, 3, 8), (3, 1, 9), (3, 2, 3), (4, 1, 4), (4, 6, 7), (5, 1, 5), (22, 1, 7), (24, 3, 8)), x AS (SELECT doc_id, file, sid, doc_id % 9 + 1 AS line FROM code WHERE file LIKE '%.py'), i AS (SELECT doc_id, arg_min(a, a) AS a, arg_min(b, a) AS b FROM x JOIN g USING (sid) WHERE line BETWEEN a AND b GROUP BY doc_id) SELECT doc_id AS ordinal, CAST(coalesce(a, greatest(1, line - 10)) AS BIGINT) AS first_line, CAST(coalesce(b, least(n, line + 10)) AS BIGINT) AS last_line FROM x LEFT JOIN i USING (doc_id) JOIN n USING (file)",
    "embedding_join": "SELECT doc_id AS ordinal, CAST(64 AS BIGINT) AS size, round(coalesce(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 0.0), 4) AS norm FROM documents LEFT JOIN embeddings ON doc_id = vec_id",
    "store_scan_counts": f"WITH {_E} SELECT scan_id, count(*) AS total_findings, " + ", ".join(f"count(*) FILTER (WHERE severity = '{x}') AS {x}_count" for x in ST.LEVELS) + " FROM e GROUP BY scan_id",
    "store_stats": f"WITH {_E} SELECT 'total_findings' AS measure, NULL AS value, count(*) AS n FROM e UNION ALL SELECT 'severity', severity, count(*) FROM e GROUP BY severity UNION ALL (SELECT 'type', type, count(*) AS n FROM e GROUP BY type ORDER BY n DESC, type LIMIT 10)",
    "store_page": f"WITH {_E} SELECT id, scan_id, severity, type FROM e WHERE severity = 'high' AND type = 'click' ORDER BY id LIMIT 20 OFFSET 40",
    "store_pages": f"WITH {_E} SELECT count(*) AS total, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages FROM e WHERE severity = 'high'",
    "store_delete": f"WITH {_E} SELECT scan_id, count(*) AS n FROM e WHERE scan_id NOT IN ('s1', 's7') GROUP BY scan_id",
    "union_analyzers": "SELECT 'documents' AS source, count(*) AS n, CAST(0 AS BIGINT) AS with_url, CAST(sum(length(text)) AS BIGINT) AS size FROM documents UNION ALL SELECT 'pages', count(*), count(url), NULL FROM pages UNION ALL SELECT 'conversations', count(*), 0, CAST(sum(length(text)) AS BIGINT) FROM conversations",
    "rules_merge": "SELECT id, severity, 'f' AS callee, count(*) AS n FROM documents, (VALUES ('A', 'high'), ('B', 'low'), ('C', 'high')) v(id, severity) GROUP BY ALL",
    "events_windowed": "SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
