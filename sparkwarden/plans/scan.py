"""The scan: files to findings, with what is known of their files, suppressed, scored, classified, filtered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.functions import catalog as C
from sparkwarden.functions.facts import PythonFacts, javascript
from sparkwarden.operators import advisories as A
from sparkwarden.operators import patterns as P
from sparkwarden.operators import python_code as PY
from sparkwarden.operators import scoring as S
from sparkwarden.operators.rules import rule_table
from sparkwarden.operators.suppression import fingerprint, suppressed
from sparkwarden.operators.versions import range_report
from sparkwarden.sources import readers as SRC
from sparkwarden.sources.readers import iac_kind, lines, read_files, scanned

from .config import Profile, profile
from .tables import held

CHURN = ("commit_count", "unique_authors", "last_modified_days")


def analyzed(files: DataFrame, chosen: Profile, languages: tuple[str, ...] = ("python", "javascript"), rules: list[dict] | None = None, flags: str = P.UNICODE) -> tuple[DataFrame, DataFrame]:
    """(findings, errors) of files(file, content): all analyzers' findings in one schema, in the analyzers' order (stage).

    errors (file, error) are the files that do not parse. rules: further call rules, matched beside the dictionaries.
    """
    spark = files.sparkSession
    parts: list[tuple[int, DataFrame]] = []
    errors = spark.createDataFrame([], "file string, error string")
    if chosen.pattern_matching and "python" in languages:
        facts = PythonFacts(scanned(files, "python"))
        errors = facts.errors
        parts.append((0, PY.function_findings(facts)))
        if rules:
            found = PY.rule_matches(facts.calls, rule_table(spark, rules))
            parts.append((0, found.withColumn("type", F.lit("rule_match")).withColumnRenamed("description", "message").withColumnRenamed("callee", "function")))
        if chosen.taint_analysis:
            taint = PY.taint_findings(facts).withColumn("line", F.col("sink_line"))
            steps = F.transform("trace", lambda x: F.concat(x["line"].cast("string"), F.lit(": "), x["name"]))
            parts.append((1, taint.withColumn("trace", steps).drop("visit_pos", "arg", "source")))
        if chosen.interprocedural_analysis:
            flow = PY.flow_findings(facts).withColumn("file", F.split_part("sink_func", F.lit("::"), F.lit(1)))
            parts.append((5, flow.withColumn("line", F.col("sink_line")).drop("visit_pos", "arg")))
    if chosen.pattern_matching:
        parts.append((6, P.content_findings(scanned(files, "go"), C.GO_RULES, flags).drop("match")))
        iac = scanned(files, "iac").withColumn("kind", iac_kind(F.col("file")))
        tf, docker, k8s = (iac.where(F.col("kind") == k).drop("kind") for k in ("terraform", "dockerfile", "kubernetes"))
        parts += [(7, P.terraform_findings(tf, lines(tf), flags)), (8, P.dockerfile_findings(lines(docker), flags)), (9, P.kubernetes_findings(k8s, flags))]
    if chosen.js_analysis and "javascript" in languages:
        functions, calls = javascript(scanned(files, "javascript"))
        parts.append((2, functions.select(F.lit("function_analysis").alias("type"), "file", F.col("name").alias("function"), F.col("lineno").alias("line"), "length", F.col("nesting").alias("max_nesting_depth"), F.col("validation").alias("input_validation"))))
        parts.append((3, calls.select(F.lit("dangerous_call").alias("type"), "file", F.col("callee").alias("function"), F.col("lineno").alias("line"))))
        js = scanned(files, "js_patterns")
        parts += [(4, P.line_findings(lines(js), C.JS_RULES, flags)), (4, P.postmessage_findings(js, flags)), (4, P.line_findings(lines(scanned(files, "typescript")), C.TS_RULES, flags))]
    if not parts:
        return spark.createDataFrame([], "type string, file string, line bigint, rule_id string, message string, severity string, stage int"), errors
    found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("stage", F.lit(k)) for k, df in parts])
    return found, errors


def findings_of(files: DataFrame, chosen: Profile, **options) -> DataFrame:
    return analyzed(files, chosen, **options)[0]


def dependency_findings(files: DataFrame, latest: DataFrame | None = None, advisories: DataFrame | None = None) -> DataFrame:
    """A finding for each manifest in the project's root: its packages, and how many are outdated or vulnerable.

    latest (name, latest) and advisories are tables; without them no package is either. Advisories are either answers for versions (name,
    version, severity) or records (json), whose ranges are compared with versions. As a manifest of JavaScript says ranges,
    its packages are never outdated.
    """
    spark = files.sparkSession
    latest = latest if latest is not None else spark.createDataFrame([], "name string, latest string")
    advisories = advisories if advisories is not None else spark.createDataFrame([], "name string, version string, severity string")
    text = files.where(F.col("file").isin("requirements.txt", "package.json"))
    py = SRC.requirements(lines(text.where("file = 'requirements.txt'")).select(F.col("file").alias("project"), "line"))
    js = SRC.package_json(text.where("file = 'package.json'").select(F.col("file").alias("project"), F.col("content").alias("json")))
    if "json" in advisories.columns:
        known = py.withColumn("ecosystem", F.lit("PyPI")).unionByName(js.withColumn("ecosystem", F.lit("npm")))
        report = range_report(known, latest, advisories).drop("ecosystem", "n_advisories")
    else:
        report = A.dependency_report(py.unionByName(js), latest, advisories)
    report = report.withColumn("outdated", F.col("outdated") & (F.col("project") == "requirements.txt"))
    each = F.struct("name", "version", "outdated", "vulnerable", "severity")
    listed = report.groupBy("project").agg(F.array_sort(F.collect_list(each)).alias("dependencies"))
    out = A.dependency_summary(report).drop("n_dependencies").join(listed, "project")
    return out.withColumnRenamed("project", "file").withColumn("type", F.lit("dependencies"))


def with_churn(findings: DataFrame, commits: DataFrame, now) -> DataFrame:
    """findings with what commits (file, author, ts) say of their files; zeros where they say nothing."""
    known = SRC.churn(commits, now).select(F.col("file").alias("_file"), *CHURN)
    out = findings.drop(*CHURN).join(known, F.col("file") == F.col("_file"), "left").drop("_file")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in CHURN})


def qualified(spark: SparkSession, path: str) -> str:
    """path as the file system names it: absolute, with its scheme, without . and .. parts."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p)
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(full.toUri().normalize()).toString()


def project_files(spark: SparkSession, path: str) -> DataFrame:
    """files(file, content) below path, named relative to it, whatever signs its name holds."""
    root = qualified(spark, path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    # of a file's own name only the path counts: schemes are spelt in more than one way
    name = F.regexp_replace("file", r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")
    return read_files(spark, root).withColumn("file", F.substr(name, F.lit(len(place) + 2)))


def scan_project(
    spark: SparkSession, path: str, profile_name: str = "standard", minimum: str = "low", ignore: list[str] = (), baseline: DataFrame | None = None, show_suppressed: bool = False, model=None, *,
    languages: tuple[str, ...] = ("python", "javascript"), rules: list[dict] | None = None, disabled: tuple[str, ...] = (), latest: DataFrame | None = None, advisories: DataFrame | None = None,
    commits: DataFrame | None = None, tools: list[DataFrame] = (), now=None, auto_train: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(findings, errors) below path, most severe first by severity and combined_score; suppressed ones carry their reason, if shown.

    disabled: rules whose findings are left out; latest, advisories: tables for dependencies; commits (file, author, ts) add
    churn; tools: findings of captured reports (see readers.tool_findings), taken as they are; auto_train: a profile that
    scores, without a model, fits one on the findings' automatic labels, if there are both.
    """
    chosen = profile(profile_name)
    files = project_files(spark, path)
    found, errors = analyzed(files, chosen, tuple(languages), rules)
    for more in tools:
        found = found.unionByName(more.withColumn("stage", F.lit(1)), allowMissingColumns=True)
    if chosen.dependency_check:
        found = found.unionByName(dependency_findings(files, latest, advisories).withColumn("stage", F.lit(10)), allowMissingColumns=True)
    if disabled and "rule_id" in found.columns:
        found = found.where(F.coalesce(~F.upper("rule_id").isin([d.upper() for d in disabled]), F.lit(True)))
    if commits is not None:
        found = with_churn(found, commits, now if now is not None else F.current_timestamp())
    found = held(found.withColumn("ordinal", F.monotonically_increasing_id()))
    # what a baseline knows a finding by, before classification names its rule anew
    rule, text = fingerprint(found)
    found = found.withColumns({"known_rule": rule, "known_message": text})
    marked = suppressed(found, lines(files), list(ignore), baseline)
    if chosen.ml_scoring and model is None and auto_train:
        from sparkwarden.operators.learning import FEATURES, labelled_features, train

        rows = labelled_features(found)
        if rows.select("label").distinct().count() == 2:
            model = train(rows, FEATURES)
    if chosen.ml_scoring and model is not None:
        from sparkwarden.operators.learning import FEATURES, features, predict

        scores = predict(model, features(marked, ["ordinal"])).select("ordinal", "vuln_score").drop(*FEATURES)
        marked = marked.join(scores, "ordinal", "left")
    kept = marked if show_suppressed else marked.where("suppression_reason IS NULL")
    return S.by_severity(S.at_least(S.classified(kept), minimum)), errors


def scan(spark: SparkSession, path: str, *args, **options) -> DataFrame:
    """The findings of scan_project."""
    return scan_project(spark, path, *args, **options)[0]
