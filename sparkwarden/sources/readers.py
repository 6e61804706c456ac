"""Sources as DataFrames: project files, lines, manifests, advisories, baselines, ignore files, commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.functions.catalog import SCANNABLE, SCANNERS

from .json_stream import read_elements


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """files(file, content) below path; bytes that are no UTF-8 are dropped."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    text = F.replace(F.decode("content", "UTF-8"), F.lit("�"), F.lit(""))
    return reader.load(path).select(F.col("path").alias("file"), text.alias("content"))


def base_name(file: Column) -> Column:
    return F.element_at(F.split(file, "/", -1), -1)


def scanned(files: DataFrame, scanner: str) -> DataFrame:
    """The files a scanner looks at: by suffix, without its skipped folders (tested before content is touched)."""
    suffixes, skipped = SCANNERS[scanner]
    file, name = F.col("file"), base_name(F.col("file"))
    lower = F.lower(name)
    ok = F.lit(False)
    for s in suffixes:
        ok = ok | (lower if scanner == "iac" else name).endswith(s)
    if scanner == "go":
        ok = ok & ~name.endswith("_test.go")
    if scanner == "iac":
        ok = ok | lower.startswith("dockerfile") | (lower == "containerfile")
    if skipped:
        ok = ok & ~F.arrays_overlap(F.slice(F.split(file, "/", -1), 1, F.greatest(F.size(F.split(file, "/", -1)) - 1, F.lit(0))), F.array(*map(F.lit, skipped)))
    return files.where(ok)


def iac_kind(file: Column) -> Column:
    """terraform, dockerfile, kubernetes or null; suffixes by case, names without."""
    name = F.lower(base_name(file))
    return (
        F.when(file.endswith(".tf"), "terraform")
        .when(name.startswith("dockerfile") | (name == "containerfile"), "dockerfile")
        .when(file.endswith(".yaml") | file.endswith(".yml"), "kubernetes")
    )


def scannable_count(files: DataFrame) -> DataFrame:
    ok = F.lit(False)
    for s in SCANNABLE:
        ok = ok | F.col("file").endswith(s)
    return files.agg(F.count_if(ok).alias("n_files"))


def lines(files: DataFrame) -> DataFrame:
    """lines(file, line_no, line) from 1, with any kind of line end."""
    text = F.regexp_replace("content", "\r\n?", "\n")
    each = files.select("file", F.posexplode(F.split(text, "\n", -1)).alias("i", "line"))
    return each.select("file", (F.col("i") + 1).cast("bigint").alias("line_no"), "line")


def requirements(rows: DataFrame) -> DataFrame:
    """(project, name, version) from manifest lines (project, line); version is null if none is pinned."""
    line = F.trim("line")
    kept = rows.where((line != "") & ~line.startswith("#"))
    pattern = r"^([a-zA-Z0-9_\-]+)([=<>!~]+([a-zA-Z0-9_.]+))?"
    out = kept.select("project", F.regexp_extract(line, pattern, 1).alias("name"), F.nullif(F.regexp_extract(line, pattern, 3), F.lit("")).alias("version"))
    return out.where("name <> ''")


def package_json(rows: DataFrame) -> DataFrame:
    """(project, name, version) from (project, json): dependencies, then devDependencies, which win; bad JSON has none."""
    parsed = rows.select("project", F.from_json("json", "dependencies map<string,string>, devDependencies map<string,string>").alias("p"))
    none = F.create_map().cast("map<string,string>")
    main, dev = F.coalesce("p.dependencies", none), F.coalesce("p.devDependencies", none)
    merged = F.map_concat(F.map_filter(main, lambda k, _: ~F.map_contains_key(dev, k)), dev)
    each = parsed.select("project", F.explode(merged).alias("name", "spec"))
    return each.select("project", "name", F.ltrim("spec", F.lit("^~><=!")).alias("version"))


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """A labelled findings CSV with a header; label is an integer."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return rows.withColumn("label", F.col("label").cast("int"))


NVD = "vulnerabilities array<struct<cve:struct<id:string,descriptions:array<struct<lang:string,value:string>>,weaknesses:array<struct<description:array<struct<lang:string,value:string>>>>,configurations:array<struct<nodes:array<struct<cpeMatch:array<struct<vulnerable:boolean,criteria:string>>>>>>>>>"


def nvd_patterns(documents: DataFrame) -> DataFrame:
    """(cve_id, description, cwes, products) from NVD documents (json): first description, first weakness's CWEs, all CPEs."""
    return _nvd_patterns(documents.select(F.explode(F.from_json("json", NVD)["vulnerabilities"]).alias("v")).select("v.cve"))


def nvd_elements(spark: SparkSession, path: str) -> DataFrame:
    """nvd_patterns of documents of any size at path, whose elements are read one by one."""
    element = NVD.removeprefix("vulnerabilities array<").removesuffix(">")
    each = read_elements(spark, path).select(F.from_json("json", element)["cve"].alias("cve"))
    return _nvd_patterns(each.where("cve IS NOT NULL"))


def _nvd_patterns(each: DataFrame) -> DataFrame:
    products = F.flatten(F.transform("cve.configurations", lambda c: F.flatten(F.transform(c["nodes"], lambda n: F.transform(n["cpeMatch"], lambda m: m["criteria"])))))
    none = F.array().cast("array<string>")
    return each.select(
        F.col("cve.id").alias("cve_id"), F.get("cve.descriptions", F.lit(0))["value"].alias("description"),
        F.coalesce(F.transform(F.get("cve.weaknesses", F.lit(0))["description"], lambda d: d["value"]), none).alias("cwes"), F.coalesce(products, none).alias("products"),
    )


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """findings of a saved baseline document; none if it is not readable as one."""
    schema = "findings array<struct<file:string,line:bigint,rule_id:string,type:string,message:string,description:string>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("findings").alias("f")).select("f.*")


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """A baseline: the document if the name ends in .json, else a Parquet table."""
    return read_baseline(spark, path) if path.lower().endswith(".json") else spark.read.parquet(path)


def ignore_patterns(rows: DataFrame) -> list[str]:
    """Patterns of an ignore file's lines, a driver-side list as in any project configuration."""
    return [r[0].strip() for r in rows.collect() if r[0].strip() and not r[0].strip().startswith("#")]


def churn(commits: DataFrame, now: Column) -> DataFrame:
    """(file, commit_count, unique_authors, last_modified_days) from commits(file, author, ts)."""
    return commits.groupBy("file").agg(
        F.count("*").alias("commit_count"), F.count_distinct("author").alias("unique_authors"), F.floor((F.unix_timestamp(now) - F.unix_timestamp(F.max("ts"))) / 86400).cast("bigint").alias("last_modified_days")
    )


def tool_findings(rows: DataFrame, tool: str) -> DataFrame:
    """Findings from a captured report (json) of `bandit` or `eslint`."""
    if tool == "bandit":
        r = rows.select(F.explode(F.from_json("json", "results array<struct<filename:string,line_number:bigint,test_id:string,issue_text:string,issue_severity:string>>")["results"]).alias("r"))
        return r.select(F.lit("bandit").alias("type"), F.col("r.filename").alias("file"), F.col("r.line_number").alias("line"), F.col("r.test_id").alias("rule_id"), F.col("r.issue_text").alias("message"), F.lower("r.issue_severity").alias("severity"))
    r = rows.select(F.explode(F.from_json("json", "array<struct<filePath:string,messages:array<struct<ruleId:string,line:bigint,message:string,severity:int>>>>")).alias("f")).select("f.filePath", F.explode("f.messages").alias("m"))
    return r.select(F.lit("eslint").alias("type"), F.col("filePath").alias("file"), F.col("m.line").alias("line"), F.col("m.ruleId").alias("rule_id"), F.col("m.message").alias("message"), F.when(F.col("m.severity") == 2, "high").otherwise("medium").alias("severity"))
