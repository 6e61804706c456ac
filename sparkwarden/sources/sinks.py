"""Sinks: reports as files, baselines, labelled findings, training and benchmark datasets, advisory patterns."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.operators import reports as R
from sparkwarden.operators import scoring as S
from sparkwarden.operators.suppression import fingerprint


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small document to any store that Spark writes to."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def document(findings: DataFrame, form: str, scan_path: str = "", suppressed: int = 0, lines: DataFrame | None = None) -> R.Document:
    """A report: json, sarif, html or text, of all findings; markdown has its top lists."""
    if form == "json":
        return R.json_document(findings, scan_path, suppressed)
    if form == "sarif":
        return R.sarif_document(findings, lines)
    if form == "html":
        return R.html_document(findings)
    if form == "text":
        return R.text_document(findings)
    if form != "markdown":
        raise ValueError(f"no format {form}")
    none = findings.sparkSession.createDataFrame([], "position bigint, text string")
    return R.Document(R.markdown(findings, scan_path, suppressed), none, "", "")


def render(findings: DataFrame, form: str, scan_path: str = "", suppressed: int = 0) -> str:
    """A report as one text, for findings that the driver can print; rows come a partition at a time."""
    d = document(findings, form, scan_path, suppressed)
    return d.head + d.sep.join(r["text"] for r in d.rows.orderBy("position").toLocalIterator()) + d.tail


def write_report(findings: DataFrame, path: str, form: str, scan_path: str = "", suppressed: int = 0, lines: DataFrame | None = None) -> None:
    write_document(findings.sparkSession, document(findings, form, scan_path, suppressed, lines), path)


def write_document(spark: SparkSession, d: R.Document, path: str) -> None:
    """A document as one file: Spark writes its rows in parts, and the driver copies them, one after another, as streams."""
    from sparkwarden.plans.tables import folder

    parts = folder(spark, "report")
    d.rows.orderBy("position").select(F.col("text").alias("value")).write.option("lineSep", d.sep or "\n").text(parts)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    name = jvm.org.apache.hadoop.fs.Path
    target, source = name(path), name(parts)
    out = target.getFileSystem(conf).create(target, True)
    try:
        out.write(bytearray(d.head.encode()))
        fs = source.getFileSystem(conf)
        sizes = {f.getPath().toString(): f.getLen() for f in fs.listStatus(source) if f.getPath().getName().startswith("part-") and f.getLen()}
        for x in sorted(sizes):
            # what stands between rows also ends the last one, and is left out there
            size = sizes[x] - (len(d.sep.encode()) if x == max(sizes) else 0)
            into = fs.open(name(x))
            try:
                bounded = jvm.org.apache.commons.io.input.BoundedInputStream(into, size)
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(bounded, out, 1 << 16, False)
            finally:
                into.close()
        out.write(bytearray(d.tail.encode()))
    finally:
        out.close()


def save_baseline(findings: DataFrame, path: str) -> None:
    """All findings of a scan, by the key that comparisons use, so the next scan knows each again: a document if the name ends in .json, else Parquet."""
    rule, text = fingerprint(findings)
    have = findings.columns
    rule, text = (F.col("known_rule"), F.col("known_message")) if "known_rule" in have else (rule, text)
    rows = findings.select("ordinal", "file", F.col("line").cast("bigint").alias("line"), rule.alias("rule_id"), "type", text.alias("message"))
    if not path.lower().endswith(".json"):
        rows.drop("ordinal").write.mode("overwrite").parquet(path)
        return
    rows = R.numbered(rows).select("position", F.to_json(F.struct("file", "line", "rule_id", "type", "message")).alias("text"))
    write_document(findings.sparkSession, R.Document('{"findings": [\n', rows, ",\n", "\n]}"), path)


def write_labelled(findings: DataFrame, path: str) -> None:
    """Findings with their automatic label as CSV; arrays and structs as JSON."""
    have = set(findings.columns)
    get = lambda n, t: F.col(n) if n in have else F.lit(None).cast(t)
    label = S.auto_label(get("dangerous_calls", "array<string>"), get("cyclomatic_complexity", "int"), get("max_nesting_depth", "int"), F.col("type"))
    flat = [F.to_json(F.struct(n)).alias(n) if t.startswith(("array", "struct", "map")) else F.col(n) for n, t in findings.dtypes]
    findings.select(*flat, label.alias("label")).write.mode("overwrite").csv(path, header=True, escape='"')


def write_nvd(patterns: DataFrame, path: str) -> None:
    patterns.select("cve_id", "description", F.to_json("cwes").alias("cwes"), F.to_json("products").alias("products")).write.mode("overwrite").csv(path, header=True, escape='"')


def write_dataset(samples: DataFrame, path: str) -> dict:
    """Samples as CSV, and their counts as a document beside them, which is returned."""
    samples.write.mode("overwrite").csv(f"{path}/data", header=True, escape='"')
    rows = samples.groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("vulnerable")).orderBy("type").collect()
    meta = {"total": sum(r.n for r in rows), "vulnerable": sum(r.vulnerable for r in rows), "types": {r.type: r.n for r in rows}}
    write_text(samples.sparkSession, f"{path}/meta.json", json.dumps(meta))
    return meta


def benchmark(samples: DataFrame, detected: DataFrame) -> DataFrame:
    """Confusion by type: samples (id, label, type) against the ids of which anything was found."""
    from sparkwarden.operators.learning import confusion

    hit = detected.select("id").distinct().withColumn("detected", F.lit(1))
    return confusion(samples.join(hit, "id", "left").withColumn("detected", F.coalesce("detected", F.lit(0))), "detected", "label", "type")


def synthetic_project(spark: SparkSession, n: int, lines: int = 50) -> DataFrame:
    """files(file, content): 60 % Python, 30 % JavaScript, 10 % Go, some with a finding; the same for the same numbers."""
    i = F.col("id")
    kind = F.when(i % 10 < 6, "py").when(i % 10 < 9, "js").otherwise("go")
    head = F.when(kind == "py", F.when(i % 4 == 0, "def f(x):\n    eval(x)\n").otherwise("def f(x):\n    return x\n")).when(kind == "js", F.when(i % 4 == 0, "eval(x);\n").otherwise("use(x);\n")).otherwise(F.when(i % 4 == 0, 'import "crypto/des"\n').otherwise("package main\n"))
    sign = F.when(kind == "py", "# ").otherwise("// ")
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(lines)), lambda k: F.concat(sign, F.lit("line "), k.cast("string"))), "\n")
    return spark.range(n).select(F.concat(F.lit("p/f"), i.cast("string"), F.lit("."), kind).alias("file"), F.concat(head, body).alias("content"))


def level_counts(findings: DataFrame, threshold: str) -> tuple[dict[str, int], bool]:
    """Counts by level, and whether any is at or above the threshold: what a build step needs."""
    counts = {r.severity: r.n for r in R.severity_counts(findings, F.lower("severity"), ["critical", "high", "medium", "low"]).collect()}
    order = ["low", "medium", "high", "critical"]
    return counts, any(counts[x] for x in order[order.index(threshold) :])
