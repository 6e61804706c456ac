"""Reports: summaries, top lists, ids, JSON, SARIF, Markdown and HTML; snippets by a join to lines.

A report is a Document: what comes before its rows, rows of text with their position, what comes between and after them.
Rows are made by Spark, and sinks join them part by part, so no report is held by a task or the driver.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkwarden.functions import catalog as C

from . import scoring as S

TOP_FINDINGS, TOP_DETAILS, TOP_FILES, TOP_TYPES = 20, 50, 10, 8
VERSION = "1.0.0"
#: What reports read of a finding.
FIELDS = {
    "ordinal": "bigint", "type": "string", "file": "string", "line": "bigint", "severity": "string", "message": "string", "rule_description": "string", "sink": "string", "variable": "string",
    "tainted_var": "string", "function": "string", "vuln_score": "double", "rule_id": "string", "cwe": "string", "confidence": "string", "cyclomatic_complexity": "bigint", "source_func": "string", "sink_func": "string",
    "trace": "array<string>", "call_chain": "array<string>", "sink_line": "bigint", "name": "string",
}


@dataclass(frozen=True)
class Document:
    """A report: head, rows(position from 1, text) with sep between them, tail."""

    head: str
    rows: DataFrame
    sep: str
    tail: str


def report_columns(findings: DataFrame) -> DataFrame:
    """findings with every column that reports read, null where there is none; a sink's line stands for a missing line."""
    have = set(findings.columns)
    out = findings.select(*[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in FIELDS.items()])
    return out.withColumn("line", F.coalesce("line", "sink_line"))


# fixed values: the sentences of message and sarif_message, which readers of these formats know findings by
def message(kind: Column, f: dict[str, Column], text: Column) -> Column:
    """The JSON report's message of a finding by its type; f names variable, sink, tainted_var and function."""
    return (
        F.when(kind == "taint_analysis", F.format_string("Tainted variable '%s' flows from source to dangerous sink '%s'", F.coalesce(f["variable"], F.lit("unknown")), F.coalesce(f["sink"], F.lit("unknown"))))
        .when(kind == "interprocedural_taint", F.format_string("Interprocedural taint flow: %s reaches sink '%s' via call chain", F.coalesce(f["tainted_var"], F.lit("?")), F.coalesce(f["sink"], F.lit("?"))))
        .when(kind == "dangerous_function", F.concat(F.lit("Dangerous function call: "), F.coalesce(f["function"], F.lit("unknown"))))
        .when(kind == "hardcoded_secret", F.concat(F.lit("Hardcoded secret detected: "), F.coalesce(f["variable"], F.lit("?"))))
        .otherwise(text)
    )


def sarif_message(f: dict[str, Column]) -> Column:
    """SARIF's message of a finding (f: its columns)."""
    kind, no = f["type"], F.lit("unknown")
    variable = F.coalesce(f["variable"], f["tainted_var"], no)
    return (
        F.when(kind == "taint_analysis", F.format_string("Tainted variable '%s' flows to dangerous sink '%s'", F.coalesce(f["variable"], no), F.coalesce(f["sink"], no)))
        .when(kind == "interprocedural_taint", F.format_string("Interprocedural taint: '%s' reaches '%s' via %s", F.coalesce(f["tainted_var"], no), F.coalesce(f["sink"], no), F.coalesce(F.array_join(f["call_chain"], " -> "), F.lit(""))))
        .when(kind == "dangerous_function", F.concat(F.lit("Dangerous function call: "), F.coalesce(f["function"], no)))
        .when(kind == "hardcoded_secret", F.concat(F.lit("Hardcoded secret detected in variable '"), variable, F.lit("'")))
        .when(kind == "high_complexity", F.concat(F.lit("High cyclomatic complexity: "), F.coalesce(f["cyclomatic_complexity"].cast("string"), F.lit("?"))))
        .otherwise(F.coalesce(f["message"], f["rule_description"], f["name"], kind, F.lit("")))
    )


def markdown_message(f: dict[str, Column]) -> Column:
    """Markdown's message: a rule's description or the finding's own, else one by its type."""
    kind, no = f["type"], F.lit("?")
    flow = F.format_string("Tainted variable `%s` flows to sink `%s`", F.coalesce(f["variable"], f["tainted_var"], no), F.coalesce(f["sink"], no))
    by_type = (
        F.when(kind == "dangerous_function", F.concat(F.lit("Dangerous function call: "), F.coalesce(f["function"], no)))
        .when(kind.isin("taint_analysis", "interprocedural_taint"), flow)
        .when(kind == "hardcoded_secret", F.concat(F.lit("Hardcoded secret: "), F.coalesce(f["variable"], no)))
        .when(kind == "high_complexity", F.concat(F.lit("High cyclomatic complexity: "), F.coalesce(f["cyclomatic_complexity"].cast("string"), no)))
    )
    return F.coalesce(f["rule_description"], f["message"], by_type, f["name"], F.lit("Unknown finding"))


def location(file: Column, line: Column) -> Column:
    return F.when(file.isNull() | (file == ""), "").when(line.isNull() | (line == 0), F.concat(F.lit("`"), file, F.lit("`"))).otherwise(F.concat(F.lit("`"), file, F.lit(":"), line.cast("string"), F.lit("`")))


def severity_counts(findings: DataFrame, severity: Column, levels: list[str]) -> DataFrame:
    """(severity, n) for each level, zero ones too: one row of counts, unpivoted."""
    one = findings.agg(*[F.count_if(severity == x).alias(x) for x in levels])
    return one.select(F.explode(F.array(*[F.struct(F.lit(x).alias("severity"), F.col(x).alias("n")) for x in levels])).alias("r")).select("r.*")


def top_counts(findings: DataFrame, by: Column, n: int, order: str = "ordinal") -> DataFrame:
    """(label, n): the most frequent values, of equals the one met first."""
    return findings.groupBy(by.alias("label")).agg(F.count("*").alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first").limit(n).select("label", "n")


def numbered(findings: DataFrame, order: str = "ordinal", splits: int = 0) -> DataFrame:
    """findings with position from 1 and id VP-0001... in order. Positions come from counts by range of the order, so no task holds all rows."""
    keyed = findings.repartitionByRange(splits, order) if splits else findings.repartitionByRange(order)
    keyed = keyed.sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    keyed = keyed.withColumn("_k", F.col("_m") - F.shiftleft(F.col("_p").cast("bigint"), 33))
    from sparkwarden.plans.tables import held

    keyed = held(keyed)
    sizes = keyed.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    out = keyed.join(F.broadcast(before), "_p").withColumn("_i", F.col("_before") + F.col("_k") + 1)
    return out.withColumn("id", F.format_string("VP-%04d", "_i")).withColumnRenamed("_i", "position").drop("_p", "_m", "_k", "_before")


def top_findings(findings: DataFrame, n: int = TOP_FINDINGS) -> DataFrame:
    """The Markdown table's rows: by severity, then score, then order; a top-k, not a full sort."""
    sev = S.markdown_severity(F.col("severity"), F.col("vuln_score"))
    rank = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(("critical", "high", "medium", "low", "info")) for x in (k, i)]), sev)
    return findings.withColumn("level", sev).orderBy(rank, F.coalesce("vuln_score", F.lit(0.0)).desc(), "ordinal").limit(n)


def snippets(findings: DataFrame, lines: DataFrame, around: int = 2) -> DataFrame:
    """(ordinal, snippet): each finding's line with its neighbours. Findings ask for single lines, so the join is by equality."""
    wanted = findings.select("ordinal", "file", F.explode(F.sequence(F.col("line") - around, F.col("line") + around)).alias("line_no"))
    met = wanted.join(lines, ["file", "line_no"])
    return met.groupBy("ordinal").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("snippet"))


def json_rows(findings: DataFrame) -> DataFrame:
    """The JSON report's findings as rows (position, ordinal, severity, json); a type has its own fields beside the common ones."""
    f = report_columns(findings)
    c = {n: F.col(n) for n in FIELDS}
    sev = S.json_severity(c["type"], c["sink"], c["vuln_score"])
    rows = numbered(f.withColumn("level", sev))
    kind, no = c["type"], F.lit("unknown")
    only = lambda test, v: F.when(test, v)
    taint, flow = kind == "taint_analysis", kind == "interprocedural_taint"
    secret = kind == "hardcoded_secret"
    values = {
        "id": F.col("id"), "type": F.coalesce(kind, no), "severity": F.col("level"), "file": c["file"], "line": c["line"],
        "message": message(kind, c, F.when(kind == "high_complexity", F.concat(F.lit("High cyclomatic complexity: "), F.coalesce(c["cyclomatic_complexity"].cast("string"), F.lit("?")))).otherwise(F.coalesce("message", "rule_description", "name", F.lit("")))),
        "sink": only(taint | flow, F.coalesce(c["sink"], no)), "variable": F.when(flow, F.coalesce(c["tainted_var"], no)).when(taint | secret, F.coalesce(c["variable"], no)), "trace": only(taint, c["trace"]),
        "call_chain": only(flow, c["call_chain"]), "source_function": only(flow, c["source_func"]), "sink_function": only(flow, c["sink_func"]), "function": only(kind == "dangerous_function", F.coalesce(c["function"], no)),
        "complexity": only(kind == "high_complexity", c["cyclomatic_complexity"]), "confidence": c["vuln_score"],
    }
    return rows.select("position", "ordinal", F.col("level").alias("severity"), F.to_json(F.struct(*[v.alias(k) for k, v in values.items()])).alias("json"))


def json_document(findings: DataFrame, scan_path: str, suppressed: int = 0, files: int | None = None, seconds: float | None = None) -> Document:
    from datetime import datetime, timezone

    from sparkwarden.plans.tables import held

    rows = held(json_rows(findings))
    counts = {r["severity"]: r["n"] for r in severity_counts(rows, F.col("severity"), ["high", "medium", "low"]).collect()}
    meta = {"tool": "sparkwarden", "version": VERSION, "scan_timestamp": datetime.now(timezone.utc).isoformat(), "scan_path": scan_path}
    meta |= {} if seconds is None else {"scan_duration_seconds": round(seconds, 3)}
    meta |= {} if files is None else {"files_scanned": files}
    summary = {"total_findings": sum(counts.values()), "by_severity": counts, "suppressed_findings": suppressed}
    head = json.dumps({"$schema": "sparkwarden-json-v1", "schema_version": VERSION, "metadata": meta, "summary": summary})
    return Document(head[:-1] + ', "findings": [\n', rows.select("position", F.col("json").alias("text")), ",\n", "\n]}")


def sarif_results(findings: DataFrame) -> DataFrame:
    """ordinal, rule, rule_index (among the rules used), level and fingerprint of each finding."""
    have = set(findings.columns)
    f = findings.withColumn("rule", S.sarif_rule(F.col("type")))
    index = F.broadcast(f.select("rule").distinct().withColumn("rule_index", (F.row_number().over(W.orderBy("rule")) - 1).cast("bigint")))  # six rules at most
    pick = lambda *names: [F.col(n).cast("string") for n in names if n in have]
    about = F.coalesce(*pick("variable", "tainted_var", "function"), F.lit(""))
    mark = F.concat_ws("/", "rule", F.coalesce("file", F.lit("")), F.coalesce(*pick("line", "sink_line"), F.lit("")), about)
    return f.join(index, "rule").select("ordinal", "rule", "rule_index", S.sarif_level(F.col("type"), F.col("vuln_score")).alias("level"), mark.alias("fingerprint"))


def sarif_rows(findings: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """SARIF results as rows (position, ordinal, rule, json); with lines(file, line_no, line) they hold snippets."""
    c = F.col
    f = report_columns(findings)
    found = sarif_results(f)
    rows = numbered(f).join(found, "ordinal")
    line = F.when(c("line") >= 1, c("line")).otherwise(1)
    if lines is None:
        rows = rows.withColumn("_line", F.lit(None).cast("string")).withColumn("_context", F.lit(None).cast("string"))
    else:
        at = f.select("ordinal", "file", line.alias("line"))
        own = at.join(lines.select("file", c("line_no").alias("line"), c("line").alias("_line")), ["file", "line"]).select("ordinal", "_line")
        rows = rows.join(own, "ordinal", "left").join(snippets(at, lines).withColumnRenamed("snippet", "_context"), "ordinal", "left")
    place = F.struct(
        F.struct(F.coalesce("file", F.lit("unknown")).alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"),
        F.struct(line.alias("startLine"), F.lit(1).alias("startColumn"), F.when(c("_line").isNotNull(), F.struct(c("_line").alias("text"))).alias("snippet")).alias("region"),
        F.when(c("_line").isNotNull(), F.struct(F.greatest(F.lit(1), line - 2).alias("startLine"), (line + 2).alias("endLine"), F.struct(c("_context").alias("text")).alias("snippet"))).alias("contextRegion"),
    )
    properties = F.struct(c("vuln_score").alias("confidence"), "trace", c("call_chain").alias("callChain"))
    some = c("vuln_score").isNotNull() | c("trace").isNotNull() | c("call_chain").isNotNull()
    result = F.struct(
        c("rule").alias("ruleId"), c("rule_index").alias("ruleIndex"), "level", F.struct(sarif_message({n: c(n) for n in FIELDS}).alias("text")).alias("message"),
        F.array(F.struct(place.alias("physicalLocation"))).alias("locations"), F.create_map(F.lit("sparkwarden/v1"), c("fingerprint")).alias("fingerprints"), F.when(some, properties).alias("properties"),
    )
    return rows.select("position", "ordinal", "rule", F.to_json(result).alias("json"))


def sarif_document(findings: DataFrame, lines: DataFrame | None = None) -> Document:
    """A SARIF 2.1.0 document of all results."""
    from sparkwarden.plans.tables import held

    rows = held(sarif_rows(findings, lines))
    used = sorted(r["rule"] for r in rows.select("rule").distinct().collect())
    rules = [{"id": k, "name": C.SARIF_NAMES[k], "shortDescription": {"text": C.SARIF_TEXTS[k][0]}, "defaultConfiguration": {"level": C.SARIF_TEXTS[k][1]}, "properties": {"tags": ["security", C.SARIF_TEXTS[k][2]]}} for k in used]
    tool = {"driver": {"name": "sparkwarden", "version": VERSION, "rules": rules}}
    head = json.dumps({"$schema": C.SARIF_SCHEMA, "version": "2.1.0"})[:-1] + ', "runs": [{"tool": ' + json.dumps(tool) + ', "columnKind": "utf16CodeUnits", "results": [\n'
    return Document(head, rows.select("position", F.col("json").alias("text")), ",\n", "\n]}]}")


def finding_details(findings: DataFrame, n: int = TOP_DETAILS) -> DataFrame:
    """The n top findings with what Markdown says of each: rank, level, at, text, and type, rule_id, cwe, vuln_score, confidence, trace."""
    f = report_columns(findings)
    top = top_findings(f.withColumn("text", markdown_message({c: F.col(c) for c in FIELDS})).withColumn("at", location(F.col("file"), F.col("line"))), n)
    return top.select("level", "at", "text", "type", "rule_id", "cwe", "vuln_score", "confidence", F.coalesce("trace", "call_chain").alias("trace"), "ordinal")


def _detail(i: int, r) -> list[str]:
    """A finding as a numbered heading, one line of what is known of it, and its way from source to sink."""
    known = [r["level"], r["at"], r["type"], r["rule_id"] and f"rule `{r['rule_id']}`", r["cwe"], None if r["vuln_score"] is None else f"score {r['vuln_score']:.2f}", r["confidence"] and f"{r['confidence']} confidence"]
    out = [f"#### {i}. {r['text']}", "", " · ".join(x for x in known if x), ""]
    return [*out, *(f"{k}. `{step}`" for k, step in enumerate(r["trace"], 1)), ""] if r["trace"] else out


def markdown(findings: DataFrame, scan_path: str = "", suppressed: int = 0) -> str:
    """A summary for people: counts, the top 20 in a table and the top 50 in detail, and how many are left out of each."""
    f = report_columns(findings)
    counts = {r["severity"]: r["n"] for r in severity_counts(f, S.markdown_severity(F.col("severity"), F.col("vuln_score")), ["critical", "high", "medium", "low"]).collect()}
    total = f.count()
    out = [f"## Scan results: {total} finding{'' if total == 1 else 's'}", "", "| Severity | Count |", "|---|---|", *[f"| {k.capitalize()} | {v} |" for k, v in counts.items()], ""]
    out += [" | ".join([f"**Path**: `{scan_path}`", *([f"**Suppressed**: {suppressed}"] if suppressed else [])]), ""]
    if not total:
        return "\n".join([*out, "Nothing was found."])
    rows = finding_details(f).collect()
    out += ["### Top findings", "", "| # | Severity | Location | Description |", "|---|---|---|---|"]
    out += [f"| {i} | {r['level'].capitalize()} | {r['at']} | {r['text'].replace('|', chr(92) + '|')} |" for i, r in enumerate(rows[:TOP_FINDINGS], 1)]
    if total > TOP_FINDINGS:
        out.append(f"| | | | *{total - TOP_FINDINGS} more* |")
    out += ["", "### Details", ""]
    for i, r in enumerate(rows, 1):
        out += _detail(i, r)
    if total > len(rows):
        out.append(f"*{total - len(rows)} further findings are in the JSON report.*")
    return "\n".join(out)


def _escaped(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def html_document(findings: DataFrame) -> Document:
    f = report_columns(findings).withColumn("message", message(F.col("type"), {n: F.col(n) for n in FIELDS}, F.coalesce("message", "rule_description", F.lit(""))))
    sev = S.html_severity(F.col("severity"), F.lit(None).cast("string"))
    charts = {
        "severity": [list(r) for r in severity_counts(f, sev, ["critical", "high", "medium", "low", "info", "unknown"]).where("n > 0").collect()],
        "files": [list(r) for r in top_counts(f, F.element_at(F.split(F.coalesce("file", F.lit("unknown")), "/", -1), -1), TOP_FILES).collect()],
        "types": [list(r) for r in top_counts(f, F.coalesce("type", F.lit("unknown")), TOP_TYPES).collect()],
    }
    rows = f.withColumn("level", sev).withColumn("fix", S.remediation(F.coalesce("type", F.lit(""))))
    rows = numbered(rows.withColumn("_order", F.struct(-S.severity_of(F.col("level")), "ordinal")), "_order")
    cells = [F.concat(F.lit("<td>"), _escaped(F.coalesce(F.col(n).cast("string"), F.lit(""))), F.lit("</td>")) for n in ("level", "type", "file", "line", "message", "fix")]
    head = f"<!doctype html><meta charset='utf-8'><title>Scan</title><script>const charts={json.dumps(charts).replace('</', '<' + chr(92) + '/')};</script><table>\n"
    return Document(head, rows.select("position", F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("text")), "\n", "\n</table>\n")


def text_document(findings: DataFrame) -> Document:
    f = report_columns(findings).withColumn("message", message(F.col("type"), {n: F.col(n) for n in FIELDS}, F.coalesce("message", "rule_description", F.lit(""))))
    counts = severity_counts(f, F.lower("severity"), ["critical", "high", "medium", "low"]).collect()
    rows = numbered(f.withColumn("_order", F.struct(-S.severity_of(F.col("severity")), "ordinal")), "_order")
    text = F.concat(F.lit("["), F.coalesce("severity", F.lit("")), F.lit("] "), F.coalesce("file", F.lit("")), F.lit(":"), F.coalesce(F.col("line").cast("string"), F.lit("")), F.lit(" "), F.coalesce("type", F.lit("")), F.lit(" "), F.col("message"))
    return Document("", rows.select("position", text.alias("text")), "\n", "\n" + "\n".join(f"{r.severity}: {r.n}" for r in counts))
