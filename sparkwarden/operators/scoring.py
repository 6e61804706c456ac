"""Severity, confidence and scores of findings; filters and orders over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions import catalog as C


def severity_of(text: Column) -> Column:
    """Ordinal of a label; unknown ones are medium, a missing one is low."""
    t = F.lower(F.trim(text))
    return F.when(text.isNull(), 1).when(t == "low", 1).when(t == "high", 3).when(t == "critical", 4).otherwise(2)


def confidence_of(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t == "low", 1).when(t == "high", 3).otherwise(2)


def severity_label(ordinal: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ("Low", "Medium", "High", "Critical"))), ordinal)


def confidence_label(ordinal: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ("Low", "Medium", "High"))), ordinal)


def combined_score(severity: Column, confidence: Column, ml: Column) -> Column:
    """0.6 * severity/4 * confidence/3 + 0.4 * ml (0.5 if null), between 0 and 1, three places, half to even."""
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.05) * severity * confidence + F.lit(0.4) * F.coalesce(ml, F.lit(0.5)))), 3)


def matched_rules(finding: DataFrame) -> Column:
    """Rules that a function finding's attributes match, in order."""
    names = set(finding.columns)
    none = F.array().cast("array<string>")

    def has(k: str) -> Column:
        return F.col(k) if k in names else F.lit(None)

    def calls(k: str) -> Column:
        return F.coalesce(F.col(k), none) if k in names else none

    def one(test: Column, rule: str) -> Column:
        return F.when(test, F.array(F.lit(rule))).otherwise(none)

    danger = F.transform(calls("dangerous_calls"), lambda c: F.when(c.contains("eval"), "PY-EVAL-001").when(c.contains("exec") & ~c.contains("subprocess"), "PY-EXEC-001").when(c.contains("subprocess") | c.contains("os.system") | c.contains("os.popen"), "PY-CMDI-001"))
    load = F.transform(calls("deserialization_calls"), lambda c: F.when(c.contains("dill") | c.contains("cloudpickle"), "PY-DESER-002").otherwise("PY-DESER-001"))
    crypto = F.transform(calls("weak_crypto_calls"), lambda c: F.when(c.contains("DES") | c.contains("ARC4"), "PY-CRYPTO-002").otherwise("PY-CRYPTO-001"))
    parts = [
        danger, load, one(F.size(calls("ssrf_calls")) > 0, "PY-SSRF-001"), one(F.size(calls("path_traversal_calls")) > 0, "PY-PATH-001"), one(F.size(calls("xxe_calls")) > 0, "PY-XXE-001"), crypto,
        one(F.size(calls("template_injection_calls")) > 0, "PY-TMPL-001"), one(F.size(calls("open_redirect_calls")) > 0, "PY-REDIR-001"), one(F.size(calls("ldap_injection_calls")) > 0, "PY-LDAP-001"),
        one(F.coalesce(has("sensitive_data_involved").cast("boolean"), F.lit(False)), "PY-SECRET-001"), one(F.coalesce(has("cyclomatic_complexity").cast("int"), F.lit(0)) > 15, "PY-COMPLEX-001"), one(F.coalesce(has("max_nesting_depth").cast("int"), F.lit(0)) > 5, "PY-NESTING-001"),
    ]
    return F.filter(F.concat(*parts), lambda r: r.isNotNull())


def classified(findings: DataFrame) -> DataFrame:
    """findings with the best matched rule: highest severity, then confidence, then the first; UNKNOWN, low, low if none beats that."""
    table = F.create_map(*[x for k, (s, c, d) in C.REGISTRY.items() for x in (F.lit(k), F.struct(F.lit(s).alias("s"), F.lit(c).alias("c"), F.lit(d).alias("d")))])
    ranked = F.transform("_rules", lambda r, i: F.struct((table[r]["s"] * 10 + table[r]["c"]).alias("rank"), (-i).alias("order"), r.alias("rule")))
    best = F.array_max(F.filter(ranked, lambda x: x["rank"] > 11))
    out = findings.withColumn("_rules", matched_rules(findings)).withColumn("_best", best["rule"])
    s, c = F.coalesce(table[F.col("_best")]["s"], F.lit(1)), F.coalesce(table[F.col("_best")]["c"], F.lit(1))
    ml = F.col("vuln_score") if "vuln_score" in findings.columns else F.lit(None).cast("double")
    out = out.withColumns({"severity": severity_label(s), "confidence": confidence_label(c), "rule_id": F.coalesce("_best", F.lit("UNKNOWN")), "rule_description": F.coalesce(table[F.col("_best")]["d"], F.lit("Unclassified finding")), "combined_score": combined_score(s, c, ml)})
    return out.drop("_rules", "_best")


def at_least(findings: DataFrame, minimum: str) -> DataFrame:
    least = {"low": 1, "high": 3, "critical": 4}.get(minimum.lower().strip(), 2)
    return findings.where(severity_of(F.col("severity")) >= least)


def by_severity(findings: DataFrame, order: str = "ordinal") -> DataFrame:
    """Most severe first, then the best score, then the order findings came in."""
    return findings.orderBy(severity_of(F.col("severity")).desc(), F.col("combined_score").desc(), F.col(order))


def auto_label(dangerous: Column, complexity: Column, nesting: Column, kind: Column) -> Column:
    return (F.coalesce(F.size(dangerous) > 0, F.lit(False)) | F.coalesce(complexity > 10, F.lit(False)) | F.coalesce(nesting > 5, F.lit(False)) | F.coalesce(kind == "interprocedural_taint", F.lit(False))).cast("int")


# one severity for each report


def _scored(score: Column, high: str, medium: str, low: str, other: Column) -> Column:
    return F.when(score >= 0.8, high).when(score >= 0.5, medium).when(score.isNotNull(), low).otherwise(other)


def json_severity(kind: Column, sink: Column, score: Column) -> Column:
    heuristic = (
        F.when(kind == "interprocedural_taint", "high").when(sink.isin("eval", "exec", "os.system", "subprocess.call", "cursor.execute"), "high").when(sink.isin("open", "pickle.loads", "yaml.load", "marshal.loads"), "medium")
        .when(kind == "hardcoded_secret", "high").when(kind == "dangerous_function", "medium").otherwise("low")
    )
    return _scored(score, "high", "medium", "low", heuristic)


def markdown_severity(severity: Column, score: Column) -> Column:
    s = F.lower(severity)
    return F.when(s.isin("critical", "high", "medium", "low", "info"), s).otherwise(_scored(score, "high", "medium", "low", F.lit("medium")))


def html_severity(severity: Column, confidence: Column) -> Column:
    s = F.lower(F.trim(severity))
    return F.when(s.isin("critical", "high", "medium", "low", "info", "unknown"), s).when(F.lower(F.trim(confidence)) == "high", "high").otherwise("medium")


def sarif_level(kind: Column, score: Column) -> Column:
    return _scored(score, "error", "warning", "note", F.when(kind.isin("taint_analysis", "interprocedural_taint", "hardcoded_secret"), "error").when(kind == "high_complexity", "note").otherwise("warning"))


def sarif_rule(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in C.SARIF_RULES.items() for x in kv])
    return F.coalesce(table[kind], F.lit("VP003"))


def remediation(kind: Column) -> Column:
    out = F.lit(C.REMEDIATION_DEFAULT)
    for key, text in reversed(C.REMEDIATION.items()):
        out = F.when(F.lower(kind).contains(key), text).otherwise(out)
    return out


def cwe_rule(cwe: Column) -> Column:
    """Struct rule_id, type, severity of a CWE; null if it has none."""
    return F.create_map(*[x for k, v in C.CWE_RULES.items() for x in (F.lit(k), F.struct(*[F.lit(y).alias(n) for n, y in zip(("rule_id", "type", "severity"), v, strict=True)]))])[cwe]
