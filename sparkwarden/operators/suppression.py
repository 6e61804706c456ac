"""Suppression: ignore patterns, inline markers, and baselines (exact and within a few lines)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKER = "sparkwarden"


def _glob(pattern: str, any_char: str = ".") -> str:
    """A shell glob as a regex; * crosses / where any_char is a dot."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += f"{any_char}*"
        elif c == "?":
            out += any_char
        elif c == "[" and (end := pattern.find("]", i + 1)) > 0:
            body = pattern[i:end].replace("\\", "\\\\")
            out += f"[{'^' + body[1:] if body[0] == '!' else body}]"
            i = end + 1
        else:
            out += re.escape(c)
    return out


def ignore_regexes(patterns: list[str]) -> list[str]:
    """Regexes over paths relative to the project, one for each way a pattern can match."""
    out = []
    for p in patterns:
        if p.endswith("/"):
            d = p.rstrip("/")
            out += [f"(?:^|/){_glob(d, '[^/]')}/", f"^{re.escape(d)}/"]
        elif "**" in p:
            parts = [_glob(x.strip("/"), "[^/]") for x in p.split("**") if x.strip("/")]
            out.append(f"^{'(?:.*/)?' if p.startswith('**') else ''}{'(?:.+/)?'.join(parts)}$")
        else:
            out.append(f"^{_glob(p)}$")
            if "/" not in p:
                out.append(f"(?:^|/){_glob(p, '[^/]')}$")
    return out


def ignored(path: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for r in ignore_regexes(patterns):
        out = out | path.rlike("(?s)" + r)
    return out


def inline_markers(lines: DataFrame, marker: str = MARKER) -> DataFrame:
    """(file, line_no, all_rules, rules): what comments on a line suppress; the first form that fits counts."""
    line = F.col("line")
    m = re.escape(marker)
    some = lines.where(F.contains(F.lower(line), F.lit(f"{marker.lower()}-ignore")))
    rules = [F.regexp_extract(line, rf"(?i){c}\s*{m}-ignore:\s*(.+)", 1) for c in ("#", "//")]
    whole = [line.rlike(rf"(?i){c}\s*{m}-ignore-line") for c in ("#", "//")]
    def mark(every: bool, listed: Column) -> Column:
        return F.struct(F.lit(every).alias("all"), listed.alias("list"))

    found = F.when(rules[0] != "", mark(False, rules[0])).when(whole[0], mark(True, F.lit("")))
    found = found.when(rules[1] != "", mark(False, rules[1])).when(whole[1], mark(True, F.lit("")))
    out = some.select("file", "line_no", found.alias("f")).where("f IS NOT NULL")
    return out.select("file", "line_no", F.col("f.all").alias("all_rules"), F.transform(F.split("f.list", ","), lambda r: F.upper(F.trim(r))).alias("rules"))


def fingerprint(findings: DataFrame) -> tuple[Column, Column]:
    """(rule or type, message or description) of findings, missing columns as empty."""
    have = findings.columns
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in have], F.lit(""))
    return pick("rule_id", "type"), pick("message", "description")


def known(findings: DataFrame, baseline: DataFrame, within: int = 5, kind: str = "left_semi") -> DataFrame:
    """Findings that the baseline has, at most so many lines away (kind left_anti: those it has not); a missing line is 0.

    Lines fall in buckets of within + 1, and a finding asks for its own bucket and the two beside it, so a file with many
    equal findings is joined by equality and not as a product.
    """
    fr, fm = fingerprint(findings)
    br, bm = fingerprint(baseline)
    line, size = F.coalesce(findings["line"], F.lit(0)).cast("bigint"), within + 1
    old_line = F.coalesce("line", F.lit(0)).cast("bigint")
    b = baseline.select(F.coalesce("file", F.lit("")).alias("_f"), br.alias("_r"), bm.alias("_m"), old_line.alias("_l"), F.floor(old_line / size).alias("_b")).distinct()
    # of a bucket the lines next to its neighbours suffice: its first for the bucket before, its last for the one after
    own = b.groupBy("_f", "_r", "_m", "_b").agg(F.min("_l").alias("_low"), F.max("_l").alias("_high"))
    low = own.select("_f", "_r", "_m", F.col("_b").alias("_at"), F.col("_low").alias("_x"), F.col("_high").alias("_y"))
    before = own.select("_f", "_r", "_m", (F.col("_b") - 1).alias("_at"), F.col("_low").alias("_x"), F.lit(None).cast("bigint").alias("_y"))
    after = own.select("_f", "_r", "_m", (F.col("_b") + 1).alias("_at"), F.lit(None).cast("bigint").alias("_x"), F.col("_high").alias("_y"))
    near = low.unionByName(before).unionByName(after).groupBy("_f", "_r", "_m", "_at").agg(F.collect_set("_x").alias("_xs"), F.collect_set("_y").alias("_ys"))
    hit = F.exists(F.concat("_xs", "_ys"), lambda x: F.abs(line - x) <= within)
    at = F.floor(line / size)
    return findings.join(near, (F.coalesce(findings["file"], F.lit("")) == F.col("_f")) & (fr == F.col("_r")) & (fm == F.col("_m")) & (at == F.col("_at")) & hit, kind)


def suppressed(findings: DataFrame, lines: DataFrame, patterns: list[str], baseline: DataFrame | None = None, within: int = 5, marker: str = MARKER) -> DataFrame:
    """findings with suppression_reason (null if active): ignore file, inline line, inline rule, baseline; the first that holds.

    Findings carry an `ordinal` that is theirs alone. Those without a file or a line have no inline reason.
    """
    marks = inline_markers(lines, marker).select(F.col("file").alias("_file"), F.col("line_no").alias("_no"), "all_rules", "rules")
    f = findings.join(marks, (F.col("file") == F.col("_file")) & (F.col("line") == F.col("_no")), "left")
    rule = F.upper(fingerprint(findings)[0])
    reason = F.when(F.coalesce(ignored(F.col("file"), patterns), F.lit(False)), "ignore_file").when(F.col("all_rules"), "inline_ignore_line").when(F.array_contains("rules", rule), "inline_ignore_rule")
    out = f.withColumn("suppression_reason", reason).drop("_file", "_no", "all_rules", "rules")
    if baseline is not None:
        old = known(findings, baseline, within).select("ordinal", F.lit(True).alias("_old"))
        out = out.join(old, "ordinal", "left").withColumn("suppression_reason", F.coalesce("suppression_reason", F.when(F.col("_old"), "baseline"))).drop("_old")
    return out
