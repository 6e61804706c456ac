"""YAML rules: read and checked on the driver, merged, and handed on as a small table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

SEVERITIES, CONFIDENCES = ("critical", "high", "medium", "low", "info"), ("high", "medium", "low")
PATTERNS, LANGUAGES = ("function_call", "import", "string_match", "ast_pattern"), ("python", "javascript", "typescript", "go")
SCHEMA = "id string, name string, severity string, confidence string, category string, message string, cwe string, enabled boolean, languages array<string>, tags array<string>, pattern_type string, names array<string>, references array<string>"
BUILTIN = os.path.join(os.path.dirname(os.path.dirname(__file__)), "rules")


class RuleError(ValueError):
    """A rule that cannot be used."""


def problems(rule: dict) -> list[str]:
    """What is wrong with a rule; nothing if it is fine."""
    out = [f"no {k}" for k in ("id", "name", "severity", "message", "pattern") if not rule.get(k)]
    if out:
        return out
    p = rule["pattern"]
    if str(rule["severity"]).lower() not in SEVERITIES:
        out.append(f"severity {rule['severity']}")
    if str(rule.get("confidence", "medium")).lower() not in CONFIDENCES:
        out.append(f"confidence {rule['confidence']}")
    out += [f"language {x}" for x in rule.get("languages", []) if str(x).lower() not in LANGUAGES]
    if not isinstance(p, dict) or p.get("type") not in PATTERNS:
        return [*out, "pattern type"]
    if p["type"] == "function_call" and not (p.get("name") or p.get("names")):
        out.append("function_call without a name")
    return out


def parsed(rule: dict) -> tuple:
    """A row of SCHEMA, with defaults."""
    p = rule["pattern"]
    names = list(dict.fromkeys([*([p["name"]] if p.get("name") else []), *(p.get("names") or [])]))
    return (
        rule["id"], rule["name"], str(rule["severity"]).lower(), str(rule.get("confidence", "medium")).lower(), rule.get("category", "general"), rule["message"], rule.get("cwe"), bool(rule.get("enabled", True)),
        [str(x).lower() for x in rule.get("languages", ["python"])], list(rule.get("tags", [])), p["type"], names, [str(x) for x in rule.get("references") or []],
    )


def load_file(path: str, strict: bool = False) -> list[dict]:
    """Valid, enabled rules of a file; with strict the first bad one is an error."""
    import yaml

    try:
        with open(path, encoding="utf-8") as f:
            data = yaml.safe_load(f)
    except (OSError, yaml.YAMLError) as e:
        if strict:
            raise RuleError(f"{path}: {e}") from e
        return []
    rules = data.get("rules", []) if isinstance(data, dict) else data if isinstance(data, list) else []
    out = []
    for r in rules:
        bad = problems(r) if isinstance(r, dict) else ["no mapping"]
        if bad and strict:
            raise RuleError(f"{path}: {', '.join(bad)}")
        if not bad and r.get("enabled", True):
            out.append(r)
    return out


def load_folder(path: str, strict: bool = False) -> list[dict]:
    if not os.path.isdir(path):
        return []
    return [r for n in sorted(os.listdir(path)) if n.endswith((".yml", ".yaml")) for r in load_file(os.path.join(path, n), strict)]


def load_all(extra: list[str] = (), strict: bool = False) -> list[dict]:
    """Built-in rules, replaced in place by later ones with the same id."""
    merged: dict[str, dict] = {}
    for folder in (BUILTIN, *extra):
        for r in load_folder(folder, strict):
            merged[r["id"]] = r
    return list(merged.values())


def rule_table(spark: SparkSession, rules: list[dict] | None = None) -> DataFrame:
    return spark.createDataFrame([parsed(r) for r in (load_all() if rules is None else rules)], SCHEMA)


def rules_for(rules: DataFrame, language: str) -> DataFrame:
    """The enabled rules for a language."""
    from pyspark.sql import functions as F

    return rules.where(F.col("enabled") & F.array_contains("languages", language.lower()))


def rule_by_id(rules: DataFrame, rule_id: str) -> DataFrame:
    from pyspark.sql import functions as F

    return rules.where(F.col("id") == rule_id)


def callees(rules: DataFrame, language: str | None = None) -> DataFrame:
    """(callee, id): the function names that call rules look for."""
    from pyspark.sql import functions as F

    some = rules_for(rules, language) if language else rules.where("enabled")
    return some.where("pattern_type = 'function_call'").select(F.explode("names").alias("callee"), "id")


def merged_rules(builtin: DataFrame, user: DataFrame) -> DataFrame:
    """The same merge on tables: a full outer join by id, the user's side first."""
    from pyspark.sql import functions as F

    b, u = builtin.alias("b"), user.alias("u")
    return b.join(u, F.col("b.id") == F.col("u.id"), "full_outer").select(*[F.when(F.col("u.id").isNotNull(), F.col(f"u.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in builtin.columns])
