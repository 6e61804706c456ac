"""Regex rules over lines, blocks and whole files. A catalogue becomes one projection of literal patterns, no join."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from sparkwarden.functions import catalog as C
from sparkwarden.functions.catalog import Rule

from .literals import may_match

#: Flags in front of every pattern: Unicode classes and plain line ends, as in Python. "" keeps them ASCII.
UNICODE = "(?dU)"
COLUMNS = ["file", "line", "rule_id", "type", "name", "severity", "cwe", "message"]


def _any(text: Column, patterns: tuple[str, ...], flags: str) -> Column:
    """Whether a pattern matches; each is tried where the texts that it needs are."""
    tests = [(may_match(text, (p,)), text.rlike(flags + p)) for p in patterns]
    return reduce(lambda a, b: a | b, [test if need is None else need & test for need, test in tests])


def _fields(rule: Rule) -> list[Column]:
    return [F.lit(getattr(rule, k)).alias(k) for k in COLUMNS[2:]]


def _found(rows: DataFrame, tests: list[tuple[Rule, Column]]) -> DataFrame:
    """One finding for each rule whose test holds, in catalogue order; rows carry file and line."""
    none = F.filter(F.array(*[F.when(test, F.struct(*_fields(rule))) for rule, test in tests]), lambda x: x.isNotNull())
    return rows.select("file", "line", F.explode(none).alias("r")).select("file", "line", *[f"r.{k}" for k in COLUMNS[2:]])


def is_comment(line: Column) -> Column:
    start = F.trim(F.regexp_replace(line, r"^\s+", ""))
    return start.startswith("//") | start.startswith("/*")


def line_findings(lines: DataFrame, rules: list[Rule], flags: str = UNICODE) -> DataFrame:
    """Findings (COLUMNS) of rules on lines(file, line_no, line); rules skip comment lines unless they say otherwise."""
    line = F.col("line")
    comment = is_comment(line)
    tests = [(r, _any(line, r.patterns, flags) & (F.lit(True) if r.comments else ~comment)) for r in rules]
    hit = reduce(lambda a, b: a | b, [t for _, t in tests])
    rows = lines.where(hit).select("file", F.col("line_no").alias("no"), "line")
    none = F.filter(F.array(*[F.when(test, F.struct(*_fields(rule))) for rule, test in tests]), lambda x: x.isNotNull())
    return rows.select("file", F.col("no").alias("line"), F.explode(none).alias("r")).select("file", "line", *[f"r.{k}" for k in COLUMNS[2:]])


def postmessage_findings(files: DataFrame, flags: str = UNICODE, ahead: int = 20) -> DataFrame:
    """Message listeners with no origin check in the next lines: each looks ahead in its own file's array of lines."""
    text = F.regexp_replace("content", "\r\n?", "\n")
    # only files with a listener are split
    some = files.where(F.col("content").rlike(flags + C.LISTENER)).select("file", F.split(text, "\n", -1).alias("all"))
    line = lambda i: F.get("all", i)
    listens = lambda i: _any(line(i), (C.LISTENER,), flags) & ~is_comment(line(i))
    seen = lambda i: F.exists(F.slice("all", i + 2, F.lit(ahead)), lambda x: _any(x, C.ORIGIN, flags))
    # only listeners are rows, without the lines
    at = F.filter(F.sequence(F.lit(0), F.size("all") - 1), lambda i: listens(i) & ~seen(i))
    return some.select("file", F.explode(at).alias("i")).select("file", (F.col("i") + 1).cast("bigint").alias("line"), *_fields(C.POSTMESSAGE))


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _numbered(rule: int):
    return lambda x, k: F.struct(F.lit(rule).alias("rule"), k.alias("k"), x["g"].alias("g"), _newlines(x["m"]).alias("n"), F.left(x["m"], F.lit(120)).alias("match"))


def content_findings(files: DataFrame, rules: list[Rule], flags: str = UNICODE) -> DataFrame:
    """Every non-overlapping match in a file's content: COLUMNS and match (120 characters); a file's matches share a window."""
    parts = []
    for i, r in enumerate(rules):
        p = flags + r.patterns[0]
        pair = F.zip_with(F.regexp_extract_all("content", F.lit(p), 0), F.split("content", p, -1), lambda m, g: F.struct(m.alias("m"), (_newlines(g)).alias("g")))
        parts.append(F.when(_any(F.col("content"), r.patterns[:1], flags), F.transform(F.filter(pair, lambda x: x["m"].isNotNull()), _numbered(i))).otherwise(F.array().cast("array<struct<rule:int,k:int,g:int,n:int,match:string>>")))
    each = files.select("file", F.explode(F.flatten(F.array(*parts))).alias("x")).select("file", "x.*")
    before = W.partitionBy("file", "rule").orderBy("k")
    line = 1 + F.sum(F.col("g") + F.col("n")).over(before) - F.col("n")
    fields = F.element_at(F.array(*[F.struct(*_fields(r)) for r in rules]), F.col("rule") + 1)
    out = each.select("file", line.cast("bigint").alias("line"), fields.alias("r"), "match")
    return out.select("file", "line", *[f"r.{k}" for k in COLUMNS[2:]], "match")


_BLOCKS = T.ArrayType(T.StructType([T.StructField("start_line", T.LongType()), T.StructField("end_line", T.LongType()), T.StructField("text", T.StringType())]))


def terraform_blocks(content: str) -> list[dict]:
    """Resource blocks: a block ends where braces balance on a line after its first; one that never ends is none."""
    rows = content.split("\n")
    starts = [k for k, x in enumerate(rows) if x.lstrip().startswith("resource") and x.lstrip()[8:9].isspace() and x.lstrip()[8:].lstrip().startswith('"')]
    out, free = [], 0
    for s in starts:
        if s < free:
            continue
        level = 0
        for k in range(s, len(rows)):
            level += rows[k].count("{") - rows[k].count("}")
            if k > s and level <= 0:
                out.append({"start_line": s + 1, "end_line": k + 1, "text": "\n".join(rows[s : k + 1])})
                free = k + 1
                break
    return out


def _blocks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("start_line", pa.int64()), ("end_line", pa.int64()), ("text", pa.string())]))
    for a in batches:
        yield pa.array([terraform_blocks(x) if x else [] for x in a.to_pylist()], kind)


def terraform_findings(files: DataFrame, lines: DataFrame, flags: str = UNICODE) -> DataFrame:
    """Block rules (a pattern without its remedy in the same block) and line rules."""
    some = files.where(F.col("content").rlike(r'resource\s+"'))  # below the Python step
    block = some.select("file", F.explode(F.arrow_udf(_blocks, _BLOCKS)("content")).alias("b")).select("file", F.col("b.start_line").alias("line"), F.col("b.text").alias("text"))
    tests = [(r, _any(F.col("text"), r.patterns, flags) & ~F.col("text").rlike(flags + r.unless)) for r in C.TF_BLOCK_RULES]
    every = [Rule(**{**r.__dict__, "comments": True}) for r in C.TF_LINE_RULES]
    return _found(block, tests).unionByName(line_findings(lines, every, flags))


def dockerfile_findings(lines: DataFrame, flags: str = UNICODE) -> DataFrame:
    """Line rules on stripped lines that are no comment, and one finding for files that never leave root."""
    line = F.regexp_replace("line", r"^\s+|\s+$", "")
    rows = lines.select("file", "line_no", line.alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    found = line_findings(rows, [Rule(**{**r.__dict__, "comments": True}) for r in C.DOCKER_RULES], flags)
    upper = F.upper("line")
    user = upper.startswith("USER") & ~F.col("line").rlike(r"(?i)^USER\s+root\s*$")
    state = rows.groupBy("file").agg(F.bool_or(upper.startswith("FROM")).alias("f"), F.bool_or(user).alias("u"))
    return found.unionByName(state.where("f AND NOT u").select("file", F.lit(1).cast("bigint").alias("line"), *_fields(C.DOCKER_NO_USER)))


def kubernetes_findings(files: DataFrame, flags: str = UNICODE) -> DataFrame:
    """Manifests only: line rules, and one finding for containers without limits."""
    from sparkwarden.sources.readers import lines

    c = F.col("content")
    manifests = files.where(F.contains(c, F.lit("apiVersion:")) & F.contains(c, F.lit("kind:")))
    found = line_findings(lines(manifests), [Rule(**{**r.__dict__, "comments": True}) for r in C.K8S_RULES], flags)
    bare = F.contains(c, F.lit("containers:")) & ~(F.contains(c, F.lit("resources:")) & F.contains(c, F.lit("limits:")))
    return found.unionByName(manifests.where(bare).select("file", F.lit(1).cast("bigint").alias("line"), *_fields(C.K8S_NO_LIMITS)))
