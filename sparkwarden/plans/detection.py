"""Queries of the detectors over the code corpus, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.functions import catalog as C
from sparkwarden.functions.catalog import Rule
from sparkwarden.functions.facts import PythonFacts, javascript
from sparkwarden.operators import patterns as P
from sparkwarden.operators import python_code as PY
from sparkwarden.operators.rules import load_all, rule_table
from sparkwarden.operators.suppression import ignored, inline_markers, suppressed
from sparkwarden.sources.readers import iac_kind, lines, scannable_count, scanned

from .config import profile
from .corpus import CODE_SQL, files, quoted
from .scan import findings_of

ASCII = ""  # the flags of patterns that SQL engines share
SHOWN = ["file", "line", "rule_id", "severity", "cwe"]
NO_BACKREF = [r for r in C.JS_RULES if r.rule_id != "VP-JS-002"]
REDOS = next(r for r in C.JS_RULES if r.rule_id == "VP-JS-002")
#: The same without a back-reference: its two signs, one after the other, for engines that have none.
REDOS_SPLIT = Rule(**{**REDOS.__dict__, "patterns": (*(REDOS.patterns[0].replace("([+*])", sign).replace(r"\1", sign) for sign in (r"\+", r"\*")), *REDOS.patterns[1:])})
REDOS_PLAIN = Rule(**{**REDOS.__dict__, "patterns": REDOS.patterns[1:]})
INLINE_SCRIPT = Rule("SW-HTML-001", "inline_script", "Inline Script", "low", "CWE-79", "Inline script", (r"<script>", r"document\.write\("), comments=True)


def _only(suffix: str, fs: DataFrame) -> DataFrame:
    return fs.where(F.col("file").endswith(suffix))


def _docs(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id", text: str = "text") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(F.col(key).cast("string").alias("file"), F.coalesce(text, F.lit("")).alias("content"))


def secret_scan(spark, sf_dir):
    return P.line_findings(lines(_docs(spark, sf_dir)), [C.SECRET_RULE], ASCII).select(*SHOWN)


def js_line_rules(spark, sf_dir):
    return P.line_findings(lines(scanned(files(spark, sf_dir), "js_patterns")), NO_BACKREF, ASCII).select(*SHOWN)


def js_redos(spark, sf_dir):
    return P.line_findings(lines(scanned(files(spark, sf_dir), "js_patterns")), [REDOS_PLAIN], ASCII).select(*SHOWN)


def js_redos_backref(spark, sf_dir):
    return P.line_findings(lines(scanned(files(spark, sf_dir), "js_patterns")), [REDOS], ASCII).select(*SHOWN)


def js_postmessage_window(spark, sf_dir):
    return P.postmessage_findings(scanned(files(spark, sf_dir), "js_patterns"), ASCII).select(*SHOWN)


def ts_line_rules(spark, sf_dir):
    return P.line_findings(lines(scanned(files(spark, sf_dir), "typescript")), C.TS_RULES, ASCII).select(*SHOWN)


def go_offset_rules(spark, sf_dir):
    return P.content_findings(scanned(files(spark, sf_dir), "go"), C.GO_RULES, ASCII).select(*SHOWN, "match")


def terraform(spark, sf_dir):
    fs = _only(".tf", files(spark, sf_dir))
    return P.terraform_findings(fs, lines(fs), ASCII).select(*SHOWN)


def dockerfile(spark, sf_dir):
    fs = files(spark, sf_dir).where(iac_kind(F.col("file")) == "dockerfile")
    return P.dockerfile_findings(lines(fs), ASCII).select(*SHOWN)


def kubernetes(spark, sf_dir):
    fs = files(spark, sf_dir).where(iac_kind(F.col("file")) == "kubernetes")
    return P.kubernetes_findings(fs, ASCII).select(*SHOWN)


def html_script_scan(spark, sf_dir):
    return P.line_findings(lines(_docs(spark, sf_dir, "pages", "page_id", "html")), [INLINE_SCRIPT], ASCII).select(*SHOWN)


def _facts(spark, sf_dir):
    return PythonFacts(scanned(files(spark, sf_dir), "python"))


def py_function_findings(spark, sf_dir):
    f = PY.function_findings(_facts(spark, sf_dir))
    return f.select(
        "file", "function", "line", "length", *[F.array_join(f"{k}_calls", ",").alias(f"{k}_calls") for k in C.SINKS], "cyclomatic_complexity", "max_nesting_depth",
        F.array_join("input_validation", ",").alias("input_validation"), "sensitive_data_involved", "num_sensitive_vars",
    )


def py_calls(spark, sf_dir):
    """Every call in the corpus's Python files, which SQL finds in the text of their lines."""
    return _facts(spark, sf_dir).calls.select("file", F.col("lineno").alias("line"), "callee")


#: Python text of a function whose branches, levels, sources and sinks follow from the document's id, in an expression that both engines read.
_GENERATED = (
    "concat('def run(a, token):\n    eval(a)\n', repeat('    if a:\n        a()\n', CAST(doc_id % 20 AS INT)), repeat('    for x in a:\n        while x:\n            x()\n', CAST(doc_id % 3 AS INT)), "
    "repeat('    v = input()\n', CAST(doc_id % 4 AS INT)), repeat('    os.popen(v)\n', CAST(doc_id % 5 AS INT)), CASE WHEN doc_id % 7 = 0 THEN '    v = open(a)\n    os.popen(token, v)\n' ELSE '' END)"
)


def _generated(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.expr(_GENERATED.replace("\n", "\\n")).alias("content"))
    return PythonFacts(d.select(F.format_string("gen/d%d.py", "doc_id").alias("file"), "content"))


def py_metrics(spark, sf_dir):
    """Function metrics of generated files: branches, levels and statements follow from the id."""
    f = PY.function_findings(_generated(spark, sf_dir))
    return f.select("file", "function", "line", "length", "cyclomatic_complexity", "max_nesting_depth", F.array_join("dangerous_calls", ",").alias("dangerous_calls"), F.array_join("path_traversal_calls", ",").alias("path_traversal_calls"), "num_sensitive_vars")


def py_taint_lines(spark, sf_dir):
    """Sinks of generated files with the last source before them, whose place follows from the id."""
    t = PY.taint_findings(_generated(spark, sf_dir))
    return t.select("file", "variable", "sink", "sink_line", F.col("source.line").alias("source_line"), F.col("source.name").alias("source"))


def py_taint_asof(spark, sf_dir):
    t = PY.taint_findings(_facts(spark, sf_dir))
    return t.select("file", "variable", "sink", "sink_line", F.col("source.line").alias("source_line"), F.col("source.name").alias("source"), F.size("trace").cast("bigint").alias("trace_length"))


def py_flow(spark, sf_dir):
    return PY.flow_findings(_facts(spark, sf_dir)).select("source_func", "sink_func", "sink", "sink_line", "tainted_var", F.size("call_chain").cast("bigint").alias("chain_length"))


def py_flow_propagated(spark, sf_dir):
    flows = PY.flow_findings(_facts(spark, sf_dir), propagate=True)
    return flows.select("source_func", "sink_func", "sink", "sink_line", "tainted_var", F.size("call_chain").cast("bigint").alias("chain_length"))


def py_parse_errors(spark, sf_dir):
    return _facts(spark, sf_dir).errors.select("file", F.split_part("error", F.lit(":"), F.lit(1)).alias("error"))


def yaml_rule_match(spark, sf_dir):
    return PY.rule_matches(_facts(spark, sf_dir).calls, rule_table(spark)).select("file", "line", "callee", "rule_id", "severity", "description")


def js_dangerous_calls(spark, sf_dir):
    _, calls = javascript(scanned(files(spark, sf_dir), "javascript"))
    return calls.select("file", "callee", F.col("lineno").alias("line"))


def js_functions(spark, sf_dir):
    functions, _ = javascript(scanned(files(spark, sf_dir), "javascript"))
    return functions.select("file", "name", F.col("lineno").alias("line"), "length", "nesting", F.array_join("validation", ",").alias("validation"))


def scan_findings(spark, sf_dir):
    """The scan's analyzers over all files of the corpus, with patterns that SQL engines share."""
    found = findings_of(files(spark, sf_dir), profile("standard"), flags=ASCII).withColumn("rule_id", F.coalesce("rule_id", F.lit("")))
    return found.groupBy("file", "type", "line", "rule_id").agg(F.count("*").alias("n"))


def scanner_dispatch(spark, sf_dir):
    fs = files(spark, sf_dir)
    kinds = scanned(fs, "iac").groupBy(iac_kind(F.col("file")).alias("kind")).agg(F.count("*").alias("n"))
    return kinds.unionByName(scannable_count(fs).select(F.lit("scannable").alias("kind"), F.col("n_files").alias("n")))


IGNORE = ["web/", "srv/*.go", "**/d1*.py", "*.yaml"]


def suppress_ignore(spark, sf_dir):
    return files(spark, sf_dir).select("file", ignored(F.col("file"), IGNORE).alias("ignored"))


def suppress_inline(spark, sf_dir):
    m = inline_markers(lines(files(spark, sf_dir)))
    return m.select("file", "line_no", "all_rules", F.array_join("rules", "|").alias("rules"))


def _proto(spark, sf_dir):
    ls = lines(scanned(files(spark, sf_dir), "js_patterns"))
    f = P.line_findings(ls, C.JS_RULES[:1], ASCII)
    return f.withColumn("ordinal", F.xxhash64("file", "line")), ls


def suppression_reasons(spark, sf_dir):
    f, ls = _proto(spark, sf_dir)
    old = f.where("line = 7").select("file", (F.col("line") + 4).alias("line"), "rule_id", "message")
    marked = suppressed(f, ls, ["web/d1*.js"], old)
    return marked.groupBy(F.coalesce("suppression_reason", F.lit("active")).alias("reason")).agg(F.count("*").alias("n"))


QUERIES = {
    k: globals()[k]
    for k in """secret_scan js_line_rules js_redos js_redos_backref js_postmessage_window ts_line_rules go_offset_rules terraform dockerfile kubernetes html_script_scan
    py_function_findings py_calls py_metrics py_taint_lines py_taint_asof py_flow py_flow_propagated py_parse_errors yaml_rule_match js_dangerous_calls js_functions scan_findings scanner_dispatch suppress_ignore suppress_inline suppression_reasons""".split()
}


# SQL


def _sql_rules(source: str, rules: list[Rule]) -> str:
    """Line rules over source(file, line_no, line)."""
    parts = []
    for r in rules:
        test = " OR ".join(f"regexp_matches(line, {quoted(p)})" for p in r.patterns)
        skip = "" if r.comments else r" AND NOT regexp_matches(line, '^\s*(//|/\*)')"
        parts.append(f"SELECT file, line_no AS line, '{r.rule_id}' AS rule_id, '{r.severity}' AS severity, '{r.cwe}' AS cwe FROM {source} WHERE ({test}){skip}")
    return " UNION ALL ".join(parts)


def _plain_lines(table: str, key: str, text: str) -> str:
    return f"lines AS (SELECT CAST({key} AS VARCHAR) AS file, unnest(string_split(coalesce({text}, ''), chr(10))) AS line, CAST(unnest(generate_series(1, len(string_split(coalesce({text}, ''), chr(10))))) AS BIGINT) AS line_no FROM {table})"


def _go_sql() -> str:
    parts = []
    for r in C.GO_RULES:
        p = quoted(r.patterns[0])
        parts.append(f"SELECT file, '{r.rule_id}' AS rule_id, '{r.severity}' AS severity, '{r.cwe}' AS cwe, unnest(regexp_extract_all(content, {p})) AS m, unnest((string_split_regex(content, {p}))[:-2]) AS g, unnest(generate_series(1, len(regexp_extract_all(content, {p})))) AS k FROM code WHERE file LIKE '%.go' AND regexp_matches(content, {p})")
    nl = lambda c: f"(length({c}) - length(replace({c}, chr(10), '')))"
    return f"""WITH {CODE_SQL}, each AS ({" UNION ALL ".join(parts)})
SELECT file, CAST(1 + sum({nl("g")} + {nl("m")}) OVER (PARTITION BY file, rule_id ORDER BY k) - {nl("m")} AS BIGINT) AS line, rule_id, severity, cwe, substr(m, 1, 120) AS match FROM each"""


def _values(rows: list[tuple], columns: str) -> str:
    def lit(v):
        return "NULL" if v is None else quoted(v) if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else f"CAST({v} AS BIGINT)"

    return f"e({columns}) AS (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)})"


def _expected(rows: list[tuple], columns: str, select: str, where: str = "") -> str:
    return f"WITH {CODE_SQL}, {_values(rows, columns)} SELECT {select} FROM code JOIN e USING (sid) {where}"


_FN = "sid, function, line, length, " + ", ".join(f"{k}_calls" for k in C.SINKS) + ", cyclomatic_complexity, max_nesting_depth, input_validation, sensitive_data_involved, num_sensitive_vars"


def _fn(sid, name, line, length, calls, cyclomatic=1, nesting=1, validation="", sensitive=0):
    return (sid, name, line, length, *[calls.get(k, "") for k in C.SINKS], cyclomatic, nesting, validation, sensitive > 0, sensitive)


_FUNCTIONS = [
    _fn(0, "load", 1, 3, {"dangerous": "input,eval"}),
    _fn(2, "read_all", 3, 5, {"deserialization": "pickle.loads,pickle.loads", "path_traversal": "open"}, sensitive=1),
    _fn(3, "outer", 1, 3, {"dangerous": "os.system,exec"}, 6, 3),
    _fn(3, "inner", 2, 1, {"dangerous": "os.system"}),
    _fn(5, "fetch", 1, 4, {"ssrf": "requests.get"}, validation="html.escape,re.match", sensitive=2),
    _fn(22, "parse", 1, 6, {"xxe": "ET.parse", "weak_crypto": "hashlib.md5,hashlib.sha1", "template_injection": "jinja2.Template", "open_redirect": "redirect", "ldap_injection": "conn.search_s"}, sensitive=1),
    _fn(24, "last", 3, 5, {"dangerous": "input", "path_traversal": "open"}),
]
_TAINTS = [(0, "data", "eval", 3, 2, "input", 2), (2, "raw", "pickle.loads", 6, 5, "open", 2), (4, "q", "cursor.execute", 3, 2, "request.args", 2), (5, "session_id", "requests.get", 3, 2, "read", 2), (24, "v", "os.popen", 6, 5, "recv", 2), (24, "v", "os.popen", 6, 5, "recv", 2)]
_FLOWS = [(0, "load", "load", "eval", 3, "data", 1), (4, "first", "first", "cursor.execute", 3, "q", 1), (24, "last", "last", "os.popen", 6, "v", 1), (24, "last", "last", "os.popen", 6, "v", 1)]
_CALLS = {0: [("input", 2), ("eval", 3)], 2: [("yaml.load", 4), ("open", 5), ("pickle.loads", 6), ("pickle.loads", 7)], 3: [("os.system", 3), ("exec", 9)], 5: [("requests.get", 3)], 22: [("ET.parse", 2), ("hashlib.md5", 3), ("jinja2.Template", 4), ("conn.search_s", 5), ("hashlib.sha1", 6), ("redirect", 7)], 24: [("input", 4), ("recv", 5), ("os.popen", 6), ("open", 7)]}


def _rule_rows() -> list[tuple]:
    rows = []
    for r in load_all():
        p = r["pattern"]
        for name in [p["name"]] if p.get("name") else p["names"]:
            for sid, calls in _CALLS.items():
                rows += [(sid, line, callee, r["id"], r["severity"], f"{r['message']} ({r['cwe']})") for callee, line in calls if callee == name and "python" in r["languages"]]
    return rows


_SUFFIX = "regexp_matches(file, '\\.(js|jsx|mjs|ts|tsx)$')"
_JS = f"WITH {CODE_SQL}, js AS (SELECT * FROM lines WHERE {_SUFFIX}) "
_DF = "WITH " + CODE_SQL + r", d AS (SELECT file, line_no, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM lines WHERE file LIKE '%/Dockerfile'), rows AS (SELECT * FROM d WHERE line <> '' AND line NOT LIKE '#%') "
_all = lambda rules: [Rule(**{**r.__dict__, "comments": True}) for r in rules]
_ORIGIN = " OR ".join(f"regexp_matches(line, {quoted(p)})" for p in C.ORIGIN)
_PM = C.POSTMESSAGE
_LIMITS = C.K8S_NO_LIMITS
_BLOCKS = [(14, 1, "VP-TF-001", "high", "CWE-311"), (15, 1, "VP-TF-004", "high", "CWE-311")]
_inline = lambda c, tail: f"regexp_extract(line, '(?i){c}\\s*sparkwarden-ignore{tail}', 1)"

ORACLE = {
    "secret_scan": f"WITH {_plain_lines('documents', 'doc_id', 'text')} {_sql_rules('lines', [C.SECRET_RULE])}",
    "js_line_rules": _JS + _sql_rules("js", NO_BACKREF),
    "js_redos_backref": _JS + _sql_rules("js", [REDOS_SPLIT]),
    "js_redos": _JS + _sql_rules("js", [REDOS_PLAIN]),
    "js_postmessage_window": _JS + f""", w AS (SELECT file, line_no, regexp_matches(line, {quoted(C.LISTENER)}) AS l, regexp_matches(line, '^\\s*(//|/\\*)') AS c,
  coalesce(bool_or({_ORIGIN}) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING), FALSE) AS o FROM js)
SELECT file, line_no AS line, '{_PM.rule_id}' AS rule_id, '{_PM.severity}' AS severity, '{_PM.cwe}' AS cwe FROM w WHERE l AND NOT c AND NOT o""",
    "ts_line_rules": f"WITH {CODE_SQL}, t AS (SELECT * FROM lines WHERE regexp_matches(file, '\\.tsx?$')) " + _sql_rules("t", C.TS_RULES),
    "go_offset_rules": _go_sql(),
    "terraform": f"WITH {CODE_SQL}, {_values(_BLOCKS, 'sid, line, rule_id, severity, cwe')}, t AS (SELECT * FROM lines WHERE file LIKE '%.tf') SELECT file, line, rule_id, severity, cwe FROM code JOIN e USING (sid) UNION ALL " + _sql_rules("t", _all(C.TF_LINE_RULES)),
    "dockerfile": _DF + _sql_rules("rows", _all(C.DOCKER_RULES)) + f" UNION ALL SELECT file, CAST(1 AS BIGINT), '{C.DOCKER_NO_USER.rule_id}', '{C.DOCKER_NO_USER.severity}', '{C.DOCKER_NO_USER.cwe}' FROM rows GROUP BY file HAVING bool_or(upper(line) LIKE 'FROM%') AND NOT bool_or(upper(line) LIKE 'USER%' AND NOT regexp_matches(line, '(?i)^USER\\s+root\\s*$'))",
    "kubernetes": f"WITH {CODE_SQL}, m AS (SELECT * FROM code WHERE file LIKE '%.yaml' AND contains(content, 'apiVersion:') AND contains(content, 'kind:')), k AS (SELECT lines.* FROM lines JOIN m USING (file)) " + _sql_rules("k", _all(C.K8S_RULES)) + f" UNION ALL SELECT file, CAST(1 AS BIGINT), '{_LIMITS.rule_id}', '{_LIMITS.severity}', '{_LIMITS.cwe}' FROM m WHERE contains(content, 'containers:') AND NOT (contains(content, 'resources:') AND contains(content, 'limits:'))",
    "html_script_scan": f"WITH {_plain_lines('pages', 'page_id', 'html')} {_sql_rules('lines', [INLINE_SCRIPT])}",
    "py_function_findings": _expected(_FUNCTIONS, _FN, "file, " + _FN.removeprefix("sid, ")),
    "py_taint_asof": _expected(_TAINTS, "sid, variable, sink, sink_line, source_line, source, trace_length", "file, variable, sink, sink_line, source_line, source, trace_length"),
    "py_flow": _expected(_FLOWS, "sid, a, b, sink, sink_line, tainted_var, chain_length", "file || '::' || a AS source_func, file || '::' || b AS sink_func, sink, sink_line, tainted_var, chain_length"),
    "py_flow_propagated": _expected([*_FLOWS, (4, "first", "helper", "os.popen", 7, "z", 2)], "sid, a, b, sink, sink_line, tainted_var, chain_length", "file || '::' || a AS source_func, file || '::' || b AS sink_func, sink, sink_line, tainted_var, chain_length"),
    "py_parse_errors": _expected([(6, "SyntaxError")], "sid, error", "file, error"),
    "yaml_rule_match": _expected(_rule_rows(), "sid, line, callee, rule_id, severity, description", "file, line, callee, rule_id, severity, description"),
    "js_functions": _expected([(7, "run", 1, 4, 0, "")], "sid, name, line, length, nesting, validation", "file, name, line, length, nesting, validation"),
    "js_dangerous_calls": _expected([(7, "eval", 2), (7, "setTimeout", 3)], "sid, callee, line", "file, callee, line"),
    "scanner_dispatch": f"""WITH {CODE_SQL} SELECT kind, count(*) AS n FROM (SELECT CASE WHEN file LIKE '%.tf' THEN 'terraform' WHEN file LIKE '%/Dockerfile' THEN 'dockerfile' WHEN file LIKE '%.yaml' THEN 'kubernetes' END AS kind FROM code) WHERE kind IS NOT NULL GROUP BY kind
UNION ALL SELECT 'scannable', count(*) FILTER (WHERE regexp_matches(file, '\\.(py|js|jsx|ts|tsx)$')) FROM code""",
    "suppress_ignore": f"WITH {CODE_SQL} SELECT file, file LIKE 'web/%' OR file LIKE 'srv/%.go' OR regexp_matches(file, '^(.*/)?d1[^/]*\\.py$') OR file LIKE '%.yaml' AS ignored FROM code",
    "suppress_inline": f"""WITH {CODE_SQL}, m AS (SELECT file, line_no, {_inline('#', ':[ ]*(.+)')} AS a, regexp_matches(line, '(?i)#\\s*sparkwarden-ignore-line') AS b, {_inline('//', ':[ ]*(.+)')} AS c, regexp_matches(line, '(?i)//\\s*sparkwarden-ignore-line') AS d FROM lines)
SELECT file, line_no, a = '' AND (b OR c = '') AS all_rules, CASE WHEN a <> '' THEN array_to_string(list_transform(string_split(a, ','), lambda x: upper(trim(x))), '|') WHEN b THEN '' WHEN c <> '' THEN array_to_string(list_transform(string_split(c, ','), lambda x: upper(trim(x))), '|') ELSE '' END AS rules FROM m WHERE a <> '' OR b OR c <> '' OR d""",
    "suppression_reasons": _JS + f""", f AS (SELECT file, line_no AS line, contains(file, 'web/d1') AS ign, regexp_matches(line, '(?i)//\\s*sparkwarden-ignore-line') AS whole, contains(upper(line), 'SPARKWARDEN-IGNORE: VP-JS-001') AS rule
  FROM js WHERE ({" OR ".join(f"regexp_matches(line, {quoted(p)})" for p in C.JS_RULES[0].patterns)}) AND NOT regexp_matches(line, '^\\s*(//|/\\*)')),
g AS (SELECT *, EXISTS (SELECT 1 FROM f o WHERE o.file = f.file AND o.line = 7 AND abs(f.line - 11) <= 5) AS old FROM f)
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN ign THEN 'ignore_file' WHEN whole THEN 'inline_ignore_line' WHEN rule THEN 'inline_ignore_rule' WHEN old THEN 'baseline' ELSE 'active' END AS reason FROM g) GROUP BY reason""",
}

#: analyzer's query, its type, the finding's file and line, its rule
_PARTS = [
    ("py_function_findings", "'function_analysis'", "file", "line", "''"), ("py_taint_asof", "'taint_analysis'", "file", "sink_line", "''"),
    ("py_flow", "'interprocedural_taint'", "split_part(sink_func, '::', 1)", "sink_line", "''"), ("js_dangerous_calls", "'dangerous_call'", "file", "line", "''"),
    *((q, "t.type", "file", "line", "q.rule_id") for q in ("js_line_rules", "js_redos_backref", "js_postmessage_window", "ts_line_rules", "go_offset_rules", "terraform", "dockerfile", "kubernetes")),
]
_TYPES = _values([(r.rule_id, r.type) for r in [*C.JS_RULES, C.POSTMESSAGE, *C.TS_RULES, *C.GO_RULES, *C.TF_BLOCK_RULES, *C.TF_LINE_RULES, *C.DOCKER_RULES, C.DOCKER_NO_USER, *C.K8S_RULES, C.K8S_NO_LIMITS]], "rule_id, type").replace("e(", "t(", 1)
ORACLE["scan_findings"] = (
    f"WITH {_TYPES}, every AS ("
    + " UNION ALL ".join(f"SELECT {file} AS file, {kind} AS type, {line} AS line, {rule} AS rule_id FROM ({ORACLE[q]}) q" + (" JOIN t ON t.rule_id = q.rule_id" if kind == "t.type" else "") for q, kind, file, line, rule in _PARTS)
    + f" UNION ALL SELECT file, 'function_analysis', line, '' FROM ({_expected([(7, 1)], 'sid, line', 'file, line')}) q) SELECT file, type, line, rule_id, count(*) AS n FROM every GROUP BY ALL"
)

#: Lines before the sources, of sources, of sinks; all by the id.
_COUNTS = "g AS (SELECT 'gen/d' || CAST(doc_id AS VARCHAR) || '.py' AS file, doc_id % 20 AS ifs, doc_id % 3 AS loops, doc_id % 4 AS sources, doc_id % 5 AS sinks, doc_id % 7 = 0 AS more FROM documents)"
ORACLE["py_metrics"] = f"""WITH {_COUNTS} SELECT file, 'run' AS function, CAST(1 AS BIGINT) AS line, CAST(1 + ifs + loops + sources + sinks + CASE WHEN more THEN 2 ELSE 0 END AS BIGINT) AS length, CAST(1 + ifs + 2 * loops AS BIGINT) AS cyclomatic_complexity,
  CAST(CASE WHEN loops > 0 THEN 3 WHEN ifs > 0 THEN 2 ELSE 1 END AS BIGINT) AS max_nesting_depth, 'eval' || repeat(',input', CAST(sources AS BIGINT)) AS dangerous_calls, CASE WHEN more THEN 'open' ELSE '' END AS path_traversal_calls, CAST(1 AS BIGINT) AS num_sensitive_vars FROM g"""
ORACLE["py_taint_lines"] = f"""WITH {_COUNTS}, p AS (SELECT *, 2 + 2 * ifs + 3 * loops AS lead FROM g)
SELECT file, 'v' AS variable, 'os.popen' AS sink, CAST(lead + sources + k AS BIGINT) AS sink_line, CAST(lead + sources AS BIGINT) AS source_line, 'input' AS source FROM (SELECT *, unnest(generate_series(1, sinks)) AS k FROM p WHERE sources > 0)
UNION ALL SELECT file, 'v', 'os.popen', CAST(lead + sources + sinks + 2 AS BIGINT), CAST(lead + sources + sinks + 1 AS BIGINT), 'open' FROM p WHERE more"""
ORACLE["py_calls"] = f"""WITH {CODE_SQL}, p AS (SELECT file, line_no, regexp_replace(line, 'def [a-z_]+\\(', '', 'g') AS line FROM lines WHERE file LIKE '%.py' AND line NOT LIKE '#%' AND file NOT IN (SELECT file FROM code WHERE contains(content, 'def broken(:')))
SELECT file, line_no AS line, unnest(regexp_extract_all(line, '([A-Za-z_][A-Za-z0-9_.]*)\\(', 1)) AS callee FROM p"""
