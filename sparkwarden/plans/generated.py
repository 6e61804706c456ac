"""Queries over files, logs, stores and streams that are made from the tables, with SQL that computes what is in them.

Each file has as many statements, nested blocks and methods as a document's id says, and logs and stores hold an entry for each event,
so results differ from row to row and grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.functions.facts import PythonFacts, javascript
from sparkwarden.functions.table_functions import register
from sparkwarden.operators.learning import enclosing
from sparkwarden.operators.store import FindingStore, PagedTable
from sparkwarden.plans.tables import folder
from sparkwarden.sources.commits import log_churn, split_log
from sparkwarden.sources.readers import nvd_elements
from sparkwarden.streaming.sessions import sessions, write_sessions

#: Statements and nested blocks of a file's first function, and statements of its method, by the document's id.
_N, _D, _M = "doc_id % 7", "doc_id % 4", "doc_id % 5 + 1"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _times(text: str, n: str):
    return F.repeat(F.lit(text), F.expr(f"CAST({n} AS INT)"))


def javascript_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, content): the text as a comment; slashes that divide or begin expressions, nested templates, methods, arrows."""
    parts = [
        F.lit("/* "), F.replace("text", F.lit("*/"), F.lit("* /")), F.lit(" */\nfunction f"), F.col("doc_id").cast("string"), F.lit("(a) {\n"),
        _times("  a = a / 2 / b; g(/[/\"'`]/)\n", _N), _times("if (a) { ", _D), _times("}", _D), F.lit("\n  return `x ${ escape(`y ${eval(a)}`) } z`\n}\n"),
        F.lit("class C { m(q) { setTimeout(q); } get v() { return this.x } }\nconst h = (z) => { sanitize(z); return z / 2 }, r = /\"/g;\n"),
        F.lit('const o = { run() { eval("eval(1)") }, k: function named() { ; } };\n'),
    ]
    return _documents(spark, sf_dir).select(F.concat(F.lit("web/"), F.col("doc_id").cast("string"), F.lit(".js")).alias("file"), F.concat(*parts).alias("content"))


def js_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions, _ = javascript(javascript_files(spark, sf_dir))
    return functions.select("file", "name", F.col("lineno").alias("line"), "length", "nesting", F.array_join("validation", ",").alias("validation"))


def js_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, calls = javascript(javascript_files(spark, sf_dir))
    return calls.select("file", "callee", F.col("lineno").alias("line"))


def python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, file, content): a function with nested ones, a class with a method, the text as comments below."""
    parts = [
        F.lit("def a(x):\n"), _times("    y = x\n", f"{_N} + 1"), _times("    def b(z):\n        return z\n", f"LEAST({_D}, 2)"), F.lit("    return y\nclass C:\n    def m(self):\n"), _times("        pass\n", _M),
        F.lit("v = 1\n# "), F.replace("text", F.lit("\n"), F.lit("\n# ")), F.lit("\n"),
    ]
    return _documents(spark, sf_dir).select("doc_id", F.concat(F.lit("app/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("file"), F.concat(*parts).alias("content"))


def function_at_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outermost function around a line of each file, and how many functions are open there."""
    files = python_files(spark, sf_dir)
    places = files.select("doc_id", "file", (F.col("doc_id") % 23 + 1).alias("line"))
    functions = PythonFacts(files.select("file", "content")).functions.select("file", F.col("lineno").alias("a"), F.col("end_lineno").alias("b"))
    at = enclosing(places, functions)
    return places.join(at, ["file", "line"]).select("doc_id", "file", "line", F.col("a").alias("first_line"), F.col("b").alias("last_line"), "open")


#: A file of every even number is renamed at two of its events; every tenth old path is made anew between.
_K, _FIRST, _SECOND = "event_id % 200", "200 + event_id % 200", "600 + event_id % 200"
_ANEW = f"{_K} % 10 = 4 AND event_id % 3 = 0 AND event_id > {_FIRST} AND event_id <> {_SECOND}"


def commit_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (text): logs of fifty commits each, one for each event, newest first."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", F.col("user_id").cast("string").alias("who"), F.expr(f"CAST({_K} AS STRING)").alias("k"))
    path = lambda x: F.concat(F.lit(f"src/{x}"), "k", F.lit(".py"))
    even = F.expr(f"{_K} % 2 = 0")
    change = (
        F.when(even & F.expr(f"event_id = {_FIRST}"), F.concat(F.lit("R090\t"), path("f"), F.lit("\t"), path("g"))).when(even & F.expr(f"event_id = {_SECOND}"), F.concat(F.lit("R100\t"), path("g"), F.lit("\t"), path("h")))
        .when(~even | F.expr(f"event_id < {_FIRST} OR {_ANEW}"), F.concat(F.lit("M\t"), path("f"))).when(F.expr(f"event_id < {_SECOND}"), F.concat(F.lit("M\t"), path("g"))).otherwise(F.concat(F.lit("M\t"), path("h")))
    )
    text = F.concat(F.lit("commit "), F.sha1(F.col("event_id").cast("string").cast("binary")), F.lit("\nAuthor: U"), "who", F.lit(" <u"), "who", F.lit("@x.org>\nDate:   "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z\n\n    commit of a change\n\n"), change, F.lit("\n"))
    logs = e.select(F.floor(F.col("event_id") / 50).alias("part"), F.struct(-F.col("event_id"), text.alias("text")).alias("c")).groupBy("part").agg(F.sort_array(F.collect_list("c")).alias("all"))
    return logs.select(F.array_join(F.transform("all", lambda c: c["text"]), "\n").alias("text"))


def git_log_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Churn by the files' present names, from the texts of commit logs with renames."""
    return log_churn(split_log(commit_logs(spark, sf_dir)), F.lit("2030-01-01 00:00:00").cast("timestamp"))


def nvd_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of advisory documents that hold a hundred parts each, read element by element from files that are cut anywhere."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    of = lambda **k: F.struct(*[v.alias(n) for n, v in k.items()])
    text = F.concat(F.col("p_name"), F.lit(' }]{["\\'))
    cwe = F.concat(F.lit("CWE-"), F.col("p_size").cast("string"))
    cve = of(id=F.concat(F.lit("CVE-"), F.col("p_partkey").cast("string")), descriptions=F.array(of(lang=F.lit("en"), value=text)), weaknesses=F.array(of(description=F.array(of(lang=F.lit("en"), value=cwe)))))
    documents = p.select(F.floor(F.col("p_partkey") / 100).alias("k"), of(cve=cve).alias("v")).groupBy("k").agg(F.to_json(of(format=F.lit("x"), vulnerabilities=F.collect_list("v"))).alias("value"))
    path = folder(spark, "nvd")
    documents.select("value").write.text(path)
    return nvd_elements(spark, path).select("cve_id", "description", F.array_join("cwes", ",").alias("cwes"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as findings."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    none = F.lit(None).cast("string")
    severity = F.get(F.array(*map(F.lit, ("critical", "high", "medium", "low"))), (F.col("user_id") % 4).cast("int"))
    return e.select(F.col("event_id").alias("ordinal"), F.col("event_type").alias("type"), severity.alias("severity"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), (F.col("event_id") % 500).alias("line"), F.col("props").alias("message"), none.alias("rule_id"), none.alias("cwe"))


def store_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store after three scans, a delete, and a scan whose writer stopped before its commit: counts by scan and severity."""
    store, found = FindingStore(spark, folder(spark, "store")), _events(spark, sf_dir)
    for k in range(3):
        scan = store.add_scan(found.where(F.col("ordinal") % 3 == k), f"part {k}")
        if k == 1:
            store.delete_scan(scan)
    store._write_findings(found.limit(0).select("type"), "unfinished")
    names = store.scans.select(F.col("id").alias("scan_id"), "scan_path", "total_findings")
    return store.findings.groupBy("scan_id", "severity").agg(F.count("*").alias("n")).join(names, "scan_id").select("scan_path", "severity", "n", "total_findings")


def store_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of findings of one severity and the rows after it, from ranges with counts."""
    rows = _events(spark, sf_dir).select("line", "ordinal", "type", "severity")
    table = PagedTable.build(rows, folder(spark, "pages"), ["line", "ordinal"], ["severity", "type"], size=5000)
    page = table.page(4, 10, severity="high")
    last = page.orderBy(F.desc("line"), F.desc("ordinal")).first()
    after = table.after({"line": last["line"], "ordinal": last["ordinal"]}, 7, severity="high")
    return page.withColumn("part", F.lit("page")).unionByName(after.withColumn("part", F.lit("after")))


def sql_py_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions by file, in SQL text: a table function over the Python files."""
    register(spark)
    python_files(spark, sf_dir).select("file", "content").createOrReplaceTempView("sparkwarden_python_files")
    return spark.sql("""
        SELECT file, name, lineno, end_lineno, cyclomatic, row_number() OVER (PARTITION BY file ORDER BY lineno) AS nth
        FROM py_facts(TABLE(sparkwarden_python_files), kind => 'functions')""")


def sql_js_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dangerous calls by callee and validations by function, in SQL text."""
    register(spark)
    javascript_files(spark, sf_dir).createOrReplaceTempView("sparkwarden_javascript_files")
    return spark.sql("""
        SELECT 'call' AS kind, callee AS name, count(*) AS n, sum(lineno) AS lines FROM js_facts(TABLE(sparkwarden_javascript_files), kind => 'calls') GROUP BY callee
        UNION ALL
        SELECT 'validation', v, count(*), sum(lineno) FROM js_facts(TABLE(sparkwarden_javascript_files)) LATERAL VIEW explode(validation) AS v GROUP BY v""")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark.read.parquet(f"{sf_dir}/events.parquet"))


def event_sessions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions that a stream of the events has closed when all has been read."""
    path = f"{sf_dir}/events.parquet"
    # a pattern, as the table is a file or a folder
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/events.parque[t]")
    out, state = folder(spark, "sessions"), folder(spark, "state")
    write_sessions(stream, out, state).awaitTermination()
    return spark.read.parquet(out)


QUERIES = {f.__name__: f for f in (js_metrics, js_calls, function_at_line, git_log_churn, nvd_stream, store_commits, store_seek, sql_py_facts, sql_js_facts, event_sessions, event_sessions_stream)}

_JS = f"""j AS (SELECT 'web/' || doc_id || '.js' AS file, doc_id, {_N} AS n, {_D} AS d, 2 + length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS f FROM documents)"""
_PY = f"""p AS (SELECT doc_id, 'app/' || doc_id || '.py' AS file, doc_id % 23 + 1 AS line, 2 + {_N} AS body, least({_D}, 2) AS inner_, {_M} AS m FROM documents),
q AS (SELECT *, body + 2 * inner_ + 1 AS a_end FROM p),
g AS (SELECT doc_id, 1 AS a, a_end AS b, 0 AS depth FROM q UNION ALL SELECT doc_id, body + 1 + 2 * k, body + 2 + 2 * k, 1 FROM q, (VALUES (0), (1)) v(k) WHERE k < inner_ UNION ALL SELECT doc_id, a_end + 2, a_end + 2 + m, 0 FROM q)"""
_FOUND = "f AS (SELECT event_id AS ordinal, event_type AS type, ['critical', 'high', 'medium', 'low'][user_id % 4 + 1] AS severity, event_id % 500 AS line FROM events)"
_SESSIONS = """e AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '2 hours' OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e),
w AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '2 hours' AS session_end, count(*) AS n, round(sum(value), 4) AS total, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM s GROUP BY user_id, k)"""
ORACLE = {
    "event_sessions": f"WITH {_SESSIONS} SELECT * FROM w",
    "event_sessions_stream": f"WITH {_SESSIONS} SELECT * FROM w WHERE session_end < (SELECT max(ts) FROM events) - INTERVAL '1 hour'",
    "sql_py_facts": f"""WITH {_PY}, n AS (SELECT doc_id, 'a' AS name, a, b FROM g WHERE a = 1 UNION ALL SELECT doc_id, CASE WHEN depth = 1 THEN 'b' ELSE 'm' END, a, b FROM g WHERE a > 1)
  SELECT q.file, n.name, CAST(n.a AS BIGINT) AS lineno, CAST(n.b AS BIGINT) AS end_lineno, CAST(1 AS BIGINT) AS cyclomatic, CAST(row_number() OVER (PARTITION BY q.file ORDER BY n.a) AS INTEGER) AS nth FROM q JOIN n USING (doc_id)""",
    "sql_js_facts": f"""WITH {_JS}, c AS (SELECT v.callee, f + n + v.down AS line FROM j, (VALUES ('eval', 2), ('setTimeout', 4), ('eval', 6)) v(callee, down))
  SELECT 'call' AS kind, callee AS name, count(*) AS n, CAST(sum(line) AS BIGINT) AS lines FROM c GROUP BY callee UNION ALL SELECT 'validation', 'escape', count(*), CAST(sum(f) AS BIGINT) FROM j""",
    "nvd_stream": """SELECT 'CVE-' || p_partkey AS cve_id, p_name || ' }]{["\\' AS description, 'CWE-' || p_size AS cwes FROM part""",
    "store_commits": f"WITH {_FOUND} SELECT 'part ' || (ordinal % 3) AS scan_path, severity, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY ordinal % 3) AS BIGINT) AS total_findings FROM f WHERE ordinal % 3 <> 1 GROUP BY ordinal % 3, severity",
    "store_seek": f"WITH {_FOUND}, r AS (SELECT line, ordinal, type, severity, row_number() OVER (ORDER BY line, ordinal) AS i FROM f WHERE severity = 'high') SELECT line, ordinal, type, severity, CASE WHEN i <= 40 THEN 'page' ELSE 'after' END AS part FROM r WHERE i BETWEEN 31 AND 47",
    "git_log_churn": f"""SELECT 'src/' || CASE WHEN {_K} % 2 = 1 OR {_ANEW} THEN 'f' ELSE 'h' END || {_K} || '.py' AS file, count(*) AS commit_count, count(DISTINCT user_id) AS unique_authors,
  CAST(floor((epoch(TIMESTAMP '2030-01-01') - floor(epoch(max(ts)))) / 86400) AS BIGINT) AS last_modified_days FROM events GROUP BY 1""",
    "js_metrics": f"""WITH {_JS} SELECT file, 'f' || doc_id AS name, f AS line, 2 * n + CASE WHEN d > 0 THEN 1 ELSE 0 END + 1 AS length, d AS nesting, 'escape' AS validation FROM j
  UNION ALL SELECT file, v.name, f + n + v.down, 1, 0, '' FROM j, (VALUES ('<anonymous>', 4), ('<anonymous>', 4), ('<anonymous>', 6), ('named', 6)) v(name, down)""",
    "js_calls": f"WITH {_JS} SELECT file, v.callee, f + n + v.down AS line FROM j, (VALUES ('eval', 2), ('setTimeout', 4), ('eval', 6)) v(callee, down)",
    "function_at_line": f"WITH {_PY} SELECT q.doc_id, q.file, q.line, CAST(min(a) FILTER (WHERE depth = 0) AS BIGINT) AS first_line, CAST(max(b) FILTER (WHERE depth = 0) AS BIGINT) AS last_line, count(a) AS open FROM q LEFT JOIN g ON g.doc_id = q.doc_id AND q.line BETWEEN g.a AND g.b GROUP BY ALL",
}
