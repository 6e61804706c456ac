"""Table functions of SQL: columns by kind, arguments that are refused, nulls and partitions."""

import pytest

from sparkwarden.functions.table_functions import register


@pytest.fixture(scope="module")
def sql(spark):
    register(spark)
    rows = [("a.py", "def f(x):\n    eval(x)\n"), ("b.py", "def broken(:"), ("c.py", None), ("a.js", "function g(y) { escape(y); eval(y) }")]
    spark.createDataFrame(rows, "file string, content string").createOrReplaceTempView("sources")
    return lambda text: sorted(tuple(r) for r in spark.sql(text).collect())


def test_kinds(sql):
    assert sql("SELECT * FROM py_facts(TABLE(SELECT * FROM sources WHERE file LIKE '%.py'))") == [("a.py", "f", 1, 2, 1, 1)]
    assert sql("SELECT file, callee, lineno FROM py_facts(TABLE(sources) PARTITION BY file, kind => 'calls') WHERE file = 'a.py'") == [("a.py", "eval", 2)]
    assert [r[0] for r in sql("SELECT * FROM py_facts(TABLE(sources), 'errors')")] == ["a.js", "b.py"]
    assert sql("SELECT name, validation FROM js_facts(TABLE(sources)) WHERE file = 'a.js'") == [("g", ["escape"])]
    assert sql("SELECT s.file, count(c.callee) FROM sources s LEFT JOIN js_facts(TABLE(sources), kind => 'calls') c ON s.file = c.file WHERE s.file LIKE '%.js' GROUP BY s.file") == [("a.js", 1)]


@pytest.mark.parametrize("call", ["py_facts(TABLE(sources), 'none')", "js_facts(TABLE(sources), kind => 'errors')", "py_facts(TABLE(SELECT file FROM sources))", "py_facts('x')"])
def test_refused(sql, call):
    with pytest.raises(Exception, match="kind is one of|columns file and content"):
        sql(f"SELECT * FROM {call}")
