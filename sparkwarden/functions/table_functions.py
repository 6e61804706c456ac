"""Facts of source files as table functions of SQL.

    SELECT * FROM py_facts(TABLE(files) PARTITION BY file, kind => 'calls')

Each takes a table with the columns `file` and `content`, and says by `kind`, when the query is planned, which columns it returns. Files
are independent, so any partitioning will do, and each is parsed when its row comes: no partition is held.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

_TYPES = {"string": T.StringType(), "long": T.LongType(), "list": T.ArrayType(T.StringType())}
#: Columns by kind: what the facts hold under the same names.
PYTHON = {
    "functions": {"name": "string", "lineno": "long", "end_lineno": "long", "cyclomatic": "long", "nesting": "long"},
    "calls": {"callee": "string", "lineno": "long"},
    "errors": {"error": "string"},
}
JAVASCRIPT = {"functions": {"name": "string", "lineno": "long", "length": "long", "nesting": "long", "validation": "list"}, "calls": {"callee": "string", "lineno": "long"}}


def _analyzed(kinds: dict, files: AnalyzeArgument, kind: AnalyzeArgument | None) -> AnalyzeResult:
    if not files.isTable or not {"file", "content"} <= set(files.dataType.names):
        raise ValueError("a table with the columns file and content is expected")
    chosen = "functions" if kind is None else kind.value
    if chosen not in kinds:
        raise ValueError(f"kind is one of {', '.join(kinds)}")
    return AnalyzeResult(T.StructType([T.StructField("file", T.StringType()), *(T.StructField(n, _TYPES[t]) for n, t in kinds[chosen].items())]))


class _Facts:
    kinds: dict = {}

    @staticmethod
    def facts(content: str | None) -> dict:
        raise NotImplementedError

    def eval(self, files: Row, kind: str = "functions") -> Iterator[tuple]:
        found = self.facts(files["content"]).get("error" if kind == "errors" else kind)
        if kind == "errors":
            if found is not None:
                yield files["file"], found
            return
        for x in found or ():
            yield (files["file"], *(x[n] for n in self.kinds[kind]))


class PyFacts(_Facts):
    kinds = PYTHON

    @staticmethod
    def analyze(files: AnalyzeArgument, kind: AnalyzeArgument | None = None) -> AnalyzeResult:
        return _analyzed(PYTHON, files, kind)

    @staticmethod
    def facts(content: str | None) -> dict:
        from sparkwarden.functions.facts import python_facts

        return python_facts(content)


class JsFacts(_Facts):
    kinds = JAVASCRIPT

    @staticmethod
    def analyze(files: AnalyzeArgument, kind: AnalyzeArgument | None = None) -> AnalyzeResult:
        return _analyzed(JAVASCRIPT, files, kind)

    @staticmethod
    def facts(content: str | None) -> dict:
        from sparkwarden.functions.javascript import javascript_facts

        return javascript_facts(content)


def register(spark: SparkSession) -> None:
    """py_facts and js_facts as table functions of the session's SQL."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("py_facts", udtf(PyFacts))
    spark.udtf.register("js_facts", udtf(JsFacts))
