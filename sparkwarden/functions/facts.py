"""Facts from Python and JavaScript sources: the only step that needs code on executors. All rules over facts are joins.

One pass over a file gives its functions, calls and assignments; a file that does not parse gives an error and no facts.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwarden.plans.tables import held

from .catalog import SENSITIVE_KEYWORDS, VALIDATION_FUNCTIONS, VALIDATION_MODULES
from .javascript import javascript_facts

_NAME = pa.struct([("pos", pa.int64()), ("id", pa.string())])
_FUNCTION = pa.struct([("fn_id", pa.int64()), ("name", pa.string()), ("lineno", pa.int64()), ("end_lineno", pa.int64()), ("length", pa.int64()), ("cyclomatic", pa.int64()), ("nesting", pa.int64()), ("args", pa.list_(pa.string())), ("validation", pa.list_(pa.string())), ("sensitive", pa.list_(pa.string())), ("depth", pa.int64())])
_CALL = pa.struct([("visit_pos", pa.int64()), ("lineno", pa.int64()), ("callee", pa.string()), ("names", pa.list_(_NAME)), ("safe_loader", pa.bool_()), ("depth", pa.int64()), ("fn_ids", pa.list_(pa.int64()))])
_ASSIGN = pa.struct([("visit_pos", pa.int64()), ("lineno", pa.int64()), ("targets", pa.list_(pa.string())), ("callee", pa.string()), ("fn_ids", pa.list_(pa.int64()))])
_FACTS = pa.struct([("functions", pa.list_(_FUNCTION)), ("calls", pa.list_(_CALL)), ("assigns", pa.list_(_ASSIGN)), ("error", pa.string())])
_SAFE = {"SafeLoader", "CSafeLoader", "BaseLoader"}
_BRANCHES = (ast.If, ast.For, ast.While, ast.And, ast.Or, ast.ExceptHandler, ast.With, ast.Try)


def dotted(node: ast.AST) -> str:
    """a.b.c of names and attributes; anything else on the left adds nothing before its dot."""
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    parts.append(node.id if isinstance(node, ast.Name) else "")
    return ".".join(reversed(parts))


def _bodies(node: ast.AST) -> int:
    """Levels of statement bodies below a node."""
    level, now = -1, [node]
    while now:
        bodies = [getattr(n, "body", None) for n in now]
        now = [x for b in bodies if isinstance(b, list) for x in b]
        level += 1
    return level


def _loader(node: ast.Call) -> bool:
    values = [k.value for k in node.keywords if k.arg == "Loader"] or node.args[1:2]
    return any((v.attr if isinstance(v, ast.Attribute) else getattr(v, "id", "")) in _SAFE for v in values)


def python_facts(source: str | None) -> dict:
    empty: dict = {"functions": [], "calls": [], "assigns": [], "error": None}
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return empty | {"error": f"{type(e).__name__}: {e}"[:200]}
    # pre-order over the tree with an explicit stack; each entry knows the plain functions around it
    stack: list[tuple[ast.AST, tuple[int, ...], int]] = [(tree, (), 0)]
    pos = -1
    functions, tops = empty["functions"], {}
    while stack:
        node, around, depth = stack.pop()
        pos += 1
        if isinstance(node, ast.FunctionDef):
            around = (*around, len(functions))
            tops[around[-1]] = node
            functions.append({"fn_id": around[-1], "name": node.name, "lineno": node.lineno, "end_lineno": node.end_lineno, "length": len(node.body), "cyclomatic": 1, "nesting": _bodies(node), "args": [a.arg for a in node.args.args], "validation": set(), "sensitive": set(), "depth": depth})
            for f in around:
                functions[f]["sensitive"].update(a.arg for a in node.args.args if any(k in a.arg.lower() for k in SENSITIVE_KEYWORDS))
        if isinstance(node, _BRANCHES):
            for f in around:
                functions[f]["cyclomatic"] += 1
        if isinstance(node, ast.Call):
            name = dotted(node.func)
            empty["calls"].append({"visit_pos": pos, "lineno": node.lineno, "callee": name, "names": [{"pos": i, "id": a.id} for i, a in enumerate(node.args) if isinstance(a, ast.Name)], "safe_loader": _loader(node), "depth": depth, "fn_ids": list(around)})
            if any(name.startswith(m) for m in VALIDATION_MODULES) and any(name.endswith(v) for v in VALIDATION_FUNCTIONS):
                for f in around:
                    functions[f]["validation"].add(name)
        if isinstance(node, ast.Assign):
            names = [t.id for t in node.targets if isinstance(t, ast.Name)]
            for f in around:
                functions[f]["sensitive"].update(n for n in names if any(k in n.lower() for k in SENSITIVE_KEYWORDS))
            if isinstance(node.value, ast.Call):
                empty["assigns"].append({"visit_pos": pos, "lineno": node.lineno, "targets": names, "callee": dotted(node.value.func), "fn_ids": list(around)})
        stack += [(c, around, depth + 1) for c in reversed(list(ast.iter_child_nodes(node)))]
    for f in functions:
        f["validation"], f["sensitive"] = sorted(f["validation"]), sorted(f["sensitive"])
    return empty


def _python(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for a in batches:
        yield pa.array([python_facts(x) for x in a.to_pylist()], _FACTS)


def _spark_type(t: pa.DataType) -> T.DataType:
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(t)


def _extracted(files: DataFrame, extract, kind: pa.DataType) -> DataFrame:
    """files(file, content) to file and the fields of what the function finds, as a table: each file is parsed once.

    The function counts as nondeterministic, so filters that follow from later joins are not evaluated by parsing again.
    """
    parse = F.arrow_udf(extract, _spark_type(kind)).asNondeterministic()
    return held(files.select("file", parse("content").alias("x")).select("file", "x.*"))


class PythonFacts:
    """functions, calls, assigns and errors of files(file, content), each read from its own column of one table."""

    def __init__(self, files: DataFrame):
        facts = _extracted(files, _python, _FACTS)
        self.facts = facts
        self.functions = facts.select("file", F.explode("functions").alias("x")).select("file", "x.*")
        self.calls = facts.select("file", F.explode("calls").alias("x")).select("file", "x.*")
        self.assigns = facts.select("file", F.explode("assigns").alias("x")).select("file", "x.*")
        self.errors = facts.where("error IS NOT NULL").select("file", "error")


_JS = pa.struct([("functions", pa.list_(pa.struct([("name", pa.string()), ("lineno", pa.int64()), ("length", pa.int64()), ("nesting", pa.int64()), ("validation", pa.list_(pa.string()))]))), ("calls", pa.list_(pa.struct([("callee", pa.string()), ("lineno", pa.int64())])))])


def _javascript(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for a in batches:
        yield pa.array([javascript_facts(x) for x in a.to_pylist()], _JS)


def javascript(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(functions, dangerous calls) of JavaScript files."""
    facts = _extracted(files, _javascript, _JS)
    return tuple(facts.select("file", F.explode(k).alias("x")).select("file", "x.*") for k in ("functions", "calls"))
