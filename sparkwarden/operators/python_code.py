"""Findings over Python facts: categories of calls, taint as an as-of join, flows within and across functions, rule matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkwarden.functions import catalog as C
from sparkwarden.functions.facts import PythonFacts
from sparkwarden.operators.rules import rules_for
from sparkwarden.plans.tables import held


def dictionary(spark, name: str, rows: list[tuple]) -> DataFrame:
    """A fixed dictionary as a broadcast table."""
    return F.broadcast(spark.createDataFrame(rows, name))


def call_categories(facts: PythonFacts) -> DataFrame:
    """calls with a category for each dictionary that names them; safe YAML loaders are exempt."""
    spark = facts.calls.sparkSession
    sinks = dictionary(spark, "category string, callee string", [(k, n) for k, v in C.SINKS.items() for n in v])
    exempt = (F.col("category") == "deserialization") & (F.col("callee") == "yaml.load") & F.col("safe_loader")
    return facts.calls.join(sinks, "callee").where(~exempt)


def function_findings(facts: PythonFacts) -> DataFrame:
    """A row for each function that calls something named, is longer than 50 statements or more complex than 10; calls by level, then place."""
    by = call_categories(facts).select("file", F.explode("fn_ids").alias("fn_id"), "category", "depth", "visit_pos", "callee")
    per = by.groupBy("file", "fn_id").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("category") == k, F.struct("depth", "visit_pos", "callee")))), lambda x: x["callee"]).alias(f"{k}_calls") for k in C.SINKS])
    none = F.array().cast("array<string>")
    out = facts.functions.join(per, ["file", "fn_id"], "left").select(
        F.lit("function_analysis").alias("type"), "file", F.col("name").alias("function"), F.col("lineno").alias("line"), "length", *[F.coalesce(f"{k}_calls", none).alias(f"{k}_calls") for k in C.SINKS],
        F.col("cyclomatic").alias("cyclomatic_complexity"), F.col("nesting").alias("max_nesting_depth"), F.col("validation").alias("input_validation"),
        (F.size("sensitive") > 0).alias("sensitive_data_involved"), F.size("sensitive").cast("bigint").alias("num_sensitive_vars"),
    )
    any_call = F.greatest(*[F.size(f"{k}_calls") for k in C.SINKS]) > 0
    return out.where(any_call | (F.col("length") > 50) | (F.col("cyclomatic_complexity") > 10))


def taint_findings(facts: PythonFacts) -> DataFrame:
    """Sinks whose bare-name arguments were assigned from a source before: the last assignment before each sink (as-of)."""
    spark = facts.calls.sparkSession
    sources = dictionary(spark, "callee string", [(x,) for x in C.TAINT_SOURCES])
    sinks = dictionary(spark, "callee string", [(x,) for x in C.TAINT_SINKS])
    c = F.col
    where = F.struct(c("lineno").alias("line"), c("callee").alias("name"))
    none = F.lit(None)
    src = facts.assigns.join(sources, "callee").select(
        "file", F.explode("targets").alias("variable"), "visit_pos", where.alias("from"), none.cast("bigint").alias("arg"), none.cast("bigint").alias("sink_line"), none.cast("string").alias("sink")
    )
    use = facts.calls.join(sinks, "callee").select("file", F.explode("names").alias("a"), "visit_pos", "lineno", "callee")
    use = use.select("file", c("a.id").alias("variable"), "visit_pos", none.cast("struct<line:bigint,name:string>").alias("from"), c("a.pos").alias("arg"), c("lineno").alias("sink_line"), c("callee").alias("sink"))
    # one pass over the events of each variable, in the order they are visited: no pairs of sources and sinks
    before = W.partitionBy("file", "variable").orderBy("visit_pos").rowsBetween(W.unboundedPreceding, -1)
    events = src.unionByName(use).withColumn("source", F.last("from", ignorenulls=True).over(before))
    out = events.where("sink IS NOT NULL AND source IS NOT NULL")
    trace = F.array(F.col("source"), F.struct(F.col("sink_line").alias("line"), F.col("sink").alias("name")))
    return out.select(F.lit("taint_analysis").alias("type"), "file", "variable", "sink", "sink_line", "source", trace.alias("trace"), "visit_pos", "arg")


#: Functions' names that are broadcast at most.
HELD_NAMES = 200_000


def resolved_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """calls (file, callee, ...) with the function they go to (next, args), of functions (file, name, func, args).

    A callee ends with its function's name, so calls whose last part no function of the project has, nearly all, leave before any
    shuffle by callee, and frequent names of the language's own functions with them.
    """
    c = F.col
    names = functions.select(c("name").alias("last")).distinct()
    names = F.broadcast(names) if names.limit(HELD_NAMES + 1).count() <= HELD_NAMES else names
    calls = calls.withColumn("last", F.regexp_extract("callee", r"([^.]*)$", 1)).join(names, "last", "left_semi").drop("last")
    target = F.struct(c("func").alias("next"), "args")
    known = functions.withColumn("module", F.regexp_extract("file", r"([^/]+)\.py$", 1))
    here = known.select("file", c("name").alias("callee"), target.alias("here"))
    # names that two functions share are no targets from elsewhere
    named = known.groupBy(c("name").alias("callee")).agg(F.count("*").alias("n"), F.first(target).alias("only")).where("n = 1").drop("n")
    modules = known.groupBy(F.concat_ws(".", "module", "name").alias("callee")).agg(F.count("*").alias("n"), F.first(target).alias("there")).where("n = 1").drop("n")
    # of a dotted callee the last two parts
    tail = F.regexp_extract("callee", r"([^.]+\.[^.]+)$", 1)
    met = calls.join(here, ["file", "callee"], "left").join(named, "callee", "left")
    met = met.withColumn("tail", tail).join(modules.withColumnRenamed("callee", "tail"), "tail", "left").drop("tail")
    return met.withColumn("to", F.coalesce("here", "there", "only")).where("to IS NOT NULL").select(*calls.columns, "to.next", "to.args")


def flow_findings(facts: PythonFacts, propagate: bool = False, depth: int = 10) -> DataFrame:
    """Sources and sinks within one function, by name in any order; with propagate also through calls.

    A file's functions of one name count as the last of them. A call goes to the function of that name in its own file; else,
    if it has a module before its dot, to that module's function; else to the only one of that name in the project. So a
    call has one target at most, and edges are no more than calls. Propagation maps arguments to the callee's parameters
    and takes one round of joins for each level of calls, up to `depth`.
    """
    spark = facts.calls.sparkSession
    last = facts.functions.groupBy("file", "name").agg(F.max_by("fn_id", F.struct("depth", "fn_id")).alias("fn_id"), F.max_by("args", F.struct("depth", "fn_id")).alias("args"))
    key = F.concat_ws("::", "file", "name")
    functions = last.select("file", "fn_id", "name", "args", key.alias("func"))
    sources = dictionary(spark, "callee string", [(x,) for x in C.TAINT_SOURCES])
    sinks = dictionary(spark, "callee string", [(x,) for x in C.FLOW_SINKS])
    tainted = facts.assigns.join(sources, "callee").select("file", F.explode("fn_ids").alias("fn_id"), "targets").select("file", "fn_id", F.explode("targets").alias("var"))
    start = tainted.distinct().join(functions, ["file", "fn_id"]).select(F.col("func").alias("source_func"), "func", "var", F.array("func").alias("call_chain"))
    inside = facts.calls.select("file", F.explode("fn_ids").alias("fn_id"), "callee", "lineno", "names", "visit_pos")
    inside = inside.join(functions.select("file", "fn_id", "func"), ["file", "fn_id"])
    use = inside.join(sinks, "callee").select("func", F.col("callee").alias("sink"), F.col("lineno").alias("sink_line"), "visit_pos", F.explode("names").alias("a")).select("func", "sink", "sink_line", "visit_pos", F.col("a.id").alias("var"), F.col("a.pos").alias("arg"))
    reached = start
    if propagate:
        edge = inside.select("file", "func", "callee", F.explode("names").alias("a")).select("file", F.col("func").alias("caller"), "callee", F.col("a.id").alias("from_var"), F.col("a.pos").alias("pos"))
        step = held(resolved_calls(edge, functions).select("caller", "from_var", "next", F.get("args", F.col("pos").cast("int")).alias("to_var")).where("to_var IS NOT NULL").distinct())
        front, seen = start, start.select("source_func", "func", "var")
        for _ in range(depth):
            front = front.join(step, (F.col("func") == F.col("caller")) & (F.col("var") == F.col("from_var"))).select("source_func", F.col("next").alias("func"), F.col("to_var").alias("var"), F.concat("call_chain", F.array("next")).alias("call_chain"))
            front = front.dropDuplicates(["source_func", "func", "var"]).join(seen, ["source_func", "func", "var"], "left_anti")
            front = held(front)
            if front.isEmpty():
                break
            seen = seen.unionByName(front.select("source_func", "func", "var"))
            reached = reached.unionByName(front)
    out = reached.join(use, ["func", "var"])
    return out.select(F.lit("interprocedural_taint").alias("type"), "source_func", F.col("func").alias("sink_func"), "sink", "sink_line", "call_chain", F.col("var").alias("tainted_var"), "visit_pos", "arg")


def rule_matches(calls: DataFrame, rules: DataFrame, language: str = "python") -> DataFrame:
    """calls (file, lineno, callee) that an enabled rule for the language names: hash join on the exploded names."""
    names = rules_for(rules, language).where("pattern_type = 'function_call'")
    names = names.select(F.explode("names").alias("callee"), F.col("id").alias("rule_id"), "severity", "confidence", "cwe", F.concat(F.col("message"), F.when(F.col("cwe").isNotNull(), F.concat(F.lit(" ("), "cwe", F.lit(")"))).otherwise(F.lit(""))).alias("description"))
    return calls.join(F.broadcast(names), "callee").select("file", F.col("lineno").alias("line"), "callee", "rule_id", "severity", "confidence", "cwe", "description")
