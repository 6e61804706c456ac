"""Features of findings, a random forest over them, confusion metrics, synthetic samples."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .advisories import RANK

FEATURES = [
    "length", "dangerous_calls", "cyclomatic_complexity", "max_nesting_depth", "input_validation", "dependency_count", "taint_path_to_sink", "taint_path_length", "interprocedural_taint_path",
    "interprocedural_call_chain_length", "interprocedural_var_trace_length", "commit_count", "unique_authors", "last_modified_days", "num_vulnerable_dependencies", "num_outdated_dependencies",
    "max_dependency_severity", "sensitive_data_involved", "num_sensitive_vars", "taint_finding_count",
]


def features(findings: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """FEATURES of each finding as doubles; what is missing, infinite or not a number is 0; dependency severity is an ordinal, unknown 0."""
    have = set(findings.columns)

    def number(name: str) -> Column:
        if name not in have:
            return F.lit(0.0)
        v = F.col(name).cast("double")
        return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)

    def size(name: str) -> Column:
        return F.greatest(F.coalesce(F.size(name), F.lit(0)), F.lit(0)).cast("double") if name in have else F.lit(0.0)

    kind = F.coalesce("type", F.lit("")) if "type" in have else F.lit("")
    only = lambda t, v: F.when(kind == t, v).otherwise(0.0)
    level = F.coalesce(F.create_map(*[F.lit(x) for k, v in RANK.items() for x in (k, float(4 - v))])[F.col("max_dependency_severity")], F.lit(0.0)) if "max_dependency_severity" in have else F.lit(0.0)
    flag = F.coalesce(F.col("sensitive_data_involved").cast("int"), F.lit(0)).cast("double") if "sensitive_data_involved" in have else F.lit(0.0)
    taints = findings.agg(F.count_if(kind == "taint_analysis").cast("double").alias("taint_finding_count"))  # one row
    values = [
        number("length"), size("dangerous_calls"), number("cyclomatic_complexity"), number("max_nesting_depth"), size("input_validation"), only("dependencies", size("dependencies")), only("taint_analysis", F.lit(1.0)), only("taint_analysis", size("trace")),
        only("interprocedural_taint", F.lit(1.0)), only("interprocedural_taint", size("call_chain")), only("interprocedural_taint", size("var_trace")), number("commit_count"), number("unique_authors"), number("last_modified_days"),
        only("dependencies", number("num_vulnerable_dependencies")), only("dependencies", number("num_outdated_dependencies")), only("dependencies", level), flag, number("num_sensitive_vars"),
    ]
    rows = findings.select(*(keep or []), *[v.alias(n) for v, n in zip(values, FEATURES, strict=False)])
    return rows.crossJoin(F.broadcast(taints))  # with a single row


def split(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(training, held) rows, 80 / 20 by a hash of the columns; under five rows both are all."""
    if rows.limit(5).count() < 5:
        return rows, rows
    part = F.pmod(F.xxhash64(*columns), F.lit(5))
    return rows.where(part != 0), rows.where(part == 0)


def train(rows: DataFrame, columns: list[str], label: str = "label", trees: int = 100, seed: int = 42):
    """A pipeline fitted on the training part of rows (see split)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    stages = [VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep"), RandomForestClassifier(labelCol=label, numTrees=trees, seed=seed)]
    return Pipeline(stages=stages).fit(split(rows, columns)[0])


def trained(rows: DataFrame, columns: list[str], label: str = "label", trees: int = 100, seed: int = 42):
    """(model, metrics): a model, and its confusion on the held part."""
    model = train(rows, columns, label, trees, seed)
    held = predict(model, split(rows, columns)[1]).withColumn("detected", (F.col("vuln_score") >= 0.5).cast("int"))
    return model, confusion(held, "detected", label).first().asDict()


def labelled_features(findings: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """features() of findings with their automatic label: what a model is trained on where no labels are given."""
    from .scoring import auto_label

    have = set(findings.columns)
    get = lambda n, t: F.col(n) if n in have else F.lit(None).cast(t)
    label = auto_label(get("dangerous_calls", "array<string>"), get("cyclomatic_complexity", "int"), get("max_nesting_depth", "int"), get("type", "string"))
    return features(findings.withColumn("label", label), [*(keep or []), "label"])


def predict(model, rows: DataFrame) -> DataFrame:
    """rows with vuln_score, the probability of class 1."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(rows).withColumn("vuln_score", F.get(vector_to_array("probability"), F.lit(1)))
    return out.drop("features", "rawPrediction", "probability", "prediction")


def confusion(rows: DataFrame, detected: str, label: str, by: str | None = None) -> DataFrame:
    """tp, fp, tn, fn and precision, recall, f1, false positive rate and accuracy, for all rows (group null) and each value of `by`."""
    d, y = F.col(detected) == 1, F.col(label) == 1
    counts = [F.count_if(d & y).alias("tp"), F.count_if(d & ~y).alias("fp"), F.count_if(~d & ~y).alias("tn"), F.count_if(~d & y).alias("fn")]
    if by:
        each = rows.groupBy(F.col(by).alias("grp")).agg(*counts)
        out = each.unionByName(each.agg(F.lit(None).cast("string").alias("grp"), *[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")]))
    else:
        out = rows.agg(F.lit(None).cast("string").alias("grp"), *counts)

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b == 0, 0.0).otherwise(a / b)

    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return out.select("*", *[F.round(v, 4).alias(n) for n, v in (("precision", p), ("recall", r), ("f1_score", ratio(2 * p * r, p + r)), ("false_positive_rate", ratio(fp, fp + tn)), ("accuracy", ratio(tp + tn, tp + fp + tn + fn)))])


def synthetic_samples(spark: SparkSession, kinds: dict[str, tuple[list[str], list[str]]], per_kind: int = 20) -> DataFrame:
    """code, label, type, source, variant: for each kind per_kind // 2 vulnerable samples and the rest safe, templates in turn."""
    rows = [(k, bad, good) for k, (bad, good) in kinds.items()]
    t = spark.createDataFrame(rows, "type string, bad array<string>, good array<string>")
    half = per_kind // 2
    each = t.select("type", "bad", "good", F.explode(F.sequence(F.lit(0), F.lit(per_kind - 1))).alias("i"))
    label = (F.col("i") < half).cast("int")
    variant = F.when(F.col("i") < half, F.col("i")).otherwise(F.col("i") - half)
    code = F.when(label == 1, F.get("bad", (variant % F.size("bad")).cast("int"))).otherwise(F.get("good", (variant % F.size("good")).cast("int")))
    return each.select(code.alias("code"), label.alias("label"), "type", F.lit("synthetic").alias("source"), variant.alias("variant"))


def samples_of(rows: DataFrame, key: str, kinds: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """A sample for each row: key, code, label, type. By the key, kinds take turns, then labels, then a kind's templates."""
    each = [(i, label, t, len(group), k, code) for i, (k, (bad, good)) in enumerate(kinds.items()) for label, group in ((1, bad), (0, good)) for t, code in enumerate(group)]
    templates = rows.sparkSession.createDataFrame(each, "kind long, label int, template long, size long, type string, code string")
    n, k = len(kinds), F.col(key)
    turn = F.floor(k / (2 * n))
    rows = rows.select(key, F.pmod(k, F.lit(n)).alias("kind"), F.pmod(F.floor(k / n), F.lit(2)).cast("int").alias("label"), turn.alias("turn"))
    # as many templates as a kind has
    met = rows.join(F.broadcast(templates), ["kind", "label"]).where(F.pmod("turn", "size") == F.col("template"))
    return met.select(key, "code", "label", "type")


def enclosing(places: DataFrame, functions: DataFrame) -> DataFrame:
    """The distinct (file, line) of places with the outermost function around each, (a, b), or nulls, and how many are open there.

    functions (file, a, b: first and last line) are nested in each other or apart. One sweep over a file's lines, in order: a function that begins
    beyond the reach of all before is an outermost one, and a line's is the last of these if it reaches so far. Findings of one line are one
    place, so a file costs its lines and functions, however many findings it has.
    """
    c = F.col
    of = functions.select("file", "a", "b")
    starts = of.select("file", c("a").alias("line"), F.lit(0).alias("kind"), "b", F.lit(1).alias("opens"))
    asked = places.select("file", "line").where("line IS NOT NULL").distinct().select("file", "line", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("b"), F.lit(0).alias("opens"))
    ends = of.select("file", c("b").alias("line"), F.lit(2).alias("kind"), F.lit(None).cast("bigint").alias("b"), F.lit(-1).alias("opens"))
    order = W.partitionBy("file").orderBy("line", "kind", F.desc("b"))
    reach = F.max("b").over(order.rowsBetween(W.unboundedPreceding, -1))
    outer = F.when((c("kind") == 0) & (F.coalesce(reach, F.lit(-1)) < c("line")), F.struct(c("line").alias("a"), "b"))
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    swept = starts.unionByName(asked).unionByName(ends).withColumn("outer", outer)
    swept = swept.withColumns({"fn": F.last("outer", ignorenulls=True).over(upto), "open": F.sum("opens").over(upto)}).where("kind = 1")
    here = c("fn.b") >= c("line")
    return swept.select("file", "line", F.when(here, c("fn.a")).alias("a"), F.when(here, c("fn.b")).alias("b"), "open")


def code_context(findings: DataFrame, lines: DataFrame, functions: DataFrame, around: int = 10) -> DataFrame:
    """(ordinal, first_line, last_line) of the outermost function around a finding, or so many lines either side."""
    f = findings.select("ordinal", "file", "line")
    at = enclosing(f, functions.select("file", F.col("lineno").alias("a"), F.col("end_lineno").alias("b")))
    n = lines.groupBy("file").agg(F.max("line_no").alias("n"))
    out = f.join(at, ["file", "line"], "left").join(n, "file")
    return out.select("ordinal", F.coalesce("a", F.greatest(F.lit(1), F.col("line") - around)).alias("first_line"), F.coalesce("b", F.least(F.col("n"), F.col("line") + around)).alias("last_line"))


def with_embeddings(findings: DataFrame, embeddings: DataFrame, key: str, size: int) -> DataFrame:
    """findings with the vector of their key; zeros where there is none."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), size)
    return findings.join(embeddings, key, "left").withColumn("embedding", F.coalesce("embedding", zero))


def with_vectors(rows: DataFrame, columns: list[str], embedding: str = "embedding", out: str = "vector") -> DataFrame:
    """rows with one vector: the static features, then the embedding's values."""
    static = F.array(*[F.col(c).cast("double") for c in columns])
    return rows.withColumn(out, F.concat(static, F.transform(F.coalesce(embedding, F.array().cast("array<float>")), lambda x: x.cast("double"))))


def embedded(snippets: DataFrame, embed, size: int, code: str = "code") -> DataFrame:
    """snippets with the vectors that embed, a function of a list of texts to a list of vectors, gives for them, in Arrow batches."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            vectors = [[float(x) for x in v] for v in embed([t or "" for t in a.to_pylist()])]
            if any(len(v) != size for v in vectors):
                raise ValueError(f"vectors of {size} numbers are expected")
            yield pa.array(vectors, pa.list_(pa.float32()))

    return snippets.withColumn("embedding", F.arrow_udf(run, "array<float>").asNondeterministic()(code))
