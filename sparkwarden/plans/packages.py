"""Queries of dependencies, versions and advisories by range, with their SQL.

Dependencies come from documents and advisory records (JSON) from parts. Versions are texts that Spark parses; SQL orders them by the
numbers that they are made of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkwarden.operators import versions as V
from sparkwarden.operators.advisories import RANK

PACKAGES = 499
#: Ends of versions with their rank among versions of the same numbers, by ecosystem.
ENDS = {"PyPI": [("", 4), ("a1", 1), ("b2", 2), ("rc10", 3), (".post1", 5), (".dev3", 0)], "npm": [("", 4), ("-alpha.1", 1), ("-alpha.beta", 2), ("-rc.10", 3), ("", 4), ("-0", 0)]}
_LABELS = ["CRITICAL", "HIGH", "MODERATE", "LOW", None]


def _ecosystem(key: str) -> str:
    return f"CASE WHEN {key} % {PACKAGES} % 2 = 0 THEN 'PyPI' ELSE 'npm' END"


def _end(key: str, i: int) -> str:
    """SQL of a version's end (0) or its rank (1), for Spark and DuckDB."""
    shown = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    each = {e: "CASE " + f"({key} // 5) % 6".replace("//", "DIV") + " " + " ".join(f"WHEN {k} THEN {shown(x[i])}" for k, x in enumerate(v)) + " END" for e, v in ENDS.items()}
    return f"CASE WHEN {key} % {PACKAGES} % 2 = 0 THEN {each['PyPI']} ELSE {each['npm']} END"


_DIGITS = ("doc_id % 4", "(doc_id DIV 4) % 6", "(doc_id DIV 24) % 3")
_VERSION = "concat_ws('.', " + ", ".join(f"CAST({x} AS STRING)" for x in _DIGITS) + ")"
#: Bounds of a part's advisory: two numbers each.
_LOW, _HIGH = ("p_partkey % 4", "(p_partkey DIV 4) % 6"), ("p_partkey % 4 + (p_partkey DIV 7) % 2", "(p_partkey DIV 9) % 6")


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, ecosystem, name, version) of each document."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.selectExpr("doc_id AS project", f"{_ecosystem('doc_id')} AS ecosystem", f"concat('pkg', CAST(doc_id % {PACKAGES} AS STRING)) AS name", f"concat({_VERSION}, {_end('doc_id', 0)}) AS version")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advisory records (json), one for each part: with both bounds, one, an inclusive one, a prerelease, or versions by name."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = lambda b: F.expr(f"concat_ws('.', CAST({b[0]} AS STRING), CAST({b[1]} AS STRING), '0')")
    low, high, kind = text(_LOW), text(_HIGH), F.col("p_partkey") % 6
    eco = F.expr(_ecosystem("p_partkey"))
    rc = F.concat(low, F.when(eco == "PyPI", "rc10").otherwise("-rc.10"))
    event = lambda **k: F.struct(*[k.get(n, F.lit(None).cast("string")).alias(n) for n in ("introduced", "fixed", "last_affected")])
    events = (
        F.when(kind == 0, F.array(event(introduced=low), event(fixed=high))).when(kind == 1, F.array(event(introduced=low))).when(kind == 2, F.array(event(fixed=high)))
        .when(kind == 3, F.array(event(introduced=F.lit("0")), event(last_affected=high))).when(kind == 4, F.array(event(introduced=rc), event(fixed=high)))
    )
    listed = F.when(kind == 5, F.array(low, high))
    affected = F.struct(F.struct(F.concat(F.lit("pkg"), (F.col("p_partkey") % PACKAGES).cast("string")).alias("name"), eco.alias("ecosystem")).alias("package"), listed.alias("versions"), F.array(F.struct(F.lit("ECOSYSTEM").alias("type"), events.alias("events"))).alias("ranges"))
    label = F.get(F.array(*map(F.lit, _LABELS)), (F.col("p_partkey") % 5).cast("int"))
    return p.select(F.to_json(F.struct(F.concat(F.lit("V"), F.col("p_partkey").cast("string")).alias("id"), F.struct(label.alias("severity")).alias("database_specific"), F.array(affected).alias("affected"))).alias("json"))


def advisory_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each dependency with each advisory whose ranges or versions hold its version."""
    return V.affected_dependencies(dependencies(spark, sf_dir), records(spark, sf_dir))


def advisory_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advisories of each distinct version, counted by severity in one sweep."""
    return V.exposure(dependencies(spark, sf_dir), records(spark, sf_dir))


def dependency_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of all dependencies: outdated by version order, vulnerable by range; the newest version known is 2.3.1."""
    d = dependencies(spark, sf_dir)
    latest = d.select("name").distinct().withColumn("latest", F.lit("2.3.1"))
    return V.range_report(d, latest, records(spark, sf_dir))


def version_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct versions of each package, numbered in order."""
    each = V.distinct_versions(dependencies(spark, sf_dir))
    return each.withColumn("position", F.dense_rank().over(W.partitionBy("ecosystem", "name").orderBy("key"))).drop("key")


QUERIES = {f.__name__: f for f in (advisory_ranges, advisory_exposure, dependency_ranges, version_order)}


def _sql() -> str:
    """d: dependencies with their order as a number; a: advisories with bounds as numbers; m: matches."""
    duck = lambda x: x.replace("DIV", "//").replace("STRING", "VARCHAR")
    place = lambda b, rank: duck(f"((({b[0]}) * 10 + {b[1]}) * 100 + {rank})")
    order = duck(f"((({_DIGITS[0]}) * 10 + {_DIGITS[1]}) * 10 + {_DIGITS[2]}) * 10 + ({_end('doc_id', 1)})")
    label = " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(["critical", "high", "medium", "low"]))
    return f"""d AS (SELECT doc_id AS project, {_ecosystem('doc_id')} AS ecosystem, 'pkg' || (doc_id % {PACKAGES}) AS name, {duck(_VERSION)} || ({duck(_end('doc_id', 0))}) AS version, {order} AS place FROM documents),
a AS (SELECT {_ecosystem('p_partkey')} AS ecosystem, 'pkg' || (p_partkey % {PACKAGES}) AS name, 'V' || p_partkey AS vuln_id, CASE p_partkey % 5 {label} ELSE 'unknown' END AS severity, p_partkey % 6 AS kind,
  {place(_LOW, 4)} AS low, {place(_LOW, 3)} AS rc, {place(_HIGH, 4)} AS high FROM part),
m AS (SELECT d.project, d.ecosystem, d.name, d.version, vuln_id, severity FROM d JOIN a USING (ecosystem, name) WHERE CASE kind
  WHEN 0 THEN place >= low AND (place < high OR high < low) WHEN 1 THEN place >= low WHEN 2 THEN place < high WHEN 3 THEN place <= high WHEN 4 THEN place >= rc AND (place < high OR high < rc) ELSE place IN (low, high) END)"""


_M = _sql()
_COUNTS = ", ".join(f"count(*) FILTER (WHERE m.severity = '{s}') AS n_{s}" for s in RANK)
_WORST = "CASE " + " ".join(f"WHEN count(*) FILTER (WHERE m.severity = '{s}') > 0 THEN '{s}' END".replace(" END", "") for s in RANK) + " END"
ORACLE = {
    "advisory_ranges": f"WITH {_M} SELECT * FROM m",
    "advisory_exposure": f"WITH {_M}, v AS (SELECT DISTINCT ecosystem, name, version FROM d), p AS (SELECT DISTINCT ecosystem, name, version, vuln_id, severity FROM m) SELECT v.*, {_COUNTS}, count(vuln_id) AS n_advisories, {_WORST} AS severity FROM v LEFT JOIN p m USING (ecosystem, name, version) GROUP BY ALL",
    "dependency_ranges": f"WITH {_M} SELECT d.project, d.ecosystem, d.name, d.version, d.place < 2314 AS outdated, count(vuln_id) > 0 AS vulnerable, {_WORST} AS severity, count(vuln_id) AS n_advisories FROM d LEFT JOIN m USING (project) GROUP BY ALL",
    "version_order": f"WITH {_M} SELECT ecosystem, name, version, CAST(dense_rank() OVER (PARTITION BY ecosystem, name ORDER BY place) AS INTEGER) AS position FROM (SELECT DISTINCT ecosystem, name, version, place FROM d)",
}
