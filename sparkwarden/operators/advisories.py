"""Dependencies against version and advisory tables; advisory records; a lookup cache with a time to live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3, "unknown": 4}
OSV = """id string, summary string, details string, aliases array<string>, database_specific struct<cvss_score:double,score:double,severity:string>,
    references array<struct<url:string>>, affected array<struct<ranges:array<struct<events:array<struct<introduced:string,fixed:string>>>>>>"""
TTL = 86_400


def rank(severity: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])[severity], F.lit(99))


def cvss_severity(score: Column, label: Column) -> Column:
    up = F.upper(label)
    named = F.when(up == "CRITICAL", "critical").when(up == "HIGH", "high").when(up.isin("MODERATE", "MEDIUM"), "medium").when(up == "LOW", "low").otherwise("unknown")
    return F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").when(score.isNotNull(), "low").otherwise(named)


def parsed_advisories(records: DataFrame) -> DataFrame:
    """(key columns..., vuln_id, summary, cve_ids, severity, cvss_score, advisory_urls, affected_ranges) from `json`."""
    r = records.withColumn("v", F.from_json("json", OSV)).drop("json")
    score = F.coalesce(F.nullif("v.database_specific.cvss_score", F.lit(0.0)), "v.database_specific.score")
    none = F.array().cast("array<string>")

    def last(events: Column, field: str) -> Column:
        return F.try_element_at(F.filter(F.transform(events, lambda e: e[field]), lambda x: x.isNotNull()), F.lit(-1))

    ranges = F.flatten(F.transform("v.affected", lambda a: F.transform(a["ranges"], lambda g: F.struct(last(g["events"], "introduced").alias("introduced"), last(g["events"], "fixed").alias("fixed")))))
    keep = [c for c in r.columns if c != "v"]
    return r.select(
        *keep, F.coalesce("v.id", F.lit("UNKNOWN")).alias("vuln_id"), F.left(F.coalesce("v.summary", "v.details", F.lit("No description available")), F.lit(200)).alias("summary"),
        F.filter(F.coalesce("v.aliases", none), lambda a: a.startswith("CVE-")).alias("cve_ids"), cvss_severity(score, F.col("v.database_specific.severity")).alias("severity"), score.alias("cvss_score"),
        F.slice(F.filter(F.coalesce(F.transform("v.references", lambda x: x["url"]), none), lambda u: u.isNotNull() & (u != "")), 1, 3).alias("advisory_urls"),
        F.filter(ranges, lambda x: x["introduced"].isNotNull() | x["fixed"].isNotNull()).alias("affected_ranges"),
    )


def most_severe(advisories: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Per package the most severe advisory (the first of equals by `order`) and how many there are."""
    value = F.struct("vuln_id", "severity", "cvss_score")
    out = advisories.groupBy(*keys).agg(F.min_by(value, F.struct(rank(F.col("severity")), F.col(order))).alias("v"), F.count("*").alias("total_vulnerabilities"))
    return out.select(*keys, "v.*", "total_vulnerabilities")


def dependency_report(dependencies: DataFrame, latest: DataFrame, advisories: DataFrame) -> DataFrame:
    """dependencies (project, name, version) with outdated, vulnerable and severity; left joins on name and on name and version."""
    worst = advisories.groupBy("name", "version").agg(F.min_by("severity", rank(F.col("severity"))).alias("severity"))
    d = dependencies.join(latest.select("name", "latest"), "name", "left").join(worst, ["name", "version"], "left")
    return d.select("project", "name", "version", F.coalesce(F.col("latest").isNotNull() & F.col("version").isNotNull() & (F.col("latest") != F.col("version")), F.lit(False)).alias("outdated"), F.col("severity").isNotNull().alias("vulnerable"), "severity")


def dependency_summary(report: DataFrame) -> DataFrame:
    return report.groupBy("project").agg(
        F.count("*").alias("n_dependencies"), F.count_if("vulnerable").alias("num_vulnerable_dependencies"), F.count_if("outdated").alias("num_outdated_dependencies"),
        F.min_by("severity", F.when(F.col("severity").isNotNull(), rank(F.col("severity")))).alias("max_dependency_severity"),
    )


def cache_key(ecosystem: Column, package: Column, version: Column) -> Column:
    return F.sha2(F.lower(F.concat_ws(":", ecosystem, package, version)), 256)


def cached(queries: DataFrame, cache: DataFrame, now: Column, ttl: int = TTL) -> tuple[DataFrame, DataFrame]:
    """(answered from the cache, to be asked): queries with a `key` against cache(key, ts seconds, vulns)."""
    fresh = cache.where(now - F.col("ts") <= ttl)
    return queries.join(fresh, "key"), queries.join(fresh, "key", "left_anti")


class AdvisoryCache:
    """Advisories by package version with the second they were asked for, as a Parquet table of appended rows; the latest row of a key counts."""

    def __init__(self, spark, path: str, ttl: int = TTL):
        self.spark, self.path, self.ttl = spark, path.rstrip("/"), ttl

    def rows(self) -> DataFrame:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], "key string, ts double, vulns string")
        every = self.spark.read.schema("key string, ts double, vulns string").parquet(self.path)
        return every.groupBy("key").agg(F.max("ts").alias("ts"), F.max_by("vulns", "ts").alias("vulns"))

    def put(self, answers: DataFrame, now: float) -> None:
        """Keep answers (key, vulns) as of now."""
        answers.select("key", F.lit(float(now)).alias("ts"), F.col("vulns").cast("string").alias("vulns")).write.mode("append").parquet(self.path)

    def get(self, queries: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
        """(answered, to be asked) of queries with a key."""
        return cached(queries, self.rows(), F.lit(float(now)), self.ttl)

    def clear(self) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        self.spark.catalog.refreshByPath(self.path)


def answered(queries: DataFrame, cache: AdvisoryCache, ask, now: float) -> DataFrame:
    """queries (position, key, ...) with vulns, in one batch: fresh ones from the cache, the others from ask(queries) (key, vulns), which is kept.

    A query that nobody answers has null; positions tell the answers' order.
    """
    known, open_ = cache.get(queries, now)
    if not open_.isEmpty():
        cache.put(ask(open_.select("key").distinct()), now)
        known, _ = cache.get(queries, now)
    return queries.join(known.select("key", "vulns").distinct(), "key", "left").select(*queries.columns, "vulns")
