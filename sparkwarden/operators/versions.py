"""Versions as sortable keys, and dependencies against advisories that name ranges of versions.

A key is text whose byte order is the version order, so ranges are plain comparisons and sorts: numbers are preceded by
how many digits they have, and every list ends with a sign below all that could follow. Python's versions follow PEP 440 (epoch,
release, pre-, post- and development releases, local part), others semantic versioning (a prerelease is below
its release, numeric identifiers below others, build metadata does not count).

Versions meet ranges once for each distinct (ecosystem, name, version), however many projects have it. Pairs come from an equality
join on the package with the bounds as its condition, and are not shuffled: a version's dependencies go to that join with it. Counts by severity, which reports need, come from one ordered sweep over a
package's versions and bounds, so a package with many of both costs their sum, not their product.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .advisories import RANK, cvss_severity

RECORD = """id string, database_specific struct<cvss_score:double,score:double,severity:string>,
    affected array<struct<package:struct<name:string,ecosystem:string>,versions:array<string>,
    ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string,limit:string>>>>>>"""
_PYTHON = (
    r"^v?(?:([0-9]+)!)?([0-9]+(?:\.[0-9]+)*)(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?([0-9]*))?"
    r"(?:-([0-9]+)|[-_.]?(post|rev|r)[-_.]?([0-9]*))?(?:[-_.]?(dev)[-_.]?([0-9]*))?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?$"
)
_SEMANTIC = r"^[v=\s]*([0-9]+)(?:\.([0-9]+))?(?:\.([0-9]+))?(?:\.[0-9]+)*(?:-([0-9A-Za-z.-]+))?(?:\+.*)?$"
#: Above every key, and ecosystems whose versions are Python's.
TOP, PYTHON = "~", ("pypi",)
#: Dependencies of one version that go to a join together.
BLOCK = 1000


def _number(digits: Column) -> Column:
    """Digits so that byte order is the numbers' order; none counts as 0."""
    plain = F.regexp_replace(F.when(digits == "", "0").otherwise(digits), "^0+(?=[0-9])", "")
    return F.concat(F.lpad(F.length(plain).cast("string"), 3, "0"), plain)


def python_key(version: Column) -> Column:
    """The key of a version by PEP 440; null if it is none."""
    v = F.lower(F.trim(version))
    part = lambda i: F.regexp_extract(v, _PYTHON, i)
    release = F.split(F.regexp_replace(part(2), r"(\.0+)+$", ""), r"\.")
    pre = F.when(part(3).isin("a", "alpha"), "1").when(part(3).isin("b", "beta"), "2").when(part(3) != "", "3")
    has_post = (part(5) != "") | (part(6) != "")
    # a development release of nothing else is below all prereleases
    stage = F.when(pre.isNotNull(), F.concat(pre, _number(part(4)))).when((part(8) != "") & ~has_post, "0").otherwise("4")
    post = F.when(has_post, F.concat(F.lit("1"), _number(F.when(part(5) != "", part(5)).otherwise(part(7))))).otherwise("0")
    dev = F.when(part(8) != "", F.concat(F.lit("0"), _number(part(9)))).otherwise("1")
    local = F.when(part(10) == "", "0").otherwise(F.concat(F.lit("1"), _identifiers(F.split(part(10), "[-_.]"), "2", "1")))
    numbers = F.array_join(F.transform(release, lambda n: F.concat(F.lit("1"), _number(n))), "")
    return F.when(v.rlike(_PYTHON), F.concat(_number(part(1)), numbers, F.lit("0"), stage, post, dev, local))


def _identifiers(parts: Column, number: str, word: str) -> Column:
    """Dot-separated identifiers, of which a shorter list that is alike so far is below; number and word say which kind is first."""
    one = lambda x: F.when(x.rlike("^[0-9]+$"), F.concat(F.lit(number), _number(x))).otherwise(F.concat(F.lit(word), x, F.lit("!")))
    return F.concat(F.array_join(F.transform(parts, one), ""), F.lit("0"))


def semantic_key(version: Column) -> Column:
    """The key of a semantic version; null if it is none. Missing numbers are 0, a fourth and later ones do not count."""
    v = F.trim(version)
    part = lambda i: F.regexp_extract(v, _SEMANTIC, i)
    stage = F.when(part(4) == "", "9").otherwise(F.concat(F.lit("0"), _identifiers(F.split(part(4), r"\."), "1", "2")))
    return F.when(v.rlike(_SEMANTIC), F.concat(_number(part(1)), _number(part(2)), _number(part(3)), stage))


def version_key(ecosystem: Column, version: Column) -> Column:
    return F.when(F.lower(ecosystem).isin(*PYTHON), python_key(version)).otherwise(semantic_key(version))


def affected_intervals(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From advisory records (json): intervals (ecosystem, name, vuln_id, severity, low, high, closed) of keys, and single versions without a key
    (ecosystem, name, vuln_id, severity, version).

    An `introduced` opens an interval (0: below all), the next `fixed` or `limit` ends it before, the next `last_affected` with itself; without an
    end it goes on for ever, and a range without an opening begins below all. Ranges of commits are left out. A listed version is
    an interval of its own.
    """
    r = records.select(F.from_json("json", RECORD).alias("v"))
    score = F.coalesce(F.nullif("v.database_specific.cvss_score", F.lit(0.0)), "v.database_specific.score")
    r = r.select(F.coalesce("v.id", F.lit("UNKNOWN")).alias("vuln_id"), cvss_severity(score, F.col("v.database_specific.severity")).alias("severity"), F.explode("v.affected").alias("a"))
    r = r.select("vuln_id", "severity", F.col("a.package.ecosystem").alias("ecosystem"), F.col("a.package.name").alias("name"), "a.ranges", "a.versions").where("name IS NOT NULL AND ecosystem IS NOT NULL")
    base = ["ecosystem", "name", "vuln_id", "severity"]
    eco = F.col("ecosystem")

    # points in order: the key, then ends before openings
    def points(events: Column) -> Column:
        each = F.transform(events, lambda e: F.struct(
            F.when((e["introduced"] == "0") | e["introduced"].isNull() & F.coalesce(e["fixed"], e["last_affected"], e["limit"]).isNull(), "").otherwise(version_key(eco, F.coalesce(e["introduced"], e["fixed"], e["last_affected"], e["limit"]))).alias("key"),
            F.when(e["introduced"].isNotNull(), 1).otherwise(0).alias("opens"), e["last_affected"].isNotNull().alias("closed")))
        return F.array_sort(F.filter(each, lambda p: p["key"].isNotNull()))

    ranges = r.select(*base, F.explode("ranges").alias("g")).where("coalesce(g.type, '') <> 'GIT' AND size(g.events) > 0").withColumn("p", points(F.col("g.events")))
    opened = F.filter("p", lambda p: p["opens"] == 1)
    starts = F.when(F.size(opened) == 0, F.array(F.lit(""))).otherwise(F.transform(opened, lambda p: p["key"]))
    each = ranges.select(*base, "p", F.explode(starts).alias("low"))
    # of equal keys: what was introduced and fixed at once is nothing
    end = F.get(F.filter("p", lambda p: (p["opens"] == 0) & (p["key"] >= F.col("low"))), F.lit(0))
    spans = each.where("size(p) > 0").select(*base, "low", end["key"].alias("high"), F.coalesce(end["closed"], F.lit(False)).alias("closed"))
    spans = spans.where("high IS NULL OR low < high OR (low = high AND closed)")
    listed = r.select(*base, F.explode("versions").alias("version")).withColumn("key", version_key(eco, F.col("version")))
    single = listed.where("key IS NOT NULL").select(*base, F.col("key").alias("low"), F.col("key").alias("high"), F.lit(True).alias("closed"))
    return spans.unionByName(single).distinct(), listed.where("key IS NULL").select(*base, "version").distinct()


def joined_intervals(intervals: DataFrame) -> DataFrame:
    """Intervals of which no two of one advisory and package overlap or touch."""
    by = ["ecosystem", "name", "vuln_id", "severity"]
    end = F.struct(F.coalesce("high", F.lit(TOP)).alias("high"), F.col("closed").cast("int").alias("closed"))
    before = F.max(end).over(W.partitionBy(*by).orderBy("low", end).rowsBetween(W.unboundedPreceding, -1))
    x = intervals.withColumn("new", F.when(before.isNull() | (F.struct(F.col("low").alias("high"), F.lit(0).alias("closed")) > before), 1).otherwise(0))
    x = x.withColumn("island", F.sum("new").over(W.partitionBy(*by).orderBy("low", end).rowsBetween(W.unboundedPreceding, 0)))
    x = x.groupBy(*by, "island").agg(F.min("low").alias("low"), F.max(end).alias("end"))
    return x.select(*by, "low", F.nullif("end.high", F.lit(TOP)).alias("high"), (F.col("end.closed") == 1).alias("closed"))


def distinct_versions(dependencies: DataFrame) -> DataFrame:
    """(ecosystem, name, version, key) once each."""
    return dependencies.where("version IS NOT NULL AND name IS NOT NULL").select("ecosystem", "name", "version").distinct().withColumn("key", version_key(F.col("ecosystem"), F.col("version")))


def affected_versions(dependencies: DataFrame, records: DataFrame) -> DataFrame:
    """(ecosystem, name, version, vuln_id, severity) for each distinct version and advisory of its package that names it."""
    versions = distinct_versions(dependencies)
    intervals, single = affected_intervals(records)
    of = joined_intervals(intervals)
    inside = (F.col("key") >= F.col("low")) & (F.col("high").isNull() | (F.col("key") < F.col("high")) | F.col("closed") & (F.col("key") == F.col("high")))
    out = ["ecosystem", "name", "version", "vuln_id", "severity"]
    ranged = versions.join(of, ["ecosystem", "name"]).where(inside).select(*out)
    return ranged.unionByName(versions.where("key IS NULL").join(single, ["ecosystem", "name", "version"]).select(*out))


def affected_dependencies(dependencies: DataFrame, records: DataFrame) -> DataFrame:
    """dependencies (ecosystem, name, version, ...) with vuln_id and severity, a row for each advisory of the package that names the version.

    Dependencies of one version are lists of up to BLOCK, taken apart after the last shuffle: what is shuffled follows dependencies
    and records, not their pairs. A version without a key meets what is listed of its text, others the intervals.
    """
    package, c = ["ecosystem", "name"], F.col
    known = dependencies.where("version IS NOT NULL AND name IS NOT NULL")
    place = F.row_number().over(W.partitionBy(*package, "version").orderBy(F.lit(0)))
    blocks = known.select(*package, "version", F.struct(*dependencies.columns).alias("row"), F.floor((place - 1) / BLOCK).alias("block")).groupBy(*package, "version", "block").agg(F.collect_list("row").alias("rows"))
    blocks = blocks.withColumn("key", version_key(c("ecosystem"), c("version")))
    blocks = blocks.select(*package, "key", "rows", F.when(c("key").isNull(), F.concat(F.lit("="), "version")).otherwise("").alias("listed"))
    intervals, single = affected_intervals(records)
    of = joined_intervals(intervals).withColumn("listed", F.lit(""))
    of = of.unionByName(single.withColumn("listed", F.concat(F.lit("="), "version")).drop("version"), allowMissingColumns=True)
    inside = (c("key") >= c("low")) & (c("high").isNull() | (c("key") < c("high")) | c("closed") & (c("key") == c("high")))
    # the pairs are far more than what is joined, so the tasks' number must not follow the latter's size
    by = (int(dependencies.sparkSession.conf.get("spark.sql.shuffle.partitions")), *package, "listed")
    pairs = blocks.repartition(*by).join(of.repartition(*by), [*package, "listed"]).where(c("key").isNull() | inside)
    return pairs.select(F.inline("rows"), "vuln_id", "severity")


def exposure(dependencies: DataFrame, records: DataFrame) -> DataFrame:
    """(ecosystem, name, version, n_<severity>..., n_advisories, severity): advisories of each distinct version by a sweep; severity is the worst."""
    versions = distinct_versions(dependencies)
    intervals, single = affected_intervals(records)
    package, c = ["ecosystem", "name"], F.col
    one = {s: F.when(c("severity") == s, 1).otherwise(0) for s in RANK}
    of = joined_intervals(intervals)
    # at one key: openings and ends before it, then versions, then ends with it
    opens = of.select(*package, c("low").alias("key"), F.lit(0).alias("phase"), *[one[s].alias(s) for s in RANK])
    ends = of.where("high IS NOT NULL").select(*package, c("high").alias("key"), F.when(c("closed"), 2).otherwise(0).alias("phase"), *[(-one[s]).alias(s) for s in RANK])
    asked = versions.where("key IS NOT NULL").select(*package, "key", F.lit(1).alias("phase"), "version")
    events = opens.unionByName(ends).unionByName(asked, allowMissingColumns=True)
    before = W.partitionBy(*package).orderBy("key", "phase").rowsBetween(W.unboundedPreceding, 0)
    swept = events.withColumns({s: F.sum(F.coalesce(s, F.lit(0))).over(before) for s in RANK}).where("version IS NOT NULL").select(*package, "version", *RANK)
    named = single.groupBy(*package, "version").agg(*[F.sum(one[s]).alias(s) for s in RANK])
    odd = versions.where("key IS NULL").join(named, [*package, "version"], "left").select(*package, "version", *[F.coalesce(s, F.lit(0)).alias(s) for s in RANK])
    worst = F.coalesce(*[F.when(c(f"n_{s}") > 0, s) for s in RANK])
    out = swept.unionByName(odd).select(*package, "version", *[c(s).cast("long").alias(f"n_{s}") for s in RANK])
    return out.withColumn("n_advisories", reduce(lambda a, b: a + b, [c(f"n_{s}") for s in RANK])).withColumn("severity", worst)


def range_report(dependencies: DataFrame, latest: DataFrame, records: DataFrame) -> DataFrame:
    """dependencies (project, ecosystem, name, version) with outdated, vulnerable, severity and n_advisories. A version without a key is outdated if it is not the newest."""
    known = exposure(dependencies, records).where("n_advisories > 0").select("ecosystem", "name", "version", "severity", "n_advisories")
    d = dependencies.join(latest.select("name", "latest"), "name", "left").join(known, ["ecosystem", "name", "version"], "left")
    own, newest = (version_key(F.col("ecosystem"), F.col(x)) for x in ("version", "latest"))
    outdated = F.coalesce(F.when(own.isNotNull() & newest.isNotNull(), own < newest).otherwise(F.col("version") != F.col("latest")), F.lit(False))
    return d.select("project", "ecosystem", "name", "version", outdated.alias("outdated"), F.col("severity").isNotNull().alias("vulnerable"), "severity", F.coalesce("n_advisories", F.lit(0).cast("long")).alias("n_advisories"))
