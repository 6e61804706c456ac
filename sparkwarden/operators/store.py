"""Findings store: tables of scans and findings, a log of commits that says which scans there are, and the dashboard's queries as DataFrames.

A scan is first written whole, where no read looks, and then published by one small file, the next one of the log, which comes
into being by a rename that fails if it is there. So a crash at any step leaves the scan whole or absent, and of two writers with
the same next number one looks again and takes another; deleting what another has deleted meanwhile is told as such. What crashes leave
behind is removed by vacuum().
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOP_KINDS, RECENT = 10, 5
LEVELS = ("high", "medium", "low", "critical")
SCANS = "id string, scan_path string, status string, total_findings bigint, high_count bigint, medium_count bigint, low_count bigint, critical_count bigint, files_scanned bigint, scan_duration double, metadata string, created_at timestamp"
FINDINGS = "id bigint, finding_id string, type string, severity string, file string, line bigint, message string, rule_id string, cwe string, details string, scan_id string"


def scan_counts(findings: DataFrame, *by: str) -> DataFrame:
    """Totals and counts for each level; labels other than these count in the total only."""
    return findings.groupBy(*by).agg(F.count("*").alias("total_findings"), *[F.count_if(F.coalesce(F.col("severity"), F.lit("low")) == x).alias(f"{x}_count") for x in LEVELS])


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """The page's rows: a top-k of (number * size) rows, of which the last are kept."""
    if number < 1 or size < 1:
        raise ValueError("pages and their sizes start at 1")
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def pages(rows: DataFrame, size: int) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.ceil(F.count("*") / size).alias("pages"))


def filtered(findings: DataFrame, severity: str | None = None, kind: str | None = None) -> DataFrame:
    out = findings
    if severity:
        out = out.where(F.col("severity") == severity)
    if kind:
        out = out.where(F.col("type") == kind)
    return out


def without(rows: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Rows of scans that stay, for a delete that cascades."""
    return rows.join(deleted, key, "left_anti")


def distribution(findings: DataFrame, by: str, n: int | None = None) -> DataFrame:
    """(by, n): findings of each value, the most frequent first if only n are asked for."""
    out = findings.groupBy(by).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), by).limit(n) if n else out


def stat_rows(findings: DataFrame) -> DataFrame:
    """The dashboard's counts in one table (measure, value, n): all findings, by severity, and the ten most frequent types."""
    c = F.col
    total = findings.agg(F.lit("total_findings").alias("measure"), F.lit(None).cast("string").alias("value"), F.count("*").alias("n"))
    severity = distribution(findings, "severity").select(F.lit("severity").alias("measure"), c("severity").alias("value"), "n")
    kinds = distribution(findings, "type", TOP_KINDS).select(F.lit("type").alias("measure"), c("type").alias("value"), "n")
    return total.unionByName(severity).unionByName(kinds)


class Conflict(RuntimeError):
    """The log went on in a way that a commit does not go with."""


class FindingStore:
    """Folders `scans` and `findings`, by scan, and the commits of `log` below a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _there(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/{name}"))

    @property
    def commits(self) -> DataFrame:
        """(version, action, scan) of all commits."""
        schema = "version bigint, action string, scan string"
        return self.spark.read.schema(schema).option("pathGlobFilter", "*.json").json(f"{self.path}/log") if self._there("log") else self.spark.createDataFrame([], schema)

    def version(self) -> int:
        """The last commit's number; 0 if there is none."""
        if not self._there("log"):
            return 0
        names = (f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.path}/log")))
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    @property
    def live(self) -> DataFrame:
        """(id) of the scans that there are."""
        return self.commits.groupBy(F.col("scan").alias("id")).agg(F.max_by("action", "version").alias("action")).where("action = 'add'").select("id")

    def _publish(self, version: int, action: str, scan: str) -> bool:
        """Make the log's commit of this number, complete at once; False if there is one."""
        target = self._path(f"{self.path}/log/{version:012d}.json")
        if self._fs.exists(target):
            return False
        self._fs.mkdirs(target.getParent())
        draft = self._path(f"{self.path}/log/_{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray((json.dumps({"version": version, "action": action, "scan": scan}) + "\n").encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(self._fs.makeQualified(draft), self._fs.makeQualified(target), none)
        except Exception:
            self._fs.delete(draft, False)
            if self._fs.exists(target):
                return False
            raise
        return True

    def _commit(self, action: str, scan: str, base: int) -> int:
        """Publish after what was known at `base`. Commits of others that came between must not be about the same scan."""
        version = base + 1
        while not self._publish(version, action, scan):
            if self.commits.where((F.col("version") == version) & (F.col("scan") == scan)).count():
                raise Conflict(f"scan {scan} was changed by commit {version}")
            version += 1
        self.spark.catalog.refreshByPath(self.path)
        return version

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if self._there(name) else self.spark.createDataFrame([], schema)

    @property
    def scans(self) -> DataFrame:
        return self._read("scans", f"{SCANS}, scan_id string").drop("scan_id").join(self.live, "id", "left_semi")

    @property
    def findings(self) -> DataFrame:
        return self._read("findings", FINDINGS).join(self.live.withColumnRenamed("id", "scan_id"), "scan_id", "left_semi").select(*[f.split()[0] for f in FINDINGS.split(", ")])

    def _write_findings(self, rows: DataFrame, scan: str) -> None:
        rows.write.parquet(f"{self.path}/findings/scan_id={scan}")

    def _write_head(self, head: DataFrame, scan: str) -> None:
        head.write.parquet(f"{self.path}/scans/scan_id={scan}")

    def add_scan(self, findings: DataFrame, scan_path: str, files_scanned: int | None = None, duration: float | None = None, metadata: str | None = None) -> str:
        """Write a scan and publish it; findings carry ordinal, type, severity, file, line, message, rule_id and cwe."""
        scan, base = str(uuid.uuid4()), self.version()
        rows = findings.select(
            F.col("ordinal").cast("bigint").alias("id"), F.format_string("VP-%04d", F.col("ordinal").cast("bigint")).alias("finding_id"), F.coalesce("type", F.lit("unknown")).alias("type"), F.coalesce("severity", F.lit("low")).alias("severity"),
            "file", F.col("line").cast("bigint").alias("line"), "message", "rule_id", "cwe", F.to_json(F.struct(*findings.columns)).alias("details"),
        )
        self._write_findings(rows, scan)
        written = self.spark.read.schema(FINDINGS.rsplit(", ", 1)[0]).parquet(f"{self.path}/findings/scan_id={scan}")
        head = scan_counts(written).select(
            F.lit(scan).alias("id"), F.lit(scan_path).alias("scan_path"), F.lit("completed").alias("status"), "total_findings", *[f"{x}_count" for x in LEVELS],
            F.lit(files_scanned).cast("bigint").alias("files_scanned"), F.lit(duration).cast("double").alias("scan_duration"), F.lit(metadata).cast("string").alias("metadata"), F.current_timestamp().alias("created_at"),
        )
        self._write_head(head, scan)
        self._commit("add", scan, base)
        return scan

    def vacuum(self, older_than: float = 86_400) -> list[str]:
        """Remove files of scans that are not in the log's result, if nothing of them is newer than so many seconds: a scan being written stays."""
        live = {r[0] for r in self.live.collect()}
        gone = []
        for name in ("findings", "scans"):
            for f in self._fs.listStatus(self._path(f"{self.path}/{name}")) if self._there(name) else ():
                scan = f.getPath().getName().removeprefix("scan_id=")
                if scan not in live and f.getModificationTime() / 1000 <= time.time() - older_than:
                    self._fs.delete(f.getPath(), True)
                    gone.append(scan)
        self.spark.catalog.refreshByPath(self.path)
        return sorted(set(gone))

    def list_scans(self, number: int = 1, size: int = 20) -> DataFrame:
        return page(self.scans, [F.desc("created_at"), F.col("id")], number, size)

    def get_scan(self, scan: str) -> DataFrame:
        return self.scans.where(F.col("id") == scan)

    def get_findings(self, scan: str, severity: str | None = None, kind: str | None = None, number: int = 1, size: int = 50) -> DataFrame:
        return page(filtered(self.findings.where(F.col("scan_id") == scan), severity, kind), [F.col("id")], number, size)

    def delete_scan(self, scan: str) -> bool:
        """Publish that the scan is gone, from when on no read sees it or its findings; then remove its files. False if it is gone already."""
        base = self.version()
        if self.get_scan(scan).isEmpty():
            return False
        try:
            self._commit("delete", scan, base)
        except Conflict:
            return False
        for name in ("findings", "scans"):
            self._fs.delete(self._path(f"{self.path}/{name}/scan_id={scan}"), True)
        self.spark.catalog.refreshByPath(self.path)
        return True

    def stats(self) -> dict:
        found = {"severity": {}, "type": {}}
        total = 0
        for r in stat_rows(self.findings).collect():
            if r["measure"] == "total_findings":
                total = r["n"]
            else:
                found[r["measure"]][r["value"]] = r["n"]
        recent = self.scans.orderBy(F.desc("created_at")).limit(RECENT).collect()
        return {
            "total_scans": self.scans.count(), "total_findings": total, "severity_distribution": found["severity"], "type_distribution": found["type"], "recent_scans": [r.asDict() for r in recent],
        }


class PagedTable:
    """Rows in the order of their keys, dealt to ranges of about `rows` each, with counts by range: a page reads the ranges that it lies in.

    keys: columns that order the rows, of which the last tells rows apart; by: columns that pages may be filtered by. Counts
    are by range and values of `by`, so pages of filtered rows are found as fast. Written once, below a path.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], by: list[str]):
        self.spark, self.path, self.keys, self.by = spark, path.rstrip("/"), keys, by

    @classmethod
    def build(cls, rows: DataFrame, path: str, keys: list[str], by: list[str] | None = None, size: int = 100_000) -> PagedTable:
        spark, by = rows.sparkSession, by or []
        ranges = max(1, -(-rows.count() // size))
        dealt = rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("_range", F.spark_partition_id())
        dealt.write.partitionBy("_range").parquet(f"{path}/rows")
        counted = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, _range int").parquet(f"{path}/rows")
        low, high = (f(F.struct(*keys)).alias(n) for f, n in ((F.min, "low"), (F.max, "high")))
        counted.groupBy("_range", *by).agg(F.count("*").alias("n"), low, high).coalesce(1).write.parquet(f"{path}/counts")
        return cls(spark, path, keys, by)

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def _chosen(self, filters: dict) -> tuple:
        unknown = filters.keys() - set(self.by)
        if unknown:
            raise ValueError(f"pages are not filtered by {sorted(unknown)}")
        ok = F.lit(True)
        for k, v in filters.items():
            ok = ok & F.col(k).eqNullSafe(F.lit(v))
        return ok, self.spark.read.parquet(f"{self.path}/counts").where(ok)

    def page(self, number: int, size: int, **filters) -> DataFrame:
        """The rows of a page, in order."""
        if number < 1 or size < 1:
            raise ValueError("pages and their sizes start at 1")
        ok, counts = self._chosen(filters)
        # one number for each range
        before, skip, chosen, first = 0, (number - 1) * size, [], 0
        for r in counts.groupBy("_range").agg(F.sum("n").alias("n")).orderBy("_range").collect():
            if before + r["n"] > skip and before < skip + size:
                first = first if chosen else before
                chosen.append(r["_range"])
            before += r["n"]
        rows = self._rows().where(F.col("_range").isin(chosen) if chosen else F.lit(False)).where(ok)
        return rows.drop("_range").orderBy(*self.keys).offset(max(0, skip - first)).limit(size)

    def after(self, place: dict, size: int, **filters) -> DataFrame:
        """The next rows after the keys of `place`, in order: the last row of a page, wherever it was."""
        ok, counts = self._chosen(filters)
        at = F.struct(*[F.lit(place[k]).cast(f.dataType).alias(k) for k in self.keys for f in self._rows().schema if f.name == k])
        need, chosen = size, []
        for r in counts.where(F.col("high") > at).groupBy("_range").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.min(F.col("low") > at).alias("whole")).orderBy("_range").collect():
            chosen.append(r["_range"])
            need -= r["n"] if r["whole"] else 0
            if need <= 0:
                break
        rows = self._rows().where(F.col("_range").isin(chosen) if chosen else F.lit(False)).where(ok & (F.struct(*self.keys) > at))
        return rows.drop("_range").orderBy(*self.keys).limit(size)

    def total(self, size: int, **filters) -> tuple[int, int]:
        """Rows and pages."""
        n = self._chosen(filters)[1].agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        return n, -(-n // size)
