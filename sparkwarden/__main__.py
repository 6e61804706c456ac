"""Command line: scan, train, dataset, benchmark, extract-nvd, init. Exit codes: 0 done, 1 findings at or above --fail-on, 2 an error."""

from __future__ import annotations

import argparse
import logging
import os
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkwarden")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--debug", action="store_true")
    p.add_argument("--log-file")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan", help="findings of a project")
    s.add_argument("path")
    s.add_argument("--format", default=None, choices=["text", "json", "sarif", "markdown", "html"])
    s.add_argument("--output")
    s.add_argument("--profile", default="standard")
    s.add_argument("--min-severity")
    s.add_argument("--baseline", help="Parquet written by --save-baseline, or a JSON document of findings")
    s.add_argument("--save-baseline")
    s.add_argument("--show-suppressed", action="store_true")
    s.add_argument("--fail-on", choices=["low", "medium", "high", "critical"])
    s.add_argument("--model", help="a saved pipeline, for the deep profile")
    s.add_argument("--rules", action="append", help="a folder of further rules")
    s.add_argument("--latest", help="CSV of name, latest: the newest versions of packages")
    s.add_argument("--advisories", help="JSON lines of package, version and severity")
    s.add_argument("--advisory-records", help="advisory records with version ranges, one JSON document a line")
    s.add_argument("--commits", help="CSV of file, author, ts, for churn")
    s.add_argument("--commit-log", help="the output of git log --name-status -M, for churn that follows renames")
    s.add_argument("--bandit", help="a captured report")
    s.add_argument("--eslint", help="a captured report")
    t = sub.add_parser("train", help="fit a model on a labelled CSV")
    t.add_argument("csv")
    t.add_argument("model")
    n = sub.add_parser("extract-nvd", help="patterns of a local NVD document as CSV")
    n.add_argument("json")
    n.add_argument("csv")
    b = sub.add_parser("benchmark", help="detection over synthetic samples, and timed scans of synthetic projects")
    b.add_argument("out", help="a folder for the results")
    d = sub.add_parser("dataset", help="a labelled training dataset with its mapping and summary")
    d.add_argument("out")
    i = sub.add_parser("init", help="write a default configuration")
    i.add_argument("path", nargs="?", default=".")
    return p


def _tables(args: argparse.Namespace, spark) -> dict:
    """What a scan is told of packages, commits and other tools' findings."""
    from pyspark.sql import functions as F

    from sparkwarden.sources import readers
    from sparkwarden.sources.commits import changes, read_log, renamed

    out: dict = {"tools": []}
    if args.latest:
        out["latest"] = spark.read.schema("name string, latest string").csv(args.latest, header=True)
    if args.advisories:
        out["advisories"] = spark.read.schema("name string, version string, severity string").json(args.advisories)
    if args.advisory_records:
        out["advisories"] = spark.read.text(args.advisory_records).withColumnRenamed("value", "json")
    if args.commits:
        out["commits"] = spark.read.schema("file string, author string, ts timestamp").csv(args.commits, header=True)
    if args.commit_log:
        rows = renamed(changes(read_log(spark, args.commit_log)).where("ts IS NOT NULL"))
        out["commits"] = rows.select("commit", F.col("now").alias("file"), "author", "ts").distinct().drop("commit")
    for tool in ("bandit", "eslint"):
        if path := getattr(args, tool):
            out["tools"].append(readers.tool_findings(spark.read.text(path, wholetext=True).select(F.col("value").alias("json")), tool))
    return out


def _scan(args: argparse.Namespace, spark) -> int:
    from pyspark.sql import functions as F

    from sparkwarden.operators.rules import load_all
    from sparkwarden.plans import config
    from sparkwarden.plans.scan import scan_project
    from sparkwarden.plans.tables import held
    from sparkwarden.sources import readers, sinks

    log = logging.getLogger("sparkwarden")
    raw, warnings = config.load_config(args.path)
    for w in warnings:
        log.warning("configuration: %s", w)
    c = config.overridden(raw, {"output.format": args.format, "output.file": args.output, "severity.minimum": args.min_severity, "ml.model_path": args.model})
    ignore = list(c["scan"]["exclude"])
    file = os.path.join(args.path, ".sparkwardenignore")
    if os.path.isfile(file):
        ignore += readers.ignore_patterns(spark.read.text(file))
    deep = config.profile(args.profile).ml_scoring
    model = None
    if c["ml"]["enabled"] and c["ml"]["model_path"]:
        if not deep:
            log.warning("profile %s scores nothing: the model is not used", args.profile)
        else:
            from pyspark.ml import PipelineModel

            model = PipelineModel.load(c["ml"]["model_path"])
    folders = [*c["rules"]["additional_dirs"], *(args.rules or [])]
    options = _tables(args, spark) | {"languages": tuple(c["scan"]["languages"]), "disabled": tuple(c["rules"]["disabled"]), "rules": load_all(folders) if folders else None, "auto_train": bool(c["ml"]["enabled"])}
    baseline = readers.baseline(spark, args.baseline) if args.baseline else None
    # everything is scanned once; what is reported is a part of it
    every, errors = scan_project(spark, args.path, args.profile, "low", ignore, baseline, True, model, **options)
    every = held(every.withColumn("place", F.monotonically_increasing_id()))
    if args.save_baseline:
        sinks.save_baseline(every, args.save_baseline)
    for row in errors.orderBy("file").toLocalIterator():
        log.warning("%s: %s", row["file"], row["error"])
    found, hidden = shown(every, c["severity"]["minimum"], args.show_suppressed)
    form, out = c["output"]["format"], c["output"]["file"]
    if out:
        sinks.write_report(found, out, form, args.path, hidden)
    else:
        print(sinks.render(found, form, args.path, hidden))
    return int(bool(args.fail_on) and sinks.level_counts(found, args.fail_on)[1])


def shown(every, minimum: str, suppressed: bool):
    """The findings to report, in their order, and how many are suppressed."""
    from pyspark.sql import functions as F

    from sparkwarden.operators.scoring import at_least

    hidden = every.where("suppression_reason IS NOT NULL").count()
    kept = every if suppressed else every.where("suppression_reason IS NULL")
    return at_least(kept, minimum).orderBy(F.col("place")), hidden


def run(args: argparse.Namespace, spark) -> int:
    from pyspark.sql import functions as F

    from sparkwarden.plans import config
    from sparkwarden.plans.scan import scan
    from sparkwarden.sources import readers, sinks

    if args.command == "scan":
        return _scan(args, spark)
    if args.command == "train":
        from sparkwarden.operators.learning import FEATURES, features, trained

        rows = readers.read_labelled(spark, args.csv)
        x = features(rows.drop(*[n for n in ("dangerous_calls", "trace", "call_chain", "var_trace", "input_validation", "dependencies") if n in rows.columns]), ["label"])
        model, metrics = trained(x, FEATURES)
        model.write().overwrite().save(args.model)
        print(" ".join(f"{k}={v}" for k, v in metrics.items() if k != "grp"))
    elif args.command == "benchmark":
        import json

        from sparkwarden.plans.training import benchmark_run, benchmark_samples, timed_scans

        result, _ = benchmark_run(benchmark_samples(spark), args.out)
        print(result.where("grp IS NULL").first())
        timings = timed_scans(spark)
        sinks.write_text(spark, f"{args.out}/timings.json", json.dumps({"results": timings, "all_passed": all(t["passed"] for t in timings)}))
        return int(not all(t["passed"] for t in timings))
    elif args.command == "dataset":
        from sparkwarden.plans.training import training_run

        training_run(spark, args.out)
    elif args.command == "extract-nvd":
        sinks.write_nvd(readers.nvd_elements(spark, args.json), args.csv)
    else:
        with open(os.path.join(args.path, config.NAMES[0]), "x", encoding="utf-8") as f:
            f.write(config.default_yaml())
    return 0


def session():
    """The session there is, or a new one; its executors get this package."""
    from pyspark.sql import SparkSession

    from sparkwarden.package import ship

    spark = SparkSession.builder.appName("sparkwarden").getOrCreate()
    ship(spark)
    return spark


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    level = logging.DEBUG if args.debug else logging.INFO if args.verbose else logging.WARNING
    logging.basicConfig(level=level, filename=args.log_file)
    try:
        return run(args, session())
    except Exception as e:  # a command reports its error by its code
        logging.getLogger("sparkwarden").error("%s", e)
        return 2


if __name__ == "__main__":
    sys.exit(main())
