"""Training data, benchmark and timing runs: samples by type, detection over samples, scans of synthetic projects."""

from __future__ import annotations

import json
import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.functions import catalog as C
from sparkwarden.operators import learning as L
from sparkwarden.sources import sinks

from .config import profile
from .scan import findings_of, scan
from .tables import folder, held

#: Vulnerable and safe samples by type.
TEMPLATES: dict[str, tuple[list[str], list[str]]] = {
    "sql_injection": (["cursor.execute('SELECT * FROM t WHERE id = ' + key)", "name = input()\ncursor.execute(name)"], ["cursor.fetchone()", "total = sum(rows)"]),
    "xss": (["eval(page)", "exec(body)"], ["shown = html.escape(page)"]),
    "command_injection": (["os.system('ls ' + path)", "subprocess.call(line)"], ["names = sorted(paths)"]),
    "path_traversal": (["open(base + name)", "shutil.rmtree(target)"], ["base = '/srv/data'"]),
    "deserialization": (["pickle.loads(blob)", "yaml.load(text)"], ["json.loads(text)"]),
    "ssrf": (["requests.get(url)", "urlopen(link)"], ["host = 'internal'"]),
    "weak_crypto": (["hashlib.md5(secret)", "hashlib.sha1(secret)"], ["hashlib.sha256(secret)"]),
}
#: Scenario: files, seconds allowed, profile.
TARGETS = {"small_quick": (50, 5.0, "quick"), "small_standard": (50, 30.0, "standard"), "medium_quick": (500, 30.0, "quick"), "medium_standard": (500, 180.0, "standard")}
PREVIEW = 80


def training_run(spark: SparkSession, out: str, per_kind: int = 20) -> dict:
    """The mapping of weakness classes, a labelled dataset and a summary below out; the summary is returned."""
    sinks.write_text(spark, f"{out}/cwe_mapping.json", json.dumps({k: dict(zip(("rule_id", "type", "severity"), v, strict=True)) for k, v in C.CWE_RULES.items()}, indent=1))
    samples = L.synthetic_samples(spark, TEMPLATES, per_kind)
    meta = sinks.write_dataset(samples, f"{out}/training_dataset")
    summary = {"pipeline_version": "1.0.0", "cwe_mapping_path": f"{out}/cwe_mapping.json", "dataset_metadata": meta | {"samples_per_type": per_kind}, "run_at": datetime.now(timezone.utc).isoformat()}
    sinks.write_text(spark, f"{out}/pipeline_summary.json", json.dumps(summary, indent=1))
    return summary


def benchmark_samples(spark: SparkSession, per_kind: int = 15) -> DataFrame:
    """Synthetic samples with an id, inside a function of a Python file each."""
    return as_files(held(L.synthetic_samples(spark, TEMPLATES, per_kind)).withColumn("id", F.concat_ws("-", "type", "label", "variant")))


def as_files(samples: DataFrame) -> DataFrame:
    """Samples (id, label, type, code) inside a function of a Python file each."""
    body = F.array_join(F.transform(F.split("code", "\n"), lambda x: F.concat(F.lit("    "), x)), "\n")
    whole = F.concat(F.lit("def sample(key, path, page, body, line, base, name, target, blob, text, url, link, secret, rows, paths):\n"), body)
    return samples.select("id", "label", "type", F.lit("python").alias("language"), whole.alias("code"))


def benchmark_run(samples: DataFrame, out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(confusion by type, details) of samples (id, label, type, language, code): a sample with any finding is detected.

    With a folder, both are written below it as JSON lines.
    """
    suffix = F.when(F.col("language") == "python", ".py").otherwise(".js")
    files = samples.select(F.concat("id", suffix).alias("file"), F.col("code").alias("content"))
    found = findings_of(files, profile("standard")).groupBy(F.regexp_replace("file", r"\.(py|js)$", "").alias("id")).agg(F.count("*").alias("findings_count"))
    found = held(found)
    result = sinks.benchmark(samples, found)
    d = samples.join(found, "id", "left").withColumn("findings_count", F.coalesce("findings_count", F.lit(0)))
    hit, bad = F.col("findings_count") > 0, F.col("label") == 1
    outcome = F.when(hit & bad, "TP").when(hit, "FP").when(bad, "FN").otherwise("TN")
    details = d.select("id", F.left("code", F.lit(PREVIEW)).alias("code_preview"), "label", "type", hit.alias("detected"), outcome.alias("outcome"), "findings_count")
    if out:
        result.write.mode("overwrite").json(f"{out}/summary")
        details.write.mode("overwrite").json(f"{out}/detailed_results")
    return result, details


def timed_scans(spark: SparkSession, scenarios: list[str] | None = None) -> list[dict]:
    """Each scenario's scan of a synthetic project, its seconds against the target, and whether it passed."""
    out = []
    for name in scenarios or TARGETS:
        files, target, chosen = TARGETS[name]
        path = folder(spark, "project")
        project = sinks.synthetic_project(spark, files)
        for row in project.toLocalIterator():
            sinks.write_text(spark, f"{path}/{row['file']}", row["content"])
        start = time.perf_counter()
        scan(spark, path, chosen).write.format("noop").mode("overwrite").save()
        seconds = time.perf_counter() - start
        out.append({"scenario": name, "file_count": files, "profile": chosen, "elapsed_seconds": round(seconds, 3), "target_seconds": target, "passed": seconds <= target, "files_per_second": round(files / seconds, 1)})
    return out
