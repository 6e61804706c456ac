"""Version order against the packaging library and the published examples; ranges against plain loops."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from sparkwarden.operators import versions as V

PYTHON = """1.0.dev1 1.0a1.dev2 1.0a1 1.0a2 1.0b1 1.0rc1 1.0rc2 1.0 1.0+abc 1.0+abc.2 1.0+2 1.0.post1.dev3 1.0.post1 1.0.post2 1.0.1 1.1.dev1 1.1 1.2 1.10 1.11a1 2.0
    10.0 2013.10 1!0.5 1!1.0rc1 1!1.0 12345678901234567890.1 0 0.0.1 v1.5 1.5.0.0 1.5.0-1 1.5c3 1.5.rev4 1.5_dev""".split()
SEMANTIC = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.1-0", "1.0.1-0.3.7", "1.0.1-0a", "1.0.1", "1.1.0", "1.2.0", "1.10.0", "2.0.0", "10.0.0"]


def keys(spark, ecosystem, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    got = {r.i: r.k for r in df.select("i", V.version_key(F.lit(ecosystem), F.col("v")).alias("k")).collect()}
    return [got[i] for i in range(len(texts))]


def test_python_order(spark):
    packaging = pytest.importorskip("packaging.version")
    k = keys(spark, "PyPI", PYTHON)
    assert None not in k
    for (a, x), (b, y) in itertools.combinations(zip(PYTHON, k, strict=True), 2):
        one, two = packaging.Version(a), packaging.Version(b)
        assert (one < two, one == two) == (x < y, x == y), (a, b)


def test_semantic_order(spark):
    k = keys(spark, "npm", SEMANTIC)
    assert k == sorted(k) and len(set(k)) == len(k)
    assert keys(spark, "npm", ["v1.2", "=1.2.0+build.5", "1.2.0"]) == [keys(spark, "npm", ["1.2.0"])[0]] * 3


def test_what_is_no_version_has_no_key(spark):
    assert keys(spark, "PyPI", ["", "x", "1.0-", "1..0", None, "1.0 2.0", "latest"]) == [None] * 7
    assert keys(spark, "npm", ["", "x", "*", "1.x", None, ">=1"]) == [None] * 6


def record(vuln, name, *, events=None, versions=None, severity=None, ecosystem="PyPI", kind="ECOSYSTEM"):
    affected = {"package": {"name": name, "ecosystem": ecosystem}}
    if events is not None:
        affected["ranges"] = [{"type": kind, "events": [{k: v} for k, v in events]}]
    if versions is not None:
        affected["versions"] = versions
    return json.dumps({"id": vuln, "affected": [affected], "database_specific": {"severity": severity}})


RECORDS = [
    record("A", "p", events=[("introduced", "0"), ("fixed", "1.0")], severity="HIGH"),
    record("B", "p", events=[("introduced", "1.0"), ("last_affected", "1.1")], severity="LOW"),
    record("C", "p", events=[("introduced", "2.0rc1")], severity="CRITICAL"),
    record("D", "p", events=[("fixed", "0.5")], severity="MODERATE"),
    record("E", "p", events=[("introduced", "1.0"), ("fixed", "1.2"), ("introduced", "2.0"), ("fixed", "2.1")]),
    record("F", "p", versions=["1.1.0", "weird"], events=[("introduced", "1.0"), ("fixed", "1.0.5")], severity="HIGH"),
    record("G", "p", events=[("introduced", "abc"), ("fixed", "def")], kind="GIT"),
    record("H", "p", events=[("fixed", "1.2"), ("introduced", "1.1")]),  # in any order
    record("I", "p", events=[("introduced", "1.0"), ("limit", "1.0")]),
    record("J", "q", events=[("introduced", "0")], ecosystem="npm", kind="SEMVER"),
    record("F", "p", events=[("introduced", "1.0.4"), ("fixed", "1.1.1")], severity="HIGH"),  # the rest of F, elsewhere
    "{broken", json.dumps({"id": "K"}), json.dumps({"id": "L", "affected": [{"package": {"name": None}}]}),
]
WANT = {
    "0.4": "AD", "0.5": "A", "1.0rc1": "A", "1.0": "BEF", "1.0.post1": "BEF", "1.0.5": "BEF", "1.1": "BEFH", "1.1.1": "EH", "1.2.dev1": "EH", "1.2": "", "2.0a1": "", "2.0rc1": "C",
    "2.0": "CE", "2.1": "C", "99": "C", "weird": "F", "other": "",
}


def test_missing_bounds_prereleases_and_listed_versions(spark):
    records = spark.createDataFrame([(r,) for r in RECORDS], "json string")
    rows = [(i, "PyPI", "p", v) for i, v in enumerate([*WANT, *list(WANT)[:5]])] + [(90, "npm", "q", "1.0.0-a"), (91, "npm", "p", "1.0.0"), (92, "PyPI", "p", None)]
    deps = spark.createDataFrame(rows, "project long, ecosystem string, name string, version string")
    got = {}
    for r in V.affected_versions(deps, records).collect():
        got.setdefault((r.name, r.version), []).append(r.vuln_id)
    assert all(len(set(v)) == len(v) for v in got.values())
    assert {v: "".join(sorted(got.get(("p", v), []))) for v in WANT} == WANT
    assert got["q", "1.0.0-a"] == ["J"] and ("p", "1.0.0") not in got
    level = {"A": "high", "B": "low", "C": "critical", "D": "medium", "E": "unknown", "F": "high", "H": "unknown", "J": "unknown"}
    for r in V.exposure(deps, records).collect():
        ids = got.get((r.name, r.version), []) if r.ecosystem == "PyPI" or r.name == "q" else []
        assert (r.n_advisories, r.n_high, r.n_unknown) == (len(ids), sum(level[i] == "high" for i in ids), sum(level[i] == "unknown" for i in ids)), r
        assert r.severity == (min((level[i] for i in ids), key=lambda s: V.RANK[s]) if ids else None)


@pytest.mark.parametrize("block", [2, 1000])
def test_dependencies_with_advisories(spark, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK", block)
    records = spark.createDataFrame([(r,) for r in RECORDS], "json string")
    rows = [(k, "PyPI", "p", v) for k, v in enumerate([*WANT] * 3 + ["weird"] * 4)] + [(7, "PyPI", "p", "0.4")] * 3 + [(None, "PyPI", "p", "1.1"), (90, "npm", "q", "1.0.0-a"), (91, "npm", "p", "1.0.0"), (92, "PyPI", "p", None), (93, None, "p", "0.4"), (94, "PyPI", None, "0.4"), (95, "PyPI", "p", "")]
    out = V.affected_dependencies(spark.createDataFrame(rows, "project long, ecosystem string, name string, version string"), records)
    assert out.columns == ["project", "ecosystem", "name", "version", "vuln_id", "severity"]
    want = [(*r, v) for r in rows for v in (WANT.get(r[3], "") if r[1:3] == ("PyPI", "p") else "J" if r[2] == "q" else "")]
    assert sorted((tuple(r)[:5] for r in out.collect()), key=repr) == sorted(want, key=repr)


def test_pairs_are_not_shuffled(spark):
    from sparkwarden.plans.packages import advisory_ranges

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = advisory_ranges(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # one join, and nothing is exchanged above it
    assert plan.count("Join") == 1 and "Exchange" not in plan[: plan.index("Join")]


def test_report(spark):
    deps = spark.createDataFrame([(1, "PyPI", "p", "0.4"), (2, "PyPI", "p", "1.10"), (3, "PyPI", "p", None), (4, "PyPI", "z", "1.9"), (5, "npm", "q", "2.0.0-rc.1"), (6, "PyPI", "z", "odd")], "project long, ecosystem string, name string, version string")
    latest = spark.createDataFrame([("p", "1.9"), ("z", "1.10"), ("q", "2.0.0")], "name string, latest string")
    out = {r.project: (r.outdated, r.vulnerable, r.severity, r.n_advisories) for r in V.range_report(deps, latest, spark.createDataFrame([(r,) for r in RECORDS], "json string")).collect()}
    assert out == {1: (True, True, "high", 2), 2: (False, False, None, 0), 3: (False, False, None, 0), 4: (True, False, None, 0), 5: (True, True, "unknown", 1), 6: (True, False, None, 0)}


@pytest.mark.parametrize("seed", range(3))
def test_sweep_equals_loops(spark, seed):
    packaging = pytest.importorskip("packaging.version")
    r = random.Random(seed)
    version = lambda: f"{r.randint(0, 3)}.{r.randint(0, 3)}" + r.choice(["", "", "a1", "rc2", ".post1", ".dev1"])
    plain, texts = [], []
    for i in range(60):
        name, events, spans = r.choice("pq"), [], []
        bounds = sorted({packaging.Version(version()) for _ in range(r.randint(1, 4))})
        for a, b in itertools.zip_longest(bounds[0::2], bounds[1::2]):
            last = r.random() < 0.5
            events.append(("introduced", str(a)))
            if b is not None:
                events.append(("last_affected" if last else "fixed", str(b)))
            spans.append((a, b, last))
        level = r.choice(["HIGH", "LOW", None])
        r.shuffle(events)
        plain.append((f"V{i % 45}", name, spans))
        texts.append((record(f"V{i % 45}", name, events=events, severity=["HIGH", "LOW", None][i % 45 % 3]),))
    deps = [(k, "PyPI", r.choice("pqr"), version()) for k in range(200)]
    df = spark.createDataFrame(deps, "project long, ecosystem string, name string, version string")
    got = {(x.name, x.version): x.n_advisories for x in V.exposure(df, spark.createDataFrame(texts, "json string")).collect()}
    for _, _, name, v in deps:
        x = packaging.Version(v)
        want = {i for i, n, spans in plain if n == name and any(a <= x and (b is None or x < b or last and x == b) for a, b, last in spans)}
        assert got[name, v] == len(want), (name, v, want)


def test_no_rows(spark):
    deps = spark.createDataFrame([], "project long, ecosystem string, name string, version string")
    none = spark.createDataFrame([], "json string")
    assert V.exposure(deps, none).count() == V.affected_versions(deps, none).count() == 0


def test_a_scan_compares_records_with_manifests(spark):
    from sparkwarden.plans.scan import dependency_findings

    files = spark.createDataFrame([("requirements.txt", "p==0.4\nother==1.0\n"), ("package.json", '{"dependencies": {"q": "^2.0.0"}}')], "file string, content string")
    latest = spark.createDataFrame([("p", "0.10")], "name string, latest string")
    out = {r.file: r for r in dependency_findings(files, latest, spark.createDataFrame([(r,) for r in RECORDS], "json string")).collect()}
    assert out["requirements.txt"].num_vulnerable_dependencies == out["requirements.txt"].num_outdated_dependencies == 1
    assert out["requirements.txt"].max_dependency_severity == "high" and out["package.json"].num_vulnerable_dependencies == 1
