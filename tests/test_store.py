"""Commits of the store under crashes and conflicts, and pages by range."""

import random
import re

import pytest
from sparkwarden.operators.store import Conflict, FindingStore, PagedTable


class Crash(Exception):
    pass


@pytest.fixture
def found(spark):
    return spark.createDataFrame([(i, "t", "high", "f.py", i, "m", "R", None) for i in range(5)], "ordinal long, type string, severity string, file string, line long, message string, rule_id string, cwe string")


def crash(monkeypatch, name, before):
    real = getattr(FindingStore, name)

    def fail(self, *a):
        if not before:
            real(self, *a)
        raise Crash

    monkeypatch.setattr(FindingStore, name, fail)


@pytest.mark.parametrize("step,before", [("_write_findings", True), ("_write_findings", False), ("_write_head", True), ("_write_head", False), ("_publish", True)])
def test_a_crash_before_the_commit_leaves_nothing(spark, tmp_path, monkeypatch, found, step, before):
    store = FindingStore(spark, str(tmp_path / "s"))
    kept = store.add_scan(found, "kept")
    with monkeypatch.context() as m:
        crash(m, step, before)
        with pytest.raises(Crash):
            store.add_scan(found, "lost")
    again = FindingStore(spark, str(tmp_path / "s"))
    assert [r.id for r in again.scans.collect()] == [kept] and again.findings.count() == 5 and again.stats()["total_findings"] == 5
    assert again.vacuum() == []  # too new to tell from a scan being written
    assert len(again.vacuum(older_than=-5)) == (0 if (step, before) == ("_write_findings", True) else 1)
    assert again.findings.count() == 5
    assert again.get_scan(again.add_scan(found, "next")).first().total_findings == 5 and again.findings.count() == 10


def test_a_crash_after_the_commit_leaves_the_scan(spark, tmp_path, monkeypatch, found):
    store = FindingStore(spark, str(tmp_path / "s"))
    with monkeypatch.context() as m:
        crash(m, "_publish", False)
        with pytest.raises(Crash):
            store.add_scan(found, "there")
    assert FindingStore(spark, str(tmp_path / "s")).scans.first().scan_path == "there" and store.findings.count() == 5


def test_a_crash_of_a_delete(spark, tmp_path, monkeypatch, found):
    store = FindingStore(spark, str(tmp_path / "s"))
    scan = store.add_scan(found, "x")
    for before in (True, False):
        with monkeypatch.context() as m:
            crash(m, "_publish", before)
            with pytest.raises(Crash):
                store.delete_scan(scan)
        assert store.findings.count() == (5 if before else 0) and store.scans.count() == int(before)
    assert store.vacuum(older_than=-5) == [scan] and store.delete_scan(scan) is False


def test_two_writers_take_numbers_of_their_own(spark, tmp_path, found):
    a, b = (FindingStore(spark, str(tmp_path / "s")) for _ in range(2))
    one = a.add_scan(found, "one")
    stale = b.version()
    a.add_scan(found, "two")
    assert b._commit("add", "three", stale) == stale + 2 and a.version() == 3
    assert sorted(r.version for r in a.commits.collect()) == [1, 2, 3]
    # the same scan is deleted by both
    stale = b.version()
    assert a.delete_scan(one)
    with pytest.raises(Conflict):
        b._commit("delete", one, stale)
    assert b.delete_scan(one) is False


def test_a_commit_is_complete_or_absent(spark, tmp_path):
    store = FindingStore(spark, str(tmp_path / "s"))
    assert store._publish(1, "add", "x") and not store._publish(1, "add", "y")
    assert [tuple(r) for r in store.commits.collect()] == [(1, "add", "x")]
    (tmp_path / "s" / "log" / "_draft").write_text("{half")
    assert store.version() == 1 and store.live.count() == 1


@pytest.fixture(scope="module")
def paged(spark, tmp_path_factory):
    r = random.Random(4)
    rows = [(r.randint(0, 40), i, r.choice(["high", "low", None]), f"t{i % 3}") for i in range(5000)]
    df = spark.createDataFrame(rows, "rank long, id long, severity string, type string").repartition(5)
    return rows, PagedTable.build(df, str(tmp_path_factory.mktemp("pages") / "t"), ["rank", "id"], ["severity", "type"], size=300)


@pytest.mark.parametrize("filters", [{}, {"severity": "high"}, {"severity": None, "type": "t1"}, {"severity": "none"}])
def test_pages_equal_slices(paged, filters):
    rows, table = paged
    want = sorted(x for x in rows if all(x[{"severity": 2, "type": 3}[k]] == v for k, v in filters.items()))
    assert table.total(20, **filters) == (len(want), -(-len(want) // 20))
    for number in (1, 2, 7, len(want) // 20 + 1, 10_000):
        assert [tuple(x) for x in table.page(number, 20, **filters).collect()] == want[(number - 1) * 20 : number * 20]
    for at in (0, 19, len(want) // 2, len(want) - 3, len(want) - 1):
        if 0 <= at < len(want):
            place = {"rank": want[at][0], "id": want[at][1]}
            assert [tuple(x) for x in table.after(place, 25, **filters).collect()] == want[at + 1 : at + 26]
    assert [tuple(x) for x in table.after({"rank": -1, "id": 0}, 5, **filters).collect()] == want[:5]


def test_a_far_page_reads_one_range(paged):
    _, table = paged
    assert len({f.rsplit("_range=", 1)[1].split("/")[0] for f in table._rows().inputFiles()}) > 10
    df = table.page(200, 20)
    assert df.count() == 20
    filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", df._jdf.queryExecution().executedPlan().toString())[1]
    chosen = re.search(r"_range#\d+ (?:IN \(([\d,]+)\)|= (\d+))", filters)
    assert len((chosen[1] or chosen[2]).split(",")) <= 2


def test_bad_pages(paged):
    with pytest.raises(ValueError):
        paged[1].page(0, 5)
    with pytest.raises(ValueError):
        paged[1].page(1, 5, file="x")


def test_an_empty_table(spark, tmp_path):
    t = PagedTable.build(spark.createDataFrame([], "id long, severity string"), str(tmp_path / "t"), ["id"], ["severity"])
    assert t.total(10) == (0, 0)
