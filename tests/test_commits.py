"""Commit logs: texts to changes, renames against plain loops over the history."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkwarden.sources import commits as C

LOG = """commit 1111111111111111111111111111111111111111
Author: A. Person <a@x.org>
Date:   Mon Jan 1 10:00:00 2024 +0000

    first

    commit 2222222222222222222222222222222222222222 is only mentioned
    Author: nobody

A\tapp/a.py
A\t"sp\\303\\244t.py"

commit 3333333333333333333333333333333333333333
Merge: 1111111 2222222
Author: b
Date:   2024-01-02T10:00:00+02:00

    merge

commit 4444444444444444444444444444444444444444
Author: B <b@x.org>
AuthorDate: Wed, 3 Jan 2024 10:00:00 +0000
Commit: C <c@x.org>

    rename

R095\tapp/a.py\tapp/b.py
M\tlib/with space.py
C100\tx\ty
"""


def rows_of(df):
    return sorted((r.commit[0], r.author, r.ts.isoformat() if r.ts else None, r.status, r.file, r.old or "") for r in df.collect())


WANT = sorted([("1", "a@x.org", "2024-01-01T10:00:00", "A", "app/a.py", ""), ("1", "a@x.org", "2024-01-01T10:00:00", "A", "sp\\303\\244t.py", ""), ("4", "b@x.org", "2024-01-03T10:00:00", "R", "app/b.py", "app/a.py"), ("4", "b@x.org", "2024-01-03T10:00:00", "M", "lib/with space.py", ""), ("4", "b@x.org", "2024-01-03T10:00:00", "C", "y", "x")])


def test_texts_in_a_table(spark):
    df = spark.createDataFrame([(LOG,), (None,), ("no log",), ("",)], "text string")
    assert rows_of(C.changes(C.split_log(df))) == WANT


def test_a_file_is_cut_at_borders(spark, tmp_path):
    big = "".join(LOG.replace("1111", f"{k:04d}", 1) for k in range(3000))
    (tmp_path / "log").write_text(big)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        read = C.read_log(spark, str(tmp_path / "log"))
        assert read.rdd.getNumPartitions() > 10
        assert read.count() == 9000 and C.changes(read).count() == 15000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def plain_names(history):
    """history: (moment, status, file, old) in order. The last name of each change's file, by following identities."""
    who, names, out = {}, {}, []
    for i, (_, status, file, old) in enumerate(history):
        if status == "R" and old != file:
            ident = who.pop(old, None)
            if ident is None:
                ident = ("implied", old, i)
            if file in who:
                ident2 = who[file]
                names[ident] = ("same", ident2)
                ident = ident2
            who[file] = ident
        elif file not in who:
            who[file] = ("new", file, i)
        out.append(who[file])
        names.setdefault(who[file], file)
        if names[who[file]] is not None and not isinstance(names[who[file]], tuple):
            names[who[file]] = file
    def last(x):
        while isinstance(names[x], tuple):
            x = names[x][1]
        return names[x]
    return [last(x) for x in out]


@pytest.mark.parametrize("seed", range(4))
def test_renames_equal_loops(spark, seed):
    r = random.Random(seed)
    start, history = datetime(2024, 1, 1), []
    live, fresh = {f"f{k}" for k in range(4)}, 4
    for i in range(150):
        x = r.random()
        if x < 0.3:
            old = r.choice(sorted(live))
            to = r.choice(sorted({f"f{k}" for k in range(12)} - live)) if r.random() < 0.6 else f"n{fresh}"
            fresh += 1
            live = live - {old} | {to}
            history.append((i, "R", to, old))
        elif x < 0.4:
            new = f"f{r.randint(0, 11)}"
            live.add(new)
            history.append((i, "M", new, None))
        else:
            history.append((i, "M", r.choice(sorted(live)), None))
    df = spark.createDataFrame([(f"{i:04x}", "a", start + timedelta(hours=i), s, f, o) for i, s, f, o in history], "commit string, author string, ts timestamp, status string, file string, old string")
    got = {int(x.commit, 16): x.now for x in C.renamed(df).collect()}
    assert [got[i] for i in range(len(history))] == plain_names(history)


def test_chains_cycles_and_paths_made_anew(spark):
    rows = [("A", "a", None), ("R", "b", "a"), ("R", "c", "b"), ("A", "a", None), ("R", "d", "c"), ("M", "a", None), ("R", "a2", "a"), ("R", "a", "d"), ("M", "a", None)]
    df = spark.createDataFrame([(f"{i:04x}", "x", datetime(2024, 1, 1 + i), *r) for i, r in enumerate(rows)], "commit string, author string, ts timestamp, status string, file string, old string")
    got = {int(x.commit, 16): x.now for x in C.renamed(df).collect()}
    assert [got[i] for i in range(9)] == ["a", "a", "a", "a2", "a", "a2", "a2", "a", "a"]
    long = spark.createDataFrame([(f"{i:04x}", "x", datetime(2024, 1, 1) + timedelta(hours=i), "R", f"p{i + 1}", f"p{i}") for i in range(100)], df.schema)
    assert {x.now for x in C.renamed(long).collect()} == {"p100"}
    same = spark.createDataFrame([("a", "x", datetime(2024, 1, 1), "R", "new", "old"), ("a", "x", datetime(2024, 1, 1), "A", "old", None), ("9", "x", datetime(2023, 1, 1), "M", "old", None)], df.schema)
    assert sorted((x.status, x.now) for x in C.renamed(same).collect()) == [("A", "old"), ("M", "new"), ("R", "new")]


def test_churn_of_a_log(spark):
    df = C.split_log(spark.createDataFrame([(LOG,)], "text string"))
    out = {r.file: (r.commit_count, r.unique_authors, r.last_modified_days) for r in C.log_churn(df, F.lit("2024-01-13 10:00:00").cast("timestamp")).collect()}
    assert out == {"app/b.py": (2, 2, 10), "sp\\303\\244t.py": (1, 1, 12), "lib/with space.py": (1, 1, 10), "y": (1, 1, 10)}
    assert C.log_churn(df.limit(0), F.current_timestamp()).count() == 0


def test_the_command_reads_logs_and_advisory_records(spark, tmp_path):
    from sparkwarden.__main__ import _tables, parser

    (tmp_path / "log").write_text(LOG)
    (tmp_path / "records").write_text('{"id": "A"}\n{"id": "B"}\n')
    args = parser().parse_args(["scan", ".", "--commit-log", str(tmp_path / "log"), "--advisory-records", str(tmp_path / "records")])
    out = _tables(args, spark)
    assert sorted((r.file, r.author) for r in out["commits"].collect())[:2] == [("app/b.py", "a@x.org"), ("app/b.py", "b@x.org")]
    assert out["advisories"].columns == ["json"] and out["advisories"].count() == 2
