"""Near-duplicates against all pairs; the parameters are lowered so that every route runs on small tables."""

import numpy as np
import pytest

from sparkwarden.llm import neardup
from sparkwarden.llm.components import components


def brute(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").replace("\x0b", " ").split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    rng = np.random.default_rng(seed)
    passage = [f"p{i}" for i in range(60)]
    rows, n = [], 0

    def add(words):
        nonlocal n
        rows.append((n, " ".join(words)))
        n += 1

    base = [f"b{i}" for i in range(200)]
    long = [f"l{i}" for i in range(900)]
    for _ in range(60):  # near copies with zero to eight changed words, some below the bound
        for text, most in ((base, 9), (long, 40)):
            w = list(text)
            for k in rng.integers(0, len(w), rng.integers(0, most)):
                w[k] = f"x{rng.integers(1e9)}"
            add(w)
    for _ in range(60):  # a passage in unlike texts of several lengths
        add(passage + [f"u{rng.integers(1e9)}" for _ in range(rng.integers(2, 90))])
    for _ in range(30):
        add([f"r{rng.integers(1e9)}" for _ in range(rng.integers(1, 60))])
    for i in range(10):
        add(rows[i * 3][1].upper().split())
    add(["one"])
    add(["one"])
    add(["one", "two"])
    rows += [(n, ""), (n + 1, None), (n + 2, " \t\n")]
    return rows


@pytest.mark.parametrize(("size", "percent", "k", "limit", "rounds"), [(3, 85, 128, 32, 3), (3, 85, 32, 8, 1), (5, 80, 64, 8, 2)])
def test_against_all_pairs(spark, monkeypatch, size, percent, k, limit, rounds):
    for name, v in (("K", k), ("LIST", limit), ("ROUNDS", rounds)):
        monkeypatch.setattr(neardup, name, v)
    rows = corpus(size * k)
    df = spark.createDataFrame([(i, t, "z") for i, t in rows] + [rows[5] + ("z",), (None, rows[0][1], "z")], "doc_id bigint, text string, kept string")
    got = neardup.near_duplicates(df, size=size, percent=percent).collect()
    assert len(got) == len(rows) + 2
    want = brute(rows, size, percent)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None}
    assert {i: (found[i], want[i]) for i in want if found[i] != want[i]} == {}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_frequent_values_by_join(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HELD_VALUES", 0)
    monkeypatch.setattr(neardup, "LIST", 8)
    rows = corpus(1)[:150]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 3, 85)


def test_large_group_of_sizes_around_k(spark):
    rows = []
    for size in (128, 134):  # 126 and 132 shingles: below and above K; every shared value is frequent
        for i in range(50):
            w = [f"b{k}" for k in range(size)]
            w[3 + 2 * i] = f"x{len(rows)}"
            rows.append((len(rows), " ".join(w)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = brute(rows, 3, 85)
    assert {c for _, c in want.values()} == {0}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_empty(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == dict.fromkeys(range(31), 0) | dict.fromkeys((100, 101, 102), 100)


def test_exact_mode_and_hot_group_of_unlike_copies(spark):
    """A group of copies that are edited, cut at their ends, or changed alike, so that only some are linked with its centre."""
    rng = np.random.default_rng(11)
    rows = []
    base = [f"b{i}" for i in range(150)]
    for i in range(220):
        w = list(base)
        for k in rng.integers(0, len(w), rng.integers(0, 14)):
            w[k] = f"x{rng.integers(1e9)}"
        if i % 4 == 1:
            w = w[: rng.integers(90, 150)]
        if i % 4 == 2:
            w[10:30] = [f"v{k}" for k in range(20)]
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute(rows, 3, 85)
    assert len({c for _, c in want.values()}) > 20
    for exact in (False, True):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, exact=exact).collect()} == want


def test_one_id_with_unlike_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a), (5, a), (5, b), (7, b), (7, b), (9, "c " * 200_000)]
    got = sorted((r.doc_id, r.component_id, r.kept, r.n_shingles) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(1, 1, True, 38), (5, 1, False, 38), (5, 5, True, 38), (7, 5, False, 38), (7, 5, False, 38), (9, 9, True, 1)]


def test_lowest_estimate():
    assert 0.5 < neardup.lowest(0.8, 128) < 0.66 and neardup.lowest(0.85, 128) < 0.72


def test_one_row_of_each_group_stays(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(5, a, 1), (1, a, 2), (5, b, 3), (7, "c d", 4), (7, "c d", 5), (None, a, 6), (None, "e f", 7), (8, "", 8), (9, None, 9)]
    got = neardup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string, kept int"))
    assert got.columns == ["doc_id", "text", "kept"]
    assert sorted(r.kept for r in got.collect() if r.kept not in (4, 5)) == [2, 3, 7, 8, 9]
    assert got.where("kept IN (4, 5)").count() == 1
