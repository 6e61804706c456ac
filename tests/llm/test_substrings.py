"""Substring dedup against brute force over all windows."""

import hashlib
import random
import re

import pytest

from sparkwarden.llm import substrings

SCHEMA = "doc_id long, text string, n_words long, kept string"


def brute(rows, length):
    """(id, words, removed, kept) for each row."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, split, strict=True):
        for k in range(len(w) - length + 1):
            if i is not None:
                s = tuple(w[k : k + length])
                least[s] = min(i, least.get(s, i))
    out = []
    for (i, _), w in zip(rows, split, strict=True):
        gone = set()
        for k in range(len(w) - length + 1):
            if i is not None and least[tuple(w[k : k + length])] < i:
                gone |= set(range(k, k + length))
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=repr)


def found(spark, rows, length=substrings.LENGTH, **more):
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], SCHEMA).repartition(3)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.deduplicated(df, length=length, **more).collect()), key=repr)


def corpus(seed, n=60, passages=6):
    r = random.Random(seed)
    word = lambda: r.choice("aäbcdefgh") * r.randint(1, 2)
    shared = [[f"p{k}w{j}" for j in range(r.choice((12, 13, 14, 20, 60)))] for k in range(passages)]
    rows = []
    for i in range(n):
        words = [word() for _ in range(r.randint(0, 40))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(shared)
            a = r.randint(0, 5)
            at = r.randint(0, len(words))
            words[at:at] = p[a:]
        rows.append((i * 3 - 20, r.choice((" ", "\n", "\t ")).join(words)))
    rows.append((1000, rows[5][1]))
    rows.append((1001, rows[5][1] + " end"))
    return rows


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("chunk", [1, 500, substrings.CHUNK])
def test_windows_equal_brute_force(spark, seed, chunk):
    rows = corpus(seed)
    want = brute(rows, substrings.LENGTH)
    assert sum(w[2] for w in want) > 200
    assert found(spark, rows, chunk_bytes=chunk) == want


@pytest.mark.parametrize("length,period,cover", [(5, 3, (0, 1)), (13, 13, (0, 1, 3, 9)), (7, 7, (0, 1, 3)), (4, 1, (0,))])
def test_other_covers(spark, length, period, cover):
    rows = corpus(7, 30)
    assert found(spark, rows, length, period=period, cover=cover, chunk_bytes=300) == brute(rows, length)


def test_a_cover_must_have_all_differences(spark):
    with pytest.raises(ValueError):
        substrings.deduplicated(spark.createDataFrame([], SCHEMA), cover=(0, 1))


def test_every_pair_of_places_shares_an_anchor():
    p, c = substrings.PERIOD, substrings.COVER
    assert all(any((i + d) % p in c and (j + d) % p in c for d in range(p)) for i in range(p) for j in range(p))


def test_defined_cases(spark):
    passage = " ".join(f"w{k}" for k in range(20))
    long = " ".join(f"l{k}" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, passage), (3, passage), (None, passage), (None, passage), (4, "a " + passage), (5, long), (6, f"x {long} y"), (7, " ".join(f"w{k}" for k in range(12))), (-9, "ß " + passage[3:]), (8, passage + " " + passage)]
    assert found(spark, rows) == brute(rows, substrings.LENGTH)
    assert found(spark, []) == []


def test_a_passage_in_most_documents_is_one_entry_of_a_chunk(spark):
    passage = " ".join(f"w{k}" for k in range(50))
    rows = [(i, f"a{i} {passage} b{i}") for i in range(500)]
    assert found(spark, rows, chunk_bytes=4000) == brute(rows, substrings.LENGTH)


def test_removed_ranges_and_digest(spark):
    passage = " ".join(f"w{k}" for k in range(13))
    df = spark.createDataFrame([(1, passage), (2, f"x {passage} y {passage}")], "doc_id long, text string")
    got = {r.doc_id: r for r in substrings.deduplicated(df).collect()}
    assert [(x.start, x.end) for x in got[2].removed] == [(1, 14), (15, 28)] and got[2].kept == "x y" and got[1].removed == []
    assert hashlib.sha256(b"x y").hexdigest() == hashlib.sha256(got[2].kept.encode()).hexdigest()
