"""The prefix trie against brute force over all prefixes."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from sparkwarden.llm import conversations as conv

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def brute(rows):
    of = {}
    for c, t, role, text in rows:
        if c is not None:
            of.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    of = {c: [x[2:] for x in sorted(v, key=lambda x: (x[:2], hashlib.md5(f"{len(x[2])}:{x[2]}{x[3]}".encode()).digest()))] for c, v in of.items()}
    members, ends = {}, {}
    for c, own in of.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        path = tuple(of.get(base, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * words
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], digest(p)) for p, m in members.items()), key=repr)


def found(spark, rows, size=conv.ROWS, partitions=3):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(partitions)
    out = conv.trie(conv.rebuilt(conv.sequences(df)), size)
    out = out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in map(tuple, out.collect())), key=repr)


def talks(seed, n=150, alphabet=3):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randint(1, 6)):
            rows.append((c, t, r.choice(("user", "model")), " ".join(r.choice("ab") for _ in range(r.randint(1, alphabet)))))
    for c in range(n, n + 60):  # equal conversations
        rows += [(c, t, "user", f"same {t}") for t in range(5)]
    rows += [(n + 70, t, "user", f"deep {t // 2}") for t in range(80)]
    rows += [(n + 75, t, "user", f"deep {t // 2}") for t in range(60)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("size", [3, 20, conv.ROWS])
def test_nodes_equal_brute_force(spark, seed, size):
    rows = talks(seed)
    assert found(spark, rows, size) == brute(rows)


def test_defined_cases(spark):
    rows = [(20, None, "user", "first"), (20, 1, None, None), (20, 2, "", ""), (20, 2, "a", "tie"), (20, 2, "b", "tie"), (21, 0, "user", "x"), (21, 0, "user", "x"), (23, 0, "user", "y" * 100_000)]
    rows += [(None, 0, "user", "z"), (47, 0, "user", "no base"), (-3, 0, "user", "minus"), (-20, 0, "user", "minus"), (0, 3, "user", "zero")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, 3) == brute(rows)
    assert found(spark, []) == []


def test_roles_and_texts_are_told_apart(spark):
    rows = [(20 * k, 0, *rt) for k, rt in enumerate([("ab", "c"), ("a", "bc"), ("", "abc"), ("1:a", ""), ("", "1:a")])]
    assert len(found(spark, rows)) == 6


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 8])
def test_merging_runs(n):
    r = random.Random(n)
    turn = lambda: bytes([r.randint(0, 2)]) * conv.TURN
    members = [(b"".join(turn() for _ in range(r.randint(0, 5))), k, [], None) for k in range(40 * n)]
    runs = [conv.Run(members[k::n]) for k in range(n)] + [conv.Run([])]
    out = list(conv.merged(runs))
    assert [m for m, _ in out] == sorted(members)
    for (a, _), (b, lcp) in zip(out, out[1:], strict=False):
        assert lcp == conv.shared_turns(a[0], b[0], 0)


def test_shared_turns_are_not_compared_again(monkeypatch):
    prefix = b"p" * conv.TURN * 1000
    members = [(prefix + bytes([k]) * conv.TURN, k, [], None) for k in range(64)]
    runs = [conv.Run(members[k::8]) for k in range(8)]
    compared = []
    real = conv.shared_turns
    monkeypatch.setattr(conv, "shared_turns", lambda a, b, known: compared.append(real(a, b, known) - known) or real(a, b, known))
    assert len(list(conv.merged(runs))) == 64
    assert sum(compared) <= 7 * 1000  # the first match of each pair alone
