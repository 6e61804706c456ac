"""Operators that judge or place each row: against plain versions on small tables with the awkward cases."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwarden.llm import decontamination as dec
from sparkwarden.llm import language, licenses, packing, repetition, sharding, toxicity, warc

LONG = " ".join(f"word{i % 977} filler{i}" for i in range(30_000))
TEXTS = [
    (1, "Alpha beta gamma delta. Released under the MIT License.\nAlpha beta gamma delta.", "a"), (2, None, None), (3, "", "a"), (4, LONG, "b"),
    (5, "ÉCOLE naïve 東京 x́y\n\n  \t<|endoftext|> don't 12 345", "a"), (6, "same same same same same same same same", "b"), (6, "same same same same same same same same", "b"),
    (None, "no id here, no id here, no id here", "c"), (8, "!!! ???", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, s, "clash", 0) for i, t, s in TEXTS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, score string, n_words int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, source string, lang string")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_hits(words, items, window=10):
    hit, found = set(), set()
    for item, text in items:
        w = plain_words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for at in range(len(words) - n + 1):
                if words[at : at + n] == w[i : i + n]:
                    hit.update(range(at, at + n))
                    found.add(str(item))
    return hit, sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 120])
def test_decontamination_against_brute_force(spark, block_bytes):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(6)]
    items = [(i, " ".join(rng.choice(vocabulary, n))) for i, n in enumerate([4, 12, 15, 11, 3, 1, 2, 25])] + [(90, None), (91, ""), (92, "!!"), (12, "Zebra, zebra!")]
    texts = [(i, " ".join(rng.choice(vocabulary, 60))) for i in range(20)] + [(20, f"x {items[7][1].upper()} y"), (21, None), (22, ""), (22, ""), (23, items[1][1].replace(" ", "-, "))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id bigint, text string, n_hit string")
    found = dec.contamination(docs, spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=block_bytes)
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in found.collect())
    want = Counter()
    for i, t in texts:
        w = plain_words(t)
        hit, names = plain_hits(w, items)
        want[(i, len(w), len(hit), tuple(names))] += 1
    assert got == want


def test_search_against_plain_windows():
    """Random texts of few words, so that windows overlap, repeat and share their last and first blocks."""
    rng = np.random.default_rng(2)
    words = ["ab", "cd", "ef", "gh"]
    for trial in range(30):
        items = [(str(i), " ".join(rng.choice(words, rng.integers(0, 9)))) for i in range(rng.integers(0, 12))]
        texts = [" ".join(rng.choice([*words, "zz"], rng.integers(0, 60), p=[0.23, 0.23, 0.23, 0.23, 0.08])) for _ in range(8)]
        with pytest.MonkeyPatch.context() as m:
            m.setattr(dec, "PAIRS", 7)
            counts, ranges, found = dec.Patterns([(i, t.encode()) for i, t in items], 5).search([*(t.encode() for t in texts), None])
        for t, n, r, f in zip([*texts, ""], counts, ranges, found, strict=True):
            w, hit, names = t.split(), set(), set()
            for name, x in items:
                v = x.split()
                size = min(5, len(v))
                for k in range(len(v) - size + 1 if v else 0):
                    for at in range(len(w) - size + 1):
                        if w[at : at + size] == v[k : k + size]:
                            names.add(name)
                            hit.update(range(at, at + size))
            assert (n, f) == (len(w), names) and {k for a, b in r for k in range(a, b)} == hit


def test_patterns_are_compact():
    import pickle

    rng = np.random.default_rng(0)
    text = b" ".join(b"w%d" % i for i in rng.integers(0, 20_000, 100_000))
    size = len(pickle.dumps(dec.Patterns([("a", text)])))
    assert size < 8 * len(text)


@pytest.mark.parametrize("block_bytes", [1 << 20, 3000])
def test_decontamination_in_blocks_equals_one(spark, block_bytes):
    rng = np.random.default_rng(1)
    items = [(i, " ".join(f"q{x}" for x in rng.integers(0, 3000, 40))) for i in range(200)]
    docs = [(i, " ".join(f"q{x}" for x in rng.integers(0, 3000, 30)) + " " + (items[i % 200][1] if i % 3 == 0 else "")) for i in range(120)] + [(500, ("x " * 50_000) + items[7][1])]
    found = dec.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=block_bytes)
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in found.collect()}
    assert got == {i: (len(t.split()), 40 if i % 3 == 0 or i == 500 else 0, [str(i % 200)] if i % 3 == 0 and i != 500 else ["7"] if i == 500 else []) for i, t in docs}


def test_decontamination_of_and_by_nothing(docs, none):
    assert dec.contamination(docs, none.select("doc_id", "text"), item="doc_id").where("n_hit > 0").count() == 0
    assert dec.contamination(none, docs, item="doc_id").count() == 0


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards(docs, none):
    rows = sharding.shard_rows(docs.select("doc_id", "text"), shards=4).collect()
    assert len(rows) == len(TEXTS)
    by = {}
    for r in rows:
        key = (r.doc_id or 0) % (1 << 64)
        assert r.shard == plain_jump(key, 4)
        assert r.grown_shard == plain_jump(key, 5) and r.grown_shard in (r.shard, 4)
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shard_rows(none).count() == 0


def test_shards_are_even_and_move_little():
    keys = np.arange(20_000).astype(np.uint64)
    a, b = sharding.jump_hash(keys, 8), sharding.jump_hash(keys, 9)
    assert np.bincount(a).min() > 2300 and ((a == b) | (b == 8)).all() and 0.09 < (a != b).mean() < 0.13


def plain_repetition(text):
    words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
    w = [text[a:b] for a, b in words]
    out = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text or "")}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    out["n_dup_lines"] = len(lines) - len(set(lines))
    for n in (3, 5, 6, 7, 8, 9, 10):
        c = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        inside = {j for i in range(len(w) - n + 1) if c[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        if n == 3:
            out["n_repeat_words"] = len(inside)
        else:
            out[f"dup_chars_{n}"] = sum(len(w[j]) for j in inside)
    for n in (2, 3, 4):
        c = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        out[f"top_chars_{n}"] = max((v * sum(map(len, k)) for k, v in c.items() if v > 1), default=0)
    return out


def test_repetition_against_brute_force(docs, none):
    got = repetition.repetition(docs).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        want = plain_repetition(r.text)
        assert {k: r[k] for k in want} == want
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and not r.reasons)
    assert repetition.repetition(none).count() == 0


@pytest.mark.parametrize("targets", [None, {"a": 0.25, "b": 0.75}])
def test_packing_is_an_exact_round_trip(docs, none, targets):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.packed(docs, length=256, targets=targets).collect()
    want = sorted((str(i), t.encode(x or "", add_special_tokens=False).ids + [1]) for i, x, _ in TEXTS)
    pieces = {}
    for r in rows:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    total = sum(len(ids) for _, ids in want)
    assert sum(r.length for r in rows) == total
    got = []
    for (doc, n), p in pieces.items():
        if doc == 6:
            continue
        p.sort(key=lambda r: r.start)
        assert [r.start for r in p] == list(np.cumsum([0, *(r.length for r in p)])[:-1])
        got.append((str(doc), [x for r in p for x in np.frombuffer(r.ids, "<u4").tolist()]))
        assert len(got[-1][1]) == n
    assert sorted(got) == [x for x in want if x[0] != "6"]
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(windows) == list(range(-(-total // 256)))
    for w, p in windows.items():
        p.sort()
        assert [o for o, _ in p] == list(np.cumsum([0, *(k for _, k in p)])[:-1])
        assert sum(k for _, k in p) == (256 if w < total // 256 else total % 256)
    assert packing.packed(none).count() == 0


def plain_round_robin(full, weights):
    """Served queues, by deficits that grow with what any queue serves: the one due first, at half a quantum, serves."""
    from fractions import Fraction

    served = dict.fromkeys(full, 0)
    out = []
    while any(served[q] < full[q] for q in full):
        q = min((q for q in sorted(full) if served[q] < full[q]), key=lambda q: (Fraction(2 * served[q] + 1, 2 * weights[q]), q))
        served[q] += 1
        out.append(q)
    return out


@pytest.mark.parametrize("targets", [None, {"a": 0.2, "b": 0.7, "c": 0.1}])
def test_packing_serves_quanta_by_deficits(targets):
    totals = {"a": 40_003, "b": 13_333, "c": 2_801, "d": 300, "e": 1}
    s = packing.Schedule(totals, targets, length=512, quantum=64)
    spots, order = [], {}
    for q, n in totals.items():
        row, window, offset, length = s.pieces(np.array([s.index[q]]), np.array([0]), np.array([n]))
        assert length.sum() == n and not row.any()
        spots += zip((window * 512 + offset).tolist(), length.tolist(), strict=True)
        k = np.arange(n // 64)
        order.update(zip(s.place(np.full(len(k), s.index[q]), k).tolist(), [q] * len(k), strict=True))
    spots.sort()
    assert [x for x, _ in spots] == list(np.cumsum([0, *(n for _, n in spots)])[:-1])
    got = [order[i] for i in range(len(order))]
    first = [q for q in totals if not targets or q in targets]
    weights = {q: int(s.weight[s.index[q]]) for q in totals}
    want = plain_round_robin({q: totals[q] // 64 for q in first}, weights)
    want += plain_round_robin({q: totals[q] // 64 for q in totals if q not in first}, weights)
    assert got == want
    # while all have tokens, no queue is two quanta off its share at any place
    share = {q: weights[q] / sum(weights[x] for x in first) for q in first}
    until = min(max(i for i, x in enumerate(got) if x == q) for q in first if q in "abc")
    for q in first:
        ahead = np.cumsum([x == q for x in got[:until]]) - share[q] * np.arange(1, until + 1)
        assert np.abs(ahead).max() < 2


def test_packing_gives_small_sources_their_share(spark):
    many = [(k, "word " * 299, f"s{k // 10}") for k in range(4000)]  # 400 equal sources of 3000 tokens
    got = packing.packed(spark.createDataFrame(many, "doc_id bigint, text string, source string")).collect()
    sources = {}
    for r in got:
        sources.setdefault(r.sequence_id, set()).add(r.doc_id // 10)
    # a window has eight quanta, so fifty windows serve all queues once
    for w in range(0, max(sources) - 100, 50):
        assert len(set().union(*(sources[x] for x in range(w, w + 50)))) == 400
    assert len(got) <= 4000 * (300 / packing.QUANTUM + 1.2)
    # sources of less than their part share a queue, and are spread over it, each token once
    with pytest.MonkeyPatch.context() as m:
        m.setattr(packing, "SHARES", 256)
        rows = packing.packed(spark.createDataFrame(many, "doc_id bigint, text string, source string"), length=256).collect()
    spots = sorted((r.sequence_id * 256 + r.offset, r.length) for r in rows)
    assert [a for a, _ in spots] == list(np.cumsum([0, *(n for _, n in spots)])[:-1])
    early = {r.doc_id // 10 for r in rows if r.sequence_id <= max(x.sequence_id for x in rows) // 5}
    assert len(early) == 400


def test_packing_keeps_targets_of_small_sources(spark):
    rows = [(k, "word " * 99, "a") for k in range(600)] + [(9000, "word " * 9000, "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    first = [r for r in packing.packed(df, targets={"a": 0.5, "b": 0.5}).collect() if r.sequence_id == 0]
    assert sum(r.length for r in first if r.doc_id == 9000) == 1024
    assert packing.packed(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), length=1000).where("offset + length > 1000").count() == 0
    with pytest.raises(ValueError, match="without tokens"):
        packing.packed(df, targets={"a": 0.5, "c": 0.5})


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>é</p>\r\n\r\nWARC/1.1\r\n\r\n", "", None, "<p>é</p>\r\n\r\nWARC/1.1\r\n\r\n", "x" * 300_000, "y"]
    pages = spark.createDataFrame([(i, None if i == 3 else f"http://a/{i}", h, "z") for i, h in enumerate(html)] + [(5, "http://a/5", "y", "z")], "page_id bigint, url string, html string, record_type string")
    rows = warc.deduplicate_archives(pages, str(tmp_path / "w"), with_payload=True).collect()
    assert len(rows) == 7
    import base64

    for r in rows:
        data = (html[r.page_id] or "").encode()
        assert r.payload_bytes == len(data)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        if r.record_type == "response":
            assert r.payload == data and r.refers_to is None
    assert {r.page_id: r.refers_to for r in rows if r.record_type == "revisit"} == {0: 3, 1: 2}
    empty = warc.deduplicate_archives(pages.limit(0), str(tmp_path / "e"))
    assert empty.count() == 0


@pytest.mark.parametrize("broadcast", [0, 500_000])
def test_warc_of_large_payloads_and_groups(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "REVISITS", broadcast)
    monkeypatch.setattr(warc, "FILE_BYTES", 4 << 20)
    big = ["é" * 1_300_000, "<p>\r\n\r\n</p>" * 200_000]
    html = [big[i % 2] if i % 40 == 0 else "hot" if i % 3 else f"own {i}" for i in range(200)]
    pages = spark.createDataFrame([(i, f"http://a/{i}", h) for i, h in enumerate(html)], "page_id bigint, url string, html string")
    path = str(tmp_path / "w")
    rows = {r.page_id: r for r in warc.deduplicate_archives(pages, path, with_payload=True).collect()}
    kept = {h: i for i, h in enumerate(html)}
    for i, h in enumerate(html):
        assert rows[i].payload_bytes == len(h.encode()) and (rows[i].refers_to or i) == kept[h]
        assert (rows[i].payload == h.encode()) if kept[h] == i else rows[i].payload is None
    import os

    large = [f for f in os.listdir(f"{path}/large") if f.startswith("part-")]
    assert 2 <= len(large) and os.listdir(f"{path}/records")


def test_warc_files_of_many_members_are_read_as_streams():
    import gzip

    def record(k, payload):
        http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        return b"WARC/1.1\r\nWARC-Type: response\r\nX-Page: %d\r\nContent-Length: %d\r\n\r\n" % (k, len(http)) + http + b"\r\n\r\n"

    payloads = [b"", b"\r\n\r\nWARC/1.1\r\n", bytes(range(256)) * 9000, b"z"]
    plain = b"".join(record(k, p) for k, p in enumerate(payloads))
    members = b"".join(gzip.compress(record(k, p)) for k, p in enumerate(payloads))
    for data in (plain, gzip.compress(plain), members):
        assert [(h["X-Page"], p) for h, _, p in warc.parsed(data)] == [(str(k), p) for k, p in enumerate(payloads)]
    for bad in (plain[:-10], plain[5:]):
        with pytest.raises(ValueError):
            list(warc.parsed(bad))
    assert list(warc.parsed(b"")) == list(warc.parsed(gzip.compress(b""))) == []


def test_licenses(docs, none, spark):
    got = licenses.recognised(docs).collect()
    assert len(got) == len(TEXTS)
    assert [(r.sentence_ids, r.licenses) for r in got if r.doc_id == 1] == [(["mit_ref"], ["MIT"])]
    assert all(r.n_known == 0 and r.licenses == [] for r in got if r.doc_id != 1)
    s = licenses.SENTENCES
    both = ".\n".join([s["bsd_grant"], s["bsd_source"], "Other words", s["bsd_binary"], s["bsd_names"], s["cc_by4"]])
    r = licenses.recognised(spark.createDataFrame([(both,)], "text string")).first()
    assert r.rules == ["bsd3", "cc_by"] and r.licenses == ["BSD-3-Clause", "CC-BY-4.0"] and r.n_sentences == 6
    assert licenses.recognised(none).count() == 0


NOTICES = {
    "mit_text": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.""",
    "bsd3": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.""",
    "gpl3_notice": """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.""",
    "apache2_notice": """ * Licensed under the Apache License, Version 2.0 (the "License"); you may
 * not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "mpl2": """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */""",
}


def test_wrapped_licence_notices(spark):
    df = spark.createDataFrame(list(NOTICES.items()), "name string, text string")
    assert {r.name: r.rules for r in licenses.recognised(df).collect()} == {k: [k] for k in NOTICES}


def test_language(spark, none):
    rng = np.random.default_rng(0)
    stems = {"aa": ["kala", "miro", "tuso", "velan"], "bb": ["grüx", "shrod", "ynth", "wock"]}
    rows = [(i, " ".join(rng.choice(stems[x]) + rng.choice(["", "in", "or"]) for _ in range(30)), x) for i, x in enumerate(["aa", "bb"] * 60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fitted(df.where("doc_id % 5 <> 0"))
    more = spark.createDataFrame([(900, None, "x"), (901, "12 !? 3", "x"), (902, "KALA miro" + " tuso" * 40_000, "x")], "doc_id bigint, text string, score string")
    got = {r.doc_id: r for r in language.identified(df.drop("lang").unionByName(more, allowMissingColumns=True), model).collect()}
    held = [i for i, _, x in rows if i % 5 == 0 and got[i].lang_pred == x]
    assert len(held) >= 23
    assert (got[900].lang_pred, got[901].lang_pred, got[902].lang_pred) == ("und", "und", "aa") and got[900].score == 0
    assert language.identified(none.drop("lang"), model).count() == 0
    assert {r.lang_pred for r in language.identified(df, language.fitted(none)).collect()} == {"und"}


def test_rare_toxic_words_are_cues():
    toxic = [{b"word%d" % i, b"vilexin" if i < 6 else b"zogwart"} for i in range(1200)]  # 0.5 % hold the rare word
    found = toxicity.cues(toxic, ({b"word%d" % i} for i in range(1200)))
    assert not found.isdisjoint(toxicity.features(b"vilexin"))


def test_toxicity(spark, none):
    rng = np.random.default_rng(0)
    words = [a + b + c for a in "bdfgkl" for b in "aeiou" for c in ("n", "r", "st", "m")]
    rows = []
    for i in range(400):
        w = list(rng.choice(words, 40))
        if i % 4 == 0:
            for k in rng.choice(40, 3, replace=False):
                w[k] = rng.choice(["zogwart", "zogwarty", "Vilex"])
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.fitted(df.select("doc_id", "text"), df.where("doc_id % 5 <> 0").select("doc_id", "toxic"))
    more = spark.createDataFrame([(900, None), (901, ""), (902, "bar " * 50_000 + "\nbon zogwart!")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in toxicity.scored(df.select("doc_id", "text").unionByName(more), model).collect()}
    assert sum(got[i].predicted != y for i, _, y in rows if i % 5 == 0) <= 1
    assert all(0 <= r.score <= 1 for r in got.values()) and got[900].score == got[901].score < 0.5
    spans = got[902].toxic_spans
    assert [(s.start, s.end) for s in spans] == [(200_005, 200_012)]
    assert toxicity.scored(none.select("doc_id", "text"), model).count() == 0
    assert {r.score for r in toxicity.scored(df.select("doc_id", "text"), toxicity.fitted(none, df.select("doc_id", "toxic"))).collect()} == {0.0}


def test_chain_marginals_are_exact():
    rng = np.random.default_rng(2)
    trans, start = rng.normal(size=(2, 2)), 0.3
    for n in (1, 2, 5):
        e = rng.normal(size=n)
        weight = {}
        for code in range(1 << n):
            y = [code >> i & 1 for i in range(n)]
            weight[code] = np.exp(sum(e[i] * y[i] for i in range(n)) + start * y[0] + sum(trans[y[i], y[i + 1]] for i in range(n - 1)))
        want = [np.log(sum(v for c, v in weight.items() if c >> i & 1) / sum(v for c, v in weight.items() if not c >> i & 1)) for i in range(n)]
        if n > 1:
            fwd, bwd = toxicity.messages(e, np.array([n]), trans, start)
            got = toxicity.pairs(e, fwd, bwd, np.arange(1, n), trans)
            total = sum(weight.values())
            for k, (a, b) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
                assert np.allclose(got[k], [sum(v for c, v in weight.items() if (c >> i - 1 & 1, c >> i & 1) == (a, b)) / total for i in range(1, n)])
        assert np.allclose(toxicity.marginals(np.concatenate((e, [9.0])), np.array([n, 1]), trans, start)[:n], want)


def test_crc32_of_pieces():
    assert zlib.crc32(np.array([1], "<u4").tobytes()) == zlib.crc32(b"\x01\x00\x00\x00")


def test_words_and_tails_encode_as_the_whole_text():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    e = packing.Encoder()
    pieces = ["Word,", "don't", "it's!!", "É!", "…!!", "€..", "naïve)", "≠", "a≠", "x́,", "12.", "３,", "ª.", "<|endoftext|>", "<|EndOfText|>", "A<|startoftext|>b.", "İ.", "ΑΣ,", "%%%", "co-op,", " x,", "ﬁ.", "ⅷ!", "#", "東京、,"]
    rng = np.random.default_rng(0)
    for _ in range(300):
        text = "".join(rng.choice(pieces) + rng.choice([" ", "\n", "  ", "\t"]) for _ in range(8))
        assert np.frombuffer(e([text.encode()])[0], e.kind).tolist() == [*t.encode(text, add_special_tokens=False).ids, 1], text
    import pyarrow as pa

    texts = ["é " * 40 + "Übung", None, "東京 a", "", "naïve <|endoftext|> É", "x" * 9000 + "é", "last Ñ"]
    want = [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]
    for kind in (pa.string(), pa.large_string()):
        for i in range(len(texts)):
            got = e(pa.array(texts, kind).slice(i))
            assert [np.frombuffer(x, e.kind).tolist() for x in got] == want[i:]


def test_gradients_of_tiny_chains():
    """Training's gradients against differences of the likelihood, summed over all state sequences."""
    import itertools

    rng = np.random.default_rng(4)
    lengths = np.array([1, 2, 4])
    gold = rng.integers(0, 2, 7).astype(float)
    e, trans, start = rng.normal(size=7), rng.normal(size=(2, 2)), 0.3

    def likelihood(e, trans, start):
        total, at = 0.0, 0
        for n in lengths:
            def score(y, at=at, n=n):
                return start * y[0] + sum(e[at + k] * y[k] for k in range(n)) + sum(trans[y[k - 1], y[k]] for k in range(1, n))
            total += score([int(x) for x in gold[at : at + n]]) - np.log(sum(np.exp(score(y)) for y in itertools.product((0, 1), repeat=int(n))))
            at += n
        return total

    fwd, bwd = toxicity.messages(e, lengths, trans, start)
    got_trans, got_start = toxicity.chain_gradient(gold, e, fwd, bwd, lengths, trans)
    got_e = gold - 1 / (1 + np.exp(-(fwd + bwd)))
    d = 1e-6
    for i in range(7):
        step = np.eye(7)[i] * d
        assert np.isclose(got_e[i], (likelihood(e + step, trans, start) - likelihood(e - step, trans, start)) / (2 * d), atol=1e-5)
    for i in range(2):
        for k in range(2):
            step = np.zeros((2, 2))
            step[i, k] = d
            assert np.isclose(got_trans[i, k], (likelihood(e, trans + step, start) - likelihood(e, trans - step, start)) / (2 * d), atol=1e-5)
    assert np.isclose(got_start, (likelihood(e, trans, start + d) - likelihood(e, trans, start - d)) / (2 * d), atol=1e-5)
    own, before, after, n = toxicity.placed([np.array([3]), np.array([4, 5])], 9)
    assert (own.tolist(), before.tolist(), after.tolist(), n.tolist()) == ([3, 4, 5], [9, 9, 4], [9, 5, 9], [1, 2])


def test_labels_that_are_none(spark):
    marks = [(1, 1), (1, 1), (2, 0), (100, 0), (100, 1), (101, 7), (None, 1), (3, 1), (3, None), (4, None)]
    got = toxicity.labelled(spark.createDataFrame(marks, "doc_id bigint, toxic int")).collect()
    assert sorted((r.k, r.y) for r in got) == [(1, 1), (2, 0), (3, 1)]


def test_language_features_and_scores_against_plain_loops():
    words = [b"the", b"caf\xc3\xa9", b"a", b"\xc3\x9cber", b"abcdefgh"]
    grams, counts = language.ngrams(words)
    ends = np.cumsum(counts)
    table = {}
    for w, a, b in zip(words, ends - counts, ends, strict=True):
        low = b" " + w.decode().lower().encode() + b" "
        want = []
        for n in range(1, 6):
            for i in range(len(low) - n + 1):
                g = low[i : i + n]
                if g != b" ":
                    code = 0
                    for x in g:
                        code = (code * 257 + x + 1) % (1 << 64)
                    want.append(((code + n) * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - language.BITS))
        # a space is with the word after it, and runs of five bytes may hold spaces at their ends only
        table[w] = sorted(want)
        assert sorted(grams[a:b].tolist()) == table[w]
    model = language.LanguageModel([(b"the cat and the dog " * 5, "en"), (b"der hund und die katze " * 5, "de")] * 10)
    names, score, low = language.Predictor(model)([b"the caf\xc3\xa9", b"\xc3\x9cber a", None, b"12 34"])
    for k, text in enumerate(([b"the", b"caf\xc3\xa9"], [b"\xc3\x9cber", b"a"])):
        every = [g for w in text for g in table[w]]
        x = (np.mean([model.table[g] for g in every], axis=0) + model.bias) / model.temperature
        p = np.exp(x - x.max()) / np.exp(x - x.max()).sum()
        assert names[k] == model.languages[int(p.argmax())] and np.isclose(score[k], p.max(), atol=1e-5)
    assert names[2:] == ["und", "und"] and score[2:].tolist() == [0.0, 0.0]


UNEDITED = {
    "MIT": """Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

You should have received a copy of the GNU General Public License along with this program.  If not, see <https://www.gnu.org/licenses/>.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:""",
}


def test_unedited_notices_at_any_width(spark):
    import textwrap

    rows = []
    for name, text in UNEDITED.items():
        for width in (10_000, 78, 60, 33):
            wrapped = "\n\n".join(textwrap.fill(p, width) for p in text.split("\n\n"))
            rows += [(f"{name} {width}", wrapped), (f"{name} {width} c", "\n".join(("# " + x).rstrip() for x in wrapped.split("\n")))]
    got = {r.name: r.licenses for r in licenses.recognised(spark.createDataFrame(rows, "name string, text string")).collect()}
    assert {k: v for k, v in got.items() if v != [k.split()[0]]} == {}


def test_words_of_long_texts_are_hashed_in_chunks(monkeypatch):
    from sparkwarden.llm import common

    rng = np.random.default_rng(3)
    texts = [b" ".join(bytes(rng.integers(97, 101, rng.integers(1, 9)).astype(np.uint8)) for _ in range(300)) for _ in range(6)] + [None, b"", b"x" * 700, b" \t" * 200 + b"end", b"a"]
    whole = common.words_hashed(texts)
    for chunk in (1, 7, 64, 500):
        monkeypatch.setattr(common, "CHUNK", chunk)
        assert all((a == b).all() for a, b in zip(whole, common.words_hashed(texts), strict=True))
    words = [w for t in texts for w in (t or b"").split()]
    assert [bytes(whole[0][a:b]) for a, b in zip(whole[1], whole[2], strict=True)] == words
    assert len(set(whole[3].tolist())) == len(set(words))


def test_columns_named_like_outputs(spark):
    """Nulls in every column, repeated rows, and input columns with the names of what an operator adds."""
    rows = [(1, "This project is licensed under the MIT License.", "s", "old", "old"), (1, "This project is licensed under the MIT License.", "s", "old", "old"), (2, None, None, None, None), (None, "", None, "old", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, shard string, licenses string")
    found = licenses.recognised(df)
    assert found.columns.count("licenses") == 1 and sorted(map(str, (r.licenses for r in found.collect()))) == ["['MIT']", "['MIT']", "[]", "[]"]
    placed = sharding.shard_rows(df.withColumn("slot", F.lit("x")))
    assert placed.columns.count("shard") == placed.columns.count("slot") == 1 and placed.count() == 4 and dict(placed.dtypes)["shard"] == "int"
    clash = df.withColumnsRenamed({"shard": "offset", "licenses": "sequence_id"}).withColumn("ids", F.lit(1)).withColumn("queue", F.lit(None).cast("string"))
    pieces = packing.packed(clash).collect()
    assert len(pieces) == 4 and sorted(r.doc_tokens for r in pieces)[:2] == [1, 1]
    named = language.identified(df.withColumn("score", F.lit("x")), language.LanguageModel([]))
    assert {(r.lang_pred, r.score) for r in named.collect()} == {("und", 0.0)}
