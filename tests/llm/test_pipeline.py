"""The pipeline's stages against brute force on a small corpus with a planted case for each."""

import gc

import numpy as np
import pytest

import corpus_pipeline
from sparkwarden.llm import packing

from .test_neardup import brute
from .test_row_operators import plain_hits, plain_words


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    words = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "m", "l")]
    bench = [(i, " ".join(rng.choice(words, 30))) for i in range(4)]
    docs, labels = [], []
    for i in range(160):
        w = list(rng.choice(words, 60))
        toxic = i % 4 == 1
        if toxic:
            w[10], w[20], w[30] = "zogwart", "vilex", "zogwart"
        if i % 40 == 3:
            w[5:20] = bench[i % 3][1].split()[3:18]
        if i % 40 == 6:
            w[7] = "joe.doe@mail.example and +1 (555) 123-4567"
        docs.append([i, " ".join(w), "en", f"src{i % 3}", 0])
        labels.append((i, 1, int(toxic)))
    for i in range(160, 170):
        near = docs[(i - 160) * 4][1].split()
        near[50] = "changed"
        docs.append([i, " ".join(near), "en", "src0", 0])
    docs += [[170, None, None, None, None], [171, "", "en", "src1", 0], [172, docs[0][1], "en", "src9", 0]]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, bench


def test_stages(spark, sf):
    path, docs, bench = sf
    now = spark.read.parquet(f"{path}/documents.parquet")
    columns = now.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, path)
        assert now.columns == columns
        now = spark.createDataFrame(now.collect(), now.schema)
        kept[name] = {r.doc_id: r.text for r in now.collect()}
    clean = {d[0] for d in docs if "zogwart" not in (d[1] or "")}
    assert set(kept["toxicity"]) == clean
    groups = brute([(i, t) for i, t in kept["toxicity"].items()], 5, 80)
    assert set(kept["near_duplicates"]) == {i for i, (_, c) in groups.items() if i == c}
    free = {i for i, t in kept["near_duplicates"].items() if not plain_hits(plain_words(t), bench)[0]}
    assert set(kept["decontamination"]) == free and len(free) < len(kept["near_duplicates"])
    for i, t in kept["pii"].items():
        before = kept["decontamination"][i]
        assert t == (before and before.replace("joe.doe@mail.example", "<EMAIL>").replace("+1 (555) 123-4567", "<PHONE>"))
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    out = corpus_pipeline.run(spark, path).collect()
    total = {}
    for r in out:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in kept["pii"].items()}


@pytest.mark.parametrize("many", [0, 1])
def test_defined_cases_of_the_stages(spark, sf, tmp_path, many):
    """Empty tables; nulls, repeated rows, unlike texts of one id, clashing columns and a very long text."""
    path, docs, bench = sf
    long = " ".join(f"word{i % 5000}" for i in range(60_000))
    rows = [(4, docs[0][1], None, None, 5, "x", 1), (4, docs[0][1], None, None, 5, "x", 1), (4, docs[4][1], "en", "s", 6, "y", 2), (8, long, "en", "s", 7, "z", 3), (12, None, None, None, None, None, None), (None, docs[8][1], "en", "", 8, "x", 4)]
    now = spark.createDataFrame(rows if many else [], "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, score int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = now.columns
        now = stage(spark, now, path)
        assert now.columns == columns
        now = spark.createDataFrame(now.collect(), now.schema)
    assert sorted((r.doc_id or 0, r.score or 0) for r in now.collect()) == ([(0, 4), (4, 1), (4, 2), (8, 3), (12, 0)] if many else [])
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, path).collect()
    assert len({r.doc_id for r in pieces}) == (4 if many else 0)


def test_the_driver_holds_no_tokenizer(spark):
    df = spark.createDataFrame([(1, "one two", "a"), (2, None, "b"), (3, "three " * 5000, "a")], "doc_id long, text string, source string")
    packing._encoders.clear()
    got = {(r.doc_id, r.start): (r.length, bytes(r.ids)) for r in packing.packed(df).collect()}
    # tasks are processes of their own
    assert not packing._encoders
    for i, text in ((1, "one two"), (2, ""), (3, "three " * 5000)):
        pieces = [got[k] for k in sorted(got) if k[0] == i]
        assert all(len(ids) == 4 * n for n, ids in pieces)
        want = packing.encoder(None).tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(b"".join(ids for _, ids in pieces), "<u4").tolist() == [*want, packing.END_ID]


def test_the_driver_drops_what_is_over(spark, monkeypatch):
    from sparkwarden.llm import common

    monkeypatch.setattr(common, "TABLES", 2)
    jvm = spark.sparkContext._jvm
    held = jvm.java.lang.ref.WeakReference(jvm.java.util.ArrayList())
    gc.collect()
    for i in range(2):
        common.written(spark.range(1), f"some{i}")
    assert held.get() is None
