"""Benchmark items beyond a block, and tokenizers of other kinds."""

import json
import os
import random

import pytest

from sparkwarden.llm import decontamination as D
from sparkwarden.llm import packing


@pytest.mark.parametrize("seed", range(4))
def test_runs_hold_every_window_once_cut(seed):
    r = random.Random(seed)
    for n in (0, 1, 9, 10, 11, 200):
        words = [b"w" * r.choice((1, 3, 40)) + b"%d" % r.randint(0, 99) for _ in range(n)]
        text = b"".join(w + r.choice((b" ", b", ", b"\n\n")) for w in words) + b" " * r.randint(0, 30)
        for most in (5, 60, 400):
            parts = [D.words_of(p) for p in D.runs(text, most, 10)]
            windows = lambda w: {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
            assert set().union(*map(windows, parts)) == windows(D.words_of(text))


def test_an_item_of_many_blocks(spark):
    r = random.Random(9)
    word = lambda: f"w{r.randint(0, 9999)}"
    item = [word() for _ in range(3000)]
    docs = [(i, " ".join([word() for _ in range(20)] + item[a : a + n] + [word() for _ in range(20)])) for i, (a, n) in enumerate([(0, 10), (1500, 9), (777, 300), (2990, 10), (100, 2800), (0, 0)])]
    df, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("big", " ".join(item)), ("small", "one two three"), ("none", "")], "item_id string, text string")
    got = {}
    for size in (D.BLOCK_BYTES, 6000, 700):
        out = D.contamination(df, items, block_bytes=size).select("doc_id", "n_words", "n_hit", "hit_ranges", "items").collect()
        got[size] = sorted((x.doc_id, x.n_words, x.n_hit, [tuple(y) for y in x.hit_ranges], x["items"]) for x in out)
    assert got[6000] == got[D.BLOCK_BYTES] == got[700]
    assert [x[2] for x in got[700]] == [10, 0, 300, 10, 2800, 0]


def made(tmp_path, name, change):
    with open(packing.default_tokenizer(), encoding="utf-8") as f:
        d = json.load(f)
    change(d)
    path = os.path.join(tmp_path, name)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(d, f)
    return path


TEXTS = ["Hello, World! don't\tstop  <|endoftext|> naïve Ünder 東京 x123y", "", None, "a\n\nB  c", "é" * 50, "U.S.A. e-mail@x.org 12,5"]


def changes():
    from tokenizers import Tokenizer

    def word_level(d):
        d.clear()
        from tokenizers import models, pre_tokenizers

        t = Tokenizer(models.WordLevel({"a": 0, "Hello": 1, ",": 2, "?": 3}, unk_token="?"))
        t.pre_tokenizer = pre_tokenizers.Whitespace()
        d |= json.loads(t.to_str())

    return {
        "cased": lambda d: d.update(normalizer=None), "without white space rule": lambda d: d["normalizer"]["normalizers"].pop(1), "prefix space": lambda d: d["pre_tokenizer"]["pretokenizers"][1].update(add_prefix_space=True),
        "no split": lambda d: d.update(pre_tokenizer=d["pre_tokenizer"]["pretokenizers"][1]), "word level": word_level, "added word": lambda d: d["added_tokens"].append(d["added_tokens"][0] | {"id": 49408, "content": "World", "special": False}),
    }


@pytest.mark.parametrize("name", changes())
def test_other_tokenizers_get_whole_texts(tmp_path, name):
    from tokenizers import Tokenizer

    path = made(tmp_path, "t.json", changes()[name])
    encode, plain = packing.Encoder(path), Tokenizer.from_file(path)
    assert not encode.apart
    import numpy as np

    for text, ids in zip(TEXTS, encode([t.encode() if t is not None else None for t in TEXTS]), strict=True):
        assert np.frombuffer(ids, encode.kind).tolist() == [*plain.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def test_other_public_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(TEXTS * 5)], "doc_id long, text string, source string")
    plain = Tokenizer.from_file(path)
    got = {}
    for p in packing.packed(df, tokenizer=path, length=16).collect():
        got.setdefault(p.doc_id, {})[p.start] = p.ids
    import numpy as np

    for i, t in enumerate(TEXTS * 5):
        assert np.frombuffer(b"".join(x for _, x in sorted(got[i].items())), "<u4").tolist() == [*plain.encode(t or "", add_special_tokens=False).ids, packing.END_ID]


def test_the_default_tokenizer_is_cut():
    assert packing.Encoder().apart and packing.Encoder().direct
