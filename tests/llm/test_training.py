"""Training samples of the two classifiers: long texts, and any number of labels."""

import random

from pyspark.sql import functions as F

from sparkwarden.llm import common, language, toxicity

WORDS = {"en": "the cat and dog ran over that house with them", "de": "der hund und die katze liefen über das haus mit ihnen"}


def long_text(r, words, marks=(), size=22_000):
    out = []
    while sum(map(len, out)) + len(out) < size:
        out += [" ".join(r.choice(words) for _ in range(12)) + "\n"]
    for m in marks:
        for _ in range(200):
            out.insert(r.randrange(len(out)), f"{m} ")
    return "".join(out)


def test_excerpts_are_bounded_and_whole_words(spark):
    texts = ["a b", "x" * 100, " ".join(f"w{k}" for k in range(5000)), "字" * 3000, "ab\n" * 900, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", common.excerpt(F.col("t"), 1600).alias("e"))
    got = {r.t: r.e for r in df.collect()}
    assert all(got[t] == t for t in texts if len(t.encode()) <= 1600)
    assert all(len(e) <= 1616 for e in got.values())
    assert set(got[texts[2]].split()) < set(texts[2].split()) and max(int(w[1:]) for w in got[texts[2]].split()) > 4600
    assert len(got[texts[3]]) > 1000


def test_toxicity_is_learned_from_long_texts(spark):
    r = random.Random(1)
    plain = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    rows = [(i, long_text(r, plain, ["vilexin"] if i % 2 else []), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fitted(df.select("doc_id", "text"), df.where("doc_id < 40").select("doc_id", "toxic"))
    got = {x.doc_id: x.predicted for x in toxicity.scored(df.select("doc_id", "text"), model).collect()}
    assert all(got[i] == y for i, _, y in rows)


def test_labels_of_unusable_rows_do_not_fill_the_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TOXIC_ROWS", 20)
    monkeypatch.setattr(toxicity, "CLEAN_ROWS", 20)
    rows = [(i, f"some plain words {'vilexin' if i % 2 else 'here'} and more {i}", i % 2) for i in range(60)] + [(100 + i, None, i % 2) for i in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fitted(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert model.constant is None and any("vilexin" in c for c in model.cues)


def test_languages_are_learned_from_long_texts(spark):
    r = random.Random(2)
    rows = [(i, long_text(r, WORDS[x].split(), size=30_000), x) for i in range(20) for x in WORDS]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identified(spark.createDataFrame([("en", "the dog ran over the house"), ("de", "die katze und der hund")], "lang string, text string"), language.fitted(df)).collect()
    assert all(x.lang == x.lang_pred for x in got)


def test_any_number_of_labels(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 40)
    monkeypatch.setattr(language, "TRAINING_ROWS", 8000)
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(WORDS[x].split()) for _ in range(30)), x) for i in range(200) for x in WORDS]
    rows += [(1000 + i, " ".join(r.choice("qwrtzpsdfg") * 3 for _ in range(20)), f"dirty{i}") for i in range(3000)]
    model = language.fitted(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 40 and model.out is not None and model.table.shape == (language.BUCKETS, language.DIM)
    names, _, _ = language.Predictor(model)([b"the cat and the dog ran over that house", b"der hund und die katze liefen"])
    assert names == ["en", "de"]
