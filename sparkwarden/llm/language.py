"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the mean of the embeddings of its words' n-grams (of UTF-8 bytes); embeddings and softmax are trained by
stochastic gradient descent in numpy, on snippets of a bounded sample. A temperature fitted on a part of the
sample calibrates the probabilities, and a threshold on them rejects texts like no learned language.

After training, a word is a sum of its n-grams' rows, kept by word: of their parts in every logit where languages are few, of
their embeddings otherwise, so memory does not follow the number of labels. One task trains; of a column with any number of
labels, the MOST_LANGUAGES most frequent ones are learned, from TRAINING_ROWS rows in all.

Defined cases: a null text or one without a letter is `und` with score 0; so is every text if no row has a
label; of equally likely languages the first by name is taken, and of equally frequent labels too; labelled texts of any length are learned from; repeated rows get equal results; very long texts are read
whole; an empty table gives no rows; input columns named like an output are replaced.
"""

from __future__ import annotations

import pickle
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import excerpt, fold, released, slices, table

#: Training rows for each language, and in all, at most (the bounds of the sample; one for each language at least), languages at most,
#: and bytes of text a training row may have; of longer texts, pieces from all over them are taken.
PER_LANGUAGE, TRAINING_ROWS, MOST_LANGUAGES, ROW_BYTES = 300, 6000, 1000, 20_000
#: Snippets of a training row, of shuffled words, and words of a snippet, at most.
SNIPPETS, SNIPPET_WORDS = 6, 24
BITS, DIM, EPOCHS = 15, 16, 6
BUCKETS = 1 << BITS
#: Part of correct calibration snippets that the rejection threshold keeps.
KEPT_SHARE = 0.995
_WORDS_KEPT = 300_000

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_LETTERS).split() if text else []


def ngrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' n-grams of 1 to 5 bytes, a space at each end of a word, and how many each word has."""
    low = [w if w.isascii() else w.decode("utf-8", "ignore").lower().encode() for w in words]
    buf = np.frombuffer(b" " + b" ".join(low) + b" ", np.uint8)
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    ends = np.cumsum(sizes + 1)
    inner = np.cumsum(buf == 32) - 1  # word that a byte is in; a space is with the word after it
    gap = buf == 32
    grams, owners = [], []
    code = np.zeros(len(buf), np.uint64)
    for n in range(1, 6):
        m = len(buf) - n + 1
        if m <= 0:
            break
        code = code[:m] * np.uint64(257) + buf[n - 1 :].astype(np.uint64) + np.uint64(1)
        ok = ~gap[:m] if n == 1 else np.ones(m, bool)
        for k in range(1, n - 1):
            ok &= ~gap[k : k + m]
        if n == 2:
            ok &= ~(gap[:m] & gap[1 : 1 + m])
        if n > 1:
            ok[ends[-1] :] = False
        at = np.flatnonzero(ok)
        h = (code[at] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        grams.append((h >> np.uint64(64 - BITS)).astype(np.int64))
        owners.append(inner[at])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(grams)[order], np.bincount(owner, minlength=len(low))


class LanguageModel:
    """languages, table (bucket -> logit parts, or embeddings if languages are more than DIM), out, bias, temperature, threshold."""

    def __init__(self, rows: list[tuple[bytes, str]], seed: int = 7):
        self.languages = sorted({lang for _, lang in rows})
        self.temperature, self.threshold = 1.0, 0.0
        k = len(self.languages)
        self.table, self.out, self.bias = np.zeros((BUCKETS, min(k, DIM)), np.float32), None, np.zeros(k, np.float32)
        if k:
            self._fit(rows, random.Random(seed), np.random.default_rng(seed))

    def _fit(self, rows: list[tuple[bytes, str]], rng: random.Random, nrng: np.random.Generator) -> None:
        distinct = sorted({w for text, _ in rows for w in words_of(text)})
        grams, counts = ngrams(distinct) if distinct else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        known = dict(zip(distinct, np.split(grams, np.cumsum(counts)[:-1]), strict=True)) if distinct else {}
        snippets: list[tuple[np.ndarray, int]] = []
        number = {lang: i for i, lang in enumerate(self.languages)}
        for text, lang in rows:
            words = words_of(text)
            rng.shuffle(words)
            y = number[lang]
            for i in range(0, min(len(words), SNIPPETS * SNIPPET_WORDS), SNIPPET_WORDS):
                size = rng.choice((3, 6, 12, SNIPPET_WORDS))
                snippets.append((np.concatenate([known[w] for w in words[i : i + size]]), y))
        rng.shuffle(snippets)
        if not snippets:
            return
        held = snippets[: len(snippets) // 6]
        train = snippets[len(held) :] or snippets
        k = len(self.languages)
        emb = (nrng.random((BUCKETS, DIM)) - 0.5).astype(np.float32) / DIM
        out, bias = np.zeros((DIM, k), np.float32), np.zeros(k, np.float32)
        steps = EPOCHS * -(-len(train) // 32)
        step = 0
        for _ in range(EPOCHS):
            rng.shuffle(train)
            for i in range(0, len(train), 32):
                batch = train[i : i + 32]
                rate = 2.0 * (1 - step / steps)
                step += 1
                sizes = np.array([len(g) for g, _ in batch])
                ids, owner = np.concatenate([g for g, _ in batch]), np.repeat(np.arange(len(batch)), sizes)
                mean = np.add.reduceat(emb[ids], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
                p = _softmax(mean @ out + bias)
                p[np.arange(len(batch)), [y for _, y in batch]] -= 1
                p = (p / len(batch)).astype(np.float32)
                back = (p @ out.T) / sizes[:, None]
                out -= rate * (mean.T @ p).astype(np.float32)
                bias -= rate * p.sum(0)
                np.add.at(emb, ids, -(rate * len(batch)) * back[owner].astype(np.float32))
        self.table, self.out, self.bias = ((emb @ out).astype(np.float32), None, bias) if k <= DIM else (emb, out, bias)
        self._calibrate(held or train)

    def logits(self, means: np.ndarray) -> np.ndarray:
        """Logits of mean rows of the table."""
        return (means if self.out is None else means @ self.out) + self.bias

    def _calibrate(self, held: list[tuple[np.ndarray, int]]) -> None:
        logits = self.logits(np.array([self.table[g].mean(0) for g, _ in held]))
        y = np.array([y for _, y in held])
        fits = []
        for t in np.geomspace(0.2, 5, 25):
            p = _softmax(logits / t)
            fits.append((-np.log(p[np.arange(len(y)), y] + 1e-9).mean(), t))
        self.temperature = float(min(fits)[1])
        p = _softmax(logits / self.temperature)
        right = p.max(1)[p.argmax(1) == y]
        self.threshold = float(np.quantile(right, 1 - KEPT_SHARE)) if len(right) else 0.0


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class _Words(dict):
    """word -> row of parts; the last row entry counts n-grams."""

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model, self.rows = model, np.zeros((0, model.table.shape[1] + 1))

    def learn(self, words: list[bytes]) -> None:
        for i in range(0, len(words), 1 << 13):
            part = words[i : i + (1 << 13)]
            grams, counts = ngrams(part)
            new = np.column_stack((np.add.reduceat(self.model.table[grams], np.cumsum(counts) - counts, axis=0), counts))
            self.update(zip(part, range(len(self), len(self) + len(part)), strict=True))
            if len(self) > len(self.rows):
                self.rows = np.concatenate((self.rows, np.zeros((max(4096, len(self)), self.rows.shape[1]))))
            self.rows[len(self) - len(part) : len(self)] = new


def has_letter(text: bytes | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "ignore"))))


class Predictor:
    def __init__(self, model: LanguageModel):
        self.model, self.words = model, _Words(model)

    def __call__(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language or und, probability, and whether it is too low to be trusted."""
        m = self.model
        sums = np.zeros((len(texts), m.table.shape[1] + 1))
        seen = np.fromiter(map(has_letter, texts), bool, len(texts))
        split = [words_of(t) for t in texts]
        if len(self.words) > _WORDS_KEPT:
            self.words = _Words(m)
        if m.languages:
            self.words.learn(list(set().union(*split) - self.words.keys()))
        get, rows = self.words.__getitem__, self.words.rows
        for k, words in enumerate(split):
            for i in range(0, len(words), 1 << 16) if m.languages else ():
                sums[k] += rows[list(map(get, words[i : i + (1 << 16)]))].sum(0)
        if not m.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for i in range(0, len(texts), 256):
            p = _softmax(m.logits(sums[i : i + 256, :-1] / np.maximum(sums[i : i + 256, -1:], 1)) / m.temperature)
            best[i : i + 256], score[i : i + 256] = p.argmax(1), p.max(1)
        score = np.where(seen, score, 0.0)
        names = [m.languages[b] if s else "und" for b, s in zip(best.tolist(), seen.tolist(), strict=True)]
        return names, score, score < m.threshold


def fitted(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> LanguageModel:
    """A model of a bounded sample of df's rows that have a label and a text. One task holds it; the driver gets the model only."""
    rows = df.where(F.col(lang).isNotNull() & (F.octet_length(text) > 0)).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    known = rows.groupBy("l").agg(F.count("*").alias("_rows")).orderBy(F.desc("_rows"), "l").limit(MOST_LANGUAGES).collect()
    if not known:
        return LanguageModel([])
    each = max(1, min(PER_LANGUAGE, TRAINING_ROWS // len(known)))
    counts = df.sparkSession.createDataFrame(known, "l string, _rows long")
    draw = F.pmod(F.xxhash64(F.lit("sample"), "k"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(F.broadcast(counts), "l").where(draw * F.col("_rows") < each).select("l", excerpt(F.col("t"), ROW_BYTES).cast("binary").alias("t"))
    made = sample.repartition(1).mapInArrow(_train, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else LanguageModel([])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [(t, x) for b in batches for t, x in zip(b.column("t").to_pylist(), b.column("l").to_pylist(), strict=True)]
    if rows:
        model = pickle.dumps(LanguageModel(sorted(rows)))
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])
    del rows
    released()


_TYPE = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def identified(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """df with lang_pred, score and rejected."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        predictor = Predictor(held.value)
        for a in batches:
            texts = a.to_pylist()
            names: list[str] = []
            scores, low = [], []
            for i, j in slices(texts):
                n, s, r = predictor(texts[i:j])
                names += n
                scores.append(s)
                low.append(r)
            columns = [pa.array(names, pa.string()), *(pa.array(np.concatenate(x) if x else [], k) for x, k in ((scores, pa.float64()), (low, pa.bool_())))]
            yield pa.StructArray.from_arrays(columns, ["lang_pred", "score", "rejected"])

    out = df.drop("lang_pred", "score", "rejected").withColumn("_l", F.arrow_udf(predict, _TYPE)(F.col(text).cast("binary")))
    return out.select(*[c for c in out.columns if c != "_l"], "_l.lang_pred", "_l.score", "_l.rejected")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fitted(docs.where(fold("doc_id") != 0))
    return identified(docs.select("doc_id", "text"), model).select("doc_id", (fold("doc_id") == 0).alias("held_out"), "lang_pred", "score", "rejected")
