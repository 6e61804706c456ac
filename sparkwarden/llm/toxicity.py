"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels mark documents, so tokens are labelled first: of the words and word beginnings that occur almost only in
toxic documents, those spread over many unlike ones are taken, then by a greedy cover those that explain most toxic
documents not explained yet; every token with one of them is toxic. A two-state chain over each line (cut at SEGMENT words) with hashed features of a word
and its neighbours is trained on these tokens by stochastic gradients of its likelihood. Forward-backward gives
each token's marginal; their sum, maximum and mean give the document's score by a logistic fit.

With two states a message is one number, its log-odds, so the recursions run over all segments of a buffer at once.

Defined cases: a null or empty text has no tokens and gets the score of none; repeated rows get equal results; with
no labelled rows, or one class only, every score is that class's share (0 if there is none); a document with unlike
labels has none, and labels other than 0 and 1 are none; of ties between cues the most frequent, then the purest, then the
whole word is taken; very long texts are read whole; an empty table gives no rows; input columns named like an output
are replaced.
"""

from __future__ import annotations

import heapq
import pickle
import sys
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, excerpt, fold, released, slices, table

#: Toxic and clean training rows at most (the bound of the sample), and bytes of text a training row may have; of longer texts, pieces from all over them are taken.
TOXIC_ROWS, CLEAN_ROWS, ROW_BYTES = 2000, 5000, 16_000
#: Least share of the toxic training rows that a cue is in, and its letters at most; segments with cues that the chain is
#: trained on at most, and segments without for each of them.
CUE_SUPPORT, CUE_LETTERS, CUE_SEGMENTS, PLAIN_SEGMENTS = 0.003, 80, 6000, 2
BUCKETS, PREFIX, SEGMENT, EPOCHS = 1 << 17, 10, 128, 4
_WORDS_KEPT = 150_000

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 or c == 10 else 32 for c in range(256))


def lines_of(text: bytes | None) -> list[list[bytes]]:
    return [w for w in (x.split() for x in text.translate(_LETTERS).split(b"\n")) if w] if text else []


def features(word: bytes) -> list[str]:
    """The word and its beginnings of 3 to 8 letters."""
    w = word.decode("utf-8", "ignore").lower()[:CUE_LETTERS]
    return [f"w={w}", *(f"p={w[:n]}" for n in range(3, 9) if len(w) > n)]


def buckets(words: list[bytes]) -> np.ndarray:
    """Hashed features of each word: itself and its beginnings of 3 to 10 bytes; bucket 0 stands for none."""
    low = [w if w.isascii() else w.decode("utf-8", "ignore").lower().encode() for w in words]
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    buf = np.frombuffer(b"".join(low) + bytes(PREFIX), np.uint8)
    at = np.cumsum(sizes) - sizes
    out = np.zeros((len(low), PREFIX - 1), np.int64)
    out[:, 0] = np.fromiter(map(zlib.crc32, low), np.int64, len(low)) % (BUCKETS - 1) + 1
    h = np.zeros(len(low), np.uint64)
    for n in range(1, PREFIX + 1):
        h = (h + buf[at + n - 1].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        if n >= 3:
            out[:, n - 2] = np.where(sizes > n, ((h ^ (h >> np.uint64(29))) >> np.uint64(7)).astype(np.int64) % (BUCKETS - 1) + 1, 0)
    return out


def cues(toxic: list[set[bytes]], clean: Iterable[set[bytes]], purity: float = 0.95) -> set[str]:
    """Features that mark toxic tokens; each document is the set of its words.

    Pure features that are spread over many unlike documents are taken at once, others by the cover.
    """

    def of(words: set[bytes]) -> set[str]:
        return {sys.intern(f) for w in words for f in features(w)}

    against, inside = Counter(), Counter()
    least = max(2, round(CUE_SUPPORT * len(toxic)))
    for d in toxic:
        inside.update(of(d))
    inside = Counter({f: n for f, n in inside.items() if n >= least})  # no others can be cues
    sets = [of(d) & inside.keys() for d in toxic]
    n_clean = 0
    for n_clean, d in enumerate(clean, 1):
        against.update(of(d) & inside.keys())
    where: dict[str, list[int]] = {}
    for i, s in enumerate(sets):
        for f in s:
            a, b = inside[f] / max(1, len(toxic)), against[f] / max(1, n_clean)
            if a >= purity * (a + b):
                where.setdefault(f, []).append(i)
    # near copies share their least word hash mostly, and count as one
    sketch = [min(map(zlib.crc32, d), default=0) for d in toxic]
    spread = max(4, round(0.01 * len(set(sketch))))
    taken = {f for f, v in where.items() if len({sketch[i] for i in v}) >= spread}
    # the most frequent first; of equal ones the purest, then the whole word
    heap = [(-len(v), against[f], f.startswith("p="), -len(f), f) for f, v in where.items()]
    heapq.heapify(heap)
    open_ = set(range(len(toxic))).difference(*(where[f] for f in taken))
    while heap and open_:
        gain, b, p, n, f = heapq.heappop(heap)
        now = sum(i in open_ for i in where[f])
        if now < least:
            continue
        if now < -gain:
            heapq.heappush(heap, (-now, b, p, n, f))
            continue
        taken.add(f)
        open_.difference_update(where[f])
    return taken


class Chain:
    """Two-state chain: weights of hashed features (own, of the word before, of the word after) for state 1 against 0, transition and start weights."""

    def __init__(self) -> None:
        self.weights = np.zeros((3, BUCKETS))
        self.trans = np.zeros((2, 2))
        self.start = 0.0

    def parts(self, words: list[bytes]) -> np.ndarray:
        """What each word adds to its own log-odds, to the next word's and to the one before."""
        f = buckets(words)
        return np.column_stack([w[f].sum(1) for w in self.weights])


def _step(r: np.ndarray, a: float, b: float, c: float, d: float) -> np.ndarray:
    """log((exp(a) + exp(b + r)) / (exp(c) + exp(d + r)))"""
    return np.logaddexp(a, b + r) - np.logaddexp(c, d + r)


def layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments from longest to shortest, and for each step how many still run."""
    order = np.argsort(-lengths, kind="stable")
    live = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")
    return order, live


def messages(emission: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log-odds of state 1 for each token; emission holds the segments one after another."""
    order, live = layout(lengths)
    first = (np.cumsum(lengths) - lengths)[order]
    fwd, bwd = np.empty(len(emission)), np.zeros(len(emission))
    r = np.zeros(len(order))
    for t, n in enumerate(live):
        at = first[:n] + t
        r[:n] = emission[at] + (start if t == 0 else _step(r[:n], trans[0, 1], trans[1, 1], trans[0, 0], trans[1, 0]))
        fwd[at] = r[:n]
    r = np.zeros(len(order))
    for t in range(len(live) - 2, -1, -1):
        n = live[t + 1]
        at = first[:n] + t
        r[:n] = _step(emission[at + 1] + bwd[at + 1], trans[1, 0], trans[1, 1], trans[0, 0], trans[0, 1])
        bwd[at] = r[:n]
    return fwd, bwd


def marginals(emission: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: float) -> np.ndarray:
    """Log-odds of state 1 for each token given its segment."""
    fwd, bwd = messages(emission, lengths, trans, start)
    return fwd + bwd


def pairs(emission: np.ndarray, fwd: np.ndarray, bwd: np.ndarray, at: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Probabilities [4, n] of the states (0, 0), (0, 1), (1, 0), (1, 1) of the tokens at - 1 and at."""
    left, right = fwd[at - 1], emission[at] + bwd[at]
    x = np.stack([np.full(len(at), trans[0, 0]), trans[0, 1] + right, trans[1, 0] + left, trans[1, 1] + left + right])
    x = np.exp(x - x.max(0))
    return x / x.sum(0)


def placed(ids: list[np.ndarray], none: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of segments one after another, the word before and after each (none at a segment's ends), and lengths."""
    lengths = np.array([len(x) for x in ids])
    own = np.concatenate(ids)
    first = np.cumsum(lengths) - lengths
    before, after = np.concatenate(([none], own[:-1])), np.concatenate((own[1:], [none]))
    before[first] = none
    after[first + lengths - 1] = none
    return own, before, after, lengths


def trained(segments: list[tuple[list[bytes], list[int]]], seed: int = 5) -> Chain:
    """Stochastic gradient ascent (Adagrad) on the likelihood of labelled segments.

    Segments are kept as numbers of words, and features are looked up for each batch.
    """
    chain, rng = Chain(), np.random.default_rng(seed)
    distinct = sorted({w for words, _ in segments for w in words})
    if not distinct:
        return chain
    known = np.vstack((buckets(distinct), np.zeros((1, PREFIX - 1), np.int64))).astype(np.int32)
    none = len(distinct)
    number = {w: i for i, w in enumerate(distinct)}
    data = [(np.fromiter((number[w] for w in words), np.int32, len(words)), np.array(labels, np.uint8)) for words, labels in segments]
    seen = np.full(3 * BUCKETS, 1e-3)
    weights = chain.weights.reshape(-1)
    seen_t, seen_s = np.full((2, 2), 1.0), 1.0
    for _ in range(EPOCHS):
        for group in np.array_split(rng.permutation(len(data)), max(1, len(data) // 64)):
            own, before, after, lengths = placed([data[i][0] for i in group], none)
            at = np.concatenate((known[own], known[before] + BUCKETS, known[after] + 2 * BUCKETS), axis=1)
            gold = np.concatenate([data[i][1] for i in group]).astype(float)
            emission = weights[at].sum(1)
            fwd, bwd = messages(emission, lengths, chain.trans, chain.start)
            m = 1 / (1 + np.exp(-np.clip(fwd + bwd, -40, 40)))
            error = gold - m
            grad = np.bincount(at.reshape(-1), np.repeat(error, at.shape[1]), 3 * BUCKETS) - 1e-4 * weights
            grad[[0, BUCKETS, 2 * BUCKETS]] = 0
            seen += grad**2
            weights += 0.3 * grad / np.sqrt(seen)
            trans, start = chain_gradient(gold, emission, fwd, bwd, lengths, chain.trans)
            seen_t += trans**2
            chain.trans += 0.1 * trans / np.sqrt(seen_t)
            seen_s += start**2
            chain.start += 0.1 * start / np.sqrt(seen_s)
    return chain


def chain_gradient(gold: np.ndarray, emission: np.ndarray, fwd: np.ndarray, bwd: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, float]:
    """Gradients of the segments' log-likelihood by the transition and start weights: what is observed less what is expected."""
    first = np.cumsum(lengths) - lengths
    inner = np.ones(len(gold), bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    was, is_ = gold[at - 1], gold[at]
    observed = np.array([((1 - was) * (1 - is_)).sum(), ((1 - was) * is_).sum(), (was * (1 - is_)).sum(), (was * is_).sum()])
    pair = (observed - pairs(emission, fwd, bwd, at, trans).sum(1)).reshape(2, 2)
    m = 1 / (1 + np.exp(-np.clip(fwd + bwd, -40, 40)))
    return pair, float((gold - m)[first].sum())


class _Words(dict):
    """word -> row of its parts"""

    def __init__(self, chain: Chain):
        super().__init__()
        self.chain, self.rows = chain, np.zeros((0, 3))

    def learn(self, words: list[bytes]) -> None:
        if not words:
            return
        new = self.chain.parts(words)
        self.update(zip(words, range(len(self), len(self) + len(words)), strict=True))
        if len(self) > len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros((max(4096, len(self)), 3))))
        self.rows[len(self) - len(words) : len(self)] = new


class Tagger:
    """Marginals of the tokens of texts, and document scores."""

    def __init__(self, model: ToxicityModel):
        self.model, self.words = model, _Words(model.chain)

    def tag(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of all tokens, text after text, and tokens in each text."""
        if len(self.words) > _WORDS_KEPT:
            self.words = _Words(self.model.chain)
        ids: list[int] = []
        lengths: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        split = [lines_of(t) for t in texts]
        known = self.words
        known.learn(list(set().union(*(line for lines in split for line in lines)) - known.keys()))
        get = known.__getitem__
        for k, lines in enumerate(split):
            before = len(ids)
            for line in lines:
                ids += map(get, line)
                n = len(line)
                while n > SEGMENT:
                    lengths.append(SEGMENT)
                    n -= SEGMENT
                lengths.append(n)
            counts[k] = len(ids) - before
        if not ids:
            return np.zeros(0), counts
        size = np.array(lengths)
        own, after, before_ = known.rows[ids].T
        emission = own.copy()
        first = np.zeros(len(ids) + 1, bool)
        first[np.concatenate(([0], np.cumsum(size)))] = True
        emission[1:] += np.where(first[1:-1], 0, after[:-1])
        emission[:-1] += np.where(first[1:-1], 0, before_[1:])
        logits = marginals(emission, size, self.model.chain.trans, self.model.chain.start)
        return 1 / (1 + np.exp(-np.clip(logits, -40, 40))), counts

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, list[list[dict[str, int]]]]:
        """Scores, and spans of toxic tokens in code points, end exclusive."""
        if self.model.constant is not None:
            return np.full(len(texts), self.model.constant), [[] for _ in texts]
        m, counts = self.tag(texts)
        ends = np.cumsum(counts)
        spans: list[list[dict[str, int]]] = [[] for _ in texts]
        for k in np.unique(np.searchsorted(ends, np.flatnonzero(m >= 0.5), side="right")).tolist():
            spans[k] = _spans(texts[k], m[ends[k] - counts[k] : ends[k]] >= 0.5)
        return self.model.score(summed(m, counts)), spans


def summed(m: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log(1 + sum), maximum and mean of the marginals of each text."""
    out = np.zeros((len(counts), 3))
    has = np.flatnonzero(counts)
    if len(has):
        at = (np.cumsum(counts) - counts)[has]
        out[has, 0] = np.add.reduceat(m, at)
        out[has, 1] = np.maximum.reduceat(m, at)
        out[has, 2] = out[has, 0] / counts[has]
        out[:, 0] = np.log1p(out[:, 0])
    return out


def _spans(text: bytes, hit: np.ndarray) -> list[dict[str, int]]:
    buf = np.frombuffer(text.translate(_LETTERS) + b" ", np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], (buf != 32) & (buf != 10))).view(np.int8)))
    points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    starts, ends = points[edge[0::2]], points[edge[1::2]]
    out: list[dict[str, int]] = []
    last = -2
    for i in np.flatnonzero(hit).tolist():
        if i == last + 1 and out:
            out[-1]["end"] = int(ends[i])
        else:
            out.append({"start": int(starts[i]), "end": int(ends[i])})
        last = i
    return out


class ToxicityModel:
    """Trained on (text, label) rows."""

    def __init__(self, rows: list[tuple[bytes, int]]):
        self.constant: float | None = None
        self.chain, self.scale = Chain(), np.zeros(4)
        self.cues: set[str] = set()
        classes = Counter(y for _, y in rows)
        if len(classes) < 2:
            self.constant = float(classes[1] > 0)
            return
        rows = sorted(set(rows))
        order = np.random.default_rng(3).permutation(len(rows))
        same: dict[bytes, bytes] = {}  # one object for each word

        def lines(text: bytes) -> list[list[bytes]]:
            return [[same.setdefault(w, w) for w in line] for line in lines_of(text)]

        toxic = [lines(rows[i][0]) for i in order if rows[i][1]]
        clean = [rows[i][0] for i in order if not rows[i][1]]
        bags = [{w for line in d for w in line} for d in toxic]
        self.cues = cues(bags, ({w for line in lines_of(t) for w in line} for t in clean))
        del bags
        marks: dict[bytes, int] = {}

        def mark(word: bytes) -> int:
            if word not in marks:
                marks[word] = int(not self.cues.isdisjoint(features(word)))
            return marks[word]

        with_cue, without = [], []
        for d in (*toxic, *map(lines, clean)):
            for line in d:
                for i in range(0, len(line), SEGMENT):
                    words = line[i : i + SEGMENT]
                    (with_cue if any(map(mark, words)) else without).append(words)
        rng = np.random.default_rng(3)
        pick = rng.permutation(len(with_cue))[:CUE_SEGMENTS]
        some = rng.permutation(len(without))[: PLAIN_SEGMENTS * len(pick) + 200]
        self.chain = trained([(x, list(map(mark, x))) for x in (*(with_cue[i] for i in pick), *(without[i] for i in some))])
        del with_cue, without, same, marks
        self._scale(rows)

    def _scale(self, rows: list[tuple[bytes, int]]) -> None:
        """Newton's method for the logistic fit, with a small ridge."""
        tagger = Tagger(self)
        parts = [summed(*tagger.tag([t for t, _ in rows[i : i + 200]])) for i in range(0, len(rows), 200)]
        x = np.column_stack((np.concatenate(parts), np.ones(len(rows))))
        y, w = np.array([y for _, y in rows], float), np.zeros(4)
        ridge = np.diag([0.05, 0.05, 0.05, 1e-3])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w = w + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        self.scale = w

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.scale[:3] + self.scale[3], -30, 30)))


def labelled(labels: DataFrame, key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """(k, y): the labels 0 and 1 of documents that have one only."""
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    return marks.groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("_most")).where("y = _most AND y IN (0, 1)").drop("_most")


def fitted(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> ToxicityModel:
    """A model of a bounded sample of the documents that have a label and a text; rows with a null label have none."""
    rows = docs.where(F.octet_length(text) > 0).select(F.col(key).alias("k"), F.col(text).alias("t"))
    marks = labelled(labels, key, label).join(rows.select("k"), "k", "left_semi")
    chosen = bounded_sample(marks, "k", "y", F.when(F.col("y") == 1, TOXIC_ROWS).otherwise(CLEAN_ROWS)).select("k", "y").limit(2 * (TOXIC_ROWS + CLEAN_ROWS))
    # the sample is bounded, so one task holds it; the driver gets the model only
    sample = rows.join(F.broadcast(chosen), "k").select(excerpt(F.col("t"), ROW_BYTES).cast("binary").alias("t"), F.col("y").cast("long").alias("y")).repartition(1)
    made = sample.mapInArrow(_train, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else ToxicityModel([])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [(t, y) for b in batches for t, y in zip(b.column("t").to_pylist(), b.column("y").to_pylist(), strict=True)]
    if rows:
        model = pickle.dumps(ToxicityModel(rows))
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])
    del rows
    released()


_TYPE = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("toxic_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])


def scored(df: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """df with score, toxic_spans and predicted."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tagger = Tagger(held.value)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for a in batches:
            texts = a.to_pylist()
            scores, spans = [], []
            for i, j in slices(texts, 1 << 20):
                s, x = tagger(texts[i:j])
                scores.append(s)
                spans += x
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(scores) if scores else [], pa.float64()), pa.array(spans, kind)], ["score", "toxic_spans"])
        del tagger
        released()

    # a filter on the result must not be evaluated apart, below the projection
    out = df.drop("score", "toxic_spans", "predicted").withColumn("_t", F.arrow_udf(score, _TYPE).asNondeterministic()(F.col(text).cast("binary")))
    out = out.select(*[c for c in out.columns if c != "_t"], F.col("_t.score").alias("score"), F.col("_t.toxic_spans").alias("toxic_spans"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fitted(docs, table(spark, sf_dir, "labels").where(fold("doc_id") != 0))
    spans = F.array_join(F.transform("toxic_spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return scored(docs, model).select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", "predicted", F.size("toxic_spans").cast("long").alias("n_spans"), spans.alias("spans"))
