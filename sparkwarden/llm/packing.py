"""Mixture-controlled packing: deficit round-robin over source queues into windows of a fixed number of tokens.

A queue is the documents of a source, one after another. Its tokens are served in quanta of QUANTUM, eight to a window.
With each quantum that any queue serves, every queue's deficit grows by its weight's share of a quantum, and serving one
costs a whole one; the queue whose deficit is due first (reaches half a quantum first) serves next, and what it lacks
or has left is carried to the next window. Quantum k of queue q is due at (2 k + 1) / (2 w[q]), so its place in
the stream is the number of quanta of all queues that are due earlier, a sum of one quotient for each queue: no task needs
another's state, and deficits carry over windows and partitions by arithmetic. A queue that has ended is not
served any more; the ends of queues, less than a quantum each, follow at last. Every window but the last is full.

Positions: the tokenising task numbers its own tokens by queue, and a small table of token counts by queue and
task gives each task its start. Documents are tokenised once, into a table in the shared scratch folder.

Targets are the sources' own shares unless given; given targets hold until some queue ends, then the others go on by
theirs; a target without tokens is an error, and so is one below a 2^20th; sources without a target follow when the named
ones have ended. A source with less than a 2048th of the tokens that no target names shares one queue with its like,
where documents follow each other by the part of their source that is before them, so each source is spread over the
whole queue.

Defined cases: a null text is empty, and has just the end id; a null source is the queue ""; repeated rows are packed
each; queues that are due at once serve in the order of their names; an empty table gives no pieces; very long texts are
cut over windows; a tokenizer of any kind gives the ids that it gives for whole texts; other input columns are ignored, also those named like an output.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cached_by, released, small, table, written

LENGTH, END_ID = 2048, 1
#: Tokens that a queue serves at once.
QUANTUM = 256
#: Sources of less than a part of so many tokens share a queue; weights are whole numbers up to WEIGHTS.
SHARES, WEIGHTS = 2048, 1 << 20
#: Documents of the shared queue that are put in order together.
BUCKET_ROWS = 20_000
_WORDS_KEPT = 250_000
_REST = "\x00rest"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: ASCII punctuation but the apostrophe, which starts contractions.
_TAIL = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != 39)


#: A lower-case ASCII word without an apostrophe, and the punctuation after its last letter or digit.
_BODY_TAIL = re.compile(rb"^([^'\n]*[a-z0-9])([" + re.escape(_TAIL) + rb"]+)$", re.M)

#: Characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on.
_SIGNS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


#: Steps of a tokenizer under which words may be encoded apart: case and kinds of white space do not count, white space falls away,
#: and letters, digits and other characters are never in one token. Fixed values of the file format.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_PRE_TOKENIZER = [_SPLIT, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]


def words_apart(tokenizer: dict) -> bool:
    """Whether a tokenizer (its file's content) is of the kind whose words may be encoded apart."""
    steps = lambda part, name: (tokenizer.get(part) or {}).get(name)
    model = tokenizer.get("model") or {}
    # added tokens begin with a sign that words are looked through for, and are matched before the steps
    plain = all(t["content"].startswith("<|") and not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) for t in tokenizer.get("added_tokens") or [])
    return plain and steps("normalizer", "normalizers") == _NORMALIZER and steps("pre_tokenizer", "pretokenizers") == _PRE_TOKENIZER and model.get("type") == "BPE" and not model.get("dropout")


class Encoder:
    """Ids of texts by a tokenizer of any kind.

    One that ignores case and white space and keeps letters apart from other characters (see words_apart) lets texts be
    cut at ASCII white space, and a word from the punctuation after its last letter or digit; each part's ids are kept.
    Words with an apostrophe or a special token's sign stay whole. Other tokenizers get whole texts.
    """

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = path or default_tokenizer()
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.apart = words_apart(json.load(f))
        #: 16 bits an id where the vocabulary allows, in parts and tables
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        # words of letters only need no look at added tokens and no splitting, if the tokenizer is of that kind
        self._merge = self.tokenizer.model.tokenize
        self.direct = False
        if not self.apart:
            return
        probe = ["word", "naïve", "東京", "straße", "and", "über", "ελλάδα"]
        signs = [self._signs(w) for w in probe]
        self.direct = [x and [t.id for t in self._merge(x)] for x in signs] == [self.tokenizer.encode(w, add_special_tokens=False).ids for w in probe]

    def _signs(self, word: str) -> str | None:
        """A word of letters as the vocabulary spells it; none if it has other characters."""
        if word.isascii():
            return word.lower() if word.isalpha() else None
        word = self.tokenizer.normalizer.normalize_str(word)
        return word.encode().decode("latin-1").translate(_SIGNS) if word.isalpha() else None

    @staticmethod
    def cut(word: bytes) -> tuple[bytes, bytes]:
        low = word.lower()
        if low.isalpha():
            return low, b""
        if b"'" in word or b"<|" in word:
            return word, b""
        body = low.rstrip(_TAIL)
        if len(body) == len(low) or not body:
            return low, b""
        last = body[-1]
        apart = chr(last).isalnum() if last < 128 else body[-4:].decode("utf-8", "ignore")[-1:].lower()[-1:].isalpha()
        return (body, low[len(body) :]) if apart else (low, b"")

    def __call__(self, texts: list[bytes | None] | pa.Array, end: int = END_ID) -> list[bytes]:
        """Ids of each text and the end id, little-endian, as self.kind."""
        last = np.array([end], self.kind).tobytes()
        a = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary())).cast(pa.large_string()).fill_null("")
        if not self.apart:
            out: list[bytes] = []
            for i, j in runs_of(pc.binary_length(a).to_numpy(), 1 << 20):
                encoded = self.tokenizer.encode_batch_fast(a.slice(i, j - i).to_pylist(), add_special_tokens=False)
                out += [np.array(e.ids, self.kind).tobytes() + last for e in encoded]
            return out
        # a copy that starts at byte 0: the kernels below misread some slices
        a = pa.concat_arrays([a, pa.array([], pa.large_string())])
        # lower case first: fewer words. Special tokens are told by their case
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(a, "<|"), a, pc.ascii_lower(a)))
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary.cast(pa.large_binary()).to_pylist()
        if len(self.words) > _WORDS_KEPT:
            # the last words stay at hand; those of them that come again are kept
            self.older, self.words = self.words, {}
        gc.disable()  # what is made here has no cycles, and there is much of it
        try:
            self._learn(set(distinct) - self.words.keys())
        finally:
            gc.enable()
        ids = pa.array(list(map(self.words.__getitem__, distinct)), pa.large_binary()).take(words.indices)
        at = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1][lists.offsets.to_numpy()] if len(ids) else np.zeros(len(a) + 1, np.int64)
        data = memoryview(ids.buffers()[2] or b"")
        return [bytes(data[i:j]) + last for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def _learn(self, new: set[bytes]) -> None:
        known = self.words
        if self.older:
            again = new & self.older.keys()
            known.update(zip(again, map(self.older.__getitem__, again), strict=True))
            new -= again
        other = [w for w in new if not w.isalpha()]
        joined = b"\n".join(w for w in other if w.isascii() and b"<|" not in w)
        cuts = {a + b: (a, b) for a, b in _BODY_TAIL.findall(joined)}
        cuts.update((w, self.cut(w)) for w in other if not w.isascii())
        parts = {x for c in cuts.values() for x in c if x}
        parts.update(new - cuts.keys())
        parts -= known.keys()
        if self.direct:
            spelt = {w: x for w in parts if (x := self._signs(w.decode()))}
            tokens = list(map(self._merge, spelt.values()))
            ends = 2 * np.cumsum([0, *map(len, tokens)]) if self.kind == "<u2" else 4 * np.cumsum([0, *map(len, tokens)])
            ids = np.fromiter((t.id for x in tokens for t in x), self.kind).tobytes()
            at = ends.tolist()
            known.update(zip(spelt, map(ids.__getitem__, map(slice, at, at[1:])), strict=True))
            parts -= spelt.keys()
        rest = list(parts)
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            encoded = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            known.update((w, np.array(e.ids, self.kind).tobytes()) for w, e in zip(part, encoded, strict=True))
        known[b""] = b""
        known.update([(w, known[a] + known[b]) for w, (a, b) in cuts.items()])


#: Encoders of this worker by path, with the words they have seen in earlier tasks.
_encoders: dict[str | None, Encoder] = {}
cached_by("packing", _encoders.clear)


def encoder(path: str | None) -> Encoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def runs_of(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs (start, stop) of rows that hold about so much; one large row is a run of its own."""
    ends, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")))
        yield i, j
        i = j


def _tokenise(path: str | None, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path), TaskContext.get().partitionId()
        width = int(encode.kind[-1])
        used: dict[str, int] = {}
        for b in batches:
            texts, sources = b.column("text"), b.column("queue").to_pylist()
            for i, j in runs_of(pc.binary_length(texts).to_numpy(), 8 << 20):
                ids = encode(texts.slice(i, j - i), end)
                names = sources[i:j]
                starts, sizes = [], []
                for q, x in zip(names, ids, strict=True):
                    n = len(x) // width
                    starts.append(used.get(q, 0))
                    sizes.append(n)
                    used[q] = starts[-1] + n
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i), pa.array(names, pa.string()), pa.array([part] * len(ids), pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "queue", "part", "nth", "doc_tokens", "ids"],
                )
        released(keep="packing")

    return run


class Schedule:
    """Where the tokens of queues go. totals: tokens by queue; targets: weights by queue, or none."""

    def __init__(self, totals: dict[str, int], targets: dict[str, float] | None = None, length: int = LENGTH, quantum: int = QUANTUM):
        self.length, self.quantum = length, max(1, min(quantum, length))
        names = sorted(totals)
        wanted = {q: v for q, v in (targets or {}).items() if v > 0}
        missing = wanted.keys() - {q for q in names if totals[q]}
        if names and missing:
            raise ValueError(f"targets without tokens: {sorted(missing)}")
        whole = sum(wanted.values()) if wanted else max(1, sum(totals.values()))
        weights = {q: round((wanted if wanted else totals).get(q, 0) / whole * WEIGHTS) for q in names}
        if any(not weights[q] for q in wanted if q in weights):
            raise ValueError(f"a target is below 1 / {WEIGHTS}")
        self.index = {q: i for i, q in enumerate(names)}
        full = np.array([totals[q] // self.quantum for q in names], np.int64)
        #: first the queues with a target, then those without
        self.group = np.array([int(bool(wanted) and q not in wanted) for q in names], np.int64)
        self.weight = np.array([max(1, weights[q]) if q in wanted or not wanted else max(1, round(totals[q] / sum(totals.values()) * WEIGHTS)) for q in names], np.int64)
        self.full = full
        self.before = np.array([full[self.group < g].sum() for g in self.group], np.int64)
        rest = np.array([totals[q] for q in names], np.int64) - full * self.quantum
        self.tail = full.sum() * self.quantum + np.cumsum(rest) - rest

    def place(self, queue: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The place in the stream of the queues' whole quanta k: how many are due before them."""
        out = self.before[queue].copy()
        mine, group = self.weight[queue], self.group[queue]
        # equal due times go by the queues' order; halves of quanta keep numbers whole
        due = 2 * k + 1
        for r in range(len(self.full)):
            w = self.weight[r]
            earlier = (due * w + np.where(queue > r, mine, mine - 1)) // (2 * mine)
            out += np.where(group == self.group[r], np.minimum(earlier, self.full[r]), 0)
        return out

    def pieces(self, queue: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, sequence_id, offset and length of the pieces of runs of n tokens of queues from at on, in order."""
        size, length = self.quantum, self.length
        first, many = at // size, (at + n - 1) // size - at // size + 1
        row = np.repeat(np.arange(len(at)), many)
        k = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + first[row]
        low, high = np.maximum(at[row], k * size), np.minimum((at + n)[row], (k + 1) * size)
        q = queue[row]
        ended = k >= self.full[q]
        start = np.where(ended, self.tail[q], 0) + low - np.minimum(k, self.full[q]) * size
        start[~ended] += self.place(q[~ended], k[~ended]) * size
        # runs that are next to each other are one, but windows end pieces
        joined = np.concatenate(([False], (row[1:] == row[:-1]) & (start[1:] == start[:-1] + (high - low)[:-1])))
        heads = np.flatnonzero(~joined)
        row, start, run = row[heads], start[heads], np.add.reduceat(high - low, heads) if len(heads) else low
        windows = (start + run - 1) // length - start // length + 1
        part = np.repeat(np.arange(len(row)), windows)
        w = np.arange(len(part)) - np.repeat(np.cumsum(windows) - windows, windows) + (start // length)[part]
        begin, end = np.maximum(start[part], w * length), np.minimum((start + run)[part], (w + 1) * length)
        return row[part], w, begin - w * length, end - begin


def _pieces(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schedule: Schedule = held.value
        for b in batches:
            sizes = b.column("doc_tokens").to_numpy()
            for i, j in runs_of(sizes, 1 << 21):
                x = b.slice(i, j - i)
                n = sizes[i:j]
                queue = np.array([schedule.index[q] for q in x.column("queue").to_pylist()], np.int64)
                row, window, offset, length = schedule.pieces(queue, x.column("at").to_numpy(), n)
                before = np.cumsum(length) - length
                start = before - (np.cumsum(n) - n)[row]
                # ids are 16 or 32 bits wide, and each document has one
                kind = f"<u{x.column('ids')[0].as_buffer().size // int(n[0])}"
                # the pieces' ids are the documents' ids, cut
                ids = b"".join(np.frombuffer(t.as_buffer(), kind).astype("<u4").tobytes() for t in x.column("ids"))
                bounds = 4 * np.concatenate((before, [before[-1] + length[-1]]))
                cut = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(ids)]).cast(pa.binary())
                docs = x.column("doc_id").take(pa.array(row))
                yield pa.RecordBatch.from_arrays([docs, *(pa.array(c) for c in (start, length, n[row], window, offset)), cut], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return run


def _shared(placed: DataFrame, sizes: DataFrame) -> DataFrame:
    """placed with one queue _REST: documents in the order of the part of their source's tokens (queue, n) before them."""
    part = placed.join(small(sizes), "queue").withColumn("before", F.col("at") / F.col("n")).drop("n")
    many = placed.count() // BUCKET_ROWS + 1
    # all sources begin at 0, so their first documents are dealt by name
    part = part.withColumn("bucket", F.when(F.col("at") == 0, -1 - F.pmod(F.xxhash64("queue"), F.lit(many))).otherwise(F.floor(F.col("before") * many)))
    counts = part.groupBy("bucket").agg(F.sum("doc_tokens").alias("n"))
    starts = counts.select("bucket", (F.sum("n").over(W.orderBy("bucket")) - F.col("n")).alias("start"))
    inside = F.sum("doc_tokens").over(W.partitionBy("bucket").orderBy("before", "queue", "at").rowsBetween(W.unboundedPreceding, 0)) - F.col("doc_tokens")
    out = part.withColumn("inside", inside).join(small(starts), "bucket")
    return out.select("doc_id", F.lit(_REST).alias("queue"), (F.col("start") + F.col("inside")).alias("at"), "doc_tokens", "ids")


def packed(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str | None = None, targets: dict[str, float] | None = None, length: int = LENGTH, end: int = END_ID) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, sequence_id, offset and ids (little-endian unsigned 32-bit)."""
    spark = df.sparkSession
    queue = F.coalesce(F.col(source).cast("string"), F.lit(""))
    rows = df.select(F.col(key).cast("long").alias("doc_id"), queue.alias("queue"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    tokens = written(rows.mapInArrow(_tokenise(tokenizer, end), "doc_id bigint, queue string, part bigint, nth bigint, doc_tokens bigint, ids binary"), "tokens")
    runs = written(tokens.groupBy("queue", "part").agg(F.sum("doc_tokens").alias("n")), "runs")
    by_source = runs.groupBy("queue").agg(F.sum("n").alias("n"))
    whole = by_source.agg(F.sum("n")).first()[0] or 0
    named = [q for q, v in (targets or {}).items() if v > 0]
    totals = {r[0]: r[1] for r in by_source.where((F.col("n") * SHARES >= whole) | F.col("queue").isin(named)).collect()}
    rest = whole - sum(totals.values())
    first = runs.withColumn("first", F.sum("n").over(W.partitionBy("queue").orderBy("part")) - F.col("n")).drop("n")
    placed = tokens.join(small(first), ["queue", "part"]).select("doc_id", "queue", (F.col("first") + F.col("nth")).alias("at"), "doc_tokens", "ids")
    if rest:
        own = F.col("queue").isin(list(totals))
        placed = placed.where(own).unionByName(_shared(placed.where(~own), by_source.where(~own)))
        totals[_REST] = rest
    held = spark.sparkContext.broadcast(Schedule(totals, targets, length))
    return placed.mapInArrow(_pieces(held), "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packed(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
