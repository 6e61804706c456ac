"""Substring dedup by difference-cover anchors: words under a passage that an earlier document has too are removed.

A window is LENGTH consecutive words. Positions whose remainder by PERIOD is in COVER carry an anchor, the hash of the
LENGTH - PERIOD + 1 words from there. For any two positions some shift below PERIOD brings both into the cover, so two equal
windows share an anchor at the same place of both, while only 3 of 7 positions are hashed, kept and shuffled. Windows that hold an
anchor which another document has are extended to their whole length and compared; no other window can match.

Documents are packed into chunks of about CHUNK bytes of text. A chunk asks, for each range of hashes, which of its anchors
other chunks have; the range's task answers with one bit for each. A second round asks for the windows that are left, with
the least document that has each, and the bit says whether an earlier document has it elsewhere. Requests are distinct within a chunk,
so a passage in a third of all documents is one entry of a chunk, and ranges grow in number with the text. The first round compares
32 bits and the range's number: a false match only leaves a window to the second round, which compares 64 bits
of one hash and a range by another. Texts are shuffled once, and each task holds one chunk or one range.

Defined cases: null and empty texts have no words; texts shorter than a window lose nothing; very long texts are read whole,
as a chunk of their own; windows never span documents; rows with a null id lose nothing and take nothing from others; repeated rows
have one id, so they take nothing from each other, and each is returned; rows of one id with unlike texts likewise; an empty table gives no
rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mixed, rolled, table, words_hashed, written

#: Words of a window, and the difference cover: every remainder by PERIOD is a difference of two members of COVER.
LENGTH, PERIOD, COVER = 13, 7, (0, 1, 3)
#: Bytes of text in a chunk and, on average, behind a range of hashes; ranges at least.
CHUNK, RANGE, LEAST_RANGES = 4 << 20, 32 << 20, 64

_SALT = np.uint64(0xA0761D6478BD642F)
_REQUEST = "range int, chunk long, n int, keys binary, least binary"
_ANSWER = "chunk long, round int, range int, n int, bits binary"


def _binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def _packer(limit: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            lengths = pc.fill_null(pc.binary_length(b.column("text")), 0).to_pylist()
            numbers = []
            for n in lengths:
                if size and size + n > limit:
                    chunk, size = chunk + 1, 0
                size += n + 1
                numbers.append(chunk)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), b.column("id"), b.column("text")], ["chunk", "id", "text"])

    return pack


class _Chunk:
    """The documents of one chunk as word hashes; windows and anchors by their first word's place."""

    def __init__(self, rows: pa.Table, length: int, period: int, cover: tuple[int, ...], ranges: int):
        self.length, self.period, self.ranges = length, period, ranges
        ids = rows.column("id").combine_chunks()
        self.known = pc.is_valid(ids).to_numpy(zero_copy_only=False)
        self.ids = pc.fill_null(ids, 0).to_numpy()
        self.texts = rows.column("text").to_pylist()
        _, _, _, self.hashes, self.first = words_hashed(self.texts)
        counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(counts)), counts)
        self.place = np.arange(len(self.row)) - np.repeat(self.first[:-1], counts)
        span = length - period + 1
        at = self._starts(span)
        self.at = at[np.isin(self.place[at] % period, cover)]
        key = rolled(self.hashes, span)[self.at]
        self.anchor = (key >> np.uint64(32)) % np.uint64(ranges) << np.uint64(32) | key & np.uint64(0xFFFFFFFF)
        self.anchors, self.inverse = np.unique(self.anchor, return_inverse=True)

    def _starts(self, n: int) -> np.ndarray:
        """First words of the runs of n words inside one document that has an id."""
        if len(self.row) < n:
            return np.zeros(0, np.int64)
        return np.flatnonzero((self.row[: len(self.row) - n + 1] == self.row[n - 1 :]) & self.known[self.row[: len(self.row) - n + 1]])

    def candidates(self, shared: np.ndarray) -> None:
        """Windows with an anchor that two documents have: shared says so of other chunks, for each distinct anchor."""
        owner = self.ids[self.row[self.at]]
        if len(self.at):
            low, high = np.full(len(self.anchors), np.iinfo(np.int64).max), np.full(len(self.anchors), np.iinfo(np.int64).min)
            np.minimum.at(low, self.inverse, owner)
            np.maximum.at(high, self.inverse, owner)
            shared = shared | (low < high)
        change = np.zeros(len(self.row) + 1, np.int32)
        live = self.at[shared[self.inverse]] if len(self.at) else self.at
        # an anchor is inside the windows that start up to a period before it
        np.add.at(change, np.maximum(live - self.period + 1, 0), 1)
        np.add.at(change, live + 1, -1)
        at = self._starts(self.length)
        self.window = at[np.cumsum(change[:-1])[at] > 0]
        self.key = rolled(self.hashes, self.length)[self.window]
        other = rolled(mixed(self.hashes ^ _SALT), self.length)[self.window]
        self.range = (other >> np.uint64(20)) % np.uint64(self.ranges)
        self.order = np.lexsort((self.ids[self.row[self.window]], self.key, self.range))
        r, k = self.range[self.order], self.key[self.order]
        lead = np.concatenate(([True], (r[1:] != r[:-1]) | (k[1:] != k[:-1]))) if len(r) else np.zeros(0, bool)
        self.group = np.cumsum(lead) - 1
        self.lead = self.order[lead]
        self.least = self.ids[self.row[self.window[self.lead]]]

    def removed(self, earlier: np.ndarray) -> np.ndarray:
        """Words to remove: earlier says of each distinct window whether a document before the chunk's least has it."""
        gone = np.empty(len(self.window), bool)
        gone[self.order] = earlier[self.group] | (self.least[self.group] < self.ids[self.row[self.window[self.order]]])
        change = np.zeros(len(self.row) + 1, np.int32)
        np.add.at(change, self.window[gone], 1)
        np.add.at(change, self.window[gone] + self.length, -1)
        return np.cumsum(change[:-1]) > 0


def _requests(chunk: int, ranges: np.ndarray, keys: np.ndarray, least: np.ndarray | None) -> pa.Table:
    """One row for each range: its keys, which are sorted by range, as bytes."""
    cut = np.flatnonzero(np.concatenate(([True], ranges[1:] != ranges[:-1]))) if len(ranges) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(ranges)) if len(ranges) else cut
    spans = list(zip(cut.tolist(), ends.tolist(), strict=True))
    return pa.table(
        {
            "range": pa.array(ranges[cut].astype(np.int32)),
            "chunk": pa.array(np.full(len(cut), chunk, np.int64)),
            "n": pa.array((ends - cut).astype(np.int32)),
            "keys": _binary([keys[a:b].tobytes() for a, b in spans]),
            "least": _binary([least[a:b].tobytes() if least is not None else b"" for a, b in spans]),
        }
    )


def _told(answers: pa.Table, round_: int, ranges: np.ndarray, size: int) -> np.ndarray:
    """The bits of a round's answers, in the order of the chunk's requests, which are sorted by range."""
    out = np.zeros(size, bool)
    start = np.searchsorted(ranges, np.arange(int(ranges[-1]) + 1)) if size else []
    for r, at, n, bits in zip(*(answers.column(c).to_pylist() for c in ("round", "range", "n", "bits")), strict=True):
        if r == round_:
            out[start[at] : start[at] + n] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
    return out


def _gathered(rows: pa.Table, dtype) -> tuple[np.ndarray, np.ndarray]:
    sizes = rows.column("n").to_numpy().astype(np.int64)
    return np.frombuffer(b"".join(rows.column("keys").to_pylist()), dtype), np.concatenate(([0], np.cumsum(sizes)))


def _answers(rows: pa.Table, round_: int, bits: np.ndarray, ends: np.ndarray) -> pa.Table:
    packed = [np.packbits(bits[a:b]).tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return pa.table({"chunk": rows.column("chunk"), "round": pa.array(np.full(len(packed), round_, np.int32)), "range": rows.column("range"), "n": rows.column("n"), "bits": _binary(packed)})


def _in_two_chunks(rows: pa.Table) -> pa.Table:
    """Which keys of each request another chunk asks for too."""
    keys, ends = _gathered(rows, np.uint32)
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return _answers(rows, 1, counts[inverse] > 1, ends)


def _has_earlier(rows: pa.Table) -> pa.Table:
    """Which windows of each request a document before the request's own has."""
    keys, ends = _gathered(rows, np.uint64)
    least = np.frombuffer(b"".join(rows.column("least").to_pylist()), np.int64)
    order = np.lexsort((least, keys))
    k = keys[order]
    lead = np.concatenate(([True], k[1:] != k[:-1])) if len(k) else np.zeros(0, bool)
    bits = np.empty(len(keys), bool)
    bits[order] = least[order][lead][np.cumsum(lead) - 1] < least[order]
    return _answers(rows, 2, bits, ends)


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, period: int = PERIOD, cover: tuple[int, ...] = COVER, chunk_bytes: int = CHUNK) -> DataFrame:
    """For each row key, n_words, n_removed, removed (word ranges start, end exclusive) and kept (the words left, joined by a space)."""
    if {(a - b) % period for a in cover for b in cover} != set(range(period)) or not 1 <= period <= length:
        raise ValueError("cover must be a difference cover of a period of at most the window's length")
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    chunks = written(rows.mapInArrow(_packer(chunk_bytes), "chunk long, id long, text binary"), "chunks")
    total = chunks.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(LEAST_RANGES, total // RANGE)
    load = lambda t: _Chunk(t, length, period, cover, ranges)

    def ask_anchors(number: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        c = load(rows)
        return _requests(number[0].as_py(), (c.anchors >> np.uint64(32)).astype(np.int64), c.anchors.astype(np.uint32), None)

    def known(c: _Chunk, answers: pa.Table) -> None:
        c.candidates(_told(answers, 1, (c.anchors >> np.uint64(32)).astype(np.int64), len(c.anchors)))

    def ask_windows(number: tuple[pa.Scalar, ...], rows: pa.Table, answers: pa.Table) -> pa.Table:
        c = load(rows)
        known(c, answers)
        return _requests(number[0].as_py(), c.range[c.lead].astype(np.int64), c.key[c.lead], c.least)

    def result(number: tuple[pa.Scalar, ...], rows: pa.Table, answers: pa.Table) -> pa.Table:
        c = load(rows)
        known(c, answers)
        gone = c.removed(_told(answers, 2, c.range[c.lead].astype(np.int64), len(c.lead)))
        kept, spans = [], []
        for t, a, b in zip(c.texts, c.first[:-1].tolist(), c.first[1:].tolist(), strict=True):
            words, out = (t or b"").split(), gone[a:b]
            kept.append(b" ".join(compress(words, ~out) if out.any() else words))
            edge = np.flatnonzero(np.diff(np.concatenate(([False], out, [False])).view(np.int8)))
            spans.append([{"start": s, "end": e} for s, e in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True)])
        n_words = np.diff(c.first).astype(np.int64)
        n_removed = np.bincount(c.row[gone], minlength=len(n_words)).astype(np.int64)
        ranges_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"id": rows.column("id"), "n_words": pa.array(n_words), "n_removed": pa.array(n_removed), "removed": pa.array(spans, ranges_type), "kept": _binary(kept)})

    by_chunk = chunks.groupBy("chunk")
    anchors = by_chunk.applyInArrow(ask_anchors, _REQUEST).groupBy("range").applyInArrow(_in_two_chunks, _ANSWER)
    windows = by_chunk.cogroup(anchors.groupBy("chunk")).applyInArrow(ask_windows, _REQUEST).groupBy("range").applyInArrow(_has_earlier, _ANSWER)
    out = by_chunk.cogroup(anchors.unionByName(windows).groupBy("chunk")).applyInArrow(result, "id long, n_words long, n_removed long, removed array<struct<start:bigint,end:bigint>>, kept binary")
    return out.select(F.col("id").alias(key), "n_words", "n_removed", "removed", F.col("kept").cast("string").alias("kept"))


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = rf"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, unnest(generate_series(1, len(ws) - {LENGTH - 1})) AS i, unnest(list_transform(generate_series(1, len(ws) - {LENGTH - 1}), lambda i: array_to_string(ws[i:i + {LENGTH - 1}], ' '))) AS s FROM w WHERE len(ws) >= {LENGTH}),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM g),
r AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(generate_series(i, i + {LENGTH - 1})) AS p FROM m WHERE least < doc_id) GROUP BY doc_id),
k AS (SELECT doc_id, len(ws) AS n, coalesce(len(gone), 0) AS gone_n, list_filter(ws, lambda x, i: NOT list_contains(coalesce(gone, []), i)) AS kept FROM w LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(gone_n AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
