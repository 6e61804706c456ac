"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of `window` consecutive words of each benchmark item (an item of fewer words is one
window). For each window length, a table of two-word blocks says how far a search may jump: places whose block allows a
jump, or that have a word of no window less than a length before them, are skipped. At places without a jump, buckets by
the hash of the window's last block (and its first, as a prefix check) select candidate windows, and comparison of all
words confirms them.

Words are numbers, windows are places in one array of the items' words, and tables are sorted arrays: about 30 bytes for
each word of the benchmark. A buffer of texts is searched at once, so a jump is no step from place to place: all places that a
block's shift passes over are left out together.

The benchmark is cut into blocks of at most BLOCK_BYTES of text. One block is broadcast and searched at a time; with more
than one, each pass ends in a table in the shared scratch folder, so neither driver nor workers hold more than a
block, whatever the benchmark's size; an item beyond half a block is cut into runs that share a window's words less one, so each
window is in one of them. Nothing is shuffled.

Defined cases: null or empty texts and items have no words, are never hit and never hit; items with the same
window all count, and repeated items once; repeated document rows each get the same result; very long texts are searched
whole; an empty benchmark leaves every document clean, and an empty documents table gives no rows; items with a null id
count as the id "" ; input columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, mixed, released, slices, table, written

WINDOW = 10
#: UTF-8 bytes of benchmark text that one broadcast holds, and pairs of places and windows that are compared at once.
BLOCK_BYTES, PAIRS = 8 << 20, 1 << 20
OUT = ("n_words", "n_hit", "hit_ranges", "items")
_TYPE = "struct<n_words:bigint,hit_ranges:array<struct<start:bigint,end:bigint>>,items:array<string>>"

_KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased."""
    return text.translate(_KEPT).split() if text else []


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and members of the ranges low .. high."""
    sizes = high - low
    row = np.repeat(np.arange(len(low)), sizes)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[row]


class WuManber:
    """Windows of `length` words, at starts in an array of word numbers; numbers are 1 or more, 0 is a word that no window has."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, items: np.ndarray, length: int, vocabulary: int):
        self.words, self.length, self.block, self.base = words, length, min(2, length), np.int64(vocabulary + 1)
        # a block's jump is least in the windows that it ends latest in: length - 1 less its place there
        at = np.unique(starts[:, None] + np.arange(self.block - 1, length)) if len(starts) <= 1 << 16 else np.flatnonzero(self._covered(starts))
        latest = starts[np.searchsorted(starts, at - length + 1)]
        key, far = self._key(words, at), length - 1 - (at - latest)
        order = np.lexsort((far, key))
        first = np.concatenate(([True], key[order][1:] != key[order][:-1])) if len(key) else np.zeros(0, bool)
        self.keys, self.shifts = key[order][first], far[order][first]
        bucket = self._bucket(words, starts)
        order = np.argsort(bucket, kind="stable")
        self.buckets, self.starts, self.items = bucket[order], starts[order], items[order]

    def _covered(self, starts: np.ndarray) -> np.ndarray:
        change = np.zeros(len(self.words) + 1, np.int32)
        np.add.at(change, starts + self.block - 1, 1)
        np.add.at(change, starts + self.length, -1)
        return np.cumsum(change[:-1]) > 0

    def _key(self, words: np.ndarray, last: np.ndarray) -> np.ndarray:
        own = words[last].astype(np.int64)
        return own if self.block == 1 else words[last - 1] * self.base + own

    def _bucket(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        suffix, prefix = self._key(words, starts + self.length - 1), self._key(words, starts + self.block - 1)
        return mixed(suffix.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + prefix.view(np.uint64))

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words of the occurrences, with their items' numbers."""
        n, length = len(ids), self.length
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if n < length or not len(self.keys):
            return none
        # a word of no window lets the search jump its whole length
        zero = np.where(ids == 0, np.arange(n), -1)
        at = np.flatnonzero(np.arange(n) - np.maximum.accumulate(zero) >= length)
        key = self._key(ids, at)
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        at = at[(self.keys[place] == key) & (self.shifts[place] == 0)] - length + 1
        bucket = self._bucket(ids, at)
        low, high = np.searchsorted(self.buckets, bucket, "left"), np.searchsorted(self.buckets, bucket, "right")
        found = [none]
        ends = np.cumsum(high - low)
        i = 0
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
            row, member = _ranges(low[i:j], high[i:j])
            row += i
            for k in range(length):
                same = ids[at[row] + k] == self.words[self.starts[member] + k]
                row, member = row[same], member[same]
            found.append((at[row], self.items[member]))
            i = j
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


class Patterns:
    """Searchers for the windows of some benchmark items, one for each window length."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        self.names = sorted({i for i, _ in items})
        number = {n: k for k, n in enumerate(self.names)}
        words, by_length, at = [], {}, 0
        for item, text in items:
            ids = np.fromiter((self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)), np.int32)
            length = min(window, len(ids))
            if length:
                words.append(ids)
                starts = at + np.arange(len(ids) - length + 1)
                by_length.setdefault(length, []).append((starts, np.full(len(starts), number[item], np.int32)))
                at += len(ids)
        every = np.concatenate(words) if words else np.zeros(0, np.int32)
        self.searchers = [WuManber(every, np.concatenate([s for s, _ in v]), np.concatenate([i for _, i in v]), n, len(self.ids)) for n, v in sorted(by_length.items())]

    def search(self, texts: list[bytes | None]) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
        """For each text its words, word ranges (start, end exclusive) under occurrences, merged, and the items that occur."""
        get = self.ids.get
        split = [words_of(t) for t in texts]
        counts = [len(w) for w in split]
        # a word of no window stands between texts
        first = np.cumsum([0, *(n + 1 for n in counts)])
        ids = np.zeros(first[-1], np.int32)
        for a, w in zip(first.tolist(), split, strict=False):
            ids[a : a + len(w)] = np.fromiter((get(x, 0) for x in w), np.int32, len(w))
        change = np.zeros(len(ids) + 1, np.int32)
        items: list[set[str]] = [set() for _ in texts]
        for s in self.searchers:
            at, item = s.find(ids)
            np.add.at(change, at, 1)
            np.add.at(change, at + s.length, -1)
            pairs = np.unique(np.stack((np.searchsorted(first, at, "right") - 1, item)), axis=1)
            for k, i in pairs.T.tolist():
                items[k].add(self.names[i])
        edge = np.flatnonzero(np.diff(np.concatenate(([False], np.cumsum(change) > 0)).astype(np.int8)))
        ranges: list[list[tuple[int, int]]] = [[] for _ in texts]
        for a, b, k in zip(edge[0::2].tolist(), edge[1::2].tolist(), (np.searchsorted(first, edge[0::2], "right") - 1).tolist(), strict=True):
            ranges[k].append((a - int(first[k]), b - int(first[k])))
        return counts, ranges, items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _searcher(held):
    """An Arrow function of a text column and the results of the blocks before (or nulls)."""

    def search(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        patterns: Patterns = held.value
        for text, before in batches:
            texts, earlier = text.to_pylist(), before.to_pylist()
            counts, ranges, items = [], [], []
            for i, j in slices(texts):
                n, r, found = patterns.search(texts[i:j])
                for k, b in enumerate(earlier[i:j]):
                    if b is not None and b["n_words"] is not None:
                        r[k] = merged([(x["start"], x["end"]) for x in b["hit_ranges"]] + r[k])
                        found[k] |= set(b["items"])
                counts += n
                ranges += [[{"start": x, "end": y} for x, y in a] for a in r]
                items += map(sorted, found)
            yield pa.StructArray.from_arrays(
                [pa.array(counts, pa.int64()), pa.array(ranges, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(items, pa.list_(pa.string()))],
                ["n_words", "hit_ranges", "items"],
            )
        released()

    # a filter on the result must not be evaluated apart, below the projection
    return F.arrow_udf(search, _TYPE).asNondeterministic()


def runs(text: bytes, most: int, window: int) -> list[bytes]:
    """A text's words in runs of about so many bytes; each window of the text is in one of them, and none holds less than a window."""
    low = text.translate(_KEPT)
    out, start, size = [], 0, most
    while len(low) - start > size:
        end = low.find(b" ", start + size)
        if end < 0 or not low[end:].strip():
            break
        back = end
        for _ in range(window - 1):
            while back > start and low[back - 1] == 32:
                back -= 1
            back = low.rfind(b" ", start, back) + 1 if back > start else start
        if back <= start:  # words so long that the run holds no window yet
            size *= 2
            continue
        out.append(low[start:end])
        start, size = back, most
    return [*out, low[start:]]


def _cut(most: int, window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column("i").to_pylist(), b.column("t").to_pylist(), strict=True):
                parts = [t] if len(t) <= most else runs(t, most, window)
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(parts), pa.string()), pa.array(parts, pa.binary())], ["i", "t"])

    return cut


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int, window: int) -> tuple[int, Iterator[list[tuple[str, bytes | None]]]]:
    """How many blocks, and the items of each, so many bytes of text at a time: the driver never holds more than one."""
    narrow = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.col(text).cast("binary").alias("t")).where(F.octet_length("t") > 0)
    total, longest = narrow.agg(F.sum(F.octet_length("t").cast("long") + 64), F.max(F.octet_length("t"))).first()
    if (longest or 0) > block_bytes // 2:
        narrow = narrow.mapInArrow(_cut(block_bytes // 2, window), "i string, t binary")
        total = narrow.agg(F.sum(F.octet_length("t").cast("long") + 64)).first()[0]
    total = total or 0
    n = max(1, -(-total // block_bytes))
    part = lambda k: narrow.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else narrow
    return n, ([(r["i"], bytes(r["t"])) for r in part(k).distinct().collect()] for k in range(n))


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit, hit_ranges (word ranges, end exclusive) and items (sorted ids as strings)."""
    out = docs.drop(*OUT, "_hits").withColumn("_hits", F.lit(None).cast(_TYPE))
    raw: Column = F.col(text).cast("binary")
    before = None
    many, blocks = _blocks(benchmark, item, item_text, block_bytes, window)
    for block in blocks:
        held = docs.sparkSession.sparkContext.broadcast(Patterns(block, window))
        out = out.withColumn("_hits", _searcher(held)(raw, F.col("_hits")))
        if many > 1:
            out = written(out, "block")
            held.unpersist()
            if before is not None:
                drop_table(before)
            before = out
    h = F.col("_hits")
    hit = F.aggregate(h["hit_ranges"], F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return out.select(*[c for c in out.columns if c != "_hits"], h["n_words"].alias("n_words"), hit.alias("n_hit"), h["hit_ranges"].alias("hit_ranges"), h["items"].alias("items"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any benchmark window, with docs' columns as they are."""
    found = contamination(docs.withColumn("_keep", F.struct(*docs.columns)), benchmark, **options)
    return found.where(F.col("n_hit") == 0).select("_keep.*")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH words AS (
  SELECT doc_id, i, w FROM (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM documents), LATERAL (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS i)),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, n, array_to_string(ws[s:s + n - 1], ' ') AS win FROM (
    SELECT item, ws, least(10, len(ws)) AS n FROM items WHERE len(ws) > 0), LATERAL (SELECT unnest(generate_series(1, len(ws) - n + 1)) AS s)),
lengths AS (SELECT DISTINCT n FROM windows),
docs AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
spots AS (
  SELECT doc_id, n, s, array_to_string(ws[s:s + n - 1], ' ') AS win FROM docs, lengths, LATERAL (SELECT unnest(generate_series(1, len(ws) - n + 1)) AS s)),
hits AS (SELECT DISTINCT doc_id, s, p.n AS n, item FROM spots p JOIN windows v ON p.win = v.win AND p.n = v.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, LATERAL (SELECT unnest(generate_series(s, s + n - 1)) AS p) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.ws), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
