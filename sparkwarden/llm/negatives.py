"""Hard negatives by a vector-approximation file: bounds on scores from cells, exact scores for the rest.

Components are whole numbers. Each dimension is cut into cells, fewer where values are rare; a row's approximation is its
cells, two in a byte. For an anchor, a table gives the least and the greatest product of its component with any value of a
cell, for two dimensions at a time, so the sum of half as many look-ups as there are dimensions bounds a score. Only rows whose
bounds may enter an anchor's list of positives, or a window of a positive's negatives, are scored exactly; a list that is full
raises the bound that later rows must reach.

The file (approximations beside vectors) is written once. Anchors are taken BLOCK at a time (fewer of long vectors), whatever their number: a block is
broadcast and the file is scanned twice for it, for positives and then for negatives, and no row is shuffled. A task returns at
most `positives` or `negatives` rows for each list, of which a window keeps the best. Bounds to begin with come from a
sample of SAMPLE rows, as do the cells' borders; both affect speed alone, since cells at the ends reach to the least and
greatest value of all rows.

Defined cases: rows with a null id, label or vector, or a null or non-finite component, take no part; an empty or shorter
vector counts as padded with zeros; equal rows count once, unlike rows of one id each, and none is a partner of its own id; equal
scores are ordered by id; an anchor without positives or a window without rows gives no rows; an empty table gives none;
other columns are not read. Scores must fit 63 bits, otherwise a ValueError says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import drop_table, scratch_path, table, written

#: Bits of a cell's number (two share a byte), anchors that are broadcast at once, and rows that set borders and first bounds.
BITS, BLOCK, SAMPLE = 4, 16_384, 2048
#: Rows that a task holds, anchors whose tables it holds, rows whose bounds it holds, and pairs that are scored at once, at most.
HELD, TABLES, STEP, PAIRS = 65_536, 256, 1024, 16_384
#: Bytes of vectors, and of tables, that a task holds, and of anchors that are broadcast, at most: fewer rows of longer vectors.
HELD_BYTES, TABLE_BYTES, BLOCK_BYTES = 32 << 20, 32 << 20, 16 << 20

CELLS = 1 << BITS
LEAST = np.iinfo(np.int64).min


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("vector")
        values = lists.flatten().to_numpy(zero_copy_only=False)
        if len(values) and np.abs(values).max() >= 2**31:
            raise ValueError("a component is too large: scores must fit 63 bits")
        ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy()))) * 4
        packed = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values.astype(np.int32))])
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), packed], ["id", "label", "vector"])


def _matrix(column: pa.Array, dims: int | None = None) -> np.ndarray:
    """Vectors of a binary column as rows, padded with zeros."""
    each = column.to_pylist()
    dims = max((len(x) // 4 for x in each), default=0) if dims is None else dims
    return np.frombuffer(b"".join(x.ljust(4 * dims, b"\0") for x in each), np.int32).reshape(len(each), dims)


def _extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    low = high = np.zeros(0, np.int64)
    for b in batches:
        m = _matrix(b.column("vector"))
        if len(m):
            size = max(m.shape[1], len(low))
            grow = lambda x, n=size: np.pad(x, (0, n - len(x))).astype(np.int64)
            low, high = np.minimum(grow(low), grow(m.min(0))), np.maximum(grow(high), grow(m.max(0)))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low)), pa.int32()), pa.array(low), pa.array(high)], ["dim", "low", "high"])


class Grid:
    """Cells of each dimension: values from low to high, cut where the square root of the sample's density has equal parts."""

    def __init__(self, sample: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.dims = len(low)
        edges = np.empty((self.dims, CELLS - 1), np.int64)
        for d in range(self.dims):
            counts, at = np.histogram(sample[:, d], bins=8 * CELLS, range=(float(low[d]), float(high[d]) + 1))
            part = np.concatenate(([0], np.cumsum(np.sqrt(counts + 1e-3))))
            edges[d] = np.clip(np.ceil(np.interp(np.arange(1, CELLS) / CELLS * part[-1], part, at)), low[d], high[d])
        self.edges = edges
        self.low = np.concatenate((low[:, None], edges), axis=1)
        self.high = np.maximum(np.concatenate((edges - 1, high[:, None]), axis=1), self.low)

    def cells(self, m: np.ndarray) -> np.ndarray:
        """Two cells in a byte, for each row of vectors."""
        each = np.zeros((len(m), self.dims + self.dims % 2), np.uint8)
        for d in range(self.dims):
            each[:, d] = np.searchsorted(self.edges[d], m[:, d], side="right")
        return each[:, 0::2] << BITS | each[:, 1::2]

    def tables(self, anchors: np.ndarray, upper: bool) -> np.ndarray:
        """For each two dimensions, cells of both and anchor, the greatest (or least) sum of products."""
        a = anchors.astype(np.int64)[:, :, None]
        product = np.where((a >= 0) == upper, a * self.high, a * self.low)
        if self.dims % 2:
            product = np.concatenate((product, np.zeros((len(a), 1, CELLS), np.int64)), axis=1)
        one, two = product[:, 0::2], product[:, 1::2]
        both = (one[:, :, :, None] + two[:, :, None, :]).reshape(len(a), -1, CELLS * CELLS)
        fits = np.abs(product).max(initial=0) * max(1, self.dims) < 2**31
        return np.ascontiguousarray(both.transpose(1, 2, 0).astype(np.int32 if fits else np.int64))


def bounds(tables: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The sums of the tables' entries at each row's cells: rows by anchors."""
    out = np.zeros((len(cells), tables.shape[2]), tables.dtype)
    for t, at in zip(tables, cells.T, strict=True):
        out += t.take(at, axis=0)
    return out


def _at_once(dims: int) -> tuple[int, int]:
    """Anchors whose tables, and rows whose vectors, a task holds."""
    dims = max(1, dims)
    return max(1, min(TABLES, TABLE_BYTES // (4 * CELLS * CELLS * dims))), max(1, min(HELD, HELD_BYTES // (4 * dims)))


def scores(one: np.ndarray, two: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows i of one and j of two."""
    out = np.empty(len(i), np.int64)
    for a in range(0, len(i), PAIRS):
        out[a : a + PAIRS] = np.einsum("ij,ij->i", one[i[a : a + PAIRS]].astype(np.int64), two[j[a : a + PAIRS]].astype(np.int64))
    return out


class Best:
    """For each list its best `size` rows, by score and then the smaller id, and the score that a row must reach to enter."""

    def __init__(self, floor: np.ndarray, size: int):
        self.floor, self.size = floor.copy(), size
        self.score = np.full((len(floor), size), LEAST, np.int64)
        self.id = np.zeros((len(floor), size), np.int64)

    def add(self, lists: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(lists):
            return
        touched = np.unique(lists)
        lists = np.concatenate((lists, np.repeat(touched, self.size)))
        score, ids = np.concatenate((score, self.score[touched].ravel())), np.concatenate((ids, self.id[touched].ravel()))
        order = np.lexsort((ids, -np.maximum(score, LEAST + 1), lists))
        lists, score, ids = lists[order], score[order], ids[order]
        first = np.searchsorted(lists, touched)
        rank = np.arange(len(lists)) - np.repeat(first, np.diff(np.append(first, len(lists))))
        keep = rank < self.size
        self.score[lists[keep], rank[keep]], self.id[lists[keep], rank[keep]] = score[keep], ids[keep]
        self.floor[touched] = np.maximum(self.floor[touched], self.score[touched, -1])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, place = np.nonzero(self.score != LEAST)
        return at, self.score[at, place], self.id[at, place]


def _kth(values: np.ndarray, ok: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest value of each row among those that are ok; LEAST if there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), LEAST, np.int64)
    v = np.where(ok, values, -np.inf)
    kth = np.partition(v, v.shape[1] - k, axis=1)[:, v.shape[1] - k]
    return np.where(np.isfinite(kth), kth, LEAST).astype(np.int64)


def _held(batches: Iterator[pa.RecordBatch], dims: int):
    """Ids, labels, vectors and cells of so many rows (and a batch) at a time."""
    some, n, most = [], 0, _at_once(dims)[1]
    for b in batches:
        some.append(b)
        n += b.num_rows
        if n >= most:
            yield _opened(some, dims)
            some, n = [], 0
    if n:
        yield _opened(some, dims)


def _opened(some: list[pa.RecordBatch], dims: int):
    t = pa.Table.from_batches(some).combine_chunks()
    cells = np.frombuffer(b"".join(t.column("cells").to_pylist()), np.uint8).reshape(t.num_rows, -1 if dims else 0)
    return t.column("id").to_numpy(), t.column("label").to_numpy(), _matrix(t.column("vector"), dims), cells


def _positives(shared, size: int):
    """Candidates of an anchor's positives, by task: rows of its label whose upper bound reaches the list's floor."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid, own = shared.value["grid"], shared.value
        best, many = Best(own["floor"], size), _at_once(grid.dims)[0]
        by_label = np.argsort(own["label"], kind="stable")
        sorted_labels = own["label"][by_label]
        for ids, labels, vectors, cells in _held(batches, grid.dims):
            order = np.argsort(labels, kind="stable")
            for label in np.intersect1d(labels, sorted_labels):
                rows = order[slice(*np.searchsorted(labels[order], (label, label + 1)))]
                anchors = by_label[slice(*np.searchsorted(sorted_labels, (label, label + 1)))]
                for i in range(0, len(anchors), many):
                    at = anchors[i : i + many]
                    tables = grid.tables(own["vector"][at], True)
                    for j in range(0, len(rows), STEP):
                        r = rows[j : j + STEP]
                        x, y = np.nonzero((bounds(tables, cells[r]) >= best.floor[at]) & (ids[r][:, None] != own["id"][at]))
                        x, y = r[x], at[y]
                        s = scores(vectors, own["vector"], x, y)
                        ok = s >= best.floor[y]
                        best.add(y[ok], s[ok], ids[x[ok]])
        at, score, found = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(score), pa.array(found)], ["anchor", "score", "id"])

    return search


def _negatives(shared, size: int):
    """Candidates of the windows, by task: rows of other labels whose bounds meet a window above its floor."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid, own = shared.value["grid"], shared.value
        low, high, window = own["low"], own["high"], own["window"]
        best, many = Best(np.maximum(own["floor"], low), size), _at_once(grid.dims)[0]
        has = np.flatnonzero((window >= 0).any(1))
        for ids, labels, vectors, cells in _held(batches, grid.dims):
            for i in range(0, len(has), many):
                at = has[i : i + many]
                uppers, lowers = grid.tables(own["vector"][at], True), grid.tables(own["vector"][at], False)
                w = window[at]
                most = np.where(w >= 0, high[w], LEAST).max(1)
                for j in range(0, len(ids), STEP):
                    part = slice(j, j + STEP)
                    least = np.where(w >= 0, best.floor[w], np.iinfo(np.int64).max).min(1)
                    may = (bounds(uppers, cells[part]) >= least) & (bounds(lowers, cells[part]) <= most)
                    x, y = np.nonzero(may & (labels[part][:, None] != own["label"][at]) & (ids[part][:, None] != own["id"][at]))
                    x, y = x + j, at[y]
                    s = scores(vectors, own["vector"], x, y)
                    for k in range(window.shape[1]):
                        to = window[y, k]
                        ok = (to >= 0) & (s >= best.floor[to]) & (s <= high[to])
                        best.add(to[ok], s[ok], ids[x[ok]])
        at, score, found = best.rows()
        named = {n: own[n][at] for n in ("anchor_id", "positive_id", "positive_score")}
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(v) for v in named.values()), pa.array(found), pa.array(score)], ["list", *named, "negative_id", "negative_score"])

    return search


def _ranked(df: DataFrame, by: str, score: str, key: str, size: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.col(score).desc(), key))
    return df.withColumn("rank", rank).where(F.col("rank") <= size)


class VectorFile:
    """Rows (id, label, vector of whole numbers) beside their approximations, written in the shared folder."""

    def __init__(self, rows: DataFrame):
        self.spark = rows.sparkSession
        packed = rows.select("id", "label", "vector").mapInArrow(_pack, "id long, label long, vector binary").distinct()
        plain = written(packed, "vectors")
        ends = plain.mapInArrow(_extremes, "dim int, low long, high long").groupBy("dim").agg(F.min("low"), F.max("high")).orderBy("dim").toArrow()
        low, high = ends.column(1).to_numpy(), ends.column(2).to_numpy()
        if sum(max(a * a, b * b) for a, b in zip(low.tolist(), high.tolist(), strict=True)) >= 2**62:
            raise ValueError("a component is too large: scores must fit 63 bits")
        sample = plain.orderBy(F.xxhash64("id", "vector"), "id", "vector").limit(SAMPLE).toArrow()
        self.sample = {"id": sample.column("id").to_numpy(), "label": sample.column("label").to_numpy(), "vector": _matrix(sample.column("vector"), len(low)).astype(np.float64)}
        self.grid = Grid(self.sample["vector"], low, high)
        self.exact_floats = np.square(np.maximum(-low, high).astype(np.float64)).sum() < 2**52
        shared = self.spark.sparkContext.broadcast(self.grid)

        def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cells = shared.value.cells(_matrix(b.column("vector"), shared.value.dims))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x.tobytes() for x in cells], pa.binary())], [*b.schema.names, "cells"])

        self.rows = written(plain.mapInArrow(approximate, "id long, label long, vector binary, cells binary"), "approximations")
        drop_table(plain)

    def _floors(self, own: dict, positives: int) -> np.ndarray:
        """The k-th best score of each anchor among the sample's rows of its label."""
        out = np.full(len(own["id"]), LEAST, np.int64)
        if self.exact_floats:
            for a in range(0, len(out), TABLES):
                s = own["vector"][a : a + TABLES] @ self.sample["vector"].T
                ok = (own["label"][a : a + TABLES, None] == self.sample["label"]) & (own["id"][a : a + TABLES, None] != self.sample["id"])
                out[a : a + TABLES] = _kth(s, ok, positives)
        return out

    def _window_floors(self, own: dict, negatives: int) -> np.ndarray:
        out = np.full(len(own["low"]), LEAST, np.int64)
        if self.exact_floats:
            for a in range(0, len(own["id"]), TABLES):
                s = own["vector"][a : a + TABLES] @ self.sample["vector"].T
                other = (own["label"][a : a + TABLES, None] != self.sample["label"]) & (own["id"][a : a + TABLES, None] != self.sample["id"])
                for k in range(own["window"].shape[1]):
                    w = own["window"][a : a + TABLES, k]
                    has = w >= 0
                    inside = other[has] & (s[has] >= own["low"][w[has], None]) & (s[has] <= own["high"][w[has], None])
                    out[w[has]] = _kth(s[has], inside, negatives)
        return out

    def search(self, block: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame | None:
        """The negatives for one block of anchors (id, label, vector)."""
        t, sc = block.toArrow(), self.spark.sparkContext
        own = {"id": t.column("id").to_numpy(), "label": t.column("label").to_numpy(), "vector": _matrix(t.column("vector"), self.grid.dims), "grid": self.grid}
        own["floor"] = self._floors(own, positives)
        shared = sc.broadcast(own)
        found = self.rows.mapInArrow(_positives(shared, positives), "anchor long, score long, id long")
        p = _ranked(found, "anchor", "score", "id", positives).orderBy("anchor", "rank").toArrow()
        shared.destroy()
        anchor, rank, score = (p.column(c).to_numpy() for c in ("anchor", "rank", "score"))
        own |= {"anchor_id": own["id"][anchor], "positive_id": p.column("id").to_numpy(), "positive_score": score}
        own |= {"low": -(-low * score // 100), "high": high * score // 100}
        own["window"] = np.full((len(own["id"]), positives), -1, np.int64)
        real = np.flatnonzero(own["low"] <= own["high"])
        if not len(real):
            return None
        own["window"][anchor[real], rank[real] - 1] = real
        own["floor"] = self._window_floors(own, negatives)
        lists = self.rows.mapInArrow(_negatives(sc.broadcast(own), negatives), "list long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
        return _ranked(lists, "list", "negative_score", "negative_id", negatives).drop("list")


_EMPTY = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long, rank int"


def mined(df: DataFrame, anchors: Column, key: str = "vec_id", label: str | Column = "label", vector: str = "embedding", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, block: int = BLOCK) -> DataFrame:
    """For the rows of df that `anchors` (a condition on df's columns) chooses and each of their first positives of equal label, the
    first negatives of other labels whose score is from low to high percent of the positive's. Components are floor(scale * x)."""
    v = F.col(vector)
    whole = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    label = F.col(label) if isinstance(label, str) else label
    rows = df.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("vector"), F.coalesce(anchors, F.lit(False)).alias("anchor"), whole.alias("whole"))
    rows = rows.where("whole and id is not null and label is not null")
    file = VectorFile(rows)
    chosen = rows.where("anchor").select("id", "label", "vector").mapInArrow(_pack, "id long, label long, vector binary").distinct()
    chosen = written(chosen, "anchors")
    block = max(1, min(block, BLOCK_BYTES // (4 * max(1, file.grid.dims))))
    blocks = -(-chosen.count() // block)
    number = F.pmod(F.xxhash64("id", "label", "vector"), F.lit(max(1, blocks)))
    if blocks == 1:
        out = file.search(chosen, positives, negatives, low, high)
        return out if out is not None else df.sparkSession.createDataFrame([], _EMPTY)
    path = scratch_path(df.sparkSession, "negatives")
    df.sparkSession.createDataFrame([], _EMPTY).write.parquet(path)
    for n in range(blocks):
        out = file.search(chosen.where(number == n), positives, negatives, low, high)
        if out is not None:
            out.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(_EMPTY).parquet(path)


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    out = mined(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
