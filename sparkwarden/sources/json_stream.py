"""The elements of arrays in JSON documents of any size, as rows.

A document of many gigabytes is one value, often on one line, so no reader of lines or of whole files can cut it. Here Spark's text reader
cuts it at every closing brace, which can be done from any place in a file. What a brace means depends on
all that is before it: how deep it is, and whether it stands in a string. A first pass tells for each block of a file how it changes both, from either
beginning (in a string or not); these few numbers, one pair a block, give each block's beginning, and a second pass
cuts out the elements. An element that spans blocks comes in parts, which are put together at the end. A task holds one element at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_QUOTE, _SLASH = ord('"'), ord("\\")
_CHANGE = np.zeros(256, np.int8)
_CHANGE[[ord("{"), ord("[")]] = 1
_CHANGE[[ord("}"), ord("]")]] = -1


def _strings(buf: np.ndarray) -> np.ndarray:
    """How many quotes that begin or end a string are before each byte, and in all."""
    quotes = buf == _QUOTE
    slashes = buf == _SLASH
    if slashes.any():
        # a quote after an odd run of backslashes is a character
        place = np.arange(len(buf))
        last = np.maximum.accumulate(np.where(slashes, -1, place))
        run = place - 1 - np.concatenate(([-1], last[:-1]))
        quotes &= run % 2 == 0
    return np.concatenate(([0], np.cumsum(quotes)))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes]]:
    """Runs of text of one block, with the braces that the reader took."""
    for b in batches:
        at = list(zip(b.column("file").to_pylist(), b.column("block").to_pylist(), strict=True))
        texts = b.column("value").to_pylist()
        i = 0
        while i < len(at):
            j = i
            while j < len(at) and at[j] == at[i]:
                j += 1
            yield at[i], b"}".join(texts[i:j]) + b"}"
            i = j


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block and either beginning: whether it ends in a string, and the change of depth."""
    out: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for key, text in _blocks(batches):
        buf = np.frombuffer(text, np.uint8)
        count, change = _strings(buf), _CHANGE[buf]
        effect = out.setdefault(key, [(0, 0), (1, 0)])
        for start, (inside, depth) in enumerate(effect):
            free = (count[:-1] + inside) % 2 == 0
            effect[start] = ((inside + int(count[-1])) % 2, depth + int(change[free].sum()))
    rows = [(f, b, s, i, d) for (f, b), e in out.items() for s, (i, d) in enumerate(e)]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["file", "block", "start", "inside", "depth"])


def _cutter(begins, level: int):
    """Elements whose brace goes from depth `level` to the next: whole ones, and parts at a block's ends."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[bytes] = []  # an element's text so far
        now, inside, depth, kind, order = None, 0, 0, "whole", 0
        out: list[tuple] = []

        def told() -> pa.RecordBatch:
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate([pa.string(), pa.int64(), pa.int32(), pa.string(), pa.binary()])]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["file", "block", "nth", "kind", "json"])

        for key, text in _blocks(batches):
            if key != now:
                if open_:
                    out.append((*now, order, "inner" if kind == "last" else "first", b"".join(open_)))
                now, order = key, 0
                inside, depth = begins.value[key]
                open_, kind = [], "last" if depth > level else "whole"
                holds = depth > level
            buf = np.frombuffer(text, np.uint8)
            count = _strings(buf)
            change = np.where((count[:-1] + inside) % 2 == 0, _CHANGE[buf], 0)
            deep = depth + np.cumsum(change, dtype=np.int64)
            places = np.flatnonzero((change == 1) & (deep == level + 1) | (change == -1) & (deep == level))
            at = 0
            for p in places.tolist():
                if change[p] == 1:
                    at, holds = p, True
                elif holds:
                    out.append((*now, order, kind, b"".join([*open_, text[at : p + 1]])))
                    open_, kind, order, holds = [], "whole", order + 1, False
            if holds:
                open_.append(text[at:])
            inside, depth = (inside + int(count[-1])) % 2, int(deep[-1])
            if len(out) >= 1000:
                yield told()
        if open_:
            out.append((*now, order, "inner" if kind == "last" else "first", b"".join(open_)))
        yield told()

    return cut


def read_elements(spark: SparkSession, path: str, level: int = 2) -> DataFrame:
    """Rows (json): the objects and arrays `level` brackets deep in the documents at path; 2 is an element of an array in an object."""
    rows = spark.read.option("lineSep", "}").text(path)
    pieces = rows.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    effects: dict[tuple[str, int], dict[int, tuple[int, int]]] = {}
    for r in pieces.mapInArrow(_effects, "file string, block long, start int, inside int, depth long").collect():
        effects.setdefault((r["file"], r["block"]), {})[r["start"]] = (r["inside"], r["depth"])
    begins, file, inside, depth = {}, None, 0, 0
    for f, b in sorted(effects):
        if f != file:
            file, inside, depth = f, 0, 0
        begins[f, b] = (inside, depth)
        end, change = effects[f, b][inside]
        inside, depth = end, depth + change
    cut = pieces.mapInArrow(_cutter(spark.sparkContext.broadcast(begins), level), "file string, block long, nth int, kind string, json binary")
    whole = cut.where("kind = 'whole'").select(F.col("json").cast("string").alias("json"))
    # few rows: at most two a block
    parts = cut.where("kind <> 'whole'")
    by = W.partitionBy("file").orderBy("block", "nth")
    parts = parts.withColumn("element", F.count_if(F.col("kind") == "first").over(by.rowsBetween(W.unboundedPreceding, 0)))
    order = F.struct("block", "nth", F.col("json").alias("x"))
    joined = parts.groupBy("file", "element").agg(F.array_sort(F.collect_list(order)).alias("all"), F.bool_or(F.col("kind") == "last").alias("ended")).where("ended")
    return whole.unionByName(joined.select(F.array_join(F.transform("all", lambda p: p["x"].cast("string")), "").alias("json")))
