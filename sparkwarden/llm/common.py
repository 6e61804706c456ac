"""Shared pieces: table access, shared scratch tables, skew-safe lookups, text buffers."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.plans.tables import shared_folder

#: Rows a lookup side may have before it is joined by shuffle and not by broadcast.
BROADCAST_ROWS = 200_000

#: Tables after which the driver drops what it holds of queries that are over.
TABLES = 20

_roots: dict[str, str] = {}
_tables: dict[str, int] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which driver and executors share."""
    sc = spark.sparkContext
    if sc.applicationId not in _roots:
        root = f"{shared_folder(spark)}/sparkwarden-{uuid.uuid4().hex}"
        _roots[sc.applicationId] = root
        atexit.register(_remove, spark, root)
    return _roots[sc.applicationId]


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """While this lasts, Python gets at most so many rows at once: for steps that are run in it, on texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared scratch folder: lineage ends here, and lost executors re-read it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    _tidied(spark)
    return spark.read.schema(df.schema).parquet(path)


def _tidied(spark: SparkSession) -> None:
    """Broadcast relations and shuffles of queries that are over are freed only when the driver collects garbage; here it does so regularly."""
    of = spark.sparkContext.applicationId
    _tables[of] = _tables.get(of, 0) + 1
    if _tables[of] % TABLES == 0:
        spark.sparkContext._jvm.System.gc()


def drop_table(df: DataFrame) -> None:
    """Remove the files of a table made by written() that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, folder)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count proves it has at most so many rows, else as it is (shuffle join)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, shares: int = 1000) -> DataFrame:
    """left join right on key (unique in right), safe when one key holds a large part of left.

    weight: right's column with left's rows for the key; total: left's rows. Keys with more than total / shares
    rows number fewer than `shares`, so they are broadcast; all other keys are small and are joined by shuffle.
    """
    limit = max(total // shares, 1000)
    hot = right.where(F.col(weight) > limit).drop(weight)
    keys = hot.select(F.col(key).alias("_hot"))
    marked = left.join(F.broadcast(keys), left[key].eqNullSafe(F.col("_hot")), "left")
    on_hot = marked.where(F.col("_hot").isNotNull()).drop("_hot").join(F.broadcast(hot), key)
    rest = marked.where(F.col("_hot").isNull()).drop("_hot").join(right.where(F.col(weight) <= limit).drop(weight), key, "left")
    return on_hot.unionByName(rest)


_caches: dict[str, Callable[[], None]] = {}


def cached_by(name: str, clear: Callable[[], None]) -> None:
    """Name what this process keeps from task to task of one operator, and how to drop it."""
    _caches[name] = clear


def released(keep: str = "") -> None:
    """Drop what operators other than `keep` have kept, and give memory that this process has freed back to the machine: reused workers keep it from the next stage otherwise."""
    import ctypes
    import gc

    import pyarrow as pa

    for name, clear in _caches.items():
        if name != keep:
            clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has this call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(values: list, most_bytes: int = 4 << 20):
    """Runs (start, stop) of values that hold about so many bytes; one long value is a run of its own."""
    start = size = 0
    for i, v in enumerate(values):
        n = len(v) if v is not None else 0
        if size and size + n > most_bytes:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(values):
        yield start, len(values)


def _space_table() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[0x20, 9, 10, 11, 12, 13]] = True
    return t


SPACE = _space_table()
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers (shift, multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Bytes that are hashed at once (cut at white space, so a longer word is taken whole), and powers that are kept.
CHUNK, KEPT_POWERS = 1 << 20, 1 << 22


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64 for i < n, kept for the next call if they are few."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    m = 1 << int(n - 1).bit_length()
    out = []
    for b in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64))):
        steps = np.full(m, b, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    if m <= KEPT_POWERS:
        _powers[:] = out
    return out[0][:n], out[1][:n]


def _chunks(buf: np.ndarray):
    """Runs (start, stop) of about CHUNK bytes that end after white space; the buffer ends with some."""
    a = 0
    while a < len(buf):
        b = min(a + CHUNK, len(buf))
        while b < len(buf):
            gap = np.flatnonzero(SPACE[buf[b - 1 : b - 1 + CHUNK]])
            if len(gap):
                b += int(gap[0])
                break
            b = min(b + CHUNK, len(buf))
        yield a, b
        a = b


def words_hashed(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of the texts: buffer, starts, ends, 64-bit hashes, and per text the first word's index.

    Hashes are polynomials over the bytes, by a prefix sum for each chunk of the buffer, then mixed; they do not depend on
    a word's place, so long texts are cut between words, and take memory in proportion to their words.
    """
    joined = b"\n".join(t or b"" for t in texts) + b"\n"
    buf = np.frombuffer(joined, np.uint8)
    parts = []
    for a, b in _chunks(buf):
        part = buf[a:b]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], SPACE[part])).view(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        up, down = _power(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=total[1:])
        parts.append((starts + a, ends + a, mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))))
    starts, ends, hashes = (np.concatenate([p[i] for p in parts]) for i in range(3))
    lengths = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    first = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))
    return buf, starts, ends, hashes, first


def rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n following words (len(hashes) - n + 1 of them)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, n, np.uint64)
    for i in range(n):
        out = (out + hashes[i : i + m]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed(out)


def excerpt(text, most: int, pieces: int = 16):
    """A text of up to `most` bytes as it is; of a longer one, pieces from all over it, `most` characters at most, that begin and end between words."""
    n = F.length(text)
    cut = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: F.substring(text, F.floor(i * n / pieces).cast("int") + 1, F.lit(most // pieces)))
    whole = F.transform(cut, lambda x: F.when(x.rlike(r"\s"), F.regexp_replace(x, r"^\S+|\S+$", "")).otherwise(x))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.array_join(whole, "\n"))


def bounded_sample(df: DataFrame, key: str, by: str, per_value) -> DataFrame:
    """At most about per_value (a number, or a column of `by`) rows for each value of `by`, chosen by a hash of key; all of a value that has fewer."""
    counts = small(df.groupBy(by).count().withColumnRenamed("count", "_rows"))
    draw = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30)) / float(1 << 30)
    return df.join(counts, by).where(draw * F.col("_rows") < per_value).drop("_rows")


def fold(key: str, folds: int = 5):
    """crc32 of the key as text, modulo folds; a null key counts as the empty string."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds
