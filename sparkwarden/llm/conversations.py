"""Prefix trie of conversations by a mergesort that knows common prefixes.

A conversation is the sequence of its turns' 128-bit hashes (role and text), 16 bytes each. Spark deals sequences to ranges of
about ROWS in the order (sequence, conversation), so a sequence that many conversations share may span ranges. A range's batches are
sorted runs that carry each member's longest common prefix (LCP, in turns) with the one before; a tree of losers merges
them. Of two heads the one with the longer LCP with the last output comes first, and only heads with equal LCPs are compared,
from there on, so no shared turn is compared twice. The merged stream, with its LCPs, drives a stack of the open path: a node is
finished when a sequence leaves it, and goes out with its counts, which are added to its parent's.

Nodes on a range's first or last path may go on in its neighbours. They go out as two records, a path with what each of its nodes
got from finished children and own members. Records are sequences like conversations, so the same merge takes them, ROWS at a
time, until one range is left, which finishes all: each level has a thousandth of the rows of the one below. The conversations
that end at such a node are texts of ids by range, in ascending order, which one pass over each node's texts digests as a stream.

Defined cases: rows with a null conversation id take no part; a null role or text is empty; turns that have equal numbers are
ordered by their hashes; repeated rows are turns of their own; very long texts are hashed in Spark and never gathered; a
conversation's hashes (16 bytes a turn) are held by one task, however many conversations share them; an empty table gives no nodes; columns
other than these four are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, small, table, written

#: Sequences in a range (and records that the last level takes at once), bytes of a turn's hash, rows of an output batch.
ROWS, TURN, BATCH = 8192, 16, 4096
#: Turns that a rebuilt conversation takes from its base at most, less one, and conversations to a base.
HEADS, FAMILY = 4, 20

NONE = (1 << 63) - 1
_NODE = ["depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_PATH = ["members", "least", "children", "leaves", "saved"]
_LONGS = pa.list_(pa.int64())
_TYPES = {
    "kind": pa.string(), **{n: pa.int64() for n in _NODE[:-1]}, "ends_sha256": pa.string(), "key": pa.binary(), "parent_conv_id": pa.int64(), "parent_key": pa.binary(),
    "path": pa.binary(), "words": _LONGS, **{n: _LONGS for n in _PATH}, "first": pa.int64(), "ids": pa.string(),
}
_SCHEMA = ", ".join(f"{n} {({pa.int64(): 'long', pa.string(): 'string', pa.binary(): 'binary', _LONGS: 'array<long>'})[t]}" for n, t in _TYPES.items())


def shared_turns(a: bytes, b: bytes, known: int) -> int:
    """Turns that a and b begin with alike; the first `known` are."""
    most = min(len(a), len(b)) // TURN
    while known < most and a[known * TURN : (known + 1) * TURN] == b[known * TURN : (known + 1) * TURN]:
        known += 1
    return known


class Run:
    """A batch of sequences in order, each with its LCP with the one before. A sequence is (path, tie, words, parts)."""

    def __init__(self, members: list[tuple]):
        self.members = sorted(members, key=lambda m: m[:2])
        self.lcps = [0] + [shared_turns(a[0], b[0], 0) for a, b in zip(self.members, self.members[1:], strict=False)]


def merged(runs: list[Run]) -> Iterator[tuple[tuple, int]]:
    """The members of all runs in order, each with its LCP with the one before, by a tree of losers."""
    runs = [r for r in runs if r.members]
    if not runs:
        return
    n = len(runs)
    at, lcp, losers = [0] * n, [0] * n, [-1] * n

    def winner(a: int, b: int) -> tuple[int, int]:
        """Which of two runs' heads is first, and the other, whose LCP is then with this one."""
        if a < 0 or b < 0:
            return (b, a) if a < 0 else (a, b)
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        one, two = runs[a].members[at[a]], runs[b].members[at[b]]
        common = shared_turns(one[0], two[0], lcp[a])
        here = slice(common * TURN, (common + 1) * TURN)
        if (one[0][here], one[1]) > (two[0][here], two[1]):
            a, b = b, a
        lcp[b] = common
        return a, b

    def played(i: int) -> int:
        """The winner below inner node i; runs are the leaves n to 2 n - 1."""
        if i >= n:
            return i - n
        first, losers[i] = winner(played(2 * i), played(2 * i + 1))
        return first

    best = played(1) if n > 1 else 0
    while best >= 0:
        yield runs[best].members[at[best]], lcp[best]
        at[best] += 1
        new, i = best, (best + n) // 2
        if at[best] < len(runs[best].members):
            lcp[best] = runs[best].lcps[at[best]]
        else:
            new = -1
        while i >= 1 and n > 1:
            new, losers[i] = winner(new, losers[i])
            i //= 2
        best = new


class _Node:
    __slots__ = ("children", "ends", "key", "leaves", "least", "members", "saved", "waiting", "words")

    def __init__(self, words: int, key):
        self.words, self.key = words, key
        self.members = self.children = self.leaves = self.saved = 0
        self.least, self.ends, self.waiting = NONE, [], []


class Climb:
    """The open path over a merged stream. `last`: no other range exists, so all nodes are finished here; `base`: members are conversations."""

    def __init__(self, last: bool, base: bool):
        self.last, self.base = last, base
        self.stack: list[_Node] = []
        self.out: list[dict] = []
        self.path = None
        self.first_open = -1  # nodes of the first path that are still open, less one
        self.first: dict[int, _Node] = {}

    def _keys(self, path: bytes) -> list[bytes]:
        h, out = hashlib.md5(), []
        for d in range(len(path) // TURN + 1):
            out.append(h.digest())
            h.update(path[d * TURN : (d + 1) * TURN])
        return out

    def feed(self, member: tuple, lcp: int) -> None:
        path, tie, words, parts = member
        while len(self.stack) - 1 > lcp:
            self._pop()
        for d in range(len(self.stack), len(path) // TURN + 1):
            key = None
            if not self.base:
                key = self.stack[-1].key.copy() if d else hashlib.md5()
                key.update(path[(d - 1) * TURN : d * TURN] if d else b"")
            self.stack.append(_Node(words[d - 1] if d else 0, key))
        if self.path is None:
            self.first_path, self.first_words, self.first_open = path, words, len(self.stack) - 1
        self.path, self.path_words = path, words
        if self.base:
            self._add(self.stack[-1], 1, tie, 0, 0, 0)
            self.stack[-1].ends.append(tie)
        else:
            for node, values in zip(self.stack, zip(*parts, strict=True), strict=True):
                self._add(node, *values)

    @staticmethod
    def _add(node: _Node, members: int, least: int, children: int, leaves: int, saved: int) -> None:
        node.members += members
        node.least = min(node.least, least)
        node.children += children
        node.leaves += leaves
        node.saved += saved

    def _pop(self) -> None:
        depth, node = len(self.stack) - 1, self.stack.pop()
        if depth <= self.first_open and not self.last:
            self.first[depth] = node
            self.first_open = depth - 1
            return
        self.first_open = min(self.first_open, depth - 1)
        leaves, saved = node.leaves or 1, node.saved + (node.members - 1) * node.words
        row = {"kind": "node", "depth": depth, "conv_id": node.least, "n_convs": node.members, "n_children": node.children, "n_leaves": leaves, "saved_tokens": saved}
        if self.base:
            row["ends_sha256"] = hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest()
        else:
            row["key"] = node.key.digest()
        if self.stack:
            self._add(self.stack[-1], node.members, node.least, 1, leaves, saved)
            self.stack[-1].waiting.append(row)
        else:
            self.out.append(row)
        for child in node.waiting:
            child["parent_conv_id"] = node.least
        self.out += node.waiting

    def _record(self, path: bytes, words: list[int], nodes: dict[int, _Node]) -> None:
        """A path whose nodes have parts of their counts, and what waits for its nodes."""
        keys, depths = self._keys(path), range(len(path) // TURN + 1)
        part = lambda name, none: [getattr(nodes[d], name) if d in nodes else none for d in depths]
        self.out.append({"kind": "path", "path": path, "words": list(words), **{n: part(n, NONE if n == "least" else 0) for n in _PATH}})
        for d, node in nodes.items():
            for child in node.waiting:
                child["parent_key"] = keys[d]
            self.out += node.waiting
            if node.ends:
                self.out.append({"kind": "ends", "key": keys[d], "first": node.ends[0], "ids": ",".join(map(str, node.ends))})

    def finish(self) -> None:
        if self.path is None:
            return
        if self.last:
            while self.stack:
                self._pop()
            return
        if self.first:
            self._record(self.first_path, self.first_words, self.first)
        self._record(self.path, self.path_words, dict(enumerate(self.stack)))

    def batches(self, all_: bool) -> Iterator[pa.RecordBatch]:
        while len(self.out) >= BATCH or all_ and self.out:
            some, self.out = self.out[:BATCH], self.out[BATCH:]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in some], t) for n, t in _TYPES.items()], list(_TYPES))


def _climber(last: bool, base: bool):
    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = []
        for b in batches:
            c = {n: b.column(n).to_pylist() for n in b.schema.names}
            ties = c["conv"] if base else [0] * b.num_rows
            parts = [None] * b.num_rows if base else zip(*(c[n] for n in _PATH), strict=True)
            runs.append(Run(list(zip(c["path"], ties, c["words"], parts, strict=True))))
        climb = Climb(last, base)
        for member, lcp in merged(runs):
            climb.feed(member, lcp)
            yield from climb.batches(False)
        climb.finish()
        yield from climb.batches(True)

    return climb


def _level(df: DataFrame, ranges: int, base: bool) -> DataFrame:
    """One merge of sequences: in one task if there is one range, which finishes all nodes."""
    columns = ["path", "words", "conv"] if base else ["path", "words", *_PATH]
    df = df.select(*columns)
    dealt = df.coalesce(1) if ranges <= 1 else df.repartitionByRange(ranges, "path", *(["conv"] if base else []))
    return written(dealt.mapInArrow(_climber(ranges <= 1, base), _SCHEMA), "trie")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's texts, joined by commas; they come in order, a key's all in one task, and none is held."""
    now, h, out = None, None, []
    done = lambda rows: pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.binary()), pa.array([d for _, d in rows], pa.string())], ["key", "digest"])
    for b in batches:
        for key, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if key != now:
                if h is not None:
                    out.append((now, h.hexdigest()))
                now, h = key, hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
        if len(out) >= BATCH:
            yield done(out)
            out = []
    if h is not None:
        out.append((now, h.hexdigest()))
    yield done(out)


def sequences(turns: DataFrame) -> DataFrame:
    """conv and its turns in order, as hashes and numbers of words, from (conv_id, turn, role, text)."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    hashed = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    each = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.struct("turn", hashed.alias("h"), words.alias("w")).alias("t"))
    return each.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(seqs: DataFrame) -> DataFrame:
    """Each conversation c with the first crc32(c) % HEADS turns replaced by those of conversation c - c % FAMILY."""
    heads = seqs.where(F.col("conv") % FAMILY == 0).select(F.col("conv").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head"))
    both = seqs.withColumn("base", F.col("conv") - F.col("conv") % FAMILY).join(heads, "base", "left")
    take = (F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).cast("int")
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), take)
    return both.select("conv", F.concat(head, F.slice("turns", take + 1, F.size("turns"))).alias("turns"))


def trie(seqs: DataFrame, rows: int = ROWS) -> DataFrame:
    """The nodes of the prefix trie of sequences (conv, turns): _NODE and parent_conv_id."""
    hashes = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["h"])), ""))
    flat = written(seqs.select("conv", hashes.alias("path"), F.transform("turns", lambda t: t["w"]).alias("words")), "sequences")
    levels = [_level(flat, -(-flat.count() // rows), True)]
    while (n := (paths := levels[-1].where("kind = 'path'")).count()) > 0:
        levels.append(_level(paths, -(-n // rows) if n > max(rows, 8) else 1, False))
    nodes = levels[0].where("kind = 'node'").select(*_NODE, "parent_conv_id", "parent_key")
    if len(levels) == 1:
        return nodes.drop("parent_key")
    upper = levels[1]
    for more in levels[2:]:
        upper = upper.unionByName(more)
    upper = upper.where("kind = 'node'")
    ends = levels[0].where("kind = 'ends'").select("key", "first", "ids")
    digests = ends.repartition("key").sortWithinPartitions("key", "first").select("key", "ids").mapInArrow(_digested, "key binary, digest string")
    told = upper.join(digests, "key", "left").withColumn("ends_sha256", F.coalesce("digest", F.lit(hashlib.sha256(b"").hexdigest())))
    nodes = nodes.unionByName(told.select(*_NODE, "parent_conv_id", "parent_key"))
    parents = upper.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("found"), "n_children")
    joined = lookup(nodes.where("parent_key is not null"), parents, "parent_key", "n_children", flat.count())
    joined = joined.withColumn("parent_conv_id", F.col("found")).select(*_NODE, "parent_conv_id")
    return nodes.where("parent_key is null").select(*_NODE, "parent_conv_id").unionByName(joined)


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return trie(rebuilt(sequences(turns))).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _oracle() -> str:
    """crc32 of the decimal number, byte by byte; a node is the text of its turns' digests."""
    crc = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        crc.append(n)
    steps = "[" + ", ".join(f"{n}::UINTEGER" for n in crc) + "]"
    crc32 = f"xor(list_reduce(list_prepend(4294967295::UINTEGER, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UINTEGER))), lambda a, x: xor(a >> 8, list_extract({steps}, (xor(a, x) & 255) + 1))), 4294967295::UINTEGER)"
    return f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS i,
  md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS h, len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS w FROM conversations WHERE conv_id IS NOT NULL),
q AS (SELECT c, {crc32} % {HEADS} AS h FROM (SELECT DISTINCT c FROM t)),
b AS (SELECT q.c, t.i, t.h, t.w FROM q JOIN t ON t.c = q.c - q.c % {FAMILY} AND t.i <= q.h UNION ALL SELECT t.c, t.i + {HEADS}, t.h, t.w FROM t JOIN q USING (c) WHERE t.i > q.h),
s AS (SELECT q.c, coalesce(list(b.h ORDER BY b.i) FILTER (WHERE b.h IS NOT NULL), []) AS hs, coalesce(list(b.w ORDER BY b.i) FILTER (WHERE b.h IS NOT NULL), []) AS ws FROM q LEFT JOIN b USING (c) GROUP BY q.c),
p AS (SELECT c, d, len(hs) = d AS ends, array_to_string(hs[1:d], ',') AS k, CASE WHEN d > 0 THEN array_to_string(hs[1:d - 1], ',') END AS pk, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w, hs FROM (SELECT *, unnest(generate_series(0, len(hs))) AS d FROM s)),
n AS (SELECT d, k, any_value(pk) AS pk, min(c) AS conv_id, count(*) AS n, any_value(w) AS w, any_value(hs)[1:d] AS hs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends FROM p GROUP BY d, k),
f AS (SELECT n.*, (SELECT count(*) FROM n m WHERE m.d = n.d + 1 AND m.pk = n.k) AS children FROM n),
a AS (SELECT u, array_to_string(hs[1:u], ',') AS k, (n - 1) * w AS saved, CASE WHEN children = 0 THEN 1 ELSE 0 END AS leaf FROM (SELECT *, unnest(generate_series(0, d)) AS u FROM f)),
g AS (SELECT u AS d, k, sum(saved) AS saved, sum(leaf) AS leaves FROM a GROUP BY u, k)
SELECT f.conv_id, f.d AS depth, up.conv_id AS parent_conv_id, f.n AS n_convs, f.children AS n_children, CAST(g.leaves AS BIGINT) AS n_leaves, CAST(g.saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
FROM f JOIN g ON f.d = g.d AND f.k = g.k LEFT JOIN n up ON up.d = f.d - 1 AND up.k = f.pk
"""


ORACLE = _oracle()
