"""Near-duplicates by bottom-k sketches of one hash function.

A document is the set of its n-word shingles' hashes; equal sets form a class, represented by its first row. A class's
sketch holds the K least hashes. The first few values of each sketch go to inverted lists; classes that meet in two
lists at least are a candidate pair, the union sketch estimates their Jaccard similarity, and pairs that may be similar
enough are confirmed on their full sets (sets of up to K hashes are their own sketches).

Frequent values, whose lists would hold more than LIST members (a passage in many documents), are set aside: values are
retained in the order (not frequent, hash), the same for all. If J >= t and a share s of the union is frequent, the rest
has a similarity of (t - s) / (1 - s) at least, so two documents retain fewer than two common values with a probability
below 1e-9 at t = 0.8 for LEAST_RETAINED values and s <= 0.2, and for MOST_RETAINED and s <= HOT_SHARE. The estimate
drops a pair whose similarity is t with a probability below 1e-9 (Chernoff's bound at K values, see `lowest`).

A set of up to K hashes needs no such bounds: if it has two values more that are not frequent than a link may leave
unshared, that many are retained, and two linked sets share two of these for certain (the prefix bound).

Documents that have not, or that consist of frequent values beyond HOT_SHARE (members of large groups of near copies,
mostly), are joined on their full sets, without estimates; with exact=True all documents are. Their values are put in the
order (frequent, count, hash), rarest first, and a set's prefix of n - ceil(t * n) + 1 values is listed with positions: two
linked sets share a value of both prefixes, and at the first one, enough of each must be left to reach the overlap that
their sizes ask for. Lists of rare values give pairs at once. In the list of a frequent value the member with the fewest
rare values is its centre, and compared with all; a list whose members are one component is settled, others take their
next centre among components without one. After ROUNDS centres, members outside a list's largest component meet the
rest by positions: the rare values of a copy that is not linked use up what a link could leave unshared, so almost no
pair is left, and none that is linked is lost.

Defined cases: null and empty texts have empty sets and no links; texts of fewer words than a shingle are one shingle;
very long texts are read whole, a buffer of words at a time; rows with a null id are not linked (null component_id,
kept); repeated rows are one class; rows of one id with unlike texts are classes of their own, and each is kept if its id
is its component's least; an empty table gives no rows; input columns named like an output are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, drop_table, lookup, mixed, released, rolled, slices, small, small_batches, table, words_hashed, written
from .components import components, joined

#: Hashes in a sketch; values retained with few and with many frequent ones; members of a list before its value counts as frequent.
K, LEAST_RETAINED, MOST_RETAINED, LIST = 128, 18, 36, 32
#: Share of frequent values up to which the others suffice, and centres that a frequent value's list takes.
HOT_SHARE, ROUNDS = 0.6, 3
#: Values that a task may hold, and those of centres' sets that are broadcast.
HELD_VALUES, HELD_SETS = 1_000_000, 4_000_000

_LONGS = T.ArrayType(T.LongType())
_SETS = T.StructType([T.StructField("n", T.LongType()), T.StructField("fp", T.StringType()), T.StructField("values", _LONGS)])
_TAKEN = T.StructType([T.StructField("cold", T.LongType()), T.StructField("taken", _LONGS)])


def shingle_sets(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text, A-Z lower-cased."""
    _, _, _, hashes, first = words_hashed([t.lower() if t else t for t in texts])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        h = hashes[a:b]
        if len(h) >= size:
            out.append(np.unique(rolled(h, size).view(np.int64)))
        else:
            out.append(mixed(rolled(h, len(h)) + np.uint64(len(h))).view(np.int64) if len(h) else np.zeros(0, np.int64))
    return out


def _setter(size: int, keep: int | None):
    def make(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            texts = a.to_pylist()
            n, fp, flat, ends = [], [], [], [0]
            for i, j in slices(texts, 1 << 20):
                for s in shingle_sets(texts[i:j], size):
                    n.append(len(s))
                    fp.append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest())
                    flat.append(s[:keep])
                    ends.append(ends[-1] + len(flat[-1]))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else [], pa.int64()))
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(fp, pa.string()), lists], ["n", "fp", "values"])
        released()

    # not to be evaluated again, below other operators, for filters that follow from joins on its result
    return F.arrow_udf(make, _SETS).asNondeterministic()


def _flat(a: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return a.flatten().to_numpy(), np.concatenate(([0], np.cumsum(a.value_lengths().to_numpy())))


def _inside(flat: np.ndarray, held: np.ndarray) -> np.ndarray:
    if not len(held):
        return np.zeros(len(flat), bool)
    return held[np.minimum(np.searchsorted(held, flat), len(held) - 1)] == flat


def _limit(n, cold, k, percent: int):
    """Values to retain of a set of n hashes, k of them in its sketch and cold of these not frequent."""
    few = np.where(k - cold <= 0.2 * k, LEAST_RETAINED, MOST_RETAINED)
    return np.where(n <= K, (100 - percent) * n // 100 + 2, few)


def _saturated(n: Column, cold: Column, k: Column, percent: int) -> Column:
    """Whether the values that are not frequent do not suffice."""
    return F.when(n <= K, cold < F.floor((100 - percent) * n / 100) + 2).otherwise(k - cold > HOT_SHARE * k)


def _taker(hot, shared, percent: int):
    """The retained values of sketches without frequent ones; of these, only those in shared if it is given."""

    def take(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for sizes, a in batches:
            n, (flat, ends) = sizes.to_numpy(), _flat(a)
            keep = ~_inside(flat, hot.value)
            before = np.concatenate(([0], np.cumsum(keep)))
            cold = before[ends[1:]] - before[ends[:-1]]
            lengths = np.diff(ends)
            most = _limit(n, cold, lengths, percent)
            keep &= before[1:] - np.repeat(before[ends[:-1]], lengths) <= np.repeat(most, lengths)
            if shared is not None:
                keep &= _inside(flat, shared.value)
            left = np.concatenate(([0], np.cumsum(keep)))
            lists = pa.ListArray.from_arrays(pa.array(left[ends], pa.int32()), pa.array(flat[keep], pa.int64()))
            yield pa.StructArray.from_arrays([pa.array(cold, pa.int64()), lists], ["cold", "taken"])

    return F.arrow_udf(take, _TAKEN).asNondeterministic()


def _orderer(hot, percent: int):
    """Prefixes of whole sets: values that are not frequent, then the others, rarest first; and how many are not."""

    def order(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            values, rank = hot.value
            flat, ends = _flat(a)
            lengths = np.diff(ends)
            at = np.minimum(np.searchsorted(values, flat), max(0, len(values) - 1))
            frequent = _inside(flat, values)
            place = np.where(frequent, rank[at] + 1, 0) if len(values) else np.zeros(len(flat), np.int64)
            row = np.repeat(np.arange(len(lengths)), lengths)
            # of equal places the hash decides: the sets are sorted, and so is lexsort for equal keys
            new = np.lexsort((place, row))
            most = lengths - -(-percent * lengths // 100) + 1
            keep = np.arange(len(flat)) - np.repeat(ends[:-1], lengths) < np.repeat(most, lengths)
            left = np.concatenate(([0], np.cumsum(keep)))
            cold = np.bincount(row[~frequent], minlength=len(lengths))
            lists = pa.ListArray.from_arrays(pa.array(left[ends], pa.int32()), pa.array(flat[new][keep], pa.int64()))
            yield pa.StructArray.from_arrays([pa.array(cold, pa.int64()), lists], ["cold", "taken"])

    return F.arrow_udf(order, _TAKEN).asNondeterministic()


def lowest(t: float, k: int, chance: float = 1e-9) -> float:
    """The estimate that k values of a similarity t fall below with less than the chance, by Chernoff's bound."""
    f = t
    while f > 0.01 and k * (f * log(f / t) + (1 - f) * log((1 - f) / (1 - t)) if t < 1 else 1e9) < -log(chance):
        f -= 0.005
    return f


def _estimate(a: Column, b: Column, na: Column, nb: Column) -> Column:
    """Jaccard similarity by the union sketch; exact if both sets are their own sketches."""
    union, common = F.array_union(a, b), F.array_intersect(a, b)
    whole = (na <= K) & (nb <= K)
    low = F.slice(F.array_sort(union), 1, K)
    return F.when(whole, F.size(common) / F.size(union)).otherwise(F.size(F.array_intersect(low, common)) / F.size(low))


class Linker:
    """Links between classes (node, id, fp, n, values) of documents (id, text). percent: 100 * intersection >= percent * union links two sets."""

    def __init__(self, docs: DataFrame, classes: DataFrame, size: int, percent: int):
        self.docs, self.size, self.percent = docs, size, percent
        # smaller sets are linked with no unlike one
        self.classes = classes.where(100 * F.col("n") >= percent * (F.col("n") + 1))
        self.floor = lowest(percent / 100, K)
        self.spark = docs.sparkSession

    def whole_sets(self, nodes: DataFrame) -> DataFrame:
        """(node, n, values): the whole sets of the nodes, of those beyond the sketch from their texts."""
        chosen = self.classes.join(small(nodes), "node", "left_semi")
        large = chosen.where(F.col("n") > K).select("node", F.col("id").alias("i"), F.col("fp").alias("f"), "n")
        texts = self.docs.join(small(large.select(F.col("i").alias("id")).distinct()), "id", "left_semi")
        made = texts.withColumn("s", _setter(self.size, None)(F.col("text"))).select("id", F.col("s.fp").alias("fp"), F.col("s.values").alias("values"))
        sets = made.join(small(large), (F.col("id") == F.col("i")) & (F.col("fp") == F.col("f"))).select("node", "n", "values").dropDuplicates(["node"])
        return sets.unionByName(chosen.where(F.col("n") <= K).select("node", "n", "values"))

    def alike(self, na: Column, nb: Column) -> Column:
        """Sizes that a link allows."""
        return 100 * F.least(na, nb) >= self.percent * F.greatest(na, nb)

    def enough(self, common: Column, na: Column, nb: Column) -> Column:
        return (100 + self.percent) * common >= self.percent * (na + nb)

    def _linked(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that their whole sets link."""
        one, two = (sets.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("values").alias(f"v{x}")) for x in "ab")
        full = pairs.select("a", "b").join(one, "a").join(two, "b")
        return full.where(self.enough(F.size(F.array_intersect("va", "vb")), F.col("na"), F.col("nb"))).select("a", "b")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The links (a, b) among pairs of nodes (a, b). Only sketches and sets that pairs name are shuffled."""
        pairs = written(pairs, "pairs")
        named = small(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        classes = self.classes.join(named, "node", "left_semi")
        one, two = (classes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("values").alias(f"v{x}")) for x in "ab")
        near = pairs.join(one, "a").join(two, "b")
        whole = (F.col("na") <= K) & (F.col("nb") <= K)
        near = near.withColumn("est", _estimate(F.col("va"), F.col("vb"), F.col("na"), F.col("nb")))
        near = written(near.where(F.when(whole, 100 * F.col("est") >= self.percent - 1e-9).otherwise(F.col("est") >= self.floor)).select("a", "b", whole.alias("sure")), "near")
        drop_table(pairs)
        open_ = near.where(~F.col("sure"))
        if open_.isEmpty():
            return near.select("a", "b")
        sets = written(self.whole_sets(open_.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "sets")
        out = written(near.where("sure").select("a", "b").unionByName(self._linked(open_, sets)), "links")
        drop_table(sets)
        return out

    def _held(self, values: DataFrame):
        return self.spark.sparkContext.broadcast(np.sort(values.select("value").toArrow().column(0).to_numpy()))

    def _without(self, hot: DataFrame) -> DataFrame:
        """Retained values by a shuffle, for more frequent values than a task may hold."""
        each = self.classes.select("node", F.explode("values").alias("value")).join(hot.select("value"), "value", "left_anti")
        kept = each.groupBy("node").agg(F.sort_array(F.collect_list("value")).alias("left"))
        rows = self.classes.select("node", "n", F.size("values").alias("k")).join(kept, "node", "left").withColumn("left", F.coalesce("left", F.array().cast(_LONGS)))
        rows = rows.withColumn("cold", F.size("left").cast("long"))
        few = F.when(F.col("k") - F.col("cold") <= 0.2 * F.col("k"), LEAST_RETAINED).otherwise(MOST_RETAINED)
        most = F.when(F.col("n") <= K, F.floor((100 - self.percent) * F.col("n") / 100) + 2).otherwise(few)
        return rows.withColumn("taken", F.slice("left", 1, most.cast("int"))).drop("left")

    def _taken(self, hot: DataFrame | None, many: int, shared: DataFrame | None = None) -> DataFrame:
        """(node, n, k, cold, taken) of the classes; shared: only retained values that are in it."""
        if many > HELD_VALUES:
            rows = self._without(hot)
        else:
            held = self._held(hot) if hot is not None else self.spark.sparkContext.broadcast(np.zeros(0, np.int64))
            some = self._held(shared) if shared is not None else None
            rows = self.classes.select("node", "n", F.size("values").alias("k"), _taker(held, some, self.percent)("n", "values").alias("x"))
            rows = rows.select("node", "n", "k", F.col("x.cold").alias("cold"), F.col("x.taken").alias("taken"))
        return rows

    def components(self, exact: bool = False) -> DataFrame:
        """node, component (the least node linked over any others) of linked classes."""
        if exact:
            return self.joined(self.classes.select("node"), None)
        hot, many = None, 0
        while True:
            # values retained once need no list
            counts = self._taken(hot, many).select(F.explode("taken").alias("value")).groupBy("value").count().where("count > 1")
            counts = written(counts, "counts")
            listed, found = counts.agg(F.count("*"), F.count_if(F.col("count") > LIST)).first()
            if not found:
                break
            new = counts.where(F.col("count") > LIST).select("value")
            hot, many = written(new if hot is None else hot.unionByName(new), "hot"), many + found
            drop_table(counts)
        inside = many <= HELD_VALUES and listed <= HELD_VALUES
        rows = self._taken(hot, many, counts if inside else None)
        rows = written(rows, "rows")
        lists = rows.select("node", "n", F.explode("taken").alias("value"))
        if not inside:
            lists = written(lists.join(counts.select("value").hint("shuffle_hash"), "value", "left_semi"), "lists")
        one, two = (lists.select("value", F.col("node").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
        met = one.join(two, "value").where((F.col("a") < F.col("b")) & self.alike(F.col("na"), F.col("nb")))
        found = self.confirmed(met.groupBy("a", "b").agg(F.count("*").alias("overlap")).where("overlap > 1").select("a", "b"))
        drop_table(counts)
        return self.joined(rows.where(_saturated(F.col("n"), F.col("cold"), F.col("k"), self.percent)).select("node"), found)

    def _prefixes(self, sets: DataFrame) -> DataFrame:
        """(node, n, cold, taken) of whole sets."""
        counts = written(sets.select(F.explode("values").alias("value")).groupBy("value").count().where(F.col("count") > LIST), "frequent")
        if counts.count() <= HELD_VALUES:
            values, n = (x.to_numpy() for x in counts.select("value", "count").toArrow().columns)
            values, n = values[order := np.argsort(values)], n[order]
            rank = np.empty(len(n), np.int64)
            rank[np.lexsort((values, n))] = np.arange(len(n))
            held = self.spark.sparkContext.broadcast((values, rank))
            made = sets.select("node", "n", _orderer(held, self.percent)("values").alias("x"))
            return made.select("node", "n", F.col("x.cold").alias("cold"), F.col("x.taken").alias("taken"))
        each = sets.select("node", "n", F.explode("values").alias("value"))
        each = lookup(each, counts.withColumn("w", F.col("count")), "value", "count", each.count())
        each = each.groupBy("node").agg(F.first("n").alias("n"), F.count_if(F.col("w").isNull()).alias("cold"), F.array_sort(F.collect_list(F.struct(F.coalesce("w", F.lit(0)).alias("w"), "value"))).alias("x"))
        most = F.col("n") - F.ceil(self.percent * F.col("n") / 100) + 1
        return each.select("node", "n", "cold", F.slice(F.transform("x", lambda x: x["value"]), 1, most.cast("int")).alias("taken"))

    def _first(self, one: DataFrame, two: DataFrame, more: Column) -> DataFrame:
        """Pairs (a, b) of one (value, x, nx, px, ...) and two (value, y, ny, py, ...) that may share their first value here."""
        left = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))
        met = one.join(two, "value").where(more & self.alike(F.col("nx"), F.col("ny")) & self.enough(left, F.col("nx"), F.col("ny")))
        return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def joined(self, nodes: DataFrame, links: DataFrame | None) -> DataFrame:
        """Components by links, and by links among the nodes, enough to join all that belong together, by their whole sets."""
        nodes = written(nodes, "saturated")
        links = links if links is not None else nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
        if nodes.isEmpty():
            return written(components(links), "components")
        sets = written(self.whole_sets(nodes), "whole")
        lists = written(self._prefixes(sets).select("node", "n", "cold", F.posexplode("taken").alias("p", "value")), "prefixes")
        rare = lists.where("p < cold")
        one, two = (rare.select("value", F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("p").alias(f"p{x}")) for x in "xy")
        found = self._linked(self._first(one, two, F.col("x") < F.col("y")), sets)
        of = written(components(links.unionByName(found)), "components")
        hot = lists.where("p >= cold")
        tried = None
        for last in range(ROUNDS + 1):
            now = hot.join(small(of), "node", "left").withColumn("component", F.coalesce("component", "node"))
            # lists with one component are settled
            several = now.groupBy("value").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("value")
            now = written(now.join(small(written(several, "several")), "value", "left_semi"), "open")
            if now.isEmpty():
                return of
            if last == ROUNDS:
                break
            fresh = now
            if tried is not None:
                before = tried.join(small(of), "node", "left").select("value", F.coalesce("component", "node").alias("component")).distinct()
                fresh = now.join(small(written(before, "before")), ["value", "component"], "left_anti")
            best = F.max_by(F.struct("node", "n", "component"), F.struct(-F.col("cold"), "n", -F.col("node")))
            centres = written(fresh.groupBy("value").agg(best.alias("c")).select("value", F.col("c.node").alias("a"), F.col("c.n").alias("na"), F.col("c.component").alias("ca")), "centres")
            if centres.isEmpty():
                break
            met = now.join(small(centres), "value").where((F.col("component") != F.col("ca")) & self.alike(F.col("na"), F.col("n")))
            met = written(met.select("a", F.col("node").alias("b")).distinct(), "met")
            own = sets.join(small(centres.select(F.col("a").alias("node")).distinct()), "node", "left_semi").select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("values").alias("va"))
            held = own.agg(F.sum("na")).first()[0]
            full = met.join(F.broadcast(own) if held <= HELD_SETS else own, "a").join(sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("values").alias("vb")), "b")
            new = full.where(self.enough(F.size(F.array_intersect("va", "vb")), F.col("na"), F.col("nb"))).select("a", "b")
            of = joined(of, written(new, "new"))
            centres = centres.select("value", F.col("a").alias("node"))
            tried = centres if tried is None else tried.unionByName(centres)
        # what is left: in lists of several components, members outside a list's largest one meet the others there
        main = now.groupBy("value", "component").agg(F.count("*").alias("m")).groupBy("value").agg(F.max_by("component", F.struct("m", "component")).alias("main"))
        apart = now.join(small(written(main, "main")), "value").where(F.col("component") != F.col("main"))
        one = apart.select("value", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("p").alias("px"), F.col("component").alias("cx"))
        two = now.select("value", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("p").alias("py"), F.col("component").alias("cy"))
        rest = written(self._first(small(written(one, "apart")), two, F.col("cx") != F.col("cy")), "rest")
        return of if rest.isEmpty() else joined(of, written(self._linked(rest, sets), "new"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, percent: int = 85, exact: bool = False) -> DataFrame:
    """A row for each of docs: key, n_shingles, component_id and kept. exact: all links by whole sets, without estimates."""
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, key, text, size, percent, exact)


def _near_duplicates(docs: DataFrame, key: str, text: str, size: int, percent: int, exact: bool) -> DataFrame:
    docs = docs.drop("n_shingles", "component_id", "kept")
    narrow = docs.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("text"))
    made = narrow.select("id", _setter(size, K)("text").alias("s"))
    # the documents themselves are not written again; only what linking needs is
    base = written(made.select("id", F.monotonically_increasing_id().alias("node"), F.col("s.fp").alias("fp"), F.col("s.n").alias("n"), F.col("s.values").alias("values")), "sketches")
    some = base.where("n > 0 AND id IS NOT NULL")
    heads = written(some.groupBy("fp").agg(F.min(F.struct("id", "node")).alias("x"), F.count("*").alias("members")).select("fp", F.col("x.id").alias("least"), F.col("x.node").alias("first"), "members"), "classes")
    groups = heads.where("members > 1").select("fp", "first", "members")
    copies = some.select("fp", "node")
    many = groups.count()
    copies = copies.join(F.broadcast(groups.drop("members")), "fp") if many <= BROADCAST_ROWS else lookup(copies, groups, "fp", "members", some.count())
    copies = written(copies.where(F.col("node") != F.col("first")).select("node"), "copies")
    classes = written(some.join(small(copies), "node", "left_anti").select("node", "id", "fp", "n", "values"), "nodes")
    rows = written(base.select("id", "n", "fp"), "rows")
    drop_table(base)
    of = Linker(narrow.where(F.col("id").isNotNull()), classes, size, percent).components(exact)
    linked = heads.join(small(of), F.col("first") == F.col("node"), "left").withColumn("component", F.coalesce("component", "first"))
    linked = linked.where((F.col("members") > 1) | F.col("node").isNotNull()).select("fp", "component", "least", "members")
    linked = written(linked, "linked")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    moved = written(linked.join(least, "component").select("fp", "component_id", "members"), "moved")
    joined = rows.join(F.broadcast(moved.drop("members")), "fp", "left") if moved.count() <= BROADCAST_ROWS else lookup(rows, moved, "fp", "members", rows.count())
    out = joined.withColumn("component_id", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("component_id", "id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, percent: int = 85) -> DataFrame:
    """docs with one row of each group of near-duplicates: the least key (a null comes last), of equal keys the first row.

    Rows are told apart by their place, so rows of one key with unlike texts are judged each, and of repeated rows one stays.
    """
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    marks = near_duplicates(rows.select("_row", text), "_row", text, size, percent).select("_row", "component_id")
    named = written(marks.join(rows.select("_row", F.col(key).alias("_key")), "_row"), "marks")
    order = F.struct(F.col("_key").isNull(), "_key", "_row")
    heads = named.groupBy("component_id").agg(F.min(order).alias("least"), F.count("*").alias("members")).where("members > 1")
    heads = written(heads.select("component_id", F.col("least._row").alias("first"), "members"), "groups")
    gone = written(lookup(named, heads, "component_id", "members", named.count()).where(F.col("_row") != F.col("first")).select("_row"), "gone")
    return rows.join(small(gone), "_row", "left_anti").select(*docs.columns)


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, hash(g) AS g FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(generate_series(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT a AS s, b AS t FROM e UNION SELECT r.s, e.b FROM r JOIN e ON r.t = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(min(r.t), d.doc_id)) AS component_id,
  least(d.doc_id, coalesce(min(r.t), d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.s = d.doc_id GROUP BY d.doc_id, n.n
"""
