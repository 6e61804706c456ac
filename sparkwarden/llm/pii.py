"""Personal data: base patterns, and bootstrapped contextual extraction, in DataFrame functions only.

Base kinds are regular expressions with checks. Regexes keep possessive loops and start only where a match can (after
the last match, or at a run's first character), so that long runs cost linear time and no stack.

Bootstrapping: seed entities (base finds, hexadecimal words of letters and digits, access keys of a published format)
induce lexical patterns, the two words and punctuation before them, or the name and signs that touch them (token=").
Identifier-like words (letters and digits, one digit at least) that follow a pattern are its other instances. Patterns
and instances form a graph. A round takes the patterns with SUPPORT trusted instances, counts how often their words
occur anywhere, and scores the graph in turn: a pattern's confidence is the mean score of its distinct instances times
its share, the part of its occurrences in the corpus that an instance follows; an instance's score is one less the product
of its patterns' doubts, and 1 for seeds. Patterns whose share is below CONFIDENCE can't be trusted and have no vote.
Instances with CONFIDENCE are trusted, and induce patterns in the next round, until a round finds no new one. Trusted
patterns give spans of the kinds `secret` (seeds' forms) and `id` (other words), where no base span lies; words of the
published key format are spans wherever they stand.

Counting stays in proportion to what is found: occurrences are counted over a 64th, an 8th and all of the texts, and a
pattern leaves as soon as its count alone proves its share too low, so common words are never counted to the end.

Positions are code points, ends exclusive. Matching cuts a text into gaps and matches, and sums over these, not over
characters, give positions.

Defined cases: a null text is empty; repeated rows are looked at once, count as often as they occur on both sides of a share, and
all get the result, so a table of doubled rows has the same spans twice; a null id is a value like
others; texts are read whole; an empty table gives no rows; input columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import small, table, written

_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for; each is implied by its pattern and checks.
_NEEDS = {"email": lambda t: F.contains(t, F.lit("@")), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike(r"[0-9][0-9\x20-]{10}"), "phone": lambda t: F.contains(t, F.lit("+"))}
#: Least characters of an identifier-like word, and of a hexadecimal one that is a seed.
WORD_CHARS, SEED_CHARS = 6, 16
_WORD = rf"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])[A-Za-z0-9]{{{WORD_CHARS},}}+"
#: Access key ids as their issuer publishes them: a fixed format.
_KEY = r"^A[KS]IA[0-9A-Z]{16}$"
_SECRET = rf"^(?:(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{{{SEED_CHARS},}}|A[KS]IA[0-9A-Z]{{16}})$"
_NAME = r"(?<![A-Za-z0-9])[A-Za-z0-9]++[^\sA-Za-z0-9]++"
_CONTEXT = rf"((?<!\S)(?:\S++\s++){{1,2}}[^\sA-Za-z0-9]*+|{_NAME})$"
#: What touches a match and the two words before it, in a reversed gap: its first characters, so one attempt finds them.
_LAST_WORDS = r"^(\S*+(?:\s++\S++){0,2}+)"
KINDS = [*BASE, "secret", "id"]
#: Least confidence and distinct trusted instances of a pattern, and scorings of the graph in a round.
CONFIDENCE, SUPPORT, SCORINGS = 0.8, 5, 3
#: Parts of the texts that counts are taken over in turn, and patterns' heads that are looked up in an expression.
PARTS, HELD_HEADS = (64, 8, 1), 2000
_PIECE = "array<struct<gap:bigint,size:bigint,found:string,left:string>>"


def _cut(text: Column, pattern: str, needed: Column) -> Column:
    """The matches: characters between them and the match before, their length, themselves, and what is before."""
    p = F.lit(pattern)
    both = F.zip_with(
        F.regexp_extract_all(text, p, 0), F.split(text, pattern, -1),
        lambda m, g: F.struct(F.length(g).cast("long").alias("gap"), F.length(m).cast("long").alias("size"), m.alias("found"), F.reverse(F.regexp_extract(F.reverse(g), _LAST_WORDS, 1)).alias("left")),
    )
    return F.when(needed, F.filter(both, lambda x: x["size"].isNotNull())).otherwise(F.array().cast(_PIECE))


def _valid(kind: Column, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == "ip", F.forall(F.split(found, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False))))
        .when(kind == "card", n.between(12, 19) & F.call_function("luhn_check", F.when(n.between(12, 19), digits).otherwise("0")))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(F.lit(True))
    )


def _occurrences(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, k), and valid matches (id, k, copies, kind, start, end, found, pattern); k tells texts of one id apart, copies are a text's rows."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(F.col(key), t).alias("k"), t.alias("t"))
    cut = [_cut(F.col("t"), p, _NEEDS[kind](F.col("t"))).alias(kind) for kind, p in BASE.items()]
    cut.append(_cut(F.col("t"), _WORD, F.col("t").rlike(r"[0-9]")).alias("id_"))
    pieces = written(rows.select("id", "k", *cut), "pieces")
    some = pieces.where(" OR ".join(f"size(`{c}`) > 0" for c in pieces.columns[2:]))
    one = some.groupBy("id", "k").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in pieces.columns[2:]])
    each = None
    for c in pieces.columns[2:]:
        x = one.select("id", "k", "copies", F.lit("word" if c == "id_" else c).alias("kind"), F.posexplode(c).alias("i", "x"))
        each = x if each is None else each.unionByName(x)
    before = W.partitionBy("id", "k", "kind").orderBy("i")
    end = F.sum(F.col("x.gap") + F.col("x.size")).over(before)
    found = each.select("id", "k", "copies", "kind", (end - F.col("x.size")).alias("start"), end.alias("end"), F.col("x.found").alias("found"), F.lower(F.regexp_extract("x.left", _CONTEXT, 1)).alias("pattern"))
    return pieces.select("id", "k"), written(found.where(_valid(F.col("kind"), F.col("found"))), "occurrences")


def _heads(docs: DataFrame, text: str, heads: DataFrame, part: int) -> DataFrame:
    """head, everywhere: how often the heads occur in a part of the texts. A name's head starts with a tab."""
    t = F.coalesce(F.col(text), F.lit(""))
    if part > 1:
        docs = docs.where(F.pmod(F.xxhash64(F.lit("part"), t), F.lit(part)) == 0)
    some = [r[0] for r in heads.limit(HELD_HEADS + 1).collect()]
    held = len(some) <= HELD_HEADS
    found = (lambda a, of: F.filter(a, lambda x: x.isin(of))) if held else (lambda a, of: a)
    kinds: dict[str, list[str]] = {"name": [], "pair": [], "word": []}
    for h in some:
        kinds["name" if h[0] == "\t" else "pair" if " " in h else "word"].append(h)
    lists = []
    words = F.split(F.lower(t), r"\s+", -1)
    if not held or kinds["word"]:
        lists.append(found(words, kinds["word"]))
    if not held or kinds["pair"]:
        lists.append(found(F.zip_with(words, F.slice(words, 2, 1 << 30), lambda a, b: F.concat_ws(" ", a, b)), kinds["pair"]))
    if not held or kinds["name"]:
        names = F.regexp_extract_all(t, F.lit(_NAME + "(?=[A-Za-z0-9])"), F.lit(0))
        lists.append(found(F.transform(names, lambda n: F.concat(F.lit("\t"), F.lower(n))), kinds["name"]))
    each = docs.select(F.explode(F.concat(*lists)).alias("head"))
    if not held:
        each = each.join(small(heads), "head", "left_semi")
    return each.groupBy("head").agg(F.count("*").alias("everywhere"))


def _background(docs: DataFrame, text: str, patterns: DataFrame, confidence: float) -> DataFrame:
    """pattern and share (the part of its words' occurrences that an instance follows; 0 if below confidence) of patterns (pattern, seen)."""
    c = F.col
    head = F.regexp_replace(F.regexp_replace("pattern", r"\s+[^\sA-Za-z0-9]*$", ""), r"\s+", " ")
    heads = patterns.select("pattern", "seen", F.when(c("pattern").rlike(r"\s"), head).otherwise(F.concat(F.lit("\t"), "pattern")).alias("head"))
    left, gone = heads, []
    for part in PARTS:
        counts = written(_heads(docs, text, left.select("head").distinct(), part), "everywhere")
        # words that are found nowhere prove no share: a match before cut the first of them
        share = F.least(F.lit(1.0), c("seen") / F.coalesce("everywhere", F.lit(1) if part > 1 else F.lit(1 << 62)))
        now = written(left.join(small(counts), "head", "left").withColumn("share", share), "shares")
        gone.append(now.where(c("share") < confidence).select("pattern", F.lit(0.0).alias("share")))
        left = now.where(c("share") >= confidence).select("pattern", "seen", "head")
        if left.isEmpty():
            break
    out = now.where(c("share") >= confidence).select("pattern", "share")
    for x in gone:
        out = out.unionByName(x)
    return out


def induced(docs: DataFrame, occurrences: DataFrame, text: str = "text", confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """pattern, confidence and support of the patterns that are trusted, by iterated scores of the pattern-instance graph."""
    c = F.col
    seed = (c("kind") != "word") | c("found").rlike(_SECRET)
    graph = occurrences.where(c("pattern") != "").groupBy("pattern", "found").agg(F.sum("copies").alias("n"), F.max(seed).alias("seed"))
    graph = written(graph, "graph")
    first = written(graph.groupBy("found").agg(F.max("seed").cast("double").alias("score")), "seeds")
    scores, counted, trusted = first, None, graph.select("pattern", F.lit(0.0).alias("confidence"), F.lit(0).cast("long").alias("support")).limit(0)
    while True:
        rich = graph.join(small(scores.where(c("score") > 0)), "found", "left").groupBy("pattern").agg(F.count_if(c("score") >= confidence).alias("support"), F.sum("n").alias("seen"))
        rich = rich.where(c("support") >= support).select("pattern", "seen")
        rich = written(rich if counted is None else rich.join(small(counted.select("pattern")), "pattern", "left_anti"), "rich")
        if rich.isEmpty():
            return trusted
        new = written(_background(docs, text, rich, confidence), "background")
        counted = new if counted is None else written(counted.unionByName(new), "counted")
        edges = written(graph.join(small(counted.where("share > 0")), "pattern"), "edges")
        for _ in range(SCORINGS):
            by = edges.join(small(scores), "found").groupBy("pattern").agg((F.avg("score") * F.max("share")).alias("confidence"), F.count_if(c("score") >= confidence).alias("support"))
            by = written(by, "patterns")
            doubt = F.sum(F.log(F.greatest(F.lit(1e-9), 1 - c("confidence"))))
            voted = edges.join(small(by), "pattern").groupBy("found").agg((1 - F.exp(doubt)).alias("voted"))
            scores = written(first.join(small(written(voted, "voted")), "found", "left").select("found", F.greatest("score", F.coalesce("voted", F.lit(0.0))).alias("score")), "scores")
        trusted = by.where((c("confidence") >= confidence) & (c("support") >= support))


def entities(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (id, k) of docs, and their spans (id, k, kind, start, end, found), of base kinds and of the method's."""
    rows, occurrences = _occurrences(docs, key, text)
    trusted = induced(docs, occurrences, text)
    occurrences = occurrences.drop("copies")
    base = occurrences.where(F.col("kind") != "word").drop("pattern")
    words = occurrences.where(F.col("kind") == "word")
    key = F.col("found").rlike(_KEY)
    words = words.where(~key).join(small(trusted.select("pattern")), "pattern", "left_semi").drop("pattern").unionByName(words.where(key).drop("pattern"))
    b = base.select(F.col("id").alias("i2"), F.col("k").alias("k2"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    c = F.col
    words = words.join(b, (c("k") == c("k2")) & c("id").eqNullSafe(c("i2")) & (c("start") < c("e2")) & (c("s2") < c("end")), "left_anti")
    words = words.withColumn("kind", F.when(c("found").rlike(_SECRET), "secret").otherwise("id"))
    return rows, base.unionByName(words)


def digested(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each of docs: key, n_<base kind>, base and spans (text forms), and all spans as an array."""
    rows, spans = entities(docs, key, text)
    c = F.col
    order = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)]), c("kind"))
    each = F.struct(c("start"), order.alias("o"), c("end"), c("kind"))
    grouped = spans.groupBy("id", "k").agg(*[F.count_if(c("kind") == k).alias(f"n_{k}") for k in BASE], F.array_sort(F.collect_list(each)).alias("all"))
    grouped = grouped.select(c("id").alias("i2"), c("k").alias("k2"), *[f"n_{k}" for k in BASE], "all")
    joined = rows.join(grouped, (c("k") == c("k2")) & c("id").eqNullSafe(c("i2")), "left")

    def listed(a: Column) -> Column:
        return F.coalesce(F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","), F.lit(""))

    return joined.select(
        c("id").alias(key), "k", *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in BASE],
        listed(F.filter("all", lambda x: x["o"] < len(BASE))).alias("base"), listed(c("all")).alias("spans"), c("all").alias("entities"),
    )


def redacted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with each span (or run of overlapping ones) replaced by <KIND>, of the first kind in it."""
    c = F.col
    _, spans = entities(docs, key, text)
    by = W.partitionBy("id", "k").orderBy("start", F.desc("end"))
    spans = spans.withColumn("top", F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1)))
    spans = spans.withColumn("run", F.sum((c("top").isNull() | (c("start") >= c("top"))).cast("int")).over(by))
    runs = spans.groupBy("id", "k", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", "start").alias("kind"))
    runs = runs.withColumn("last", F.lag("end", 1, 0).over(W.partitionBy("id", "k").orderBy("start")))
    cuts = runs.groupBy("id", "k").agg(F.array_sort(F.collect_list(F.struct("start", "last", "end", "kind"))).alias("cuts"))
    cuts = cuts.select(c("id").alias("i2"), c("k").alias("k2"), "cuts")
    t = F.coalesce(c(text), F.lit(""))
    out = docs.drop("_k").withColumn("_k", F.xxhash64(c(key), t)).join(cuts, (c("_k") == c("k2")) & c(key).eqNullSafe(c("i2")), "left")
    kept = F.transform("cuts", lambda x: F.concat(c(text).substr((x["last"] + 1).cast("int"), (x["start"] - x["last"]).cast("int")), F.lit("<"), F.upper(x["kind"]), F.lit(">")))
    tail = c(text).substr((F.element_at("cuts", -1)["end"] + 1).cast("int"), F.length(text))
    new = F.when(c("cuts").isNull(), c(text)).otherwise(F.concat(F.array_join(kept, ""), tail))
    return out.withColumn(text, new).select(*docs.columns)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = digested(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2("base", 256).alias("base_sha256"), "spans", F.coalesce(F.size("entities"), F.lit(0)).cast("long").alias("n_spans"))


def pii_base_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base kinds alone, which SQL can find too: counts and the matches in order."""
    _, found = _occurrences(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    found = found.where(F.col("kind") != "word")
    each = found.groupBy("id", "kind").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "found"))), lambda x: x["found"]), "|").alias("found"))
    return each.select(F.col("id").alias("doc_id"), "kind", "n", "found")


def _oracle() -> str:
    pattern = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    doubled = f"list_sum(list_transform(generate_series(1, length({digits})), lambda i: CASE WHEN (length({digits}) - i) % 2 = 0 THEN CAST(substr({digits}, CAST(i AS BIGINT), 1) AS INT) ELSE (CAST(substr({digits}, CAST(i AS BIGINT), 1) AS INT) * 2) // 10 + (CAST(substr({digits}, CAST(i AS BIGINT), 1) AS INT) * 2) % 10 END))"
    valid = {
        "email": "TRUE", "ip": "len(list_filter(string_split(m, '.'), lambda p: NOT regexp_matches(p, '^0*([0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$'))) = 0",
        "card": f"length({digits}) BETWEEN 12 AND 19 AND {doubled} % 10 = 0", "phone": f"length({digits}) BETWEEN 9 AND 15",
    }
    parts = [f"SELECT doc_id, '{k}' AS kind, i, m FROM (SELECT doc_id, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS ms FROM documents)) WHERE {valid[k]}" for k, p in pattern.items()]
    return f"SELECT doc_id, kind, count(*) AS n, string_agg(m, '|' ORDER BY i) AS found FROM ({' UNION ALL '.join(parts)}) GROUP BY doc_id, kind"


ORACLE = _oracle()
