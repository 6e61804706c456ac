"""Repetition coverage: how much of a text lies inside duplicated word runs and duplicated lines.

Word runs of each length are hashed for a whole buffer of texts at once (numpy); a sort finds the duplicated
ones, and the characters under them are counted once however many runs cover them. Rules on these shares give
the verdict.

Defined cases: a null or empty text has no words and fails; equal runs in different texts never meet; a line
without a word is no line here; of equally frequent runs the one that covers most characters counts; repeated rows each
get the same result; very long texts are measured whole; an empty table gives no rows; input columns named like an
output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mixed, rolled, slices, table, words_hashed

#: Largest allowed share of characters in the most frequent run of 2, 3, 4 words.
TOP_SHARE = {2: 0.20, 3: 0.18, 4: 0.16}
#: Largest allowed share of characters inside runs that occur twice or more, by words in the run.
DUPLICATE_SHARE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest allowed share of lines, and of characters in lines, that repeat an earlier line.
LINE_SHARE, LINE_CHARS_SHARE = 0.30, 0.20

LONGS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "dup_line_chars"]
FIELDS = LONGS + [f"dup_chars_{n}" for n in DUPLICATE_SHARE] + [f"top_chars_{n}" for n in TOP_SHARE]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


def _runs(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start words of the n-word runs that stay in one text, and their hashes, which the text is part of."""
    if len(hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
    return at, mixed(rolled(hashes, n)[at] + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _groups(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts h, and starts and sizes of the groups of equal values in it."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    start = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
    return order, start, np.diff(np.concatenate((start, [len(s)])))


def _covered(words: int, at: np.ndarray, n: int) -> np.ndarray:
    """Which of the words lie in a run of n words from one of `at`."""
    change = np.zeros(words + 1, np.int32)
    np.add.at(change, at, 1)
    np.add.at(change, at + n, -1)
    return np.cumsum(change[:-1]) > 0


def measured(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """FIELDS for each text; characters are code points."""
    n_docs = len(texts)
    buf, starts, ends, hashes, first = words_hashed(texts)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(n_docs), n_words)
    points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    chars = points[ends] - points[starts]

    def per_doc(values: np.ndarray, which: np.ndarray = doc) -> np.ndarray:
        return np.bincount(which, values, n_docs).astype(np.int64)

    out = {"n_words": n_words.astype(np.int64), "word_chars": per_doc(chars)}
    bounds = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[buf])))
    out["n_symbols"] = symbols[bounds[1:]] - symbols[bounds[:-1]]

    breaks = np.flatnonzero(buf == 10)
    line_of = np.searchsorted(breaks, starts)
    if len(starts):
        lead = np.flatnonzero(np.concatenate(([True], line_of[1:] != line_of[:-1])))
        line = line_of[lead]
        begin, end = np.where(line > 0, breaks[line - 1] + 1, 0), breaks[line]
        # the line as it is, spaces and all: its bytes' hash, not its words'
        raw = np.fromiter((hash(bytes(buf[a:b])) for a, b in zip(begin.tolist(), end.tolist(), strict=True)), np.int64, len(line)).view(np.uint64)
        owner = doc[lead]
        order, start, _ = _groups(mixed(raw + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        later = np.ones(len(line), bool)
        later[order[start]] = False
        out["n_dup_lines"] = per_doc(later, owner)
        out["n_lines"] = per_doc(np.ones(len(line)), owner)
        line_chars = np.add.reduceat(chars, lead)
        out["dup_line_chars"] = per_doc(line_chars * later, owner)
    else:
        out |= {k: np.zeros(n_docs, np.int64) for k in ("n_dup_lines", "n_lines", "dup_line_chars")}

    for n in (3, *DUPLICATE_SHARE):
        at, h = _runs(hashes, doc, n)
        order, start, sizes = _groups(h)
        twice = at[order[np.repeat(sizes > 1, sizes)]]
        inside = _covered(len(starts), twice, n) if len(twice) else np.zeros(len(starts), bool)
        if n == 3:
            out["n_repeat_words"] = per_doc(inside)
        if n in DUPLICATE_SHARE:
            out[f"dup_chars_{n}"] = per_doc(chars * inside)
    upto = np.concatenate(([0], np.cumsum(chars)))
    for n in TOP_SHARE:
        at, h = _runs(hashes, doc, n)
        order, start, sizes = _groups(h)
        best = np.zeros(n_docs, np.int64)
        if len(start):
            lead = at[order[start]]
            weight = np.where(sizes > 1, sizes * (upto[lead + n] - upto[lead]), 0)
            np.maximum.at(best, doc[lead], weight)
        out[f"top_chars_{n}"] = best
    return out


def _measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for a in batches:
        texts = a.to_pylist()
        parts = [measured(texts[i:j]) for i, j in slices(texts)]
        yield pa.StructArray.from_arrays([pa.array(np.concatenate([p[k] for p in parts]) if parts else [], pa.int64()) for k in FIELDS], FIELDS)


def repetition(df: DataFrame, text: str = "text", min_words: int = 50, max_repeat_share: float = 0.5) -> DataFrame:
    """df with FIELDS, base_failed, reasons (names of the rules that a text breaks) and kept."""
    measure = F.arrow_udf(_measure, T.StructType([T.StructField(k, T.LongType()) for k in FIELDS]))
    out = df.drop(*FIELDS, "base_failed", "reasons", "kept").withColumn("_m", measure(F.col(text).cast("binary")))
    out = out.select(*[c for c in out.columns if c != "_m"], *[F.col(f"_m.{k}").alias(k) for k in FIELDS])
    c, all_chars = F.col, F.greatest(F.col("word_chars"), F.lit(1))
    rules = {f"dup_{n}": c(f"dup_chars_{n}") > v * all_chars for n, v in DUPLICATE_SHARE.items()}
    rules |= {f"top_{n}": c(f"top_chars_{n}") > v * all_chars for n, v in TOP_SHARE.items()}
    rules |= {"lines": c("n_dup_lines") > LINE_SHARE * F.greatest(c("n_lines"), F.lit(1)), "line_chars": c("dup_line_chars") > LINE_CHARS_SHARE * all_chars}
    failed = (c("n_words") < min_words) | (c("n_repeat_words") > max_repeat_share * c("n_words"))
    out = out.withColumn("base_failed", failed)
    out = out.withColumn("reasons", F.filter(F.array(*[F.when(r, F.lit(k)) for k, r in rules.items()]), lambda x: x.isNotNull()))
    return out.withColumn("kept", ~c("base_failed") & (F.size("reasons") == 0))


def op7_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repetition(docs).drop("text", "reasons")


def _oracle() -> str:
    space = r"[\x20\x09-\x0D]+"
    parts = []
    for n in (3, *DUPLICATE_SHARE):
        parts.append(f"""g{n} AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM (SELECT doc_id, unnest(generate_series(1, len(ws) - {n - 1})) AS i, unnest(list_transform(generate_series(1, len(ws) - {n - 1}), lambda i: array_to_string(ws[i:i + {n - 1}], ' '))) AS g FROM w WHERE len(ws) >= {n})),
c{n} AS (SELECT doc_id, count(*) AS words, sum(cs[p]) AS chars FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + {n - 1})) AS p FROM g{n} WHERE k > 1) JOIN w USING (doc_id) GROUP BY doc_id)""")
    for n in TOP_SHARE:
        parts.append(f"""t{n} AS (SELECT doc_id, max(k * chars) AS chars FROM (SELECT doc_id, g, count(*) AS k, any_value(chars) AS chars FROM (SELECT doc_id, unnest(list_transform(generate_series(1, len(ws) - {n - 1}), lambda i: array_to_string(ws[i:i + {n - 1}], ' '))) AS g, unnest(list_transform(generate_series(1, len(ws) - {n - 1}), lambda i: list_sum(cs[i:i + {n - 1}]))) AS chars FROM w WHERE len(ws) >= {n}) GROUP BY doc_id, g HAVING count(*) > 1) GROUP BY doc_id)""")
    joins = " ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in (3, *DUPLICATE_SHARE)) + " " + " ".join(f"LEFT JOIN t{n} USING (doc_id)" for n in TOP_SHARE)
    whole = "CAST(coalesce({}, 0) AS BIGINT) AS {}"
    columns = [whole.format("len(ws)", "n_words"), whole.format("list_sum(cs)", "word_chars"), whole.format("length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))", "n_symbols")]
    columns += [whole.format(f"l.{k}", k) for k in ("n_dup_lines", "n_lines", "dup_line_chars")] + [whole.format("c3.words", "n_repeat_words")]
    columns += [whole.format(f"c{n}.chars", f"dup_chars_{n}") for n in DUPLICATE_SHARE] + [whole.format(f"t{n}.chars", f"top_chars_{n}") for n in TOP_SHARE]
    limit = lambda left, share, of: f"{left} > CAST({share} AS DOUBLE) * greatest({of}, 1)"
    rules = [limit(f"dup_chars_{n}", v, "word_chars") for n, v in DUPLICATE_SHARE.items()] + [limit(f"top_chars_{n}", v, "word_chars") for n, v in TOP_SHARE.items()]
    rules += [limit("n_dup_lines", LINE_SHARE, "n_lines"), limit("dup_line_chars", LINE_CHARS_SHARE, "word_chars")]
    return f"""
WITH w AS (SELECT doc_id, text, ws, list_transform(ws, lambda x: length(x)) AS cs FROM (SELECT doc_id, text, list_filter(string_split_regex(coalesce(text, ''), '{space}'), lambda x: x <> '') AS ws FROM documents)),
line AS (SELECT doc_id, line, i, list_sum(list_transform(string_split_regex(line, '{space}'), lambda x: length(x))) AS chars FROM (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE r > 1) AS n_dup_lines, sum(chars) FILTER (WHERE r > 1) AS dup_line_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS r FROM line WHERE chars > 0) GROUP BY doc_id),
{", ".join(parts)},
m AS (SELECT doc_id, {", ".join(columns)} FROM w LEFT JOIN l USING (doc_id) {joins})
SELECT *, n_words < 50 OR n_repeat_words > CAST(0.5 AS DOUBLE) * n_words AS base_failed,
  NOT (n_words < 50 OR n_repeat_words > CAST(0.5 AS DOUBLE) * n_words OR {" OR ".join(rules)}) AS kept FROM m
"""


ORACLE = _oracle()
