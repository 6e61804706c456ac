"""Licence recognition by sentences and ordered rules, in DataFrame functions only.

A text is cut into sentences, each is normalised and mapped to a known sentence's identifier, and the sequence of
identifiers is matched against licence rules in their order; a rule takes its identifiers out of the sequence, so a
longer rule placed first keeps a shorter one from claiming its sentences again. A rule of three sentences or more also fires
with one of them missing or unknown. Nothing is shuffled.

Notices are wrapped at any column: lines up to a full stop or a line without a letter or digit are joined, without the copyright
lines before them, and what they say together is looked up first, among complete sentences (WHOLE) and those
that name the holder (NAMED). Otherwise two lines together (titles), then single lines are looked up. A tag of licence
identifiers gives one identifier for each operand. n_sentences counts lines. "All rights reserved" says something only where
no licence is found.

Defined cases: null and empty texts have no sentences and no licence; a sentence repeated counts each time; repeated
rows get equal results; texts are read whole; an empty table gives no rows; input columns named like an output are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# fixed values: sentences of public licence notices, normalised (lower case, other characters as one space)
SENTENCES = {
    "mit_ref": "released under the mit license",
    "mit_ref2": "licensed under the mit license",
    "mit_ref3": "this project is licensed under the mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit_keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as_is": "the software is provided as is without warranty of any kind express or implied",
    "apache2_ref": "licensed under the apache license version 2 0",
    "apache2_ref2": "licensed under the apache license version 2 0 the license",
    "apache2_keep": "you may not use this file except in compliance with the license",
    "apache2_copy": "you may obtain a copy of the license at",
    "apache2_basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    "gpl3_ref": "this work is licensed under the gnu general public license version 3",
    "gpl3_only": "licensed under the gnu general public license version 3",
    "gpl_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl_hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "bsd_grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc_by_nc4": "licensed under cc by nc 4 0",
    "cc_by4": "licensed under cc by 4 0",
    "cc_by_sa4": "licensed under cc by sa 4 0",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "mpl2_ref": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "gpl_received": "you should have received a copy of the gnu general public license along with this program",
    "lgpl21_free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3_free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl_hope": "this library is distributed in the hope that it will be useful but without any warranty",
    "agpl3_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "bsl_grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "zlib_as_is": "this software is provided as is without any express or implied warranty",
    "zlib_grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "bsd_advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "terms_end": "end of terms and conditions",
    "apache2_title": "apache license version 2 0 january 2004",
    "gpl3_title": "gnu general public license version 3 29 june 2007",
    "gpl2_title": "gnu general public license version 2 june 1991",
    "lgpl3_title": "gnu lesser general public license version 3 29 june 2007",
    "lgpl21_title": "gnu lesser general public license version 2 1 february 1999",
    "agpl3_title": "gnu affero general public license version 3 19 november 2007",
    "mpl2_title": "mozilla public license version 2 0",
    "epl2_title": "eclipse public license v 2 0",
    "bsl_title": "boost software license version 1 0 august 17th 2003",
    "cc0_title": "cc0 1 0 universal",
    "mit_title": "the mit license mit",
    "mit_title2": "mit license",
    "isc_title": "isc license",
    "bsd2_title": "bsd 2 clause license",
    "bsd3_title": "bsd 3 clause license",
    "reserved": "all rights reserved",
}

#: Sentences that name a holder, of any name: identifier, how they begin, and the whole sentence.
NAMED = [
    ("bsd_names", ("neither the name", "the name"), "^(neither )?the names? of .{1,200} be used to endorse or promote products derived from this software without (specific )?prior written permission$"),
    ("bsd_advertising", ("all advertising materials",), "^all advertising materials mentioning features or use of this software must display the following acknowledge?ment( this product includes software developed by .{1,200})?$"),
    ("as_is", ("the software is provided as is and",), "^the software is provided as is and .{1,200} disclaims? all warranties with regard to this software including all implied warranties of merchantability and fitness$"),
]
#: Licence identifiers of tags, as they are published.
TAGGED = """0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0
    CDDL-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later
    MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL OFL-1.1 PostgreSQL Python-2.0 Unlicense Vim WTFPL Zlib""".split()
_TAG = "spdx license identifier "
#: Identifiers without "only" or "or later" of the families that have both mean the first.
TAGS = {t.lower().replace("-", " ").replace(".", " "): t for t in TAGGED} | {t[:-5].lower().replace("-", " ").replace(".", " "): t for t in TAGGED if t.endswith("-only")}

#: Complete sentences of the licences' own texts, and runs that their layout joins, to identifiers.
WHOLE = {
    SENTENCES["mit_grant"] + " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": ["mit_grant"],
    SENTENCES["mit_keep"].replace("notice shall", "notice including the next paragraph shall"): ["mit_keep"],
    SENTENCES["as_is"] + " including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": ["as_is"],
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": ["as_is"],
    SENTENCES["apache2_ref2"] + " " + SENTENCES["apache2_keep"]: ["apache2_ref2", "apache2_keep"],
    SENTENCES["apache2_copy"] + " http www apache org licenses license 2 0": ["apache2_copy"],
    SENTENCES["apache2_copy"] + " https www apache org licenses license 2 0": ["apache2_copy"],
    SENTENCES["apache2_basis"] + " without warranties or conditions of any kind either express or implied": ["apache2_basis"],
    SENTENCES["gpl_hope"] + " without even the implied warranty of merchantability or fitness for a particular purpose": ["gpl_hope"],
    SENTENCES["lgpl_hope"] + " without even the implied warranty of merchantability or fitness for a particular purpose": ["lgpl_hope"],
    SENTENCES["gpl_received"] + " if not see http www gnu org licenses": ["gpl_received"],
    SENTENCES["gpl_received"] + " if not see https www gnu org licenses": ["gpl_received"],
    SENTENCES["bsd_grant"] + " 1": ["bsd_grant"],
    SENTENCES["bsd_grant"] + " " + SENTENCES["bsd_source"]: ["bsd_grant", "bsd_source"],
    SENTENCES["bsd_binary"] + " and": ["bsd_binary"],
    SENTENCES["bsd_source"] + " and": ["bsd_source"],
    SENTENCES["apache2_title"] + " http www apache org licenses": ["apache2_title"],
    SENTENCES["apache2_title"] + " https www apache org licenses": ["apache2_title"],
    SENTENCES["apache2_copy"] + " http www apache org licenses license 2 0 " + SENTENCES["apache2_basis"] + " without warranties or conditions of any kind either express or implied": ["apache2_copy", "apache2_basis"],
    "the mit license": ["mit_title"],
}

#: Rules in order: name, licence, sentence identifiers that follow each other among a text's known sentences.
_RULES = [
    ("gpl3_text", "GPL-3.0-only", ["gpl3_title", "terms_end", "gpl_free", "gpl_hope", "gpl_received"]),
    ("gpl2_text", "GPL-2.0-only", ["gpl2_title", "terms_end", "gpl2_free", "gpl_hope", "gpl_received"]),
    ("agpl3_text", "AGPL-3.0-only", ["agpl3_title", "terms_end", "agpl3_free", "gpl_hope"]),
    ("lgpl21_text", "LGPL-2.1-only", ["lgpl21_title", "terms_end", "lgpl21_free", "lgpl_hope"]),
    ("apache2_text", "Apache-2.0", ["apache2_title", "terms_end", "apache2_ref2", "apache2_keep", "apache2_copy", "apache2_basis"]),
    ("mpl2_text", "MPL-2.0", ["mpl2_title", "mpl2_ref"]),
    ("bsd4", "BSD-4-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_advertising", "bsd_names"]),
    ("apache2_notice", "Apache-2.0", ["apache2_ref2", "apache2_keep", "apache2_copy", "apache2_basis"]),
    ("apache2_short", "Apache-2.0", ["apache2_ref2", "apache2_keep"]),
    ("mit_text", "MIT", ["mit_grant", "mit_keep", "as_is"]),
    ("mit_part", "MIT", ["mit_grant", "mit_keep"]),
    ("bsd3", "BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_names"]),
    ("bsd2", "BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("gpl3_whole", "GPL-3.0-or-later", ["gpl_free", "gpl_hope", "gpl_received"]),
    ("gpl2_whole", "GPL-2.0-or-later", ["gpl2_free", "gpl_hope", "gpl_received"]),
    ("agpl3_notice", "AGPL-3.0-or-later", ["agpl3_free", "gpl_hope"]),
    ("agpl3_free", "AGPL-3.0-or-later", ["agpl3_free"]),
    ("lgpl21_notice", "LGPL-2.1-or-later", ["lgpl21_free", "lgpl_hope"]),
    ("lgpl21_free", "LGPL-2.1-or-later", ["lgpl21_free"]),
    ("lgpl3_notice", "LGPL-3.0-or-later", ["lgpl3_free", "lgpl_hope"]),
    ("lgpl3_free", "LGPL-3.0-or-later", ["lgpl3_free"]),
    ("bsl", "BSL-1.0", ["bsl_grant"]),
    ("zlib", "Zlib", ["zlib_as_is", "zlib_grant"]),
    ("zlib_part", "Zlib", ["zlib_grant"]),
    ("gpl3_notice", "GPL-3.0-or-later", ["gpl_free", "gpl_hope"]),
    ("gpl2_notice", "GPL-2.0-or-later", ["gpl2_free", "gpl_hope"]),
    ("gpl3_free", "GPL-3.0-or-later", ["gpl_free"]),
    ("gpl2_free", "GPL-2.0-or-later", ["gpl2_free"]),
    ("apache2_ref", "Apache-2.0", ["apache2_ref"]),
    ("apache2_ref2", "Apache-2.0", ["apache2_ref2"]),
    ("mit_ref", "MIT", ["mit_ref"]),
    ("mit_ref2", "MIT", ["mit_ref2"]),
    ("mit_ref3", "MIT", ["mit_ref3"]),
    ("mit_grant", "MIT", ["mit_grant"]),
    ("gpl3_ref", "GPL-3.0-only", ["gpl3_ref"]),
    ("gpl3_only", "GPL-3.0-only", ["gpl3_only"]),
    ("cc_by_nc", "CC-BY-NC-4.0", ["cc_by_nc4"]),
    ("cc_by_sa", "CC-BY-SA-4.0", ["cc_by_sa4"]),
    ("cc_by", "CC-BY-4.0", ["cc_by4"]),
    ("cc0", "CC0-1.0", ["cc0"]),
    ("mpl2", "MPL-2.0", ["mpl2_ref"]),
    ("isc", "ISC", ["isc_grant", "as_is"]),
    ("isc_part", "ISC", ["isc_grant"]),
    ("unlicense", "Unlicense", ["unlicense"]),
    ("apache2_title", "Apache-2.0", ["apache2_title"]),
    ("gpl3_title", "GPL-3.0-only", ["gpl3_title"]),
    ("gpl2_title", "GPL-2.0-only", ["gpl2_title"]),
    ("lgpl3_title", "LGPL-3.0-only", ["lgpl3_title"]),
    ("lgpl21_title", "LGPL-2.1-only", ["lgpl21_title"]),
    ("agpl3_title", "AGPL-3.0-only", ["agpl3_title"]),
    ("mpl2_title", "MPL-2.0", ["mpl2_title"]),
    ("epl2_title", "EPL-2.0", ["epl2_title"]),
    ("bsl_title", "BSL-1.0", ["bsl_title"]),
    ("cc0_title", "CC0-1.0", ["cc0_title"]),
    ("mit_title", "MIT", ["mit_title"]),
    ("mit_title2", "MIT", ["mit_title2"]),
    ("isc_title", "ISC", ["isc_title"]),
    ("bsd2_title", "BSD-2-Clause", ["bsd2_title"]),
    ("bsd3_title", "BSD-3-Clause", ["bsd3_title"]),
]
_LAST = ("reserved", "Proprietary", ["reserved"])


def _with_gaps(rules: list[tuple[str, str, list[str]]]) -> list[tuple[str, str, list[str]]]:
    """Rules of three sentences or more also with one left out, after all whole rules of as many; what another rule says stays its own."""
    whole = {tuple(seq) for _, _, seq in rules}
    out, taken = list(rules), set(whole)
    for name, licence, seq in rules:
        for i in range(len(seq)) if len(seq) >= 3 and name != "bsd2" else ():
            part = tuple(seq[:i] + seq[i + 1 :])
            # the grant alone does not tell two licences of one family apart
            if part not in taken and part[0] not in ("gpl_hope", "lgpl_hope", "terms_end", "bsd_source", "apache2_copy") and part not in {tuple(s[: len(part)]) for _, other, s in rules if other != licence}:
                taken.add(part)
                out.append((f"{name}_but_{seq[i]}", licence, list(part)))
    return sorted(out, key=lambda r: -len(r[2]))


#: Longest rules first; tags, which stand alone; then what is said only if nothing else is.
RULES = [*_with_gaps(_RULES), *((f"tag_{t}", t, [f"tag_{t}"]) for t in TAGGED), _LAST]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OUT = ("n_sentences", "n_known", "sentence_ids", "rules", "licenses")


#: Words whose full stop ends no sentence, and a sign that means "or later".
_SHORT, _PLUS = "v|inc|ltd|corp|co", r"(gpl-[0-9.]+)\+"
_COPYRIGHT = "^(c )?copyright "


def segments(text: Column) -> Column:
    """Normalised sentences by segment: a segment ends at a full stop (not that of "v. 2.0" or "inc.") before white space or the
    text's end, or at a line without a letter or digit; a sentence ends there too, and at a line's end."""
    low = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER + "#", _LOWER + "*"), _PLUS, "$1-or-later")
    marked = F.regexp_replace(low, rf"(?<!\b(?:{_SHORT}))\.(?:[ \t\r\n]|$)", "#")
    marked = F.regexp_replace(F.regexp_replace(marked, r"\n[^a-z0-9#|]*\n", "#"), r"\.[ \t\r\n]|\.$|\n", "|")
    plain = F.regexp_replace(marked, r"[^a-z0-9|#]+", " ")
    return F.transform(F.split(plain, "#", -1), lambda x: F.filter(F.transform(F.split(x, r"\|", -1), lambda s: F.trim(s)), lambda s: s != ""))


def recognised(df: DataFrame, text: str = "text", known: dict[str, str] | None = None, rules: list[tuple[str, str, list[str]]] | None = None) -> DataFrame:
    """df with n_sentences, n_known, sentence_ids (known ones in order), rules and licenses (in rule order)."""
    known, rules = known or SENTENCES, rules or RULES
    ids = F.create_map(*[x for k, s in known.items() for x in (F.lit(s), F.array(F.lit(k)))])
    whole = {s: [k] for k, s in known.items()} | (WHOLE if known is SENTENCES else {})
    joined = F.create_map(*[x for s, k in whole.items() for x in (F.lit(s), F.array(*map(F.lit, k)))])
    tags = F.create_map(*[x for s, t in TAGS.items() for x in (F.lit(s), F.lit(f"tag_{t}"))])
    least, none = min(map(len, whole)), F.array().cast("array<string>")
    out = df.drop(*_OUT, "_s", "_q", "_hit").withColumn("_s", segments(F.col(text)))

    def tagged(line: Column) -> Column:
        """A tag's operands; " or later" belongs to one, and exceptions do not count."""
        operands = F.split(F.regexp_replace(F.replace(F.substring(line, len(_TAG) + 1, 1 << 30), F.lit(" or later"), F.lit("|")), " (or|and) ", "#"), "#", -1)
        named = F.transform(operands, lambda x: tags[F.replace(F.regexp_replace(x, " with .*", ""), F.lit("|"), F.lit(" or later"))])
        return F.filter(named, lambda t: t.isNotNull())

    def single(line: Column) -> Column:
        return F.when(F.startswith(line, F.lit(_TAG)), tagged(line)).otherwise(F.coalesce(ids[line], none))

    def named(one: Column) -> Column:
        out = none
        for k, starts, sentence in NAMED:
            begins = F.startswith(one, F.lit(starts[0]))
            for x in starts[1:]:
                begins = begins | F.startswith(one, F.lit(x))
            out = F.when(begins & one.rlike(sentence), F.array(F.lit(k))).otherwise(out)
        return out

    def several(lines: Column) -> Column:
        notice = lambda s: s.rlike(_COPYRIGHT)
        lines = F.filter(lines, lambda s, i: ~(notice(s) & F.forall(F.slice(lines, 1, i + 1), notice)))
        one = F.array_join(lines, " ")
        holder = named(one)
        pair = lambda i: joined[F.concat(F.get(lines, i), F.lit(" "), F.get(lines, i + 1))]
        each = F.flatten(F.transform(lines, lambda s, i: F.when(pair(i - 1).isNotNull(), none).otherwise(F.coalesce(pair(i), single(s)))))
        return F.when(F.length(one) < least, none).when(joined[one].isNotNull(), joined[one]).when(F.size(holder) > 0, holder).otherwise(each)

    out = out.withColumn("sentence_ids", F.flatten(F.transform("_s", several)))
    out = out.withColumn("n_sentences", F.aggregate("_s", F.lit(0).cast("long"), lambda n, x: n + F.size(x))).withColumn("n_known", F.size("sentence_ids").cast("long")).drop("_s")

    def step(state: Column, rule: Column) -> Column:
        found = F.contains(state["left"], rule["pattern"]) & ((rule["name"] != _LAST[0]) | (F.size(state["rules"]) == 0))
        return F.struct(
            F.when(found, F.replace(state["left"], rule["pattern"], F.lit(",,"))).otherwise(state["left"]).alias("left"),
            F.when(found, F.concat(state["rules"], F.array(rule["name"]))).otherwise(state["rules"]).alias("rules"),
            F.when(found, F.array_union(state["licenses"], F.array(rule["license"]))).otherwise(state["licenses"]).alias("licenses"),
        )

    every = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(x).alias("license"), F.lit("".join(f",{k}," for k in seq)).alias("pattern")) for n, x, seq in rules])
    start = F.struct(F.array_join(F.transform("sentence_ids", lambda k: F.concat(F.lit(","), k, F.lit(","))), "").alias("left"), none.alias("rules"), none.alias("licenses"))
    # texts without a known sentence, nearly all, skip the rules
    got = F.when(F.col("n_known") > 0, F.aggregate(every, start, step)).otherwise(start)
    out = out.withColumn("_hit", got)
    return out.select(*[c for c in out.columns if c != "_hit"], F.col("_hit.rules").alias("rules"), F.col("_hit.licenses").alias("licenses"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recognised(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_sentences", "n_known", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("rules", ",").alias("rules"), F.array_join("licenses", ",").alias("licenses"))


def _oracle() -> str:
    whole = {s: [k] for k, s in SENTENCES.items()} | WHOLE
    tags = "CASE replace(regexp_replace(x, ' with .*', ''), '|', ' or later') " + " ".join(f"WHEN '{s}' THEN 'tag_{t}'" for s, t in TAGS.items()) + " END"
    operands = f"string_split(regexp_replace(replace(substr(s, {len(_TAG) + 1}), ' or later', '|'), ' (or|and) ', '#', 'g'), '#')"
    ids = f"CASE WHEN starts_with(s, '{_TAG}') THEN list_filter(list_transform({operands}, lambda x: {tags}), lambda k: k IS NOT NULL) ELSE CASE s " + " ".join(f"WHEN '{s}' THEN ['{k}']" for k, s in SENTENCES.items()) + " ELSE [] END END"
    joined = "CASE {} " + " ".join(f"WHEN '{s}' THEN [{', '.join(repr(x) for x in k)}]" for s, k in whole.items()) + " END"
    holder = "CASE " + " ".join(f"WHEN regexp_matches(one, '{p}') THEN ['{k}']" for k, _, p in NAMED) + " END"
    pair = lambda i: joined.format(f"ls[{i}] || ' ' || ls[{i} + 1]")
    each = f"flatten(list_transform(ls, lambda s, i: CASE WHEN i > 1 AND {pair('(i - 1)')} IS NOT NULL THEN [] ELSE coalesce({pair('i')}, {ids}) END))"
    steps = []
    for i, (_, _, seq) in enumerate(RULES):
        pattern = "".join(f",{k}," for k in seq)
        alone = "" if i < len(RULES) - 1 else " AND NOT (" + " OR ".join(f"hit{j}" for j in range(i)) + ")"
        steps.append(f"r{i} AS (SELECT *, contains(left{i}, '{pattern}'){alone} AS hit{i}, replace(left{i}, '{pattern}', ',,') AS left{i + 1} FROM {f'r{i - 1}' if i else 'q'})")
    names = ", ".join(f"CASE WHEN hit{i} THEN '{n}' END" for i, (n, _, _) in enumerate(RULES))
    first = ", ".join(f"CASE WHEN hit{i} THEN '{x}' END" for i, (_, x, _) in enumerate(RULES))
    return f"""
WITH low AS (SELECT doc_id, regexp_replace(regexp_replace(translate(coalesce(text, ''), '{_UPPER}#', '{_LOWER}*'), '{_PLUS}', '\\1-or-later', 'g'), '\\b({_SHORT})\\.([ \\t\\r\\n]|$)', '\\1|\\2', 'g') AS t FROM documents),
marked AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '\\.([ \\t\\r\\n]|$)', '#', 'g'), '\\n[^a-z0-9#|]*\\n', '#', 'g'), '\\.[ \\t\\r\\n]|\\.$|\\n', '|', 'g') AS t FROM low),
each AS (SELECT doc_id, i, list_filter(list_transform(string_split(seg, '|'), lambda s: trim(s)), lambda s: s <> '') AS ss FROM (
  SELECT doc_id, unnest(segs) AS seg, generate_subscripts(segs, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(t, '[^a-z0-9|#]+', ' ', 'g'), '#') AS segs FROM marked))),
lined AS (SELECT doc_id, i, len(ss) AS n, list_filter(ss, lambda s, i: NOT (regexp_matches(s, '{_COPYRIGHT}') AND len(list_filter(ss[1:i], lambda x: NOT regexp_matches(x, '{_COPYRIGHT}'))) = 0)) AS ls FROM each),
found AS (SELECT doc_id, i, n, CASE WHEN length(one) < {min(map(len, whole))} THEN [] ELSE coalesce({joined.format("one")}, {holder}, {each}) END AS ids
  FROM (SELECT *, array_to_string(ls, ' ') AS one FROM lined)),
q AS (SELECT *, array_to_string(list_transform(ids, lambda k: ',' || k || ','), '') AS left0 FROM (
  SELECT doc_id, sum(n) AS n_sentences, flatten(list(ids ORDER BY i)) AS ids FROM found GROUP BY doc_id)),
{", ".join(steps)}
SELECT doc_id, CAST(n_sentences AS BIGINT) AS n_sentences, CAST(len(ids) AS BIGINT) AS n_known, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
  concat_ws(',', {names}) AS rules,
  array_to_string(list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(list_filter([{first}], lambda x: x IS NOT NULL), lambda x: [x])),
    lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE a || b END), ',') AS licenses
FROM r{len(RULES) - 1}
"""


ORACLE = _oracle()
