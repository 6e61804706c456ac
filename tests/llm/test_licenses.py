"""Licence texts as they are published, with varied holders, layouts and tags; and the same rows by SQL."""

import textwrap

import pytest

from sparkwarden.llm import licenses

GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
THIRD = "3. Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
GPL3 = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble"""
APACHE = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions."""
NOTICE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
FREE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program.  If not, see <https://www.gnu.org/licenses/>."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND {} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""
HOLDERS = ["the copyright holder", "the University", "Google Inc.", "the University of California, Berkeley", "Example Co. Ltd.", "[project]", "Müller & Söhne"]

CASES = {
    "mit": (GRANT, ["MIT"]),
    "mit, copyright above": ("Copyright (c) 2020 A. Person\n" + GRANT, ["MIT"]),
    "mit, two holders": ("MIT License\n\nCopyright (c) 2019 A. Person\nCopyright (C) 2020 B. Person, Inc.\n\n" + GRANT, ["MIT"]),
    "mit, one clause broken": (GRANT.replace("substantial portions", "large portions"), ["MIT"]),
    "mit title": ("The MIT License (MIT)\n\nCopyright (c) 2020 A. Person", ["MIT"]),
    "bsd2": (BSD + "\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS", ["BSD-2-Clause"]),
    "bsd4": (BSD + "\n\n3. All advertising materials mentioning features or use of this software must display the following acknowledgement:\nThis product includes software developed by the organization.\n\n4." + THIRD.format("the organization")[2:], ["BSD-4-Clause"]),
    "bsd3, one clause broken": (BSD.replace("must reproduce", "shall reproduce") + "\n\n" + THIRD.format("the author"), ["BSD-3-Clause"]),
    "bsd3, by the author": (BSD + "\n\n3. The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.", ["BSD-3-Clause"]),
    "bsd3, all rights reserved": ("Copyright (c) 2011, Google Inc. All rights reserved.\n\n" + BSD + "\n\n" + THIRD.format("Google Inc."), ["BSD-3-Clause"]),
    "gpl3 head": (GPL3, ["GPL-3.0-only"]),
    "gpl3 whole": (GPL3 + "\n\n   END OF TERMS AND CONDITIONS\n\n    <one line>\n\n" + FREE, ["GPL-3.0-only"]),
    "gpl3 notice": (FREE, ["GPL-3.0-or-later"]),
    "gpl2 head": ("GNU GENERAL PUBLIC LICENSE\n  Version 2, June 1991\n\n Copyright (C) 1989", ["GPL-2.0-only"]),
    "lgpl3 head": ("GNU LESSER GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n", ["LGPL-3.0-only"]),
    "agpl3 head": ("GNU AFFERO GENERAL PUBLIC LICENSE\n  Version 3, 19 November 2007\n", ["AGPL-3.0-only"]),
    "apache head": (APACHE, ["Apache-2.0"]),
    "apache whole": (APACHE + "\n\n   END OF TERMS AND CONDITIONS\n\n   Copyright [yyyy] [name of copyright owner]\n\n" + NOTICE, ["Apache-2.0"]),
    "apache notice, copyright above": ("   Copyright 2020 A. Person\n" + NOTICE, ["Apache-2.0"]),
    "mpl2 head": ("Mozilla Public License Version 2.0\n==================================\n\n1. Definitions", ["MPL-2.0"]),
    "isc": (ISC.format("THE AUTHOR"), ["ISC"]),
    "isc, holder": (ISC.format("INTERNET SYSTEMS CONSORTIUM"), ["ISC"]),
    "tag": ("// SPDX-License-Identifier: MIT", ["MIT"]),
    "tag, two": ("/* SPDX-License-Identifier: (GPL-2.0-or-later OR BSD-3-Clause) */\nint x;", ["BSD-3-Clause", "GPL-2.0-or-later"]),
    "tag, exception": ("# SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception\n", ["Apache-2.0"]),
    "tag, old forms": ("SPDX-License-Identifier: GPL-2.0+\nx\nSPDX-License-Identifier: LGPL-2.1", ["GPL-2.0-or-later", "LGPL-2.1-only"]),
    "tag, unknown": ("SPDX-License-Identifier: LicenseRef-Mine AND MIT", ["MIT"]),
    "reserved": ("Copyright 2020 A. Person. All rights reserved.", ["Proprietary"]),
    "prose": ("The mit license of the school. Redistribution of income.\nNeither the name of the king nor the queen.", []),
}
CASES |= {f"bsd3, {h}": (BSD + "\n\n" + THIRD.format(h), ["BSD-3-Clause"]) for h in HOLDERS}


def layouts():
    for name, (text, want) in CASES.items():
        yield name, text, want
        if text in (GPL3, APACHE) or "\n " in text or "tag" in name or "reserved" in name or "two holders" in name:
            continue
        for width in (78, 40):
            head, _, body = text.partition("\n") if "copyright above" in name else ("", "", text)
            wrapped = (head + "\n" if head else "") + "\n\n".join(textwrap.fill(p, width) for p in body.split("\n\n"))
            yield f"{name} {width}", wrapped, want
            yield f"{name} {width} in comments", "\n".join(("// " + x).rstrip() for x in wrapped.split("\n")), want


def test_published_texts(spark):
    rows = list(layouts())
    got = {r.name: r.licenses for r in licenses.recognised(spark.createDataFrame([r[:2] for r in rows], "name string, text string")).collect()}
    assert {n: (got[n], want) for n, _, want in rows if got[n] != want} == {}


def test_sql_gives_the_same(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    texts = [t for _, t, _ in layouts()]
    spark.createDataFrame(list(enumerate([*texts, None, ""])), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    df = licenses.op8_licenses(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(licenses.ORACLE)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(cur.fetchall())


def test_a_rule_with_a_gap_never_names_another_licence():
    by = {}
    for _, licence, seq in licenses.RULES:
        by.setdefault(tuple(seq), set()).add(licence)
    assert all(len(v) == 1 for v in by.values())
