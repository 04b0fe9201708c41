import duckdb
import numpy as np
import pytest

from glyphmill.llm import lengths, licences
from glyphmill.llm.queries import QUERIES, SQL, vocabulary

SF = "/root/testdata/sf0.001"


def scan(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return [r["licences"] for r in sorted(licences.licence_scan(df).collect(), key=lambda r: r["id"])]


def test_rules_in_order(spark):
    mit = [licences.SENTENCES[k][0] for k in ("mi2", "mi3", "mi4", "mi5")]
    full = "Intro here.\n" + ".\n".join(s.upper() for s in mit) + ".\nOther text. All  Rights-Reserved."
    got = scan(spark, full, "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.", "All rights reserved. Released under the MIT License!", "no licence", None, "", "all rights reserved " * 3)
    assert got == [["MIT", "Proprietary"], ["Apache-2.0"], ["MIT", "Proprietary"], [], [], [], []]


def test_every_known_sentence_may_be_found(spark):
    import re

    known = [s for v in licences.ALL_SENTENCES.values() for s in v]
    assert len(set(known)) == len(known)
    may = re.compile(licences.MAY)
    needs = [s for s in known if not may.search(s)]
    assert not needs or all(k.startswith(("mi4", "mi5", "ap", "gp", "bs")) for k, v in licences.SENTENCES.items() if set(v) & set(needs))
    # each stands for its own identifier, and no other sentence is found in its place
    some = known[:60] + known[60::37]
    rows = spark.createDataFrame(list(enumerate(some)), "id long, text string")
    of = {s: k for k, v in licences.ALL_SENTENCES.items() for s in v}
    assert all(r["sentence_ids"] == [of[r["text"]]] for r in licences.licence_scan(rows).collect())


MIT_FILE = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD_FILE = """Copyright (c) 2020, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL_HEADER = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
GPL_2_HEADER = GPL_HEADER.replace("version 3", "version 2").split("You should")[0]
LGPL_HEADER = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
"""
AGPL_HEADER = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""
MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
EPL_HEADER = """This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/
"""
ISC_FILE = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
UNLICENSE_FILE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
"""
ZLIB_FILE = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
"""
BOOST_FILE = """Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:
"""
OFFICIAL = {"MIT": (MIT_FILE, "mi2 mi3 mi4 mi5"), "BSD-3-Clause": (BSD_FILE, "ar1 bs1 bs2 bs3 bs4"), "Apache-2.0": (APACHE_HEADER, "ap1 ap2 ap3 ap4 ap5"), "GPL-3.0-or-later": (GPL_HEADER, "gp2 gp3 gp4 gp5")}
OFFICIAL |= {
    "GPL-2.0-or-later": (GPL_2_HEADER, "gt1 gp3 gp4"), "LGPL-2.1-or-later": (LGPL_HEADER, "lg1"), "AGPL-3.0-or-later": (AGPL_HEADER, "ag1"), "MPL-2.0": (MPL_HEADER, "mp1 mp2"), "EPL-2.0": (EPL_HEADER, "ep1"),
    "ISC": (ISC_FILE, "is1"), "Unlicense": (UNLICENSE_FILE, "un1 un2"), "Zlib": (ZLIB_FILE, "zl1 zl2"), "BSL-1.0": (BOOST_FILE, "bo1"),
}


@pytest.mark.parametrize("prefix", ["", "# ", "// ", " * ", ";; ", "REM ", "dnl ", "\t", "-- | "])
def test_official_texts_with_wrapped_lines(spark, prefix):
    forms = [(name, ids, form) for name, (text, ids) in OFFICIAL.items() for form in ("".join(prefix + x + "\n" for x in text.split("\n")), "".join(prefix + x + "\r\n" for x in text.split("\n")))]
    df = spark.createDataFrame([(i, f[2]) for i, f in enumerate(forms)], "id long, text string")
    got = [(r["sentence_ids"], r["licences"]) for r in licences.licence_scan(df).orderBy("id").collect()]
    assert got == [(ids.split(), [name] + ["Proprietary"] * ("ar1" in ids)) for name, ids, _ in forms]


def test_where_sentences_go_on(spark):
    got = scan(spark, "All rights\nreserved", "All Rights-Reserved", "all rights. reserved", "All rights\n\nreserved", "All rights.\nreserved", " ".join(GPL_HEADER.split()), "; " * 9999 + "all rights |\n" + "# reserved", "Released under the MIT\nLicense and more")
    assert got == [["Proprietary"], ["Proprietary"], [], [], [], ["GPL-3.0-or-later"], ["Proprietary"], []]


def test_one_line_names_a_licence(spark):
    lines = {
        "SPDX-License-Identifier: MIT": ["MIT"], "// SPDX-License-Identifier: Apache-2.0": ["Apache-2.0"], "/* SPDX-License-Identifier: GPL-2.0-only */": ["GPL-2.0-only"], "# spdx-license-identifier:BSD-3-Clause\nx": ["BSD-3-Clause"],
        "Released under the MIT License, see LICENSE.": ["MIT"], "Licensed under the Apache License 2.0; see LICENSE for details.": ["Apache-2.0"], "Licensed under GPLv2.": ["GPL-2.0"], "Distributed under the GNU Lesser General Public License, version 2.1.": ["LGPL-2.1"],
        "This project is licensed under the Mozilla Public License 2.0.": ["MPL-2.0"], "Available under the ISC license!": ["ISC"], "This code is licensed under the Unlicense": ["Unlicense"], "Released under the Boost Software License, Version 1.0.": ["BSL-1.0"],
        "SPDX-License-Identifier: MIT OR Foo": [], "We like the MIT License.": [], "Licensed under GPLv2 or something else": [],
    }
    assert scan(spark, *lines) == list(lines.values())
    con = duckdb.connect()
    con.register("d", spark.createDataFrame([*enumerate(lines), (1, "All rights reserved."), (1, None)], "doc_id long, text string").toPandas())
    con.execute("CREATE VIEW documents AS SELECT * FROM d")
    found = con.execute(SQL["op5_licences"]).fetchall()
    assert sorted((r[0], r[3]) for r in found) == sorted([*((i, ",".join(v)) for i, v in enumerate(lines.values())), (1, "Proprietary"), (1, "")])


def test_same_as_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    df = QUERIES["op5_licences"](spark, SF)
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(SQL["op5_licences"]).fetchall())


def test_awkward(awkward):
    assert licences.licence_scan(awkward).count() == 9 and licences.licence_scan(awkward.limit(0)).count() == 0
    found = lengths.token_lengths(awkward, vocabulary()).collect()
    assert sum(r["n_docs"] for r in found) == 9 and max(r["length"] for r in found) == 40000
    assert lengths.token_lengths(awkward.limit(0), vocabulary()).count() == 0


@pytest.mark.parametrize("sizes", [[0, 0, 5, 5, 5, 2000, 2001, 70000], [7], [1023, 1024, 1025]])
def test_answers(spark, sizes):
    hist = spark.createDataFrame([(n, sizes.count(n)) for n in set(sizes)], "length long, n_docs long")
    for r in lengths.length_answers(hist).collect():
        k = r["length"]
        want = (sizes.count(k), sum(x > k for x in sizes), sum(x for x in sizes if x > k), sum(min(x, k) for x in sizes), sum(x <= k for x in sizes) / len(sizes))
        assert want == (r["n_docs"], r["docs_over"], r["tokens_over"], r["truncated_total"], r["quantile"])


def test_query_of_lengths_by_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(vocabulary())
    texts = [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    sizes = np.array([len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)])
    got = {r["length"]: r for r in QUERIES["op8_lengths"](spark, SF).collect()}
    assert sorted(got) == sorted(set(sizes.tolist()))
    for k, r in got.items():
        want = ((sizes == k).sum(), (sizes > k).sum(), sizes[sizes > k].sum(), np.minimum(sizes, k).sum(), (sizes <= k).mean())
        assert want == (r["n_docs"], r["docs_over"], r["tokens_over"], r["truncated_total"], r["quantile"])


def test_answers_for_given_limits(spark):
    sizes, limits = [0, 5, 5, 1500, 2048, 9000], [1, 5, 2048, 4096, 10**6]
    hist = spark.createDataFrame([(n, sizes.count(n)) for n in set(sizes)], "length long, n_docs long")
    got = {r["length"]: tuple(r)[1:] for r in lengths.length_answers(hist, limits).collect()}
    assert got == {k: (sizes.count(k), sum(x > k for x in sizes), sum(x for x in sizes if x > k), sum(min(x, k) for x in sizes), sum(x <= k for x in sizes) / 6) for k in limits}
    assert [tuple(r) for r in lengths.length_answers(hist.limit(0), [7]).collect()] == [(7, 0, 0, 0, 0, None)]
    assert lengths.length_answers(hist, []).count() == 0
