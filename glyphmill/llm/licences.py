"""Operator 5: licence scans by sentences and rules, with DataFrame functions only.

A text is cut into pieces, each is normalised, runs of pieces that wrapped lines or
';' and ':' have cut are looked up among known licence sentences, and the sequence
of the identifiers found is matched against ordered rules. What a rule has matched is taken out before the next rule looks. No rows are
shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The known sentences, normalised, by identifier (two letters and a digit).
SENTENCES = {
    "mi1": ("released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "distributed under the mit license"),
    "mi2": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    ),
    "mi3": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "mi4": (
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    ),
    "mi5": (
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    "ap1": ("licensed under the apache license version 2 0", "released under the apache license version 2 0", "licensed under the apache license version 2 0 the license"),
    "ap2": ("you may not use this file except in compliance with the license",),
    "ap3": ("you may obtain a copy of the license at", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    "ap4": (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    "ap5": ("see the license for the specific language governing permissions and limitations under the license",),
    "gp1": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3"),
    "gp2": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    "gp3": (
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    ),
    "gp4": ("see the gnu general public license for more details",),
    "gp5": ("you should have received a copy of the gnu general public license along with this program",),
    "bs1": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bs2": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bs3": (
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    "bs4": (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "cn1": ("licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    "cb1": ("licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"),
    "cs1": ("licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    "cz1": ("this work is dedicated to the public domain", "released under cc0 1 0", "licensed under cc0 1 0"),
    "ar1": ("all rights reserved",),
    "gt1": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    ),
    "lg1": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    ),
    "lh1": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    "ag1": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    "mp1": ("this source code form is subject to the terms of the mozilla public license v",),
    "mp2": (
        "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
        "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    ),
    "ep1": ("this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",),
    "is1": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "un1": ("this is free and unencumbered software released into the public domain",),
    "un2": (
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
    "zl1": ("this software is provided as is without any express or implied warranty",),
    "zl2": (
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    ),
    "bo1": (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    ),
}
#: How one line names a licence, and what may follow the name.
VERBS = ("licensed under", "released under", "distributed under", "available under", "this project is licensed under", "this work is licensed under", "this software is licensed under", "this code is licensed under")
TAILS = ("see license", "see license for details", "see license for more information", "see the license file", "see the license file for details")
#: Fixed values: (licence, its names in such lines).
NAMES = (
    ("MIT", ("mit license", "mit licence")),
    ("Apache-2.0", ("apache license 2 0", "apache license version 2 0", "apache 2 0 license")),
    ("GPL-2.0", ("gnu general public license version 2", "gnu gpl version 2", "gpl version 2", "gplv2", "gpl v2", "gpl 2 0")),
    ("GPL-3.0", ("gnu general public license version 3", "gnu gpl version 3", "gpl version 3", "gplv3", "gpl v3", "gpl 3 0")),
    ("LGPL-2.1", ("gnu lesser general public license version 2 1", "lgpl version 2 1", "lgplv2 1", "lgpl 2 1")),
    ("LGPL-3.0", ("gnu lesser general public license version 3", "lgpl version 3", "lgplv3", "lgpl 3 0")),
    ("AGPL-3.0", ("gnu affero general public license version 3", "agpl version 3", "agplv3", "agpl 3 0")),
    ("MPL-2.0", ("mozilla public license 2 0", "mozilla public license version 2 0", "mpl 2 0 license")),
    ("EPL-2.0", ("eclipse public license 2 0", "eclipse public license version 2 0", "eclipse public license v2 0")),
    ("ISC", ("isc license",)),
    ("BSD-2-Clause", ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license")),
    ("BSD-3-Clause", ("bsd 3 clause license", "3 clause bsd license", "new bsd license")),
    ("Unlicense", ("unlicense",)),
    ("Zlib", ("zlib license",)),
    ("BSL-1.0", ("boost software license 1 0", "boost software license version 1 0")),
)
#: The licences that a line with an SPDX identifier may name.
SPDX = (
    "MIT", "Apache-2.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Unlicense", "Zlib", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0",
)
TAG = "spdx license identifier"


def one_line() -> tuple[dict[str, tuple[str, ...]], list[tuple[str, tuple[str]]]]:
    """(sentences, rules) of the lines that VERBS, NAMES, TAILS and SPDX describe, without those that stand in SENTENCES."""
    sentences, rules = {}, []
    taken = {s for known in SENTENCES.values() for s in known}
    for i, (licence, names) in enumerate(NAMES):
        own = [f"{verb} {the}{name}{tail}" for verb in VERBS for the in ("the ", "") for name in names for tail in ("", *(f" {t}" for t in TAILS))]
        sentences[f"n{chr(97 + i)}1"] = tuple(s for s in own if s not in taken)
        rules.append((licence, (f"n{chr(97 + i)}1",)))
    for i, licence in enumerate(SPDX):
        name = f"{'xy'[i // 26]}{chr(97 + i % 26)}1"
        sentences[name] = (f"{TAG} {licence.lower().replace('-', ' ').replace('.', ' ')}",)
        rules.append((licence, (name,)))
    return sentences, rules


#: Fixed values: (licence, sequence of identifiers), the first that matches first.
RULES = (
    ("MIT", ("mi2", "mi3", "mi4", "mi5")),
    ("MIT", ("mi2", "mi3")),
    ("Apache-2.0", ("ap1", "ap2", "ap3", "ap4", "ap5")),
    ("Apache-2.0", ("ap1", "ap2")),
    ("GPL-3.0-or-later", ("gp2", "gp3", "gp4", "gp5")),
    ("GPL-3.0-or-later", ("gp2",)),
    ("BSD-3-Clause", ("bs1", "bs2", "bs3", "bs4")),
    ("BSD-2-Clause", ("bs1", "bs2", "bs3")),
    ("GPL-2.0-or-later", ("gt1", "gp3", "gp4")),
    ("GPL-2.0-or-later", ("gt1",)),
    ("LGPL-2.1-or-later", ("lg1",)),
    ("LGPL-3.0-or-later", ("lh1",)),
    ("AGPL-3.0-or-later", ("ag1",)),
    ("MPL-2.0", ("mp1", "mp2")),
    ("MPL-2.0", ("mp1",)),
    ("EPL-2.0", ("ep1",)),
    ("ISC", ("is1",)),
    ("Unlicense", ("un1", "un2")),
    ("Unlicense", ("un1",)),
    ("Zlib", ("zl1", "zl2")),
    ("Zlib", ("zl2",)),
    ("BSL-1.0", ("bo1",)),
    ("MIT", ("mi1",)),
    ("Apache-2.0", ("ap1",)),
    ("GPL-3.0", ("gp1",)),
    ("CC-BY-NC-4.0", ("cn1",)),
    ("CC-BY-SA-4.0", ("cs1",)),
    ("CC-BY-4.0", ("cb1",)),
    ("CC0-1.0", ("cz1",)),
    ("Proprietary", ("ar1",)),
)
LINES, LINE_RULES = one_line()
#: (names or tagged lines, identifier) of the sentences of one line.
ONE_LINE = [(known if known[0].startswith(TAG) else names, name) for (name, known), names in zip(LINES.items(), [n for _, n in NAMES] + [()] * len(SPDX), strict=True)]
#: All sentences and rules; a rule of one line looks after the longer ones.
ALL_SENTENCES, ALL_RULES = {**SENTENCES, **LINES}, (*RULES, *LINE_RULES)
#: Fixed value: each known sentence holds one of these; a word of a known sentence stands unbroken in the lower-cased text, whatever separates words, so texts without them have none.
MAY = "licen|permission|copyright|redistribut|warrant|reserved|domain|cc0|software|gpl|mozilla|mpl"


def pattern() -> str:
    """A known sentence in a marked text, where pieces end in '#' at a sentence's or paragraph's end, else in '|'; a sentence may hold the latter between its words."""
    one_of = lambda known: "(?:" + "|".join(sorted(known, key=len, reverse=True)) + ")"
    short = f"{one_of(VERBS)} (?:the )?{one_of(n for _, names in NAMES for n in names)}(?: {one_of(TAILS)})?"
    tags = f"{TAG} {one_of(k.removeprefix(f'{TAG} ') for v in LINES.values() for k in v if k.startswith(TAG))}"
    known = [k for v in SENTENCES.values() for k in v]
    return "[|#] " + one_of([*known, short, tags]).replace(" ", r"(?: \|)? ") + "(?= [|#])"


KNOWN = pattern()


def normalised(sentence: Column) -> Column:
    """Lower case, one space for each run of what is no ASCII letter or digit, trimmed."""
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def marked(text: Column) -> Column:
    """The normalised pieces of a text, each between two marks.

    Pieces end at a line's end, or at one of .!?;: before white space. The mark is '#'
    where a sentence ends, or at a line without letters and digits, and '|' where it may
    go on: at other line ends and after ';' and ':'. Comment signs at a line's start are
    no part of a piece.
    """
    out = F.concat(F.lit("#"), F.regexp_replace(F.translate(F.lower(text), "|#", "__"), r"(?md)^[ \t]*@?(?:rem|dnl)[ \t]+", ""), F.lit("#"))
    steps = (
        (r"[.!?](?:[ \t\r]+|(?=\n))", "#"),
        (r"[;:][ \t\r]+", "|"),
        (r"[^a-z0-9|#\n]+", " "),
        (r"\|[| ]*+", "|"),
        (r"[ |]*+\n[ |]*+", "\n"),
        (r"\n\n+", "#"),
        (r"[ |\n]*+#[ |\n#]*+", "#"),
        (r" ?[|\n] ?", " | "),
        (r"#", " # "),
    )
    for pattern, new in steps:
        out = F.regexp_replace(out, pattern, new)
    return out


#: What names the licence in a normalised sentence of one line, or in one with a tag.
SHORT = rf"^(?:{'|'.join(VERBS)}) (?:the )?({'|'.join(sorted((n for _, names in NAMES for n in names), key=len, reverse=True))})(?: (?:{'|'.join(TAILS)}))?$|^({TAG} .*)$"


def identifier(sentence: Column) -> Column:
    """The identifier of a normalised sentence, the empty string if it is not known: whole sentences first, then what one line names."""
    named = F.concat(F.regexp_extract(sentence, SHORT, 1), F.regexp_extract(sentence, SHORT, 2))
    out = F.element_at(F.create_map(*[F.lit(x) for names, name in ONE_LINE for n in names for x in (n, name)]), named)
    out = F.coalesce(out, F.lit(""))
    for name, known in SENTENCES.items():
        out = F.when(sentence.isin(*known), name).otherwise(out)
    return out


def licence_scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``sentence_ids`` (array, in the text's order) and ``licences`` (array, in the rules' order).

    Columns of these names are replaced. Null and empty texts have neither. A rule
    matches identifiers that follow one another, whatever unknown sentences stand
    between, and counts once however often it matches. Repeated rows give repeated
    results, an empty table an empty one; texts are read whole.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    found = F.transform(F.transform(F.regexp_extract_all(marked(text), F.lit(KNOWN), F.lit(0)), normalised), identifier)
    out = docs.withColumn("sentence_ids", F.when(F.lower(text).rlike(MAY), found).otherwise(F.array().cast("array<string>")))
    rest = F.concat(F.array_join("sentence_ids", " "), F.lit(" "))
    state = F.struct(rest.alias("rest"), F.array().cast("array<string>").alias("hits"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(" ".join(sequence) + " ").alias("mark")) for name, sequence in ALL_RULES])

    def step(acc: Column, rule: Column) -> Column:
        hit = acc.rest.contains(rule["mark"])
        return F.struct(
            F.when(hit, F.replace(acc.rest, rule["mark"], F.lit("| "))).otherwise(acc.rest).alias("rest"), F.when(hit, F.array_append(acc.hits, rule["name"])).otherwise(acc.hits).alias("hits")
        )

    licences = F.array_distinct(F.aggregate(rules, state, step, lambda acc: acc.hits))
    return out.withColumn("licences", F.when(F.size("sentence_ids") > 0, licences).otherwise(F.array().cast("array<string>")))


def oracle() -> str:
    """The query's rows in DuckDB SQL, from the same sentences and rules."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    listed = ", ".join(f"({quote(s)}, {quote(name)})" for name, known in ALL_SENTENCES.items() for s in known)
    steps, hits = [], []
    for k, (name, sequence) in enumerate(ALL_RULES):
        mark = quote(" ".join(sequence) + " ")
        steps.append(f"s{k + 1} AS (SELECT *, replace(rest{k}, {mark}, '| ') AS rest{k + 1} FROM s{k})")
        hits.append(f"CASE WHEN contains(rest{k}, {mark}) THEN {quote(name)} END")
    # the licences stand in the order of the first rule that matched
    order = "array_to_string(list_filter(list_transform(range(1, len(hits) + 1), lambda i: CASE WHEN hits[i] IS NOT NULL AND list_position(hits, hits[i]) = i THEN hits[i] END), lambda x: x IS NOT NULL), ',')"
    return f"""
    WITH cut AS (
      SELECT row_number() OVER () AS rid, doc_id, list_transform(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '(spdx-license-identifier):[ \\t\\r]+', '\\1 ', 'gi'), '([.!?;:])[ \\t\\r]+', '\\1' || chr(10), 'g'), chr(10)),
        lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))) AS parts FROM documents),
    listed(s, id) AS (VALUES {listed}),
    found AS (SELECT rid, list(id ORDER BY pos) AS ids FROM (SELECT rid, unnest(parts) AS s, generate_subscripts(parts, 1) AS pos FROM cut) JOIN listed USING (s) GROUP BY rid),
    known AS (SELECT doc_id, coalesce(ids, []) AS ids FROM cut LEFT JOIN found USING (rid)),
    s0 AS (SELECT doc_id, ids, array_to_string(ids, ' ') || ' ' AS rest0 FROM known),
    {", ".join(steps)},
    rules AS (SELECT doc_id, ids, [{", ".join(hits)}] AS hits FROM s{len(ALL_RULES)})
    SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ',') AS sentence_ids, {order} AS licences FROM rules
    """
