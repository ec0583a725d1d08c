"""Licence scan by sentence rules, in built-in functions only.

A text is cut into sentences, sentences are normalised (lower case, letters and digits, single spaces)
and looked up in a table of known licence sentences. The identifiers found, in text order, form one
sequence that is matched against ordered licence rules; what a rule has matched is taken out before
the next one is tried.

A sentence ends at a mark before white space, at a line without letters or digits, and around titles and
copyright lines; other line ends are spaces, as licences are wrapped and stand in comments.  Of a sentence
that is not known, each line is looked up by itself, so that a notice below a line without an end is found.

Everything is one expression over a row: no shuffle, and texts are read whole.

Defined results: a null or empty text has no sentences and no licence; equal rows are judged each; known
sentences that no rule claims leave the licence "unknown". Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowguard.llm.common import spare

#: Normalised sentences of public licence texts and notices, by identifier.
SENTENCES = {
    "mit-title": ["mit license", "the mit license", "the mit license mit", "mit license mit"],
    "mit-ref": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license"],
    "mit-grant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject "
        "to the following conditions"
    ],
    "mit-notice": [
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial "
        "portions of the software",
    ],
    "mit-liable": [
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract "
        "tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
    ],
    "isc-title": ["isc license", "the isc license"],
    "isc-grant": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the "
        "above copyright notice and this permission notice appear in all copies",
        "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the "
        "above copyright notice and this permission notice appear in all copies",
    ],
    "0bsd-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "isc-disclaim": [
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of "
        "merchantability and fitness"
    ],
    "zlib-title": ["zlib license", "the zlib license"],
    "zlib-as-is": ["this software is provided as is without any express or implied warranty"],
    "zlib-liable": ["in no event will the authors be held liable for any damages arising from the use of this software"],
    "zlib-grant": [
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute "
        "it freely subject to the following restrictions"
    ],
    "zlib-origin": ["the origin of this software must not be misrepresented"],
    "bsl-title": ["boost software license version 1 0 august 17th 2003"],
    "bsl-ref": ["distributed under the boost software license version 1 0"],
    "bsl-grant": [
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation "
        "covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative "
        "works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"
    ],
    "unlicense-free": ["this is free and unencumbered software released into the public domain"],
    "unlicense-anyone": [
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for "
        "any purpose commercial or non commercial and by any means"
    ],
    "as-is": [
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
        "merchantability fitness for a particular purpose and noninfringement"
    ],
    "apache-title": [
        "apache license version 2 0 january 2004 http www apache org licenses",
        "apache license version 2 0 january 2004 https www apache org licenses",
        "apache license version 2 0 january 2004",
    ],
    "apache-terms": ["terms and conditions for use reproduction and distribution"],
    "apache-def": [
        "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document"
    ],
    "apache-ref": [
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license",
        "this work is licensed under the apache license version 2 0",
    ],
    "apache-comply": ["you may not use this file except in compliance with the license"],
    "apache-copy": ["you may obtain a copy of the license at"],
    "apache-basis": [
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied"
    ],
    "gpl3-ref": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3"],
    "gpl2-ref": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2"],
    "gpl2-title": ["gnu general public license version 2 june 1991"],
    "gpl3-title": ["gnu general public license version 3 29 june 2007"],
    "lgpl21-title": ["gnu lesser general public license version 2 1 february 1999"],
    "lgpl3-title": ["gnu lesser general public license version 3 29 june 2007"],
    "agpl3-title": ["gnu affero general public license version 3 19 november 2007"],
    "gnu-everyone": [
        "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"
    ],
    "gpl2-preamble": ["the licenses for most software are designed to take away your freedom to share and change it"],
    "gpl3-preamble": ["the gnu general public license is a free copyleft license for software and other kinds of works"],
    "agpl3-preamble": [
        "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure "
        "cooperation with the community in the case of network server software"
    ],
    "lgpl3-adds": [
        "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license "
        "supplemented by the additional permissions listed below"
    ],
    "gpl-free": ["this program is free software", "this library is free software", "this file is free software"],
    "gpl-under": [
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"
    ],
    "lgpl-under": [
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"
    ],
    "either-2": ["either version 2 of the license or at your option any later version"],
    "either-21": ["either version 2 1 of the license or at your option any later version"],
    "either-3": ["either version 3 of the license or at your option any later version"],
    "lgpl21-later": [
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software "
        "foundation either version 2 1 of the license or at your option any later version"
    ],
    "lgpl3-later": [
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software "
        "foundation either version 3 of the license or at your option any later version"
    ],
    "agpl3-later": [
        "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software "
        "foundation either version 3 of the license or at your option any later version"
    ],
    "gpl3-later": [
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software "
        "foundation either version 3 of the license or at your option any later version"
    ],
    "gpl2-later": [
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software "
        "foundation either version 2 of the license or at your option any later version"
    ],
    "gpl-hope": [
        "this program is distributed in the hope that it will be useful but without any warranty",
        "this library is distributed in the hope that it will be useful but without any warranty",
        "without even the implied warranty of merchantability or fitness for a particular purpose",
    ],
    "bsd-title": ["bsd 2 clause license", "bsd 3 clause license", "the 2 clause bsd license", "the 3 clause bsd license"],
    "bsd-grant": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
    ],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": [
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
        "documentation and or other materials provided with the distribution"
    ],
    "bsd-name": [
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission",
        "neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission",
        "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "bsd-ads": ["all advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "cc0-ref": ["this work is dedicated to the public domain under cc0 1 0", "licensed under cc0 1 0"],
    "cc0-title": ["cc0 1 0 universal", "creative commons legal code cc0 1 0 universal", "creative commons cc0 1 0 universal"],
    "cc0-purpose": ["statement of purpose"],
    "mpl-ref": [
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "this source code form is subject to the terms of the mozilla public license v",  # "v. 2.0" ends a sentence
        "licensed under the mozilla public license version 2 0",
    ],
    "mpl-copy": [
        "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
        "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    ],
    "mpl-title": ["mozilla public license version 2 0"],
    "mpl-contributor": [
        "contributor means each individual or legal entity that creates contributes to the creation of or owns covered software"
    ],
    "epl2-title": ["eclipse public license v 2 0"],
    "epl1-title": ["eclipse public license v 1 0"],
    "epl-terms": ["the accompanying program is provided under the terms of this eclipse public license agreement"],
    "epl2-ref": [
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at "
        "https www eclipse org legal epl 2 0"
    ],
}
#: Creative Commons licences of version 4.0: the mark, and the name in words.
COMMONS = {
    "by": "attribution",
    "by-sa": "attribution sharealike",
    "by-nc": "attribution noncommercial",
    "by-nd": "attribution noderivatives",
    "by-nc-sa": "attribution noncommercial sharealike",
    "by-nc-nd": "attribution noncommercial noderivatives",
}
for _mark, _words in COMMONS.items():
    _short, _long = f"cc {_mark.replace('-', ' ')} 4 0", f"creative commons {_words} 4 0 international"
    SENTENCES[f"cc-{_mark}-ref"] = [f"{start}licensed under {_short}" for start in ("", "this work is ")] + [
        f"this work is licensed under a {_long} license",
        f"this work is licensed under the {_long} license",
    ]
    SENTENCES[f"cc-{_mark}-bound"] = [
        f"by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this {_long} public "
        "license public license"
    ]
#: Ordered rules: a licence and the identifiers, in order, that prove it; "?" marks what may be absent.
HEADER = ["gpl-free?", "gpl-under?", "either-2?", "gpl3-later?", "gpl2-later?", "gpl-hope?", "gpl-hope?"]  # how to apply, at the end of a text
RULES = [
    ("MIT", ["mit-title?", "mit-grant", "mit-notice", "as-is?", "mit-liable?"]),
    ("ISC", ["isc-title?", "isc-grant", "isc-disclaim?"]),
    ("0BSD", ["0bsd-grant", "isc-disclaim"]),
    ("Zlib", ["zlib-title?", "zlib-as-is", "zlib-liable", "zlib-grant", "zlib-origin?"]),
    ("BSL-1.0", ["bsl-title?", "bsl-grant"]),
    ("BSL-1.0", ["bsl-ref"]),
    ("Unlicense", ["unlicense-free", "unlicense-anyone?"]),
    ("BSD-4-Clause", ["bsd-title?", "bsd-grant", "bsd-source", "bsd-binary", "bsd-ads", "bsd-name?"]),
    ("BSD-3-Clause", ["bsd-title?", "bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]),
    ("BSD-2-Clause", ["bsd-title?", "bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0", ["gpl3-title", "gnu-everyone?", "gpl3-preamble", *HEADER]),
    ("GPL-2.0", ["gpl2-title", "gnu-everyone?", "gpl2-preamble", *HEADER]),
    ("LGPL-2.1", ["lgpl21-title", "gnu-everyone?", "gpl2-preamble", "gpl-free?", "lgpl-under?", "either-21?", "gpl-hope?", "gpl-hope?"]),
    ("LGPL-3.0", ["lgpl3-title", "gnu-everyone?", "lgpl3-adds"]),
    ("AGPL-3.0", ["agpl3-title", "gnu-everyone?", "agpl3-preamble", "gpl-free?", "agpl3-later?", "gpl-hope?", "gpl-hope?"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-later", "gpl-hope?", "gpl-hope?"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-under", "either-3", "gpl-hope?", "gpl-hope?"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl2-later", "gpl-hope?", "gpl-hope?"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl-under", "either-2", "gpl-hope?", "gpl-hope?"]),
    ("LGPL-2.1-or-later", ["gpl-free", "lgpl21-later", "gpl-hope?", "gpl-hope?"]),
    ("LGPL-2.1-or-later", ["gpl-free", "lgpl-under", "either-21", "gpl-hope?", "gpl-hope?"]),
    ("LGPL-3.0-or-later", ["gpl-free", "lgpl3-later", "gpl-hope?", "gpl-hope?"]),
    ("LGPL-3.0-or-later", ["gpl-free", "lgpl-under", "either-3", "gpl-hope?", "gpl-hope?"]),
    ("AGPL-3.0-or-later", ["gpl-free", "agpl3-later", "gpl-hope?", "gpl-hope?"]),
    ("Apache-2.0", ["apache-title", "apache-terms?", "apache-def"]),
    ("Apache-2.0", ["apache-ref", "apache-comply?", "apache-copy?", "apache-basis?"]),
    ("GPL-3.0", ["gpl3-ref"]),
    ("GPL-2.0", ["gpl2-ref"]),
    *[(f"CC-{m.upper()}-4.0", [f"cc-{m}-{x}"]) for m in COMMONS for x in ("bound", "ref")],
    ("CC0-1.0", ["cc0-title", "cc0-purpose"]),
    ("CC0-1.0", ["cc0-ref"]),
    ("MPL-2.0", ["mpl-title", "mpl-contributor", "mpl-ref?", "mpl-copy?"]),
    ("MPL-2.0", ["mpl-ref", "mpl-copy?"]),
    ("EPL-2.0", ["epl2-title", "epl-terms"]),
    ("EPL-2.0", ["epl2-ref"]),
    ("EPL-1.0", ["epl1-title", "epl-terms"]),
    ("MIT", ["mit-ref"]),
]
CUT = "\x01"
#: A sentence ends at these marks before white space or the end of a text.
ENDS = r"[.!?;:]([ \t\n\f]|\z)"
OTHER = r"[^a-z0-9\n\x01]+"
BLANK = r"\n ?\n"
#: Lines of normalised text that stand alone: who holds the copyright, and a title.
HOLDER = r"(\A|[\n\x01]) ?(copyright (c|[0-9]|year|yyyy|by|the [a-z]+ authors)[^\n]*|c [0-9][^\n]*|all rights reserved)"
TITLES = [x for name, all_ in SENTENCES.items() if name in ("mit-title", "isc-title", "zlib-title", "bsd-title", "mpl-title") for x in all_]
TITLE = rf"(\A|[\n\x01]) ?({'|'.join(TITLES)}) ?(\n|\x01|\z)"
SPACE = r"[ \n]+"


def pattern(rule: list[str]) -> str:
    """A regular expression over a sequence ";a;;b;", in which each identifier has marks of its own."""
    return "".join(f"(;{x[:-1]};)?" if x.endswith("?") else f";{x};" for x in rule)


def _known() -> dict[str, str]:
    return {sentence: name for name, all_ in SENTENCES.items() for sentence in all_}


def sentences(text: Column) -> Column:
    """Normalised sentences, in which line ends are left."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + CUT, "abcdefghijklmnopqrstuvwxyz ")
    low = F.translate(F.replace(low, F.lit("\r\n"), F.lit("\n")), "\r", "\n")
    plain = F.regexp_replace(F.regexp_replace(low, ENDS, f"{CUT}$1"), OTHER, " ")
    for alone in (HOLDER, TITLE):
        plain = F.regexp_replace(plain, alone, f"{CUT}$2{CUT}\n")
    plain = F.regexp_replace(plain, BLANK, CUT)
    return F.filter(F.transform(F.split(plain, CUT, -1), lambda s: F.btrim(s, F.lit(" \n"))), lambda s: s != "")


def _identifiers(found: Column) -> Column:
    """Identifiers of the known sentences, or else lines of them, in text order."""
    table = F.create_map(*[F.lit(x) for pair in _known().items() for x in pair])
    looked = F.transform(found, lambda s: F.struct(F.try_element_at(table, F.regexp_replace(s, SPACE, " ")).alias("id"), s.alias("s")))

    def by_line(s: Column) -> Column:
        lines = F.when(F.contains(s, F.lit("\n")), F.split(s, "\n", -1)).otherwise(F.array().cast("array<string>"))
        return F.transform(lines, lambda x: F.try_element_at(table, F.btrim(x)))

    ids = F.transform(looked, lambda x: F.when(x["id"].isNotNull(), F.array(x["id"])).otherwise(by_line(x["s"])))
    return F.filter(F.flatten(ids), lambda x: x.isNotNull())


def _licenses(sequence: Column) -> Column:
    """Names of the rules that match, in their order."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(pattern(rule)).alias("pattern")) for name, rule in RULES])
    start = F.struct(sequence.alias("rest"), F.array().cast("array<string>").alias("names"))

    def step(state: Column, rule: Column) -> Column:
        hit = F.regexp_like(state["rest"], rule["pattern"])
        return F.struct(
            F.regexp_replace(state["rest"], rule["pattern"], F.lit("|")).alias("rest"),
            F.when(hit, F.array_append(state["names"], rule["name"])).otherwise(state["names"]).alias("names"),
        )

    return F.aggregate(rules, start, step, lambda s: F.array_distinct(s["names"]))


def mark(docs: DataFrame, into: str, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``into`` of n_sentences, identifiers and licenses (two arrays in order)."""
    cut, found = (spare(docs, f"{into}_{x}") for x in ("cut", "found"))
    rows = docs.withColumn(cut, sentences(F.coalesce(F.col(text), F.lit("")))).withColumn(found, _identifiers(F.col(cut)))
    row = F.array_join(F.transform(found, lambda x: F.concat(F.lit(";"), x, F.lit(";"))), "")
    any_ = F.size(found) > 0
    matched = F.when(any_, _licenses(row)).otherwise(F.array().cast("array<string>"))
    matched = F.transform(F.array(matched), lambda m: F.when(any_ & (F.size(m) == 0), F.array(F.lit("unknown"))).otherwise(m))[0]
    out = F.struct(F.size(cut).cast("long").alias("n_sentences"), F.array_distinct(found).alias("identifiers"), matched.alias("licenses"))
    return rows.select(*docs.columns, out.alias(into))


def query(spark, sf_dir: str) -> DataFrame:
    """Known licence sentences and licences of every document."""
    from flowguard.llm.common import documents

    found = mark(documents(spark, sf_dir).select("doc_id", "text"), "found")
    f = F.col("found")
    return found.select(
        "doc_id", f.n_sentences.alias("n_sentences"), F.array_join(f.identifiers, ",").alias("identifiers"), F.array_join(f.licenses, ",").alias("licenses")
    )


def oracle() -> str:
    """The same in DuckDB SQL."""
    rows = ", ".join(f"('{s}', '{n}')" for s, n in _known().items())
    text = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(1), 'abcdefghijklmnopqrstuvwxyz ')"
    text = f"translate(replace({text}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    alone = r"chr(1) || '\2' || chr(1) || chr(10)"
    for regex, by in ((ENDS, r"chr(1) || '\1'"), (OTHER, "' '"), (HOLDER, alone), (TITLE, alone), (BLANK, "chr(1)")):
        text = f"regexp_replace({text}, '{regex}', {by}, 'g')"
    steps = [
        """m0 AS (SELECT doc_id, n_sentences, a, array_to_string(list_transform(a, lambda x: ';' || x || ';'), '') AS rest,
          CAST([] AS VARCHAR[]) AS names FROM ids)"""
    ]
    for k, (name, rule) in enumerate(RULES):
        p = pattern(rule)
        steps.append(
            f"m{k + 1} AS (SELECT doc_id, n_sentences, a, regexp_replace(rest, '{p}', '|', 'g') AS rest, "
            f"CASE WHEN regexp_matches(rest, '{p}') AND NOT list_contains(names, '{name}') THEN list_append(names, '{name}') ELSE names END AS names FROM m{k})"
        )
    return f"""
WITH known(sentence, id) AS (VALUES {rows}), t AS (SELECT map(list(sentence), list(id)) AS m FROM known),
s AS (SELECT doc_id, list_filter(list_transform(string_split({text}, chr(1)), lambda s: trim(s, ' ' || chr(10))), lambda s: s != '') AS cut
  FROM documents),
ids AS (SELECT doc_id, CAST(len(cut) AS BIGINT) AS n_sentences,
  list_filter(flatten(list_transform(cut, lambda s: CASE WHEN m[regexp_replace(s, '{SPACE}', ' ', 'g')] IS NOT NULL
    THEN [m[regexp_replace(s, '{SPACE}', ' ', 'g')]] WHEN contains(s, chr(10))
    THEN list_transform(string_split(s, chr(10)), lambda x: m[trim(x)]) ELSE CAST([] AS VARCHAR[]) END)), lambda x: x IS NOT NULL) AS a
  FROM s, t),
{", ".join(steps)}
SELECT doc_id, n_sentences,
  array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ',') AS identifiers,
  CASE WHEN len(a) > 0 AND len(names) = 0 THEN 'unknown' ELSE array_to_string(names, ',') END AS licenses
FROM m{len(RULES)}
"""
