import textwrap

import duckdb
from pyspark.sql import functions as F

from flowguard.llm import licenses as l

APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://example.org/LICENSE

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""


def test_rules(spark):
    texts = {
        1: "Prose.\nReleased under the MIT License.\nMore prose",
        2: "prose no end\nLicensed under CC BY-NC 4.0.",
        3: APACHE,
        4: "You may obtain a copy of the License at\nhome",
        5: None,
        6: "",
        7: "It is not released under the MIT License today.",
        8: "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\n"
        "the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
        9: "This work is licensed under the GNU General Public License, version 3. Released under the MIT License!",
        10: "x. " * 20000 + "Released under the MIT License.",
    }
    rows = spark.createDataFrame([(k, t, "y") for k, t in texts.items()], "doc_id int, text string, found_lines string")
    got = {r.doc_id: r.found.licenses for r in l.mark(rows, "found").collect()}
    assert got == {
        1: ["MIT"], 2: ["CC-BY-NC-4.0"], 3: ["Apache-2.0"], 4: ["unknown"], 5: [], 6: [], 7: [], 8: ["GPL-3.0-or-later"], 9: ["GPL-3.0", "MIT"], 10: ["MIT"],
    }


def test_order_matters(spark):
    right = ["bsd-grant", "bsd-source", "bsd-binary"]
    for order, want in ((right, ["BSD-2-Clause"]), (right[::-1], ["unknown"])):
        text = "\n".join(l.SENTENCES[x][0] + "." for x in order)
        rows = spark.createDataFrame([(text,)], "text string")
        assert l.mark(rows, "found").first().found.licenses == want


def test_rules_name_known_identifiers(none):
    assert {x.rstrip("?") for _, rule in l.RULES for x in rule} <= set(l.SENTENCES)
    assert l.mark(none, "found").count() == 0


MIT = """The MIT License (MIT)
Copyright (c) 2020 A. Writer

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD2 = """Copyright 2019 A. Writer

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD3 = """BSD 3-Clause License

""" + BSD2 + """

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
GPL3 = """Copyright (C) 2021 A. Writer
This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
LGPL21 = """Copyright (C) 2021 A. Writer
This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."""
GPL2_TEXT = """GNU GENERAL PUBLIC LICENSE
Version 2, June 1991

Copyright (C) 1989, 1991 Free Software Foundation, Inc.

Preamble

The licenses for most software are designed to take away your freedom to share and change it."""
APACHE_TEXT = """Apache License
Version 2.0, January 2004
http://www.apache.org/licenses/

TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

1. Definitions.

"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
FILES = {
    "MIT": MIT, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3, "GPL-3.0-or-later": GPL3, "LGPL-2.1-or-later": LGPL21, "GPL-2.0": GPL2_TEXT,
    "Apache-2.0": APACHE_TEXT, "MPL-2.0": MPL,
}


def wrapped(text, width, mark="", end="\n"):
    paragraphs = ([""] if not line else textwrap.wrap(line, width) for line in text.split("\n"))
    return end.join(mark + line for lines in paragraphs for line in lines)


def test_whole_files_at_any_width(spark):
    """Titles, copyright lines, blank lines, comment marks and either line end leave a licence what it is."""
    forms = [(60,), (72,), (80,), (10**6,), (72, " * "), (60, "# ", "\r\n")]
    rows = [(name, str(form), wrapped(text, *form)) for name, text in FILES.items() for form in forms]
    got = l.mark(spark.createDataFrame(rows, "name string, form string, text string"), "found").collect()
    assert [(r.name, r.form, r.found.licenses) for r in got if r.found.licenses != [r.name]] == []


def test_sql_on_whole_files(spark, tmp_path):
    texts = [wrapped(text, 72) for text in FILES.values()] + [APACHE, None, "", "x\n\n\n\ny.\r\n" + MIT, "\x01a. " + MIT, "." * 5000 + "a"]
    texts = texts + texts[:1]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(f"SELECT doc_id, n_sentences, identifiers, licenses FROM ({l.oracle()})").fetchall()
    f = F.col("found")
    got = l.mark(docs, "found").select("doc_id", f.n_sentences, F.array_join(f.identifiers, ","), F.array_join(f.licenses, ","))
    assert sorted(map(tuple, got.collect())) == sorted(want)
