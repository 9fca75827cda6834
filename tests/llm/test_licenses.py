"""Licence notices as they are found in files: whole, and wrapped behind comment marks."""

import textwrap

import duckdb
import pytest
from lodestone.llm import licenses

NOTICES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
FOUND = {"MIT": "mit-grant,mit-notice-kept,as-is", "GPL-2.0-or-later": "gpl2-or-later,gpl-hope", "GPL-3.0-or-later": "gpl3-or-later,gpl-hope", "MPL-2.0": "mpl2-notice", "Apache-2.0": "apache-notice,apache-compliance,apache-copy,apache-basis", "BSD-3-Clause": "bsd-grant,bsd-source,bsd-binary,bsd-endorse", "BSD-2-Clause": "bsd-grant,bsd-source,bsd-binary", "ISC": "isc-grant", "Unlicense": "unlicense"}


@pytest.mark.parametrize("width", [0, 30, 60, 76])
@pytest.mark.parametrize("mark", ["", " * ", "# ", "// "])
def test_notices(spark, width, mark):
    def laid(text):
        parts = [textwrap.wrap(p, width) if width else [p] for p in text.split("\n\n")]
        return "x = 1.\r\n" + "\r\n".join(mark + line for p in parts for line in [*p, ""]) + "\r\ny = 2"

    names = list(NOTICES)
    d = spark.createDataFrame([(k, laid(NOTICES[n])) for k, n in enumerate(names)], "doc_id long, text string")
    got = {names[r["doc_id"]]: (r["license"], r["ids"]) for r in licenses.scan(d).collect()}
    assert got == {n: (n, FOUND[n]) for n in names}


def test_part_of_a_sentence_is_none(spark):
    texts = ["We say: released under the MIT license today.", "released under\nthe MIT license\n", "not released under\nthe MIT license", ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["n_found"] for r in licenses.scan(d).collect()} == {0: 0, 1: 1, 2: 0, 3: 0}


BSD = NOTICES["BSD-3-Clause"]
MORE = {
    "BSD-3-Clause of a named holder": (BSD.replace("the copyright holder nor the names of its contributors", "Google Inc. nor the names of its contributors"), "BSD-3-Clause", "BSD-3-Clause"),
    "BSD-3-Clause of an author": (NOTICES["BSD-2-Clause"] + "\n\n3. The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.", "BSD-3-Clause", "BSD-3-Clause"),
    "BSD-4-Clause": (NOTICES["BSD-2-Clause"] + "\n\n3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software.", "BSD-4-Clause", "BSD-4-Clause"),
    "LGPL": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "LGPL-2.1-or-later", "LGPL-2.1-or-later"),
    "AGPL": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "AGPL-3.0-or-later", "AGPL-3.0-or-later"),
    "GPL-2.0-only": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "GPL-2.0-only", "GPL-2.0-only"),
    "zlib": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "Zlib", "Zlib"),
    "CC0": ("To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.", "CC0-1.0", "CC0-1.0"),
    "Boost": ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0", "BSL-1.0"),
    "0BSD": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "0BSD", "0BSD"),
    "tag": ("// SPDX-License-Identifier: MIT\nint main() {}", "MIT", "MIT"),
    "longer tag": ("# SPDX-License-Identifier: GPL-2.0-or-later\r\n", "GPL-2.0-or-later", "GPL-2.0-or-later"),
    "tag of something else": ("SPDX-License-Identifier: LicenseRef-Mine", None, ""),
    "tag and notice": ("SPDX-License-Identifier: Apache-2.0\nReleased under the MIT License.", "MIT", "MIT,Apache-2.0"),
    "too long a name": (BSD.replace("the copyright holder", "x " * 60), "BSD-2-Clause", "BSD-2-Clause"),
}


@pytest.mark.parametrize("width", [0, 40, 76])
def test_slots_tags_and_what_excludes(spark, width):
    """Holders' names, licences that lack or have a clause more, tags; and the SQL on the same texts, wrapped ones too."""
    laid = lambda t: "\n".join(line for p in t.split("\n") for line in (textwrap.wrap(p, width, break_on_hyphens=False) if width else [p]))
    names = list(MORE)
    d = spark.createDataFrame([(k, laid(MORE[n][0])) for k, n in enumerate(names)] + [(90, None), (91, "")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licenses.scan(d).collect()}
    assert {names[k]: (r["license"], r["licenses"]) for k, r in rows.items() if k < 90} == {n: MORE[n][1:] for n in names}
    con = duckdb.connect()
    con.register("documents", d.toPandas())
    cur = con.execute(licenses.oracle())
    columns = [c[0] for c in cur.description]
    assert sorted(map(repr, cur.fetchall())) == sorted(repr(tuple(r[c] for c in columns)) for r in rows.values())


def test_equals_sql_on_tables(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}'")
    d = licenses.scan(spark.read.parquet(path))
    cur = con.execute(licenses.oracle())
    names = [c[0] for c in cur.description]
    want = sorted(map(repr, cur.fetchall()))
    assert sorted(repr(tuple(r[c] for c in names)) for r in d.collect()) == want


def test_own_sentences(spark):
    """A table of sentences and rules of one's own; no word of it is in the fixed one."""
    d = spark.createDataFrame([(1, "Do what\nyou like. Have fun!"), (2, "Have fun! Do what you like."), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["ids"], r["license"]) for r in licenses.scan(d, known={"do what you like": "a", "have fun": "b"}, rules=(("Fun", "own", ("a", "b"), ()),)).collect()}
    assert got == {1: ("a,b", "Fun"), 2: ("b,a", None), 3: ("", None)}
