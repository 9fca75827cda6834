"""License scans by sentence rules.

Texts are normalised (lower case, letters and digits only) and cut where a sentence or line ends.
Slots (a holder's name in an endorsement clause) are filled alike. A known licence sentence is found
where it equals one piece or several that follow each other, the longest first; a tag that names an
identifier of a licence is such a sentence too. A text becomes the sequence of the identifiers found.
Rules, in order of rank, match identifier sequences, unless one stands there that the rule excludes;
the first that matches names the licence, all that match are listed. Everything happens in the row,
so texts never move. Expressions of several licences in one tag are not known.

Defined results: null and empty texts have no sentences and no licence; repeated rows are judged
one by one; an empty table gives no rows.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences, normalised, and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache-notice",
    "licensed under the apache license version 2 0 the license": "apache-notice",
    "you may not use this file except in compliance with the license": "apache-compliance",
    "you may obtain a copy of the license at": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-basis",
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice-kept",
    "the software is provided as is without warranty of any kind express or implied": "as-is",
    "this work is licensed under the gnu general public license version 3": "gpl3-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-or-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-or-later",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl-hope",
    "licensed under cc by nc 4 0": "cc-by-nc-4",
    "licensed under cc by 4 0": "cc-by-4",
    "licensed under cc by sa 4 0": "cc-by-sa-4",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-notice",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advert",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl2-only",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license": "gpl2-only",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license": "gpl3-only",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21-or-later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-or-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-or-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-or-later",
    "this library is distributed in the hope that it will be useful but without any warranty": "gpl-hope",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "distributed under the boost software license version 1 0": "boost-notice",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "boost-grant",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0-dedication",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-4",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-4",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl2-notice",
    "licensed under the bsd 3 clause license": "bsd3-notice",
    "licensed under the bsd 2 clause license": "bsd2-notice",
}

# Sentences of the full licences that go on past the known text, and their identifiers.
LONGER = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "as-is",
}
# Identifiers of licences in tags, by family.
TAGGED = {
    "permissive": ("0BSD", "AFL-3.0", "Apache-1.1", "Apache-2.0", "Artistic-2.0", "BlueOak-1.0.0", "BSD-1-Clause", "BSD-2-Clause", "BSD-2-Clause-Patent", "BSD-3-Clause", "BSD-3-Clause-Clear", "BSD-4-Clause", "BSL-1.0", "CC-BY-3.0", "CC-BY-4.0", "curl", "ECL-2.0", "FTL", "HPND", "ICU", "ISC", "libpng-2.0", "MIT", "MIT-0", "MS-PL", "MulanPSL-2.0", "NCSA", "OpenSSL", "PHP-3.01", "PostgreSQL", "Python-2.0", "PSF-2.0", "Ruby", "Unicode-3.0", "UPL-1.0", "W3C", "X11", "Zlib"),
    "copyleft": ("AGPL-3.0-only", "AGPL-3.0-or-later", "CC-BY-SA-4.0", "CDDL-1.0", "CECILL-2.1", "CPL-1.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MPL-1.1", "MPL-2.0", "MS-RL", "OFL-1.1", "OSL-3.0"),
    "public-domain": ("CC0-1.0", "Unlicense", "WTFPL"),
    "non-commercial": ("CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0"),
}
TAG = "spdx license identifier"


def _words(name: str) -> str:
    return re.sub("[^a-z0-9]+", " ", name.lower())


TAGS = {f"{TAG} {_words(n)}": f"tag-{n}" for names in TAGGED.values() for n in names}
KNOWN = SENTENCES | LONGER | TAGS

#: Slots: what stands there in a text's pieces, and how it is filled. Up to 40 words name a holder.
_NAME = "(?:[a-z0-9]+[ \n]+){1,40}?"
SLOTS = (
    (rf"neither[ \n]+the[ \n]+names?[ \n]+of[ \n]+{_NAME}nor[ \n]+the[ \n]+names[ \n]+of[ \n]+{_NAME}may[ \n]+be[ \n]+used", "neither the name of the copyright holder nor the names of its contributors may be used"),
    (rf"the[ \n]+names?[ \n]+of[ \n]+{_NAME}may[ \n]+not[ \n]+be[ \n]+used[ \n]+to[ \n]+endorse", "the name of the author may not be used to endorse"),
)

# Rules by rank: licence, family, the identifiers that must follow each other (others may stand between), and those that must not be there.
RULES = (
    ("Apache-2.0", "permissive", ("apache-notice", "apache-compliance", "apache-basis"), ()),
    ("BSD-4-Clause", "permissive", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert"), ()),
    ("BSD-3-Clause", "permissive", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"), ("bsd-advert",)),
    ("BSD-2-Clause", "permissive", ("bsd-grant", "bsd-source", "bsd-binary"), ("bsd-endorse", "bsd-advert")),
    ("MIT", "permissive", ("mit-grant", "mit-notice-kept", "as-is"), ()),
    ("AGPL-3.0-or-later", "copyleft", ("agpl3-or-later",), ()),
    ("LGPL-3.0-or-later", "copyleft", ("lgpl3-or-later",), ()),
    ("LGPL-2.1-or-later", "copyleft", ("lgpl21-or-later",), ()),
    ("GPL-3.0-or-later", "copyleft", ("gpl3-or-later", "gpl-hope"), ()),
    ("GPL-2.0-or-later", "copyleft", ("gpl2-or-later", "gpl-hope"), ()),
    ("GPL-3.0-only", "copyleft", ("gpl3-only",), ()),
    ("GPL-2.0-only", "copyleft", ("gpl2-only",), ()),
    ("ISC", "permissive", ("isc-grant",), ()),
    ("0BSD", "permissive", ("0bsd-grant",), ()),
    ("MPL-2.0", "copyleft", ("mpl2-notice",), ()),
    ("EPL-2.0", "copyleft", ("epl2-notice",), ()),
    ("Zlib", "permissive", ("zlib-grant",), ()),
    ("BSL-1.0", "permissive", ("boost-grant",), ()),
    ("BSL-1.0", "permissive", ("boost-notice",), ()),
    ("CC0-1.0", "public-domain", ("cc0-dedication",), ()),
    ("Unlicense", "public-domain", ("unlicense",), ()),
    ("CC-BY-NC-4.0", "non-commercial", ("cc-by-nc-4",), ()),
    ("CC-BY-SA-4.0", "copyleft", ("cc-by-sa-4",), ()),
    ("CC-BY-4.0", "permissive", ("cc-by-4",), ()),
    ("GPL-3.0-only", "copyleft", ("gpl3-notice",), ()),
    ("GPL-3.0-or-later", "copyleft", ("gpl3-or-later",), ()),
    ("GPL-2.0-or-later", "copyleft", ("gpl2-or-later",), ()),
    ("Apache-2.0", "permissive", ("apache-notice",), ()),
    ("BSD-3-Clause", "permissive", ("bsd3-notice",), ()),
    ("BSD-2-Clause", "permissive", ("bsd2-notice",), ()),
    ("MIT", "permissive", ("mit-grant",), ()),
    ("MIT", "permissive", ("mit-notice",), ()),
    *((n, family, (f"tag-{n}",), ()) for family, names in TAGGED.items() for n in names),
)

#: A sentence ends at a line end, or at a stop, colon or semicolon before white space.
BREAKS = r"[\n\r]+|[.;:!?](?=[ \t\n\r]|\z)"


def pieces(text: Column) -> Column:
    """The normalised pieces of a text, each between line ends, with slots filled."""
    t = F.regexp_replace(F.lower(F.regexp_replace(text, BREAKS, "\n")), "[^a-z0-9\n]+", " ")
    t = F.concat(F.lit("\n"), F.regexp_replace(t, " ?\n[ \n]*|^ | $", "\n"), F.lit("\n"))
    for slot, filled in SLOTS:
        t = F.regexp_replace(t, slot, filled)
    return t


def _ways(known, gap: str) -> str:
    """All known sentences, the longest first; between words a space or a break."""
    return "|".join(s.replace(" ", gap) for s in sorted(known, key=lambda s: (-len(s), s)))


def sentence_ids(text: Column, known=KNOWN) -> Column:
    """Identifiers of the known sentences of a text, in order; a sentence may be cut by breaks between any words."""
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    hits = F.regexp_extract_all(pieces(text), F.lit(f"\n({_ways(known, '[ \n]')})(?=\n)"), F.lit(1))
    return F.transform(hits, lambda s: F.try_element_at(table, F.translate(s, "\n", " ")))


def _pattern(ids) -> str:
    """For a line of identifiers, each with a comma behind it and one before the first."""
    return "(?s)," + "(?:,.*)?,".join(re.escape(i) for i in ids) + ","


def scan(docs: DataFrame, id_col="doc_id", text_col="text", known=KNOWN, rules=RULES) -> DataFrame:
    """One row per row of docs: doc_id, n_found, ids (comma-joined), license, family, licenses (all that match, by rank), null or empty where none."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # a cheap test before splitting: every known sentence holds its own longest word whole
    likely = F.lower(text).rlike("|".join(sorted({max(x.split(), key=len) for x in known})))
    ids = F.when(likely, sentence_ids(text, known)).otherwise(F.array().cast("array<string>"))
    d = docs.select(F.col(id_col).alias("doc_id"), ids.alias("_ids"))
    d = d.select("doc_id", F.size("_ids").cast("long").alias("n_found"), F.array_join("_ids", ",").alias("ids"))
    line = F.concat(F.lit(","), F.col("ids"), F.lit(","))
    there = lambda want, but: [line.rlike(_pattern(want)), *[~F.contains(line, F.lit(f",{i},")) for i in but]]
    hits = F.when(F.col("n_found") == 0, F.array().cast("array<struct<license:string,family:string>>")).otherwise(
        F.array_compact(F.array(*[F.when(reduce(and_, there(want, but)), F.struct(F.lit(name).alias("license"), F.lit(family).alias("family"))) for name, family, want, but in rules]))
    )
    d = d.withColumn("_hits", hits)
    return d.select("doc_id", "n_found", "ids", F.get("_hits", F.lit(0))["license"].alias("license"), F.get("_hits", F.lit(0))["family"].alias("family"), F.array_join(F.array_distinct(F.transform("_hits", lambda h: h["license"])), ",").alias("licenses"))


def oracle(known=KNOWN, rules=RULES) -> str:
    """The same over table documents in DuckDB's SQL: breaks are doubled, so that what ends one sentence can begin the next."""
    pairs = ", ".join(f"('{s}', '{i}')" for s, i in known.items())
    want = ", ".join(f"({k}, '{n}', '{f}', '{_pattern(w)}', {[f',{i},' for i in but]}::VARCHAR[])" for k, (n, f, w, but) in enumerate(rules))
    text = r"regexp_replace(lower(regexp_replace(coalesce(text, ''), '[.;:!?]([ \t\n\r]|$)', chr(10) || '\1', 'g')), '[^a-z0-9\n\r]+', ' ', 'g')"
    text = rf"chr(10) || regexp_replace({text}, ' ?[\n\r][ \n\r]*|^ | $', chr(10), 'g') || chr(10)"
    for slot, filled in SLOTS:
        text = f"regexp_replace({text}, '{slot}', '{filled}', 'g')"
    return rf"""
    WITH known(s, i) AS (VALUES {pairs}), rules(k, license, family, p, but) AS (VALUES {want}),
    t AS (SELECT row_number() OVER () AS r, doc_id, replace({text}, chr(10), chr(10) || chr(10)) AS t FROM documents),
    x AS (SELECT r, regexp_extract_all(t, '\n({_ways(known, "[ \\n]+")})\n', 1) AS m FROM t),
    e AS (SELECT r, unnest(m) AS m, unnest(range(len(m))) AS pos FROM x),
    hits AS (SELECT r, string_agg(i, ',' ORDER BY pos) AS ids, count(*) AS n FROM e JOIN known ON regexp_replace(m, '\n+', ' ', 'g') = s GROUP BY r),
    found AS (SELECT r, k, license, family FROM hits JOIN rules ON regexp_matches(',' || ids || ',', p) AND NOT list_bool_or(list_transform(but, lambda b: contains(',' || ids || ',', b)) || [false])),
    firsts AS (SELECT r, license, min(k) AS k FROM found GROUP BY r, license),
    listed AS (SELECT r, string_agg(license, ',' ORDER BY k) AS licenses, min(k) AS k FROM firsts GROUP BY r)
    SELECT doc_id, coalesce(h.n, 0) AS n_found, coalesce(h.ids, '') AS ids, license, family, coalesce(l.licenses, '') AS licenses
    FROM t LEFT JOIN hits h USING (r) LEFT JOIN listed l USING (r) LEFT JOIN rules USING (k)
    """
