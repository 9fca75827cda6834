"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import licenses, ranked_search

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

MIXING = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, 2 * source_size AS most FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS place FROM w),
r AS (SELECT *, (SELECT sum(source_size) * 1.5::DOUBLE FROM s) AS total,
             coalesce(sum(most) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
             sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_after FROM o),
l AS (SELECT *, (total - full_before) / weight_after AS level FROM r),
f AS (SELECT min(place) AS place FROM l WHERE level * weight <= most),
t AS (SELECT l.source, l.source_size, CASE WHEN l.place >= f.place THEN least((SELECT level FROM l x WHERE x.place = f.place) * weight, most) ELSE most END::DOUBLE AS target FROM l, f),
j AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
             ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * (floor(rate)::BIGINT + (draw < rate - floor(rate))::BIGINT))::BIGINT AS taken FROM j
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM m
"""

_SPACE = r"[\x20\x09-\x0D]"


def quality() -> str:
    """Words, three-word windows and lines as rows of a number; thresholds from the rules' table, ratios multiplied out."""
    from .quality_rules import MIN_WORDS, MOST_REPEATED_PERCENT, RULES, STOP_WORDS, SYMBOLS

    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    bounds = []
    for r in RULES:
        bottom = f"{r.denominator}::DOUBLE" if r.denominator else "1::DOUBLE"
        bounds += [f"{r.numerator}::DOUBLE {sign} {limit}::DOUBLE * {bottom}" for sign, limit in ((">=", r.least), ("<=", r.most)) if limit is not None]
    return rf"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT n, list_filter(string_split_regex(text, '{_SPACE}+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines FROM d),
g AS (SELECT n, i, w[i:i + 2] AS s FROM (SELECT n, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
r AS (SELECT n, i FROM g QUALIFY count(*) OVER (PARTITION BY n, s) > 1),
c AS (SELECT n, count(DISTINCT p) AS k FROM (SELECT n, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY n),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(text, '[^{SYMBOLS}]', '', 'g'))::BIGINT AS n_symbols, (length(text) - length(replace(text, '!', '')))::BIGINT AS n_shouts,
             len(list_filter(w, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words, len(lines)::BIGINT AS n_lines,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(k, 0)::BIGINT AS n_repeat_words
      FROM d JOIN w USING (n) LEFT JOIN c USING (n)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(bounds)} AS kept FROM f
"""


def secrets() -> str:
    """Matches and the pieces between them, numbered; a match starts after all that comes before it."""
    from .secrets import KINDS, MAX_OWNERS, MAX_REPOSITORIES, OPAQUE

    kinds = [*KINDS, OPAQUE]
    plain = lambda p: p.replace("}+", "}").replace("'", "''")  # noqa: E731  no possessive repeats in this dialect, and none needed
    one = "\nUNION ALL ".join(
        f"SELECT n, {k} AS rank, '{kind}' AS kind, {least} AS least, regexp_extract_all(text, '{plain(p)}') AS hits, {f"regexp_extract_all(text, '{plain(p)}', 2)" if kind == 'assign' else f"regexp_extract_all(text, '{plain(p)}')"} AS vals, string_split_regex(text, '{plain(p)}') AS pieces FROM d"
        for k, (kind, p, least) in enumerate(kinds)
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text, coalesce(source, chr(0)) AS owner, coalesce(source, chr(0)) || '/' || coalesce(lang, chr(0)) AS repository FROM documents),
k AS ({one}),
e AS (SELECT n, rank, kind, least, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS hit, unnest(vals) AS val, unnest(pieces[1:len(hits)]) AS piece FROM k WHERE len(hits) > 0),
p AS (SELECT *, sum(length(hit) + length(piece)) OVER (PARTITION BY n, rank ORDER BY i) AS stop FROM e),
m AS (SELECT n, rank, kind, (stop - length(hit))::BIGINT AS start, stop::BIGINT AS stop, val FROM p WHERE length(val) >= least),
base AS (SELECT * FROM m WHERE rank < {len(KINDS)}),
opaque AS (SELECT * FROM m WHERE rank = {len(KINDS)} AND regexp_matches(val, '[a-z]') AND regexp_matches(val, '[A-Z]') AND regexp_matches(val, '[0-9]')
           AND NOT EXISTS (SELECT 1 FROM base b WHERE b.n = m.n AND b.start < m.stop AND m.start < b.stop)),
c AS (SELECT * FROM base UNION ALL SELECT * FROM opaque),
o AS (SELECT val, count(DISTINCT owner) AS owners, count(DISTINCT repository) AS repositories FROM c JOIN d USING (n) GROUP BY val),
j AS (SELECT c.*, owners, repositories, owners <= {MAX_OWNERS} AND repositories <= {MAX_REPOSITORIES} AS live, kind || ':' || start || ':' || stop AS span FROM c JOIN o USING (val)),
b AS (SELECT n, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex, string_agg(span, ',' ORDER BY start, stop, rank) FILTER (rank < {len(KINDS)}) AS base,
             string_agg(span, ',' ORDER BY start, stop, rank) FILTER (rank < {len(KINDS)} OR live) AS spans, string_agg(owners::VARCHAR, ',' ORDER BY start, stop, rank) FILTER (rank < {len(KINDS)} OR live) AS owners,
             string_agg(repositories::VARCHAR, ',' ORDER BY start, stop, rank) FILTER (rank < {len(KINDS)} OR live) AS repositories, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live AND rank < {len(KINDS)}) AS n_example FROM j GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(b.owners, '') AS owners, coalesce(b.repositories, '') AS repositories, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example FROM d LEFT JOIN b USING (n)
"""


#: Each place's 200 bytes as 400 hexadecimal digits, by digest, from pieces that overlap; covered places by gaps and islands.
REPEATS = """
WITH d AS (SELECT row_number() OVER () AS n, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT n, 400 * c AS base, substr(h, 800 * c + 1, 1198) AS h FROM (SELECT n, h, unnest(range(0, length(h) // 800 + 1)) AS c FROM d)),
w AS (SELECT n, base + i AS i, md5_number(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT n, base, h, unnest(range(0, least(400, length(h) // 2 - 199))) AS i FROM p)),
a AS (SELECT n, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
b AS (SELECT n, i, coalesce(i > lag(i) OVER (PARTITION BY n ORDER BY i) + 200, true) AS new FROM a),
c AS (SELECT n, i, sum(new::INT) OVER (PARTITION BY n ORDER BY i) AS run FROM b),
r AS (SELECT n, run, min(i) AS p0, max(i) + 200 AS p1 FROM c GROUP BY n, run),
s AS (SELECT *, coalesce(lag(p1) OVER (PARTITION BY n ORDER BY p0), 0) AS before FROM r),
g AS (SELECT n, sum(p1 - p0) AS removed, count(*) AS spans, max(p1) AS last, string_agg(substr(h, 2 * before + 1, 2 * (p0 - before)), '' ORDER BY p0) AS kept FROM s JOIN d USING (n) GROUP BY n)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN g.n IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN g USING (n)
"""

ORACLES = {"op2_secret_scans": secrets(), "op3_repeats": REPEATS, "op4_license_scans": licenses.oracle(), "op5_quality_rules": quality(), "op8_mixing": MIXING, "op9_warc": WARC, "op12_ranked_search": ranked_search.ORACLE}
