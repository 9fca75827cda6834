"""DuckDB SQL for the queries, written from the rules and not from the plans."""

from __future__ import annotations

import uuid

from .functions.text import TERMS, WS
from .operators.extract import CONCEPT_ROLES, VERBS
from .operators.graph import NAMESPACE as NODES
from .operators.links import NAMESPACE
from .queries import EPS, FOREST_EPS, LEMMAS, MOST_CHARS, ROLES

WORDS_BREAK = f"{WS}+"


def strip(x):
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def normal(x):
    return strip(f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))")


def words(x):
    return f"list_filter(string_split_regex({x}, '{WORDS_BREAK}'), lambda w: w <> '')"


def tokens(x):
    return rf"list_filter(string_split(lower(regexp_replace({x}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda w: w <> '')"


def uuid5(ns, name):
    h = f"sha1(unhex('{uuid.UUID(str(ns)).hex}') || encode({name}))"
    return f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr({h}, 17, 1)), 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"


def planner_ns(graph):
    return uuid.uuid5(uuid.NAMESPACE_URL, f"research-planner/{graph}")


ACCEPT = f"""
t AS (SELECT doc_id, {normal("coalesce(text, '')")} AS text, {strip("coalesce(source, '')")} AS source, {uuid5(NAMESPACE, "source || ':' || doc_id")} AS request_id FROM documents),
a AS (SELECT *, CASE WHEN source = '' THEN 'MissingSource' WHEN text = '' THEN 'Empty' WHEN length(text) > 10000 THEN 'MaxLength' END AS error_code FROM t)
"""


def scored(source, error="error_code IS NULL"):
    """CTEs from source (request_id, text) to v with the five scores."""
    return f"""
r AS (SELECT *, len({words("text")}) AS n_words, CASE WHEN length(text) = 0 THEN 0.2 WHEN length(text) <= 5 THEN 0.5 WHEN length(text) <= 20 THEN 0.65 WHEN length(text) <= 100 THEN 0.8 ELSE 0.9 END::DOUBLE AS confidence FROM {source} WHERE {error}),
k AS (SELECT *, ['Step 1: Received input with request ID ' || request_id, 'Step 2: Input contains ' || length(text) || ' characters and ' || n_words || ' words', 'Step 3: Input timestamp is 2024-01-01T00:00:00+00:00',
  CASE WHEN text = '' THEN 'Step 4: Input is empty, minimal processing required' WHEN n_words = 1 THEN 'Step 4: Single-word input detected, likely a simple command or query' WHEN n_words <= 5 THEN 'Step 5: Short input detected, processing as concise request' ELSE 'Step 5: Multi-word input detected, processing as detailed request' END] AS steps FROM r),
w AS (SELECT *, {tokens("text")} AS tw, {tokens("array_to_string(steps, chr(10))")} AS tk FROM k),
c AS (SELECT *, 1.0::DOUBLE AS step_count_score, 1.0::DOUBLE AS coherence_score, greatest(0, least(1, 1 - abs(confidence - least(1.0, length(text) / 120.0::DOUBLE))))::DOUBLE AS confidence_alignment_score,
  CASE WHEN len(tw) = 0 THEN 1.0 ELSE len(list_filter(tw, lambda x: list_contains(tk, x))) / len(tw)::DOUBLE END::DOUBLE AS input_coverage_score FROM w),
v AS (SELECT *, (step_count_score + coherence_score + confidence_alignment_score + input_coverage_score) / 4 AS overall_score FROM c)
"""


LICENSED = "l AS (SELECT doc_id, text, source, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents WHERE contains(lower(text), 'license'))"
SEQUENTIAL = "l AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents), s AS (SELECT a.doc_id AS a, b.doc_id AS b, a.pos FROM l a JOIN l b ON a.pos + 1 = b.pos)"

E = """
o AS (SELECT *, lead(user_id) OVER (ORDER BY ts, event_id) AS next_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events),
e AS (SELECT event_id AS edge_id, pos AS edge_pos, user_id AS source_id, next_id AS target_id, event_type,
  CASE event_type WHEN 'click' THEN 'supports' WHEN 'purchase' THEN 'confirms' WHEN 'error' THEN 'contradicts' WHEN 'signup' THEN 'refutes' WHEN 'view' THEN 'references' END AS edge_type,
  repeat(props, 1 + event_id % 6) AS evidence, (event_id % 101) / 100.0::DOUBLE AS confidence FROM o WHERE next_id IS NOT NULL),
n AS (SELECT DISTINCT user_id AS id FROM events)
"""
#: Breadth-first trees from every node, level by level; the data's trees end before the last level, which is empty.
LEVELS = 9
_STEP = """y{k} AS (SELECT start, target_id AS x, r, edge_pos, path || ',' || target_id AS path, es || CASE WHEN es = '' THEN '' ELSE ',' END || edge_id AS es, row_number() OVER (PARTITION BY start, target_id ORDER BY r, edge_pos) AS k
  FROM z{p} JOIN e ON source_id = x WHERE {new}),
z{k} AS (SELECT start, x, row_number() OVER (PARTITION BY start ORDER BY r, edge_pos) AS r, path, es FROM y{k} WHERE k = 1)"""
CHAINS = ", ".join(
    ["z0 AS (SELECT id AS start, id AS x, 0 AS r, id::VARCHAR AS path, '' AS es FROM n)"]
    + [_STEP.format(k=k, p=k - 1, new=" AND ".join(f"NOT EXISTS (SELECT 1 FROM z{j} v WHERE v.start = z{k - 1}.start AND v.x = e.target_id)" for j in range(k))) for k in range(1, LEVELS)]
    + ["chain AS (" + " UNION ALL ".join(f"SELECT path AS nodes, es AS edges, {k} AS depth FROM z{k}" for k in range(2, LEVELS)) + ")"]
)
ADJ = "adj AS (SELECT source_id AS u, target_id AS v FROM g WHERE source_id <> target_id UNION SELECT target_id, source_id FROM g WHERE source_id <> target_id)"
PAIRS = "p AS (SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, list_sort(list_distinct(list(lower(edge_type)))) AS types FROM e GROUP BY 1, 2)"
WEAK = f"""
k AS (SELECT *, length({strip("coalesce(evidence, '')")}) AS n FROM e), x AS (SELECT * FROM k WHERE confidence < 0.6 OR n < 40)
SELECT {uuid5(planner_ns("events"), "'weak:' || edge_id || ':' || source_id || ':' || target_id || ':' || edge_type || ':' || n")} AS action_id, 'strengthen_evidence' AS action_type,
  round(greatest(0, least(1, 0.5 * greatest(0, least(1, (0.6 - confidence) / 0.6)) + 0.5 * CASE WHEN n = 0 THEN 1.0 ELSE 40.0::DOUBLE / (n + 40.0) END))::DOUBLE, 9) AS priority,
  'evidence length ' || n || ' of edge ' || edge_id AS evidence FROM x
"""


def joined(x, order):
    return f"string_agg({x}::VARCHAR, ',' ORDER BY {order})"


TERM_LIST = "list_sort(list_distinct(" + " || ".join(rf"regexp_extract_all(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '_', 'g'), '{p}')" for p in TERMS) + "))[1:50]"

TRACES = "t AS (SELECT conv_id, list(text ORDER BY turn) AS steps FROM conversations GROUP BY conv_id)"
REPLAY = f"""
WITH {TRACES},
f AS (SELECT conv_id, 0 AS place, 'input' AS frame_type, NULL AS step FROM t
  UNION ALL SELECT conv_id, k, 'reasoning_step', steps[k] FROM (SELECT conv_id, steps, unnest(range(1, len(steps) + 1)) AS k FROM t)
  UNION ALL SELECT conv_id, 1000000, 'evaluation', NULL FROM t WHERE conv_id % 3 <> 0
  UNION ALL SELECT conv_id, 1000001, 'tool_call', NULL FROM t WHERE conv_id % 2 = 0)
SELECT conv_id::VARCHAR AS request_id, (row_number() OVER (PARTITION BY conv_id ORDER BY place) - 1)::INTEGER AS frame_index, frame_type, step FROM f
"""

VERB_CASE = "CASE " + " ".join(f"WHEN lemma IN ({', '.join(repr(v) for v in vs)}) THEN '{k}'" for k, vs in VERBS.items()) + " ELSE 'RELATED_TO' END"

ORACLES = {
    "packets_accept": f"WITH {ACCEPT} SELECT doc_id, error_code, CASE WHEN error_code = 'MaxLength' THEN length(text) END::INTEGER AS actual_length FROM a",
    "reject_counts": f"WITH {ACCEPT} SELECT error_code, count(*) AS n, max(CASE WHEN error_code = 'MaxLength' THEN length(text) END)::INTEGER AS longest FROM a WHERE error_code IS NOT NULL GROUP BY error_code",
    "score_documents": f"WITH {ACCEPT}, {scored('a')} SELECT doc_id, n_words::INTEGER AS n_words, confidence, step_count_score, coherence_score, confidence_alignment_score, input_coverage_score, overall_score FROM v",
    "run_conclusions": f"WITH {ACCEPT}, {scored('a')} SELECT request_id, steps[4] AS conclusion, 1 AS n_calls, len({words('d.text')})::VARCHAR AS word_count FROM v JOIN (SELECT doc_id, text FROM documents) d USING (doc_id)",
    "compare_configs": f"WITH {ACCEPT}, {scored('a')} SELECT 'plain' AS config, count(*) AS n, 0::BIGINT AS errors, NULL::DOUBLE AS mean_score FROM v UNION ALL SELECT 'scored', count(*), 0, round(avg(overall_score), 9) FROM v UNION ALL SELECT 'broken', count(*), count(*), NULL FROM v",
    "link_keyword": f"WITH {LICENSED} SELECT a.doc_id::VARCHAR AS source_document_id, b.doc_id::VARCHAR AS target_document_id, 'keyword_related' AS link_type, 'shared_keyword:license' AS hint FROM l a JOIN l b ON a.doc_id < b.doc_id",
    "link_metadata": "SELECT a.doc_id::VARCHAR AS source_document_id, b.doc_id::VARCHAR AS target_document_id, 'metadata_related' AS link_type, 'shared_source:src1' AS hint FROM documents a JOIN documents b ON a.doc_id < b.doc_id WHERE a.source = 'src1' AND b.source = 'src1'",
    "link_sequential": f"WITH {SEQUENTIAL} SELECT a::VARCHAR AS source_document_id, b::VARCHAR AS target_document_id, 'sequential' AS link_type, 'sequential_order:' || pos AS hint FROM s",
    "link_outcomes": f"""WITH {SEQUENTIAL}, z AS (SELECT a::VARCHAR AS sa, CASE WHEN a % 7 = 0 THEN 'none' ELSE b::VARCHAR END AS sb, 'sequential_order:' || pos AS hint FROM s),
      y AS (SELECT sa, sb, hint, b.doc_id IS NULL AS missing, {uuid5(NAMESPACE, "'link:' || sa || ':' || sb || ':sequential:' || hint")} AS request_id,
        {normal("'Analyze the relationship between two documents.' || chr(10) || chr(10) || 'Source Document: ' || a.source || chr(10) || 'Source Content: ' || substr(a.text, 1, 500) || '...' || chr(10) || chr(10) || 'Target Document: ' || b.source || chr(10) || 'Target Content: ' || substr(b.text, 1, 500) || '...' || chr(10) || chr(10) || 'Proposed Link Type: sequential' || chr(10) || 'Hint: ' || hint || chr(10) || chr(10) || 'Justify whether this link is valid and provide evidence.'")} AS text
        FROM z JOIN documents a ON a.doc_id::VARCHAR = sa LEFT JOIN documents b ON b.doc_id::VARCHAR = sb), {scored("y", "NOT missing")}
      SELECT sa AS source_document_id, sb AS target_document_id, CASE WHEN overall_score >= 0.75 THEN 'edge' ELSE 'rejection' END AS outcome, round(overall_score, 9) AS overall_score FROM v
      UNION ALL SELECT sa, sb, 'failure', NULL FROM y WHERE missing""",
    "plan_gap": f"""WITH d AS (SELECT id, count(*) AS n FROM (SELECT source_document_id::BIGINT AS id FROM edges UNION ALL SELECT target_document_id::BIGINT FROM edges) GROUP BY id), k AS (SELECT doc_id, source, coalesce(n, 0) AS n FROM documents LEFT JOIN d ON doc_id = id)
      SELECT {uuid5(planner_ns("documents"), "'gap:' || doc_id || ':' || doc_id || ':' || n")} AS action_id, 'investigate_gap' AS action_type, CASE WHEN n = 0 THEN 1.0 ELSE 0.8 END::DOUBLE AS priority, 'degree ' || n || ' of ''' || source || ':' || doc_id || '''' AS evidence FROM k WHERE n <= 1""",
    "plan_contradiction": f"""WITH {E}, {PAIRS} SELECT {uuid5(planner_ns("events"), "'contradiction:' || a || ':' || b || ':' || array_to_string(types, ',')")} AS action_id, 'resolve_contradiction' AS action_type,
      round(0.8 + 0.2 * least(1.0, len(types) / 4.0::DOUBLE), 9)::DOUBLE AS priority, 'Between ' || a || ' and ' || b || ': ' || array_to_string(types, ', ') AS evidence FROM p
      WHERE list_has_any(types, ['supports', 'agrees', 'confirms']) AND list_has_any(types, ['contradicts', 'refutes', 'disagrees'])""",
    "plan_weak": f"WITH {E}, {WEAK}",
    "node_degrees": f"WITH {E} SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM e UNION ALL SELECT target_id FROM e) GROUP BY id",
    "pair_types": f"WITH {E}, {PAIRS} SELECT a, b, array_to_string(types, ',') AS types FROM p",
    "dangling_edges": f"WITH {E} SELECT edge_id FROM e WHERE source_id % 10 = 0 OR target_id % 10 = 0",
    "graph_identifiers": "SELECT DISTINCT doc_id::VARCHAR AS id FROM documents",
    "motif_gap": f"""WITH {E}, g AS (SELECT * FROM e), {ADJ}, w AS (SELECT a.v AS x, b.v AS y, a.u AS s FROM adj a JOIN adj b ON a.u = b.u AND a.v < b.v),
      c AS (SELECT x, y, count(*) AS n, {joined("s", "s")} AS shared FROM w GROUP BY x, y HAVING count(*) >= 2)
      SELECT x || ',' || y || ',' || shared AS nodes, '' AS edges, round(least(1.0, n / 5.0::DOUBLE), 9)::DOUBLE AS confidence FROM c WHERE NOT EXISTS (SELECT 1 FROM adj WHERE u = x AND v = y)""",
    "motif_cluster": f"""WITH {E}, g AS (SELECT * FROM e), {ADJ},
      t AS (SELECT a.u AS p, a.v AS q, b.v AS r FROM adj a JOIN adj b ON a.v = b.u JOIN adj c ON c.u = a.u AND c.v = b.v WHERE a.u < a.v AND b.u < b.v)
      SELECT p || ',' || q || ',' || r AS nodes, {joined("edge_id", "edge_pos")} AS edges, 1.0::DOUBLE AS confidence FROM t JOIN g ON source_id IN (p, q, r) AND target_id IN (p, q, r) GROUP BY p, q, r""",
    "motif_hub": f"""WITH {E}, g AS (SELECT * FROM e), i AS (SELECT source_id AS id, edge_pos, edge_id FROM g UNION ALL SELECT target_id, edge_pos, edge_id FROM g), m AS (SELECT count(*) AS n FROM n)
      SELECT id::VARCHAR AS nodes, {joined("edge_id", "edge_pos")} AS edges, round(least(1.0, count(*) / any_value(m.n)::DOUBLE), 9)::DOUBLE AS confidence, '''user_' || id || ''' is a hub of ' || count(*) || ' links' AS description FROM i, m GROUP BY id HAVING count(*) >= greatest(3, any_value(m.n) // 2)""",
    "motif_contradiction": f"""WITH {E} SELECT least(source_id, target_id) || ',' || greatest(source_id, target_id) AS nodes, {joined("edge_id", "edge_pos")} AS edges, 1.0::DOUBLE AS confidence FROM e
      GROUP BY least(source_id, target_id), greatest(source_id, target_id) HAVING count(*) >= 2 AND bool_or(edge_type = 'supports') AND bool_or(edge_type = 'contradicts')""",
    "motif_chain": f"WITH {E}, {CHAINS} SELECT nodes, edges, round(least(1.0, 0.5 + 0.1 * (depth + 1)), 9)::DOUBLE AS confidence FROM chain",
    "motif_counts": f"""WITH {E}, {CHAINS}, g AS (SELECT * FROM e), {ADJ}, m AS (SELECT count(*) AS n FROM n),
      gap AS (SELECT x, y, count(*) AS n FROM (SELECT a.v AS x, b.v AS y FROM adj a JOIN adj b ON a.u = b.u AND a.v < b.v) GROUP BY x, y HAVING count(*) >= 3),
      hub AS (SELECT id, count(*) AS d FROM (SELECT source_id AS id FROM e UNION ALL SELECT target_id FROM e) GROUP BY id),
      con AS (SELECT least(source_id, target_id) AS a FROM e GROUP BY least(source_id, target_id), greatest(source_id, target_id) HAVING count(*) >= 2 AND bool_or(edge_type = 'supports') AND bool_or(edge_type = 'contradicts')),
      c AS (SELECT 'gap' AS hypothesis_type, count(*) AS n FROM gap WHERE NOT EXISTS (SELECT 1 FROM adj WHERE u = x AND v = y)
        UNION ALL SELECT 'cluster', count(*) FROM adj a JOIN adj b ON a.v = b.u JOIN adj c ON c.u = a.u AND c.v = b.v WHERE a.u < a.v AND b.u < b.v
        UNION ALL SELECT 'chain', count(*) FROM chain UNION ALL SELECT 'hub', count(*) FROM hub, m WHERE m.n >= 3 AND d >= greatest(3, m.n // 2) AND d / m.n::DOUBLE >= 0.5 UNION ALL SELECT 'contradiction', count(*) FROM con)
      SELECT * FROM c WHERE n > 0""",
    "trace_replay": REPLAY,
    "trace_round_trip": REPLAY,
    "trace_versions": "SELECT user_id::VARCHAR AS request_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id",
    "page_assembly": f"""SELECT conv_id AS doc, content, page_count, extracted_pages, CASE WHEN content = '' THEN 'EmptyDocument' END AS error_type FROM (SELECT conv_id, {strip("coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (turn % 4 <> 3 AND coalesce(text, '') <> ''), '')")} AS content,
      count(*) AS page_count, count(*) FILTER (turn % 4 <> 3 AND coalesce(text, '') <> '') AS extracted_pages FROM conversations GROUP BY conv_id)""",
    "cluster_summary": f"""WITH d AS (SELECT vec_id, label, embedding, (vec_id % 10) / 10.0::DOUBLE AS p FROM embeddings WHERE vec_id % 11 <> 0), u AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS dim FROM d),
      c AS (SELECT label, dim, avg(x) AS m FROM u GROUP BY label, dim), q AS (SELECT u.vec_id, u.label, sum((x - m) * (x - m)) AS d2 FROM u JOIN c USING (label, dim) GROUP BY 1, 2),
      s AS (SELECT label, {joined("vec_id", "vec_id")} AS members, count(*) AS size, avg(p) AS mp FROM d GROUP BY label), b AS (SELECT label, arg_min(vec_id, d2) AS r, min(d2) AS least_d2 FROM q GROUP BY label)
      SELECT label AS cluster_id, members, r::VARCHAR AS representative_id, 'item ' || r AS representative_text, size, round(mp, 9) AS mean_probability, round(least_d2, 6) AS least_d2, 0.0::DOUBLE AS stability FROM s JOIN b USING (label)""",
    "concept_edges": """WITH m AS (SELECT vec_id // 25 AS cluster_id, vec_id, embedding[1] > -0.2::FLOAT AS known, row_number() OVER (PARTITION BY vec_id // 25 ORDER BY vec_id) - 1 AS k, count(*) OVER (PARTITION BY vec_id // 25) AS n FROM embeddings),
      bad AS (SELECT cluster_id FROM m WHERE k < 4 AND NOT known), p(t, least_n, most_n, a, b, c) AS (VALUES ('related_to', 2, 2, 0, 1, 0.95), ('related_to', 3, 1000000, 0, 1, 0.95), ('related_to', 3, 1000000, 1, 2, 0.95), ('related_to', 3, 1000000, 0, 2, 0.95), ('sequential', 4, 1000000, 0, 1, 1.0), ('sequential', 4, 1000000, 1, 2, 1.0), ('sequential', 4, 1000000, 2, 3, 1.0))
      SELECT x.cluster_id, x.vec_id::VARCHAR AS source, y.vec_id::VARCHAR AS target, t AS edge_type, c::DOUBLE AS confidence FROM m x JOIN m y USING (cluster_id) JOIN p ON x.k = a AND y.k = b AND x.n BETWEEN least_n AND most_n WHERE x.cluster_id NOT IN (SELECT cluster_id FROM bad)""",
    "token_pool": "SELECT label AS id, dim::INTEGER AS dim, round(sum(CASE WHEN vec_id % 4 <> 0 THEN x ELSE 0 END) / greatest(1, count(*) FILTER (vec_id % 4 <> 0)), 9) AS x FROM (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS dim FROM embeddings) GROUP BY label, dim",
    "role_softmax": f"""WITH x AS (SELECT vec_id, list_transform(embedding[1:{len(ROLES)}], lambda v: v::DOUBLE) AS l FROM embeddings), y AS (SELECT vec_id, list_position(l, list_max(l)) AS k, 1 / list_sum(list_transform(l, lambda v: exp(v - list_max(l)))) AS c FROM x)
      SELECT vec_id, {ROLES}[k] AS role, round(c, 9) AS confidence, {ROLES}[k] IN {CONCEPT_ROLES} AND c > 0.3 AS is_concept FROM y""",
    "eps_components": f"""WITH RECURSIVE x AS (SELECT vec_id AS id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings), l AS (SELECT a.id AS u, b.id AS v FROM x a JOIN x b ON a.id <> b.id AND list_distance(a.e, b.e) <= {EPS}),
      r(id, to_id) AS (SELECT id, id FROM x UNION SELECT r.id, l.v FROM r JOIN l ON r.to_id = l.u), c AS (SELECT id, min(to_id) AS label FROM r GROUP BY id), s AS (SELECT label, count(*) AS n FROM c GROUP BY label)
      SELECT id, CASE WHEN n >= 2 THEN label ELSE -1 END AS label FROM c JOIN s USING (label)""",
    "document_terms": f"SELECT doc_id, array_to_string({TERM_LIST}, '|') AS terms FROM documents",
    "distinct_terms": f"WITH t AS (SELECT DISTINCT unnest({TERM_LIST}) AS term FROM documents), k AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS k FROM t) SELECT 'term_' || k AS id, term FROM k",
    "sentence_spans": rf"""WITH a AS (SELECT doc_id, length(text) - length(regexp_replace(text, '^{WS}+', '')) AS lead, {strip("text")} AS t FROM documents),
      b AS (SELECT doc_id, lead, string_split(regexp_replace(t, '([.!?]){WS}+', '\1' || chr(1), 'g'), chr(1)) AS s, list_transform(regexp_extract_all(t, '[.!?]{WS}+'), lambda g: length(g) - 1) AS g FROM a WHERE t <> ''),
      c AS (SELECT doc_id, lead, unnest(s) AS x, unnest(g || [0]) AS gap, unnest(range(len(s))) AS k FROM b),
      d AS (SELECT *, lead + coalesce(sum(length(x) + gap) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM c)
      SELECT doc_id, k::INTEGER AS k, length(x)::INTEGER AS n, md5(x) AS digest, start::INTEGER AS start, (start + length(x))::INTEGER AS "end" FROM d""",
    "svo_relations": f"""WITH w AS (SELECT conv_id || ':' || turn AS doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '') AS ws FROM conversations),
      t AS (SELECT doc_id, unnest(ws) AS text, unnest(range(len(ws))) AS i FROM w), p AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS idx FROM t),
      v AS (SELECT doc_id, i, CASE WHEN i % 10 = 2 THEN {LEMMAS}[1 + (i // 10) % {len(LEMMAS)}] ELSE lower(text) END AS lemma FROM p WHERE i % 5 = 2)
      SELECT v.doc_id, v.i::INTEGER AS verb_i, {VERB_CASE} AS relation_type, s.text AS subject, s.idx::INTEGER AS subject_start, (s.idx + length(s.text))::INTEGER AS subject_end, o.text AS object, o.idx::INTEGER AS object_start, (o.idx + length(o.text))::INTEGER AS object_end, lemma AS predicate, 0.7::DOUBLE AS confidence, 'nsubj-ROOT-dobj' AS pattern
      FROM v JOIN p s ON s.doc_id = v.doc_id AND s.i = v.i - 1 JOIN p o ON o.doc_id = v.doc_id AND o.i = v.i + 1""",
}
ORACLES["plan_top"] = f"WITH x0 AS ({ORACLES['plan_weak']}) SELECT action_id, action_type, priority, evidence FROM x0 JOIN events ON regexp_extract(evidence, 'edge ([0-9]+)', 1)::BIGINT = event_id ORDER BY priority DESC, action_type, CASE event_type WHEN 'click' THEN 'supports' WHEN 'purchase' THEN 'confirms' WHEN 'error' THEN 'contradicts' WHEN 'signup' THEN 'refutes' ELSE 'references' END, action_id LIMIT 10"
ORACLES["plan_gap"] = f"WITH edges AS (SELECT * FROM ({ORACLES['link_outcomes']}) WHERE outcome = 'edge'), {ORACLES['plan_gap'].removeprefix('WITH ')}"
TRACE = "conv_id, count(*) AS n_steps, arg_min(text, turn) AS text FROM conversations GROUP BY conv_id"
ORACLES |= {
    "link_keyword_groups": """WITH k AS (SELECT doc_id, unnest(list_filter(['license', 'copyright'], lambda w: contains(lower(text), w))) AS k FROM documents)
      SELECT doc_id::VARCHAR AS document_id, 'shared_keyword:' || k AS hint, (min(doc_id) OVER w)::VARCHAR AS group_id, count(*) OVER w - 1 AS n_links FROM k WINDOW w AS (PARTITION BY k)""",
    "link_metadata_groups": "SELECT doc_id::VARCHAR AS document_id, 'shared_source:' || source AS hint, (min(doc_id) OVER w)::VARCHAR AS group_id, count(*) OVER w - 1 AS n_links FROM documents WHERE source <> '' WINDOW w AS (PARTITION BY source)",
    "packets_all": f"SELECT doc_id, length(t)::INTEGER AS n, md5(t) AS digest FROM (SELECT doc_id, {normal('text')} AS t FROM documents)",
    "score_violations": f"WITH {ACCEPT}, {scored('a')} SELECT doc_id FROM v WHERE NOT confidence BETWEEN 0.85 AND 1.0 OR NOT input_coverage_score BETWEEN 0.005 AND 0.2",
    "tool_outputs": f"""WITH {ACCEPT}, {scored('a')} SELECT request_id, 'none' AS config, 4 AS n_steps, NULL::DOUBLE AS overall_score, NULL::VARCHAR AS outputs, NULL::VARCHAR AS error_type, NULL::VARCHAR AS message FROM v
      UNION ALL SELECT request_id, 'calls', 4, round(overall_score, 9), 'letters=3,word_count=2', NULL, NULL FROM v UNION ALL SELECT request_id, 'fails', NULL, NULL, NULL, 'RuntimeError', 'no reasoner' FROM v""",
    "edges_added": f"WITH {E} SELECT edge_id, edge_pos, source_id, target_id FROM e UNION ALL SELECT edge_id, edge_pos + (SELECT max(edge_pos) + 1 FROM e), target_id, source_id FROM e",
    "document_nodes": f"SELECT {uuid5(NODES, "'corpus:node:' || doc_id")} AS node_id, doc_id AS node_pos, doc_id::VARCHAR AS document_id, source AS label FROM documents",
    "endpoints_resolved": f"WITH {SEQUENTIAL} SELECT 'sequential_order:' || pos AS edge_id, {uuid5(NODES, "'corpus:node:' || a")} AS source_id, {uuid5(NODES, "'corpus:node:' || b")} AS target_id FROM s",
    "trace_store": f"""WITH t AS (SELECT {TRACE}) SELECT conv_id::VARCHAR AS request_id, CASE WHEN conv_id % 3 = 0 THEN 'again' ELSE 'conversation' END AS source, n_steps::INTEGER AS n_steps,
      row_number() OVER (ORDER BY conv_id % 3 = 0, conv_id::VARCHAR) - 1 AS place FROM t""",
    "trace_lookup": f"SELECT conv_id::VARCHAR AS request_id, text FROM (SELECT {TRACE}) ORDER BY conv_id LIMIT 1",
    "ingested_files": f"""WITH c AS (SELECT conv_id, {normal("string_agg(text, chr(10) || chr(10) ORDER BY turn) || chr(10)")} AS content FROM conversations GROUP BY conv_id),
      k AS (SELECT *, row_number() OVER (ORDER BY conv_id::VARCHAR || '/') - 1 AS pos FROM c), e AS (SELECT *, CASE pos % 50 WHEN 49 THEN 'UnsupportedFormat' WHEN 48 THEN 'NoPages' WHEN 47 THEN 'FileNotFound' END AS error_type FROM k)
      SELECT conv_id, pos, CASE WHEN error_type IS NULL THEN 'corpus' END AS corpus_id, CASE WHEN error_type IS NULL THEN length(content) END::INTEGER AS n, CASE WHEN error_type IS NULL THEN md5(content) END AS digest, error_type FROM e""",
    "parsed_items": f"""WITH c AS (SELECT DISTINCT conv_id FROM conversations), k AS (SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN 'InputNotAList' WHEN conv_id % 7 = 0 THEN 'InvalidJson' END AS e FROM c)
      SELECT turn::VARCHAR AS id, md5({strip("text")}) AS digest, NULL AS error_type, NULL AS module FROM conversations JOIN k USING (conv_id) WHERE e IS NULL AND {strip("coalesce(text, '')")} <> ''
      UNION ALL SELECT NULL, NULL, e, 'items' FROM k WHERE e IS NOT NULL""",
    "parsed_relations": """SELECT [NULL, 'EntitiesNotAList', 'InputNotAnObject', 'MissingText'][1 + doc_id % 4] AS error_type, count(*) AS n, CASE WHEN doc_id % 4 = 0 THEN count(*) END AS entities, CASE WHEN doc_id % 4 < 2 THEN sum(length(text)) END::BIGINT AS chars FROM documents GROUP BY doc_id % 4""",
    "exported_scores": "SELECT vec_id, greatest(0.0, least(1.0, round(embedding[1]::DOUBLE * 4, 6)))::DOUBLE AS score, '{\"score\":0,\"vec_id\":0}' AS form FROM embeddings",
}

#: Sentences, their digits and what a softmax makes of them.
SPANS = f"""{ORACLES["sentence_spans"].partition("SELECT doc_id, k::INTEGER")[0].replace("WITH a AS", "a AS")},
  m AS (SELECT *, length(x) > {MOST_CHARS} AS failed, list_transform(range(1, {len(ROLES) + 1}), lambda j: (instr('0123456789abcdef', substr(md5(x), j, 1)) - 1) / 2.0::DOUBLE) AS l FROM d),
  s AS (SELECT *, CASE WHEN NOT failed THEN {ROLES}[list_position(l, list_max(l))] END AS role, CASE WHEN NOT failed THEN 1 / list_sum(list_transform(l, lambda v: exp(v - list_max(l)))) END AS confidence FROM m)"""
CONCEPTS = ", ".join(f"'{r}'" for r in CONCEPT_ROLES)
INDEXED = ORACLES["eps_components"]
TURNS = f"""t AS (SELECT source, {uuid5(NAMESPACE, "source")} AS request_id, text, CASE WHEN text = '' THEN 'Empty' WHEN length(text) > 10000 THEN 'MaxLength' END AS error_code
  FROM (SELECT conv_id || ':' || turn AS source, {normal("coalesce(text, '')")} AS text FROM conversations))"""
ORACLES |= {
    "cluster_members": """WITH u AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS dim FROM embeddings WHERE label >= 0), c AS (SELECT label, dim, avg(x) AS m FROM u GROUP BY label, dim)
      SELECT u.label AS cluster_id, vec_id, round(sum((x - m) * (x - m)), 6) AS d2 FROM u JOIN c USING (label, dim) GROUP BY u.label, vec_id""",
    "scored_spans": f"""WITH {SPANS} SELECT doc_id, k::INTEGER AS k, start::INTEGER AS start, (start + length(x))::INTEGER AS "end", role, round(confidence, 9) AS confidence, 'digits:softmax' AS provenance, CASE WHEN failed THEN 'roles:ValueError:span too long' ELSE '' END AS error FROM s""",
    "role_term_motifs": f"""WITH {SPANS}, w AS (SELECT x AS text FROM s WHERE role IN ({CONCEPTS}) AND confidence > 0.3), t AS (SELECT DISTINCT unnest({TERM_LIST}) AS term FROM w),
      g AS (SELECT count(*) AS n FROM t GROUP BY length(term), ascii(term), ascii(right(term, 1))), z AS (SELECT 'cluster' AS hypothesis_type, count(*) AS n FROM g WHERE n >= 3 UNION ALL SELECT 'chain', 2 * count(*) FROM g WHERE n >= 4) SELECT * FROM z WHERE n > 0""",
    "link_strategies": f"{ORACLES['link_keyword']} UNION ALL SELECT * FROM ({ORACLES['link_sequential']})",
    "rescored_links": f"""WITH {SEQUENTIAL}, y AS (SELECT s.*, length({normal("'Analyze the relationship between two documents.' || chr(10) || chr(10) || 'Source Document: ' || a.source || chr(10) || 'Source Content: ' || substr(a.text, 1, 500) || '...' || chr(10) || chr(10) || 'Target Document: ' || b.source || chr(10) || 'Target Content: ' || substr(b.text, 1, 500) || '...' || chr(10) || chr(10) || 'Proposed Link Type: sequential' || chr(10) || 'Hint: sequential_order:' || s.pos || chr(10) || chr(10) || 'Justify whether this link is valid and provide evidence.'")}) AS n
        FROM s JOIN documents a ON a.doc_id = s.a JOIN documents b ON b.doc_id = s.b), v AS (SELECT *, CASE WHEN n > 800 THEN 0.65 ELSE 0.9 END::DOUBLE AS score FROM y)
      SELECT a::VARCHAR AS source_document_id, b::VARCHAR AS target_document_id, CASE WHEN score >= 0.9 THEN 'edge' ELSE 'rejection' END AS outcome, score AS overall_score FROM v""",
    "distinct_entities": """WITH w AS (SELECT conv_id || ':' || turn AS doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '') AS ws FROM conversations),
      t AS (SELECT doc_id, unnest(ws) AS text, unnest(range(len(ws))) AS i FROM w), p AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS idx FROM t)
      SELECT doc_id, i::INTEGER AS ord, CASE WHEN i % 3 = 0 THEN 'again ' ELSE '' END || text AS text, idx::INTEGER AS start, (idx + length(text))::INTEGER AS "end" FROM p WHERE i % 5 IN (1, 3)""",
    "compare_faults": f"""WITH {ACCEPT}, g AS (SELECT request_id, confidence, length(text) AS n FROM (SELECT *, CASE WHEN length(text) <= 5 THEN 0.5 WHEN length(text) <= 20 THEN 0.65 WHEN length(text) <= 100 THEN 0.8 ELSE 0.9 END::DOUBLE AS confidence FROM a WHERE error_code IS NULL))
      SELECT request_id, 'plain' AS config, 4 AS n_steps, confidence, false AS failed, NULL::VARCHAR AS message FROM g
      UNION ALL SELECT request_id, 'plugin', CASE WHEN n % 5 <> 0 THEN 2 END, CASE WHEN n % 5 <> 0 THEN 0.5 END, n % 5 = 0, CASE WHEN n % 5 = 0 THEN 'length' END FROM g UNION ALL SELECT request_id, 'stops', NULL, NULL, true, NULL FROM g""",
    # an edge is in the forest if the lesser ones do not join its ends
    "min_spanning_forest": f"""WITH RECURSIVE x AS (SELECT vec_id AS id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings),
      l AS (SELECT a.id AS u, b.id AS v, list_distance(a.e, b.e) AS distance, row_number() OVER (ORDER BY list_distance(a.e, b.e), a.id, b.id) AS k FROM x a JOIN x b ON a.id < b.id AND list_distance(a.e, b.e) <= {FOREST_EPS}),
      s AS (SELECT u AS a, v AS b, k FROM l UNION ALL SELECT v, u, k FROM l), r(k, x) AS (SELECT k, u FROM l UNION SELECT r.k, s.b FROM r JOIN s ON s.a = r.x AND s.k < r.k)
      SELECT u, v, round(distance, 9) AS distance FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.k = l.k AND r.x = l.v)""",
    "eps_components_indexed": INDEXED,
    "stream_ingest": f"""WITH {TURNS}, {scored("t")} SELECT source, 'trace' AS outcome, round(overall_score, 9) AS overall_score FROM v UNION ALL SELECT source, error_code, NULL FROM t WHERE error_code IS NOT NULL""",
    "stream_upsert": "SELECT conv_id::VARCHAR AS request_id, md5(arg_max(text, turn)) AS digest, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id",
}
