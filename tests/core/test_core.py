"""Worked examples, brute force over random graphs, and the queries against their SQL."""

import os
import random
import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone import oracle, queries
from lodestone.functions import scoring, text
from lodestone.operators import clusters, extract, links, motifs, planner
from lodestone.operators.graph import Graph
from lodestone.plans import runs
from lodestone.sources import ingest, traces
from lodestone.streaming import streams

TS = "2024-01-01 00:00:00"


def test_accept(spark):
    raw = [("\r\n  Hello\nWorld  \r", "a"), ("Line 1\r\nLine 2\rLine 3", "a"), ("   \n\t   ", "a"), ("abcdef", "a"), ("abc", "   "), ("  a    b ", "a"), (None, None)]
    got = [(r.text, r.error_code, r.actual_length) for r in scoring.accept(spark.createDataFrame(raw, "text string, source string"), 20).collect()]
    assert got == [("Hello\nWorld", None, None), ("Line 1\nLine 2\nLine 3", "MaxLength", 20) if len("Line 1\nLine 2\nLine 3") > 20 else ("Line 1\nLine 2\nLine 3", None, None), ("", "Empty", None), ("abcdef", None, None), ("abc", "MissingSource", None), ("a    b", None, None), ("", "MissingSource", None)]
    with pytest.raises(ValueError):
        scoring.accept(spark.createDataFrame(raw, "text string, source string"), 0)


def test_scores(spark):
    d = spark.createDataFrame([("alpha beta", ["Step 1 alpha", "Step 2 beta"], 0.6), ("tiny", ["only step"], 1.0), ("short", [f"Step {k}" for k in range(12)], 0.5)], "text string, steps array<string>, confidence double")
    got = {r.text: [round(r[s], 6) for s in scoring.SCORES] for r in scoring.evaluate(d).collect()}
    assert got == {"alpha beta": [0.5, 1.0, 0.483333, 1.0, 0.745833], "tiny": [0.25, 1.0, 0.033333, 0.0, 0.320833], "short": [0.0, 1.0, 0.541667, 0.0, 0.385417]}


def test_text_columns(spark):
    names = ["", "a", "é中", "x" * 100]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(text.uuid5(uuid.NAMESPACE_URL, F.col("n"))).collect()
    assert [r[0] for r in got] == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]
    d = spark.createDataFrame([("  ΣΑΣ Don't. Is it? Yes!  \x1c",)], "t string").select(text.strip(F.col("t")), text.tokens(F.col("t")), text.sentences(F.col("t"))).first()
    assert d[0] == "ΣΑΣ Don't. Is it? Yes!" and d[1] == ["σασ", "don", "t", "is", "it", "yes"] and d[2] == ["ΣΑΣ Don't.", "Is it?", "Yes!"]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [("1", 0, "Document about quantum computing", "a", {"author": "Smith"}), ("2", 1, "Study of quantum mechanics", "b", {"author": "Smith"}), ("3", 2, "Classical computing systems", "c", {"author": ""})]
    return spark.createDataFrame(rows, "document_id string, doc_pos long, content string, source string, metadata map<string,string>")


def test_links(spark, documents):
    pair = lambda d: sorted((r.source_document_id, r.target_document_id) for r in d.collect())
    assert pair(links.candidates(documents, "keyword_overlap", keyword="Quantum")) == [("1", "2")]
    assert pair(links.candidates(documents, "metadata_match", field="author")) == [("1", "2")]
    assert pair(links.candidates(documents, "sequential")) == [("1", "2"), ("2", "3")]
    for bad in (dict(strategy="x"), dict(strategy="keyword_overlap", keyword=" ")):
        with pytest.raises(ValueError):
            links.candidates(documents, **bad)
    c = spark.createDataFrame([("1", "2"), ("1", "999"), ("2", "1")], "source_document_id string, target_document_id string").withColumns({"link_type": F.lit("t"), "hint": F.lit("h")})
    for score, want in ((0.8, [2, 1, 0]), (0.3, [0, 1, 2])):
        j = links.justify(c, documents, TS, scorer=lambda d, s=score: d.withColumn("overall_score", F.lit(s)))
        assert [links.edges_of(j, TS).count(), links.failures_of(j).count(), links.rejections_of(j).count()] == want
    shuffled = documents.drop("doc_pos").repartition(3)
    assert [(r.document_id, r.doc_pos) for r in links.dense_positions(shuffled, "document_id").orderBy("doc_pos").collect()] == [("1", 0), ("2", 1), ("3", 2)]


def graph(spark, n, edges, label=str):
    nodes = spark.createDataFrame([(k, k, k, label(k), "t") for k in range(n)], "node_id long, node_pos long, document_id long, label string, node_type string")
    e = spark.createDataFrame([(k, k, a, b, t, ev, c) for k, (a, b, t, ev, c) in enumerate(edges)], "edge_id long, edge_pos long, source_id long, target_id long, edge_type string, evidence string, confidence double")
    return Graph("g", nodes, e)


def test_planner(spark):
    g = graph(spark, 3, [(0, 1, "supports", "x" * 26, 0.75), (1, 0, "refutes", "y" * 40, 0.9), (0, 0, "mentions", "weak", 0.55)])
    assert [r.priority for r in planner.plan(g, "gap-driven").collect()] == [1.0]
    r = planner.plan(g, " Contradiction-Driven ").collect()
    assert len(r) == 1 and r[0].metadata["types"] == "refutes,supports" and round(r[0].priority, 6) == 0.9
    assert [round(r.priority, 6) for r in planner.plan(g, "weak-evidence").collect()] == [0.496212, 0.30303]
    assert planner.plan(g, "weak-evidence", 0).count() == 0
    with pytest.raises(ValueError):
        planner.plan(g, "other")


def brute(n, edges):
    adj = {k: set() for k in range(n)}
    for a, b, *_ in edges:
        if a != b:
            adj[a].add(b)
            adj[b].add(a)
    gaps = {(a, b): len(adj[a] & adj[b]) for a in range(n) for b in range(a + 1, n) if b not in adj[a] and len(adj[a] & adj[b]) >= 2}
    tri = {(a, b, c): tuple(k for k, e in enumerate(edges) if {e[0], e[1]} <= {a, b, c}) for a in range(n) for b in range(a + 1, n) for c in range(b + 1, n) if b in adj[a] and c in adj[a] and c in adj[b]}
    chains = set()
    for s in range(n):
        queue, seen = [([s], [])], {s}
        while queue:
            path, used = queue.pop(0)
            for k, (a, b, *_) in enumerate(edges):
                if a == path[-1] and b not in seen:
                    seen.add(b)
                    queue.append((path + [b], used + [k]))
                    if len(path) >= 2:
                        chains.add((tuple(path + [b]), tuple(used + [k])))
    return gaps, tri, chains


def test_motifs(spark):
    rng = random.Random(3)
    for n, m in ((6, 11), (9, 20)):
        edges = [(rng.randrange(n), rng.randrange(n), rng.choice(["supports", "contradicts"]), "", 1.0) for _ in range(m)]
        g = graph(spark, n, edges)
        gaps, tri, chains = brute(n, edges)
        assert {tuple(r.supporting_nodes[:2]): len(r.supporting_nodes) - 2 for r in motifs.gaps(g).collect()} == gaps
        assert {tuple(r.supporting_nodes): tuple(r.supporting_edges) for r in motifs.clusters(g).collect()} == tri
        assert {(tuple(r.supporting_nodes), tuple(r.supporting_edges)) for r in motifs.chains(g).collect()} == chains
    star = graph(spark, 4, [(0, k, "supports", "", 1.0) for k in (1, 2, 3)])
    assert [(r.supporting_nodes, r.confidence) for r in motifs.hubs(star).collect()] == [([0], 0.75)]
    two = graph(spark, 2, [(0, 1, "supports", "", 1.0), (1, 0, "contradicts", "", 1.0)])
    assert {r.hypothesis_type: r.n for r in motifs.counts_by_type(motifs.all_motifs(two)).collect()} == {"contradiction": 1}
    with pytest.raises(ValueError):
        motifs.all_motifs(graph(spark, 1, [(0, 5, "supports", "", 1.0)]), strict=True)


def test_clusters(spark):
    d = spark.createDataFrame([("a", 0, "A", [0.0, 0.0], 0, 0.9), ("b", 1, "B", [0.2, 0.0], 0, 0.8), ("c", 2, "C", [5.0, 5.0], 1, 0.85), ("d", 3, "D", [5.0, 5.1], 1, 0.82), ("e", 4, "E", [9.0, 0.0], -1, 0.1)], "id string, pos int, text string, embedding array<double>, label int, probability double")
    p = spark.createDataFrame([(0, 0.77), (1, 1.73)], "label int, value double")
    got = [(r.cluster_id, r.member_ids, round(r.mean_probability, 6), r.stability) for r in clusters.summarise(d, p).orderBy("cluster_id").collect()]
    assert got == [(0, ["a", "b"], 0.85, 0.77), (1, ["c", "d"], 0.835, 1.0)]
    found = {r.id: r.label for r in clusters.threshold_clusters(d.select(F.col("pos").alias("id"), "embedding"), 0.5).collect()}
    assert found == {0: 0, 1: 0, 2: 2, 3: 2, 4: -1}


def test_relations(spark):
    words = [("Temperature", "amod"), ("increase", "nsubj"), ("causes", "ROOT"), ("ice", "compound"), ("melting", "dobj"), (".", "punct")]
    at, tokens = 0, []
    for i, (w, dep) in enumerate(words):
        tokens.append(("d", i, w, "cause" if i == 2 else w, "VERB" if i == 2 else "X", dep, {0: 1, 3: 4}.get(i, 2), at))
        at += len(w) + (i != 4)
    t = spark.createDataFrame(tokens, "doc_id string, i int, text string, lemma string, pos string, dep string, head int, idx int")
    e = spark.createDataFrame([("d", 0, "Temperature increase", 0, 20), ("d", 1, "ice melting", 28, 39), ("d", 2, "bad", 5, 5)], "doc_id string, ord int, text string, start int, `end` int")
    r = extract.relations(t, e).collect()
    assert [(x.relation_type, x.subject, x.object, round(x.confidence, 6)) for x in r] == [("CAUSES", "Temperature increase", "ice melting", 0.8)]


def test_json_inputs(spark):
    d = spark.createDataFrame([('[{"id": "a", "text": " t "}, {"id": "", "text": "x"}]',), ("{}",), ("no json",)], "value string")
    kind = lambda r: r.error.error_type if r.error else ""
    got = extract.parse_items(d.unionByName(spark.createDataFrame([(" ",), (None,)], "value string")), module="m", model="x").collect()
    assert sorted((r.id or "", kind(r)) for r in got) == [("", "InputNotAList"), ("", "InvalidJson"), ("a", "")]
    assert {(r.error.module, r.error.model) for r in got if r.error} == {("m", "x")} and all(r.error.error for r in got if r.error)
    d = spark.createDataFrame([('{"text": "t", "entities": []}',), ("[]",), ('{"text": "t", "entities": 1}',), ('{"entities": []}',), ("",)], "value string")
    assert sorted(kind(r) for r in extract.parse_relation_input(d).collect()) == ["", "EntitiesNotAList", "InputNotAnObject", "MissingText"]


def test_relation_under_a_root_tag(spark):
    t = spark.createDataFrame([("d", 0, "x", "x", "ROOT", "dep", 0, 0), ("d", 1, "a", "a", "N", "nsubj", 2, 2), ("d", 2, "use", "use", "VERB", "xcomp", 0, 4), ("d", 3, "b", "b", "N", "dobj", 2, 8)], "doc_id string, i int, text string, lemma string, pos string, dep string, head int, idx int")
    e = spark.createDataFrame([("d", 0, "a", 2, 3), ("d", 1, "b", 8, 9)], "doc_id string, ord int, text string, start int, `end` int")
    r = extract.relations(t, e).collect()
    assert [(x.relation_type, x.pattern, round(x.confidence, 6)) for x in r] == [("USES", "nsubj-xcomp-dobj", 0.85)]


def test_sentences_of_repeated_ids(spark):
    d = spark.createDataFrame([(1, " One. Two!"), (1, "Three? Four."), (None, None), (2, "")], "doc_id long, text string")
    got = sorted((r.span_text, r.k, r.start, r.end) for r in extract.sentence_spans(d, "doc_id", "text").collect())
    assert got == [("Four.", 1, 7, 12), ("One.", 0, 1, 5), ("Three?", 0, 0, 6), ("Two!", 1, 6, 10)]


def test_edges_keep_metadata_and_places(spark, documents):
    c = spark.createDataFrame([("1", "2", 4, {"w": "x"}), ("2", "1", 9, None)], "source_document_id string, target_document_id string, pos int, metadata map<string,string>").withColumns({"link_type": F.lit("t"), "hint": F.lit("h")})
    j = links.justify(c, documents, TS, scorer=lambda d: d.withColumn("overall_score", F.lit(0.8)))
    assert sorted((r.source_id, r.edge_pos, r.metadata) for r in links.edges_of(j, TS).collect()) == [("1", 4, {"w": "x"}), ("2", 9, None)]


def test_link_groups_say_what_pairs_say(spark, documents):
    for keyed, pairs in ((links.by_metadata(documents, "author"), links.metadata_links(documents, "author")), (links.by_keyword(documents, "computing"), links.keyword_links(documents, "computing"))):
        n = {}
        for r in pairs.collect():
            for k in (r.source_document_id, r.target_document_id):
                n[k] = n.get(k, 0) + 1
        got = links.link_groups(keyed).collect()
        assert {r.document_id: r.n_links for r in got if r.n_links} == n and {r.group_id for r in got if r.n_links} == {min(n)}


def test_comparison_isolates_failures_and_calls_tools(spark):
    p = spark.createDataFrame([("r", "one two", TS)], "request_id string, text string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = [(0, "a", "default", True, [("echo", "x"), ("none", "y")]), (1, "b", "bad", True, [("echo", "x")]), (2, "c", "gone", False, None), (3, "a", "default", False, [("none", "y")])]

    def bad(packets):
        raise RuntimeError("broken")

    got = {r.config: r for r in runs.compare(p, spark.createDataFrame(rows, "pos int, name string, reasoner string, evaluate boolean, calls array<struct<name:string,input:string>>"), {"default": scoring.reason, "bad": bad}).collect()}
    assert got["a"].tool_calls == [] and got["a"].overall_score is None and len(got["a"].steps) == 4 and got["a"].error is None
    assert (got["b"].error.error_type, got["b"].error.message, got["b"].steps, got["b"].tool_calls) == ("RuntimeError", "broken", None, None)
    assert got["c"].error.error_type == "LookupError"


def test_ingest_traces_and_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("Hello\r\nWorld ")
    (src / "b.txt").write_text("  \n")
    (src / "c.txt").write_bytes(b"\xff\xfe\xfa")
    m = spark.createDataFrame([(0, str(src / "a.txt"), "text"), (1, str(src / "b.txt"), "text"), (2, str(src / "c.txt"), "text"), (3, str(src / "gone.txt"), "text"), (4, "x", "docx"), (5, "y", "pdf"), (6, None, "text"), (7, "z", None)], "pos int, path string, format string")
    good, bad = ingest.ingest(spark, m, "corpus")
    assert [(r.content, r.metadata["file_size"]) for r in good.collect()] == [("Hello\nWorld", "13")]
    assert {r.pos: r.error_type for r in bad.collect()} == {1: "EmptyDocument", 2: "UnicodeDecodeError", 3: "FileNotFound", 4: "UnsupportedFormat", 5: "NoPages", 6: "FileNotFound", 7: "UnsupportedFormat"}
    q = streams.start(streams.texts(spark, str(src)), TS, str(tmp_path / "out"), str(tmp_path / "rej"), str(tmp_path / "cp"))
    q.awaitTermination()
    rejected = spark.read.parquet(str(tmp_path / "rej")).count()
    again = streams.start(streams.texts(spark, str(src)), TS, str(tmp_path / "out"), str(tmp_path / "rej"), str(tmp_path / "cp2"))  # as if the batch had been lost
    again.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "rej")).count() == rejected > 0
    t = traces.read(spark, str(tmp_path / "out"))
    assert [r.input.text for r in t.collect() if r.input.text.startswith("Hello")] == ["Hello\nWorld"]
    rid = t.first().request_id
    assert traces.retrieve(spark, str(tmp_path / "out"), rid).count() == 1
    j = tmp_path / "json"
    j.mkdir()
    for k, r in enumerate(traces.to_json(t).collect()):
        (j / f"{k}.json").write_text(r.value)
    (j / "bad.json").write_text("invalid json {")
    ok, rejects = traces.read_json(spark, str(j))
    assert ok.count() == t.count() and rejects.count() == 1
    traces.clear(spark, str(tmp_path / "out"))
    assert traces.read(spark, str(tmp_path / "out")).count() == 0


SF = "/root/testdata/sf0.001"


def value(v):
    return float(f"{v:.8g}") if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(oracle.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    d = queries.queries()[name](spark, SF)
    cur = con.execute(oracle.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(d.columns)
    assert sorted(repr(tuple(map(value, r))) for r in cur.fetchall()) == sorted(repr(tuple(value(r[c]) for c in names)) for r in d.collect())
