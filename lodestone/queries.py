"""The operators over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scoring
from .functions.plugins import Plugin
from .functions.staging import folder, kept
from .functions.text import key_terms, split_words, uuid5
from .operators import clusters, components, extract, graph, links, models, motifs, planner
from .plans import runs
from .sources import ingest, store, traces
from .streaming import streams

TS = "2024-01-01 00:00:00"
ROLES = ["background", "objective", "method", "result", "finding", "conclusion", "other"]
LEMMAS = [v for verbs in extract.VERBS.values() for v in verbs]
EPS, FOREST_EPS = 0.6, 1.15
#: Characters of a span that the stand-in model takes.
MOST_CHARS = 300
#: Characters of the texts whose words are numbered in one task; about half a million words and their entities.
CHARS_A_TASK = 1 << 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_inputs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "text", "source", uuid5(links.NAMESPACE, F.concat_ws(":", "source", F.col("doc_id").cast("string"))).alias("request_id"))


def documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("document_id"), F.col("doc_id").alias("doc_pos"), F.col("text").alias("content"), "source", F.lit("text").alias("format"), F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang")).alias("metadata"))


def in_order(spark, sf_dir):
    """All documents with dense places in the order of their ids."""
    return links.dense_positions(documents(spark, sf_dir).withColumn("_n", F.col("doc_pos")).drop("doc_pos"), "_n")


def graph_e(spark, sf_dir, types=None):
    """Users as nodes; an edge from each event's user to the next event's."""
    e = links.dense_positions(table(spark, sf_dir, "events"), "ts", "event_id")
    a = e.select("doc_pos", "event_id", "user_id", "event_type", "props")
    b = e.select((F.col("doc_pos") - 1).alias("_p"), F.col("user_id").alias("_next"))
    kind = F.create_map(*[F.lit(x) for kv in {"click": "supports", "purchase": "confirms", "error": "contradicts", "signup": "refutes", "view": "references"}.items() for x in kv])
    j = a.join(b, F.col("doc_pos") == F.col("_p"))
    if types:
        j = j.filter(F.col("event_type").isin(*types))
    edges = j.select(
        F.col("event_id").alias("edge_id"), F.col("doc_pos").alias("edge_pos"), F.col("user_id").alias("source_id"), F.col("_next").alias("target_id"), F.try_element_at(kind, F.col("event_type")).alias("edge_type"),
        F.repeat("props", (1 + F.col("event_id") % 6).cast("int")).alias("evidence"), ((F.col("event_id") % 101) / 100.0).alias("confidence"),
    )
    nodes = table(spark, sf_dir, "events").select(F.col("user_id").alias("node_id")).distinct().select("node_id", F.col("node_id").alias("node_pos"), F.col("node_id").alias("document_id"), F.concat(F.lit("user_"), F.col("node_id").cast("string")).alias("label"), F.lit("user").alias("node_type"))
    return graph.Graph("events", nodes, edges)


def graph_k(spark, sf_dir):
    """All documents as nodes; of the links in order those that are justified as edges."""
    d = documents(spark, sf_dir)
    nodes = d.select(F.col("document_id").alias("node_id"), F.col("doc_pos").alias("node_pos"), "document_id", F.concat_ws(":", "source", "document_id").alias("label"), F.lit("document").alias("node_type"))
    return graph.Graph("documents", nodes, kept(links.edges_of(justified(spark, sf_dir), TS), "edges"))


def packets_accept(spark, sf_dir):
    return scoring.accept(raw_inputs(spark, sf_dir)).select("doc_id", "error_code", "actual_length")


def reject_counts(spark, sf_dir):
    return scoring.rejected(scoring.accept(raw_inputs(spark, sf_dir))).groupBy("error_code").agg(F.count("*").alias("n"), F.max("actual_length").alias("longest"))


def score_documents(spark, sf_dir):
    d = scoring.accepted(scoring.accept(raw_inputs(spark, sf_dir))).withColumn("ts", F.lit(TS).cast("timestamp"))
    d = scoring.evaluate(scoring.reason(d))
    return d.select("doc_id", F.size(split_words(F.col("text"))).alias("n_words"), "confidence", *scoring.SCORES)


def run_conclusions(spark, sf_dir):
    raw = raw_inputs(spark, sf_dir).drop("doc_id")
    calls = raw.select("request_id", F.explode(F.array(F.struct(F.lit(0).alias("call_pos"), F.lit("word_count").alias("name")), F.struct(F.lit(1).alias("call_pos"), F.lit("missing").alias("name")))).alias("c"), F.col("text").alias("input"))
    t = runs.run(raw, TS, calls.select("request_id", "c.call_pos", "c.name", "input"))
    return t.select("request_id", "conclusion", F.size("tool_calls").alias("n_calls"), F.get("tool_calls", F.lit(0))["output"].alias("word_count"))


def compare_configs(spark, sf_dir):
    p = scoring.accepted(scoring.accept(raw_inputs(spark, sf_dir))).withColumn("ts", F.lit(TS).cast("timestamp"))
    configs = spark.createDataFrame([(0, "plain", "default", False), (1, "scored", "none", True), (2, "scored", "default", True), (3, "broken", "none", True)], "pos int, name string, reasoner string, evaluate boolean")
    return runs.compare(p, configs).groupBy("config").agg(F.count("*").alias("n"), F.count("error").alias("errors"), F.round(F.avg("overall_score"), 9).alias("mean_score"))


def link_keyword(spark, sf_dir):
    return links.keyword_links(documents(spark, sf_dir), "license")


def link_metadata(spark, sf_dir):
    return links.metadata_links(documents(spark, sf_dir), "source", "src1")


def link_sequential(spark, sf_dir):
    return links.sequential_links(in_order(spark, sf_dir))


def link_keyword_groups(spark, sf_dir):
    """The links of two keywords at a row a document: groups grow, rows do not square."""
    return links.link_groups(links.by_keyword(documents(spark, sf_dir), "license", "copyright"))


def link_metadata_groups(spark, sf_dir):
    """The links of all sources at a row a document."""
    return links.link_groups(links.by_metadata(documents(spark, sf_dir), "source"))


def justified(spark, sf_dir):
    """All links in order, justified; every seventh ends at no document."""
    c = links.sequential_links(in_order(spark, sf_dir)).withColumn("pos", F.col("source_document_id").cast("long"))
    c = c.withColumn("target_document_id", F.when(F.col("pos") % 7 == 0, "none").otherwise(F.col("target_document_id")))
    return links.justify(c, documents(spark, sf_dir), TS, threshold=0.75)


def link_outcomes(spark, sf_dir):
    j = justified(spark, sf_dir)
    return j.select("source_document_id", "target_document_id", "outcome", F.when(F.col("outcome") != "failure", F.round("overall_score", 9)).alias("overall_score"))


def _actions(d):
    return d.select("action_id", "action_type", F.round("priority", 9).alias("priority"), "evidence")


def plan_gap(spark, sf_dir):
    return _actions(planner.gap_actions(graph_k(spark, sf_dir)))


def plan_contradiction(spark, sf_dir):
    return _actions(planner.contradiction_actions(graph_e(spark, sf_dir)))


def plan_weak(spark, sf_dir):
    return _actions(planner.weak_actions(graph_e(spark, sf_dir)))


def plan_top(spark, sf_dir):
    return _actions(planner.plan(graph_e(spark, sf_dir), "Weak-Evidence"))


def node_degrees(spark, sf_dir):
    return planner.degrees(graph_e(spark, sf_dir).edges)


def pair_types(spark, sf_dir):
    return planner.pair_types(graph_e(spark, sf_dir).edges).select("a", "b", F.array_join("types", ",").alias("types"))


def dangling_edges(spark, sf_dir):
    g = graph_e(spark, sf_dir)
    return graph.dangling(g.edges, g.nodes.filter("node_id % 10 <> 0")).select("edge_id")


def graph_identifiers(spark, sf_dir):
    return graph.identifiers(graph_k(spark, sf_dir))


def _motif(d, *more):
    line = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return d.select(line("supporting_nodes").alias("nodes"), line("supporting_edges").alias("edges"), F.round("confidence", 9).alias("confidence"), *more)


def motif_gap(spark, sf_dir):
    return _motif(motifs.gaps(graph_e(spark, sf_dir)))


def motif_cluster(spark, sf_dir):
    return _motif(motifs.clusters(graph_e(spark, sf_dir)))


def motif_hub(spark, sf_dir):
    h = motifs.hubs(graph_e(spark, sf_dir))
    return _motif(h.withColumn("_d", F.col("description")), "_d").withColumnRenamed("_d", "description")


def motif_contradiction(spark, sf_dir):
    return _motif(motifs.contradictions(graph_e(spark, sf_dir)))


def motif_chain(spark, sf_dir):
    return _motif(motifs.chains(graph_e(spark, sf_dir)))


def motif_counts(spark, sf_dir):
    return motifs.motif_counts(graph_e(spark, sf_dir), 0.5)


def conversation_traces(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    t = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    steps = F.transform("turns", lambda x: x["text"])
    scores = F.struct(*[F.lit(0.5).alias(s) for s in scoring.SCORES])
    call = F.array(F.struct(F.lit("echo").alias("name"), F.get(steps, F.lit(0)).alias("input"), F.get(steps, F.lit(0)).alias("output")))
    rid = F.col("conv_id").cast("string")
    return t.select(
        rid.alias("request_id"), F.struct(F.get(steps, F.lit(0)).alias("text"), rid.alias("request_id"), F.lit("2024-01-01T00:00:00+00:00").alias("timestamp"), F.lit("conversation").alias("source")).alias("input"),
        F.struct(steps.alias("reasoning_steps"), F.lit(0.9).alias("confidence_score")).alias("reasoning"), F.when(F.col("conv_id") % 3 != 0, scores).alias("evaluation"), F.when(F.col("conv_id") % 2 == 0, call).alias("tool_calls"), F.lit(TS).cast("timestamp").alias("created_at"),
    )


def trace_replay(spark, sf_dir):
    f = traces.replay(conversation_traces(spark, sf_dir))
    return f.select("request_id", "frame_index", "frame_type", F.get_json_object("content", "$.step").alias("step"))


def trace_round_trip(spark, sf_dir):
    """Traces to JSON and back, then replayed; must equal trace_replay."""
    back = traces.from_json(traces.to_json(conversation_traces(spark, sf_dir))).select("trace.*")
    return traces.replay(back).select("request_id", "frame_index", "frame_type", F.get_json_object("content", "$.step").alias("step"))


def trace_versions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("request_id"), "event_id", F.col("ts").alias("created_at"), F.col("event_id").alias("seq"))
    return traces.last_versions(e).select("request_id", "event_id")


def page_assembly(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("turn") % 4 == 3, "").otherwise(F.col("text")))
    return ingest.assemble_pages(c, "conv_id", "turn", "text")


def cluster_summary(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("vec_id").alias("pos"), F.concat(F.lit("item "), F.col("vec_id").cast("string")).alias("text"), "embedding", F.when(F.col("vec_id") % 11 == 0, -1).otherwise(F.col("label")).alias("label"), ((F.col("vec_id") % 10) / 10.0).alias("probability"))
    s = clusters.summarise(e)
    return s.select("cluster_id", F.array_join("member_ids", ",").alias("members"), "representative_id", "representative_text", "size", F.round("mean_probability", 9).alias("mean_probability"), F.round("least_d2", 6).alias("least_d2"), "stability")


def cluster_members(spark, sf_dir):
    """The members of each label as rows, with their distance from its centroid."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return clusters.members(e).select("cluster_id", "vec_id", F.round("d2", 6).alias("d2"))


def concept_edges(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    c = e.groupBy(F.floor(F.col("vec_id") / 25).alias("cluster_id")).agg(F.transform(F.array_sort(F.collect_list("vec_id")), lambda x: x.cast("string")).alias("member_ids"), F.lit(0.95).alias("stability"))
    concepts = e.filter(F.get("embedding", F.lit(0)) > -0.2).select(F.col("vec_id").cast("string").alias("id"), F.concat(F.lit("term "), F.col("vec_id").cast("string")).alias("text"))
    g = graph.concept_graph(c, concepts, "doc")
    n = g.nodes.select("node_id", F.col("id"))
    a, b = n.withColumnsRenamed({"node_id": "_a", "id": "source"}), n.withColumnsRenamed({"node_id": "_b", "id": "target"})
    return g.edges.join(a, F.col("source_id") == F.col("_a")).join(b, F.col("target_id") == F.col("_b")).select("cluster_id", "source", "target", "edge_type", F.round("confidence", 9).alias("confidence"))


def token_pool(spark, sf_dir):
    t = table(spark, sf_dir, "embeddings").select(F.col("label").alias("id"), F.col("embedding").alias("vector"), (F.col("vec_id") % 4 != 0).cast("int").alias("mask"))
    return clusters.pool(t).select("id", F.posexplode("embedding").alias("dim", "x")).select("id", "dim", F.round("x", 9).alias("x"))


def role_softmax(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", extract.role_scores(F.col("embedding"), ROLES).alias("r"))
    return e.select("vec_id", "r.role", F.round("r.confidence", 9).alias("confidence"), (F.col("r.role").isin(*extract.CONCEPT_ROLES) & (F.col("r.confidence") > 0.3)).alias("is_concept"))


def eps_components(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return clusters.threshold_clusters(e, EPS)


def document_terms(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(key_terms(F.col("text")), "|").alias("terms"))


def distinct_terms(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return extract.distinct_terms(d.select(F.explode(key_terms(F.col("text"))).alias("term")))


def sentence_spans(spark, sf_dir):
    s = extract.sentence_spans(table(spark, sf_dir, "documents"), "doc_id", "text")
    return s.select("doc_id", "k", F.length("span_text").alias("n"), F.md5("span_text").alias("digest"), "start", "end")


def annotated_tokens(spark, sf_dir):
    """Whitespace words of conversations with made-up annotation: every fifth is a verb between its subject and object."""
    from pyspark.sql import Window as W

    c = table(spark, sf_dir, "conversations")
    # texts are dealt out before they become words: the rows of a task are as many however large the table is
    n = (c.agg(F.sum(F.length("text"))).head()[0] or 0) // CHARS_A_TASK
    c = c.select(F.concat_ws(":", "conv_id", "turn").alias("doc_id"), "text").repartition(max(n, spark.sparkContext.defaultParallelism), "doc_id")
    w = c.select("doc_id", F.posexplode(F.filter(F.split("text", r"[ \t\n\r]+"), lambda x: x != "")).alias("i", "text"))
    before = W.partitionBy("doc_id").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    w = w.withColumn("idx", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("int"))
    k = F.col("i") % 5
    lemma = F.when(F.col("i") % 10 == 2, F.get(F.array(*[F.lit(x) for x in LEMMAS]), F.pmod((F.col("i") / 10).cast("int"), F.lit(len(LEMMAS))))).otherwise(F.lower("text"))
    t = w.select("doc_id", "i", "text", lemma.alias("lemma"), F.when(k == 2, "VERB").otherwise("NOUN").alias("pos"), F.when(k == 1, "nsubj").when(k == 3, "dobj").when(k == 2, "ROOT").otherwise("dep").alias("dep"), F.when(k == 1, F.col("i") + 1).when(k == 3, F.col("i") - 1).otherwise(F.col("i")).alias("head"), "idx")
    e = w.filter("i % 5 IN (1, 3)").select("doc_id", F.col("i").alias("ord"), "text", F.col("idx").alias("start"), (F.col("idx") + F.length("text")).alias("end"))
    return t, e


def svo_relations(spark, sf_dir):
    r = extract.relations(*annotated_tokens(spark, sf_dir))
    return r.select("doc_id", "verb_i", "relation_type", "subject", "subject_start", "subject_end", "object", "object_start", "object_end", "predicate", F.round("confidence", 9).alias("confidence"), "pattern")


def _digits():
    """Stands for a model: a role's number is a digit of the span's digest. Long spans are too much for it."""
    import hashlib

    def run(spans):
        if any(len(s) > MOST_CHARS for s in spans):
            raise ValueError("span too long")
        return [[int(x, 16) / 2 for x in hashlib.md5(s.encode()).hexdigest()[: len(ROLES)]] for s in spans]

    return run


def _spans(spark, sf_dir):
    return models.scored_spans(table(spark, sf_dir, "documents"), Plugin("digits", _digits, "array<double>"), ROLES)


def scored_spans(spark, sf_dir):
    """Sentences with the role that a model gives them; those it fails on with its error."""
    s = _spans(spark, sf_dir)
    return s.select("doc_id", "k", "start", "end", "role", F.round("confidence", 9).alias("confidence"), F.concat_ws(":", "provenance.model", "provenance.strategy").alias("provenance"), F.concat_ws(":", "error.module", "error.error_type", "error.error").alias("error"))


def role_term_motifs(spark, sf_dir):
    """Sentences to roles, terms, clusters of like terms, concept graph and motifs."""
    m = runs.concept_motifs(_spans(spark, sf_dir), lambda t: t.withColumn("embedding", F.array(F.length("term"), F.ascii("term"), F.ascii(F.right("term", F.lit(1)))).cast("array<double>")), 0.5)
    return m.groupBy("hypothesis_type").agg(F.count("*").alias("n"))


def packets_all(spark, sf_dir):
    """Packets of all texts, also of those that accept() rejects: a single one would stop scoring.accept_all, which is for batches that their caller can mend, and leave none of the table."""
    return scoring.normalised(raw_inputs(spark, sf_dir)).select("doc_id", F.length("text").alias("n"), F.md5("text").alias("digest"))


def score_violations(spark, sf_dir):
    return scoring.violations(score_documents(spark, sf_dir), confidence=(0.85, 1.0), input_coverage_score=(0.005, 0.2)).select("doc_id")


def tool_outputs(spark, sf_dir):
    """Every accepted document under three configurations with tool calls, one of them a registered tool, one unknown, and a reasoner that fails."""
    scoring.register_tool("letters", lambda c: F.length(c).cast("string"))
    p = scoring.accepted(scoring.accept(raw_inputs(spark, sf_dir))).withColumn("ts", F.lit(TS).cast("timestamp"))
    configs = spark.createDataFrame(
        [(0, "none", "default", False, None), (1, "calls", "default", True, [("letters", "abc"), ("gone", "x"), ("word_count", "a b")]), (2, "fails", "broken", True, [("echo", "x")])],
        "pos int, name string, reasoner string, evaluate boolean, calls array<struct<name:string,input:string>>",
    )

    def broken(packets):
        raise RuntimeError("no reasoner")

    c = runs.compare(p, configs, {"default": scoring.reason, "broken": broken})
    told = F.array_join(F.transform("tool_calls", lambda x: F.concat_ws("=", x["name"], x["output"])), ",")
    return c.select("request_id", "config", F.size("steps").alias("n_steps"), F.round("overall_score", 9).alias("overall_score"), told.alias("outputs"), "error.error_type", "error.message")


def edges_added(spark, sf_dir):
    """Graph E with its edges turned round appended."""
    g = graph_e(spark, sf_dir)
    back = g.edges.select("*", F.col("target_id").alias("_s"), F.col("source_id").alias("_t")).withColumns({"source_id": F.col("_s"), "target_id": F.col("_t")}).drop("_s", "_t")
    return graph.add_edges(g, back, "both").edges.select("edge_id", "edge_pos", "source_id", "target_id")


def document_nodes(spark, sf_dir):
    return graph.from_documents(documents(spark, sf_dir), "corpus").select("node_id", "node_pos", "document_id", "label")


def endpoints_resolved(spark, sf_dir):
    """Edges between document ids, resolved to the nodes of the documents."""
    d = in_order(spark, sf_dir)
    e = links.sequential_links(d).select(F.col("hint").alias("edge_id"), F.col("source_document_id").alias("source_id"), F.col("target_document_id").alias("target_id"))
    return graph.resolve_endpoints(e, graph.from_documents(d, "corpus"))


def trace_store(spark, sf_dir):
    """Traces stored, a third of them stored again later with other input, the store compacted, then read in the order of time."""
    s = store.Store(spark, f"{folder(spark)}/traces-{uuid.uuid4().hex}")
    t = conversation_traces(spark, sf_dir)
    s.put(t)
    again = t.filter(F.col("request_id").cast("long") % 3 == 0)
    s.put(again.withColumns({"created_at": F.lit("2024-01-02 00:00:00").cast("timestamp"), "input": F.col("input").withField("source", F.lit("again"))}), 1)
    s.compact()
    r = traces.list_all(s.last()).select("request_id", F.col("input.source").alias("source"), F.size("reasoning.reasoning_steps").alias("n_steps"), F.monotonically_increasing_id().alias("_n"))
    return links.dense_positions(r, "_n").select("request_id", "source", "n_steps", F.col("doc_pos").alias("place"))


def trace_lookup(spark, sf_dir):
    """The trace of the request with the least id, looked up in the store; then the store is cleared, and has none."""
    s = store.Store(spark, f"{folder(spark)}/traces-{uuid.uuid4().hex}")
    t = conversation_traces(spark, sf_dir)
    s.put(t)
    least = t.agg(F.min(F.col("request_id").cast("long")).cast("string")).first()[0]
    found = kept(s.get(least).select("request_id", F.col("input.text").alias("text")), "found")
    s.clear()
    return found.unionByName(s.get(least).select("request_id", F.col("input.text").alias("text")))


def ingested_files(spark, sf_dir):
    """Conversations written as one text file each, then ingested by a manifest with an unknown format, a missing file and a PDF without pages."""
    path = f"{folder(spark)}/files-{uuid.uuid4().hex}"
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n").alias("value"))
    # tasks move their own files to their places; by default the driver moves all of them, one after the other
    c.repartition("conv_id").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("conv_id").text(path)
    files = ingest.file_names(spark, path, "*.txt")
    m = links.dense_positions(files, "path").select(F.col("doc_pos").alias("pos"), "path", F.when(F.col("doc_pos") % 50 == 49, "docx").when(F.col("doc_pos") % 50 == 48, "pdf").otherwise("text").alias("format"))
    m = m.withColumn("path", F.when(F.col("pos") % 50 == 47, F.concat("path", F.lit("-gone"))).otherwise(F.col("path")))
    good, bad = ingest.ingest(spark, m, "corpus")
    conv = F.regexp_extract("path", "conv_id=([0-9]+)", 1).cast("long").alias("conv_id")
    good = good.withColumn("path", F.col("source")).select(conv, F.col("doc_pos").alias("pos"), "corpus_id", F.length("content").alias("n"), F.md5("content").alias("digest"))
    return good.unionByName(bad.select(conv, F.col("pos").cast("long").alias("pos"), "error_type"), allowMissingColumns=True)


def parsed_items(spark, sf_dir):
    """Conversations as JSON lists, every fifth as an object instead, every seventh broken off."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    items = F.to_json(F.transform("t", lambda x: F.struct(x["turn"].cast("string").alias("id"), x["text"].alias("text"))))
    value = F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit('{"items": '), items, F.lit("}"))).when(F.col("conv_id") % 7 == 0, F.substring(items, 1, 20)).otherwise(items)
    found = extract.parse_items(c.select(value.alias("value")))
    return found.select("id", F.when(F.col("error").isNull(), F.md5("text")).alias("digest"), "error.error_type", "error.module")


def parsed_relations(spark, sf_dir):
    """Documents as relation inputs, with entities that are a list, none or no list."""
    d = table(spark, sf_dir, "documents")
    entity = F.to_json(F.struct("text", F.array(F.struct(F.col("lang").alias("text"), F.lit(0).alias("start"), F.lit(2).alias("end"), F.lit("L").alias("type"))).alias("entities")))
    value = F.when(F.col("doc_id") % 4 == 1, F.to_json(F.struct("text", F.col("lang").alias("entities")))).when(F.col("doc_id") % 4 == 2, F.to_json(F.array("lang"))).when(F.col("doc_id") % 4 == 3, F.to_json(F.struct(F.col("lang").alias("entities")))).otherwise(entity)
    p = extract.parse_relation_input(d.select(value.alias("value")))
    return p.groupBy(F.col("error.error_type").alias("error_type")).agg(F.count("*").alias("n"), F.sum(F.size("entities")).alias("entities"), F.sum(F.length("text")).cast("long").alias("chars"))


def exported_scores(spark, sf_dir):
    """Vectors as JSON rows with a score clamped to [0, 1]."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.get("embedding", F.lit(0)).cast("double") * 4, 6).alias("score"))
    j = extract.export(e, "score")
    return j.select(F.get_json_object("value", "$.vec_id").cast("long").alias("vec_id"), F.get_json_object("value", "$.score").cast("double").alias("score"), F.regexp_replace("value", "[0-9.E-]+", "0").alias("form"))


def link_strategies(spark, sf_dir):
    """Candidates by the strategies' names: of a keyword and of the order."""
    named = links.candidates(documents(spark, sf_dir), "keyword_overlap", keyword="License")
    return named.unionByName(links.candidates(in_order(spark, sf_dir), "sequential"))


def rescored_links(spark, sf_dir):
    """The links of link_outcomes under a scorer that takes the confidence as the score."""
    c = links.sequential_links(in_order(spark, sf_dir))
    j = links.justify(c, documents(spark, sf_dir), TS, threshold=0.9, scorer=lambda d: d.withColumn("overall_score", F.col("confidence") - F.when(F.length("text") > 800, 0.25).otherwise(0.0)))
    return j.select("source_document_id", "target_document_id", "outcome", F.round("overall_score", 9).alias("overall_score"))


def distinct_entities(spark, sf_dir):
    """Words of conversations as entities, some given again under another text, some with spans that are empty or negative."""
    _, e = annotated_tokens(spark, sf_dir)
    again = e.filter("ord % 3 = 0").withColumns({"ord": F.col("ord") + 100_000, "text": F.concat(F.lit("again "), "text")})
    bad = e.filter("ord % 4 = 0").withColumns({"start": F.when(F.col("ord") % 8 == 0, -1).otherwise(F.col("end")), "ord": F.col("ord") + 200_000})
    return extract.valid_entities(e.unionByName(again).unionByName(bad)).select("doc_id", "ord", "text", "start", "end")


def compare_faults(spark, sf_dir):
    """Configurations whose reasoners fail: a plug-in on some rows, a function of the table as it runs."""

    def model():
        def run(texts):
            if any(len(t) % 5 == 0 for t in texts):
                raise ValueError("length")
            return [{"steps": ["Read.", "Done."], "confidence": 0.5} for _ in texts]

        return run

    p = scoring.accepted(scoring.accept(raw_inputs(spark, sf_dir))).withColumn("ts", F.lit(TS).cast("timestamp"))
    stops = lambda d: scoring.reason(d).withColumn("confidence", F.when(F.length("text") > 0, F.raise_error(F.lit("stopped"))).otherwise(F.col("confidence")))
    configs = spark.createDataFrame([(0, "plain", "default", True), (1, "plugin", "plugin", True), (2, "stops", "stops", False)], "pos int, name string, reasoner string, evaluate boolean")
    c = runs.compare(p, configs, {"default": scoring.reason, "plugin": Plugin("two", model, "struct<steps:array<string>,confidence:double>"), "stops": stops})
    return c.select("request_id", "config", F.size("steps").alias("n_steps"), "confidence", F.col("error").isNotNull().alias("failed"), F.when(F.col("config") == "plugin", F.col("error.message")).alias("message"))


def min_spanning_forest(spark, sf_dir):
    """The minimum spanning forest of vectors at most FOREST_EPS apart."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    f = components.spanning_forest(clusters.links_within(e, FOREST_EPS))
    return f.select("u", "v", F.round("distance", 9).alias("distance"))


def eps_components_indexed(spark, sf_dir):
    """The clusters of eps_components by the approximate index."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return clusters.threshold_clusters(e, EPS, clusters.near_links)


def cluster_hierarchy(spark, sf_dir):
    """Clusters that persist in the hierarchy of the forest, summed up with how much they do."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    forest = components.spanning_forest(clusters.links_within(e.withColumnRenamed("vec_id", "id"), FOREST_EPS))
    labels, value = clusters.hierarchy(forest, FOREST_EPS)
    items = e.join(labels, F.col("vec_id") == F.col("id")).select(F.col("vec_id").cast("string").alias("id"), F.col("vec_id").alias("pos"), F.concat(F.lit("item "), F.col("vec_id").cast("string")).alias("text"), "embedding", "label", F.lit(1.0).alias("probability"))
    s = clusters.summarise(items, value, gather=False)
    return s.select("cluster_id", "size", "representative_id", F.round("least_d2", 6).alias("least_d2"), F.round("stability", 6).alias("stability"))


def _turns_as_files(spark, sf_dir, columns):
    """Conversations' turns written to a few files, for a stream to read one after the other."""
    path = f"{folder(spark)}/turns-{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "conversations").selectExpr(*columns)
    d.repartition(3).write.parquet(path)
    return spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 2).parquet(path)


def stream_ingest(spark, sf_dir):
    """Turns as a stream of texts to stored traces and rejects."""
    path = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    raw = _turns_as_files(spark, sf_dir, ["text", "concat(conv_id, ':', turn) AS source"])
    streams.start(raw, TS, f"{path}/traces", f"{path}/rejects", f"{path}/checkpoint").awaitTermination()
    good = traces.read(spark, f"{path}/traces").select(F.col("input.source").alias("source"), F.lit("trace").alias("outcome"), F.round("evaluation.overall_score", 9).alias("overall_score"))
    return good.unionByName(spark.read.schema("source string, error_code string").parquet(f"{path}/rejects").select("source", F.col("error_code").alias("outcome"), F.lit(None).cast("double").alias("overall_score")))


def stream_upsert(spark, sf_dir):
    """Turns as versions of their conversation's trace, late ones among them: the store keeps the last of each."""
    path = f"{folder(spark)}/store-{uuid.uuid4().hex}"
    at = f"timestamp '{TS}' + make_interval(0, 0, 0, 0, 0, 0, turn)"
    body = "struct(text, CAST(conv_id AS STRING) AS request_id, '' AS timestamp, role AS source)"
    raw = _turns_as_files(spark, sf_dir, ["CAST(conv_id AS STRING) AS request_id", f"{body} AS input", "struct(array(text) AS reasoning_steps, 0.5D AS confidence_score) AS reasoning", f"CAST(NULL AS {traces.EVALUATION}) AS evaluation", "CAST(NULL AS array<struct<name:string,input:string,output:string>>) AS tool_calls", f"{at} AS created_at"])
    s = store.Store(spark, f"{path}/store")
    streams.upsert(raw, s, f"{path}/checkpoint", every=2).awaitTermination()
    return s.last().select("request_id", F.md5("input.text").alias("digest"), F.col("input.source").alias("role"))


QUERIES = (
    packets_accept, reject_counts, score_documents, run_conclusions, compare_configs, link_keyword, link_metadata, link_sequential, link_outcomes, plan_gap, plan_contradiction, plan_weak, plan_top,
    node_degrees, pair_types, dangling_edges, graph_identifiers, motif_gap, motif_cluster, motif_hub, motif_contradiction, motif_chain, motif_counts, trace_replay, trace_round_trip, trace_versions, page_assembly,
    cluster_summary, concept_edges, token_pool, role_softmax, eps_components, document_terms, distinct_terms, sentence_spans, svo_relations, role_term_motifs,
    link_keyword_groups, link_metadata_groups, packets_all, score_violations, tool_outputs, edges_added, document_nodes, endpoints_resolved, trace_store, trace_lookup, ingested_files, parsed_items, parsed_relations, exported_scores,
    cluster_members, scored_spans, link_strategies, rescored_links, distinct_entities, compare_faults, min_spanning_forest, eps_components_indexed, cluster_hierarchy, stream_ingest, stream_upsert,
)


def queries():
    return {f.__name__: f for f in QUERIES}
