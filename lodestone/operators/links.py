"""Links between documents: candidates by keyword, metadata or order; justification; three-way split."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.staging import kept
from ..functions.text import uuid5
from .pairs import pairs_within

STRATEGIES = ("keyword_overlap", "metadata_match", "sequential")
NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def _pairs(keyed: DataFrame, link_type: str) -> DataFrame:
    """keyed (key, hint, document_id, doc_pos): all pairs of a key, earlier document first. Only ids travel; a hot key is dealt out in cells."""
    p = pairs_within(keyed, "key", "doc_pos", "document_id", "hint")
    return p.select(F.col("a_document_id").alias("source_document_id"), F.col("b_document_id").alias("target_document_id"), F.lit(link_type).alias("link_type"), F.col("a_hint").alias("hint"))


def by_keyword(documents: DataFrame, *keywords: str) -> DataFrame:
    """(document_id, doc_pos, key, hint) of documents that hold a keyword."""
    if not keywords or any(not k.strip() for k in keywords):
        raise ValueError("keyword must not be blank")
    lower = [k.lower() for k in keywords]
    hits = F.filter(F.array(*[F.when(F.contains(F.lower("content"), F.lit(k)), F.lit(k)) for k in lower]), lambda x: x.isNotNull())
    return documents.select("document_id", "doc_pos", F.explode(hits).alias("key")).withColumn("hint", F.concat(F.lit("shared_keyword:"), "key"))


def keyword_links(documents: DataFrame, *keywords: str) -> DataFrame:
    """All pairs of documents that hold a keyword: n² rows by nature; link_groups() says the same in n."""
    return _pairs(by_keyword(documents, *keywords), "keyword_related")


def by_metadata(documents: DataFrame, field: str, value: str | None = None) -> DataFrame:
    """(document_id, doc_pos, key, hint) of documents with a value in a field of their metadata."""
    if not field.strip():
        raise ValueError("field must not be blank")
    keyed = documents.select("document_id", "doc_pos", F.try_element_at("metadata", F.lit(field)).alias("key")).filter("key <> ''")
    if value is not None:
        keyed = keyed.filter(F.col("key") == value)
    return keyed.withColumn("hint", F.concat(F.lit(f"shared_{field}:"), "key"))


def metadata_links(documents: DataFrame, field: str, value: str | None = None) -> DataFrame:
    """All pairs of documents with equal values: n² rows a value by nature; link_groups() says the same in n."""
    return _pairs(by_metadata(documents, field, value), "metadata_related")


def link_groups(keyed: DataFrame) -> DataFrame:
    """keyed (key, hint, document_id, doc_pos) to a row per document and key: group_id, the first document of those that share the key, and n_links, how many it is linked with.

    The same links as the pairs, at one row a document however large a group is: places and counts are
    aggregated before they move, and a hot key's rows are only counted and joined with one row.
    """
    g = keyed.groupBy("hint").agg(F.min_by("document_id", "doc_pos").alias("group_id"), (F.count("*") - 1).alias("n_links"))
    return keyed.join(kept(g, "groups").withColumnRenamed("hint", "_hint"), F.col("hint") == F.col("_hint")).select("document_id", "hint", "group_id", "n_links")


def sequential_links(documents: DataFrame) -> DataFrame:
    """doc_pos must be dense: an equi-join of each place with the next, no global window."""
    a, b = documents.select("document_id", "doc_pos").alias("a"), documents.select("document_id", "doc_pos").alias("b")
    p = a.join(b, F.col("a.doc_pos") + 1 == F.col("b.doc_pos"))
    return p.select(F.col("a.document_id").alias("source_document_id"), F.col("b.document_id").alias("target_document_id"), F.lit("sequential").alias("link_type"), F.concat(F.lit("sequential_order:"), F.col("a.doc_pos").cast("string")).alias("hint"))


def candidates(documents: DataFrame, strategy: str, **args) -> DataFrame:
    ways: dict[str, Callable] = {"keyword_overlap": lambda: keyword_links(documents, args["keyword"]), "metadata_match": lambda: metadata_links(documents, args["field"], args.get("value")), "sequential": lambda: sequential_links(documents)}
    if strategy not in ways:
        raise ValueError(f"unknown strategy {strategy!r}; supported: {', '.join(STRATEGIES)}")
    return ways[strategy]()


def dense_positions(documents: DataFrame, *order_cols: str) -> DataFrame:
    """doc_pos 0, 1, ... by order_cols without one task for all: places in range partitions plus the sizes of those before."""
    d = kept(documents.repartitionByRange(*order_cols).withColumn("_part", F.spark_partition_id()), "ranges")  # sampled once, so that both uses agree
    local = d.withColumn("_k", F.row_number().over(W.partitionBy("_part").orderBy(*order_cols)))
    sizes = d.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row per partition
    return local.join(before, F.col("_part") == F.col("_p")).withColumn("doc_pos", F.col("_k") + F.col("_before") - 1).drop("_part", "_p", "_k", "_before")


def justify(links: DataFrame, documents: DataFrame, ts, threshold: float = 0.5, reasoner=scoring.reason, scorer=scoring.evaluate, max_length: int = scoring.MAX_LENGTH) -> DataFrame:
    """Candidates with outcome edge, rejection or failure, and what an edge needs. Excerpts, not contents, are joined."""
    docs = documents.select("document_id", "source", F.substring("content", 1, 500).alias("excerpt"))
    s = docs.select(*[F.col(c).alias(f"s_{c}") for c in docs.columns])
    t = docs.select(*[F.col(c).alias(f"t_{c}") for c in docs.columns])
    j = links.join(s, F.col("source_document_id") == F.col("s_document_id"), "left").join(t, F.col("target_document_id") == F.col("t_document_id"), "left")
    missing = F.when(F.col("s_document_id").isNull(), F.concat(F.lit("source not found: "), "source_document_id")).when(F.col("t_document_id").isNull(), F.concat(F.lit("target not found: "), "target_document_id"))
    # The prompt's lines, whose words count in the coverage score.
    prompt = F.concat(
        F.lit("Analyze the relationship between two documents.\n\nSource Document: "), "s_source", F.lit("\nSource Content: "), "s_excerpt",
        F.lit("...\n\nTarget Document: "), "t_source", F.lit("\nTarget Content: "), "t_excerpt",
        F.lit("...\n\nProposed Link Type: "), "link_type", F.lit("\nHint: "), "hint",
        F.lit("\n\nJustify whether this link is valid and provide evidence."),
    )
    more = [c for c in links.columns if c not in ("source_document_id", "target_document_id", "link_type", "hint")]  # metadata and place, where candidates have them
    d = j.select("source_document_id", "target_document_id", "link_type", "hint", *more, missing.alias("_missing"), prompt.alias("text"), F.lit("link").alias("source"))
    d = scoring.accept(d, max_length).withColumn("request_id", uuid5(NAMESPACE, F.concat_ws(":", F.lit("link"), "source_document_id", "target_document_id", "link_type", "hint")))
    d = scorer(reasoner(d.withColumn("ts", F.lit(ts).cast("timestamp"))))
    error = F.coalesce("_missing", "error_code")
    outcome = F.when(error.isNotNull(), "failure").when(F.col("overall_score") >= threshold, "edge").otherwise("rejection")
    return d.withColumn("error", error).withColumn("outcome", outcome).drop("_missing", "error_code", "actual_length", "max_length")


def edges_of(judged: DataFrame, created_at) -> DataFrame:
    """Edges of accepted candidates, with the candidate's metadata (null where it has none) and its place pos as edge_pos."""
    e = judged.filter("outcome = 'edge'")
    more = [(F.col("metadata") if "metadata" in judged.columns else F.lit(None).cast("map<string,string>")).alias("metadata"), *([F.col("pos").cast("long").alias("edge_pos")] if "pos" in judged.columns else [])]
    return e.select(
        uuid5(NAMESPACE, F.concat_ws(":", F.lit("edge"), "request_id")).alias("edge_id"), F.col("source_document_id").alias("source_id"), F.col("target_document_id").alias("target_id"),
        F.col("link_type").alias("edge_type"), F.array_join("steps", " | ").alias("evidence"), F.col("request_id").alias("reasoning_trace_id"), F.col("overall_score").alias("confidence"), F.lit(created_at).cast("timestamp").alias("created_at"), *more,
    )


def failures_of(judged: DataFrame) -> DataFrame:
    return judged.filter("outcome = 'failure'").select("source_document_id", "target_document_id", "link_type", "error")


def rejections_of(judged: DataFrame) -> DataFrame:
    return judged.filter("outcome = 'rejection'").select("source_document_id", "target_document_id", "link_type", "overall_score")
