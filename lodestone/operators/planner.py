"""Follow-up actions over a graph: gaps, contradictions, weak evidence, ranked."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clamp, strip, uuid5
from .graph import Graph

# Edge types that support and that contradict, and the names of the strategies.
SUPPORT, CONTRADICT = ("supports", "agrees", "confirms"), ("contradicts", "refutes", "disagrees")
STRATEGIES = {"gap-driven": "gap", "contradiction-driven": "contradiction", "weak-evidence": "weak", "weak_evidence": "weak", "weak-evidence-driven": "weak"}


def _id(graph: Graph, name):
    return uuid5(uuid.uuid5(uuid.NAMESPACE_URL, f"research-planner/{graph.graph_id}"), name)


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): occurrences as an endpoint, a self-loop twice."""
    return edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def gap_actions(graph: Graph) -> DataFrame:
    d = degrees(graph.edges)
    n = graph.nodes.select("node_id", "document_id", "label")
    n = n.join(d.withColumnsRenamed({"id": "_a", "degree": "_da"}), F.col("node_id") == F.col("_a"), "left").join(d.withColumnsRenamed({"id": "_b", "degree": "_db"}), F.col("document_id") == F.col("_b"), "left")
    n = n.withColumn("degree", F.greatest(F.coalesce("_da", F.lit(0)), F.coalesce("_db", F.lit(0)))).filter("degree <= 1")
    s = lambda c: F.col(c).cast("string")
    return n.select(
        _id(graph, F.concat_ws(":", F.lit("gap"), s("document_id"), s("node_id"), s("degree"))).alias("action_id"), F.lit("investigate_gap").alias("action_type"),
        F.concat(F.lit("Find links for '"), "label", F.lit("'")).alias("description"), F.concat(F.lit("degree "), s("degree"), F.lit(" of '"), "label", F.lit("'")).alias("evidence"),
        F.lit("Few links: knowledge may be missing or not yet connected.").alias("rationale"), F.when(F.col("degree") == 0, 1.0).otherwise(0.8).alias("priority"),
        F.create_map(F.lit("document_id"), s("document_id"), F.lit("node_id"), s("node_id"), F.lit("degree"), s("degree")).alias("metadata"),
    )


def pair_types(edges: DataFrame) -> DataFrame:
    """(a, b, types): lower-cased edge types of each unordered pair, sorted."""
    return edges.groupBy(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).agg(F.array_sort(F.collect_set(F.lower("edge_type"))).alias("types"))


def contradiction_actions(graph: Graph) -> DataFrame:
    has = lambda types: F.arrays_overlap("types", F.array(*[F.lit(t) for t in types]))
    p = pair_types(graph.edges).filter(has(SUPPORT) & has(CONTRADICT))
    p = p.withColumns({"a": F.col("a").cast("string"), "b": F.col("b").cast("string"), "_t": F.array_join("types", ",")})
    return p.select(
        _id(graph, F.concat_ws(":", F.lit("contradiction"), "a", "b", "_t")).alias("action_id"), F.lit("resolve_contradiction").alias("action_type"),
        F.lit("Settle conflicting relations").alias("description"), F.concat(F.lit("Between "), "a", F.lit(" and "), "b", F.lit(": "), F.array_join("types", ", ")).alias("evidence"),
        F.lit("Relations that support and refute stand side by side; compare primary sources.").alias("rationale"), clamp(0.8 + 0.2 * F.least(F.lit(1.0), F.size("types") / 4.0)).alias("priority"),
        F.create_map(F.lit("pair_source"), F.col("a"), F.lit("pair_target"), F.col("b"), F.lit("types"), F.col("_t")).alias("metadata"),
    )


def weak_actions(graph: Graph) -> DataFrame:
    e = graph.edges.withColumn("_n", F.length(strip(F.coalesce("evidence", F.lit("")))))
    e = e.filter((F.col("confidence") < 0.6) | (F.col("_n") < 40))
    short = F.when(F.col("_n") == 0, 1.0).otherwise(clamp(40.0 / (F.col("_n") + 40.0)))
    s = lambda c: F.col(c).cast("string")
    return e.select(
        _id(graph, F.concat_ws(":", F.lit("weak"), s("edge_id"), s("source_id"), s("target_id"), "edge_type", s("_n"))).alias("action_id"), F.lit("strengthen_evidence").alias("action_type"),
        F.concat(F.lit("Strengthen evidence of '"), "edge_type", F.lit("'")).alias("description"), F.concat(F.lit("evidence length "), s("_n"), F.lit(" of edge "), s("edge_id")).alias("evidence"),
        F.lit("Little supports this link; gather citations or longer quotations.").alias("rationale"), clamp(0.5 * clamp((0.6 - F.col("confidence")) / 0.6) + 0.5 * short).alias("priority"),
        F.create_map(F.lit("edge_id"), s("edge_id"), F.lit("edge_type"), F.col("edge_type"), F.lit("source_id"), s("source_id"), F.lit("target_id"), s("target_id")).alias("metadata"),
    )


def actions(graph: Graph, strategy: str) -> DataFrame:
    """All actions of a strategy, unranked."""
    ways = {"gap": gap_actions, "contradiction": contradiction_actions, "weak": weak_actions}
    name = STRATEGIES.get(strategy.strip().lower())
    if not name:
        raise ValueError(f"unknown strategy {strategy!r}; supported: {', '.join(STRATEGIES)}")
    return ways[name](graph)


def plan(graph: Graph, strategy: str, max_actions: int = 10) -> DataFrame:
    """The max_actions foremost actions."""
    return actions(graph, strategy).orderBy(F.desc("priority"), "action_type", "description", "action_id").limit(max(0, max_actions))
