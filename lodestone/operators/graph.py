"""Node and edge tables: building, appending, checking, concept graphs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clamp, uuid5

NAMESPACE = "6ba7b812-9dad-11d1-80b4-00c04fd430c8"


@dataclass(frozen=True)
class Graph:
    graph_id: str
    nodes: DataFrame  # node_id, node_pos, document_id, label, node_type
    edges: DataFrame  # edge_id, edge_pos, source_id, target_id, edge_type, evidence, confidence


def from_documents(documents: DataFrame, graph_id: str) -> DataFrame:
    return documents.select(uuid5(NAMESPACE, F.concat(F.lit(f"{graph_id}:node:"), "document_id")).alias("node_id"), F.col("doc_pos").alias("node_pos"), "document_id", F.col("source").alias("label"), F.lit("document").alias("node_type"))


def add_edges(graph: Graph, more: DataFrame, graph_id: str) -> Graph:
    """A new graph with the edges appended; places of more are moved past those there."""
    last = graph.edges.agg(F.coalesce(F.max("edge_pos") + 1, F.lit(0)).alias("_last"))
    moved = more.withColumn("edge_pos", F.col("edge_pos") + last.scalar())
    return Graph(graph_id, graph.nodes, graph.edges.unionByName(moved, allowMissingColumns=True))


def identifiers(graph: Graph) -> DataFrame:
    ids = [graph.nodes.select(F.col("node_id").alias("id")), graph.nodes.select("document_id"), graph.edges.select("source_id"), graph.edges.select("target_id")]
    return ids[0].union(ids[1]).union(ids[2]).union(ids[3]).distinct()


def resolve_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Endpoints given as document ids become node ids; node ids stay; others stay as they are."""
    ids = nodes.select(F.col("node_id").alias("_id"), "node_id").unionByName(nodes.select(F.col("document_id").alias("_id"), "node_id"))
    ids = ids.groupBy("_id").agg(F.min("node_id").alias("_node"))
    for c in ("source_id", "target_id"):
        edges = edges.join(ids, F.col(c) == F.col("_id"), "left").withColumn(c, F.coalesce("_node", c)).drop("_id", "_node")
    return edges


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an endpoint that is no node."""
    ids = nodes.select("node_id").distinct()
    a = edges.join(ids, edges["source_id"] == ids["node_id"], "left_anti")
    b = edges.join(ids, edges["source_id"] == ids["node_id"], "left_semi").join(ids, edges["target_id"] == ids["node_id"], "left_anti")
    return a.unionByName(b)


def first_nodes(nodes: DataFrame) -> DataFrame:
    """(node_id, node_pos, label), the first of each id."""
    return nodes.groupBy("node_id").agg(F.min(F.struct("node_pos", "label")).alias("m")).select("node_id", "m.node_pos", "m.label")


def concept_graph(clusters: DataFrame, concepts: DataFrame, document_id: str) -> Graph:
    """clusters (cluster_id, member_ids, stability), concepts (id, text): concept nodes; edges within clusters.

    Two members: one edge; three or more: a triangle of the first three; four or more: also a chain
    of the first four. A cluster with a member that is no concept has no edges.
    """
    nodes = concepts.select(uuid5(NAMESPACE, F.concat(F.lit("concept:"), "id")).alias("node_id"), F.col("id"), F.lit(document_id).alias("document_id"), F.col("text").alias("label"), F.lit("concept").alias("node_type"))
    m = clusters.select("cluster_id", "stability", F.size("member_ids").alias("n"), F.posexplode(F.slice("member_ids", 1, 4)).alias("k", "member"))
    m = m.join(nodes.select("id", "node_id"), F.col("member") == F.col("id"), "left")
    whole = m.groupBy("cluster_id", "stability", "n").agg(F.array_sort(F.collect_list(F.struct("k", "node_id"))).alias("got"))
    whole = whole.filter(~F.exists("got", lambda x: x["node_id"].isNull()))
    pair = lambda kind, bonus, *at: [F.struct(F.lit(kind).alias("t"), F.lit(bonus).alias("bonus"), F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in at]
    triangle, chain = pair("related_to", 0.0, (0, 1), (1, 2), (0, 2)), pair("sequential", 0.1, (0, 1), (1, 2), (2, 3))
    plan = F.when(F.col("n") == 2, F.array(*pair("related_to", 0.0, (0, 1)))).when(F.col("n") == 3, F.array(*triangle)).when(F.col("n") >= 4, F.array(*triangle, *chain))
    e = whole.select("*", F.posexplode(plan).alias("at", "p"))
    e = e.select("cluster_id", "at", F.get("got", F.col("p.a"))["node_id"].alias("source_id"), F.get("got", F.col("p.b"))["node_id"].alias("target_id"), F.col("p.t").alias("edge_type"), clamp(F.col("stability") + F.col("p.bonus")).alias("confidence"))
    e = e.withColumn("edge_id", uuid5(NAMESPACE, F.concat_ws(":", F.lit("edge"), F.col("cluster_id").cast("string"), F.col("at").cast("string"))))
    e = e.withColumn("edge_pos", F.col("cluster_id").cast("long") * 8 + F.col("at"))
    return Graph("concepts", nodes, e)
