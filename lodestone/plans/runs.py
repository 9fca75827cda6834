"""Chains of operators: run to conclusions, compare configurations, apply tool calls, text to concept motifs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.plugins import ERROR, Plugin, call
from ..functions.staging import kept, setting
from ..functions.text import key_terms
from ..operators import clusters, extract, graph, motifs
from ..sources import traces

#: Spark's setting for the rows that go to Python at once, and how many of them: texts may be long, and each task holds what it has sent.
BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1024


def apply_tools(packets: DataFrame, calls: DataFrame) -> DataFrame:
    """packets (request_id, ...), calls (request_id, call_pos, name, input): tool_calls in call order; unknown tools fall out; null where none was asked for."""
    out = None
    for name in scoring.tool_names():
        value = scoring.TOOLS[name](F.col("input"))
        out = F.when(F.col("name") == name, value) if out is None else out.when(F.col("name") == name, value)
    c = calls.withColumn("output", out)
    entry = F.when(F.col("name").isin(*scoring.tool_names()), F.struct("call_pos", "name", "input", "output"))
    g = c.groupBy(F.col("request_id").alias("_r")).agg(F.array_sort(F.collect_list(entry)).alias("_c"))
    g = g.select("_r", F.transform("_c", lambda x: F.struct(x["name"].alias("name"), x["input"].alias("input"), x["output"].alias("output"))).alias("tool_calls"))
    return packets.join(g, F.col("request_id") == F.col("_r"), "left").drop("_r")


def run(raw: DataFrame, ts, calls: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """raw (request_id, text, source) to traces with conclusion; stored under path if given."""
    p = scoring.reason(scoring.accepted(scoring.accept(raw)).withColumn("ts", F.lit(ts).cast("timestamp")))
    p = apply_tools(p, calls) if calls is not None else p
    t = traces.build(p, ts)
    if path:
        traces.store(t, path)
    return t.withColumn("conclusion", scoring.conclusion(F.col("reasoning.reasoning_steps")))


def compare(packets: DataFrame, configs: DataFrame, reasoners: dict[str, Callable[[DataFrame], DataFrame] | Plugin] | None = None, isolate: bool = True) -> DataFrame:
    """Every packet under every config (pos, name, reasoner, evaluate, and maybe calls: array of name and input): (request_id, config, steps, confidence, overall_score, tool_calls, error). Of equal names the last wins.

    Each reasoner in use runs once over the packets, however many configs share it. A reasoner is a
    function of the table, or a Plugin from text to struct<steps:array<string>,confidence:double>. One
    that is unknown, or that fails, leaves rows with an error of its type for its own configs only: a
    plug-in on the rows that it fails on, a function of the table on all of its configs' rows, for which
    its result is written before it is used (isolate; without, only plans that fail are caught). A plug-in
    gets ROWS texts at once at most, whatever its batch, where its result is written.
    Unknown tools fall out; tool_calls is null where a config asks for none.
    """
    ways = reasoners or {"default": scoring.reason}
    last = configs.withColumn("_k", F.row_number().over(W.partitionBy("name").orderBy(F.desc("pos")))).filter("_k = 1")
    by_reasoner: dict[str, list] = {}
    for r in last.collect():  # the caller's own few configurations
        by_reasoner.setdefault(r["reasoner"], []).append(r)
    columns = ["steps", "confidence", "overall_score"]
    out = None
    for name, rows in by_reasoner.items():
        scored, broken = any(r["evaluate"] for r in rows), None
        try:
            if name not in ways:
                raise LookupError(f"unknown reasoner {name}")
            way = ways[name]
            if isinstance(way, Plugin):
                d = packets.withColumn("_p", call(way, "text"))
                d = d.withColumns({"steps": F.col("_p.value.steps"), "confidence": F.col("_p.value.confidence"), "error": F.col("_p.error").cast(ERROR)})
            else:
                d = way(packets).withColumn("error", F.lit(None).cast(ERROR))
            d = scoring.evaluate(d) if scored else d.withColumn("overall_score", F.lit(None).cast("double"))
            d = d.select("request_id", *columns, "error").withColumn("overall_score", F.when(F.col("error").isNull(), F.col("overall_score")))
            if isolate and name in ways and ways[name] is not scoring.reason:
                with setting(packets.sparkSession, BATCH, ROWS):
                    d = kept(d, "reasoned")
        except Exception as e:  # noqa: BLE001  whatever a caller's reasoner raises concerns its own configs
            broken = F.struct(F.lit(type(e).__name__).alias("error_type"), F.lit(str(e).partition("\n")[0]).alias("message"))
            d = packets.select("request_id", *[F.lit(None).cast(t).alias(c) for c, t in zip(columns, ("array<string>", "double", "double"), strict=True)], broken.cast(ERROR).alias("error"))
        plan = F.array(*[F.struct(F.lit(r["name"]).alias("config"), F.lit(bool(r["evaluate"])).alias("scored"), _called(r["calls"] if "calls" in configs.columns and broken is None else None).alias("tool_calls")) for r in rows])
        d = d.select("*", F.explode(plan).alias("c"))
        calls = F.when(F.col("error").isNull(), F.col("c.tool_calls"))
        d = d.select("request_id", "c.config", "steps", "confidence", F.when(F.col("c.scored"), F.col("overall_score")).alias("overall_score"), calls.alias("tool_calls"), "error")
        out = d if out is None else out.unionByName(d)
    return out


def _called(calls) -> Column:
    """A config's own tool calls as a column: known tools in order, null where none are asked for."""
    kind = "array<struct<name:string,input:string,output:string>>"
    if calls is None:
        return F.lit(None).cast(kind)
    known = [c for c in calls if c["name"] in scoring.TOOLS]
    done = [F.struct(F.lit(c["name"]).alias("name"), F.lit(c["input"]).alias("input"), scoring.TOOLS[c["name"]](F.lit(c["input"])).cast("string").alias("output")) for c in known]
    return (F.array(*done) if done else F.array()).cast(kind)


def concept_motifs(spans: DataFrame, embed: Callable[[DataFrame], DataFrame], eps: float, min_confidence: float = 0.5, max_depth: int | None = None) -> DataFrame:
    """Scored role spans (span_text, role, confidence) to motifs of their concept graph. embed adds an embedding to (id, term)."""
    terms = extract.concept_spans(spans).select(F.explode(key_terms(F.col("span_text"))).alias("term"))
    items = embed(extract.distinct_terms(terms)).withColumn("pos", F.split("id", "_")[1].cast("int"))
    items = items.join(clusters.threshold_clusters(items.select(F.col("pos").alias("id"), "embedding"), eps).withColumnRenamed("id", "_i"), F.col("pos") == F.col("_i"))
    c = clusters.summarise(items.withColumn("text", F.col("term")).withColumn("probability", F.lit(1.0)))
    g = graph.concept_graph(c, items.select("id", F.col("term").alias("text")), "concepts")
    nodes = g.nodes.withColumn("node_pos", F.split("id", "_")[1].cast("long"))
    return motifs.all_motifs(graph.Graph("concepts", nodes, g.edges), min_confidence, max_depth)
