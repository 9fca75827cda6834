"""Traces as tables: append, read the last version, look up, scan, clear, JSON both ways, replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scoring import SCORES
from ..functions.text import iso

EVALUATION = "struct<" + ",".join(f"{s}:double" for s in SCORES) + ">"
SCHEMA = (
    "request_id string, input struct<text:string,request_id:string,timestamp:string,source:string>, "
    f"reasoning struct<reasoning_steps:array<string>,confidence_score:double>, evaluation {EVALUATION}, "
    "tool_calls array<struct<name:string,input:string,output:string>>, created_at timestamp"
)


def build(results: DataFrame, created_at) -> DataFrame:
    """results (request_id, text, source, ts, steps, confidence, and maybe the scores and tool_calls) to traces."""
    c = results.columns
    return results.select(
        "request_id",
        F.struct("text", "request_id", iso(F.col("ts")).alias("timestamp"), "source").alias("input"),
        F.struct(F.col("steps").alias("reasoning_steps"), F.col("confidence").alias("confidence_score")).alias("reasoning"),
        (F.struct(*SCORES) if "overall_score" in c else F.lit(None)).cast(EVALUATION).alias("evaluation"),
        (F.col("tool_calls") if "tool_calls" in c else F.lit(None)).cast("array<struct<name:string,input:string,output:string>>").alias("tool_calls"),
        F.lit(created_at).cast("timestamp").alias("created_at"),
    )


def store(traces: DataFrame, path: str, seq: int = 0) -> None:
    traces.withColumn("seq", F.lit(seq).cast("long")).repartitionByRange("request_id").sortWithinPartitions("request_id").write.mode("append").parquet(path)


def last_versions(d: DataFrame, keep_seq: bool = False) -> DataFrame:
    """The last version of each request: latest created_at, then largest seq, then the greatest of the rest, so that ties agree from run to run."""
    rest = [c for c in d.columns if c not in ("request_id", "created_at", "seq", "batch")]
    rest = [F.desc(F.to_json(F.struct(*rest)))] if rest else []
    w = W.partitionBy("request_id").orderBy(F.desc("created_at"), F.desc("seq"), *rest)
    return d.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k", *([] if keep_seq else ["seq", "batch"]))


def read(spark: SparkSession, path: str) -> DataFrame:
    return last_versions(spark.read.schema(SCHEMA + ", seq long").parquet(path))


def retrieve(spark: SparkSession, path: str, request_id: str) -> DataFrame:
    """The trace with the id; no row if there is none. The filter reaches the scan."""
    return last_versions(spark.read.schema(SCHEMA + ", seq long").parquet(path).filter(F.col("request_id") == request_id))


def list_all(traces: DataFrame) -> DataFrame:
    return traces.orderBy("created_at", "request_id")


def clear(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], SCHEMA + ", seq long").write.mode("overwrite").parquet(path)


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One trace a file (pretty-printed JSON) to traces and rejects (file, text). Not JSON, or a section of another type, rejects."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    d = from_json(raw)
    ok = F.col("trace.request_id").isNotNull() & F.col("trace.input").isNotNull() & F.col("trace.reasoning").isNotNull() & F.col("trace.created_at").isNotNull()
    return d.filter(ok).select("trace.*"), d.filter(~F.coalesce(ok, F.lit(False))).select("file", "value")


def from_json(raw: DataFrame) -> DataFrame:
    return raw.withColumn("trace", F.from_json("value", SCHEMA, {"mode": "PERMISSIVE"}))


def to_json(traces: DataFrame) -> DataFrame:
    body = F.struct("request_id", "input", "reasoning", iso(F.col("created_at")).alias("created_at"), "evaluation", "tool_calls")
    return traces.select("request_id", F.to_json(body, {"ignoreNullFields": "true"}).alias("value"))


def replay(traces: DataFrame) -> DataFrame:
    """One row per frame: request_id, frame_index, frame_type, content (JSON), in the order input, steps, evaluation, calls."""
    frame = lambda kind, body: F.struct(F.lit(kind).alias("frame_type"), F.to_json(body).alias("content"))
    none = F.array().cast("array<struct<frame_type:string,content:string>>")
    parts = (
        F.when(F.col("input").isNotNull(), F.array(frame("input", F.col("input")))),
        F.transform("reasoning.reasoning_steps", lambda s, i: frame("reasoning_step", F.struct(i.alias("step_index"), s.alias("step")))),
        F.when(F.col("evaluation").isNotNull(), F.array(frame("evaluation", F.col("evaluation")))),
        F.transform("tool_calls", lambda c, i: frame("tool_call", F.struct(i.alias("call_index"), c["name"].alias("name"), c["input"].alias("input"), c["output"].alias("output")))),
    )
    frames = F.concat(*[F.coalesce(p, none) for p in parts])
    return traces.select("request_id", F.posexplode(frames).alias("frame_index", "f")).select("request_id", "frame_index", "f.frame_type", "f.content")
