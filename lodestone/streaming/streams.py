"""The row-wise steps under Structured Streaming, and the upsert of traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.text import uuid5
from ..sources import traces
from ..sources.store import Store

NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def texts(spark: SparkSession, folder: str, **options) -> DataFrame:
    d = spark.readStream.options(**options).text(folder, wholetext=True)
    return d.select(F.col("value").alias("text"), F.concat(F.lit("text:"), F.col("_metadata.file_path")).alias("source"))


def judged(raw: DataFrame, ts) -> DataFrame:
    d = scoring.accept(raw).withColumn("request_id", uuid5(NAMESPACE, F.col("source"))).withColumn("ts", F.lit(ts).cast("timestamp"))
    return scoring.evaluate(scoring.reason(d))


def start(raw: DataFrame, ts, out: str, rejects: str, checkpoint: str):
    """New texts to traces (versions by batch) and rejects; stops when what is there has been read.

    A batch owns a folder in each, so one that is run again after a failure replaces what it wrote.
    """

    def each(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        good = batch.filter("error_code IS NULL")
        traces.build(good, ts).withColumn("seq", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{out}/batch={n}")
        batch.filter("error_code IS NOT NULL").select("source", "error_code", "actual_length").write.mode("overwrite").parquet(f"{rejects}/batch={n}")
        batch.unpersist()

    return judged(raw, ts).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert(traces_stream: DataFrame, store: Store, checkpoint: str, keep: str = "last", delay: str = "1 hour", every: int = 10):
    """A stream of traces into a store; stops when what is there has been read.

    keep="last": of a request the version of the latest created_at stays, in whatever order versions
    arrive; a batch's rows are appended under its number, and every so many batches the store is
    compacted. A batch that runs again after a failure appends the same versions again, which changes
    nothing. keep="first": of a request the first to arrive stays and those that follow it within the
    delay are dropped by a keyed state, which forgets a request once the watermark has passed it by the
    delay; after that it counts as new.
    """
    if keep not in ("last", "first"):
        raise ValueError("keep must be last or first")
    if keep == "first":
        traces_stream = traces_stream.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["request_id"])

    def each(batch: DataFrame, n: int) -> None:
        store.put(batch, n)
        if (n + 1) % every == 0:
            store.compact()

    return traces_stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
