"""Tables written once to the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Temporary folders of local sessions, by application.
_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as spark.checkpoint.dir names it; in local mode, and only there, a temporary one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not re.match(r"local($|\[)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="lodestone-")
    return _own[context.applicationId]


#: Spark's setting to delete what a job has shuffled as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Parquet's settings for rows of megabytes: by default it looks at the size of pages and row groups only after 100 rows.
LARGE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1", "parquet.block.size": str(32 << 20)}

#: Settings for plans over such rows: a few rows of a file are read at once, and no side is broadcast, since packed files say little of what rows hold.
WITH_LARGE_ROWS = {"spark.sql.parquet.columnarReaderBatchSize": "8", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


def kept(df: DataFrame, name: str = "stage", lean: bool = False, large_rows: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and outlives executors. lean: for tables larger than the input, packed closer, and what was shuffled for one goes when it is written. large_rows: for rows of megabytes, to be read under WITH_LARGE_ROWS."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    write = df.write.options(**LARGE_ROWS) if large_rows else df.write
    if lean:
        with setting(spark, CLEANUP, "true"):
            write.option("compression", "zstd").parquet(path)
    else:
        write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Several settings at once."""
    with ExitStack() as stack:
        for key, value in values.items():
            stack.enter_context(setting(spark, key, value))
        yield


@contextmanager
def setting(spark: SparkSession, key: str, value) -> Iterator[None]:
    """A setting of the session while what is written here runs."""
    before = spark.conf.get(key, None)
    try:
        spark.conf.set(key, value)
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
