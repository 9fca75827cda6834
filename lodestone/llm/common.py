"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space and the control characters 9 to 13.
SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"


#: Temporary folders of local sessions, by application.
_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
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


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's setting to delete what a job has shuffled as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str, clean: bool = False) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage and outlives executors. clean: what was shuffled for it goes when it is written; for plans that run only here."""
    spark = df.sparkSession
    path, before = shared_path(spark, name), spark.conf.get(CLEANUP, "false")
    try:
        spark.conf.set(CLEANUP, "true" if clean else before)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def trimmed(text: Column) -> Column:
    return F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(SPACE))


def words(trimmed_text: Column) -> Column:
    """The words of a text that trimmed() has made; no words for an empty one."""
    return F.when(trimmed_text == "", F.array().cast("array<string>")).otherwise(F.split(trimmed_text, SPACES))


def lower_ascii(text: Column) -> Column:
    """Lower-case A to Z only; lower() would also change other letters."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
