"""Documents from files and page tables, with rejected rows instead of failed jobs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalise, strip

FORMATS = ("text", "pdf")


def literal(path: str) -> str:
    """A path whose characters all stand for themselves, for readers that take patterns."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


#: Spark's setting for the most tasks that list folders; by default nearly each folder is a task of its own.
LISTERS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def _few_listers(spark: SparkSession) -> Iterator[None]:
    """Folders are listed by four tasks a core; for reads that are resolved here."""
    before = spark.conf.get(LISTERS)
    try:
        spark.conf.set(LISTERS, min(int(before), 4 * spark.sparkContext.defaultParallelism))
        yield
    finally:
        spark.conf.set(LISTERS, before)


def file_names(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path) of all files under a folder, at any depth, whose names match pattern."""
    with _few_listers(spark):
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(literal(path)).select("path")


def read_texts(spark: SparkSession, *paths: str) -> DataFrame:
    """One row per file: path, content, metadata, error_type. A file that is not UTF-8 or is blank is a rejected row. Paths are taken literally; of a folder its files are read."""
    with _few_listers(spark):
        f = spark.read.format("binaryFile").load([literal(p) for p in paths])
    text = F.try_validate_utf8(F.col("content").cast("string"))
    d = f.select("path", normalise(text).alias("content"), text.isNull().alias("_bad"), F.create_map(F.lit("file_size"), F.col("length").cast("string"), F.lit("encoding"), F.lit("utf-8")).alias("metadata"))
    return d.withColumn("error_type", F.when(F.col("_bad"), "UnicodeDecodeError").when(F.col("content") == "", "EmptyDocument")).drop("_bad")


def assemble_pages(pages: DataFrame, doc_col: str, page_col: str, text_col: str) -> DataFrame:
    """Page texts to documents: doc, content (non-empty pages joined by a blank line), page_count, extracted_pages, error_type."""
    full = F.coalesce(F.col(text_col), F.lit("")) != ""
    parts = F.array_sort(F.collect_list(F.when(full, F.struct(F.col(page_col).alias("n"), F.col(text_col).alias("t")))))
    d = pages.groupBy(F.col(doc_col).alias("doc")).agg(strip(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n")).alias("content"), F.count("*").alias("page_count"), F.count_if(full).alias("extracted_pages"))
    return d.withColumn("error_type", F.when(F.col("content") == "", "EmptyDocument"))


def _key(path: str) -> Column:
    """A path without scheme, for comparison: readers give URIs with some characters escaped, a manifest names files as they are."""
    return F.regexp_replace(path, "^file:/*", "/")


def ingest(spark: SparkSession, manifest: DataFrame, corpus_id: str, pages: DataFrame | None = None, created_at=None) -> tuple[DataFrame, DataFrame]:
    """manifest (pos, path, format) to documents and failures. pages (path, page_no, text) stands for extracted PDF pages; without it a PDF is a failure.

    Each row of the manifest is in one of the two; a null path or format is a failure; repeated rows are
    ingested one by one. Names are taken literally, whatever characters they hold. Files are found by a
    listing of their folders that is joined with the manifest by path, so the driver holds the names
    of folders but of no file; contents are read in tasks, by folder, and joined last.
    """
    bad = manifest.filter(~F.coalesce(F.col("format").isin(*FORMATS), F.lit(False))).select("pos", "path", F.lit("UnsupportedFormat").alias("error_type"))
    wanted = manifest.filter("format = 'text'").withColumn("_key", _key("path"))
    folders = [r["f"] for r in wanted.select(F.regexp_replace("_key", "/[^/]*$", "").alias("f")).filter("f IS NOT NULL").distinct().collect()]
    texts = _texts(spark, folders)
    if texts is not None:
        texts = texts.withColumn("_key", _key("path")).drop("path")
        here = wanted.select(F.col("_key").alias("_w")).distinct()
        texts = texts.join(here, F.col("_key") == F.col("_w"), "left_semi")  # before anything else moves: other files of the folders go
        texts = wanted.join(texts, "_key", "left").drop("_key")
    else:
        nothing = {"content": F.lit(None).cast("string"), "metadata": F.lit(None).cast("map<string,string>"), "error_type": F.lit(None).cast("string")}
        texts = wanted.drop("_key").withColumns(nothing)
    texts = texts.withColumn("error_type", F.when(F.col("metadata").isNull(), "FileNotFound").otherwise(F.col("error_type")))
    if pages is None:
        pdf = manifest.filter("format = 'pdf'").select("*", F.lit(None).cast("string").alias("content"), F.lit(None).cast("map<string,string>").alias("metadata"), F.lit("NoPages").alias("error_type"))
    else:
        docs = assemble_pages(pages, "path", "page_no", "text").withColumnRenamed("doc", "path")
        docs = docs.withColumn("metadata", F.create_map(F.lit("page_count"), F.col("page_count").cast("string"), F.lit("extracted_pages"), F.col("extracted_pages").cast("string"))).drop("page_count", "extracted_pages")
        pdf = manifest.filter("format = 'pdf'").join(docs, "path", "left")
        pdf = pdf.withColumn("error_type", F.when(F.col("metadata").isNull(), "FileNotFound").otherwise(F.col("error_type")))
    found = texts.unionByName(pdf)
    good = found.filter("error_type IS NULL")
    good = good.select(F.sha1(F.concat_ws(":", F.lit(corpus_id), "path")).alias("document_id"), F.col("pos").cast("long").alias("doc_pos"), "content", F.col("path").alias("source"), "format", "metadata", F.lit(corpus_id).alias("corpus_id"), F.lit(created_at).cast("timestamp").alias("created_at"))
    return good, bad.unionByName(found.filter("error_type IS NOT NULL").select("pos", "path", "error_type"))


def _texts(spark: SparkSession, folders: list[str]) -> DataFrame | None:
    """The texts of the folders that are there, which are listed once; None if there are none. Only if one is missing, the others are looked for first."""
    from pyspark.errors import AnalysisException

    try:
        return read_texts(spark, *folders) if folders else None
    except AnalysisException:
        there = _existing(spark, folders)
        return read_texts(spark, *there) if there else None


def _existing(spark: SparkSession, folders: list[str]) -> list[str]:
    """The folders that are there, of some of which one is missing: halves are tried by themselves."""
    half = len(folders) // 2
    return _there(spark, folders[:half]) + _there(spark, folders[half:]) if half else []


def _there(spark: SparkSession, folders: list[str]) -> list[str]:
    from pyspark.errors import AnalysisException

    try:
        read_texts(spark, *folders)  # resolving checks the paths
        return folders
    except AnalysisException:
        return _existing(spark, folders)


def as_packets(documents: DataFrame) -> DataFrame:
    """Documents as raw inputs: text, and source as format:source."""
    return documents.select("*", F.col("content").alias("text"), F.concat_ws(":", "format", "source").alias("_s")).drop("source").withColumnRenamed("_s", "source")
