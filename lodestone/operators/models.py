"""Models over tables: role scores of sentences, embeddings of texts, annotations of documents. Rows that a model fails on stay, with an error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.plugins import Plugin, call
from .extract import error_record, role_scores, sentence_spans

#: What an annotator gives for each token of a text, in order.
TOKENS = "array<struct<text:string,lemma:string,pos:string,dep:string,head:int,idx:int>>"


def _failed(result: str, module: str, plugin: Plugin):
    return error_record(F.col(f"{result}.error.error_type"), F.col(f"{result}.error.message"), module, plugin.name)


def scored_spans(docs: DataFrame, scorer: Plugin, roles: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sentences of docs with their role: doc_id, k, span_text, start, end, role, confidence, provenance, error.

    The scorer gives a number for each of roles (array<double>); role is the first greatest, confidence
    its share by softmax, both made in Spark. No numbers: the first role, 0. provenance names the model,
    its roles and the strategy. Of a sentence that the scorer fails on, role and confidence are null and
    error says why. Null and blank texts have no sentences; rows of equal ids are scored each.
    """
    s = sentence_spans(docs, id_col, text_col).withColumn("_r", call(scorer, "span_text"))
    got = role_scores(F.col("_r.value"), roles)
    told = F.struct(F.lit(scorer.name).alias("model"), F.array(*[F.lit(r) for r in roles]).alias("role_vocab"), F.lit("softmax").alias("strategy"))
    s = s.withColumn("error", _failed("_r", "roles", scorer)).withColumn("_g", F.when(F.col("error").isNull(), got))
    return s.select("doc_id", "k", "span_text", "start", "end", "_g.role", "_g.confidence", told.alias("provenance"), "error")


def embedded(items: DataFrame, embedder: Plugin, text_col: str = "text") -> DataFrame:
    """items with embedding (null where the embedder fails) and error."""
    d = items.withColumn("_r", call(embedder, text_col))
    return d.withColumn("embedding", F.col("_r.value")).withColumn("error", _failed("_r", "embeddings", embedder)).drop("_r")


def annotated(docs: DataFrame, annotator: Plugin, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Tokens (doc_id, i, text, lemma, pos, dep, head, idx) of the texts, as relations() takes them, and (doc_id, error) of those that the annotator, of type TOKENS, fails on."""
    d = docs.select(F.col(id_col).alias("doc_id"), call(annotator, text_col).alias("_r"))
    tokens = d.select("doc_id", F.posexplode("_r.value").alias("i", "t")).select("doc_id", "i", "t.*")
    return tokens, d.filter("_r.error IS NOT NULL").select("doc_id", _failed("_r", "relations", annotator).alias("error"))
