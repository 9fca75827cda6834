"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, brown, conversations, images, licenses, mixing, quality_rules, ranked_search, repeats, secrets, simhash, token_counts, warc
from .common import shared_path, table
from .oracle import ORACLES


def ranks():
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op1_class_model(spark, sf_dir):
    return brown.score(table(spark, sf_dir, "documents"))


def op2_secret_scans(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"), carry=("doc_id",)).drop("_spans")


def op3_repeats(spark, sf_dir):
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op4_license_scans(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), ranks())


def op8_mixing(spark, sf_dir):
    p = mixing.planned(table(spark, sf_dir, "documents"))
    return p.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_warc(spark, sf_dir):
    path = shared_path(spark, "warc-archive")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path).drop("url")


def op10_image_copies(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return images.find_copies(vectors, "vec_id", "embedding", images.draw_vector, lambda i: i % 20 == 0, images.one_of_the_edits)


def op11_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), token_counts.read_merges(public_tokenizers.path("word_bpe_49k.json")))


def op12_ranked_search(spark, sf_dir):
    return ranked_search.search(ranked_search.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_conversation_repair(spark, sf_dir):
    return conversations.summary(conversations.repair(conversations.damage(table(spark, sf_dir, "conversations"))), table(spark, sf_dir, "conversations"))


QUERIES = (
    op1_class_model, op2_secret_scans, op3_repeats, op4_license_scans, op5_quality_rules, op6_simhash, op7_byte_bpe, op8_mixing, op9_warc, op10_image_copies,
    op11_token_counts, op12_ranked_search, op13_conversation_repair,
)


def queries():
    return {f.__name__: f for f in QUERIES}


def oracle_sql():
    return dict(ORACLES)
