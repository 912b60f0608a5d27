"""The registered queries of the training-data operators."""

import public_tokenizers
from pyspark.sql import functions as F

from recollect.llm.common import table, text_of


def op1_line_dedup(spark, sf_dir):
    from recollect.llm.lines import dedup_lines
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped",
                      F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_sharding(spark, sf_dir):
    from recollect.llm.sharding import assign
    keys = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text_of("text")) + 8).cast("long").alias("size"),
        F.crc32(text_of("text").cast("binary")).alias("text_crc32"))
    return assign(keys, shards=24, tied=True).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op2_packing(spark, sf_dir):
    from recollect.llm.packing import pack
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op4_suffix_dedup(spark, sf_dir):
    from recollect.llm.suffixes import remove_repeats
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_quality_rules(spark, sf_dir):
    from recollect.llm.quality import filter_quality
    return filter_quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("failed_rules", ",").alias("failed_rules"))


def op6_html_extraction(spark, sf_dir):
    from recollect.llm.html import extract_pages
    return extract_pages(table(spark, sf_dir, "pages"))


def op7_simhash(spark, sf_dir):
    from recollect.llm.simhash import near_groups
    return near_groups(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_top_k(spark, sf_dir):
    from recollect.llm.topk import top_k
    return top_k(table(spark, sf_dir, "embeddings"), k=10, every=100, scale=1024)


def op9_sentencepiece(spark, sf_dir):
    from recollect.llm.pieces import encode_docs
    return encode_docs(table(spark, sf_dir, "documents").select("doc_id", "text"),
                       public_tokenizers.path("piece_bpe_32k.model"))


def op10_language_id(spark, sf_dir):
    from recollect.llm.language import identify, is_held_out
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), docs.where(~is_held_out()))
    return out.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score", "accepted")


def op11_centroids(spark, sf_dir):
    from recollect.llm.centroids import cluster
    return cluster(table(spark, sf_dir, "embeddings"))


def op12_fingerprints(spark, sf_dir):
    from recollect.llm.multiset import edited_fingerprints
    return edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_whitening(spark, sf_dir):
    from recollect.llm.whitening import whiten
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_packing, op3_sharding, op4_suffix_dedup, op5_quality_rules, op6_html_extraction, op7_simhash,
    op8_top_k, op9_sentencepiece, op10_language_id, op11_centroids,
    op12_fingerprints, op13_whitening)}
