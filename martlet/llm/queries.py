"""The registered queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlet.llm import sql
from martlet.llm.divergence import divergence
from martlet.llm.embeddings import near_vectors
from martlet.llm.html_text import extract_text
from martlet.llm.licenses import scan_licenses
from martlet.llm.minhash import near_duplicates
from martlet.llm.mixing import mix
from martlet.llm.quality_rules import quality_rules, words_of
from martlet.llm.sentencepieces import code_pieces
from martlet.llm.substrings import remove_repeats
from martlet.llm.token_counts import token_counts
from martlet.llm.token_files import read_tokens, write_tokens
from martlet.llm.warc import archive
from martlet.llm.whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_read(spark, sf_dir, "pages").select("page_id", "html")).withColumn("n_chars", F.length("text").cast("long"))


def op3_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"), width=2)


def op4_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages have no time of capture; here each is captured a second after the page before it."""
    at = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return archive(_read(spark, sf_dir, "pages"), captured_at=at)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return code_pieces(_read(spark, sf_dir, "documents"), model).select("doc_id", "n_tokens", "n_differing", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))


def op7_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_read(spark, sf_dir, "embeddings"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"), window=35)
    words = F.array_join(words_of(F.coalesce("text", F.lit(""))), " ")
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_tokens(spark, manifest)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = whiten(_read(spark, sf_dir, "embeddings"), components=4, scale=256)
    each = rows.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "_of"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("_of.whitened").alias("whitened"), F.col("_of.explained").alias("explained"), "identity_error")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(_read(spark, sf_dir, "documents"), least=30, top=50, prior=5)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_html_text": op2_html_text,
    "op3_minhash_near_duplicates": op3_minhash_near_duplicates,
    "op4_warc_archives": op4_warc_archives,
    "op5_source_mix": op5_source_mix,
    "op6_sentencepieces": op6_sentencepieces,
    "op7_embedding_near_duplicates": op7_embedding_near_duplicates,
    "op8_token_counts": op8_token_counts,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_token_files": op10_token_files,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_source_divergence": op12_source_divergence,
    "op13_license_scan": op13_license_scan,
}

SQL: dict[str, str] = {
    "op1_quality_rules": sql.QUALITY_RULES,
    "op3_minhash_near_duplicates": sql.NEAR_DUPLICATES,
    "op4_warc_archives": sql.ARCHIVES,
    "op5_source_mix": sql.SOURCE_MIX,
    "op7_embedding_near_duplicates": sql.NEAR_VECTORS,
    "op9_substring_dedup": sql.SUBSTRINGS,
    "op12_source_divergence": sql.DIVERGENCE,
}
