"""The corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from functools import reduce
from operator import and_

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlet.llm.minhash import near_duplicates
from martlet.llm.mixing import mix, tie_of
from martlet.llm.quality_rules import quality_rules
from martlet.llm.sentencepieces import code_pieces
from martlet.llm.shared import new_path, table
from martlet.llm.substrings import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules on their own text and on their source keep.

    A null text has no words and is rejected. Each row has its own verdict, whether it has an id, shares it or is repeated; the row passes through the operator.
    """
    judged = quality_rules(docs.select(*COLUMNS, F.col("text").alias("_text"))).filter("kept")
    return judged.withColumnRenamed("_text", "text").select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (shingles of five words, similarity 0.8): the one with the smallest id.

    A document is an id with a text, told from others by a 64-bit hash of both: texts that share an id, and texts without
    one, are judged each. In a group a row without an id comes last, and equal ids are ordered by that hash. Of rows with
    equal id and text one stays: the first by lang, source and n_chars, nulls first.
    """
    keyed = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("_key"))
    groups = near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("_key"), "component_id").distinct()
    # Rows are told apart by narrow columns; texts are read once more at the end and never are a key.
    first_row = F.min(F.struct("lang", "source", "n_chars"))
    keys = table(keyed.groupBy("_key", "doc_id").agg(F.count(F.lit(1)).alias("_n"), first_row.alias("_row")), "keys")
    first = keys.join(groups, "_key").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).alias("_first")).select("_first._key")
    stay = table(keys.join(first, "_key", "left_semi").select(F.col("_key").alias("_of"), "_n", "_row"), "stay")
    # Texts are dealt once, for keys of one row; the few keys of several rows are a table of their own, small enough to be sent to the texts.
    again = table(stay.filter("_n > 1"), "again")
    of = F.col("_key") == F.col("_of")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_row.{c}")) for c in ("lang", "source", "n_chars")])
    repeated = keyed.join(again, of & same).dropDuplicates(["_key"])
    return keyed.join(stay.filter("_n = 1"), of).select(COLUMNS).unionByName(repeated.select(COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 35 words or more that occur elsewhere too; a text of which nothing is left goes.

    Null texts and those without words have nothing to lose and go as well; texts under 35 words stay as they are.
    """
    cut = remove_repeats(docs).filter("n_removed < n_words")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, so sources have their target sizes.

    Rows without an id and rows that share one are taken each by their own count; equal rows all have the same. A text
    without words has no size and is never taken, so it goes. Texts are compared by their hashes, never as keys.
    """
    also = ("lang", "n_chars")
    taken = mix(docs, also=also).filter("passes > 0").groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("_tie").alias("_of")).agg(F.max("passes").cast("int").alias("_passes"))
    rows = docs.select(COLUMNS).withColumn("_tie", tie_of(F.col("text"), *map(F.col, also)))
    same = (F.col("_tie") == F.col("_of")) & F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source"))
    return rows.join(taken, same).withColumn("_pass", F.explode(F.sequence(F.lit(1), "_passes"))).select(COLUMNS)


def piece_codes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document encoded and decoded again: doc_id, n_tokens, n_differing, ids_crc32 and the decoded text.

    Every row gives one, repeated or without an id; a null text is coded as an empty one.
    """
    model = public_tokenizers.path("piece_bpe_32k.model")
    return code_pieces(docs, model).select("doc_id", "n_tokens", "n_differing", "ids_crc32", "text")


STAGES = [("quality_rules", quality), ("minhash_near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("source_mix", source_mix), ("sentencepieces", piece_codes)]

#: SQL has no SentencePiece encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
