"""The pipeline deals texts to other tasks no more often than a stage needs."""

import re

from pyspark.sql import functions as F


def own_class(docs):
    return docs.select("doc_id", F.lit(1).alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))


def test_near_dedup_deals_texts_once(spark, monkeypatch, capsys):
    import corpus_pipeline as p

    monkeypatch.setattr(p, "near_duplicates", own_class)
    row = lambda i: (i, f"text {i} " * 5, "en", None if i % 2 else "s", i)
    data = [row(i) for i in range(20_000)]
    rows = data + data[:3] + [(4, data[4][1], None, "s", 4), (4, data[4][1], None, "s", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")  # as if the keys of one row were too many to be sent
    try:
        kept = p.near_dedup(spark, docs, "")
        kept.explain("formatted")
        plan = capsys.readouterr().out
        got = sorted((tuple(r) for r in kept.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Nulls come first, so of the rows of id 4 the one without a language stays.
    assert got == sorted([x for x in data if x[0] != 4] + [rows[-1]], key=str)
    assert len(re.findall(r"\) Exchange\nInput +\[\d+\]: \[[^\]]*\btext#", plan)) == 1
    assert "SortMergeJoin" in plan
