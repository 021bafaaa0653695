"""Token totals, quantiles and truncated totals for every context limit, from one exact histogram of lengths."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from martlet.llm.shared import table

#: Lengths of one window: the sums of longer blocks are added to it.
BLOCK = 4096

_ENCODINGS: dict[tuple[str, str], object] = {}


#: White space too long for the pattern.
LONG_BLANK = regex.compile(r"\p{White_Space}{10000,}")


def encoding(path: str, pattern: str):
    """One encoding per Python worker."""
    import tiktoken

    if (path, pattern) not in _ENCODINGS:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        _ENCODINGS[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path, pattern]


def encoded_length(own, text: str) -> int:
    """Tokens of a text. A long run of white space is a piece of its own but for its last character (with all of it at the end
    of the text); such runs are encoded as pieces, since the pattern's engine cannot take them, and the rest on its own."""
    total, start = 0, 0
    for run in LONG_BLANK.finditer(text):
        end = run.end() - (run.end() < len(text))
        total += len(own.encode_ordinary(text[start:run.start()])) + len(own._encode_single_piece(text[run.start():end]))
        start = end
    return total + len(own.encode_ordinary(text[start:]))


def token_lengths(docs: DataFrame, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """(length, n): the histogram of encoded lengths of each batch. Null and empty texts have length 0.

    Whole texts are encoded, of any length; the pattern must cut white space as the public one does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(ranks, pattern)
        for batch in batches:
            lengths = pa.array([encoded_length(own, x.as_py() or "") for x in batch.column(0)], pa.int64())
            counts = pc.value_counts(lengths)
            yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], names=["length", "n"])

    return docs.select(F.col(text)).mapInArrow(run, "length long, n long")


def context_totals(lengths: DataFrame) -> DataFrame:
    """One row per occurring length, from (length, n): what a context limit of that length means for all documents.

    n_docs, n_longer, n_tokens (all documents' tokens), truncated_tokens (with each document cut at the limit) and
    share_within (of documents no longer: the quantile that the length is). Between two occurring lengths the truncated
    total is linear, with slope n_longer of the lower one, so the rows answer every limit. Suffix sums run in two levels:
    over blocks of lengths, and within a block. Repeated and tied lengths are summed; an empty table gives no row.
    """
    histogram = lengths.groupBy("length").agg(F.sum("n").alias("n_docs")).withColumn("_block", F.floor(F.col("length") / BLOCK))
    blocks = histogram.groupBy("_block").agg(F.sum("n_docs").alias("_n"), F.sum(F.col("n_docs") * F.col("length")).alias("_t"))
    after = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    blocks = blocks.select(F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(after), F.lit(0)).alias("_n_after"), F.coalesce(F.sum("_t").over(after), F.lit(0)).alias("_t_after"),
                           F.sum("_n").over(every).alias("_all"), F.sum("_t").over(every).alias("n_tokens"))
    longer = Window.partitionBy("_block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    rows = histogram.withColumns({"_n_in": F.coalesce(F.sum("n_docs").over(longer), F.lit(0)), "_t_in": F.coalesce(F.sum(F.col("n_docs") * F.col("length")).over(longer), F.lit(0))})
    rows = rows.join(blocks, F.col("_block") == F.col("_b")).withColumn("n_longer", F.col("_n_in") + F.col("_n_after"))
    truncated = F.col("n_tokens") - (F.col("_t_in") + F.col("_t_after")) + F.col("n_longer") * F.col("length")
    return rows.select("length", "n_docs", "n_longer", "n_tokens", truncated.alias("truncated_tokens"), ((F.col("_all") - F.col("n_longer")) / F.col("_all")).alias("share_within"))


def token_counts(docs: DataFrame, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """`context_totals` of a table's texts; other columns are not read. The histogram is written, so texts are encoded once."""
    histogram = token_lengths(docs, ranks, pattern, text).groupBy("length").agg(F.sum("n").alias("n"))
    return context_totals(table(histogram, "lengths"))
