"""Host-level quality rules, with DataFrame functions only.

Every document is judged by rules on its own text. The failures are then summed by host, each host's failure rate is
shrunk with a beta prior fitted to all hosts, and a host whose shrunk rate is too high takes all its documents with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.llm.shared import table

WHITE_SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: The most hosts that are broadcast to the documents (about 10 MB).
FEW_HOSTS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once per row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def repeated_words(words: Column, width: int) -> Column:
    """Words that lie in `width`-word windows found twice or more in the array, the first of them included.

    The windows' 64-bit hashes are sorted with their positions, so equal windows become neighbours; neighbours with
    equal hashes are compared word by word. Sorted start positions then give the covered words without a pass per word.
    """
    starts = F.sequence(F.lit(1), F.size(words) - (width - 1))
    windows = F.array_sort(F.transform(starts, lambda i: F.struct(F.xxhash64(F.slice(words, i, width)).alias("h"), i.alias("p"))))

    def twin(ordered: Column, item: Column, at: Column) -> Column:
        other = F.get(ordered, at)
        return F.coalesce((other["h"] == item["h"]) & (F.slice(words, other["p"], width) == F.slice(words, item["p"], width)), F.lit(False))

    def covered(ordered: Column) -> Column:
        marked = F.filter(ordered, lambda x, i: twin(ordered, x, i - 1) | twin(ordered, x, i + 1))
        positions = F.array_sort(F.transform(marked, lambda x: x["p"]))
        return let(positions, lambda at: F.aggregate(
            F.transform(at, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(at, i + 1) - p, F.lit(width)))), F.lit(0), lambda a, b: a + b))

    return F.when(F.size(words) > width, let(windows, covered)).otherwise(0).cast("long")


def free_name(rows: DataFrame, name: str) -> str:
    """A column name that rows do not have."""
    while name.lower() in {c.lower() for c in rows.columns}:
        name += "_"
    return name


def base_rules(docs: DataFrame, text: str = "text", *, min_words: int = 20, max_repeat_percent: int = 30, window: int = 8) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    A null text counts as one without words. Columns of these names are replaced.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    has_word = lambda line: F.length(F.translate(line, WHITE_SPACE, "")) > 0
    lines = F.filter(F.split(content, "\n", -1), has_word)
    rule = free_name(docs, "rule")
    return docs.withColumns({
        "word_chars": F.length(F.translate(content, WHITE_SPACE, "")).cast("long"),
        "n_symbols": (F.length(content) - F.length(F.translate(content, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        rule: let(words_of(content), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w, window).alias("r"))),
    }).withColumns({"n_words": F.col(f"{rule}.n"), "n_repeat_words": F.col(f"{rule}.r")}).drop(rule).withColumn(
        "base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))


def host_verdicts(judged: DataFrame, host: str = "source", *, max_rate: float = 0.5) -> DataFrame:
    """One row per host (`_host`; null is a host): n_docs, n_failed, shrunk_rate, host_failed.

    The beta prior has the mean of all documents. Its strength comes from the variance of the hosts' rates, weighted by
    documents, less what binomial sampling alone explains. Where nothing is left, every host gets the common rate.
    """
    hosts = judged.groupBy(F.col(host).alias("_host")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.sum("n_docs").alias("_n"), F.sum("n_failed").alias("_f"), F.count(F.lit(1)).alias("_h"), F.sum(rate * F.col("n_failed")).alias("_pf"))
    mean, noise = F.col("_f") / F.col("_n"), F.col("_h") / F.col("_n")
    prior = prior.withColumn("_mean", mean).withColumn("_between", F.col("_pf") / F.col("_n") - mean * mean - mean * (1 - mean) * noise)
    prior = prior.select("_mean", F.when(F.col("_between") > 0, F.greatest(F.col("_mean") * (1 - F.col("_mean")) / F.col("_between") - 1, F.lit(0.0))).alias("_strength"))
    mean, strength = prior.select("_mean").scalar(), prior.select("_strength").scalar()
    shrunk = F.coalesce((F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength), mean)
    return hosts.withColumn("shrunk_rate", shrunk).withColumn("host_failed", F.col("shrunk_rate") > max_rate)


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", *, max_rate: float = 0.5, **rules) -> DataFrame:
    """`docs` without its text but with the rules' counts, base_failed, the host's n_docs, n_failed, shrunk_rate and kept.

    Defined results: a null or empty text fails (no words); a null host is one host; repeated rows are judged each; other
    columns pass unless a result has their name; an empty table gives an empty one. The judged rows (no texts) are written
    to the shared folder once, and both the host sums and the join back read that table. Hosts are pre-aggregated before
    any shuffle. Up to FEW_HOSTS hosts, counted, are broadcast, so documents stay where they lie; with more, Spark chooses
    the join and splits hot hosts. Whole texts are judged, of any length.
    """
    judged = table(base_rules(docs, text, **rules).drop(text), "judged")
    key = free_name(judged, "host")
    hosts = table(host_verdicts(judged, host, max_rate=max_rate).withColumnRenamed("_host", key), "hosts")
    if hosts.count() <= FEW_HOSTS:
        hosts = F.broadcast(hosts)
    judged = judged.drop("n_docs", "n_failed", "shrunk_rate", "host_failed", "kept")
    return judged.join(hosts, F.col(host).eqNullSafe(F.col(key)), "left").withColumn(
        "kept", ~F.col("base_failed") & ~F.col("host_failed")).drop(key, "host_failed")
