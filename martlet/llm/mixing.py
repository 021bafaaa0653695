"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Each source's documents are shuffled by a hash of their id. Pass e of a document finishes at the virtual time
(e x source size + running size within the source) / target. All passes of all sources, ordered by that time and cut at
the total budget, are the mix: every source has then been served in proportion to its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from martlet.llm.quality_rules import words_of
from martlet.llm.shared import table

WEIGHTS = (5, 2, 1)
#: Slices of the unit interval of virtual time: at most this many rows are summed in one task.
TIME_SLICES = 1 << 14


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_passes: int = 3) -> DataFrame:
    """From (source, source_size), one row per source: adds `target`.

    Sources by code point, null last, take the weights in turn. Together they get `share` of all sizes. A source that
    would get more than `max_passes` times its size gets just that, and the others share the excess by weight: with
    sources ordered by size per weight, those that hit their limit are a prefix. One row per source: a summary table.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    everything = Window.partitionBy(F.lit(0))
    ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.lit(max_passes) * F.col("source_size")
    # What is left for this source and those after it, when all before it have got their limit.
    rest = F.floor(F.sum("source_size").over(everything) * F.lit(share)) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    ranked = sizes.withColumn("weight", weight).withColumn("_rest", rest).withColumn("_left", weight_left)
    capped = cap * F.col("_left") <= F.col("weight") * F.col("_rest")
    level = F.min(F.when(~capped, F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", "_rest", "_left"))).over(everything)
    ranked = ranked.withColumn("_capped", capped).withColumn("_level", level)
    shared = (F.col("weight") * F.col("_level._rest")).cast("double") / F.col("_level._left")
    return ranked.withColumn("target", F.when(F.col("_capped"), cap.cast("double")).otherwise(shared)).drop("_rest", "_left", "_capped", "_level")


def running_size(rows: DataFrame, slices: int) -> DataFrame:
    """Adds `_run`: the sum of `size` within the source up to and with this row, in hash order.

    Two levels: sums per (source, hash slice), a running total over a source's slices, and a window inside one slice only,
    so no task gets a whole source.
    """
    rows = rows.withColumn("_slice", F.pmod(F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long") * slices / F.lit(1 << 32), F.lit(slices)).cast("int"))
    by_slice = rows.groupBy("source", "_slice").agg(F.sum("size").alias("_sum"))
    upto = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    by_slice = by_slice.select(F.col("source").alias("_s"), F.col("_slice").alias("_k"), F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("source", "_slice").orderBy("_hash", "doc_id", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_in", F.sum("size").over(inside))
    return rows.join(by_slice, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_slice") == F.col("_k")), "left").withColumn(
        "_run", F.col("_in") + F.col("_before")).drop("_s", "_k", "_in", "_before", "_slice")


def last_taken(passes: DataFrame, budget: int) -> tuple | None:
    """The key (_time, _hash, _rank, doc_id, _tie) of the last pass that starts within the budget, in the order of that key.

    A range sort in two levels: fixed slices of virtual time are summed, and only the slice in which the budget ends is ordered.
    """
    key = ["_time", "_hash", "_rank", "doc_id", "_tie"]
    passes = passes.withColumn("_t", F.least(F.floor(F.col("_time") * (TIME_SLICES / 4.0)), F.lit(TIME_SLICES)).cast("int"))
    sums = passes.groupBy("_t").agg(F.sum("size").alias("_sum"))
    so_far = F.sum("_sum").over(Window.orderBy("_t")) - F.col("_sum")
    cut = sums.withColumn("_before", so_far).filter(F.col("_before") < budget).orderBy(F.desc("_t")).first()
    if cut is None:
        return None
    inside = passes.filter(F.col("_t") == cut["_t"]).groupBy(*key).agg(F.sum("size").alias("size"))
    start = F.sum("size").over(Window.orderBy(*key)) - F.col("size")
    return inside.withColumn("_start", start).filter(F.col("_start") < budget - cut["_before"]).orderBy(*[F.desc(k) for k in key]).select(*key).first()


def tie_of(text: Column, *more: Column) -> Column:
    """What tells rows of one id apart: a hash of the text, and of the other columns if there are any."""
    content = F.md5(F.coalesce(text, F.lit("")))
    return F.md5(F.concat(content, *[F.coalesce(F.md5(c.cast("string")), F.lit("-")) for c in more])) if more else content


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", *, weights: tuple[int, ...] = WEIGHTS,
        share: float = 1.0, max_passes: int = 3, slices: int = 1024, also: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, source, size (words), source_size, target, passes (how often the mix takes it), taken.

    Defined results: a null or empty text has size 0 and is never taken; a null source is one source, last in order; rows
    that repeat an id are told apart by their text and the columns `also`, and equal rows are both taken or both not, so the mix may pass its
    budget by copies of its last document; an empty table gives an empty one. Reruns agree: the shuffle is a hash of the id.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    rows = table(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.size(words_of(content)).cast("long").alias("size"),
                             F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).alias("_hash"), tie_of(F.col(text), *map(F.col, also)).alias("_tie")), "sizes")
    targets = table(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights=weights, share=share, max_passes=max_passes)
                    .withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumnRenamed("source", "_s"), "targets")
    rows = running_size(rows, slices).join(targets, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s", "weight")
    rows = table(rows.withColumn("_first", F.when(F.col("size") > 0, F.col("_run") / F.col("target"))), "queue")
    finish = lambda e: (F.col("source_size") * e + F.col("_run")) / F.col("target")
    passes = rows.filter("size > 0").select("size", "_hash", "_rank", "doc_id", "_tie", F.explode(F.array(*map(finish, range(max_passes)))).alias("_time"))
    budget = targets.agg(F.floor(F.coalesce(F.sum("source_size"), F.lit(0)) * F.lit(share)).cast("long")).first()[0]
    last = last_taken(passes, budget)

    def taken(e: int) -> Column:
        """Whether pass e is not after the last key, compared field by field."""
        fields = [(finish(e), last["_time"]), *((F.col(k), last[k]) for k in ("_hash", "_rank", "doc_id", "_tie"))]
        result = F.lit(True)
        for here, there in reversed(fields):
            same = here.eqNullSafe(F.lit(there))
            result = F.when(same, result).otherwise(F.coalesce(here < F.lit(there), F.lit(there is not None)))
        return result.cast("int")

    count = sum((taken(e) for e in range(max_passes)), F.lit(0)) if last else F.lit(0)
    return rows.withColumn("passes", F.when(F.col("size") > 0, count).otherwise(0)).withColumn("taken", F.col("size") * F.col("passes")).select(
        "doc_id", "source", "size", "source_size", "target", "passes", "taken", "_tie")
