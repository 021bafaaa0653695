"""Near-duplicate documents by MinHash with tensored tables.

A document has two collections of m sub-keys, each made of `rows` minhashes. Table (i, j) has sub-key i of the first and
j of the second collection as its key, so 2 m sub-keys give m^2 tables: two documents of similarity s meet in one with
probability (1 - (1 - s^rows)^m)^2, from 2 m rows minhashes. Meetings are verified on the full shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.llm import wordhash
from martlet.llm.components import components
from martlet.llm.shared import drop, table

#: Of (text, text) comparisons against one pivot, one task gets about this many.
PIVOT_SHARE = 2000
#: Members of a block, for what is left to compare after the pivots.
BLOCK = 256


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the `width`-word shingles of a text lower-cased in A-Z; a shorter text is one shingle."""
    words = wordhash.text_words(text, lower=True)
    return np.unique(wordhash.run_hashes(words, min(width, len(words)))) if len(words) else words


def fingerprint(shingle_set: np.ndarray) -> bytes:
    return hashlib.blake2b(shingle_set.tobytes(), digest_size=16).digest()


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 x intersection >= percent x union, for sorted distinct arrays that aren't empty."""
    if percent * max(len(a), len(b)) > 100 * min(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int(np.count_nonzero(b[at] == a))
    return 100 * common >= percent * (len(a) + len(b) - common)


class Sketch:
    """Sub-keys of shingle sets; the lowest bit of a sub-key tells its collection."""

    def __init__(self, m: int, rows: int) -> None:
        random = np.random.Generator(np.random.PCG64(7))
        self.m, self.rows = m, rows
        self.factors = random.integers(1, 2**64 - 1, 2 * m * rows, dtype=np.uint64) | np.uint64(1)
        self.salts = random.integers(1, 2**64 - 1, 2 * m, dtype=np.uint64)

    def keys(self, shingle_set: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factors), np.iinfo(np.uint64).max, dtype=np.uint64)
        for i in range(0, len(shingle_set), 2048):
            part = shingle_set[i:i + 2048, None] * self.factors
            part ^= part >> np.uint64(32)
            part *= np.uint64(0xD6E8FEB86659FD93)
            np.minimum(least, part.min(axis=0), out=least)
        keys = wordhash.run_hashes(wordhash.mix(least), self.rows)[::self.rows]
        return (wordhash.mix(keys ^ self.salts) & ~np.uint64(1)) | (np.arange(2 * self.m, dtype=np.uint64) // np.uint64(self.m))


def sketches(docs: DataFrame, width: int, m: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, mark (of the set, null if empty), keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(m, rows)
        for batch in batches:
            sizes, marks, keys = [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py(), width)
                sizes.append(len(found))
                marks.append(fingerprint(found) if len(found) else None)
                keys.append(sketch.keys(found).view(np.int64) if len(found) else np.empty(0, dtype=np.int64))
            offsets = np.cumsum([0, *map(len, keys)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys) if keys else np.empty(0, dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), lists], names=["doc_id", "n_shingles", "mark", "keys"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, mark binary, keys array<long>")


def _texts(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node, mark, text for the texts of `nodes` (node, mark)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [fingerprint(shingles(t.as_py(), width)) == m.as_py() for t, m in zip(batch.column(2), batch.column(1))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    joined = nodes.join(docs, F.col("node") == F.col("doc_id")).select("node", "mark", "text")
    return joined.mapInArrow(run, "node long, mark binary, text string").dropDuplicates(["node", "mark"])


def _verify(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (pivot, node) whose sets are similar.

    A pivot's pairs are dealt to as many groups as they need; each group gets the pivot's text once and the other texts
    in a stream, so a task holds two sets at a time, whatever a group's size.
    """
    groups = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / PIVOT_SHARE).cast("int").alias("n"))
    dealt = pairs.join(groups, "pivot").select("pivot", F.pmod(F.xxhash64("node"), F.col("n")).cast("int").alias("part"), F.lit(1).alias("other"), "node")
    own = groups.select("pivot", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"), F.lit(0).alias("other"), F.col("pivot").alias("node"))
    rows = dealt.unionByName(own).join(texts, "node").select("pivot", "part", "other", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            found = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
                pivot, part, other, node = row[:4]
                if group != (pivot, part):
                    group, held = (pivot, part), []
                mine = shingles(row[4].as_py(), width)
                if not other:
                    held.append(mine)
                elif any(similar(x, mine, percent) for x in held):
                    found.append((pivot, node))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return rows.repartition("pivot", "part").sortWithinPartitions("pivot", "part", "other", "node").mapInArrow(run, "a long, b long")


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of slices of the incidence matrix."""
    n, sizes = len(sets), [len(x) for x in sets]
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(n), sizes), count[column] > 1
    column, row = (np.cumsum(count > 1) - 1)[column[shared]], row[shared]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    total = np.zeros((n, n), dtype=np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
        i, j = np.searchsorted(column, [at, at + 8192])
        part = np.zeros((n, 8192), dtype=np.float32)
        part[row[i:j], column[i:j] - at] = 1
        total += part @ part.T
    return total.astype(np.int64)


def _compare(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between members of a cluster that are in different components and share a table.

    A cluster is dealt to blocks of about BLOCK members, and each pair of blocks is one group; texts meet in groups, and
    only links come out.
    """
    blocks = members.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n"))
    dealt = members.join(blocks, "cluster").withColumn("_own", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    dealt = dealt.join(texts, "node").withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("cluster", F.least("_own", "_with").alias("lo"), F.greatest("_own", "_with").alias("hi"), "_own", "node", "component", "_a", "_b", "text")

    def run(group: pa.Table) -> pa.Table:
        node, own, component = (group.column(c).to_numpy() for c in ("node", "_own", "component"))
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        found = ([], [])
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        keys = [[np.array(x.as_py(), dtype=np.int64) for x in group.column(c)] for c in ("_a", "_b")]
        meet = np.ones((len(left), len(right)), dtype=bool)
        for side in keys:
            values = {k: i for i, k in enumerate(np.unique(np.concatenate(side)).tolist())}
            marks = np.zeros((len(node), len(values)), dtype=np.float32)
            for i, x in enumerate(side):
                marks[i, [values[k] for k in x.tolist()]] = 1
            meet &= marks[left] @ marks[right].T > 0
        meet &= component[left][:, None] != component[right][None, :]
        if lo == hi:
            meet &= node[left][:, None] < node[right][None, :]
        x, y = np.nonzero(meet)
        if len(x):
            sets = [shingles(t.as_py(), width) for t in group.column("text")]
            size = np.array([len(s) for s in sets])
            a, b = left[x], right[y]
            near = percent * np.maximum(size[a], size[b]) <= 100 * np.minimum(size[a], size[b])
            a, b = a[near], b[near]
            if len(a) > 2000:
                common = _common(sets)[a, b]
                linked = 100 * common >= percent * (size[a] + size[b] - common)
            else:
                linked = np.array([similar(sets[i], sets[j], percent) for i, j in zip(a, b)], dtype=bool)
            found = (node[a[linked]], node[b[linked]])
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    return dealt.groupBy("cluster", "lo", "hi").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, width: int = 5, percent: int = 80, m: int = 16, rows: int = 3) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id reachable), kept (doc_id = component_id).

    Documents with the same set are one class, compared once, by the class's smallest id. A class takes part in a table
    only where another class has the same sub-key, so the m^2 keys are made for near-duplicates, not for the corpus. In
    each bucket all members are compared with one pivot (the member that shares most); then only members of different
    components are compared with each other. No bucket is emitted as all pairs.

    Defined results: a null or empty text has an empty set and is linked with nothing (component_id = doc_id); rows that
    repeat an id are one node; rows without an id are linked by none, and have no component and kept false unless their
    set equals another row's; other columns are not read; an empty table gives an empty one.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketched = table(sketches(docs, width, m, rows), "sketches")
    classes = sketched.filter("mark is not null").groupBy("mark").agg(F.min("doc_id").alias("node"))
    nodes = sketched.join(classes, "mark").filter("doc_id = node").select("node", "mark", "n_shingles", "keys").dropDuplicates(["node", "mark"])
    keys = nodes.select("node", "mark", "n_shingles", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    side = lambda bit: F.filter("keys", lambda k: k.bitwiseAND(F.lit(1)) == bit)
    meeting = keys.join(shared, "key").groupBy("node", "mark", "n_shingles").agg(F.collect_list("key").alias("keys"), F.sum("n").alias("weight"))
    meeting = meeting.withColumns({"_a": side(0), "_b": side(1)}).filter((F.size("_a") > 0) & (F.size("_b") > 0))
    meeting = table(meeting.select("node", "mark", "n_shingles", "weight", "_a", "_b"), "meeting")

    def cells(frame: DataFrame, *more: str) -> DataFrame:
        """One row for each node and table key."""
        one = frame.select("node", "n_shingles", "weight", "_b", *more, F.explode("_a").alias("_x"))
        one = one.select("node", "n_shingles", "weight", *more, "_x", F.explode("_b").alias("_y"))
        return one.select("node", "n_shingles", "weight", *more, F.xxhash64("_x", "_y").alias("cell"))

    def near_size(a: str, b: str):
        return percent * F.greatest(F.col(a), F.col(b)) <= 100 * F.least(F.col(a), F.col(b))

    texts = table(_texts(docs, meeting.select("node", "mark"), width), "texts").select("node", "text")
    rows_ = cells(meeting)
    pivots = rows_.groupBy("cell").agg(F.max(F.struct("weight", -F.col("node"), "n_shingles")).alias("p"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    pivots = pivots.select("cell", (-F.col("p.col2")).alias("pivot"), F.col("p.n_shingles").alias("pivot_size"))
    pairs = rows_.join(pivots, "cell").filter(F.col("node") != F.col("pivot")).filter(near_size("n_shingles", "pivot_size")).select("pivot", "node").distinct()
    links = table(_verify(pairs, texts, width, percent), "verified")
    found = components(links)

    # What is left: buckets whose members are in different components. Overlapping buckets are compared together.
    placed = meeting.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rest = cells(placed, "component")
    mixed = rest.groupBy("cell").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("cell")
    meets = table(rest.join(mixed.join(pivots, "cell"), "cell").filter(F.col("node") != F.col("pivot")).select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), "meets")
    more = table(_compare(placed.join(components(meets).withColumnRenamed("component", "cluster"), "node"), texts, width, percent), "compared")
    stars = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
    found = components(stars.union(more))
    out = sketched.join(classes, "mark", "left").join(found, "node", "left")
    out = out.withColumn("component_id", F.coalesce("component", "node", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
