"""Removal of repeated passages, found by fixed-block anchors.

The index holds the non-overlapping `block`-word blocks of every text. Every rolling `block`-word window probes it. With
block = (window + 1) // 2 each `window`-word window covers exactly one block of its own text, so a window that occurs
twice covers a block that is met by another rolling window. Only such windows are extended: they are compared as wholes,
and neighbouring repeated windows join to maximal exact repeats.

Probes are by far the most rows. They travel as sorted distinct 5-byte values in one binary per task and hash range, each
at most twice, so a passage that a third of all documents share costs two values a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.llm import wordhash
from martlet.llm.shared import table

#: Words that a task gathers before it sends their hashes, and characters of text for each hash range.
GATHER, RANGE_CHARS = 1_000_000, 6_000_000
_SECOND = 0xA0761D6478BD642F


def mark_of(data: bytes) -> bytes:
    """128 bits that stand for a text's sequence of words."""
    return hashlib.blake2b(b" ".join(data.split()), digest_size=16).digest()


def _bits(docs: DataFrame, text: str) -> int:
    """Hash ranges as a power of two, in proportion to the corpus."""
    chars = docs.agg(F.sum(F.length(text)).cast("long")).first()[0] or 0
    return max(0, (chars // RANGE_CHARS).bit_length())


def _ranges(ordered: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(range, first, last) of the sorted hashes that share their upper bits."""
    at = np.searchsorted(ordered, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.empty(0, dtype=np.int64)
    edges = [0, *at.tolist(), len(ordered)]
    return ((k, i, j) for k, (i, j) in enumerate(zip(edges, edges[1:])) if i < j)


def _five_bytes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The 40 bits after the upper ones, as bytes."""
    return ((hashes << np.uint64(bits)) >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]


def _eight(data: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(data), dtype=np.uint8).reshape(-1, 5)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, :5] = raw
    return out.view("<u8").ravel()


def _anchors(docs: DataFrame, text: str, block: int, bits: int) -> DataFrame:
    """(mark, at): the blocks that rolling windows meet at least twice, their own text's window included."""

    def send(hashes: list[np.ndarray], marks: list[bytes]) -> pa.RecordBatch:
        values, count = np.unique(np.concatenate(hashes), return_counts=True)
        values = np.repeat(values, np.minimum(count, 2))
        at = [np.arange(0, len(h), block) for h in hashes]
        anchor = np.concatenate([h[i] for h, i in zip(hashes, at)])
        owner, start = np.repeat(np.arange(len(hashes)), [len(i) for i in at]), np.concatenate(at).astype("<i4")
        order = np.argsort(anchor, kind="stable")
        anchor, owner, start = anchor[order], owner[order], start[order]
        names = np.frombuffer(b"".join(marks), dtype="V16")
        rows = {k: [_five_bytes(values[i:j], bits).tobytes(), b"", b"", b""] for k, i, j in _ranges(values, bits)}
        for k, i, j in _ranges(anchor, bits):
            rows[k][1:] = _five_bytes(anchor[i:j], bits).tobytes(), names[owner[i:j]].tobytes(), start[i:j].tobytes()
        columns = list(zip(*rows.values()))
        return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["range", "probes", "anchors", "marks", "starts"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, marks, held = [], [], 0
        for batch in batches:
            for value in batch.column(0):
                data = (value.as_py() or "").encode("utf-8", "surrogatepass")
                words = wordhash.word_hashes(data, *wordhash.word_spans(data))
                if len(words) >= 2 * block - 1:
                    hashes.append(wordhash.run_hashes(words, block))
                    marks.append(mark_of(data))
                    held += len(words)
                if held >= GATHER:
                    yield send(hashes, marks)
                    hashes, marks, held = [], [], 0
        if hashes:
            yield send(hashes, marks)

    def meet(group: pa.Table) -> pa.Table:
        values, count = np.unique(_eight(group.column("probes").to_pylist()), return_counts=True)
        many = values[count > 1]
        anchor = _eight(group.column("anchors").to_pylist())
        names, start = (np.frombuffer(b"".join(group.column(c).to_pylist()), dtype=t) for c, t in (("marks", "V16"), ("starts", "<i4")))
        at = np.searchsorted(many, anchor)
        at[at == len(many)] = 0
        hit = many[at] == anchor if len(many) else np.zeros(len(anchor), dtype=bool)
        return pa.table({"mark": pa.array([x.tobytes() for x in names[hit]], pa.binary()), "at": pa.array(start[hit], pa.int32())})

    sent = docs.select(text).mapInArrow(probe, "range int, probes binary, anchors binary, marks binary, starts binary")
    return sent.groupBy("range").applyInArrow(meet, "mark binary, at int")


def _repeats(texts: DataFrame, window: int, block: int, bits: int) -> DataFrame:
    """(mark, starts): windows over anchors whose whole sequence starts anywhere else; texts has _mark, _at, text."""
    kind = np.dtype([("a", "<u8"), ("b", "<u8"), ("mark", "V16"), ("start", "<i4")])

    def send(parts: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(parts)
        rows = rows[np.argsort(rows["a"], kind="stable")]
        found = [(k, rows[i:j].tobytes()) for k, i, j in _ranges(rows["a"], bits)]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], names=["range", "rows"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for mark, at, value in zip(*batch.columns):
                data = value.as_py().encode("utf-8", "surrogatepass")
                spans = wordhash.word_spans(data)
                words, others = (wordhash.word_hashes(data, *spans, which) for which in (0, 1))
                last = len(words) - window
                anchors = np.array(at.as_py(), dtype=np.int64)
                start = np.unique(anchors[:, None] - np.arange(window - block + 1)[None, :])
                start = start[(start >= 0) & (start <= last)]
                rows = np.empty(len(start), dtype=kind)
                rows["a"], rows["b"] = wordhash.run_hashes(words, window)[start], wordhash.run_hashes(others, window, _SECOND)[start]
                rows["mark"], rows["start"] = np.frombuffer(mark.as_py(), dtype="V16")[0], start
                parts.append(rows)
                held += len(rows)
                if held >= GATHER // 4:
                    yield send(parts)
                    parts, held = [], 0
        if held:
            yield send(parts)

    def meet(group: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(group.column("rows").to_pylist()), dtype=kind)
        name = np.ascontiguousarray(rows["mark"]).view("<u8").reshape(-1, 2)
        rows, name = (x[np.lexsort((rows["start"], name[:, 0], name[:, 1], rows["b"], rows["a"]))] for x in (rows, name))
        same = (rows["a"][1:] == rows["a"][:-1]) & (rows["b"][1:] == rows["b"][:-1])
        again = same & (rows["start"][1:] == rows["start"][:-1]) & (name[1:] == name[:-1]).all(axis=1)  # copies of a text send the same rows
        fresh = np.concatenate([[True], ~again])
        rows = rows[fresh]
        same = (rows["a"][1:] == rows["a"][:-1]) & (rows["b"][1:] == rows["b"][:-1])
        twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        rows = rows[twice]
        return pa.table({"mark": pa.array([x.tobytes() for x in rows["mark"]], pa.binary()), "start": pa.array(rows["start"], pa.int32())})

    sent = texts.select("_mark", "_at", "_text").mapInArrow(extend, "range int, rows binary")
    return sent.groupBy("range").applyInArrow(meet, "mark binary, start int")


def remove_repeats(docs: DataFrame, text: str = "text", *, window: int = 35) -> DataFrame:
    """`docs` with each word cut from its text that a repeated window covers, and n_words, n_removed.

    A window of `window` consecutive words is repeated if its sequence also starts anywhere else, in the same document or
    another; windows are judged on the input. A cut takes a run of words and the white space within it; other texts stay
    as they are. Texts with equal words (copies) are compared once, and wholly repeated.

    Defined results: a null text has no words and stays null; texts under `window` words stay; repeated rows are copies;
    ids are not read; other columns pass, unless they are named n_words or n_removed; an empty table gives an empty one.
    """
    block = (window + 1) // 2
    names = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    docs = docs.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])  # so no name clashes with one used here
    text = f"c{names.index(text)}"
    columns = [c for c in docs.columns if c != text]
    bits = _bits(docs, text)
    anchors = _anchors(docs, text, block, bits).groupBy("mark").agg(F.collect_set("at").alias("_at"))
    anchors = table(anchors.withColumnRenamed("mark", "_key"), "anchors")

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([mark_of(x) for x in data], pa.binary()), pa.array([len(x.split()) for x in data], pa.int64())], names=[*batch.schema.names, "_mark", "n_words"])

    rows = docs.select(*columns, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    rows = rows.mapInArrow(marked, f"{kinds}, _mark binary, n_words long")
    rows = table(rows.join(anchors, F.col("_mark") == F.col("_key"), "left").drop("_key"), "anchored")
    hit = rows.filter("_at is not null")
    starts = _repeats(hit, window, block, bits).groupBy("mark").agg(F.collect_list("start").alias("_starts"))
    copies = hit.groupBy(F.col("_mark").alias("_m")).agg((F.count(F.lit(1)) > 1).alias("_copied"))
    verdicts = table(copies.join(starts, F.col("_m") == F.col("mark"), "left").filter("_copied or mark is not null").drop("mark"), "repeats")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, value, copied, start = batch.columns
            texts, removed = [], []
            for t, whole, at in zip(value, copied, start):
                data = t.as_py().encode("utf-8", "surrogatepass") if t.is_valid else b""
                if not (whole.as_py() or at.is_valid):
                    texts.append(t.as_py())
                    removed.append(0)
                    continue
                first, last = wordhash.word_spans(data)
                delta = np.zeros(len(first) + 1, dtype=np.int64)
                if whole.as_py():
                    delta[0] = 1
                else:
                    np.add.at(delta, np.array(at.as_py(), dtype=np.int64), 1)
                    np.subtract.at(delta, np.array(at.as_py(), dtype=np.int64) + window, 1)
                gone = np.concatenate([[False], np.cumsum(delta)[:-1] > 0, [False]]).astype(np.int8)
                edge = np.diff(gone)
                bounds = [0, *np.column_stack([first[np.flatnonzero(edge == 1)], last[np.flatnonzero(edge == -1) - 1]]).ravel().tolist(), len(data)]
                texts.append(b"".join(data[i:j] for i, j in zip(bounds[::2], bounds[1::2])).decode("utf-8", "surrogatepass"))
                removed.append(int(gone.sum()))
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array(removed, pa.int64())], names=[*batch.schema.names[:-3], "_text", "n_removed"])

    passed = rows.filter("_at is null").select(*columns, "n_words", "_text", F.lit(0).cast("long").alias("n_removed"))
    judged = hit.join(verdicts, F.col("_mark") == F.col("_m"), "left").select(*columns, "n_words", "_text", "_copied", "_starts")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in passed.schema.fields)
    result = passed.unionByName(judged.mapInArrow(cut, kinds))
    return result.select(*[F.col("_text" if c == text else c).alias(name) for c, name in zip(docs.columns, names)], "n_words", "n_removed")
