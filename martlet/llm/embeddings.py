"""Near-duplicate embeddings by p-stable hashing of normalised vectors.

A table's key is made of `width` projections on Gaussian directions, shifted and cut to cells of size `cell`. For vectors
of cosine 0.98 (distance 0.2) one projection agrees with probability 0.90, so with 16 projections and 60 tables a pair is
missed with probability 5e-6. Pairs that meet are checked by their exact cosine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.llm import wordhash
from martlet.llm.components import components
from martlet.llm.shared import table

#: Rows of a block: each pair of blocks of a bucket is compared as one matrix product.
BLOCK = 512


def directions(dimension: int, tables: int, width: int, cell: float) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.Generator(np.random.PCG64([11, dimension]))
    return random.standard_normal((dimension, tables * width)), random.uniform(0, cell, tables * width)


def hashed(rows: DataFrame, tables: int, width: int, cell: float) -> DataFrame:
    """vec_id, label (a string), mark (of label and vector; null for vectors that link with nothing), unit, keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            marks, units, keys = [], [], []
            for label, vector in zip(batch.column(1), batch.column(2)):
                x = None
                if label.is_valid and vector.is_valid and len(vector) and not vector.values.null_count:
                    x = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    scale = np.abs(x).max()
                    x = x / scale if np.isfinite(scale) and scale > 0 else None
                if x is None or not np.isfinite(x).all():
                    marks.append(None), units.append(None), keys.append(np.empty(0, dtype=np.int64))
                    continue
                name = label.as_py().encode("utf-8", "surrogatepass")
                digest = hashlib.blake2b(len(name).to_bytes(8, "little") + name, digest_size=16)
                digest.update(vector.values.to_numpy(zero_copy_only=False).astype("<f8").tobytes())
                marks.append(digest.digest())
                x = x / np.sqrt(x @ x)
                if len(x) not in lines:
                    lines[len(x)] = directions(len(x), tables, width, cell)
                a, shift = lines[len(x)]
                cells = np.floor((x @ a + shift) / cell).astype(np.int64).view(np.uint64).reshape(tables, width)
                start = wordhash.mix(np.uint64(xxhash.xxh3_64_intdigest(name, seed=len(x))) + np.arange(tables, dtype=np.uint64))
                for i in range(width):
                    start = wordhash.mix(start * np.uint64(0xD1342543DE82EF95) + cells[:, i])
                units.append(x.astype("<f8").tobytes())
                keys.append(start.view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)], dtype=np.int32)), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, pa.binary()), pa.array(units, pa.binary()), lists], names=["vec_id", "label", "mark", "unit", "keys"])

    return rows.mapInArrow(run, "vec_id long, label string, mark binary, unit binary, keys array<long>")


def _compare(dealt: DataFrame, least: float) -> DataFrame:
    """(node, n, low) for each pair of blocks: the node's links found here (copies counted), and the least node it is joined to."""

    def run(group: pa.Table) -> pa.Table:
        node, own, copies = (group.column(c).to_numpy() for c in ("node", "own", "copies"))
        label = group.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        lo, hi, which = (group.column(c)[0].as_py() for c in ("lo", "hi", "at"))
        units = [np.frombuffer(x.as_py(), dtype="<f8") for x in group.column("unit")]
        size = np.array([len(u) for u in units])
        matrix = np.zeros((len(units), size.max()))
        for i, u in enumerate(units):
            matrix[i, :len(u)] = u
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        near = (matrix[left] @ matrix[right].T >= least) & (label[left][:, None] == label[right]) & (size[left][:, None] == size[right]) & (node[left][:, None] != node[right])
        x, y = np.nonzero(near)
        # A pair counts in the first of the tables in which it meets.
        keys = np.stack([np.asarray(k.values) for k in group.column("keys")])
        first = np.concatenate([[], *((keys[left[x[i:i + 65536]]] == keys[right[y[i:i + 65536]]]).argmax(axis=1) for i in range(0, len(x), 65536))])
        x, y = left[x[first == which]], right[y[first == which]]
        n = np.zeros(len(node), dtype=np.int64)
        np.add.at(n, x, copies[y])
        low = node.copy()
        if lo != hi:
            np.add.at(n, y, copies[x])
        while True:
            before = low.copy()
            np.minimum.at(low, x, low[y])
            np.minimum.at(low, y, low[x])
            if (low == before).all():
                break
        some = n > 0
        return pa.table({"node": pa.array(node[some]), "n": pa.array(n[some]), "low": pa.array(low[some])})

    return dealt.groupBy("key", "lo", "hi").applyInArrow(run, "node long, n long, low long")


def near_vectors(rows: DataFrame, vector: str = "embedding", label: str = "label", vec_id: str = "vec_id", *, least: float = 0.98,
                 tables: int = 60, width: int = 16, cell: float = 1.6) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (the smallest id reachable), kept (vec_id = component_id).

    Equal vectors of a label are one class and meet others once; n_links counts each copy. Only keys that two classes
    share are looked at. A bucket is dealt to blocks, and each pair of blocks is one group with a matrix product; a pair
    counts in the first table in which it meets, so pairs are never written out. Counting every link of a cluster is
    quadratic in the cluster by nature; the work is spread over block pairs.

    Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and null labels, link with
    nothing (n_links 0, component_id = vec_id); vectors of different lengths never link; labels are of any
    simple type and are told apart as texts; rows that repeat an id are one
    node; a class without any id is linked with nothing; other columns are not read; an empty table gives an empty one.
    """
    kind = rows.select(label).dtypes[0][1]
    name = (F.col(label) + F.lit(0).cast(kind) if kind in ("double", "float") else F.col(label)).cast("string")  # -0.0 is 0.0
    marked = table(hashed(rows.select(F.col(vec_id).cast("long").alias("vec_id"), name.alias("label"), F.col(vector)), tables, width, cell), "vectors")
    classes = marked.filter("mark is not null").groupBy("mark").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    classes = table(classes, "classes")
    nodes = marked.join(classes, "mark").filter("vec_id = node").dropDuplicates(["mark"]).select("mark", "node", "copies", "label", "unit", "keys")
    met = nodes.select("mark", F.posexplode("keys").alias("at", "key"))
    blocks = met.groupBy("key", "at").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    dealt = met.join(blocks, ["key", "at"]).withColumn("own", F.pmod(F.xxhash64("mark"), F.col("n")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.join(nodes, "mark").select("key", "at", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"), "own", "node", "copies", "label", "unit", "keys")
    found = table(_compare(dealt, least), "links")
    placed = components(found.select(F.col("node").alias("a"), F.col("low").alias("b")))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    out = marked.select("vec_id", "mark").join(classes, "mark", "left").join(counts, "node", "left").join(placed, "node", "left")
    component = F.coalesce("component", "node", "vec_id")
    links = F.coalesce("n", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    return out.select("vec_id", links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
