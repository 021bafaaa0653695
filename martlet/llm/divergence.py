"""How the sources of a language differ in their words: an audit by a recount through minimal perfect hashes.

A first pass counts each term's documents exactly; the terms of enough documents are kept. They are dealt to shards, and each
shard gets a minimal perfect hash with its keys stored. In the second pass every task holds the shards and counts each kept
term's occurrences in dense arrays, one for each (lang, source), without a shuffle of terms. All arithmetic is exact.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martlet.llm import wordhash
from martlet.llm.perfect_hash import PerfectHash, hashes
from martlet.llm.shared import drop, table

#: Terms of a shard, about; bytes of the shards that are broadcast at once (more take more rounds over the documents).
SHARD_TERMS, ROUND_BYTES = 1 << 16, 32 << 20
#: A task passes its counts on when it holds so many terms (first pass) or bytes of dense arrays (second pass).
HELD_TERMS, HELD_BYTES = 400_000, 128 << 20
#: Terms and sources of a block in which sources are compared.
TERM_BLOCK, SOURCE_BLOCK = 4096, 256

#: On UTF-8 bytes lower-cased in A-Z, a term is a run of letters a-z and bytes of other characters.
_TERM, _OTHER, _PIECE = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]"), 1 << 20


def terms_of(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of about a megabyte of text."""
    data = data.translate(wordhash.LOWER)
    start = 0
    while start < len(data):
        end = len(data)
        if end - start > _PIECE:
            cut = _OTHER.search(data, start + _PIECE)
            end = cut.start() if cut else end
        yield _TERM.findall(data, start, end)
        start = end


def _texts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    given = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang, source, text)]
    return docs.select(given[0].alias("lang"), given[1].alias("source"), given[2].cast("binary").alias("text"))


def document_counts(texts: DataFrame) -> DataFrame:
    """(lang, term, n): in how many documents of its language each term occurs."""

    def rows(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counter in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counter), pa.string()), pa.array(list(counter), pa.binary()), pa.array(list(counter.values()), pa.int64())], names=["lang", "term", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(2)):
                counts.setdefault(lang, Counter()).update({t for part in terms_of(text.as_py()) for t in part})
                if sum(map(len, counts.values())) > HELD_TERMS:
                    yield from rows(counts)
                    counts = {}
        yield from rows(counts)

    return texts.mapInArrow(run, "lang string, term binary, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))


def shards_of(kept: DataFrame) -> DataFrame:
    """(lang, shard, bits, n, size, hash): the kept terms (lang, term, of) of each shard as a pickled perfect hash.

    `of` is the number of kept terms of the language. A shard is a range of the terms' hashes, 2^bits of them a language.
    """
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("of") / SHARD_TERMS))).cast("int")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.column(2).to_numpy().astype(np.uint64)
            shard = (hashes(batch.column(1).to_pylist()) >> np.uint64(32)) >> (np.uint64(32) - width)
            yield batch.append_column("shard", pa.array(shard.astype(np.int64)))

    def build(key: tuple, group: pa.Table) -> pa.Table:
        made = PerfectHash(group.column("term").to_pylist())
        data = pickle.dumps(made, protocol=5)
        return pa.table({"lang": [key[0].as_py()], "shard": pa.array([key[1].as_py()], pa.int64()), "bits": pa.array([group.column("bits")[0].as_py()], pa.int32()),
                         "n": pa.array([len(made)], pa.int64()), "size": pa.array([len(data)], pa.int64()), "hash": pa.array([data], pa.binary())})

    placed = kept.select("lang", "term", bits.alias("bits")).mapInArrow(place, "lang string, term binary, bits int, shard long")
    return placed.groupBy("lang", "shard").applyInArrow(build, "lang string, shard long, bits int, n long, size long, hash binary")


def _occurrences(texts: DataFrame, found: list, first: dict[tuple[str, int], int], start: dict[str, int], width: dict[str, int]) -> tuple[DataFrame, Broadcast]:
    """(lang, source, slot, n): occurrences of the terms of the shards `found`, counted in dense arrays; and the broadcast.

    `first` is the first slot of a shard; `start` and `width` are the first slot and the number of slots of a language here.
    """
    sent = texts.sparkSession.sparkContext.broadcast([(r["lang"], r["shard"], r["bits"], bytes(r["hash"])) for r in found])

    def rows(counts: dict[tuple[str, str], np.ndarray]) -> Iterator[pa.RecordBatch]:
        for (lang, source), dense in counts.items():
            at = np.flatnonzero(dense)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([source] * len(at), pa.string()), pa.array(at + start[lang]), pa.array(dense[at])], names=["lang", "source", "slot", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, tuple[int, dict[int, PerfectHash]]] = {}
        for lang, shard, bits, data in sent.value:
            shards.setdefault(lang, (bits, {}))[1][shard] = pickle.loads(data)
        counts: dict[tuple[str, str], np.ndarray] = {}

        def add(group: tuple[str, str], seen: Counter) -> None:
            bits, parts = shards[group[0]]
            words = list(seen)
            values, times = hashes(words), np.fromiter(seen.values(), dtype=np.int64, count=len(words))
            of = ((values >> np.uint64(32)) >> np.uint64(32 - bits)).astype(np.int64)
            for shard, made in parts.items():
                mine = np.flatnonzero(of == shard) if bits else np.arange(len(words))
                slot = made.find([words[i] for i in mine.tolist()], values[mine])
                dense = counts.setdefault(group, np.zeros(width[group[0]], dtype=np.int64))
                dense[slot[slot >= 0] + (first[group[0], shard] - start[group[0]])] += times[mine[slot >= 0]]

        for batch in batches:
            held: dict[tuple[str, str], Counter] = {}
            for *group, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if group[0] in shards:
                    seen = held.setdefault(tuple(group), Counter())
                    for part in terms_of(text.as_py()):
                        seen.update(part)
                        if len(seen) > HELD_TERMS:
                            add(tuple(group), seen)
                            seen.clear()
            for group, seen in held.items():
                add(group, seen)
                if sum(d.nbytes for d in counts.values()) > HELD_BYTES:
                    yield from rows(counts)
                    counts = {}
        yield from rows(counts)

    return texts.mapInArrow(run, "lang string, source string, slot long, n long").groupBy("lang", "source", "slot").agg(F.sum("n").alias("n")), sent


@dataclass(frozen=True)
class Recount:
    """groups (lang, source), kept (lang, of: its number of kept terms), terms (lang, slot, term) and counts (lang, source, slot, n); `written` are their tables."""

    groups: DataFrame
    kept: DataFrame
    terms: DataFrame
    counts: DataFrame
    written: tuple[DataFrame, ...]


def recount(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", *, least: int = 30) -> Recount:
    """Exact occurrences of the terms that at least `least` documents of their language hold, by language and source.

    The broadcast is bounded: shards are sent in rounds of ROUND_BYTES, each a pass over the documents, so more kept terms
    mean more passes and no greater broadcast. The driver gets a line for each shard and the hashes of one round.
    """
    texts = _texts(docs, text, lang, source)
    spark = docs.sparkSession
    groups = table(texts.select("lang", "source").distinct(), "groups")
    frequent = table(document_counts(texts).filter(F.col("n") >= least).select("lang", "term"), "frequent")
    kept = table(frequent.groupBy("lang").agg(F.count(F.lit(1)).alias("of")), "kept")
    shards = table(shards_of(frequent.join(kept, "lang")), "shards")
    drop(frequent)

    lines = shards.select("lang", "shard", "n", "size").orderBy("lang", "shard").collect()
    first, filled, rounds, room = {}, Counter(), [], 0
    for line in lines:
        first[line["lang"], line["shard"]] = filled[line["lang"]]
        filled[line["lang"]] += line["n"]
        if not rounds or room + line["size"] > ROUND_BYTES:
            rounds.append([])
            room = 0
        rounds[-1].append(line)
        room += line["size"]

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, shard, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                made = pickle.loads(data)
                slots = np.arange(len(made)) + first[name, shard]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(made), pa.string()), pa.array(slots), pa.array([made.key(i) for i in range(len(made))], pa.binary()).cast(pa.string())], names=["lang", "slot", "term"])

    terms = table(shards.select("lang", "shard", "hash").mapInArrow(named, "lang string, slot long, term string"), "terms")
    counted = []
    for lines in rounds:
        ends = (lines[0], lines[-1])
        of_round = shards.filter(F.struct("lang", "shard").between(*(F.struct(F.lit(e["lang"]).alias("lang"), F.lit(e["shard"]).cast("long").alias("shard")) for e in ends)))
        start, width = {}, Counter()
        for line in lines:
            start.setdefault(line["lang"], first[line["lang"], line["shard"]])
            width[line["lang"]] += line["n"]
        summed, sent = _occurrences(texts, of_round.select("lang", "shard", "bits", "hash").collect(), first, start, dict(width))
        counted.append(table(summed, "counts"))
        sent.destroy()
    drop(shards)
    counts = reduce(DataFrame.unionByName, counted or [spark.createDataFrame([], "lang string, source string, slot long, n long")])
    return Recount(groups, kept, terms, counts, (groups, kept, terms, *counted))


def _share(n: Column, total: Column) -> Column:
    """1 + floor(10^9 n / total) for whole numbers, in decimals."""
    return (F.lit(1) + F.call_function("div", n.cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)"), total.cast("decimal(20,0)"))).cast("long")


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """(lang, source, item, value): for each two sources of a language the sum over its kept terms of what their shares differ.

    groups has lang, source, of and none (the share of a term that does not occur), shares has lang, source, slot and p of
    those that occur. A language's terms and sources are dealt to blocks; each block of terms and pair of source blocks is one
    group with a dense matrix, whatever the language's size. The result has all pairs, as the audit asks.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("of") / TERM_BLOCK)).cast("int")
    sides = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / SOURCE_BLOCK).cast("int").alias("sides"))
    own = F.pmod(F.xxhash64("source"), F.col("sides")).cast("int")
    groups = groups.join(sides, "lang").withColumn("own", own)
    every = groups.select("lang", "source", "own", "sides", "of", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(-1).alias("at"), F.col("none").alias("p"))
    given = shares.join(groups.select("lang", "source", "own", "sides", "of"), ["lang", "source"])
    given = given.select("lang", "source", "own", "sides", "of", F.floor(F.col("slot") / TERM_BLOCK).cast("int").alias("block"), (F.col("slot") % TERM_BLOCK).cast("int").alias("at"), "p")
    dealt = every.unionByName(given).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    dealt = dealt.select("lang", "block", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"), "own", "source", "of", "at", "p")

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        lang, block, lo, hi = (k.as_py() for k in key)
        source, own, at, p = group.column("source").combine_chunks().dictionary_encode(), *(group.column(c).to_numpy() for c in ("own", "at", "p"))
        names, which = source.dictionary.to_pylist(), source.indices.to_numpy()
        side = np.zeros(len(names), dtype=np.int64)
        side[which] = own
        wide = max(0, min(TERM_BLOCK, group.column("of")[0].as_py() - block * TERM_BLOCK))
        shares = np.zeros((len(names), wide), dtype=np.int64)
        absent = at < 0
        shares[which[absent]] = p[absent, None]
        shares[which[~absent], at[~absent]] = p[~absent]
        left, right = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
        a, b, value = [], [], []
        for k, i in enumerate(left.tolist()):
            other = right[k + 1:] if lo == hi else right
            a += [names[i]] * len(other)
            b += [names[j] for j in other.tolist()]
            value += np.abs(shares[other] - shares[i]).sum(axis=1).tolist()
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "value": pa.array(value, pa.int64())})

    parts = dealt.groupBy("lang", "block", "lo", "hi").applyInArrow(compare, "lang string, a string, b string, value long")
    summed = parts.groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("value").alias("value"))
    both = summed.withColumn("of", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))))
    return both.select("lang", "of.source", "of.item", "value")


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", *, least: int = 30, top: int = 50, prior: int = 5) -> DataFrame:
    """(lang, source, part, item, value, rank): how far sources are apart, and the terms that mark a source.

    A group's share of a kept term is p = 1 + floor(10^9 (count + prior) / (N + prior V)), V the language's kept terms and N
    the group's occurrences of them. Part `pair` has every other source of the language with the summed difference of shares;
    part `term` the group's `top` occurring terms whose share most exceeds the language's. Ranks fall by value, then by item.

    Defined results: null text, lang and source are taken as empty strings; each row is a document, repeated or without an id; a group without
    terms has N = 0; a language without kept terms has pairs of value 0 and no terms; a language with one source has no
    pairs; texts of any length are read in pieces; other columns are not read; an empty table gives an empty one.
    """
    found = recount(docs, text, lang, source, least=least)
    totals = found.counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = found.groups.join(found.kept, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = groups.select("lang", "source", F.coalesce("of", F.lit(0)).alias("of"), F.coalesce("total", F.lit(0)).alias("total"))
    whole = lambda: F.greatest(F.col("total") + prior * F.col("of"), F.lit(1))
    groups = groups.withColumn("none", _share(F.lit(prior), whole()))
    shares = found.counts.join(groups.select("lang", "source", "of", "total"), ["lang", "source"]).select("lang", "source", "slot", _share(F.col("n") + prior, whole()).alias("p"))

    pairs = _pairs(groups, shares)
    rank = lambda: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank().alias("rank"))

    of_lang = groups.groupBy("lang").agg(F.max("of").alias("of"), F.sum("total").alias("total"))
    overall = found.counts.groupBy("lang", "slot").agg(F.sum("n").alias("n")).join(of_lang, "lang").select("lang", "slot", _share(F.col("n") + prior, whole()).alias("q"))
    above = shares.join(overall, ["lang", "slot"]).filter("p > q").join(found.terms, ["lang", "slot"]).select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    marks = above.withColumn("rank", rank()).filter(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    out = table(pairs.unionByName(marks), "divergence")
    drop(*found.written)
    return out
