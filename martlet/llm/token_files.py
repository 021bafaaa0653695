"""Token ids as flat binary files.

A data set is a folder of parts. Part k has `ids` (unsigned 16-bit integers where the vocabulary fits, else 32-bit, all
little-endian), `offsets` (n + 1 unsigned 64-bit positions within the part) and `docs` (signed 64-bit document ids). A
manifest has one row per part; a part's base is the sum of the ids of the parts before it.
"""

from __future__ import annotations

import json
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from martlet.llm import files
from martlet.llm.shared import new_path, table

#: Bytes of ids in a part, about; parts of words whose ids a Python worker remembers; texts and their bytes encoded at a time.
PART_BYTES, REMEMBERED, AT_ONCE, BYTES_AT_ONCE = 32 << 20, 900_000, 512, 16 << 20
#: Signs that the pattern never joins to a letter or digit before them (the apostrophe may be).
SIGNS = b".,;:!?*$#%&|<>()"
#: A character that stands between words when many are encoded at once.
DIVIDER = b"\x01"
#: Fixed value: the pattern of tokenizers whose texts may be encoded by word.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NO_ID = -(2**63)


def ends_in_letter(core: bytes) -> bool:
    """Whether the tokenizer's pattern, after its normaliser, cuts between this text and signs after it."""
    last = unicodedata.normalize("NFC", core[-4:].decode("utf-8", "ignore")[-1:].lower())[-1:]
    return last.isalpha() or last != "" and last in "0123456789"


def divided(words: pa.Array) -> pa.Array:
    """Two parts for each word: a core in lower case and the signs after it, where the tokenizer's pattern cuts there.

    Otherwise the first part is the word and the second empty. Words that may hold a special token keep their case.
    """
    special = pc.match_substring(words, "<|")
    low = pc.if_else(special, words, pc.ascii_lower(words)) if pc.any(special).as_py() else pc.ascii_lower(words)
    cores = pc.ascii_rtrim(low, characters=SIGNS.decode())
    bounds = np.frombuffer(low.buffers()[1], dtype=np.int32)[low.offset:low.offset + len(low) + 1]
    data = np.frombuffer(low.buffers()[2] or b"\0", dtype=np.uint8)
    full, length = np.diff(bounds), pc.binary_length(cores).to_numpy(zero_copy_only=False)
    may = (length > 0) & (length < full) & ~special.to_numpy(zero_copy_only=False)
    last = data[np.where(may, bounds[:-1] + length - 1, 0)]
    cut = may & ((last - ord("a") < 26) | (last - ord("0") < 10))  # unsigned, so lower bytes wrap
    for i in np.flatnonzero(may & (last >= 128)).tolist():
        cut[i] = ends_in_letter(data[bounds[i]:bounds[i] + length[i]][-4:].tobytes())
    ends = np.empty(2 * len(low) + 1, dtype=np.int32)
    ends[0::2], ends[1::2] = bounds, bounds[:-1] + np.where(cut, length, full)
    return pa.Array.from_buffers(pa.binary(), 2 * len(low), [None, pa.py_buffer(ends), low.buffers()[2]])


class WordEncoder:
    """Ids of texts by a tokenizer that lowers case and whose tokens never reach over ASCII white space.

    The parts of words are remembered; only those that are new to a worker are encoded. Other tokenizers encode whole texts.
    """

    def __init__(self, path: str, typecode: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.typecode, self.parts = Tokenizer.from_file(path), typecode, {}
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = [c.get("pattern", {}).get("Regex") for c in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and cuts[:1] == [WORD_PATTERN]
        divider = self.tokenizer.encode(DIVIDER.decode(), add_special_tokens=False).ids
        self.divider = divider[0] if len(divider) == 1 else None

    def _learn_each(self, words: list[bytes]) -> None:
        for w, e in zip(words, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)):
            self.parts[w] = array(self.typecode, e.ids).tobytes()

    def _learn(self, words: list[bytes]) -> None:
        """Many words in one call, told apart by the id of a character that none of them has."""
        for i in range(0, len(words), 1024):
            part = words[i:i + 1024]
            ids = np.array(self.tokenizer.encode_batch_fast([(b" " + DIVIDER + b" ").join(part).decode("utf-8", "replace")], add_special_tokens=False)[0].ids, dtype=self.typecode)
            ends = np.append(np.flatnonzero(ids == self.divider), len(ids)) * ids.itemsize
            data = ids.tobytes()
            starts = np.append(0, ends[:-1] + ids.itemsize)
            for w, a, b in zip(part, starts.tolist(), ends.tolist(), strict=True):
                self.parts[w] = data[a:b]

    def _ids_of(self, parts: list[bytes]) -> list[bytes]:
        """The ids of different parts; only those that this worker does not remember are encoded."""
        found = list(map(self.parts.get, parts))
        new = [p for p, ids in zip(parts, found) if ids is None]
        if not new:
            return found
        if len(self.parts) + len(new) > REMEMBERED:
            self.parts.clear()
        self._learn_each([p for p in new if self.divider is None or DIVIDER in p])
        self._learn([p for p in new if self.divider is not None and DIVIDER not in p])
        learnt = map(self.parts.__getitem__, new)
        return [next(learnt) if ids is None else ids for ids in found]

    def encode(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """The ids of each text and `end`, in the machine's (little-endian) order.

        Texts are split, words divided and told apart, and parts replaced by their ids as arrays; Python handles each
        different part of a batch once.
        """
        texts = texts.fill_null("")
        if not self.by_word:
            found = self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
            return pa.array([array(self.typecode, e.ids).tobytes() + end for e in found], pa.binary())
        split = pc.ascii_split_whitespace(texts)
        stops = np.asarray(split.offsets)[1:] - split.offsets[0].as_py()
        words = split.flatten().dictionary_encode()
        parts = divided(words.dictionary).dictionary_encode()
        ids = self._ids_of(parts.dictionary.to_pylist())
        pairs = parts.indices.to_numpy(zero_copy_only=False).reshape(-1, 2)
        # The end is a part of its own after each text.
        order = np.insert(pairs[words.indices.to_numpy(zero_copy_only=False)].ravel(), 2 * stops, len(ids))
        placed = pa.array([*ids, end], pa.binary()).take(pa.array(order))
        bounds = np.frombuffer(placed.buffers()[1], dtype=np.int32)[:len(placed) + 1]
        starts = np.concatenate([bounds[:1], bounds[2 * stops + np.arange(1, len(stops) + 1)]])
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(starts), placed.buffers()[2]])


_ENCODERS: dict[tuple[str, str], WordEncoder] = {}


def encoder(path: str, typecode: str) -> WordEncoder:
    """One encoder per Python worker, kept between tasks."""
    return _ENCODERS.setdefault((path, typecode), None) or _ENCODERS.update({(path, typecode): WordEncoder(path, typecode)}) or _ENCODERS[path, typecode]


def encoded(docs: DataFrame, tokenizer: str, typecode: str, end_id: int | None) -> DataFrame:
    """doc_id, ids (binary) from doc_id, text."""
    end = array(typecode, [] if end_id is None else [end_id]).tobytes()

    def bounded(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        half = part.num_rows // 2
        if half and (part.num_rows > AT_ONCE or part.nbytes > BYTES_AT_ONCE):
            yield from bounded(part.slice(0, half))
            yield from bounded(part.slice(half))
        else:
            yield part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, typecode)
        for batch in batches:
            for part in bounded(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), own.encode(part.column(1), end)], names=["doc_id", "ids"])

    return docs.mapInArrow(run, "doc_id long, ids binary")


def write_tokens(docs: DataFrame, tokenizer: str, *, text: str = "text", doc_id: str = "doc_id", end_id: int | None = 1, folder: str | None = None) -> DataFrame:
    """Encode `docs` into files in ascending document id and return the manifest: part, path, dtype, n_docs, n_ids, base.

    Files have new names for each task attempt, and the manifest lists those of the attempts that count, so a lost
    executor leaves files that nothing reads.

    Defined results: null and empty texts have the end id only; rows without an id come first, as id -2^63; rows that
    repeat an id follow each other by their ids' hash; other columns are not read; an empty table gives no part.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    typecode = "H" if max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True), (end_id or 0) + 1) <= 1 << 16 else "I"
    width = array(typecode).itemsize
    folder = folder or new_path(spark, "tokens")
    files.make_folder(folder)
    rows = table(encoded(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), tokenizer, typecode, end_id)
                 .withColumn("tie", F.xxhash64("ids")), "encoded")
    total = rows.agg(F.sum(F.length("ids"))).first()[0] or 0
    parts = max(1, -(-total // PART_BYTES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, counts, docs_, out = f"{folder}/part-{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}", [np.zeros(1, dtype="<u8")], [], None
        for batch in batches:
            out = out or files.open_out(f"{path}.ids")
            for ids in batch.column(1):
                out.write(ids.as_buffer())
            lengths = np.fromiter((len(ids.as_buffer()) // width for ids in batch.column(1)), dtype="<u8", count=batch.num_rows)
            counts.append(lengths)
            docs_.append(batch.column(0).fill_null(NO_ID).to_numpy().astype("<i8"))
        if out:
            out.close()
            offsets = np.cumsum(np.concatenate(counts), dtype="<u8")
            for name, values in (("offsets", offsets), ("docs", np.concatenate(docs_))):
                with files.open_out(f"{path}.{name}") as file:
                    file.write(values.tobytes())
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "path": [path], "dtype": [f"<u{width}"], "n_docs": [len(offsets) - 1], "n_ids": [int(offsets[-1])]},
                                             schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("dtype", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    ordered = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "ids")
    manifest = table(ordered.mapInArrow(write, "part int, path string, dtype string, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start (over all parts), n_tokens, ids_crc32 (of the ids as 32-bit integers), read from the files of a manifest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, dtype, base in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids, offsets, docs = (files.array_of(f"{path}.{n}", t) for n, t in (("ids", dtype), ("offsets", "<u8"), ("docs", "<i8")))
                for i in range(0, len(docs), 4096):
                    at, own = offsets[i:i + 4097].astype(np.int64), np.asarray(docs[i:i + 4096])
                    sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at, at[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64(), mask=own == NO_ID), pa.array(at[:-1] + base), pa.array(np.diff(at)), pa.array(sums, pa.int64())],
                                                     names=["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = max(1, manifest.count())
    return manifest.select("path", "dtype", "base").repartition(parts, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
