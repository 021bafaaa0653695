"""SentencePiece models on the tokenizers library.

The model's protobuf is read field by field; normaliser, metaspace, scores (unigram) or merges (BPE), and byte fallback
are rebuilt from it. Pieces never hold a marker after another character (checked when the model is read), so a text is
encoded by its segments (marker runs with the word after them), each once per worker, in multithreaded batches. Each new
segment's ids are compared with the sentencepiece library's; the segments in which the two differ take the latter's ids.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
# Fixed values of the model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
REMEMBERED, AT_ONCE = 300_000, 256


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: an int for varints, else the bytes."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            i, shift = i + 1, shift + 7
            if data[i - 1] < 128:
                return value, i

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            size, at = {1: (8, at), 5: (4, at)}.get(key & 7) or varint(at)
            value, at = data[at:at + size], at + size
        yield key >> 3, value


class Model:
    """What a model file says: pieces [(text, score, type)], kind, charsmap, dummy_prefix, shrink, escape, unk."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        trainer = normaliser = b""
        for number, value in fields(data):
            if number == 1:
                own = dict(fields(value))
                self.pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, bytes(4)))[0], own.get(3, NORMAL)))
            elif number == 2:
                trainer = value
            elif number == 3:
                normaliser = value
        train, norm = dict(fields(trainer)), dict(fields(normaliser))
        self.kind, self.byte_fallback, self.suffix = train.get(3, UNIGRAM), bool(train.get(35, 0)), bool(train.get(24, 0))
        self.charsmap, self.dummy_prefix, self.shrink, self.escape = norm.get(2, b""), bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1))
        self.unk = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        #: Texts may be cut before each run of markers.
        self.separable = self.escape and not self.suffix and not any(re.search(f"[^{MARK}]{MARK}", p[0]) for p in self.pieces if p[2] in (NORMAL, USER))

    def tokenizer(self):
        """The tokenizers library's model, for normalised and marked text."""
        from tokenizers import AddedToken, Tokenizer, models

        if self.kind == UNIGRAM:
            made = models.Unigram([(t, s) for t, s, _ in self.pieces], unk_id=self.unk, byte_fallback=self.byte_fallback)
        elif self.kind == BPE:
            ids = {t: i for i, (t, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
            merges = [(-self.pieces[i][1], i, ids[t[:k]], ids[t[k:]], t[:k], t[k:]) for t, i in ids.items() for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids]
            made = models.BPE({t: i for i, (t, _, _) in enumerate(self.pieces)}, [m[4:] for m in sorted(merges)],
                              unk_token=self.pieces[self.unk][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            raise ValueError(f"model type {self.kind} is not supported")
        tokenizer = Tokenizer(made)
        tokenizer.add_tokens([AddedToken(t, normalized=False) for t, _, kind in self.pieces if kind == USER])
        return tokenizer

    def normaliser(self):
        from tokenizers import normalizers as n

        steps = [n.Precompiled(self.charsmap)] if self.charsmap else []
        return n.Sequence(steps)


class PieceEncoder:
    """Ids and texts of one model in a Python worker."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        with open(path, "rb") as file:
            self.model = Model(file.read())
        self.tokenizer, self.normaliser = self.model.tokenizer(), self.model.normaliser()
        self.peer = sentencepiece.SentencePieceProcessor(model_file=path)
        self.known: dict[str, tuple[bytes, int]] = {}
        self.cut = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        pieces = self.model.pieces
        self.bytes_of = [bytes([int(t[3:5], 16)]) if k == BYTE else b" \xe2\x81\x87 " if k == UNKNOWN else b"" if k == CONTROL else t.replace(MARK, " ").encode() for t, _, k in pieces]
        self.is_byte = np.array([k == BYTE for _, _, k in pieces])

    def prepare(self, text: str | None) -> str:
        """Normalised text with markers for blanks."""
        text = text or ""
        if self.model.charsmap:
            text = self.normaliser.normalize_str(text)
        if self.model.shrink:
            text = re.sub(" +", " ", text).strip(" ")
        if self.model.dummy_prefix and text:
            text = " " + text
        return text.replace(" ", MARK) if self.model.escape else text

    def _learn(self, segments: list[str]) -> None:
        for i in range(0, len(segments), 4096):
            part = segments[i:i + 4096]
            ours = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            for segment, ids, theirs in zip(part, ours, self._reference(part)):
                self.known[segment] = (array("i", ids).tobytes(), int(ids != theirs))

    def _reference(self, segments: list[str]) -> list[list[int]]:
        """The sentencepiece library's ids of segments of prepared text."""
        texts = [s.replace(MARK, " ") for s in segments]
        plain = [self.model.dummy_prefix and len(t) > 1 and t[0] == " " for t in texts]
        found = iter(self.peer.encode([t[1:] for t, p in zip(texts, plain) if p], num_threads=os.cpu_count() or 1))
        return [next(found) if p else self._inner(t) for t, p in zip(texts, plain)]

    def _inner(self, text: str) -> list[int]:
        """Ids of text in which no blank is put first: behind a character that is a piece of its own, which is taken off."""
        ids, lead = self.peer.encode("\n" + text), self.peer.encode("\n")
        return ids[len(lead):]

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, int]]:
        """Of each text: its ids as 32-bit integers, and how many of its segments the two libraries encode differently."""
        split = [self.cut.findall(p) if self.model.separable else [p] * bool(p) for p in map(self.prepare, texts)]
        new = {s for segments in split for s in segments if s not in self.known}
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = {s for segments in split for s in segments}
        self._learn(list(new))
        found = [[self.known[s] for s in segments] for segments in split]
        return [(b"".join([x[0] for x in f]), sum([x[1] for x in f])) for f in found]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: runs of byte pieces form characters, bad ones become U+FFFD each, and the dummy prefix goes."""
        data = b"".join([self.bytes_of[i] for i in ids.tolist()])
        if self.model.dummy_prefix and data.startswith(b" "):
            data = data[1:]
        return data.decode("utf-8", "replace")


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def encode_pieces(docs: DataFrame, model: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ids (array of int), n_tokens, n_differing (segments for which the sentencepiece library has other ids).

    Defined results: null and empty texts have no ids; whole texts of any length are encoded; repeated rows and rows without
    an id are encoded each; other columns are not read, whatever their names; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in batches:
            for i in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(i, AT_ONCE)
                found = own.encode(part.column(1).to_pylist())
                sizes = [len(x) // 4 for x, _ in found]
                values = np.frombuffer(b"".join([x for x, _ in found]), dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes], dtype=np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(sizes, pa.int64()), pa.array([n for _, n in found], pa.int64())], names=["doc_id", "ids", "n_tokens", "n_differing"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, n_differing long")


def decode_pieces(coded: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, n_differing, ids_crc32 (of the ids as little-endian 32-bit integers) and the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in batches:
            for i in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(i, AT_ONCE)
                ids = [np.asarray(x.values, dtype=np.int32) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array([own.decode(x) for x in ids], pa.string())],
                                                 names=["doc_id", "n_tokens", "n_differing", "ids_crc32", "text"])

    return coded.mapInArrow(run, "doc_id long, n_tokens long, n_differing long, ids_crc32 long, text string")


def code_pieces(docs: DataFrame, model: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """`decode_pieces` of `encode_pieces` in one pass, so a task has one Python worker and the ids stay in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in batches:
            for i in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(i, AT_ONCE)
                found = own.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(x) // 4 for x, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64()),
                    pa.array([zlib.crc32(x) for x, _ in found], pa.int64()), pa.array([own.decode(np.frombuffer(x, dtype=np.int32)) for x, _ in found], pa.string())],
                    names=["doc_id", "n_tokens", "n_differing", "ids_crc32", "text"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, "doc_id long, n_tokens long, n_differing long, ids_crc32 long, text string")
