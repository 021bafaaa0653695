"""License scans: a fuzzy search for short notices.

A notice of m characters may be met with up to k edits. Cut into k + 1 pieces, one of them must stand in the text unchanged
(the pigeonhole principle), so an automaton of all pieces finds every place worth a look in one pass over the text. There
the regex library's matching with bounded errors verifies the notice, counts the edits and gives the span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases that are told exactly, with their labels.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

#: Sentences by which licenses are declared, as words.
NOTICES = (
    ("agpl-3", "licensed under the gnu affero general public license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("boost-1", "distributed under the boost software license version 1 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "waived all copyright and related or neighboring rights"),
    ("epl-2", "made available under the terms of the eclipse public license 2 0"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mit", "licensed under the mit license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

# Letters, digits and bytes of other characters stay, A-Z as a-z; all else separates words.
_WORDS = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
_BLANKS = re.compile(rb"  +")


def normal(data: bytes) -> str:
    """The words of a text, each with a blank before and after it."""
    return _BLANKS.sub(b" ", b" " + data.translate(_WORDS) + b" ").decode("utf-8", "replace")


@dataclass(frozen=True)
class Hit:
    """A notice found: characters start to end of the normal text, the edits, and the notice's length."""

    label: str
    start: int
    end: int
    edits: int
    length: int


class NoticeSearch:
    """Finds notices with at most rate x length edits, and no more than `most` (a failed match takes thrice as long for each)."""

    def __init__(self, notices: Sequence[tuple[str, str]], rate: float, most: int) -> None:
        self.notices, pieces = [], {}
        for label, words in notices:
            notice = f" {words} "
            k = min(most, int(len(notice) * rate))
            needs = [(c, notice.count(c)) for c in sorted(set(notice), key=lambda c: (-notice.count(c), c))]
            self.notices.append((label, notice, k, needs, regex.compile(f"(?b)(?:{regex.escape(notice)}){{e<={k}}}")))
            cuts = [len(notice) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(notice[a:b], []).append((len(self.notices) - 1, b))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.automaton.add_word(piece, uses)
        if pieces:
            self.automaton.make_automaton()

    def candidates(self, text: str) -> dict[int, list[int]]:
        """For each notice, where it would start for each of its pieces found, falling within 2 k characters taken once."""
        starts: dict[int, list[int]] = {}
        if self.notices:
            for end, uses in self.automaton.iter(text):
                for number, after in uses:
                    starts.setdefault(number, []).append(end + 1 - after)
        out = {}
        for number, found in starts.items():
            kept, reach = [], 2 * self.notices[number][2]
            for s in sorted(found):
                if not kept or s > kept[-1] + reach:
                    kept.append(s)
            out[number] = kept
        return out

    def find(self, text: str) -> list[Hit]:
        """The notices in a normal text, by place. Where notices overlap, that with the fewest edits for its length stays, then the longest."""
        hits = set()
        for number, starts in self.candidates(text).items():
            label, notice, k, needs, pattern = self.notices[number]
            for s in starts:
                # Of the pieces taken together the last may start 2 k later; each may be off by k.
                first, last = max(0, s - k), min(len(text), s + len(notice) + 3 * k)
                lacking = 0  # letters that the window has too few of: each takes an edit
                for letter, n in needs:
                    lacking += max(0, n - text.count(letter, first, last))
                    if lacking > k:
                        break
                else:
                    match = pattern.search(text, first, last)
                    if not match:
                        continue
                    hits.add(Hit(label, match.start(), match.end(), sum(match.fuzzy_counts), len(notice)))
        kept: list[Hit] = []
        taken = bytearray(len(text) if hits else 0)
        for hit in sorted(hits, key=lambda h: (h.edits / h.length, -h.length, h.label, h.start)):
            # Neighbouring notices share the blank between them.
            if not any(taken[hit.start + 1:hit.end - 1]):
                kept.append(hit)
                taken[hit.start + 1:hit.end - 1] = b"\1" * (hit.end - hit.start - 2)
        return sorted(kept, key=lambda h: h.start)


def phrase_places(text: str, phrases: Sequence[tuple[str, str]]) -> list[tuple[int, str]]:
    """(character, label) of every place where a phrase's words stand consecutively."""
    found = []
    for label, words in phrases:
        at = text.find(f" {words} ")
        while at >= 0:
            found.append((at, label))
            at = text.find(f" {words} ", at + 1)
    return found


_SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int32()), ("length", pa.int32())])


def scan_licenses(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES, rate: float = 0.1, most: int = 3) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    A word is a run of letters, digits and other than ASCII characters, lower-cased in A-Z. n_base counts the places of the
    exact phrases, first_word and last_word are their smallest and largest start (words from 0). spans are the notices found
    with at most rate x length edits, `most` at most: label, first word, words, edits and the notice's length. labels are those of both,
    distinct and sorted. score is 1 with a phrase, else the best 1 - edits / length, else 0.

    Defined results: a null or empty text has no words, no places (first_word and last_word null), empty labels and score 0;
    whole texts are searched, in time linear in their length and the candidates; repeated rows and rows without an id each
    give theirs; other columns are not read; an empty table gives an empty one.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = NoticeSearch(notices, rate, most)
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
            for data in batch.column(1):
                words = normal(data.as_py())
                base, hits = phrase_places(words, phrases), search.find(words)
                blanks = np.flatnonzero(np.frombuffer(words.encode("utf-32-le"), dtype="<u4") == 32) if base or hits else np.empty(0, dtype=np.int64)
                word = lambda at: int(np.searchsorted(blanks, at))
                starts = [word(at) for at, _ in base]
                names = {label for _, label in base}
                out["n_words"].append(words.count(" ") - 1)
                out["n_base"].append(len(base))
                out["first_word"].append(min(starts, default=None))
                out["last_word"].append(max(starts, default=None))
                out["base_labels"].append(",".join(sorted(names)))
                out["labels"].append(",".join(sorted(names | {h.label for h in hits})))
                out["score"].append(1.0 if base else max((1 - h.edits / h.length for h in hits), default=0.0))
                out["spans"].append([{"label": h.label, "first_word": max(0, word(h.start + 1) - 1), "n_words": max(1, word(h.end - 1) - word(h.start + 1) + 1), "edits": h.edits, "length": h.length} for h in hits])
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(_SPAN)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(out.values(), types))], names=["doc_id", *out])

    id_type = source.schema["doc_id"].dataType.simpleString()
    spans = "array<struct<label:string,first_word:bigint,n_words:bigint,edits:int,length:int>>"
    return source.mapInArrow(run, f"doc_id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {spans}")
