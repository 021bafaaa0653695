"""License scans against exact counting of phrases and edit distances by dynamic programming."""

import random
import re

import pytest

from martlet.llm import queries
from martlet.llm.licenses import NOTICES, PHRASES, NoticeSearch, normal, scan_licenses

SCHEMA = "doc_id long, text string, n_words string, spans long, score string"


def word_list(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def base_of(text):
    words, found = word_list(text), []
    for label, phrase in PHRASES:
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i:i + len(p)] == p]
    return len(words), found


def least_edits(notice, text):
    """The fewest edits with which the notice occurs anywhere in the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(notice, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def damage(text, k, rand):
    for _ in range(k):
        i = rand.randrange(1, len(text) - 1)
        text = rand.choice([text[:i] + text[i + 1:], text[:i] + rand.choice("abcé ") + text[i:], text[:i] + rand.choice("xyz") + text[i + 1:]])
    return text


@pytest.mark.parametrize("seed", range(4))
def test_search_finds_every_notice_within_its_edits(seed):
    rand = random.Random(seed)
    filler = [w for _, n in NOTICES for w in n.split()] + ["ab", "é", "zz9"] * 5
    search = NoticeSearch(NOTICES, 0.1, 3)
    for _ in range(60):
        label, notice = rand.choice(NOTICES)
        text = normal((" ".join(rand.choices(filler, k=12)) + " " + damage(notice, rand.randrange(0, 6), rand) + " " + " ".join(rand.choices(filler, k=8))).encode())
        hits = search.find(text)
        within = {}
        for name, n, k, *_ in search.notices:
            edits = least_edits(n, text)
            if edits <= k:
                within[name] = min(edits / len(n), within.get(name, 1))
        assert {h.label for h in hits} <= set(within) and bool(hits) == bool(within)
        if within:
            assert min(h.edits / h.length for h in hits) == min(within.values())
        for h in hits:
            n = next(n for name, n, *_ in search.notices if name == h.label and len(n) == h.length and least_edits(n, text[h.start:h.end]) <= h.edits)
            assert abs(len(n) - (h.end - h.start)) <= h.edits
        assert all(a.end - 1 <= b.start + 1 for a, b in zip(hits, hits[1:]))


def test_scan(spark):
    rand = random.Random(9)
    texts = ["", None, "nothing here", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.\n", "cc by nc cc by nc cc by nc", "under-the/MIT\tlicense under the mit license",
             "Apache License, Version 2", "Licensed under the mit licenses", "Distributed under the Bost Software License, version 1.0", "ÜNDER the mit license",
             "licensed under the apache licence version 2 0", "x" * 300_000, "license " * 3000 + "under the mit license " * 500, "word " * 200_000 + "This work is licensed under the GNU General Public License, version 3.",
             *[" ".join(rand.choices(["cc", "by", "nc", "under", "the", "mit", "license", "apache", "version", "2", "é"], k=60)) for _ in range(60)]]
    rows = [(i, t, "clash", 1, "clash") for i, t in enumerate(texts)] + [(None, texts[3], "", 0, ""), (3, texts[3], "", 0, ""), (3, texts[3], "", 0, "")]
    got = scan_licenses(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    want = []
    for i, text, *_ in rows:
        n, found = base_of(text)
        starts = [at for at, _ in found]
        want.append((i, n, len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({name for _, name in found}))))
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        labels = set(filter(None, r.labels.split(",")))
        assert labels == set(filter(None, r.base_labels.split(","))) | {s.label for s in r.spans} and 0 <= r.score <= 1
        assert r.score == (1 if r.n_base else max((1 - s.edits / s.length for s in r.spans), default=0))
        assert all(0 <= s.first_word and s.first_word + s.n_words <= r.n_words for s in r.spans)
    of = {r.doc_id: r for r in got}
    assert of[9].labels == "boost-1" and of[11].labels == "apache-2" and of[14].labels == "gpl-3" and of[14].spans[0].first_word == 200_003 and of[14].spans[0].n_words == 9
    assert of[8].labels == "mit" and of[8].base_labels == "" and of[10].labels == "" and of[12].score == 0


def test_own_notices_and_no_rows(spark):
    table = spark.createDataFrame([(1, "The quick brown fox jumps over a lazy dog")], "doc_id int, text string")
    found = scan_licenses(table, notices=[("fox", "quick brown fix jumps over the lazy dog")], phrases=[("the", "the quick"), ("dog", "dog")], rate=0.15, most=4).first()
    assert (found.labels, found.base_labels, found.n_base, found.first_word, found.last_word) == ("dog,fox,the", "dog,the", 2, 0, 8)
    assert scan_licenses(table, notices=[], phrases=[]).first().score == 0
    assert scan_licenses(table.filter("doc_id > 5")).count() == 0


def test_query(spark):
    path = "/root/testdata/sf0.001"
    got = queries.op13_license_scan(spark, path)
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, found = base_of(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word) == (n, len(found), min((i for i, _ in found), default=None))
