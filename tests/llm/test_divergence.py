"""The source audit against brute force; perfect hashes by their properties."""

import re
from collections import Counter

import pytest

from martlet.llm import divergence as module
from martlet.llm import perfect_hash
from martlet.llm.divergence import divergence, terms_of
from martlet.llm.perfect_hash import PerfectHash
from martlet.llm.wordhash import LOWER

SCHEMA = "doc_id long, text string, lang string, source string, term string, value long"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(rows, least, top, prior):
    rows = [(t, lang or "", source or "") for _, t, lang, source, *_ in rows]
    df, count = Counter(), Counter()
    for t, lang, source in rows:
        df.update({(lang, w) for w in terms(t)})
        count.update((lang, source, w) for w in terms(t))
    out, groups = [], sorted({(lang, s) for _, lang, s in rows})
    for lang in {g[0] for g in groups}:
        kept = sorted(w for (of, w), n in df.items() if of == lang and n >= least)
        sources = [s for of, s in groups if of == lang]
        shares = {}
        for name, members in [(None, sources), *((s, [s]) for s in sources)]:
            c = [sum(count[lang, s, w] for s in members) for w in kept]
            shares[name] = [1 + 10**9 * (x + prior) // (sum(c) + prior * len(kept)) for x in c]
        for a in sources:
            pairs = [(b, sum(abs(x - y) for x, y in zip(shares[a], shares[b]))) for b in sources if b != a]
            marks = [(w, p - q) for w, p, q in zip(kept, shares[a], shares[None]) if count[lang, a, w] and p > q]
            for part, found in (("pair", pairs), ("term", marks)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, a, part, item, value, i + 1) for i, (item, value) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    out = []
    for i in range(240):
        words = [f"word{chr(97 + (i * k) % 23)}" for k in range(1, 30)] + ["The", "the", "Éa", "éa", "x" + "yz"[i % 2], "İ", "ß1ß"]
        out.append((i, " ".join(words * (1 + i % 3)) + (" zebra" * 400 if i % 40 == 0 else ""), ["en", "en", "de", None][i % 4], None if i % 11 == 0 else f"s{i % 5}", "c", 0))
    out += [(1000 + i, None if i else "", "empty", f"s{i % 3}", "c", 0) for i in range(4)]
    out += [(None, "alone on its own", "en", "sé", "c", 0), (7, "The the THE", "one", "only", "c", 0), (7, "The the THE", "one", "only", "c", 0)]
    return out + [(2000, "long" * 300_000 + " " + "the " * 400_000 + "é中" * 1000, "en", "s1", "c", 0)] + out[:3]


@pytest.mark.parametrize(("least", "top"), [(30, 50), (1, 3)])
def test_divergence(spark, corpus, least, top):
    table = spark.createDataFrame(corpus, SCHEMA).repartition(6)
    assert sorted(map(tuple, divergence(table, least=least, top=top).collect())) == brute(corpus, least, top, 5)


def test_small_shards_rounds_and_blocks(spark, corpus, monkeypatch):
    for name, value in (("SHARD_TERMS", 4), ("ROUND_BYTES", 3000), ("HELD_TERMS", 50), ("HELD_BYTES", 300), ("TERM_BLOCK", 5), ("SOURCE_BLOCK", 2)):
        monkeypatch.setattr(module, name, value)
    table = spark.createDataFrame(corpus, SCHEMA).repartition(3)
    assert sorted(map(tuple, divergence(table, least=20).collect())) == brute(corpus, 20, 50, 5)


def test_no_documents(spark):
    assert divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None, None)] * 2, SCHEMA)
    assert divergence(nulls).count() == 0


def test_terms_in_pieces(monkeypatch):
    monkeypatch.setattr(module, "_PIECE", 7)
    for text in ("", "a", "Ab c9d  é--É über " * 5, "x" * 50 + " y"):
        assert [t for part in terms_of(text.encode()) for t in part] == [t.encode() for t in terms(text)]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 5000])
def test_perfect_hash(n):
    keys = [f"key{i}".encode() for i in range(n)]
    made = PerfectHash(keys)
    slots = made.find(keys).tolist()
    assert len(made) == n and sorted(slots) == list(range(n)) and all(made.key(s) == k for s, k in zip(slots, keys))
    strangers = [f"other{i}".encode() for i in range(3000)] + [b"", b"key", b"key00"]
    assert (made.find(strangers) == -1).all()


def test_keys_with_equal_hashes(monkeypatch):
    real = perfect_hash.hashes
    monkeypatch.setattr(perfect_hash, "hashes", lambda keys: real([k[:1] for k in keys]))
    keys = [b"a1", b"a2", b"b1", b"a3", b"c"]
    made = PerfectHash(keys)
    assert sorted(made.find(keys).tolist()) == [0, 1, 2, 3, 4] and (made.find([b"a4", b"b", b"z"]) == -1).all()
    assert LOWER[65] == 97
