"""Operators against brute force on a small table of hard cases."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from martlet.llm.embeddings import near_vectors
from martlet.llm.html_text import extract_text, visible_text
from martlet.llm.minhash import near_duplicates
from martlet.llm.mixing import mix
from martlet.llm.quality_rules import quality_rules
from martlet.llm.sentencepieces import decode_pieces, encode_pieces
from martlet.llm.substrings import remove_repeats
from martlet.llm.token_counts import context_totals, token_counts
from martlet.llm.token_files import read_tokens, write_tokens
from martlet.llm.warc import LoserTree, archive


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def repeat_count(w, n):
    seen = Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    return len({j for i in range(len(w) - n + 1) if seen[tuple(w[i:i + n])] > 1 for j in range(i, i + n)})


def test_quality_rules(docs, no_docs, rows):
    got = quality_rules(docs.withColumn("kept", F.lit("clash"))).collect()
    key = lambda r: tuple(map(str, r))
    want = []
    for i, text, _, _, _ in rows:
        w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
        r = repeat_count(w, 8)
        want.append((i, len(w), len("".join(w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), r, len(w) < 20 or 100 * r > 30 * len(w)))
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=key) == sorted(want, key=key)
    assert all(not r.kept for r in got if r.base_failed)
    assert quality_rules(no_docs).count() == 0


def test_bad_host_takes_its_documents(spark):
    good = " ".join(f"g{i}" for i in range(40))
    table = spark.createDataFrame([(i, "bad" if i < 60 else "fine", "short" if i < 55 else f"{good} {i}") for i in range(160)], "doc_id long, source string, text string")
    kept = {r.doc_id for r in quality_rules(table).filter("kept").collect()}
    assert kept == set(range(60, 160))


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, no_docs, rows, width):
    def shingles(text):
        w = words("".join(c.lower() if c.isascii() else c for c in text or ""))
        return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1)) or (frozenset([tuple(w)]) if w else frozenset())

    sets = [(i, shingles(t)) for i, t, *_ in rows]
    reach = list(range(len(sets)))
    find = lambda x: x if reach[x] == x else find(reach[x])
    for a, (i, x) in enumerate(sets):
        for b, (j, y) in enumerate(sets[:a]):
            if i is not None and i == j or x and y and 100 * len(x & y) >= 80 * len(x | y):
                reach[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(x for x in (least.get(find(k)), i, 10**9) if x is not None)
    want = Counter((i, len(s), None if least[find(k)] == 10**9 else least[find(k)]) for k, (i, s) in enumerate(sets))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs, width=width).collect()) == want
    assert near_duplicates(no_docs).count() == 0


def test_mix(docs, no_docs, rows):
    got = mix(docs).collect()
    assert len(got) == len(rows) and sum(r.size for r in got) == sum(len(words(t)) for _, t, *_ in rows)
    assert all(0 <= r.passes <= 3 and r.taken == r.size * r.passes for r in got)
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(sum(r.size for r in got))
    assert sorted(map(str, got)) == sorted(map(str, mix(docs.repartition(5)).collect()))
    assert mix(no_docs).count() == 0


def test_substrings(docs, no_docs, rows):
    seen = Counter(tuple(w[i:i + 35]) for _, t, *_ in rows for w in [words(t)] for i in range(len(w) - 34))
    want = Counter()
    for i, t, *_ in rows:
        w = words(t)
        gone = {j for k in range(len(w) - 34) if seen[tuple(w[k:k + 35])] > 1 for j in range(k, k + 35)}
        want[i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)] += 1
    got = remove_repeats(docs.withColumn("n_removed", F.lit("clash"))).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, " ".join(words(r.text))) for r in got) == want
    assert {r.text for r in got if r.n_removed == 0} <= {t for _, t, *_ in rows}
    assert remove_repeats(no_docs).count() == 0


def test_sentencepieces(docs, no_docs, rows):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    peer = sentencepiece.SentencePieceProcessor(model_file=path)
    coded = encode_pieces(docs, path)
    key = lambda x: (str(x[0]), len(x[1]), x[1])
    assert sorted(((r.doc_id, r.ids) for r in coded.collect()), key=key) == sorted(((i, peer.encode(t or "")) for i, t, *_ in rows), key=key)
    texts = sorted((str(r.doc_id), r.text) for r in decode_pieces(coded, path).collect())
    assert texts == sorted((str(i), t or "") for i, t, *_ in rows)
    assert encode_pieces(no_docs, path).count() == 0


def test_token_files(spark, docs, no_docs, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    peer = Tokenizer.from_file(path)
    got = sorted(read_tokens(spark, write_tokens(docs, path)).collect(), key=lambda r: r.start)
    want = Counter()
    for i, t, *_ in rows:
        ids = [*peer.encode(t or "", add_special_tokens=False).ids, 1]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: -1 if x is None else x)
    assert read_tokens(spark, write_tokens(no_docs, path)).count() == 0


def test_token_counts(spark, docs, no_docs):
    lengths = [0, 5, 5, 5, 9000, 123, 4096]
    got = {r.length: r for r in context_totals(spark.createDataFrame([(x, 1) for x in lengths], "length long, n long")).collect()}
    assert set(got) == set(lengths)
    for limit, r in got.items():
        assert (r.n_docs, r.n_longer, r.truncated_tokens) == (lengths.count(limit), sum(x > limit for x in lengths), sum(min(x, limit) for x in lengths))
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert token_counts(docs.filter("length(text) < 1000 or text is null"), path, public_tokenizers.PATTERN).agg(F.sum("n_docs")).first()[0] == docs.filter("length(text) < 1000 or text is null").count()
    assert token_counts(no_docs, path, public_tokenizers.PATTERN).count() == 0


def test_embeddings(spark):
    random = np.random.default_rng(1)
    base = random.standard_normal((40, 16))
    near = base[:20] + 0.02 * random.standard_normal((20, 16))
    data = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(np.vstack([base, near, base[:5], near[:5] * 3]))]
    data = [(i, v, i % 20 % 3 if i < 60 else (i - 60) % 5 % 3) for i, v, _ in data]
    data += [(100, None, 1), (101, [0.0] * 16, 1), (102, [float("nan")] * 16, 1), (103, [1.0, None], 1), (104, data[0][1], None), (105, [], 1), (None, data[1][1], 1), data[2]]
    ok = lambda v, label: label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")).collect()}
    for i, v, label in data:
        if i is None or i == 2:
            continue
        v32 = np.array(v or [], dtype=object)
        links = 0
        if ok(v, label):
            x = np.array(v, np.float32).astype(float)
            for j, w, other in [d for d in data if d is not data[-1] or True]:
                if j != i and other == label and ok(w, other) and len(w) == len(v):
                    y = np.array(w, np.float32).astype(float)
                    links += x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98
        assert got[i].n_links == links, (i, len(v32))
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_archives(spark):
    page = "<html>" + "é" * 100
    data = [(1, "http://WWW.a.org/x", page), (5, "http://www.a.org/x", page), (3, None, page), (4, "http://b.org/ y", "short"), (6, "http://b.org/", "short"), (7, "https://c.net", None), (8, "u\r\n\r\nv", "WARC/1.1\r\n\r\n" * 30), (None, "http://d.org/", page)]
    table = spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in archive(table, captured_at=F.lit("2024-01-01T00:00:00Z")).collect()}
    for i, _, html in data:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 1) if html == page and i != 1 else ("response", None))
    assert archive(spark.createDataFrame([], "page_id long, url string, html string"), captured_at=F.lit("x")).count() == 0


def test_loser_tree():
    runs = [sorted(np.random.default_rng(k).integers(0, 50, k * 3).tolist()) for k in range(7)]
    for k in range(8):
        assert list(LoserTree(runs[:k])) == sorted(x for r in runs[:k] for x in r)


def test_html(spark):
    html = "<title>T</title><h1>A <b>b</b></h1><p>one<p>two &amp; three<ul><li>x<li>y<ol start=3><li>z</ol></ul><div hidden>no</div><script>var x='</p>'</script><table><tr><th>Name<th>Qty<tr><td>melon<td>3</table><pre> a\n  b</pre>"
    assert visible_text(html) == "A b\n\none\n\ntwo & three\n\n- x\n- y\n  3. z\n\nName   Qty\nmelon  3\n\n a\n  b"
    assert visible_text(None) == visible_text("") == visible_text("<p hidden>x") == ""
    assert visible_text("<div>" * 5000 + "deep").strip() == "deep"
    table = spark.createDataFrame([(1, "<p>a", "clash"), (2, None, "c")], "page_id long, html string, text string")
    assert {(r.page_id, r.text) for r in extract_text(table).collect()} == {(1, "a"), (2, "")}


@pytest.mark.parametrize("html, text", [
    ("<head><title>T</title><body>Hello <b>x</b>", "Hello x"), ("<head><title>T</title><body><span><p>a<p>b</span>", "a\n\nb"),
    ("<html><head><meta charset=x><title>T</title>\n Hello", "Hello"), ("<head><span>a<p>b", "a\n\nb"), ("<head><li>a<li>b", "- a\n- b"),
    ("<head><table><td>a</table>b", "a\nb"), ("<p>a<head><title>T</title>b", "ab"), ("<head><head><title>T</title>a", "a"),
    ("<head><noscript><p>no</noscript><template><p>no</template><style>no</style><link>\n<body>a", "a"), ("<head><noscript><p>no<body>a", "a"),
    ("<head><title>T</title></head><body>a", "a")])
def test_html_head_left_open(html, text):
    got = visible_text(html)
    assert re.sub(r"\n+", "\n", got) == re.sub(r"\n+", "\n", text)


@pytest.mark.parametrize("html, text", [
    ('<a href="x"">click</a> rest of page <b>x</b> more', "click rest of page x more"), ("<p title=it's>Hello <b>all</b> the rest", "Hello all the rest"),
    ("<a href=x'>one</a> <a href=y'>two</a>", "one two"), ('<b ">x</b> y', "x y"), ('<b ="p>x</b> y', "x y"), ('<b a=b="c>x</b> y', "x y"), ("<b a = 'p>q' c>x</b> y", "x y"),
    ("<b a= >x</b>", "x"), ("<b a='p>q", ""), ("<b a='p'b=\"q>\"c>x</b>", "x"), ("<b/a='>'/>x", "x"), ("<p title=it'hidden>x", "x"), ("<p title=a hidden>x", ""), ('<p title="a"hidden>x', ""),
    ("a<!-->b<!-- c -->d", "abd"), ("a<!--->b<!-- c -->d", "abd"), ("a<!---->b<!-- c -->d", "abd"), ("a<!-- > -> c --!>b", "ab"), ("a<!-- c", "a")])
def test_html_malformed_tags(html, text):
    assert visible_text(html) == text


@pytest.mark.parametrize("html, text", [
    ("<table><tr><form><td>Price<td>3</form></tr></table>", "Price  3"), ("<table><tr><a name=x><td>a<td>b</a></table>", "a  b"), ("<table><tbody><form><tr><td>a<td>b</form></table>", "a  b"),
    ("<table><tbody><p>text<tr><td>a</table>b", "text\na\nb"), ("<table><tr>loose <b>text</b><td>a</table>", "loose text\na"), ("<table><thead>x</thead><tr><td>a</table>", "x\na"),
    ("<table><colgroup><col><td>a</table>", "a"), ("<table><colgroup>x<tr><td>a</table>", "x\na"), ("<table><caption>c<tr><td>a<td>b</table>", "c\na  b"), ("<table><tr><caption>c<td>a</table>", "c\na"),
    ("<table><tr><div><td>a</div><tr><i><th>b</table>c", "a\nb\nc"), ("<table><tr><td>a<table><tr>x<td>b</table>c<td>d</table>e", "ax  d\nb\nc\ne"), ("<table><tr><table><td>a</table><td>b</table>c", "a\nbc"),
    ("<table><tr><textarea>x</textarea><script>no</script><td>a</table>", "x\na"), ("<table><tr><div hidden>no<td>a</table>", "a"), ("<table><tr><td>a<template><td>no</template>b</table>", "ab"),
    ("<div>p<table>x<tr>y</p>z</table>q</div>r", "pxy\nz\n\nq\nr"), ("<div>" * 300 + "<table><tr><td>a<p>b</table>c", "a\nbc"), ("<div>" * 197 + "<table><tr><td>a<td>b</table>c", "ab\nc")])
def test_html_table_strays(html, text):
    assert re.sub(r"\n+", "\n", visible_text(html)) == re.sub(r"\n+", "\n", text)


def test_html_tags_take_linear_time():
    long = 200_000
    for html in ("<a " + "'" * long, "<a " + "=" * long, "<a" + " a=" * long, "<a " + "a " * long, "<!--" + "-" * long, '<a b="' * long):
        assert visible_text(html + ">") == ""


def test_pipeline(spark, docs, rows, tmp_path):
    import corpus_pipeline as p

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, kept, str(tmp_path)).cache()
        assert after.columns == p.COLUMNS, name
        assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in kept.select("doc_id").collect()}
        kept = after
    assert p.run(spark, str(tmp_path)).count() == kept.count()


def test_pipeline_rows_without_an_id_or_with_a_shared_one(spark):
    import corpus_pipeline as p

    good = [" ".join(f"g{k}x{i}" for i in range(60)) for k in range(8)]
    near = good[6] + " more"
    data = [(None, good[1]), (None, good[2]), (7, good[3]), (7, "short"), (7, good[4]), (8, good[5]), (8, good[5]), (None, good[5]), (None, "short"), (9, near), (9, good[6]), (6, good[7]), (5, good[7] + " more"), (None, good[7] + " end")]
    table = spark.createDataFrame([(i, t, "en", "hot" if i else None, len(t)) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    as_rows = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    fine = p.quality(spark, table, "").cache()
    assert as_rows(fine) == Counter(x for x in data if x[1] != "short")
    single = as_rows(p.near_dedup(spark, fine, ""))
    assert set(single.values()) == {1}
    assert set(single) - {(9, near), (9, good[6])} == {(None, good[1]), (None, good[2]), (7, good[3]), (7, good[4]), (8, good[5]), (5, good[7] + " more")}
    assert len(single) == 7
    assert as_rows(p.near_dedup(spark, fine.repartition(7, "text"), "")) == single
    langs = table.withColumn("lang", F.when(F.length("text") > 300, "de")).union(table)
    for docs in (table, langs):
        want = Counter()
        for r in p.mix(docs, also=("lang", "n_chars")).collect():
            want[r.doc_id, r.source] += r.passes
        mixed = p.source_mix(spark, docs, "").collect()
        assert Counter((r.doc_id, r.source) for r in mixed) == +want
        assert {(r.doc_id, r.text) for r in mixed} <= set(data) and any(r.doc_id is None for r in mixed)
