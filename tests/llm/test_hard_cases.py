"""Inputs on which hashes, labels, patterns or column names could fool the operators."""

import random
import struct

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from martlet.llm import wordhash
from martlet.llm.embeddings import near_vectors
from martlet.llm.minhash import near_duplicates
from martlet.llm.quality_rules import quality_rules
from martlet.llm.sentencepieces import PieceEncoder, code_pieces, decode_pieces, encode_pieces
from martlet.llm.substrings import remove_repeats
from martlet.llm.token_counts import encoded_length, encoding, token_lengths


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.mark.parametrize("n", [64, 2048, 1 << 17])
def test_words_built_to_collide(spark, n):
    one, other = thue_morse(n), thue_morse(n, "b", "a")
    assert all(len(set(wordhash.word_hashes(f"{one} {other}".encode(), *wordhash.word_spans(f"{one} {other}".encode()), which).tolist())) == 2 for which in (0, 1))
    docs = spark.createDataFrame([(1, one), (2, other), (3, one)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1}
    around = " ".join(f"w{i}" for i in range(34))
    texts = spark.createDataFrame([(1, f"{around} {one}"), (2, f"{around} {other}"), (3, f"x {one} {around}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in remove_repeats(texts).collect()} == {1: 0, 2: 0, 3: 0}


def test_labels_of_any_type(spark):
    v = [0.5, 0.25, 1.0]
    long_labels = spark.createDataFrame([(1, v, 12345678901234567), (2, v, 12345678901234568), (3, v, 12345678901234567)], "vec_id long, embedding array<double>, label long")
    assert {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(long_labels).collect()} == {1: (1, 1), 2: (0, 2), 3: (1, 1)}
    texts = spark.createDataFrame([(1, v, "x" * 40 + "a"), (2, v, "x" * 40 + "b"), (3, [0.5, 0.25, 1.01], "x" * 40 + "a"), (4, v, None)], "vec_id long, embedding array<double>, label string")
    assert {r.vec_id: r.component_id for r in near_vectors(texts).collect()} == {1: 1, 2: 2, 3: 1, 4: 4}
    numbers = spark.createDataFrame([(1, v, 1.2), (2, v, 1.5), (3, v, -0.0), (4, v, 0.0)], "vec_id long, embedding array<double>, label double")
    assert {r.vec_id: r.component_id for r in near_vectors(numbers).collect()} == {1: 1, 2: 2, 3: 3, 4: 3}


def test_lengths_of_white_space_and_of_every_row(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = encoding(path, public_tokenizers.PATTERN)
    blanks = [" " * 1_000_000, "a" + "\n " * 500_000 + "b", "a" + "　" * 20_000 + "1", "x" + " " * 30_000]
    assert [encoded_length(own, t) for t in blanks[2:]] == [len(own.encode_ordinary(t)) for t in blanks[2:]]
    huge = spark.createDataFrame([(t,) for t in blanks], "text string")
    assert token_lengths(huge, path, public_tokenizers.PATTERN).agg(F.sum("n")).first()[0] == 4
    want = sorted(len(own.encode_ordinary(r.text or "")) for r in docs.select("text").collect())
    got = sorted(x for r in token_lengths(docs, path, public_tokenizers.PATTERN).collect() for x in [r.length] * r.n)
    assert got == want


def test_lengths_are_cut_as_the_pattern_cuts(monkeypatch):
    import regex

    from martlet.llm import token_counts

    own = encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    monkeypatch.setattr(token_counts, "LONG_BLANK", regex.compile(r"\p{White_Space}{3,}"))
    rand = random.Random(1)
    for _ in range(2000):
        text = "".join(rand.choices(["a", "1", ".", "'s", " ", "\n", "\t", "\xa0", "\x1c", "é", "　", "   "], k=40))
        assert encoded_length(own, text) == len(own.encode_ordinary(text))


def test_columns_with_the_names_in_use(spark):
    names = ["_host", "host", "rule", "_rule", "_text", "_mark", "_key", "_at", "_m", "_copied", "_starts", "c0", "mark"]
    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"{words} {i}", "s") for i in range(4)], "doc_id long, text string, source string")
    docs = docs.select("*", *[F.concat(F.lit(f"{n}-"), "doc_id").alias(n) for n in names])
    for got in (quality_rules(docs), remove_repeats(docs)):
        rows = got.collect()
        assert len(rows) == 4 and all(r[n] == f"{n}-{r.doc_id}" for r in rows for n in names)


def test_one_pass_codes_like_two_and_the_libraries_agree(docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    both = sorted(map(str, code_pieces(docs, path).collect()))
    assert both == sorted(map(str, decode_pieces(encode_pieces(docs, path), path).collect()))
    assert code_pieces(docs, path).filter("n_differing > 0").count() == 0


def field(number, kind, data):
    head = bytes([number << 3 | kind]) if number < 16 else bytes([(number << 3 | kind) & 127 | 128, number >> 4])
    return head + (bytes([len(data)]) + data if kind == 2 else data)


def test_unigram_model_with_byte_fallback(tmp_path):
    import sentencepiece

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", -20.0, 6) for b in range(256)),
              *((t, -s, 1) for t, s in (("▁", 3.0137), ("a", 4.0291), ("b", 4.1533), ("c", 4.2719), ("ab", 5.0871), ("abc", 6.5413), ("▁a", 4.5677), ("▁ab", 5.2339), ("bc", 5.5197), ("▁the", 4.0823), ("ca", 5.1559)))]
    body = b"".join(field(1, 2, field(1, 2, t.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([k]))) for t, s, k in pieces)
    body += field(2, 2, field(3, 0, b"\1") + field(35, 0, b"\1")) + field(3, 2, field(3, 0, b"\1") + field(4, 0, b"\1") + field(5, 0, b"\1"))
    path = tmp_path / "unigram.model"
    path.write_bytes(body)
    peer, own = sentencepiece.SentencePieceProcessor(model_file=str(path)), PieceEncoder(str(path))
    rand = random.Random(5)
    texts = ["", "a", "abc", "the abc", "é", "日本 ab", "  two  blanks ", *("".join(rand.choices("abc  é", k=25)) for _ in range(200))]
    for text, (ids, differing) in zip(texts, own.encode(texts)):
        got = list(struct.unpack(f"<{len(ids) // 4}i", ids))
        assert got == peer.encode(text) and differing == 0


def test_words_are_divided_like_whole_texts():
    """Parts of words, put together again, are the ids of the whole text by the library; slices and cleared memories too."""
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from martlet.llm import token_files

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["", None, " ", "a\x0bb\x0cc  d ", "\n\n", "ü,", "é.,", "É,", "é, x", "it's, 3.14!! 5;", "A b C.", "\x01 a\x01b", "ﬁ.", "²,", "٣.", "word" * 2000,
             "a," * 3000, "“q”,", "_,", "-.", "1,2", "|", "||| |a|", "Z9.", "don't!", "x​,", "中文, 字。", "\U0001f600!", "ß;"]
    library = Tokenizer.from_file(path)
    want = [e.ids + [1] for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    own = token_files.WordEncoder(path, "H")
    column, end = pa.array(texts, pa.string()), (1).to_bytes(2, "little")
    for part, at in ((column, 0), (column.slice(5, 9), 5), (column.slice(3), 3)):
        found = [list(memoryview(x).cast("H")) for x in own.encode(part, end).to_pylist()]
        assert found == want[at:at + len(part)]
        own.parts.clear()
    assert own.encode(column.slice(0, 0), end).to_pylist() == []
