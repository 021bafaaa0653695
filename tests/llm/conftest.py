from pyspark.sql import types as T
import pytest

DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])
WS = " \t\n\x0b\f\r"


def phrase(start: int, n: int) -> str:
    return " ".join(f"w{start + i}" for i in range(n))


@pytest.fixture(scope="session")
def rows():
    """Nulls, empty and very long texts, copies, repeated rows and ids, near copies, shared passages."""
    base, passage = phrase(0, 120), phrase(5000, 60)
    texts = [base, base, base + " extra", base.replace("w50 ", "x "), passage + " " + phrase(9000, 80), phrase(9500, 70) + "\n" + passage, "", None, "one", "One", "a  b\t\tc\n a",
             ("spam egg " * 300).strip(), "x" * 200_000, phrase(20_000, 30_000), " \n ", "é, İ, THE THE. 'S <|endoftext|>", passage, "# $ % & < > | *"]
    out = [(i, t, "en", "hot" if i % 3 else (None if i % 2 else "cold"), 0) for i, t in enumerate(texts)]
    return [*out, out[0], (None, base, "en", "cold", 0), (None, None, None, None, None), (3, phrase(70_000, 50), "en", "hot", 0)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
