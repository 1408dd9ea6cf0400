import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use for their own results
    T.StructField("node", T.StringType()), T.StructField("piece", T.IntegerType()), T.StructField("key", T.StringType()),
])


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from texts or (doc_id, text[, lang]) with extra, clashing columns."""

    def make(rows):
        full = []
        for i, r in enumerate(rows):
            doc_id, text, lang = (i, r, "en") if r is None or isinstance(r, str) else (*r, "en")[:3]
            full.append((doc_id, text, lang, "a/b.txt", len(text) if text is not None else None, "x", 7, None))
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, unusual and very long texts, with repeats."""
    return [
        None, "", " \n\t ", "Plain words, twice.", "Plain words, twice.", "don't they'll İstanbul ΑΣ Ⅷ x² ½ _a_ __",
        "<|endoftext|>in<|startoftext|> text<|endoftext|>", "aaaa" * 3000, "a\x1cb\x85c　d 日本語 😀", "longer words " * 4000, "\n\n\n",
    ]
