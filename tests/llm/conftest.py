import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, extra=False):
    """A documents table; extra: with columns whose names clash with those that operators make."""
    rows = [(None if t is NO_ID else i, None if t is NO_ID else t, "en", f"src{i % 5}", None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        from pyspark.sql import functions as F

        for name in ("digest", "row", "spans", "kept", "start", "length", "class", "a", "b", "n", "x", "hash", "text_key", "url_key", "vector"):
            df = df.withColumn(name, F.lit("clash"))
    return df


NO_ID = object()


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, white space, ties, repeats, controls, other scripts, a very long word and a very long text."""
    r = random.Random(5)
    words = ["alpha", "Beta", "γάμμα", "delta!", "été", "日本語テキスト", "x" * 40, "ſtraße", "İstanbul", "ΑΣ", "don't", "we'll", "\x1cgap\x1f"]
    long = " ".join(r.choice(words) for _ in range(30_000))
    return [NO_ID, None, "", " \n\t ", "one", "one two three", "same text here for two", "same text here for two", "a\x85b\xa0c　d e", "\n\n\nlines\n\nlines\n", "z" * 5000, " " * 3000, "🙂 emoji 👩‍👩‍👧 text", "é decomposed", long, "tail'" * 50]


@pytest.fixture(scope="session")
def make(spark):
    return lambda texts, **k: documents(spark, texts, **k)
