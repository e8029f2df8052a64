import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int"


@pytest.fixture
def docs_of(spark):
    def make(texts, lang="en", source="s"):
        rows = [t if isinstance(t, tuple) else (i, t, lang, source, None if t is None else len(t), 7) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture
def odd(docs_of):
    """Nulls in every column, empty and long texts, repeated rows, ties."""
    long = " ".join(f"w{i % 997} and" for i in range(30_000))
    same = " ".join(f"same{i}" for i in range(60))
    return docs_of([None, "", " \n\t ", long, same, same, (None, same, None, None, None, None), (None, None, None, None, None, None), (4, same, "en", "s", None, 7), "héllo wörld 漢字 🙂", "a\x00b", "x" * 5000])
