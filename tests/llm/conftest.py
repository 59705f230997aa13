import pytest

DATA = "/root/testdata/sf0.001"
#: Column names that the operators use inside or return, as extra columns of the input.
CLASHES = ["score", "fingerprint", "component_id", "ids", "n_tokens", "n_words", "y", "cell", "native", "least", "root", "host", "rule", "words", "lang2", "kept", "decoded", "predicted"]


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def pages(spark):
    return spark.read.parquet(f"{DATA}/pages.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.read.parquet(f"{DATA}/benchmark.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, odd characters, extra columns with clashing names."""
    long_text = " ".join(f"word{i % 997}" for i in range(60_000))
    rows = [
        (1, "Plain words stand here, quite a few of them in fact, ten or more.", "en", "a", 1),
        (2, None, "en", "a", None), (3, "", None, None, 0), (None, "no id at all", "en", "a", 3), (None, None, None, None, None),
        (5, long_text, "en", "a", 5), (6, "x" * 300_000, "de", "b", 6), (7, " \t\n\x0b\f\r ", "fr", "b", 7),
        (8, "same row", "en", "a", 8), (8, "same row", "en", "a", 8), (9, "ÄÖ 漢字 😀 <|endoftext|> \x00 e\u0301 İ", "xx", "c", 9), (-4, "a b c", "es", "c", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    return df.selectExpr("*", *(f"'x' as {c}" for c in CLASHES))


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")
