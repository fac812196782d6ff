import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_texts():
    """Texts of the edge cases: null, empty, blank, ties, long, unusual characters."""
    return [
        None, "", "   ", "\n\n", "word", "two words", "same text here for a tie", "same text here for a tie", "a  b   c ", " led by a space",
        "tab\tand no-break em", "Émile ÀÉÎ naïve ﬁ ligature", "▁mark ▁ mark", "it's they'll 12,345.67 <|endoftext|> x<|startoftext|>y", "emoji 😀😀 é combining", "\r\nlines\r\n\x1c\x1d", "x" * 3000, "long " * 6000,
        "line\nline\nline\n\nother", "Ünï 中文字 тест", "café café", "?!...---", "trailing   ",
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """The odd texts as documents, with extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else "src0", None) for i, t in enumerate(odd_texts)]
    docs = spark.createDataFrame(rows, COLUMNS)
    for name in ("id", "shard", "h", "ids", "n", "key", "sig", "digest", "component", "words", "score", "host", "base"):
        docs = docs.withColumn(name, F.lit("extra"))
    return docs


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
