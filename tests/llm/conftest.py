import pytest
from pyspark.sql import functions as F

LONG = "lorem ipsum " * 30_000


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls anywhere, empty and long texts, ties, repeated rows, extra columns with the operators' own names."""
    rows = [
        (1, "a b c d e f", "en", "s1"), (2, None, "en", "s1"), (3, "", "en", None), (4, " \t\n", "de", "s2"), (5, LONG, "en", "s2"), (6, "a b c d e f", "fr", "s1"), (6, "a b c d e f", "fr", "s1"),
        (7, "Zürich größer\nline two\n\nline two", None, "s3"), (None, "no id here", "en", "s1"), (8, "one", "en", "s3"), (9, "one two", "en", "s3"), (10, "x\ty z w <|endoftext|> <|startoftext|>  \n tail ", "en", "é"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    for name in ("fp", "size", "copies", "score", "rank", "salt", "host", "key", "range", "length", "node", "component", "label", "n_lines", "bundle", "sha1"):
        df = df.withColumn(name, F.lit(name))
    return df


@pytest.fixture(scope="session")
def empty_docs(edge_docs):
    return edge_docs.limit(0)
