import pytest
from pyspark.sql import functions as F

#: Rows that every operator must bear: nulls, empty and blank texts, ties, repeats, a long text, other scripts.
ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n\x0b ", None, None), (4, "a", "en", None), (5, "A", "en", "b"), (5, "A", "en", "b"),
    (6, "one two three one two three four", None, "b"), (None, "no id", "de", "b"), (None, "no id", "de", "b"), (7, "x " * 30000, "en", "c"),
    (8, "çé 中文 한국어 ñ", "fr", "c"), (9, "call +44 (0)20 7946 0958, mail a.b@c.example.org, 10.0.0.255, 4111 1111 1111 1111", "en", "d"),
    (10, "<|endoftext|> it's", "en", "\U0001F600"), (2**62, "big id", "en", "￿"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").repartition(3)
    # names that operators use inside
    names = ["size", "row", "run", "part", "rate", "_t", "base", "fp", "node", "_size", "_part", "_text", "_doc", "_own", "_lang", "_key", "copies", "component", "kept", "stratum", "score", "key", "target", "index", "word.s"]
    return rows.withColumns({x: F.lit(f"mine {x}") for x in names})


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
