import pytest

from plumeflow.llm import queries

SF_SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

#: Rows that every operator on documents has to take: nulls, blanks, repeats, one very long line and clashing names.
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "src1", 0),
    (3, " \n\t\n ", "en", "src1", 6),
    (4, "the same short text", "en", "src1", 19),
    (4, "the same short text", "en", "src1", 19),
    (None, "the same short text", None, None, 19),
    (5, "word " * 40_000, "en", "src2", 200_000),
    (6, "x" * 150_000, "en", "src2", 150_000),
    (7, "é" * 900 + "\n" + "é" * 900, "fr", "src3", 1801),
    (7, "another text under the id of a row above it", "fr", "src3", 43),
    (8, "\n".join(["a line of some words that repeats"] * 5), "en", None, 170),
]


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    # columns whose names the operators use within
    return df.withColumns({k: F.lit(1) for k in ("n_words", "cid", "th", "kept", "_host", "_cut", "_runs", "component", "n", "a", "b")})


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def registered():
    return queries
