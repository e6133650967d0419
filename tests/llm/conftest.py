import pytest

ODD = [
    (1, "one two three four five six", "en", "a", 27),
    (1, "one two three four five six", "en", "a", 27),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (None, "no id\nb\nc\nd", "de", None, 10),
    (4, "x" * 5000 + " " + "y z " * 3000, "en", "b", 17001),
    (5, " \n\t ", "fr", "b", 4),
    (6, "ÀÉ ｆｕｌｌ width ß", "de", "b", 15),
    (7, "àé full width SS", "de", "b", 16),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, a missing id, and extra columns with clashing names."""
    base = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    return base.selectExpr("*", "1 AS size", "2 AS start", "'x' AS fingerprint", "3 AS rate", "4 AS k", "5 AS h")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("false")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
