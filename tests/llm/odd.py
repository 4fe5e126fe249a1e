"""Tables with nulls, ties, repeated rows, empty and very long texts."""

from pyspark.sql import DataFrame, SparkSession, functions as F

LONG = "Lorem ipsum, dolor sit amet. " * 4000

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

DOCS = [
    (1, "Alpha beta gamma delta.", "en", "a", 23),
    (2, "ALPHA beta gamma delta.", "en", "a", 23),
    (3, "alpha beta gamma delta!", "en", None, 23),
    (3, "alpha beta gamma delta!", "en", None, 23),
    (3, "alpha beta gamma delta!", "fr", "b", 23),
    (4, None, None, None, None),
    (5, "", "en", "b", 0),
    (None, "no id here at all", "en", "a", 17),
    (None, "no id here at all", "en", "a", 17),
    (None, None, None, None, None),
    (6, LONG, "en", "c", len(LONG)),
    (7, LONG, "en", "c", len(LONG)),
    (8, LONG + "x", "en", "c", len(LONG) + 1),
    (9, " \t\n ", "en", "c", 4),
    (10, "Ärger und ÄRGER 😀 über", "de", "é", 22),
    (11, "one", "en", "b", 3),
]


def docs_of(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DOCS, SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def clashing(spark: SparkSession, *names: str) -> DataFrame:
    """Columns with the names that an operator uses itself, and a name with a dot."""
    more = {n: F.lit("mine") for n in names if n not in NAMES}
    return docs_of(spark).withColumns(more | {"a.b": F.lit(1)})
