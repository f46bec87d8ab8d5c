import pytest
from pyspark.sql import types as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents from ``(id, text)`` rows, with the other columns filled in."""

    def build(rows, source="s"):
        full = [(i, t, "en", source if t is None or i is None else f"{source}{i % 3}", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, T._parse_datatype_string(SCHEMA)).repartition(3)

    return build


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


EDGE_TEXTS = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "one"),
    (5, "Ünïcode 😀 text with words here and there"),
    (6, "the same words again and again " * 2000),
    (7, "the same words again and again " * 2000),
    (8, "x" * 60000),
    (None, "a row without an id that has some words of its own"),
    (None, None),
    (9, "a repeated row that is here twice with all of its words"),
    (9, "a repeated row that is here twice with all of its words"),
]
