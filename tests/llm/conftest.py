import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

LONG = " ".join(f"word{i * i % 9973}" for i in range(60_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))

ROWS = [
    (1, None, "en", "a", None),
    (2, "", None, "a", 0),
    (3, " \t\n ", "en", None, 4),
    (4, "one two", "en", "a", 7),
    (5, "One TWO", "en", "b", 7),
    (6, LONG, "en", "b", len(LONG)),
    (7, LONG, "en", "b", len(LONG)),
    (8, PASSAGE + " alpha beta gamma", "de", "c", 1),
    (9, "delta epsilon " + PASSAGE, "de", "c", 1),
    (10, "Größe ß 😀 naïve " * 30, "fr", None, 1),
    (11, "x" * 5000, "fr", "", 1),
    (12, "ab " * 400, "es", "c", 1),
    (None, "a text without an id but with words", "es", "c", 1),
    (None, None, None, None, None),
    (13, "Released under the MIT License.\nsome other line", "en", "a", 1),
    (14, "Copyright (c) 2020 Somebody\nLICENSED under the Apache Licence -- version 2.0", "en", "a", 1),
    (15, "Copyright (c) 2021 Another\nLicensed under the Apache License, Version 2.0.", "en", "a", 1),
    (16, "dup row", "en", "a", 7),
    (16, "dup row", "en", "a", 7),
    (16, "same id, other text", "en", "a", 7),
]

#: Names that operators use for themselves.
CLASHES = ("size", "h", "c", "t", "at", "id", "key", "n", "copies", "taken", "target", "shard",
           "slot", "score", "f", "component", "component_id", "bands", "piece", "length",
           "offset", "digest", "rank", "n_words", "n_bytes", "entries", "fold", "y")


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def crowded(edge):
    """The same rows with extra columns named like what operators add."""
    return edge.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)
