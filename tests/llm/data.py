"""Awkward rows that every operator must take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Columns besides those of `documents` carry names that operators use inside.
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("score", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("fp", T.StringType()),
        T.StructField("named", T.StringType()),
        T.StructField("block", T.StringType()),
    ]
)

LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(20_000))
PROSE = "The quick brown fox jumps over the lazy dog while the old clock of the town strikes nine in the rain."

ROWS = [
    (1, PROSE, "en", "s", len(PROSE)),
    (2, PROSE, "en", "s", len(PROSE)),
    (3, PROSE.replace("lazy", "lazi"), "en", "s", None),
    (3, PROSE.replace("lazy", "lazi"), "en", "s", None),  # a repeated row
    (4, None, None, None, None),
    (5, "", "en", "s", 0),
    (6, " \t\n ", "en", "s", 4),
    (7, LONG, "en", "s", len(LONG)),
    (8, "one", "en", "s", 3),
    (9, "Ünïcode 漢字 \U0001f600 text, with ÄÖÜ and more: " * 5, "de", "s", None),
    (None, "a row without an id that says something of its own entirely", None, "s", None),
    (None, None, None, None, None),
    (10, f"{PROSE}\nA second line that is long enough to count for the line join here.\n{PROSE}", "en", "s", None),
    (11, "A second line that is long enough to count for the line join hare.\nshort", "en", "s", None),
]


def awkward(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*r, "x", "y", "z", "n", "b") for r in ROWS], SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def from_texts(spark: SparkSession, texts: list[str | None], first: int = 0) -> DataFrame:
    return spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def labels(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def tokens(text: str) -> int:
    """Tokens of a text by white space, 16 characters of a run at most."""
    return sum(-(-len(run.decode()) // 16) for run in text.encode().split())
