"""Operators as SQL table functions: ``SELECT * FROM every_nth(TABLE(t) PARTITION BY k ORDER BY ts, 50)``.

Each takes a table of any columns and returns its rows, so user code can be written in SQL
and functions of the same shape can stand in for one another. Rows of a partition pass one
by one, in the given order, through an object that holds the partition's state; for large
tables the operators of the same names do the same without a Python step per row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def _table(argument: AnalyzeArgument) -> T.StructType:
    if not argument.isTable:
        raise ValueError("the first argument is a table: TABLE(name)")
    return argument.dataType


class EveryNth:
    """``every_nth(TABLE(t) PARTITION BY .. ORDER BY .., n)``: every n-th row of a partition."""

    def __init__(self) -> None:
        self.seen = 0

    @staticmethod
    def analyze(table: AnalyzeArgument, n: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(schema=_table(table))

    def eval(self, row: Row, n: int) -> Iterator[tuple]:
        self.seen += 1
        if self.seen % n == 0:
            yield tuple(row)


class RateSample:
    """``rate_sample(TABLE(t) PARTITION BY .. ORDER BY .., ts, rate)``: rows of a partition at
    least ``1 / rate`` seconds of column ``ts`` apart; rate 0 keeps all."""

    def __init__(self) -> None:
        self.last = None

    @staticmethod
    def analyze(table: AnalyzeArgument, ts: AnalyzeArgument, rate: AnalyzeArgument) -> AnalyzeResult:
        schema = _table(table)
        if ts.value not in schema.names:
            raise ValueError(f"no column {ts.value!r}")
        return AnalyzeResult(schema=schema)

    def eval(self, row: Row, ts: str, rate: float) -> Iterator[tuple]:
        at = row[ts]
        if float(rate) == 0 or self.last is None or (at - self.last).total_seconds() >= 1 / float(rate):
            self.last = at
            yield tuple(row)


class Topics:
    """``topics(TABLE(t), text, prefix)``: the rows once per word of column ``text`` that
    starts with the prefix, with that ``word``."""

    @staticmethod
    def analyze(table: AnalyzeArgument, text: AnalyzeArgument, prefix: AnalyzeArgument) -> AnalyzeResult:
        schema = _table(table)
        if text.value not in schema.names:
            raise ValueError(f"no column {text.value!r}")
        return AnalyzeResult(schema=T.StructType([*schema.fields, T.StructField("word", T.StringType())]))

    def eval(self, row: Row, text: str, prefix: str) -> Iterator[tuple]:
        for word in re.split("[ \n\t]+", row[text] or ""):
            if word and word.startswith(prefix):
                yield (*row, word)


TABLE_FUNCTIONS = {"every_nth": EveryNth, "rate_sample": RateSample, "topics": Topics}


def register_table_functions(spark: SparkSession) -> None:
    """Make the table functions known to the session's SQL by their names."""
    from pyspark.sql.functions import udtf

    for name, function in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, udtf(function))
