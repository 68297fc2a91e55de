"""Constraints that look at one row at a time work on a streaming frame as they are.

Unique and UniqueCombinations need other rows and are refused here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def _row_local(constraints) -> list:
    for c in constraints:
        if not c.row_local:
            raise ValueError(f"{type(c).__name__} needs other rows and cannot judge a stream")
    return list(constraints)


def filter_valid_stream(stream: DataFrame, constraints) -> DataFrame:
    """Rows of the stream that hold all constraints."""
    tests = [c.valid(stream) for c in _row_local(constraints)]
    return stream.filter(reduce(lambda a, b: a & b, tests)) if tests else stream


def flag_valid_stream(stream: DataFrame, constraints, name: str = "is_valid") -> DataFrame:
    """The stream with the joint verdict on every row."""
    tests = [c.valid(stream) for c in _row_local(constraints)]
    return stream.withColumn(name, reduce(lambda a, b: a & b, tests))
