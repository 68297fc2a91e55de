"""Values with a fixed number of decimals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ...functions.numbers import as_number, back_to, round_even
from .base import Constraint


class Rounding(Constraint):
    """Columns are rounded to ``digits`` decimals, up to ``tolerance``; null does not pass."""

    def __init__(self, columns, digits, handling="transform", tolerance=None):
        if digits > 15:
            raise ValueError("doubles carry at most 15 digits")
        if tolerance is not None and tolerance >= 10.0 ** (-digits):
            raise ValueError("the tolerance must be smaller than one rounding step")
        self.targets = [columns] if isinstance(columns, str) else list(columns)
        self.digits = digits
        self.tolerance = tolerance or 10.0 ** (-(digits + 1))
        super().__init__(handling)

    def applies_to(self, df):
        return set(self.targets) <= set(df.columns)

    def valid(self, df):
        values = [as_number(df, c) for c in self.targets]
        tests = [F.abs(v - round_even(v, self.digits)) <= F.lit(self.tolerance) for v in values]
        return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))

    def _reverse(self, df):
        present = [c for c in self.targets if c in df.columns]
        return df.withColumns(
            {c: back_to(round_even(as_number(df, c), self.digits), df.schema[c].dataType) for c in present}
        )
