"""Columns of which exactly one is 1."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ...functions.numbers import as_number, back_to
from ...functions.vectors import argmax
from .base import Constraint


class OneHot(Constraint):
    """Each row holds one 1 and otherwise 0 in ``columns`` (nulls are skipped)."""

    def __init__(self, columns, handling="transform"):
        self.columns = tuple(columns)
        super().__init__(handling, fit_columns_model=True)

    def valid(self, df):
        values = [as_number(df, c) for c in self.columns]
        total = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in values])
        top = F.greatest(*values) if len(values) > 1 else values[0]
        low = F.least(*values) if len(values) > 1 else values[0]
        return F.coalesce((total == 1.0) & (top == 1.0) & (low == 0.0), F.lit(False))

    def _winner(self, df: DataFrame, scores) -> DataFrame:
        best = argmax(F.array(*scores))
        types = {c: df.schema[c].dataType if c in df.columns else None for c in self.columns}
        made = {}
        for i, c in enumerate(self.columns):
            bit = F.when(best == i, F.lit(1.0)).otherwise(F.lit(0.0))
            made[c] = bit if types[c] is None else back_to(bit, types[c])
        return df.withColumns(made)

    def _reverse(self, df):
        return self._winner(df, [as_number(df, c) for c in self.columns])

    def check_conditions(self, df: DataFrame) -> None:
        """Conditions are zeros and ones with at most one 1 (one job over the conditions)."""
        given = [c for c in self.columns if c in df.columns]
        values = [as_number(df, c) for c in given]
        bits = reduce(lambda a, b: a & b, [F.coalesce(v.isin(0.0, 1.0), F.lit(False)) for v in values])
        ones = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in values])
        bad, many = df.agg(F.count_if(~bits), F.count_if(bits & (ones > 1.0))).first()
        if bad:
            raise ValueError("conditions on one-hot columns are zeros and ones")
        if many:
            raise ValueError("a condition asks for more than one 1")

    def fill(self, df: DataFrame, seed: int = 0, id_col: str | None = None) -> DataFrame:
        """Complete conditions that name some of the columns.

        A given 1 makes the others 0; if all but one are 0 the missing one is 1; otherwise
        the open columns are drawn from the column model and the largest becomes 1.
        """
        given = [c for c in self.columns if c in df.columns]
        open_columns = [c for c in self.columns if c not in given]
        if not open_columns:
            return df
        if not given:
            return self._with_columns(df)
        self.check_conditions(df)
        has_one = reduce(lambda a, b: a + b, [as_number(df, c) for c in given]) == 1.0
        if len(open_columns) == 1:
            return df.withColumn(open_columns[0], F.when(has_one, F.lit(0.0)).otherwise(F.lit(1.0)))
        if self.model is None:
            raise ValueError("fit the constraint before filling conditions that leave a choice")
        drawn = self.model.draw_given(df, given, open_columns, seed, id_col)
        best = argmax(F.array(*[F.col(f"`_draw_{c}`") for c in open_columns]))
        made = {
            c: F.when(has_one, F.lit(0.0)).otherwise(F.when(best == i, F.lit(1.0)).otherwise(F.lit(0.0)))
            for i, c in enumerate(open_columns)
        }
        return drawn.withColumns(made).drop(*[f"_draw_{c}" for c in open_columns])

    def complete(self, df):
        return self.fill(df)
