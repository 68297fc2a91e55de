"""Constraints given by the user's own expressions."""

from __future__ import annotations

import inspect
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ...functions.numbers import column
from .base import Constraint, resolve


class ColumnFormula(Constraint):
    """``column`` equals ``formula``: a SQL expression or a function ``DataFrame -> Column``.

    Equal, or both null. Encoded by dropping the column, rebuilt by computing it.
    """

    def __init__(self, column, formula, handling="transform", drop_column=True):
        self.column, self.drop_column = column, drop_column
        self.formula = resolve(formula) if isinstance(formula, str) and _is_path(formula) else formula
        self.columns = self.rebuilds = (column,)
        super().__init__(handling)

    def _value(self, df: DataFrame):
        return F.expr(self.formula) if isinstance(self.formula, str) else self.formula(df)

    def valid(self, df):
        value = self._value(df)
        return column(df, self.column).eqNullSafe(F.nanvl(value.cast("double"), F.lit(None).cast("double"))
                                                  if df.schema[self.column].dataType.typeName() in ("double", "float")
                                                  else value)

    def _transform(self, df):
        return df.drop(self.column) if self.drop_column else df

    def _reverse(self, df):
        return df.withColumn(self.column, self._value(df))


def _is_path(text: str) -> bool:
    parts = text.split(".")
    return len(parts) > 1 and all(p.isidentifier() for p in parts) and _importable(parts[0])


def _importable(module: str) -> bool:
    import importlib.util

    try:
        return importlib.util.find_spec(module) is not None
    except (ImportError, ValueError):
        return False


def _arity(function) -> int:
    return len([p for p in inspect.signature(function).parameters.values() if p.default is p.empty])


class Custom(Constraint):
    """User functions for encoding, rebuilding and checking.

    With ``columns``: ``Column -> Column`` or ``(DataFrame, name) -> DataFrame`` per column
    (rebuilding goes through the columns backwards). Without: ``DataFrame -> DataFrame``.
    ``is_valid`` returns a Column; the verdicts of several columns must all hold.
    """

    def __init__(self, columns=None, transform=None, reverse=None, is_valid=None):
        self.targets = [columns] if isinstance(columns, str) else list(columns or [])
        self._forward, self._backward, self._check = resolve(transform), resolve(reverse), resolve(is_valid)
        super().__init__("all")

    def applies_to(self, df):
        return set(self.targets) <= set(df.columns)

    def _run(self, function, df: DataFrame, names) -> DataFrame:
        if function is None:
            return df
        if not self.targets:
            return function(df)
        for name in names:
            df = function(df, name) if _arity(function) == 2 else df.withColumn(name, function(F.col(f"`{name}`")))
        return df

    def valid(self, df):
        if self._check is None:
            return F.lit(True)
        if not self.targets:
            verdict = self._check(df)
        else:
            two = _arity(self._check) == 2
            tests = [self._check(df, c) if two else self._check(F.col(f"`{c}`")) for c in self.targets]
            verdict = reduce(lambda a, b: a & b, tests)
        return F.coalesce(verdict, F.lit(False))

    def _transform(self, df):
        return self._run(self._forward, df, self.targets)

    def _reverse(self, df):
        return self._run(self._backward, df, list(reversed(self.targets)))
