"""Order constraints between columns and scalars."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ...functions.numbers import as_number, back_to, column, from_micros, is_time, literal, micros
from .base import Constraint, free_name


def _names(value) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


@dataclass(frozen=True)
class _Side:
    """One side of a comparison: a column, or a scalar read in the type of column ``like``."""

    value: object
    scalar: bool
    like: str | None = None

    def _type(self, df: DataFrame) -> T.DataType:
        return df.schema[self.like if self.scalar else self.value].dataType

    def is_time(self, df: DataFrame) -> bool:
        if self.scalar:
            return isinstance(self.value, (dt.date, dt.datetime))
        return is_time(df.schema[self.value].dataType)

    def raw(self, df: DataFrame) -> Column:
        """Value to compare; null means unknown."""
        if not self.scalar:
            return column(df, self.value)
        given = literal(self.value)
        return given.cast(self._type(df)) if self.is_time(df) and self.like in df.columns else given

    def number(self, df: DataFrame, time: bool) -> Column:
        """Double to calculate with; times count in microseconds."""
        if time:
            return micros(self.raw(df), self._type(df) if self.like in (None, *df.columns) else T.TimestampNTZType())
        return F.lit(float(self.value)) if self.scalar else as_number(df, self.value)


def _holds(low: Column, high: Column, strict: bool) -> Column:
    return F.coalesce(low < high if strict else low <= high, F.lit(True))


class GreaterThan(Constraint):
    """``high`` is at least ``low`` (above it if ``strict``); an unknown side passes.

    Either side may be several columns, and one side a scalar (``scalar='low'`` or
    ``'high'``). Encoded as ``ln(high - low + 1)`` per pair; times differ in nanoseconds.
    Rebuilding rounds the gap to a whole number, so fractions of a unit are lost.
    """

    learned = ("time", "types", "gap_names")

    def __init__(self, low, high, strict=False, handling="transform", fit_columns_model=False, drop=None, scalar=None):
        if scalar not in (None, "low", "high"):
            raise ValueError(f"scalar must be 'low', 'high' or None, not {scalar!r}")
        if scalar is not None and drop == scalar:
            raise ValueError(f"the {drop} side is a scalar and cannot be dropped")
        if drop not in (None, "low", "high"):
            raise ValueError(f"drop must be 'low', 'high' or None, not {drop!r}")
        if scalar is not None and isinstance(low if scalar == "low" else high, (list, tuple)):
            raise ValueError(f"`{scalar}` must be a single scalar")
        self.strict, self.drop, self.scalar = strict, drop, scalar
        self.low = [low] if scalar == "low" else _names(low)
        self.high = [high] if scalar == "high" else _names(high)
        if scalar is None and len(self.low) > 1 and len(self.high) > 1:
            raise ValueError("only one side may name several columns")
        self.columns = tuple(([] if scalar == "low" else self.low) + ([] if scalar == "high" else self.high))
        rebuild_low = drop == "low" or (drop is None and scalar == "high")
        self.target_side = "low" if rebuild_low else "high"
        self.targets = self.low if rebuild_low else self.high
        self.rebuilds = tuple(self.targets)
        super().__init__(handling, fit_columns_model)

    def _pairs(self) -> list[tuple[_Side, _Side]]:
        n = max(len(self.low), len(self.high))
        lows = self.low * (n if len(self.low) == 1 else 1)
        highs = self.high * (n if len(self.high) == 1 else 1)
        return [
            (_Side(a, self.scalar == "low", b if self.scalar == "low" else None),
             _Side(b, self.scalar == "high", a if self.scalar == "high" else None))
            for a, b in zip(lows, highs)
        ]

    def _time(self, df: DataFrame) -> bool:
        kinds = [side.is_time(df) for pair in self._pairs() for side in pair]
        if any(kinds) and not all(kinds):
            raise ValueError("low and high must both be times or both be numbers")
        return all(kinds)

    def _fit(self, df):
        for side in ("low", "high"):
            missing = set() if self.scalar == side else set(getattr(self, side)) - set(df.columns)
            if missing:
                raise KeyError(f'no columns {sorted(map(str, missing))} for the {side} side; a scalar needs scalar="{side}"')
        self.time = self._time(df)
        self.types = {c: df.schema[c].dataType for c in self.targets}
        base = None if self.scalar else (self.low if len(self.low) == 1 else self.high)[0]
        others = list(self.columns)
        if base is not None:
            others.remove(base)
        self.gap_names = [free_name([c, base or ""], df.columns) for c in others]

    def valid(self, df):
        self._time(df)
        tests = [_holds(lo.raw(df), hi.raw(df), self.strict) for lo, hi in self._pairs()]
        return reduce(lambda a, b: a & b, tests)

    def _transform(self, df):
        gaps = {}
        for (lo, hi), name in zip(self._pairs(), self.gap_names):
            gap = hi.number(df, self.time) - lo.number(df, self.time)
            gap = (gap * 1000).cast("double") if self.time else gap
            gaps[name] = F.when(gap > -1, F.ln(gap + 1))
        out = df.withColumns(gaps)
        return out.drop(*getattr(self, self.drop)) if self.drop else out

    def _reverse(self, df):
        rebuilt = {}
        pairs = list(zip(self._pairs(), self.gap_names))
        broken = None if self.drop else ~self.valid(df)
        for i, name in enumerate(self.targets):
            (lo, hi), gap_name = pairs[i]
            gap = F.greatest(F.rint(F.exp(as_number(df, gap_name))) - 1, F.lit(0.0))
            gap = F.when(as_number(df, gap_name).isNotNull(), gap)
            gap = F.rint(gap / 1000).try_cast("bigint") if self.time else gap
            known = hi if self.target_side == "low" else lo
            start = known.number(df, self.time)
            value = start - gap if self.target_side == "low" else start + gap
            dtype = self.types[name]
            value = from_micros(value, dtype) if self.time else back_to(value, dtype)
            rebuilt[name] = value if broken is None else F.when(broken, value).otherwise(F.col(f"`{name}`"))
        return df.withColumns(rebuilt).drop(*self.gap_names)


class Positive(GreaterThan):
    """The columns are at least zero (above zero if ``strict``)."""

    def __init__(self, columns, strict=False, handling="transform", fit_columns_model=False, drop=False):
        super().__init__(0, columns, strict, handling, fit_columns_model, "high" if drop else None, "low")


class Negative(GreaterThan):
    """The columns are at most zero (below zero if ``strict``)."""

    def __init__(self, columns, strict=False, handling="transform", fit_columns_model=False, drop=False):
        super().__init__(columns, 0, strict, handling, fit_columns_model, "low" if drop else None, "high")


class Between(Constraint):
    """``column`` lies between two bounds, each a scalar or another column.

    An unknown value passes, an unknown bound is open. Encoded by the logit of the
    position between the bounds, shrunk by 5 % so that the bounds stay finite.
    """

    learned = ("time", "type", "encoded", "low_is_scalar", "high_is_scalar")

    SPAN, EDGE = 0.95, 0.025  # fixed values of the encoding

    def __init__(self, column, low, high, strict=False, handling="transform", fit_columns_model=False,
                 high_is_scalar=None, low_is_scalar=None):
        self.column, self.low, self.high, self.strict = column, low, high, strict
        self.low_is_scalar, self.high_is_scalar = low_is_scalar, high_is_scalar
        self.columns = self.rebuilds = (column,)
        super().__init__(handling, fit_columns_model)

    def _side(self, df: DataFrame, which: str) -> _Side:
        value, scalar = getattr(self, which), getattr(self, f"{which}_is_scalar")
        if scalar is None:
            scalar = value not in df.columns
        return _Side(value, scalar, self.column if scalar else None)

    def _sides(self, df: DataFrame) -> tuple[_Side, _Side]:
        return self._side(df, "low"), self._side(df, "high")

    def _fit(self, df):
        low, high = self._sides(df)
        self.low_is_scalar, self.high_is_scalar = low.scalar, high.scalar
        kinds = [low.is_time(df), high.is_time(df), is_time(df.schema[self.column].dataType)]
        if any(kinds) and not all(kinds):
            raise ValueError("the column and its bounds must all be times or all be numbers")
        self.time = all(kinds)
        self.type = df.schema[self.column].dataType
        self.encoded = free_name([self.column, str(self.low), str(self.high)], df.columns)

    def valid(self, df):
        low, high = self._sides(df)
        value = column(df, self.column)
        return _holds(low.raw(df), value, self.strict) & _holds(value, high.raw(df), self.strict)

    def _transform(self, df):
        low, high = (s.number(df, self.time).cast("double") for s in self._sides(df))
        value = _Side(self.column, False).number(df, self.time)
        place = F.try_divide(value - low, high - low) * F.lit(self.SPAN) + F.lit(self.EDGE)
        return df.withColumn(self.encoded, F.ln(F.try_divide(place, F.lit(1.0) - place))).drop(self.column)

    def _reverse(self, df):
        low, high = (s.number(df, self.time).cast("double") for s in self._sides(df))
        code = as_number(df, self.encoded)
        place = (F.lit(1.0) / (F.lit(1.0) + F.exp(-code)) - F.lit(self.EDGE)) / F.lit(self.SPAN)
        value = F.when(code.isNotNull(), F.greatest(F.least(place * (high - low) + low, high), low))
        if self.time:
            value = from_micros(F.rint(value), self.type)
        elif isinstance(self.type, (T.DoubleType, T.FloatType)):
            value = value.cast(self.type)
        return df.withColumn(self.column, value).drop(self.encoded)
