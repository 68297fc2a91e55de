"""Reversible encoders: a column becomes a short vector of numbers and comes back.

All scalar statistics of a table come from one aggregation, all category tables from one
unpivoted count. Encoding and decoding a whole row is one projection, plus a lookup for the
encoders that keep their categories in a table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..errors import NotFittedError
from ..functions.numbers import as_number, back_to, column, from_micros, is_time, round_even, time_number
from ..functions.random import uniform
from ..functions.vectors import argmax, one_hot_index
from ..session import materialize
from ..spec import TableSpec
from .frequency import text_of
from .intervals import build_guide, cumulative, pick
from .joins import lookup
from .ordinals import dense_index

MAX_DECIMALS = 15  # fixed value: decimals looked at when learning the rounding


class Encoder:
    """Base class; users may add their own and name it per field.

    ``statistics`` lists aggregates, ``learn`` receives their values; encoders with
    ``uses_categories`` receive the table (value, n, first_at) of their column.
    """

    kind = "tanh"
    width = 1
    uses_categories = False

    def bind(self, df: DataFrame, name: str) -> Encoder:
        self.name, self.type = name, df.schema[name].dataType
        return self

    def statistics(self, df: DataFrame) -> list[Column]:
        return []

    def learn(self, values: list) -> None:
        pass

    def learn_categories(self, table: DataFrame) -> None:
        pass

    def fit(self, df: DataFrame, name: str, order_by: str | None = None) -> Encoder:
        fit_encoders(df, {name: self}, order_by)
        return self

    def encode(self, df: DataFrame, out: str, ids: list[str] = ()) -> DataFrame:
        """Add the vector of the column as ``out``."""
        return df.withColumn(out, self.encoded(df))

    def decode(self, df: DataFrame, vector: str, out: str) -> DataFrame:
        """Add the value read back from the vector."""
        return df.withColumn(out, self.decoded(F.col(vector)))

    def encoded(self, df: DataFrame) -> Column:
        raise NotImplementedError

    def decoded(self, vector: Column) -> Column:
        raise NotImplementedError


def decimals(value: Column) -> Column:
    """Number of decimals of a double, up to 15."""
    text = value.try_cast(f"decimal(38,{MAX_DECIMALS})").cast("string")
    return F.length(F.regexp_replace(F.coalesce(F.get(F.split(text, r"\."), F.lit(1)), F.lit("")), "0+$", ""))


class Numeric(Encoder):
    """A number; null becomes the mean. Decoding clips and rounds.

    ``rounding``, ``minimum``, ``maximum``: ``'auto'`` learns them, a number fixes them,
    None leaves the value alone.
    """

    def __init__(self, rounding="auto", minimum="auto", maximum="auto"):
        self.rounding, self.minimum, self.maximum = rounding, minimum, maximum
        self.mean = None

    def statistics(self, df):
        v = as_number(df, self.name)
        return [F.avg(v), F.min(v), F.max(v), F.max(decimals(v)) if self.rounding == "auto" else F.lit(None)]

    def learn(self, values):
        mean, low, high, digits = values
        self.mean = 0.0 if mean is None else float(mean)
        self.low = low if self.minimum == "auto" else self.minimum
        self.high = high if self.maximum == "auto" else self.maximum
        self.digits = digits if self.rounding == "auto" else self.rounding

    def encoded(self, df):
        if self.mean is None:
            raise NotFittedError(f"encoder of {self.name} has not been fitted")
        return F.array(F.coalesce(as_number(df, self.name), F.lit(self.mean)))

    def decoded(self, vector):
        value = vector[0]
        if self.low is not None:
            value = F.greatest(value, F.lit(float(self.low)))
        if self.high is not None:
            value = F.least(value, F.lit(float(self.high)))
        if self.digits is not None:
            value = round_even(value, int(self.digits))
        elif isinstance(self.type, T.IntegralType):
            value = F.rint(value)
        return back_to(value, self.type)


class BinaryEnc(Encoder):
    """A yes/no value as 0 or 1; null becomes the more frequent one."""

    def statistics(self, df):
        v = as_number(df, self.name)
        return [F.count_if(v >= 0.5), F.count_if(v < 0.5)]

    def learn(self, values):
        self.mode = 1.0 if values[0] > values[1] else 0.0

    def encoded(self, df):
        return F.array(F.coalesce(as_number(df, self.name), F.lit(self.mode)))

    def decoded(self, vector):
        value = F.least(F.greatest(F.rint(vector[0]), F.lit(0.0)), F.lit(1.0))
        return (value == 1.0) if isinstance(self.type, T.BooleanType) else back_to(value, self.type)


class UnixTs(Encoder):
    """A time as nanoseconds since 1970; null becomes the mean."""

    mean = None

    def statistics(self, df):
        # decimal: an exact sum that does not depend on the order of the rows
        return [F.avg(time_number(df, self.name).cast("decimal(20,0)"))]

    def learn(self, values):
        self.mean = float(values[0] or 0.0)

    def encoded(self, df):
        return F.array(F.coalesce(time_number(df, self.name).cast("double"), F.lit(self.mean)) * 1000.0)

    def decoded(self, vector):
        return from_micros(F.rint(vector[0] / 1000.0), self.type)


class LabelEnc(Encoder):
    """The position of the category in order of appearance; any number of categories."""

    uses_categories = True

    def learn_categories(self, table):
        self.table = materialize(dense_index(table, ["first_at", "value"], "code").select("value", "code"), "codes")

    def encode(self, df, out, ids=()):
        keyed = df.withColumn("value", text_of(df, self.name))
        found = lookup(keyed, self.table, ["value"], null_safe=True)
        return found.withColumn(out, F.array(F.col("code").cast("double"))).drop("value", "code")

    def decode(self, df, vector, out):
        keyed = df.withColumn("code", F.rint(F.col(vector)[0]).cast("bigint"))
        found = lookup(keyed, self.table, ["code"])
        return found.withColumn(out, F.col("value").cast(self.type)).drop("value", "code")


class OneHotEnc(LabelEnc):
    """One place per category, in order of appearance; an unseen value is all zero.

    The categories stay in a table of (value, code), so the plan does not grow with their number.
    """

    kind = "softmax"

    def learn_categories(self, table):
        super().learn_categories(table)
        self.width = self.table.count()

    def encode(self, df, out, ids=()):
        if not self.width:
            return df.withColumn(out, F.array().cast("array<double>"))
        coded = super().encode(df, "_code", ids)
        return coded.withColumn(out, one_hot_index(F.coalesce(F.col("_code")[0], F.lit(-1.0)).cast("int"), self.width)).drop("_code")

    def decode(self, df, vector, out):
        best = df.withColumn("_best", F.array(argmax(F.col(vector)).cast("double")))
        return super().decode(best, "_best", out).drop("_best")


class UniformCat(Encoder):
    """A number drawn inside the category's interval, as wide as its frequency."""

    uses_categories = True

    def __init__(self, seed: int = 0):
        self.seed = seed

    def learn_categories(self, table):
        self.bounds = materialize(cumulative(table, [], ["value"]).select("value", "lo", "hi"), "bounds")
        self.guide = build_guide(self.bounds, [])

    def encode(self, df, out, ids=()):
        if not ids:
            raise ValueError("UniformCat draws a number per row and needs the row's id columns")
        keyed = df.withColumn("value", text_of(df, self.name))
        found = lookup(keyed, self.bounds, ["value"], null_safe=True, salt_by=list(ids))
        u = uniform(self.seed, f"cat/{self.name}", *ids)
        return found.withColumn(out, F.array(F.col("lo") + u * (F.col("hi") - F.col("lo")))).drop("value", "lo", "hi")

    def decode(self, df, vector, out):
        # keep the number inside [0, 1): noise or the upper bound must still find a category
        u = F.least(F.greatest(F.col(vector)[0], F.lit(0.0)), F.lit(1.0 - 2.0**-53))
        return pick(df, self.guide, u, how="left").withColumn(out, F.col("value").cast(self.type)).drop("value")


def fit_encoders(df: DataFrame, encoders: dict[str, Encoder], order_by: str | None = None) -> dict[str, Encoder]:
    """Fit all encoders with one aggregation and, if any is categorical, one unpivoted count.

    ``order_by`` defines the order of appearance; without it categories are sorted by value.
    """
    slots, aggs = [], []
    for name, e in encoders.items():
        e.bind(df, name)
        own = e.statistics(df)
        slots.append((e, len(aggs), len(own)))
        aggs += [a.alias(f"a{len(aggs) + i}") for i, a in enumerate(own)]
    if aggs:
        row = list(df.agg(*aggs).first())
        for e, start, n in slots:
            if n:
                e.learn(row[start : start + n])
    named = [n for n, e in encoders.items() if e.uses_categories]
    if named:
        entries = [F.struct(F.lit(c).alias("column"), text_of(df, c).alias("value")) for c in named]
        first = F.col(order_by) if order_by else F.lit(0)
        flat = df.select(first.alias("_order"), F.inline(F.array(*entries)))
        table = flat.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.min("_order").alias("first_at"))
        table = materialize(table, "categories")
        for n in named:
            encoders[n].learn_categories(table.filter(F.col("column") == n).drop("column"))
    return encoders


def default_encoder(dtype: T.DataType) -> Encoder:
    """Encoder by type: one-hot text, 0/1 booleans, nanosecond times, plain numbers."""
    if isinstance(dtype, T.StringType):
        return OneHotEnc()
    if isinstance(dtype, T.BooleanType):
        return BinaryEnc()
    if is_time(dtype):
        return UnixTs()
    if isinstance(dtype, T.NumericType):
        return Numeric()
    raise ValueError(f"no encoder for the type {dtype.simpleString()}")


# fixed values: names under which a field may ask for an encoder
NAMED = {
    "integer": Numeric, "float": Numeric, "categorical": UniformCat, "categorical_fuzzy": UniformCat,
    "one_hot_encoding": OneHotEnc, "label_encoding": LabelEnc, "boolean": BinaryEnc, "datetime": UnixTs,
}


def choose_encoders(df: DataFrame, spec: TableSpec, extra: list[str] = ()) -> dict[str, Encoder]:
    """One encoder per modelled column: the field's own, else by type; columns added by
    constraints are included."""
    chosen = {}
    for name in [n for n in spec.names(ids=False) if n in df.columns] + list(extra):
        asked = spec[name].encoder if name in spec else None
        if asked is None:
            chosen[name] = default_encoder(df.schema[name].dataType)
        elif isinstance(asked, str):
            chosen[name] = NAMED[asked]()
        else:
            chosen[name] = asked() if isinstance(asked, type) else asked
    return chosen


@dataclass
class Span:
    column: str
    kind: str
    start: int
    width: int


def layout(encoders: dict[str, Encoder]) -> list[Span]:
    """Where each column sits in the row vector."""
    spans, start = [], 0
    for name, e in encoders.items():
        spans.append(Span(name, e.kind, start, e.width))
        start += e.width
    return spans


def encode(df: DataFrame, encoders: dict[str, Encoder], name: str = "vector", ids: list[str] = (), keep: list[str] = ()) -> DataFrame:
    """The whole row as one vector; columns in ``keep`` stay beside it."""
    out = df
    for i, e in enumerate(encoders.values()):
        out = e.encode(out, f"_v{i}", list(ids))
    parts = [F.col(f"`_v{i}`") for i in range(len(encoders))]
    return out.select(*[F.col(f"`{c}`") for c in keep], F.concat(*parts).alias(name))


def decode(df: DataFrame, encoders: dict[str, Encoder], name: str = "vector") -> DataFrame:
    """Columns read back from the row vector, with their original types."""
    out = df
    keep = [c for c in df.columns if c != name and c not in encoders]
    for i, span in enumerate(layout(encoders)):
        out = out.withColumn(f"_v{i}", F.slice(F.col(f"`{name}`"), span.start + 1, span.width))
    for i, (c, e) in enumerate(encoders.items()):
        out = e.decode(out, f"_v{i}", c)
    return out.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{c}`") for c in encoders])


def argmax_decode(df: DataFrame, columns: list[str], name: str = "winner") -> DataFrame:
    """Name of the column with the largest score; the first one wins a tie."""
    best = argmax(F.array(*[column(df, c) for c in columns]))
    return df.withColumn(name, F.element_at(F.array(*[F.lit(c) for c in columns]), best + 1))
