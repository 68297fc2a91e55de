"""Everything a fit needs to know about its columns, gathered while the rows are written once.

Counts, ranges, quartiles, decimals, the test for yes/no numbers and the rows that break a constraint are aggregates that merge, so they
ride along with the write as observed metrics. The input, which may be an expensive query, is not read again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from ..functions.numbers import as_number, column, is_time
from ..session import materialize
from ..spec import TableSpec
from .encoders import decimals
from .mixture import _number

ACCURACY = 1000  # of the quartiles, as in the histograms
BROKEN = "_broken_"


@dataclass
class Summary:
    """What the metrics of some written rows say."""

    spec: TableSpec
    types: dict[str, T.DataType]
    values: dict

    @property
    def rows(self) -> int:
        return int(self.values["rows"])

    def discrete(self, name: str) -> bool:
        """Declared categories, text and booleans, and numbers that take both 0 and 1 and no other value."""
        f = self.spec[name]
        if f"zeros_{name}" in self.values:
            return self.values[f"zeros_{name}"] > 0 and self.values[f"ones_{name}"] > 0 and self.values[f"others_{name}"] == 0
        return f.type in ("categorical", "boolean")

    def range(self, name: str) -> tuple | None:
        """(first quartile, median, third quartile, least, largest); None without a value."""
        found = tuple(self.values[f"{k}_{name}"] for k in ("q1", "q2", "q3", "low", "high"))
        return None if found[3] is None else found

    def numeric(self, name: str) -> list:
        """Mean, least, largest and decimals, as a numeric encoder learns them."""
        return [self.values[f"{k}_{name}"] for k in ("mean", "low", "high", "digits")]

    def broken(self) -> dict[str, int]:
        """Rows that break each marked constraint, where there are any."""
        return {k[len(BROKEN):]: v for k, v in self.values.items() if k.startswith(BROKEN) and v}


def _aggregates(df: DataFrame, spec: TableSpec) -> dict[str, Column]:
    out = {"rows": F.count(F.lit(1))}
    for name in df.columns:
        if name.startswith(BROKEN):
            out[name] = F.count_if(F.col(f"`{name}`"))
    for f in spec.fields:
        dtype = df.schema[f.name].dataType
        if isinstance(dtype, T.NumericType) and f.type == "numerical":
            v = column(df, f.name)
            out |= {f"zeros_{f.name}": F.count_if(v == 0), f"ones_{f.name}": F.count_if(v == 1), f"others_{f.name}": F.count_if(~v.isin(0, 1))}
        if isinstance(dtype, T.NumericType) or is_time(dtype):
            x = _number(df, f.name)
            quartiles = {f"q{i}_{f.name}": F.percentile_approx(x, i / 4, ACCURACY) for i in (1, 2, 3)}
            out |= {**quartiles, f"low_{f.name}": F.min(x), f"high_{f.name}": F.max(x), f"mean_{f.name}": F.avg(x)}
        if isinstance(dtype, T.NumericType):
            out[f"digits_{f.name}"] = F.max(decimals(as_number(df, f.name)))
    return out


def write_observed(df: DataFrame, field_types: dict, tag: str = "rows") -> tuple[DataFrame, Summary]:
    """The rows, written, and what was seen of them on the way. Columns that start with ``BROKEN`` flag rows and are dropped."""
    flags = [c for c in df.columns if c.startswith(BROKEN)]
    spec = TableSpec.infer(df.drop(*flags), None, field_types)
    aggregates = _aggregates(df, spec)
    metrics = Observation()
    seen = df.observe(metrics, *[a.alias(f"m{i}") for i, a in enumerate(aggregates.values())])
    written = materialize(seen.drop(*flags), tag)
    found = metrics.get
    return written, Summary(spec, {f.name: f.dataType for f in written.schema.fields}, {n: found[f"m{i}"] for i, n in enumerate(aggregates)})
