"""One row per key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ...functions.numbers import column
from .base import Constraint


class Unique(Constraint):
    """The first row of each key, in the order of ``order_by``, is valid; a null key never is.

    ``order_by`` names columns that order the rows totally; a DataFrame has no order of its own.
    """

    row_local = False

    def __init__(self, columns, order_by):
        self.keys = [columns] if isinstance(columns, str) else list(columns)
        self.order_by = [order_by] if isinstance(order_by, str) else list(order_by)
        super().__init__("reject_sampling")

    def applies_to(self, df):
        return set(self.keys) <= set(df.columns)

    def _known(self, df: DataFrame):
        return reduce(lambda a, b: a & b, [column(df, c).isNotNull() for c in self.keys])

    def _keep(self, df):
        # a filter on row_number() = 1 keeps one row per key before the shuffle already,
        # so a key with a third of the rows does not travel to one task
        w = Window.partitionBy(*self.keys).orderBy(*self.order_by)
        return df.filter(self._known(df)).withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")

    def count_invalid(self, df):
        # rows minus known keys; counting per key combines before the shuffle
        counts = df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_n"))
        kept = F.count_if(self._known(counts))
        return counts.agg((F.coalesce(F.sum("_n"), F.lit(0)) - kept).alias("invalid"))

    def flag(self, df, name="is_valid"):
        # the first order value per key combines on the map side; the join back is on
        # (key, order), which no hot key can make uneven. Rows equal in both are numbered
        # inside that same partitioning, so that only one of them counts as first
        first = df.filter(self._known(df)).groupBy(*self.keys).agg(
            F.min(F.struct(*self.order_by)).alias("_first")
        )
        columns = df.columns
        twins = Window.partitionBy(*self.keys, *self.order_by).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in columns]))
        df = df.withColumn("_twin", F.row_number().over(twins))
        side = first.select(
            *[F.col(f"`{c}`").alias(f"_k_{c}") for c in self.keys],
            *[F.col(f"_first.`{c}`").alias(f"_o_{c}") for c in self.order_by],
            F.lit(True).alias(name),
        )
        test = [df[c] == side[f"_k_{c}"] for c in self.keys]
        test += [df[c].eqNullSafe(side[f"_o_{c}"]) for c in self.order_by]
        out = df.join(side, reduce(lambda a, b: a & b, test), "left")
        verdict = F.coalesce(name, F.lit(False)) & (F.col("_twin") == 1)
        return out.select(*[F.col(f"`{c}`") for c in columns], verdict.alias(name))
