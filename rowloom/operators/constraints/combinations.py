"""Only combinations of values that were seen in the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ...errors import NotFittedError
from ...functions.numbers import column
from ...session import materialize
from ..joins import lookup
from .base import Constraint, free_name


def combination_key(df: DataFrame, columns) -> F.Column:
    """Key of a combination: a hash of the values in which null differs from every text."""
    parts = []
    for c in columns:
        text = column(df, c).cast("string")
        parts.append(F.when(text.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.length(text), F.lit(":"), text)))
    return F.sha2(F.concat_ws("|", *parts), 256)


class UniqueCombinations(Constraint):
    """The combination of ``columns`` occurs in the fitted data. Null equals null.

    Encoded as one key column per combination; unseen combinations become null.
    """

    learned = ("joint", "table")

    row_local = False

    def __init__(self, columns, handling="transform", fit_columns_model=False):
        if len(columns) < 2:
            raise ValueError("a combination needs two or more columns")
        self.columns = self.rebuilds = tuple(columns)
        self.table = None
        super().__init__(handling, fit_columns_model)

    def _fit(self, df):
        self.joint = free_name(list(self.columns), df.columns)
        seen = df.select(*[column(df, c).alias(c) for c in self.columns]).distinct()
        self.table = materialize(seen.withColumn(self.joint, combination_key(seen, self.columns)), "combinations")

    def _learned(self) -> DataFrame:
        if self.table is None:
            raise NotFittedError("UniqueCombinations has not seen any data")
        return self.table

    def _key(self, df: DataFrame, name: str) -> DataFrame:
        table = self._learned().withColumnRenamed(self.joint, name)
        return lookup(df, table, list(self.columns), null_safe=True)

    def flag(self, df, name="is_valid"):
        return self._key(df, "_joint").withColumn(name, F.col("_joint").isNotNull()).drop("_joint")

    def count_invalid(self, df):
        # distinct combinations are counted first, so rows do not take part in the join
        own = df.select(*[column(df, c).alias(c) for c in self.columns])
        counts = own.groupBy(*self.columns).agg(F.count(F.lit(1)).alias("_n"))
        missed = lookup(counts, self._learned(), list(self.columns), how="left_anti", null_safe=True)
        return missed.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("invalid"))

    def _keep(self, df):
        return lookup(df, self._learned(), list(self.columns), how="left_semi", null_safe=True)

    def _transform(self, df):
        return self._key(df, self.joint).drop(*self.columns)

    def _reverse(self, df):
        return lookup(df, self._learned(), [self.joint]).drop(self.joint)
