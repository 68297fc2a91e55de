"""Column model of a constraint: a joint normal distribution over a few columns.

The fit is two aggregations over the assembled vectors. Conditioning is linear in the given values, so all conditions
are drawn in one projection instead of one solve per condition.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.numbers import as_number, back_to, column, from_micros, is_time, time_number
from ..functions.random import normal
from ..functions.vectors import argmax
from ..session import materialize
from .factors import FactorModel

MODEL_WIDTH = 512  # the driver inverts a matrix of this order at most; wider models are factored
ROUNDS = 100  # fixed value: attempts to complete a condition
ROUND_FACTOR = 10  # fixed value: candidates per wanted row in one round


def copula_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and deviation of two columns and their correlation, for every pair, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    numbers = df.select(*[as_number(df, c).alias(c) for c in columns])
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    aggs += [F.corr(a, b).alias(f"r_{a}_{b}") for a, b in pairs]
    one = numbers.agg(*aggs)
    rows = F.array(*[
        F.struct(
            F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`m_{a}`").alias("mean_a"), F.col(f"`m_{b}`").alias("mean_b"),
            F.col(f"`s_{a}`").alias("std_a"), F.col(f"`s_{b}`").alias("std_b"), F.col(f"`r_{a}_{b}`").alias("corr"),
        )
        for a, b in pairs
    ])
    return one.select(F.inline(rows))


def draw_normal(mean: list[Column], factor: np.ndarray, seed: int, stream: str, *ids) -> list[Column]:
    """``mean + factor @ z`` with independent standard normals ``z`` of the row."""
    z = [normal(seed, f"{stream}/{j}", *ids) for j in range(factor.shape[1])]
    out = []
    for i, m in enumerate(mean):
        value = m
        for j in range(factor.shape[1]):
            if factor[i, j] != 0.0:
                value = value + F.lit(float(factor[i, j])) * z[j]
        out.append(value)
    return out


def root(matrix: np.ndarray) -> np.ndarray:
    """A factor L with L @ L.T = matrix, also for singular matrices."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    return vectors * np.sqrt(np.clip(values, 0.0, None))


@dataclass
class _Dim:
    column: str
    category: object = None


class Copula:
    """Normal margins plus correlation, over numeric, time and one-hot encoded columns."""

    def __init__(self, columns, types, dims, mean, cov):
        self.columns, self.types, self.dims = columns, types, dims
        self.mean, self.cov = np.asarray(mean, float), np.asarray(cov, float)

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str]) -> Copula | FactorModel:
        """A full covariance up to ``MODEL_WIDTH`` dimensions, a factored one beyond."""
        types = {c: df.schema[c].dataType for c in columns}
        dims: list[_Dim] = []
        for c in columns:
            if isinstance(types[c], (T.StringType, T.BooleanType)):
                top = df.groupBy(c).count().orderBy(F.desc("count"), c).limit(MODEL_WIDTH + 1).collect()
                dims += [_Dim(c, (r[c],)) for r in top]
            else:
                dims.append(_Dim(c))
        if len(dims) > MODEL_WIDTH:
            return FactorModel.fit(df, columns)
        model = cls(columns, types, dims, np.zeros(len(dims)), np.zeros((len(dims), len(dims))))
        means = df.agg(*[F.avg(model._raw(df, d)).alias(f"m{i}") for i, d in enumerate(dims)]).first()
        mean = [float(v) if v is not None else 0.0 for v in means]
        full = F.array(*[F.coalesce(model._raw(df, d), F.lit(m)) for d, m in zip(dims, mean)])
        vectors = df.select(array_to_vector(full).alias("v"))
        spread = np.sqrt(vectors.select(Summarizer.variance(F.col("v")).alias("s")).first()["s"].toArray())
        corr = np.nan_to_num(Correlation.corr(vectors, "v").first()[0].toArray())
        np.fill_diagonal(corr, 1.0)
        model.cov = corr * np.outer(spread, spread)
        model.mean = np.asarray(mean)
        return model

    def _raw(self, df: DataFrame, dim: _Dim) -> Column:
        dtype = self.types[dim.column]
        if dim.category is not None:
            return column(df, dim.column).eqNullSafe(F.lit(dim.category[0])).cast("double")
        if is_time(dtype):
            return time_number(df, dim.column).cast("double")
        return as_number(df, dim.column)

    def _of(self, names) -> list[int]:
        return [i for i, d in enumerate(self.dims) if d.column in set(names)]

    def conditional(self, given: list[str], wanted: list[str]):
        """(weights, factor): wanted mean = mean + weights @ (given - mean of given)."""
        o, m = self._of(given), self._of(wanted)
        weights = self.cov[np.ix_(m, o)] @ np.linalg.pinv(self.cov[np.ix_(o, o)])
        rest = self.cov[np.ix_(m, m)] - weights @ self.cov[np.ix_(o, m)]
        return weights, root(rest)

    def _draw(self, df: DataFrame, given, wanted, seed: int, ids) -> dict[int, Column]:
        o, m = self._of(given), self._of(wanted)
        weights, factor = self.conditional(given, wanted)
        known = [F.coalesce(self._raw(df, self.dims[i]), F.lit(float(self.mean[i]))) for i in o]
        mean = []
        for r, i in enumerate(m):
            value = F.lit(float(self.mean[i]))
            for k, j in enumerate(o):
                value = value + F.lit(float(weights[r, k])) * (known[k] - F.lit(float(self.mean[j])))
            mean.append(value)
        return dict(zip(m, draw_normal(mean, factor, seed, "copula", *ids)))

    def draw_given(self, df: DataFrame, given, wanted, seed: int = 0, id_col: str | None = None) -> DataFrame:
        """Add raw draws ``_draw_<column>`` of numeric columns given other columns of the row."""
        if id_col is None:  # written, so that a repeated task draws the same numbers
            df = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
        drawn = self._draw(df, given, wanted, seed, [id_col or "_row"])
        out = df.withColumns({f"_draw_{self.dims[i].column}": v for i, v in drawn.items()})
        return out.drop("_row") if id_col is None else out

    def sample_given(self, df: DataFrame, given, wanted, seed: int, ids) -> DataFrame:
        """Add decoded draws of ``wanted`` given the row's ``given`` columns."""
        drawn = self._draw(df, given, wanted, seed, ids)
        scored = df.withColumns({f"_dim{i}": v for i, v in drawn.items()})
        made = {}
        for c in wanted:
            own, dtype = self._of([c]), self.types[c]
            if self.dims[own[0]].category is not None:
                best = argmax(F.array(*[F.col(f"`_dim{i}`") for i in own])) + 1
                made[c] = F.element_at(F.array(*[F.lit(self.dims[i].category[0]).cast(dtype) for i in own]), best)
            elif is_time(dtype):
                made[c] = from_micros(F.rint(F.col(f"`_dim{own[0]}`")), dtype)
            elif isinstance(dtype, T.IntegralType):
                made[c] = back_to(F.rint(F.col(f"`_dim{own[0]}`")), dtype)
            else:
                made[c] = F.col(f"`_dim{own[0]}`").cast(dtype)
        return scored.withColumns(made).drop(*[f"_dim{i}" for i in drawn])


def complete_conditions(conditions: DataFrame, constraint, seed: int = 0, id_col: str | None = None,
                        rounds: int = ROUNDS) -> DataFrame:
    """Fill the constraint columns that ``conditions`` leave out, so that the constraint holds.

    Every condition row makes its own attempts, so no condition that occurs very often
    becomes a large group. Rows still open after the last round reuse completed rows of the
    same condition; a condition without any completed row is an error.
    """
    from .ordinals import dense_index
    from .sampling import draw_members

    names = conditions.columns
    given = [c for c in constraint.columns if c in names]
    wanted = [c for c in constraint.columns if c not in names]
    if id_col is None:
        placed = materialize(conditions.withColumn("_place", F.monotonically_increasing_id()), "placed")  # splits equal rows
        keyed = dense_index(placed, [*names, "_place"], "_cond").drop("_place")
        keyed = materialize(keyed, "conditions")
    else:
        keyed = conditions.withColumn("_cond", F.col(f"`{id_col}`").cast("bigint"))
    pending, done, first, tried, found = keyed, [], 0, 0, 0
    for _ in range(rounds):
        waiting = pending.count()
        if not waiting:
            break
        per_row = min(ROUND_FACTOR, max(1, int((tried + 1) / (found + 1))))
        tries = pending.withColumn("_try", F.explode(F.sequence(F.lit(first), F.lit(first + per_row - 1))))
        drawn = constraint.model.sample_given(tries, given, wanted, seed, ["_cond", "_try"])
        good = constraint._keep(drawn)
        best = good.groupBy("_cond").agg(F.min_by(F.struct(*wanted), "_try").alias("_v"))
        best = materialize(best.select("_cond", "_v.*"), "completed")
        done.append(best)
        first, tried, found = first + per_row, tried + waiting * per_row, found + best.count()
        pending = materialize(pending.join(best, "_cond", "left_anti"), "pending")
    filled = done[0]
    for part in done[1:]:
        filled = filled.unionByName(part)
    completed = keyed.join(filled, "_cond")
    left = pending.count()
    if left:
        completed = materialize(completed, "completed")
        spare = draw_members(completed, given, ["_cond"], pending.select("_cond", *given), ["_cond"], seed, prefix="_from")
        extra = pending.join(spare.select("_cond", "_from__cond"), "_cond").join(
            completed.select(F.col("_cond").alias("_from__cond"), *wanted), "_from__cond"
        )
        if extra.count() < left:
            raise ValueError(f"some conditions have no completion after {rounds} rounds")
        completed = completed.unionByName(extra.select(*completed.columns))
    return completed.select(*names, *wanted)
