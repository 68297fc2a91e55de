"""Mixture normaliser: a number becomes (position inside its component, component).

The full-data part of the fit is one histogram pass for all columns. The expectation
maximisation then runs on at most a few thousand bins per column.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import as_number, back_to, from_micros, is_time, time_number
from ..functions.random import normal, uniform
from ..functions.vectors import argmax, number_array, one_hot_index
from .encoders import Encoder

MAX_CLUSTERS = 10  # fixed values of the normaliser
WEIGHT_THRESHOLD = 0.005
SPREAD = 4.0
CLIP = 0.99
FLOOR = 1e-6
BINS = 2000
ITERATIONS = 200


@dataclass
class Mixture:
    means: list[float]
    stds: list[float]
    weights: list[float]

    @property
    def size(self) -> int:
        return len(self.means)


def number_ranges(df: DataFrame, columns: list[str]) -> dict[str, tuple | None]:
    """(first quartile, median, third quartile, least, largest) of every column in one pass; None for a column without values."""
    values = df.select(*[_number(df, c).alias(c) for c in columns])
    aggs = []
    for c in columns:
        quartiles = F.percentile_approx(c, [0.25, 0.5, 0.75], 1000)
        aggs += [quartiles.alias(f"q_{c}"), F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}")]
    row = values.agg(*aggs).first()
    return {c: None if row[f"lo_{c}"] is None else (*row[f"q_{c}"], row[f"lo_{c}"], row[f"hi_{c}"]) for c in columns}


def histogram(df: DataFrame, columns: list[str], bins: int = BINS, ranges: dict[str, tuple | None] | None = None) -> DataFrame:
    """(column, bin, n, total, squares) of all columns in one pass, after one range pass where the ``ranges`` are not known.

    Bins are equal on an asinh scale around the median, so long tails do not swallow the
    body of the distribution.
    """
    ranges = number_ranges(df, columns) if ranges is None else ranges
    values = df.select(*[_number(df, c).alias(c) for c in columns])
    entries = []
    for c in columns:
        if ranges[c] is None:
            continue
        q1, mid, q3, least, largest = ranges[c]
        scale = (q3 - q1) or (largest - least) or 1.0
        lo, hi = (float(np.arcsinh((v - mid) / scale)) for v in (least, largest))
        place = F.asinh((F.col(f"`{c}`") - F.lit(mid)) / F.lit(scale))
        width = (hi - lo) or 1.0
        number = F.least(F.floor((place - F.lit(lo)) / F.lit(width) * bins), F.lit(bins - 1)).cast("int")
        entries.append(F.struct(F.lit(c).alias("column"), number.alias("bin"), F.col(f"`{c}`").alias("x")))
    flat = values.select(F.inline(F.array(*entries))).filter(F.col("x").isNotNull())
    return flat.groupBy("column", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"), F.sum(F.col("x") * F.col("x")).alias("squares")
    )


def _number(df: DataFrame, name: str) -> Column:
    return time_number(df, name).cast("double") if is_time(df.schema[name].dataType) else as_number(df, name)


def _em(pdf: pd.DataFrame, clusters: int, threshold: float, iterations: int = ITERATIONS) -> pd.DataFrame:
    pdf = pdf.sort_values("bin")
    n = pdf["n"].to_numpy(float)
    x = pdf["total"].to_numpy(float) / n
    inner = np.maximum(pdf["squares"].to_numpy(float) / n - x * x, 0.0)
    rows = n.sum()
    spread = np.sqrt(max(np.average((x - np.average(x, weights=n)) ** 2 + inner, weights=n), 1e-24))
    k = int(min(clusters, rows, len(x)))
    upto = np.cumsum(n) / rows
    means = x[np.searchsorted(upto, (np.arange(k) + 0.5) / k)]
    stds = np.full(k, spread / max(k, 1) + 1e-12)
    weights = np.full(k, 1.0 / k)
    tiny = (spread * 1e-4 + 1e-12) ** 2
    converged = False
    for _ in range(iterations):
        logs = np.log(weights) - np.log(stds) - 0.5 * ((x[:, None] - means) ** 2 + inner[:, None]) / stds**2
        resp = np.exp(logs - logs.max(axis=1, keepdims=True))
        resp = resp / resp.sum(axis=1, keepdims=True) * n[:, None]
        mass = np.maximum(resp.sum(axis=0), 1e-12)
        new_means = (resp * x[:, None]).sum(axis=0) / mass
        var = (resp * ((x[:, None] - new_means) ** 2 + inner[:, None])).sum(axis=0) / mass
        moved = np.abs(new_means - means).max()
        means, stds, weights = new_means, np.sqrt(np.maximum(var, tiny)), mass / mass.sum()
        if moved < spread * 1e-7:
            converged = True
            break
    keep = weights > threshold
    weights = weights[keep] / weights[keep].sum()
    order = np.argsort(means[keep], kind="stable")
    return pd.DataFrame({
        "column": pdf["column"].iloc[0], "component": np.arange(keep.sum()),
        "mean": means[keep][order], "std": stds[keep][order], "weight": weights[order], "converged": converged,
    })


def mixture_table(df: DataFrame, columns: list[str], max_clusters: int = MAX_CLUSTERS,
                  weight_threshold: float = WEIGHT_THRESHOLD, bins: int = BINS, iterations: int = ITERATIONS,
                  ranges: dict[str, tuple | None] | None = None) -> DataFrame:
    """(column, component, mean, std, weight, converged): fitted components of every column.

    Each task of the grouped step sees the at most ``bins`` bins of one column. ``converged`` is false where the means still
    moved after ``iterations`` steps.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        return _em(pdf, max_clusters, weight_threshold, iterations)

    return histogram(df, columns, bins, ranges).groupBy("column").applyInPandas(
        fit, "column string, component int, mean double, std double, weight double, converged boolean"
    )


def fit_mixtures(df: DataFrame, columns: list[str], **kwargs) -> dict[str, Mixture]:
    """Components by column, on the driver: at most ten per column."""
    return read_mixtures(mixture_table(df, columns, **kwargs), columns) if columns else {}


def read_mixtures(table: DataFrame, columns: list[str]) -> dict[str, Mixture]:
    """The fitted components (column, component, mean, std, weight, converged) by column."""
    found: dict[str, list] = {c: [] for c in columns}
    for r in table.collect():
        found[r["column"]].append(r)
    out = {}
    for c, rows in found.items():
        rows = sorted(rows, key=lambda r: r["component"])
        if not all(r["converged"] for r in rows):
            warnings.warn(f"the mixture of {c} has not converged", stacklevel=3)
        out[c] = Mixture([r["mean"] for r in rows], [r["std"] for r in rows], [r["weight"] for r in rows])
    return out


def _log_density(value: Column, mix: Mixture, i: int) -> Column:
    start = float(np.log(mix.weights[i]) - np.log(mix.stds[i]))
    return F.lit(start) - F.lit(0.5) * F.pow((value - F.lit(mix.means[i])) / F.lit(mix.stds[i]), F.lit(2.0))


def with_probabilities(df: DataFrame, value: Column, mix: Mixture, prefix: str) -> DataFrame:
    """Add ``<prefix>0..``: floored probabilities that the value belongs to each component.

    ``1 / sum_j exp(l_j - l_i)`` needs no common maximum, so the expressions stay small and
    inside generated code; an overflow to infinity gives probability zero, as it should.
    """
    k = range(mix.size)
    df = df.withColumns({f"{prefix}l{i}": _log_density(value, mix, i) for i in k})
    made = {}
    for i in k:
        total = F.lit(1.0)
        for j in k:
            if j != i:
                total = total + F.exp(F.col(f"{prefix}l{j}") - F.col(f"{prefix}l{i}"))
        made[f"{prefix}{i}"] = (F.lit(1.0) / total + F.lit(FLOOR)) / F.lit(1.0 + mix.size * FLOOR)
    return df.withColumns(made).drop(*[f"{prefix}l{i}" for i in k])


def draw_component(value: Column, mix: Mixture, seed: int, stream: str, ids) -> Column:
    """Component of a value, drawn by the floored probabilities, as one small expression.

    The largest of ``log density + Gumbel noise`` is a draw by the plain probabilities. The
    floor adds the same small amount to every component, which is a rare uniform draw.
    """
    k = mix.size
    if k == 1:
        return F.lit(0)
    scores = F.array(*[
        _log_density(value, mix, i) - F.ln(-F.ln(uniform(seed, f"{stream}/{i}", *ids))) for i in range(k)
    ])
    rare = F.lit(k * FLOOR / (1.0 + k * FLOOR))
    u = uniform(seed, stream, *ids)
    return F.when(u < rare, F.least(F.floor(u / rare * k), F.lit(k - 1)).cast("int")).otherwise(argmax(scores))


def transform_mixture(df: DataFrame, name: str, mix: Mixture, seed: int, ids: list[str], out: str,
                      mean: float | None = None) -> DataFrame:
    """Add ``out`` = [z, one-hot component]; the component is drawn by its probability.

    ``z = (x - mean) / (4 std)`` clipped to ±0.99. A null is treated as the column's mean.
    """
    value = _number(df, name)
    if mean is not None:
        value = F.coalesce(value, F.lit(mean))
    drawn = df.withColumn("_x", value)
    drawn = drawn.withColumn("_c", draw_component(F.col("_x"), mix, seed, f"component/{name}", ids))
    centre, spread = (F.element_at(number_array(v), F.col("_c") + 1) for v in (mix.means, mix.stds))
    z = (F.col("_x") - centre) / (F.lit(SPREAD) * spread)
    z = F.when(F.col("_x").isNotNull(), F.greatest(F.least(z, F.lit(CLIP)), F.lit(-CLIP)))
    return drawn.withColumn(out, F.concat(F.array(z), one_hot_index(F.col("_c"), mix.size))).drop("_x", "_c")


def inverse_mixture(vector: Column, mix: Mixture, noise: Column | None = None) -> Column:
    """Number read back from [z, component scores]; the best score names the component."""
    best = argmax(F.slice(vector, 2, mix.size)) + 1
    z = vector[0] if noise is None else vector[0] + noise
    z = F.greatest(F.least(z, F.lit(1.0)), F.lit(-1.0))
    return z * F.lit(SPREAD) * F.element_at(number_array(mix.stds), best) + F.element_at(number_array(mix.means), best)


def label_components(df: DataFrame, label: str, mixtures: dict[str, Mixture], scale: float = 1e6) -> DataFrame:
    """(label, column, component, n): how much of each label's rows each component explains.

    One aggregation over all columns and components; ``n`` is the summed probability as an
    integer share of 1/scale.
    """
    out, sums = df.select(F.col(f"`{label}`").cast("string").alias("label"), *[_number(df, c).alias(c) for c in mixtures]), []
    for j, (c, mix) in enumerate(mixtures.items()):
        out = with_probabilities(out, F.col(f"`{c}`"), mix, f"_q{j}_")
        sums += [(c, i, f"_q{j}_{i}") for i in range(mix.size)]
    one = out.groupBy("label").agg(*[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for _, _, n in sums])
    entries = [
        F.struct(F.lit(c).alias("column"), F.lit(i).alias("component"), F.round(F.col(f"`{n}`") * F.lit(scale)).cast("bigint").alias("n"))
        for c, i, n in sums
    ]
    return one.select("label", F.inline(F.array(*entries))).filter("n > 0")


class MixtureNorm(Encoder):
    """The normaliser as an encoder: one vector [z, one-hot component]."""

    def __init__(self, max_clusters: int = MAX_CLUSTERS, weight_threshold: float = WEIGHT_THRESHOLD, seed: int = 0,
                 sigma: float | None = None, mixture: Mixture | None = None):
        self.max_clusters, self.weight_threshold = max_clusters, weight_threshold
        self.seed, self.sigma, self.mixture, self.mean = seed, sigma, mixture, None
        if mixture is not None:
            self.width = 1 + mixture.size

    def statistics(self, df):
        if self.mixture is None:
            self.mixture = fit_mixtures(df, [self.name], max_clusters=self.max_clusters,
                                        weight_threshold=self.weight_threshold)[self.name]
        self.width = 1 + self.mixture.size
        return [F.avg(_number(df, self.name))]

    def learn(self, values):
        self.mean = values[0]

    def encode(self, df, out, ids=()):
        if not ids:
            raise ValueError("MixtureNorm draws a component per row and needs the row's id columns")
        return transform_mixture(df, self.name, self.mixture, self.seed, list(ids), out, self.mean)

    def decoded(self, vector):
        value = inverse_mixture(vector, self.mixture)
        return from_micros(F.rint(value), self.type) if is_time(self.type) else back_to(value, self.type)

    def decode(self, df, vector, out, ids=()):
        if self.sigma is None:
            return super().decode(df, vector, out)
        noise = F.lit(self.sigma) * normal(self.seed, f"noise/{self.name}", *(ids or [F.xxhash64(vector)]))
        value = inverse_mixture(F.col(vector), self.mixture, noise)
        return df.withColumn(out, from_micros(F.rint(value), self.type) if is_time(self.type) else back_to(value, self.type))
