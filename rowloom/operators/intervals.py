"""Weighted draws: a uniform number finds its interval of cumulative probability.

``u >= lo AND u < hi`` alone would become a nested-loop join. A guide table turns it into
an equi-join: [0, 1) is cut into a power of two of buckets, each interval is listed in the
buckets it touches, and a draw joins on (keys, bucket) with the interval test as residual.
A value holding a third of the mass is spread over a third of the buckets, so it does not
make a hot key. Buckets crowded by many rare values are cut once more.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import BROADCAST_BYTES, fits_broadcast, materialize, row_bytes
from .joins import lookup
from .ordinals import WINDOW_ROWS, running_sum

MIN_BUCKETS = 64
MAX_BUCKETS = 2**20
CROWDED = 64


def power_of_two(n: int) -> int:
    return 1 << max(0, int(n) - 1).bit_length()


def cumulative(weights: DataFrame, keys: list[str], order: list[str], weight: str = "n") -> DataFrame:
    """Add ``lo`` and ``hi``: the share of integer ``weight`` before and up to each row, per ``keys``.

    Sums stay integers until one final division, so bounds meet exactly and the last is 1.0.
    """
    kept = weights.filter(F.col(f"`{weight}`") > 0)
    rows = kept.count()
    summed = running_sum(kept, keys, order, weight, "_upto", rows)
    if rows <= WINDOW_ROWS:
        summed = summed.withColumn("_total", F.sum(weight).over(Window.partitionBy(*keys)))
    elif keys:
        totals = materialize(kept.groupBy(*keys).agg(F.sum(weight).alias("_total")), "totals")
        summed = lookup(summed, totals, keys, null_safe=True)
    else:
        summed = summed.withColumn("_total", F.lit(kept.agg(F.sum(weight)).first()[0]))
    return summed.withColumns(
        {"lo": (F.col("_upto") - F.col(f"`{weight}`")) / F.col("_total"), "hi": F.col("_upto") / F.col("_total")}
    ).drop("_upto", "_total")


@dataclass
class Guide:
    """Bucketed interval table, ready to be joined with draws."""

    table: DataFrame
    keys: list[str]
    buckets: int
    crowded: DataFrame | None = None
    crowded_small: bool = False  # measured below the broadcast bound when built
    small: bool = False


def _bucket(u: Column, buckets) -> Column:
    return F.floor(u * buckets).cast("bigint")


def build_guide(bounds: DataFrame, keys: list[str], buckets: int | None = None, crowded: int = CROWDED) -> Guide:
    """Guide table over intervals ``lo``/``hi`` per ``keys``; written, since every draw reads it."""
    bounds = materialize(bounds, "intervals")
    if buckets is None:
        # buckets for the average key, so that the listing grows with the intervals and not
        # with keys times the widest key; keys with many intervals get crowded buckets instead
        per_key = bounds.groupBy(*keys).count() if keys else bounds.groupBy().count()
        total, n = per_key.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first()
        buckets = min(max(power_of_two(-(-total // max(n, 1))), MIN_BUCKETS), MAX_BUCKETS)
    k = F.lit(float(buckets))
    first, last = _bucket(F.col("lo"), k), F.ceil(F.col("hi") * k).cast("bigint") - 1
    listed = materialize(bounds.withColumn("_bucket", F.explode(F.sequence(first, last))), "guide")
    full = listed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_c"), F.sum(row_bytes(listed)).alias("_b"))
    most, size = full.agg(F.coalesce(F.max("_c"), F.lit(0)), F.coalesce(F.sum("_b"), F.lit(0))).first()
    if most <= crowded:
        return Guide(listed.withColumn("_fine", F.lit(0).cast("bigint")), keys, buckets, None, False, size <= BROADCAST_BYTES)
    full = materialize(full.filter(F.col("_c") > crowded), "crowded")
    # power of two above the number of intervals, so that products with it are exact
    full = full.select(*keys, "_bucket", F.pow(F.lit(2.0), F.ceil(F.log2("_c"))).alias("_cut"))
    cut = lookup(listed, full, keys + ["_bucket"], null_safe=True)
    fine_k = k * F.coalesce(F.col("_cut"), F.lit(1.0))
    start = F.col("_bucket") * F.coalesce(F.col("_cut"), F.lit(1.0))
    inner_first = F.greatest(F.floor(F.col("lo") * fine_k), start).cast("bigint")
    inner_last = F.least(
        F.ceil(F.col("hi") * fine_k) - 1, start + F.coalesce(F.col("_cut"), F.lit(1.0)) - 1
    ).cast("bigint")
    fine = cut.withColumn("_fine", F.explode(F.sequence(inner_first, inner_last)))
    fine = fine.withColumn("_fine", F.when(F.col("_cut").isNull(), F.lit(0)).otherwise(F.col("_fine")).cast("bigint"))
    fine = materialize(fine.drop("_cut"), "fine")
    return Guide(fine, keys, buckets, full, fits_broadcast(full), fits_broadcast(fine))


def pick(draws: DataFrame, guide: Guide, u: Column, how: str = "inner", fixed: dict | None = None) -> DataFrame:
    """For every draw the interval of its keys that contains ``u``; adds the guide's value columns.

    ``fixed`` gives some keys one value for all draws, which prunes the guide table.
    """
    fixed = fixed or {}
    keys = [k for k in guide.keys if k not in fixed]

    def own(table: DataFrame) -> DataFrame:
        for k, v in fixed.items():
            table = table.filter(F.col(k) == F.lit(v)).drop(k)
        return table

    out = draws.withColumn("_u", u).withColumn("_bucket", _bucket(F.col("_u"), F.lit(float(guide.buckets))))
    if guide.crowded is not None:
        out = lookup(out, own(guide.crowded), keys + ["_bucket"], null_safe=True, fits=guide.crowded_small)
        fine = F.floor(F.col("_u") * F.lit(float(guide.buckets)) * F.col("_cut"))
        out = out.withColumn("_fine", F.coalesce(fine, F.lit(0)).cast("bigint")).drop("_cut")
    else:
        out = out.withColumn("_fine", F.lit(0).cast("bigint"))
    on = keys + ["_bucket", "_fine"]
    guided = own(guide.table)
    table = guided.select(
        *[F.col(f"`{c}`").alias(f"_g_{c}") for c in on + ["lo", "hi"]],
        *[c for c in guided.columns if c not in on + ["lo", "hi"]],
    )
    if guide.small or (fixed and fits_broadcast(guided)):
        table = F.broadcast(table)
    test = (F.col("_u") >= F.col("_g_lo")) & (F.col("_u") < F.col("_g_hi"))
    for c in on:
        test = test & F.col(f"`{c}`").eqNullSafe(F.col(f"`_g_{c}`"))
    return out.join(table, test, how).drop("_u", "_bucket", "_fine", *[f"_g_{c}" for c in on + ["lo", "hi"]])
