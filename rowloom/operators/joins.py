"""Lookup joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import fits_broadcast

HOT_SHARE = 0.01
SALTS = 64


def _condition(left: DataFrame, right: DataFrame, pairs, null_safe: bool) -> Column:
    tests = [left[a].eqNullSafe(right[b]) if null_safe else left[a] == right[b] for a, b in pairs]
    return reduce(lambda x, y: x & y, tests)


def _joined(left, right, pairs, how, null_safe) -> DataFrame:
    out = left.join(right, _condition(left, right, pairs, null_safe), how)
    return out.drop(*[b for _, b in pairs])


def hot_keys(rows: DataFrame, on: list[str], share: float = HOT_SHARE) -> DataFrame:
    """Keys holding more than ``share`` of the rows: at most ``1/share`` of them.

    Counting combines on the map side, so the shuffle carries distinct keys, not rows.
    """
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.agg(F.count(F.lit(1)).alias("_total")).first()["_total"]
    return counts.filter(F.col("_n") > F.lit(max(1.0, total * share))).drop("_n")


def lookup(
    rows: DataFrame,
    table: DataFrame,
    on: list[str],
    how: str = "left",
    null_safe: bool = False,
    salt_by: list[str] | None = None,
    fits: bool | None = None,
) -> DataFrame:
    """Join ``rows`` with the distinct-keyed ``table`` on the columns ``on``.

    The table is broadcast only when its measured size is below the bound. Beyond it the
    hot keys of ``rows`` (a bounded list) are salted, their few table rows repeated once
    per salt, and everything else goes through one shuffled join. Every row is kept.
    """
    renamed = table.select(
        *[F.col(f"`{c}`").alias(f"_key_{c}" if c in on else c) for c in table.columns]
    )
    pairs = [(c, f"_key_{c}") for c in on]
    if how in ("left_semi", "left_anti"):
        renamed = renamed.select(*[b for _, b in pairs])
    if fits_broadcast(table) if fits is None else fits:
        return _joined(rows, F.broadcast(renamed), pairs, how, null_safe)

    hot = hot_keys(rows, on)
    hot = hot.select(*[F.col(f"`{c}`").alias(f"_hot_{c}") for c in on], F.lit(True).alias("_is_hot"))
    hot_pairs = [(c, f"_hot_{c}") for c in on]
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in (salt_by or rows.columns)]), F.lit(SALTS))
    salted = _joined(rows, F.broadcast(hot), hot_pairs, "left", True)
    salted = salted.withColumn("_salt", F.when(F.col("_is_hot"), spread).otherwise(F.lit(0)).cast("int")).drop("_is_hot")
    copies = _joined(renamed, F.broadcast(hot), [(b, h) for (_, b), (_, h) in zip(pairs, hot_pairs)], "left", True)
    copies = copies.withColumn(
        "_key__salt",
        F.explode(F.when(F.col("_is_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))),
    ).drop("_is_hot")
    out = _joined(salted, copies, pairs + [("_salt", "_key__salt")], how, null_safe)
    return out.drop("_salt")
