"""Calibrated noise on the learned frequency tables.

With at most m rows per entity, an entity changes each of the P pair tables by at most m
counts, so all tables together move by at most m * sqrt(P) in the L2 norm. Normal noise of
deviation sigma * m * sqrt(P) is added to every cell of the category domain, observed or
not. Hashed noise with a known seed can be recomputed and subtracted: a real release must
use a secret random seed, and a domain that is public or itself released privately.
"""

from __future__ import annotations

import math
import secrets

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.random import normal
from ..session import BROADCAST_BYTES, materialize, measure
from .frequency import category_counts, joint_counts, pair_names
from .joins import lookup
from .ordinals import dense_index

SIGMA = 5.0  # fixed values: noise multiplier and failure probability
DELTA = 2e-6
MAX_ORDER = 128.0


def epsilon(sigma: float, delta: float) -> float:
    """Privacy loss of one normal-noise release: the best Renyi order on a grid up to 128."""
    orders = [1 + i / 10 for i in range(1, int((MAX_ORDER - 1) * 10) + 1)]
    return min(a / (2 * sigma**2) + math.log(1 / delta) / (a - 1) for a in orders)


def secret_seed() -> int:
    return secrets.randbits(62)


def cap_rows(df: DataFrame, entity: str, order_by: list[str], most: int) -> DataFrame:
    """At most ``most`` rows per entity. The rank filter already cuts each partition before
    the shuffle, so an entity with very many rows stays cheap."""
    w = Window.partitionBy(entity).orderBy(*order_by)
    return df.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= most).drop("_nth")


def domain_cells(df: DataFrame, label: str, columns: list[str], domain: dict[str, DataFrame] | None = None) -> DataFrame:
    """(pair, label, a, b, cell) of the whole category domain.

    Cells are numbered and each number is decoded into positions in the three category
    lists, so the product of the lists is never formed by a cross join. ``domain`` gives
    (value) tables; without it the observed categories are used, which is not private.
    """
    named = [label, *columns]
    given = {c: domain[c].select(F.col("value").cast("string").alias("value")).distinct() for c in named if c in (domain or {})}
    open_columns = [c for c in named if c not in given]
    if open_columns:  # one pass for the categories of all columns
        seen = materialize(category_counts(df, open_columns), "domain")
        given |= {c: seen.filter(F.col("column") == c).select("value") for c in open_columns}
    codes = {c: dense_index(given[c], "value", "code") for c in named}
    measured = {c: measure(t) for c, t in codes.items()}
    size = {c: rows for c, (rows, _) in measured.items()}
    out, start = None, 0
    for x, y in pair_names(columns):
        total = size[label] * size[x] * size[y]
        cells = df.sparkSession.range(total).select(
            F.lit(f"{x}|{y}").alias("pair"), (F.col("id") + start).alias("cell"),
            F.call_function("div", F.col("id"), F.lit(size[x] * size[y]).cast("bigint")).alias("_l"),
            (F.call_function("div", F.col("id"), F.lit(size[y]).cast("bigint")) % size[x]).alias("_a"),
            (F.col("id") % size[y]).alias("_b"),
        )
        for key, c, name in (("_l", label, "label"), ("_a", x, "a"), ("_b", y, "b")):
            table = codes[c].select(F.col("code").alias(key), F.col("value").alias(name))
            cells = lookup(cells, table, [key], how="inner", salt_by=["cell"],
                           fits=measured[c][1] <= BROADCAST_BYTES).drop(key)
        start += total
        out = cells if out is None else out.unionByName(cells)
    return out


def private_freq(df: DataFrame, label: str, columns: list[str], entity: str, order_by: list[str], seed: int | None = None,
                 sigma: float = SIGMA, max_rows_per_entity: int = 1, delta: float = DELTA,
                 domain: dict[str, DataFrame] | None = None) -> DataFrame:
    """(pair, label, a, b, noisy, p, epsilon): joint frequencies with normal noise.

    Counts are floored at zero and renormalised within the pair. Without a seed a secret
    random one is drawn. The epsilon holds only if ``domain`` names the label and every column; otherwise the cells
    tell which categories occur, and it is null.
    """
    seed = secret_seed() if seed is None else seed
    needed = list(dict.fromkeys([entity, *order_by, label, *columns]))
    capped = cap_rows(df.select(*needed), entity, order_by, max_rows_per_entity)
    counts = joint_counts(capped, label, columns)
    cells = domain_cells(df, label, columns, domain)
    side = counts.select(*[F.col(f"`{c}`").alias(f"_{c}") for c in ("pair", "label", "a", "b")], "n")
    test = None
    for c in ("pair", "label", "a", "b"):
        t = F.col(f"`{c}`").eqNullSafe(F.col(f"`_{c}`"))
        test = t if test is None else test & t
    full = cells.join(side, test, "left")
    deviation = sigma * max_rows_per_entity * math.sqrt(len(pair_names(columns)))
    noise = normal(seed, "noise", "cell") * F.lit(deviation)
    full = full.withColumn("noisy", F.greatest(F.coalesce(F.col("n"), F.lit(0)) + noise, F.lit(0.0)))
    loss = epsilon(sigma, delta) if {label, *columns} <= set(domain or {}) else None
    totals = full.groupBy("pair").agg(F.sum("noisy").alias("_total"))
    out = full.join(F.broadcast(totals), "pair")
    return out.select(
        "pair", "label", "a", "b", "noisy", F.try_divide("noisy", "_total").alias("p"), F.lit(loss).cast("double").alias("epsilon")
    )
