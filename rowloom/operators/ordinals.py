"""Row numbers, running sums and first-n cuts without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import discard, materialize, shuffle_partitions

WINDOW_ROWS = 200_000
RANGE_ROWS = 1 << 19  # rows that one task sorts
_FAN = 1024


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows range-partitioned and sorted by ``order``; ``_at`` is partition number * 2^33 + position.

    The range bounds come from sampling, so the result is written before it is read twice. The rows are written first: their number gives that of
    the ranges, and sampling then reads them and not what they are made of.
    """
    held = materialize(df, "unordered")
    n = max(shuffle_partitions(df.sparkSession), -(-held.count() // RANGE_ROWS))
    cols = [F.col(f"`{c}`") for c in order]
    placed = held.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
    out = materialize(placed.withColumn("_at", F.monotonically_increasing_id()), "ranged")
    discard(held)
    return out


def dense_index(df: DataFrame, order_by, name: str = "row_index") -> DataFrame:
    """Add 0..n-1 in the order of ``order_by``.

    Two phases: rows are range-partitioned and numbered inside their partition, then each
    partition's offset is added. Only one count per partition reaches the driver.
    """
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    placed = _ranged(df, order)
    part = F.shiftright("_at", 33)
    counts = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    rows, start = [], 0
    for p, n in counts:
        rows.append((p, start))
        start += n
    offsets = df.sparkSession.createDataFrame(rows, "_part bigint, _offset bigint")
    local = F.col("_at") - F.shiftleft(part, 33)
    return (
        placed.join(F.broadcast(offsets), part == F.col("_part"))
        .withColumn(name, F.col("_offset") + local)
        .drop("_at", "_part", "_offset")
    )


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, rows: int | None = None) -> DataFrame:
    """Sum of ``value`` over the rows up to and including this one, per ``keys``.

    Small tables use one window. Larger ones are cut into ranges, so that no key has to
    pass through one task: local sums inside a range plus the totals of the ranges before.
    """
    rows = df.count() if rows is None else rows
    cols = [F.col(f"`{c}`") for c in order]
    if rows <= WINDOW_ROWS:
        w = Window.partitionBy(*keys).orderBy(*cols).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.sum(value).over(w))
    placed = _ranged(df, keys + order).withColumn("_part", F.shiftright("_at", 33)).drop("_at")
    local = Window.partitionBy("_part", *keys).orderBy(*cols).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum"))
    totals = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    totals = totals.select(*[F.col(f"`{c}`").alias(f"_t_{c}") for c in keys + ["_part"]], "_before")
    test = F.col("_part") == F.col("_t__part")
    for c in keys:
        test = test & F.col(f"`{c}`").eqNullSafe(F.col(f"`_t_{c}`"))
    out = placed.withColumn("_local", F.sum(value).over(local)).join(totals, test)
    return out.withColumn(name, F.col("_local") + F.col("_before")).drop(
        "_local", "_before", "_part", *[f"_t_{c}" for c in keys + ["_part"]]
    )


def cut_after(df: DataFrame, id_col: str, n: int) -> int | None:
    """Smallest id bound below which exactly ``n`` rows lie; None when there are at most ``n``.

    Ids are unique non-negative integers. A 1024-way histogram is refined until the bound
    is exact, so neither a global sort nor the rows themselves reach one task.
    """
    low, high, count = df.agg(F.min(id_col), F.max(id_col), F.count(F.lit(1))).first()
    if count <= n:
        return None
    if n <= 0:
        return int(low)
    low, width, need = int(low), int(high) - int(low) + 1, n
    while width > 1:
        step = -(-width // _FAN)
        inside = df.filter((F.col(f"`{id_col}`") >= low) & (F.col(f"`{id_col}`") < low + width))
        bins = inside.groupBy(F.call_function("div", F.col(f"`{id_col}`") - low, F.lit(step).cast("bigint")).alias("b"))
        for b, c in sorted(tuple(r) for r in bins.agg(F.count(F.lit(1)).alias("c")).collect()):
            if c >= need:
                low, width = low + b * step, step
                break
            need -= c
    return low + 1


def first_rows(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """The ``n`` rows with the smallest unique integer ids, found by a cut instead of a sort."""
    bound = cut_after(df, id_col, n)
    return df if bound is None else df.filter(F.col(f"`{id_col}`") < F.lit(bound))
