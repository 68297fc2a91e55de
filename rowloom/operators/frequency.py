"""Frequency tables of categories, of label-conditioned pairs, and orders of appearance."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.numbers import column
from ..session import materialize
from .intervals import cumulative
from .joins import lookup
from .ordinals import _ranged, dense_index

BLOCK_BITS = 20  # rows that are numbered or searched together


def text_of(df: DataFrame, name: str):
    """Category as text; null stays null and counts as a category of its own."""
    return column(df, name).cast("string")


def category_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) of all columns in one pass; combined on the map side."""
    entries = [F.struct(F.lit(c).alias("column"), text_of(df, c).alias("value")) for c in columns]
    return df.select(F.inline(F.array(*entries))).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def category_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, at): the place of every category in one vector over all columns, in the order of ``columns``, then of values.

    A written table: the number of categories has no bound, and no list of them reaches the driver. Null is a category and comes first.
    """
    counts = category_counts(df, columns).select("column", "value")
    place = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column"))
    return materialize(dense_index(counts.withColumn("_place", place), ["_place", "value"], "at").drop("_place"), "codes")


def category_freq(df: DataFrame, columns: list[str], log: bool = False) -> DataFrame:
    """(column, value, n, p): probability of each category; ``log`` uses ln(n + 1) as weight."""
    counts = category_counts(df, columns)
    weight = F.ln(F.col("n") + 1) if log else F.col("n")
    counts = counts.withColumn("_w", weight)
    # one total per column: a table as long as the list of columns
    totals = counts.groupBy("column").agg(F.sum("_w").alias("_total"))
    out = counts.join(F.broadcast(totals), "column")
    return out.select("column", "value", "n", (F.col("_w") / F.col("_total")).alias("p"))


def pair_names(columns: list[str]) -> list[tuple[str, str]]:
    return list(combinations(columns, 2))


def tuple_counts(df: DataFrame, label: str, columns: list[str], by: list[str] = ()) -> DataFrame:
    """(by, _label, _c0, _c1, ..., _n): how often each combination of the label and all columns, as text, occurs."""
    named = [text_of(df, label).alias("_label"), *[text_of(df, c).alias(f"_c{i}") for i, c in enumerate(columns)]]
    out = df.select(*by, *named)
    return out.groupBy(*out.columns).agg(F.count(F.lit(1)).alias("_n"))


def pair_sums(tuples: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """(by, pair, label, a, b, n) of every unordered pair of columns, summed out of the counts of whole combinations."""
    place = {c: f"_c{i}" for i, c in enumerate(columns)}
    entries = [
        F.struct(F.lit(f"{x}|{y}").alias("pair"), F.col("_label").alias("label"), F.col(place[x]).alias("a"), F.col(place[y]).alias("b"))
        for x, y in pair_names(columns)
    ]
    rows = tuples.select(*by, "_n", F.inline(F.array(*entries)))
    return rows.groupBy(*by, "pair", "label", "a", "b").agg(F.sum("_n").alias("n"))


def joint_counts(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """(pair, label, a, b, n) for every unordered pair of columns.

    Rows are counted once by the combination of all columns; only the distinct combinations are laid out per pair.
    """
    return pair_sums(tuple_counts(df, label, columns), columns)


def joint_freq(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """Joint counts with the probability ``p`` of the triple within its pair."""
    counts = joint_counts(df, label, columns)
    totals = counts.groupBy("pair").agg(F.sum("n").alias("_total"))
    return counts.join(F.broadcast(totals), "pair").withColumn("p", F.col("n") / F.col("_total")).drop("_total")


def cumulative_freq(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n, lo, hi): the interval of each category, in order of its value."""
    return cumulative(materialize(category_counts(df, columns), "counts"), ["column"], ["value"])


def triple_bounds(joint: DataFrame) -> DataFrame:
    """Joint counts with the interval of each triple within its pair."""
    return cumulative(joint, ["pair"], ["label", "a", "b"])


def placed_rows(rows: DataFrame, group: list[str], ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows range-partitioned and sorted by (group, ids), and the (group, _part, _count, _first, _offset) of what each
    partition holds of each group.

    ``_at`` numbers the rows of a partition, ``_first`` is the number of a group's first row there, ``_offset`` its rows in the partitions
    before. The ids split a group of any size over partitions, and the order is by ids at every size. Only the
    groups at the edges of a partition lie in several.
    """
    placed = _ranged(rows, [*group, *ids]).withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_count"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_offset", F.coalesce(F.sum("_count").over(before), F.lit(0)).cast("bigint"))
    return placed, materialize(parts, "placed-parts")


def group_ordinals(rows: DataFrame, group: list[str], ids: list[str], name: str = "ordinal") -> DataFrame:
    """Number the rows of each group 0..n-1 in the order of their ids, without collecting a group."""
    placed, parts = placed_rows(rows, group, ids)
    out = lookup(placed, parts.select(*group, "_part", "_first", "_offset"), [*group, "_part"], how="inner", null_safe=True, salt_by=["_at"])
    return out.withColumn(name, (F.col("_offset") + F.col("_at") - F.col("_first")).cast("bigint")).drop("_at", "_part", "_first", "_offset")


def placed_blocks(df: DataFrame, label: str, columns: list[str], ids: list[str]) -> DataFrame:
    """Written rows (ids, _label, _c0, ..., _at, _block) in the order of their ids; a block is at most 2^20 consecutive rows of a partition."""
    rows = df.select(*[F.col(f"`{c}`") for c in ids], text_of(df, label).alias("_label"), *[text_of(df, c).alias(f"_c{i}") for i, c in enumerate(columns)])
    return _ranged(rows, ids).withColumn("_block", F.shiftright("_at", BLOCK_BITS))


def block_counts(placed: DataFrame, columns: list[str]) -> DataFrame:
    """(pair, label, a, b, _block, _count, _offset, _rows): what each block holds of each triple, and what the blocks before it hold."""
    values = ["_label", *[f"_c{i}" for i in range(len(columns))]]
    tuples = placed.groupBy("_block", *values).agg(F.count(F.lit(1)).alias("_n"))
    counts = pair_sums(tuples, columns, ["_block"]).withColumnRenamed("n", "_count")
    triple = Window.partitionBy("pair", "label", "a", "b")
    before = triple.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumns({"_offset": F.coalesce(F.sum("_count").over(before), F.lit(0)).cast("bigint"), "_rows": F.sum("_count").over(triple)})


def triple_ordinals(df: DataFrame, label: str, columns: list[str], ids: list[str]) -> DataFrame:
    """(ids, pair, label, a, b, ordinal): the rows that carry each triple, numbered in the order of the ids.

    Rows are placed once by their ids and dealt once by range, together with one row per block and triple that stands for all rows
    before the block; running sums inside a block then give the numbers of all pairs. A task gets one range and no other.
    """
    placed = placed_blocks(df, label, columns, ids)
    ranges = (placed.agg(F.coalesce(F.max("_at"), F.lit(0))).first()[0] >> 33) + 1
    counts = block_counts(placed, columns).filter("_offset > 0")
    place, pairs = {c: i for i, c in enumerate(columns)}, pair_names(columns)
    named = [f"{x}|{y}" for x, y in pairs]
    heads = counts.select("_block", F.lit(-1).cast("bigint").alias("_at"), F.col("label").alias("_label"), *[
        F.coalesce(*[F.when(F.col("pair") == n, F.col("a" if x == c else "b")) for n, (x, y) in zip(named, pairs) if c in (x, y)]).alias(f"_c{i}")
        for c, i in place.items()
    ], F.col("pair").alias("_of"), F.col("_offset").alias("_weight"))
    rows = placed.withColumns({"_of": F.lit(None).cast("string"), "_weight": F.lit(1).cast("bigint")})
    dealt = rows.unionByName(heads, allowMissingColumns=True)
    dealt = dealt.withColumn("_part", F.shiftright("_block", 33 - BLOCK_BITS).cast("int")).repartitionById(ranges, "_part")
    for k, (n, (x, y)) in enumerate(zip(named, pairs)):
        inside = Window.partitionBy("_part", "_block", "_label", f"_c{place[x]}", f"_c{place[y]}").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        mine = F.when(F.col("_of").isNull() | (F.col("_of") == n), F.col("_weight")).otherwise(F.lit(0))
        dealt = dealt.withColumn(f"_o{k}", F.sum(mine).over(inside) - 1)
    entries = [
        F.struct(F.lit(n).alias("pair"), F.col("_label").alias("label"), F.col(f"_c{place[x]}").alias("a"), F.col(f"_c{place[y]}").alias("b"), F.col(f"_o{k}").alias("ordinal"))
        for k, (n, (x, y)) in enumerate(zip(named, pairs))
    ]
    return dealt.filter("_of is null").select(*[F.col(f"`{c}`") for c in ids], F.inline(F.array(*entries)))


def labels_by_appearance(df: DataFrame, label: str, order_by: str) -> DataFrame:
    """(label, first_at): distinct labels with the smallest order key, which sorts them by appearance."""
    return df.groupBy(F.col(f"`{label}`").alias("label")).agg(F.min(order_by).alias("first_at")).orderBy("first_at")


def condition_groups(conditions: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct conditions with their number of rows; conditions with a null are dropped."""
    known = conditions
    for c in columns:
        known = known.filter(column(conditions, c).isNotNull())
    return known.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
