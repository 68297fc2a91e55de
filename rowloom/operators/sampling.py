"""Conditioned draws of categories and of real rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.random import index_below, uniform
from ..functions.vectors import many_hot
from ..session import fits_broadcast, materialize
from .frequency import BLOCK_BITS, block_counts, pair_names, placed_blocks, placed_rows, text_of
from .intervals import Guide, build_guide, cumulative, pick
from .joins import lookup


def _choice(options: list[str], u: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (index_below(u, len(options)) + 1).cast("int"))


def with_pair(ids: DataFrame, id_col: str, columns: list[str], seed: int) -> DataFrame:
    """Add the pair of distinct columns drawn for each id; every pair is equally likely."""
    if len(columns) < 2:
        raise ValueError("a draw needs at least two discrete columns besides the label")
    names = [f"{x}|{y}" for x, y in pair_names(columns)]
    return ids.withColumn("pair", _choice(names, uniform(seed, "pair", id_col)))


def pair_columns() -> tuple[Column, Column]:
    """Names of the two columns of a pair."""
    return F.substring_index("pair", "|", 1), F.substring_index("pair", "|", -1)


def draw_conditions(guide: Guide, ids: DataFrame, id_col: str, columns: list[str], seed: int) -> DataFrame:
    """For every id a pair of columns and one (label, a, b) with its joint probability."""
    drawn = with_pair(ids, id_col, columns, seed)
    return pick(drawn, guide, uniform(seed, "triple", id_col))


def draw_members(df: DataFrame, group: list[str], ids: list[str], draws: DataFrame, draw_ids: list[str], seed: int,
                 prefix: str = "row", carry: list[str] = ()) -> DataFrame:
    """For every draw one row of its group, uniformly; adds ``<prefix>_<id>`` columns and the
    row's ``carry`` columns.

    A draw becomes a rank in its group, in the order of the ids; equal ids are ordered by the carried columns. Rows are placed once, in
    that order. The rank is the place of a row unless the group lies in several partitions: then it falls into one of them by the
    counts, of which there are no more than partitions. Draws whose group has no rows are dropped.
    """
    placed, parts = placed_rows(df.select(*group, *ids, *carry), group, [*ids, *carry])
    u = uniform(seed, "member", *draw_ids)
    sizes = materialize(
        parts.groupBy(*group).agg(F.sum("_count").cast("bigint").alias("_n"), F.count(F.lit(1)).alias("_parts"), F.min("_first").alias("_start")), "sizes"
    )
    if group:
        located = lookup(draws, sizes, group, how="inner", null_safe=True, salt_by=draw_ids)
    else:
        located = draws.join(F.broadcast(sizes.filter("_n > 0")))  # one row
    located = located.withColumn("_rank", index_below(u, F.col("_n"))).drop("_n")
    wide = sizes.filter("_parts > 1").drop("_n", "_parts", "_start")
    if not sizes.filter("_parts > 1").isEmpty():
        wide = lookup(parts, materialize(wide, "wide"), group, how="left_semi", null_safe=True) if group else parts
        guide = build_guide(cumulative(materialize(wide, "wide-parts"), group, ["_part"], "_count"), group)
        located = pick(located, guide, u, how="left")
        inside = F.least(F.greatest(F.col("_rank") - F.col("_offset"), F.lit(0)), F.col("_count") - 1)
        place = F.when(F.col("_first").isNull(), F.col("_start") + F.col("_rank")).otherwise(F.col("_first") + inside)
        located = located.withColumn("_place", place).drop("_part", "_first", "_offset", "_count")
    else:
        located = located.withColumn("_place", F.col("_start") + F.col("_rank"))
    side = placed.select(F.col("_at").alias("_m_at"), *[F.col(f"`{c}`").alias(f"{prefix}_{c}") for c in ids], *carry)
    return located.join(side, F.col("_place") == F.col("_m_at")).drop("_m_at", "_place", "_rank", "_parts", "_start")


def sample_rows(df: DataFrame, label: str, columns: list[str], ids: list[str], drawn: DataFrame, draw_id: str, seed: int) -> DataFrame:
    """For every drawn (pair, label, a, b) the id of one real row that carries it, uniformly.

    A draw becomes a rank among the rows of its triple in the order of their ids. The counts per block of rows turn the rank into a block
    and a number inside it, and only there rows are looked at: each block meets its draws, at most 2^20 rows and about as many draws at a time.
    """
    placed = placed_blocks(df, label, columns, ids)
    counts = materialize(block_counts(placed, columns), "block-counts")
    triple = ["pair", "label", "a", "b"]
    guide = build_guide(cumulative(counts, triple, ["_block"], "_count"), triple)
    u = uniform(seed, "member", draw_id)
    found = pick(drawn, guide, u)
    local = F.greatest(F.least(index_below(u, F.col("_rows")) - F.col("_offset"), F.col("_count") - 1), F.lit(0))
    found = materialize(found.select(*[F.col(f"`{c}`") for c in drawn.columns], "_block", local.alias("_local")), "ranked-draws")

    # a block with very many draws is copied for every 2^20 of them
    slices = found.groupBy("_block").agg(F.ceil(F.count(F.lit(1)) / F.lit(1 << BLOCK_BITS)).cast("int").alias("_slices"))
    slices = materialize(slices, "block-slices")
    fits = fits_broadcast(slices)
    dealt = lookup(found, slices, ["_block"], "inner", salt_by=[draw_id], fits=fits)
    dealt = dealt.withColumn("_slice", F.pmod(F.xxhash64(draw_id), F.col("_slices")).cast("int")).drop("_slices")
    rows = lookup(placed, slices, ["_block"], "inner", salt_by=["_at"], fits=fits)
    rows = rows.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).drop("_slices")

    places = {f"{x}|{y}": (columns.index(x), columns.index(y)) for x, y in pair_names(columns)}
    kept, given = list(drawn.columns), list(ids)

    def choose(held: pa.Table, asked: pa.Table) -> pa.Table:
        return chosen_rows(held, asked, places, kept, given)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in drawn.schema.fields]
    fields += [f"`row_{c}` {df.schema[c].dataType.simpleString()}" for c in ids]
    by = ["_block", "_slice"]
    return rows.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInArrow(choose, ", ".join(fields))


def chosen_rows(held: pa.Table, asked: pa.Table, places: dict, kept: list[str], ids: list[str]) -> pa.Table:
    """The draws ``asked`` of one block, each with the ids of the row that is number ``_local`` of its triple among the rows ``held``."""
    held = held.sort_by("_at")
    outs = []
    for pair, (i, j) in places.items():
        mine = asked.filter(pc.equal(asked.column("pair"), pair))
        if not mine.num_rows:
            continue
        code, wanted = np.zeros(held.num_rows, np.int64), np.zeros(mine.num_rows, np.int64)
        for own, drawn in (("_label", "label"), (f"_c{i}", "a"), (f"_c{j}", "b")):
            coded = held.column(own).combine_chunks().dictionary_encode(null_encoding="encode")
            size = len(coded.dictionary)
            here = pc.index_in(mine.column(drawn).combine_chunks(), value_set=coded.dictionary).to_numpy(zero_copy_only=False)
            code = code * size + coded.indices.to_numpy(zero_copy_only=False)
            wanted = wanted * size + here
        order = np.argsort(code, kind="stable")
        at = order[np.searchsorted(code[order], wanted.astype(np.int64)) + mine.column("_local").to_numpy()]
        found = held.take(pa.array(at))
        outs.append(pa.table([*[mine.column(c) for c in kept], *[found.column(c) for c in ids]], names=[*kept, *[f"row_{c}" for c in ids]]))
    if outs:
        return pa.concat_tables(outs)
    empty = asked.slice(0, 0)
    return pa.table([*[empty.column(c) for c in kept], *[held.slice(0, 0).column(c) for c in ids]], names=[*kept, *[f"row_{c}" for c in ids]])


def draw_original(df: DataFrame, label: str, columns: list[str], ids: list[str], draws: DataFrame, draw_id: str, seed: int) -> DataFrame:
    """For every draw a uniform source row; its label and the values of two drawn columns."""
    values = {c: f"_v{i}" for i, c in enumerate(columns)}
    source = df.select(*ids, text_of(df, label).alias("label"), *[text_of(df, c).alias(v) for c, v in values.items()])
    picked = draw_members(source, [], ids, draws, [draw_id], seed, carry=["label", *values.values()])
    out = with_pair(picked, draw_id, columns, seed)
    first, second = pair_columns()
    value = lambda name: F.coalesce(*[F.when(name == c, F.col(v)) for c, v in values.items()])
    return out.withColumns({"a": value(first), "b": value(second)}).drop(*values.values())


def condition_vector(drawn: DataFrame, label: str, columns: list[str], codes: DataFrame, name: str = "vector", mask: str = "mask") -> DataFrame:
    """Render (pair, label, a, b) as one one-hot vector over all discrete columns, and the column mask.

    ``codes`` are the ``category_codes`` of the label and the columns. A value that they do not know sets no bit.
    """
    first, second = pair_columns()
    fits, out = fits_broadcast(codes), drawn
    for i, (column, value) in enumerate([(F.lit(label), "label"), (first, "a"), (second, "b")]):
        places = codes.select(F.col("column").alias("_column"), F.col("value").alias("_value"), F.col("at").alias(f"_at{i}"))
        out = out.withColumns({"_column": column, "_value": F.col(value)})
        out = lookup(out, places, ["_column", "_value"], null_safe=True, fits=fits).drop("_column", "_value")
    bits = [F.lit(1), *[F.when((first == c) | (second == c), 1).otherwise(0) for c in columns]]
    set_at = F.array(*[F.coalesce(F.col(f"_at{i}"), F.lit(-1).cast("bigint")) for i in range(3)])
    return out.withColumns({name: many_hot(set_at, codes.count()), mask: F.array(*bits)}).drop("_at0", "_at1", "_at2")


def fixed_condition(ids: DataFrame, codes: DataFrame, column: str, value, name: str = "vector") -> DataFrame:
    """The same one-hot vector, naming one value of one column, for every id."""
    own = codes.filter(F.col("column") == column)
    if own.isEmpty():
        raise ValueError(f"`{column}` is not a discrete column")
    found = own.filter(F.col("value").eqNullSafe(F.lit(value).cast("string"))).select("at").first()
    if found is None:
        raise ValueError(f"`{value}` is not a category of `{column}`")
    return ids.withColumn(name, many_hot(F.array(F.lit(found["at"]).cast("bigint")), codes.count()))


def decode_label(df: DataFrame, vector: str, codes: DataFrame, label: str, name: str = "label") -> DataFrame:
    """Category of the column ``label`` whose bit is set in its span of the vector; null if none is."""
    own = codes.filter(F.col("column") == label)
    start, width = own.agg(F.coalesce(F.min("at"), F.lit(0)), F.count(F.lit(1))).first()
    bit = F.array_position(F.slice(F.col(vector), start + 1, width), F.lit(1.0))
    coded = df.withColumn("_at", F.when(bit > 0, bit - 1 + start))
    return lookup(coded, own.select(F.col("at").alias("_at"), F.col("value").alias(name)), ["_at"]).drop("_at")
