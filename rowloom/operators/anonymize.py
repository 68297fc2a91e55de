"""Personal fields replaced by fake values, and generated or repaired ids."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, functions as F

from ..functions.names import fake, keyed_uniform, row_uniform
from ..functions.patterns import capacity, kth_string
from ..session import materialize
from ..spec import FieldSpec, TableSpec
from .joins import lookup
from .ordinals import dense_index

DEFAULT_PATTERN = "[a-zA-Z]+"  # fixed value: string ids of a field without its own pattern


def new_salt() -> str:
    """A secret salt; without it the mapping cannot be recomputed from the values."""
    return secrets.token_hex(16)


def anon_map(df: DataFrame, field: str, category, salt: str, locale=None) -> DataFrame:
    """(value, fake) for every distinct value; several values may share a fake one."""
    values = df.select(F.col(f"`{field}`").alias("value")).distinct()
    return values.withColumn("fake", fake(category, keyed_uniform(F.col("value"), salt), locale))


def anonymize(df: DataFrame, maps: dict[str, DataFrame]) -> DataFrame:
    """Replace the values of each mapped field; values the map has not seen become null."""
    names = df.columns
    for field, table in maps.items():
        if field not in names:
            continue
        renamed = table.select(F.col("value").alias(field), F.col("fake").alias("_fake"))
        df = lookup(df, renamed, [field], null_safe=True).drop(field).withColumnRenamed("_fake", field)
    return df.select(*[f"`{n}`" for n in names])


def anonymize_stateless(df: DataFrame, field: str, category, salt: str, locale=None) -> DataFrame:
    """Same fake values as the map of the same salt, computed in place without a join."""
    return df.withColumn(field, fake(category, keyed_uniform(F.col(f"`{field}`"), salt), locale))


def fresh_pii(df: DataFrame, spec: TableSpec, seed: int, id_col: str) -> DataFrame:
    """New fake values per output row, independent of any learned map."""
    made = {
        f.name: fake(f.pii_category, row_uniform(seed, f.name, id_col), f.pii_locales)
        for f in spec.fields
        if f.pii and f.type != "id"
    }
    return df.withColumns(made) if made else df


def learn_maps(df: DataFrame, spec: TableSpec, salt: str) -> dict[str, DataFrame]:
    """Written maps of all personal fields of a table."""
    return {
        f.name: materialize(anon_map(df, f.name, f.pii_category, salt, f.pii_locales), "anon")
        for f in spec.fields
        if f.pii and f.type != "id" and f.name in df.columns
    }


def id_value(index, field: FieldSpec):
    """Id number ``index`` of a field, as a Column."""
    if (field.subtype or "integer") == "string":
        return kth_string(index, field.regex or DEFAULT_PATTERN)
    return index.cast("bigint")


def check_capacity(field: FieldSpec, rows: int) -> None:
    if (field.subtype or "integer") == "string":
        pattern = field.regex or DEFAULT_PATTERN
        most = capacity(pattern)
        if most < rows:
            raise ValueError(
                f"the pattern {pattern} yields {most} strings, too few for {rows} rows"
            )


def make_ids(df: DataFrame, field: FieldSpec, order_by, name: str | None = None, rows: int | None = None) -> DataFrame:
    """Give the rows the first ids of the field, in the order of ``order_by``.

    ``rows`` spares the count when the caller knows it.
    """
    check_capacity(field, df.count() if rows is None else rows)
    indexed = dense_index(df, order_by, "_nth")
    return indexed.withColumn(name or field.name, id_value(F.col("_nth"), field)).drop("_nth")


def ids_for_range(df: DataFrame, field: FieldSpec, index_col: str, rows: int) -> DataFrame:
    """Ids of rows that already carry a dense index 0..n-1."""
    check_capacity(field, rows)
    return df.withColumn(field.name, id_value(F.col(index_col), field))


def has_duplicates(df: DataFrame, column: str) -> bool:
    """True if a value of the column, or null, occurs twice; combined on the map side."""
    doubled = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return not doubled.isEmpty()


def make_ids_unique(df: DataFrame, spec: TableSpec, order_by) -> DataFrame:
    """Regenerate every id column that holds a duplicate; leave the others alone."""
    for field in spec.fields:
        if field.type == "id" and field.name in df.columns and has_duplicates(df, field.name):
            columns = df.columns
            order = [order_by] if isinstance(order_by, str) else list(order_by)
            keyed = df.withColumns({f"_order{i}": F.col(f"`{c}`") for i, c in enumerate(order)})
            made = make_ids(keyed, field, [f"_order{i}" for i in range(len(order))])
            df = made.select(*columns)
    return df
