"""Checks of data against its description."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from ..errors import ConstraintsNotMetError, MetadataError
from ..functions.numbers import column
from ..spec import DatasetSpec, TableSpec, infer_field
from .joins import lookup


def profile_fields(df: DataFrame, field_types: dict | None = None, field_names=None) -> DataFrame:
    """(field, type, subtype, discrete) of every field.

    Declared categorical fields, text and booleans are discrete; so are numbers that take
    both values 0 and 1 and no other. All columns are looked at in one aggregation.
    """
    spec = TableSpec.infer(df, field_names, field_types)
    tests = {}
    for f in spec.fields:
        if isinstance(df.schema[f.name].dataType, T.NumericType) and f.type == "numerical":
            v = column(df, f.name)
            tests[f.name] = (F.count_if(v == 0) > 0) & (F.count_if(v == 1) > 0) & (F.count_if(~v.isin(0, 1)) == 0)
    one = df.agg(*([t.alias(f"t_{n}") for n, t in tests.items()] or [F.count(F.lit(1)).alias("_n")]))
    rows = [
        F.struct(
            F.lit(f.name).alias("field"), F.lit(f.type).alias("type"), F.lit(f.subtype).cast("string").alias("subtype"),
            (F.col(f"t_{f.name}") if f.name in tests else F.lit(f.type in ("categorical", "boolean"))).alias("discrete"),
        )
        for f in spec.fields
    ]
    return one.select(F.inline(F.array(*rows)))


def discrete_columns(df: DataFrame, listed: list[str] | None = None, **kwargs) -> list[str]:
    """Names of the discrete columns; listed ones must exist."""
    unknown = set(listed or []) - set(df.columns)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    if listed is not None:
        return list(listed)
    return [r["field"] for r in profile_fields(df, **kwargs).collect() if r["discrete"]]


def validate_table(df: DataFrame, spec: TableSpec) -> DataFrame:
    """(field, problem, n): unexpected and missing columns, and values that fail the cast.

    One aggregation counts the bad values of all columns.
    """
    rows, aggs = [], []

    def entry(name, problem, n):
        return F.struct(F.lit(name).alias("field"), F.lit(problem).alias("problem"), n.cast("bigint").alias("n"))

    for name in df.columns:
        if name not in spec:
            rows.append(entry(name, "unexpected column", F.lit(1)))
            continue
        want = spec[name].spark_type
        value = column(df, name)
        if df.schema[name].dataType == want:
            continue
        aggs.append(F.count_if(value.isNotNull() & value.try_cast(want).isNull()).alias(f"bad_{name}"))
        rows.append(entry(name, "invalid values", F.col(f"`bad_{name}`")))
    rows += [entry(n, "missing column", F.lit(1)) for n in spec.names() if n not in df.columns]
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *aggs)
    if not rows:
        rows = [entry("", "none", F.lit(0))]
    return one.select(F.inline(F.array(*rows))).filter("n > 0")


def validate_dataset(spec: DatasetSpec, tables: dict[str, DataFrame] | None = None) -> None:
    """Raise one error that lists everything wrong with the description and the data."""
    found = spec.problems()
    for name, table in spec.tables.items():
        if tables is None:
            continue
        if name not in tables:
            found.append(f"no data given for table `{name}`")
            continue
        for r in validate_table(tables[name], table).collect():
            found.append(f"{r['problem']} in table `{name}`: `{r['field']}` ({r['n']})")
    if found:
        raise MetadataError("the description or the data is wrong:\n - " + "\n - ".join(found))


def duplicate_keys(df: DataFrame, key: str | list[str]) -> DataFrame:
    """(key columns, n) of keys that occur more than once or are null. The count combines on
    the map side, so a key with very many rows is cheap."""
    keys = [key] if isinstance(key, str) else list(key)
    null = reduce(lambda a, b: a | b, [F.col(f"`{k}`").isNull() for k in keys])
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | null)


def check_primary_key(df: DataFrame, spec: TableSpec) -> DataFrame:
    """The key's rules on the description, then its violations in the data."""
    spec.checked_key()
    return duplicate_keys(df, spec.key_fields())


def orphan_keys(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """(fk, n): references without a parent row and how many rows use them.

    References are counted before the join, so it moves distinct keys and no hot ones.
    """
    used = child.filter(F.col(f"`{fk}`").isNotNull()).groupBy(fk).agg(F.count(F.lit(1)).alias("n"))
    return used.join(parent.select(F.col(pk).alias("_pk")), F.col(f"`{fk}`") == F.col("_pk"), "left_anti")


def orphan_rows(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """The child rows whose reference has no parent row."""
    return lookup(child, orphan_keys(child, parent, fk, pk).select(fk), [fk], how="left_semi")


def constraint_audit(df: DataFrame, constraints: dict) -> DataFrame:
    """(name, invalid): rows that break each named constraint, each judged on all rows.

    All row-local constraints share one aggregation over one scan; Unique and
    UniqueCombinations add one count per key each. Constraints whose columns are absent are skipped.
    """
    spark = df.sparkSession
    present = {n: c for n, c in constraints.items() if c.applies_to(df)}
    local = {n: c for n, c in present.items() if c.row_local}
    parts = []
    if local:
        one = df.agg(*[F.count_if(~c.valid(df)).alias(n) for n, c in local.items()])
        entries = [F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("invalid")) for n in local]
        parts.append(one.select(F.inline(F.array(*entries))))
    for name, c in present.items():
        if not c.row_local:
            parts.append(c.count_invalid(df).select(F.lit(name).alias("name"), "invalid"))
    if not parts:
        return spark.createDataFrame([], "name string, invalid bigint")
    return reduce(DataFrame.unionByName, parts)


def assert_constraints(df: DataFrame, constraints, message: str = "rows break the constraints") -> None:
    """Raise when any applicable constraint is broken, with all counts listed."""
    named = {f"{i}:{type(c).__name__}": c for i, c in enumerate(constraints)}
    bad = {r["name"]: r["invalid"] for r in constraint_audit(df, named).collect() if r["invalid"]}
    if bad:
        raise ConstraintsNotMetError(f"{message}: {bad}", bad)


__all__ = [
    "assert_constraints", "check_primary_key", "constraint_audit", "discrete_columns", "duplicate_keys", "infer_field",
    "orphan_keys", "orphan_rows", "profile_fields", "validate_dataset", "validate_table",
]
