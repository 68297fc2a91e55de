"""Row generation from learned frequency tables and mixtures.

For each row id: a pair of columns and a (label, a, b) triple by joint probability, the other
categories by their frequency given the label, and numbers from the label's share of the
column's components. Everything is a join with a small learned table, keyed by hashed
uniforms of the row id, so any subset of ids can be generated anywhere and gives equal rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.numbers import back_to, from_micros, is_time
from ..functions.random import normal, uniform
from ..functions.vectors import number_array
from ..session import materialize
from ..spec import TableSpec
from .anonymize import check_capacity, fresh_pii, id_value
from .constraints import reverse_all
from .frequency import category_counts, joint_counts, pair_names
from .intervals import Guide, build_guide, cumulative, pick
from .mixture import SPREAD, Mixture, fit_mixtures, label_components
from .sampling import pair_columns, with_pair


@dataclass
class Model:
    """Learned tables: counts (label, n), joint (pair, label, a, b, n), conditional
    (column, label, value, n) and components (column, label, component, n)."""

    label: str
    columns: list[str]
    mixtures: dict[str, Mixture]
    types: dict[str, T.DataType]
    counts: DataFrame
    joint: DataFrame | None
    conditional: DataFrame | None
    components: DataFrame | None
    guides: dict[str, Guide] = field(default_factory=dict)

    def guide(self, name: str) -> Guide:
        """Guide tables are built on first use and kept."""
        if name not in self.guides:
            if name == "label":
                made = build_guide(cumulative(self.counts, [], ["label"]), [])
            elif name == "triple":
                made = build_guide(cumulative(self.joint, ["pair"], ["label", "a", "b"]), ["pair"])
            elif name == "pair":
                made = build_guide(cumulative(self.joint, ["pair", "label"], ["a", "b"]), ["pair", "label"])
            elif name == "second":  # the joint table under the pair's first column
                made = build_guide(cumulative(self.joint, ["pair", "label", "a"], ["b"]), ["pair", "label", "a"])
            elif name == "first":
                made = build_guide(cumulative(self.joint, ["pair", "label", "b"], ["a"]), ["pair", "label", "b"])
            elif name == "value":
                made = build_guide(cumulative(self.conditional, ["column", "label"], ["value"]), ["column", "label"])
            else:
                made = build_guide(cumulative(self.components, ["column", "label"], ["component"]), ["column", "label"])
            self.guides[name] = made
        return self.guides[name]


def conditional_counts(joint: DataFrame, columns: list[str]) -> DataFrame:
    """(column, label, value, n) summed out of the joint counts; no pass over the data."""
    parts = []
    for c in columns:
        for x, y in pair_names(columns):
            if c in (x, y):
                own = joint.filter(F.col("pair") == f"{x}|{y}")
                parts.append(own.select(F.lit(c).alias("column"), "label", F.col("a" if c == x else "b").alias("value"), "n"))
                break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("column", "label", "value").agg(F.sum("n").alias("n"))


def fit_model(df: DataFrame, label: str, columns: list[str], continuous: list[str],
              mixtures: dict[str, Mixture] | None = None, ranges: dict[str, tuple | None] | None = None) -> Model:
    """Learn the tables: one pass for pairs, one histogram pass, one pass for component shares.

    Without known ``ranges`` of the numbers (see ``histogram``) one more pass finds them.
    """
    types = {c: df.schema[c].dataType for c in [label, *columns, *continuous]}
    joint = conditional = None
    if len(columns) >= 2:
        joint = materialize(joint_counts(df, label, columns), "joint")
        first = f"{columns[0]}|{columns[1]}"
        counts = joint.filter(F.col("pair") == first).groupBy("label").agg(F.sum("n").alias("n"))
        conditional = materialize(conditional_counts(joint, columns), "conditional")
    else:
        counts = category_counts(df, [label]).select(F.col("value").alias("label"), "n")
        if columns:
            one = df.groupBy(F.col(f"`{label}`").cast("string").alias("label"), F.col(columns[0]).cast("string").alias("value"))
            conditional = one.agg(F.count(F.lit(1)).alias("n")).withColumn("column", F.lit(columns[0]))
            conditional = materialize(conditional, "conditional")
    mixtures = fit_mixtures(df, continuous, ranges=ranges) if mixtures is None else mixtures
    components = materialize(label_components(df, label, mixtures), "components") if mixtures else None
    return Model(label, columns, mixtures, types, materialize(counts, "labels"), joint, conditional, components)


def component_value(component: Column, mix: Mixture, z: Column) -> Column:
    """Number of a component: ``clip(z, -1, 1) * 4 std + mean``."""
    at = component + 1
    z = F.greatest(F.least(z, F.lit(1.0)), F.lit(-1.0))
    return z * F.lit(SPREAD) * F.element_at(number_array(mix.stds), at) + F.element_at(number_array(mix.means), at)


def generate(model: Model, ids: DataFrame, id_cols: list[str], seed: int, given: bool = False) -> DataFrame:
    """One row per id: the id columns (and whatever else ``ids`` carries), label and all columns.

    With ``given`` the ids carry their ``label`` (text) and only the rest is drawn.
    """
    rows, key = ids, id_columns(id_cols)
    if len(model.columns) >= 2:
        rows = _with_pair(rows, model.columns, seed, key)
        u = uniform(seed, "triple", *key)
        rows = pick(rows, model.guide("pair" if given else "triple"), u)
        x, y = pair_columns()
        rows = rows.drop("n").withColumns({"_x": x, "_y": y})
    elif not given:
        rows = pick(rows, model.guide("label"), uniform(seed, "label", *key)).drop("n")
    return finish_rows(rows, ids, model, key, seed, {})


def finish_rows(rows: DataFrame, ids: DataFrame, model: Model, key: list[Column], seed: int, known: dict[str, Column]) -> DataFrame:
    """Draw what the label, and the pair (``_x``, ``_y``) with its values ``a`` and ``b``, leave open. Columns in ``known`` have their value already."""
    made = {}
    for c in model.columns:
        if c in known:
            made[c] = known[c].cast(model.types[c])
            continue
        if len(model.columns) > 2 or len(model.columns) == 1:
            rows = pick(rows, model.guide("value"), uniform(seed, f"value/{c}", *key), fixed={"column": c}).drop("n")
            rows = rows.withColumnRenamed("value", f"_own_{c}")
            value = F.col(f"`_own_{c}`")
        else:
            value = F.lit(None).cast("string")
        if len(model.columns) >= 2:
            value = F.when(F.col("_x") == c, F.col("a")).when(F.col("_y") == c, F.col("b")).otherwise(value)
        made[c] = value.cast(model.types[c])
    for c, mix in model.mixtures.items():
        if c in known:
            value = known[c]
        else:
            rows = pick(rows, model.guide("component"), uniform(seed, f"component/{c}", *key), fixed={"column": c}).drop("n")
            rows = rows.withColumnRenamed("component", f"_own_{c}")
            value = component_value(F.col(f"`_own_{c}`"), mix, normal(seed, f"z/{c}", *key) / F.lit(SPREAD))
        dtype = model.types[c]
        if is_time(dtype):
            made[c] = from_micros(F.rint(value), dtype)
        else:
            made[c] = back_to(F.rint(value) if isinstance(dtype, T.IntegralType) else value, dtype)
    carried = [c for c in ids.columns if c != "label"]
    label = F.col("label").cast(model.types[model.label]) if model.label in model.types else F.col("label")
    return rows.select(*[F.col(f"`{c}`") for c in carried], label.alias(model.label), *[v.alias(c) for c, v in made.items()])


def id_columns(id_cols: list[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in id_cols]


def _with_pair(rows: DataFrame, columns: list[str], seed: int, key) -> DataFrame:
    hashed = rows.withColumns({f"_key{i}": k for i, k in enumerate(key)})
    if len(key) == 1:
        return with_pair(hashed, "_key0", columns, seed).drop("_key0")
    joined = hashed.withColumn("_key", F.xxhash64(*[F.col(f"`_key{i}`").cast("bigint") for i in range(len(key))]))
    return with_pair(joined, "_key", columns, seed).drop("_key", *[f"_key{i}" for i in range(len(key))])


def finalize(rows: DataFrame, spec: TableSpec, constraints, seed: int, id_col: str, types: dict | None = None,
             total: int | None = None, keep: list[str] = ()) -> DataFrame:
    """Rebuild constraints, add ids and fresh personal values, cast, and order the fields as declared.

    ``id_col`` is the row's dense number: it becomes the generated id and keys the fake values.
    Columns named in ``keep`` are carried along in front if they are still there.
    """
    out = fresh_pii(reverse_all(rows, constraints), spec, seed, id_col)
    made = {}
    for f in spec.fields:
        if f.type == "id" and f.name not in out.columns:
            if total is not None:
                check_capacity(f, total)
            made[f.name] = id_value(F.col(f"`{id_col}`"), f)
    out = out.withColumns(made) if made else out
    extra = [c for c in [id_col, *keep] if c in out.columns and c not in spec.names()]
    fields = [_restored(out, f.name, (types or {}).get(f.name)) for f in spec.fields]
    return out.select(*[F.col(f"`{c}`") for c in extra], *fields)


def _restored(df: DataFrame, name: str, dtype: T.DataType | None) -> Column:
    """Column ``name`` in its original type."""
    value = F.col(f"`{name}`")
    if dtype is None or df.schema[name].dataType == dtype:
        return value
    return (back_to(value, dtype) if isinstance(dtype, T.NumericType) else value.cast(dtype)).alias(name)


def ids_only(spark: SparkSession, spec: TableSpec, n: int) -> DataFrame:
    """Rows of a table that consists of id fields only."""
    for f in spec.fields:
        check_capacity(f, n)
    return spark.range(n).select(*[id_value(F.col("id"), f).alias(f.name) for f in spec.fields])
