"""Generate, filter, and generate again until enough rows hold.

Rounds use disjoint id ranges, so a row accepted once is never displaced. Every round is
written to the shared folder; the driver sees only counts.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.numbers import column, literal
from ..session import materialize
from .constraints import Constraint, Unique, filter_valid
from .joins import lookup
from .ordinals import dense_index, first_rows

MAX_RETRIES = 100  # fixed values of the sampling loop
MAX_ROWS_MULTIPLIER = 10
FLOAT_RTOL = 0.01
FAN = 1000  # attempts that one row lays out at once
TASK_ROWS = 1 << 22  # candidates that one task generates

Generator = Callable[[DataFrame], DataFrame]


def _is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def _matches(df: DataFrame, name: str, wanted, rtol: float):
    value = column(df, name)
    if _is_float(df.schema[name].dataType):
        return F.abs(value - wanted) < F.abs(wanted) * F.lit(rtol)
    return value == wanted


def filter_conditions(df: DataFrame, conditions: dict, rtol: float = FLOAT_RTOL) -> DataFrame:
    """Rows that meet the conditions. Floats match within ``rtol`` of the value and are then
    set to it; nothing is near zero in that sense, so a zero never matches."""
    for name, value in conditions.items():
        df = df.filter(_matches(df, name, literal(value), rtol))
        if _is_float(df.schema[name].dataType):
            df = df.withColumn(name, F.lit(float(value)).cast(df.schema[name].dataType))
    return df


def _filter_wanted(df: DataFrame, names: list[str], rtol: float) -> DataFrame:
    """As ``filter_conditions`` with each row's own wanted values in ``_want_<name>``."""
    for name in names:
        df = df.filter(_matches(df, name, F.col(f"`_want_{name}`"), rtol))
    set_to = {n: F.col(f"`_want_{n}`").cast(df.schema[n].dataType) for n in names if _is_float(df.schema[n].dataType)}
    return df.withColumns(set_to) if set_to else df


def _spans_rows(constraints) -> bool:
    """True if a verdict can depend on any other row, so that it must be judged on all rounds together."""
    return any(not isinstance(c, Unique) and not (c.row_local or getattr(c, "table", None) is not None) for c in constraints)


def filter_new(rows: DataFrame, constraints, accepted: list[DataFrame]) -> DataFrame:
    """As ``filter_valid`` for a further round: of rows with one key an accepted one stays, then the first new one.

    Only the new rows are judged. Accepted rows are met through their key columns alone, which are read from where they were written.
    """
    for c in constraints:
        rows = c.filter_valid(rows)
        if isinstance(c, Unique) and accepted:
            seen = reduce(DataFrame.unionByName, [a.select(*[F.col(f"`{k}`") for k in c.keys]) for a in accepted])
            rows = lookup(rows, seen, c.keys, "left_anti")
    return rows


def next_batch(wanted: int, valid: int, tried: int, multiplier: int = MAX_ROWS_MULTIPLIER) -> int:
    """Candidates of the next round, from the acceptance so far."""
    return min(int((wanted - valid) / ((valid + 1) / (tried + 1))), wanted * multiplier)


def sample_valid(spark: SparkSession, generator: Generator, constraints, n: int, max_retries: int = MAX_RETRIES,
                 max_rows_multiplier: int = MAX_ROWS_MULTIPLIER, conditions: dict | None = None,
                 rtol: float = FLOAT_RTOL, id_col: str = "cand_id", graceful: bool = False, max_candidates: int | None = None) -> DataFrame:
    """The first ``n`` generated rows that hold.

    ``generator`` maps a frame of candidate ids to rows that keep the id column. A round writes and judges its own rows only; a row accepted
    in one round stays when a later one repeats its unique key. When the retries, or ``max_candidates`` of all rounds, run out before
    ``n`` rows hold, that is an error, or with ``graceful`` a warning and fewer rows. A uniqueness rule over fewer keys than ``n`` can
    never be met; without ``max_candidates`` it is found out by all the retries.
    """
    if n <= 0:
        return generator(spark.range(0, 0).withColumnRenamed("id", id_col))
    together = _spans_rows(constraints)

    def judged(rows: DataFrame, accepted: list[DataFrame]) -> DataFrame:
        kept = filter_new(rows, constraints, accepted)
        return filter_conditions(kept, conditions, rtol) if conditions else kept

    parts: list[DataFrame] = []
    valid = tried = 0
    batch, most = n, float("inf") if max_candidates is None else max_candidates
    for _ in range(max_retries + 1):
        batch = min(batch, most - tried)
        tasks = max(spark.sparkContext.defaultParallelism, -(-batch // TASK_ROWS))
        ids = spark.range(tried, tried + batch, 1, tasks).withColumnRenamed("id", id_col)
        new = generator(ids)
        if together:
            parts = [materialize(judged(reduce(DataFrame.unionByName, [*parts, new]), []), "round")]
            valid = parts[0].count()
        else:
            parts.append(materialize(judged(new, parts), "round"))
            valid += parts[-1].count()
        tried += batch
        if valid >= n or tried >= most:
            break
        batch = next_batch(n, valid, tried, max_rows_multiplier)
    if valid < n:
        said = f"{n - valid} rows of {n} are still missing after " + (f"{tried} candidates" if tried >= most else f"{max_retries} retries")
        if not graceful:
            raise ValueError(said)
        warnings.warn(said, stacklevel=2)
    return first_rows(reduce(DataFrame.unionByName, parts), id_col, n)


def repeat_fill(rows: DataFrame, order_by, n: int, id_name: str = "fill_id") -> DataFrame:
    """Reach ``n`` rows by repeating: whole copies of ``rows`` in order, then its first rows."""
    indexed = dense_index(rows, order_by, "_nth")
    have = indexed.count()
    if not have:
        raise ValueError("there are no rows to repeat")
    slots = rows.sparkSession.range(n).withColumnRenamed("id", id_name)
    slots = slots.withColumn("_nth", F.col(id_name) % F.lit(have))
    return lookup(slots, materialize(indexed, "repeat"), ["_nth"], how="inner", salt_by=[id_name]).drop("_nth")


def make_conditions(spark: SparkSession, conditions, n: int | None = None) -> DataFrame:
    """Conditions as a frame with ``cond_id``: scalars give ``n`` equal rows, lists and frames
    one row each."""
    import pandas as pd

    if isinstance(conditions, pd.Series):
        conditions = conditions.to_dict()
    if isinstance(conditions, dict):
        lists = [v for v in conditions.values() if isinstance(v, (list, tuple, pd.Series))]
        if lists:
            frame = pd.DataFrame(conditions).reset_index(drop=True)
            return spark.createDataFrame(frame.rename_axis("cond_id").reset_index())
        if n is None:
            raise ValueError("conditions of single values need the number of rows")
        ids = spark.range(n).withColumnRenamed("id", "cond_id")
        return ids.withColumns({k: literal(v) for k, v in conditions.items()})
    if isinstance(conditions, pd.DataFrame):
        if n is not None and len(conditions) != n:
            raise ValueError("the number of rows must be None or match the conditions")
        return spark.createDataFrame(conditions.reset_index(drop=True).rename_axis("cond_id").reset_index())
    if isinstance(conditions, DataFrame):
        if n is not None and conditions.count() != n:
            raise ValueError("the number of rows must be None or match the conditions")
        if "cond_id" in conditions.columns:
            return conditions
        # the place of a row splits a condition that many rows share; it is written, so that it stays the same
        placed = materialize(conditions.withColumn("_place", F.monotonically_increasing_id()), "placed")
        return dense_index(placed, [*conditions.columns, "_place"], "cond_id").drop("_place")
    raise TypeError("conditions are a frame, a dictionary or a series")


def _attempts(pending: DataFrame, first: int, count: int, cond_id: str, fan: int = FAN) -> DataFrame:
    """Every row with each of its attempts ``first`` ... ``first + count - 1``.

    Many attempts of one row are laid out in levels of at most ``fan`` and spread in between, so that neither an array nor
    a task grows with ``count``.
    """
    step = 1
    while step * fan < count:
        step *= fan
    rows, width, last = pending.withColumn("attempt", F.lit(first).cast("bigint")), count, F.lit(first + count - 1).cast("bigint")
    while True:
        end = F.least(F.col("attempt") + F.lit(width - 1), last)
        rows = rows.withColumn("attempt", F.explode(F.sequence(F.col("attempt"), end, F.lit(step).cast("bigint"))))
        if step == 1:
            return rows
        rows = rows.repartition(cond_id, "attempt")
        width, step = step, step // fan


def sample_conditional(conditions: DataFrame, generator: Generator, constraints=(), fields=None,
                       max_retries: int = MAX_RETRIES, max_rows_multiplier: int = MAX_ROWS_MULTIPLIER,
                       rtol: float = FLOAT_RTOL, graceful: bool = False, cond_id: str = "cond_id", carry: list[str] = ()) -> DataFrame:
    """One generated row per condition row; the result carries ``cond_id``.

    Every condition makes its own numbered attempts and keeps the first that holds, all
    conditions in one plan per round. A condition shared by a third of the rows is therefore
    not one large group. ``generator`` receives (cond_id, attempt) and the wanted values as
    ``_want_<column>``, which it may use to draw fewer candidates in vain; it must keep them. The columns ``carry`` of the conditions
    are no wishes; they reach the generator as they are and are dropped at the end.
    Conditions with a null cannot match and are left out.
    """
    names = [c for c in conditions.columns if c != cond_id and c not in carry]
    for name in names:
        if fields is not None and name not in fields:
            raise ValueError(f"condition on the unknown column `{name}`")
    known = conditions
    for c in names:
        known = known.filter(column(conditions, c).isNotNull())
    wanted = known.select(cond_id, *[F.col(f"`{c}`").alias(f"_want_{c}") for c in names], *[F.col(f"`{c}`") for c in carry])
    wanted = pending = materialize(wanted, "conditions")
    row_wise = [c for c in constraints if not isinstance(c, Unique)]
    unique = [
        Unique([*[f"_want_{n}" for n in names], *c.keys], [cond_id, "attempt"]) for c in constraints if isinstance(c, Unique)
    ]
    done: DataFrame | None = None
    accepted: list[DataFrame] = []
    asked = waiting = wanted.count()
    first, per_row = 0, 1
    for _ in range(max_retries + 1 if asked else 0):
        tries = _attempts(pending, first, per_row, cond_id)
        rows = _filter_wanted(filter_valid(generator(tries), row_wise), names, rtol)
        cells = [c for c in rows.columns if c not in (cond_id, "attempt")]
        if per_row == 1:  # one candidate per condition: nothing to choose from
            best = rows.select(cond_id, "attempt", *[F.col(f"`{c}`") for c in cells])
        else:
            best = rows.groupBy(cond_id).agg(
                F.min("attempt").alias("attempt"), F.min_by(F.struct(*[F.col(f"`{c}`") for c in cells]), "attempt").alias("_row")
            )
            best = best.select(cond_id, "attempt", *[F.col(f"_row.`{c}`").alias(c) for c in cells])
        best = materialize(filter_new(best, unique, accepted), "accepted")
        accepted.append(best)
        done = best if done is None else done.unionByName(best)
        pending = materialize(pending.join(best.select(cond_id), cond_id, "left_anti"), "pending")
        waiting = pending.count()
        if not waiting:
            break
        first += per_row
        per_row = max(1, min(asked * max_rows_multiplier // waiting, per_row * 4))
    left = waiting
    if left:
        groups = [f"_want_{n}" for n in names]
        served = done.select(*groups).distinct()
        if not pending.select(*groups).distinct().join(served, groups, "left_anti").isEmpty():
            raise ValueError("some conditions were never met")
        if not graceful:
            raise ValueError(f"some rows are still missing after {max_retries} retries")
        warnings.warn(f"{left} rows are still missing after {max_retries} retries", stacklevel=2)
    if done is None:
        done = generator(wanted.withColumn("attempt", F.lit(0)))
    return done.drop("attempt", *[f"_want_{n}" for n in names], *carry)


__all__ = [
    "Constraint", "filter_conditions", "make_conditions", "next_batch", "repeat_fill", "sample_conditional", "sample_valid",
]
