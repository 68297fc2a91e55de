"""Column model of any width: a covariance of low rank plus a diagonal.

Every category of a column and every number is one dimension. A distributed randomised range finder learns the leading directions: a
row's dimensions are projected on random vectors that are hashes of the dimension, so nothing as wide as the model travels with the rows, and one
vector sum per dimension comes back. The dimensions, with their loadings, stay a written table. Given some columns, the expected factors of a
row follow by the Woodbury identity from the loadings of its own values alone, and the wanted columns follow from the factors one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.numbers import as_number, back_to, from_micros, is_time, time_number
from ..functions.random import normal, uniform
from ..functions.vectors import dot, number_array
from ..session import BROADCAST_BYTES, fits_broadcast, materialize
from .frequency import category_counts, text_of
from .joins import lookup

RANK = 32
OVERSAMPLED = 8
TASK_ROWS = 1 << 18  # rows of an input that one task writes
FLOOR = 1e-6  # least share of a dimension's variance that is its own


def _is_category(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.BooleanType))


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _times(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x * k)


def _moved(vector: Column, matrix: np.ndarray) -> Column:
    """``matrix @ vector``."""
    return F.array(*[dot(number_array(row.tolist()), vector) for row in matrix])


def _gram(df: DataFrame, name: str, width: int) -> np.ndarray:
    """Sum of the outer products of the vectors ``name``: ``width`` rows of every task, added up by row."""

    def products(batches):
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                y = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                total += y.T @ y
        yield pa.record_batch({"row": pa.array(range(width), pa.int32()), "sums": pa.array(list(total), pa.list_(pa.float64()))})

    parts = df.select(name).mapInArrow(products, "row int, sums array<double>")
    summed = parts.groupBy("row").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums")).collect()  # width rows
    out = np.zeros((width, width))
    for r in summed:
        out[r["row"]] = r["sums"]
    return out


def _projected(rows: DataFrame, named: list[str], vectors: DataFrame, own: list, centre, name: str) -> DataFrame:
    """Add ``name``: the sum of the ``vectors`` (column, value, vector) of a row's categories and of its numbers times their ``own`` ones, less ``centre``."""
    fits = fits_broadcast(vectors) or None  # a table that does not fit is measured by column
    out = rows.withColumn(name, number_array([-v for v in centre]))
    for i, c in enumerate(named):
        side = vectors.filter(F.col("column") == c).select(F.col("value").alias(f"_v{i}"), F.col("vector").alias("_vector"))
        out = lookup(out, side, [f"_v{i}"], "inner", null_safe=True, salt_by=["_row"], fits=fits)
        out = out.withColumn(name, _plus(F.col(name), F.col("_vector"))).drop("_vector")
    for i, vector in enumerate(own):
        out = out.withColumn(name, _plus(F.col(name), _times(number_array([float(v) for v in vector]), F.col(f"_x{i}"))))
    return out


def _sums_by_dimension(rows: DataFrame, named: list[str], plain: list[str], name: str, width: int) -> DataFrame:
    """(column, value, ``name``): the sum of the vectors ``name`` of the rows with each category, and of their products with each number.

    Every batch adds up its own rows first; the sums of the batches are added by dimension.
    """

    def sums(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            columns, values, parts = [], [], []
            for i, c in enumerate(named):
                coded = batch.column(f"_v{i}").dictionary_encode(null_encoding="encode")
                codes = coded.indices.to_numpy(zero_copy_only=False)
                order = np.argsort(codes, kind="stable")
                parts.append(np.add.reduceat(y[order], np.searchsorted(codes[order], np.arange(len(coded.dictionary))), axis=0))
                columns += [c] * len(coded.dictionary)
                values += coded.dictionary.to_pylist()
            for i, c in enumerate(plain):
                parts.append(batch.column(f"_x{i}").to_numpy(zero_copy_only=False)[None, :] @ y)
                columns.append(c)
                values.append(None)
            flat = np.concatenate(parts)
            yield pa.record_batch({
                "column": pa.array(columns, pa.string()), "value": pa.array(values, pa.string()),
                "sums": pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * width, pa.int32()), pa.array(flat.ravel())),
            })

    parts = rows.select(*[f"_v{i}" for i in range(len(named))], *[f"_x{i}" for i in range(len(plain))], name)
    parts = parts.mapInArrow(sums, "column string, value string, sums array<double>")
    return parts.groupBy("column", "value").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias(name))


class FactorModel:
    """``table``: (column, value, mean, var, load, own) of every dimension; ``numbers``: mean and deviation of the numeric columns."""

    def __init__(self, columns: list[str], types: dict, table: DataFrame, numbers: dict, rank: int):
        self.columns, self.types, self.table, self.numbers, self.rank = columns, types, table, numbers, rank

    # -- learning ------------------------------------------------------------------
    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], rank: int = RANK, seed: int = 5) -> FactorModel:
        types = {c: df.schema[c].dataType for c in columns}
        named, plain = [c for c in columns if _is_category(types[c])], [c for c in columns if not _is_category(types[c])]
        number = lambda c: time_number(df, c).cast("double") if is_time(types[c]) else as_number(df, c)
        found = df.agg(F.count(F.lit(1)).alias("n"), *[f(number(c)).alias(f"{k}_{c}") for c in plain for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        numbers = {c: (float(found[f"m_{c}"] or 0.0), float(found[f"s_{c}"] or 0.0) or 1.0) for c in plain}
        total, width = max(found["n"], 1), rank + OVERSAMPLED

        share = F.col("n") / F.lit(float(total))
        dims = category_counts(df, named).select("column", "value", share.alias("mean"), (share * (1 - share)).alias("var")) if named else None
        for c in plain:
            one = df.sparkSession.range(1).select(F.lit(c).alias("column"), F.lit(None).cast("string").alias("value"), F.lit(0.0).alias("mean"), F.lit(1.0).alias("var"))
            dims = one if dims is None else dims.unionByName(one)
        dims = materialize(dims, "dimensions")

        # the range: one sum of projected rows for every dimension, whose random vector is drawn once
        mark = F.xxhash64(F.col("column"), F.col("value").isNull(), F.col("value"))
        draws = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda j: normal(seed, "omega", F.col("_mark"), j))
        drawn = materialize(dims.withColumn("_mark", mark).withColumn("vector", draws).select("column", "value", "mean", "vector"), "draws")
        centre = drawn.agg(vector_to_array(Summarizer.sum(array_to_vector(_times(F.col("vector"), F.col("mean"))))).alias("c")).first()["c"]
        cells = [text_of(df, c).alias(f"_v{i}") for i, c in enumerate(named)]
        cells += [F.coalesce((number(c) - m) / s, F.lit(0.0)).alias(f"_x{i}") for i, (c, (m, s)) in enumerate(numbers.items())]
        tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_ROWS))  # a few bytes of a row are much work
        rows = materialize(df.select(*cells).repartition(tasks).withColumn("_row", F.monotonically_increasing_id()), "entries")

        def of_numbers(vectors: DataFrame, size: int) -> list:
            found = {r["column"]: r["vector"] for r in vectors.filter(F.col("column").isin(*plain)).collect()} if plain else {}
            return [found.get(c, [0.0] * size) for c in plain]

        summed = _sums_by_dimension(_projected(rows, named, drawn, of_numbers(drawn, width), centre, "_y"), named, plain, "_y", width)
        summed = materialize(summed.withColumn("_y", _times(F.col("_y"), F.lit(1.0 / total))), "range")

        # an orthonormal basis of the range, the covariance inside it, and its leading directions
        values, vectors = np.linalg.eigh(_gram(summed, "_y", width))
        keep = values > max(values.max(), 0.0) * 1e-12
        basis = vectors[:, keep] / np.sqrt(values[keep]) if keep.any() else np.zeros((width, 1))
        inner = basis.shape[1]
        based = materialize(summed.select("column", "value", _moved(F.col("_y"), basis.T).alias("q")), "basis")
        mean_of = lookup(based, dims, ["column", "value"], "inner", null_safe=True).agg(
            vector_to_array(Summarizer.sum(array_to_vector(_times(F.col("q"), F.col("mean"))))).alias("c")).first()["c"]
        vectors = based.withColumnRenamed("q", "vector")
        z = _projected(rows, named, vectors, of_numbers(vectors, inner), mean_of, "z")
        values, turn = np.linalg.eigh(_gram(z, "z", inner) / total)
        order = np.argsort(-values)[: min(rank, inner)]
        lead = turn[:, order] * np.sqrt(np.clip(values[order], 0.0, None))
        loads = lookup(based.select("column", "value", _moved(F.col("q"), lead.T).alias("load")), dims, ["column", "value"], "inner", null_safe=True)
        own = F.greatest(F.col("var") - dot(F.col("load"), F.col("load")), F.col("var") * F.lit(FLOOR) + F.lit(1e-12))
        table = materialize(loads.select("column", "value", "mean", "var", "load", own.alias("own")), "factor-loads")
        return cls(list(columns), types, table, numbers, lead.shape[1])

    def covariance(self, pairs: DataFrame, a: str, b: str) -> DataFrame:
        """Add ``cov`` to the pairs (a, b) of categories of two columns, as the model has it."""
        side = lambda c, n: self.table.filter(F.col("column") == c).select(F.col("value").alias(n), F.col("load").alias(f"_{n}"))
        met = lookup(lookup(pairs, side(a, "a"), ["a"], "inner", null_safe=True), side(b, "b"), ["b"], "inner", null_safe=True)
        return met.withColumn("cov", dot(F.col("_a"), F.col("_b"))).drop("_a", "_b")

    # -- drawing -------------------------------------------------------------------
    def _posterior(self, given: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Covariance of the factors once all dimensions of ``given`` are known, and what their means contribute."""
        own = self.table.filter(F.col("column").isin(*given))
        scaled = own.select(_times(F.col("load"), F.lit(1.0) / F.sqrt("own")).alias("v"))
        inner = np.linalg.inv(np.eye(self.rank) + _gram(scaled, "v", self.rank))
        offset = own.agg(vector_to_array(Summarizer.sum(array_to_vector(_times(F.col("load"), F.col("mean") / F.col("own"))))).alias("c")).first()["c"]
        return inner, np.asarray(offset)

    def factors(self, df: DataFrame, given: list[str], ids, name: str = "_factors") -> tuple[DataFrame, np.ndarray]:
        """Add the expected factors of each row given its columns ``given``; also their covariance, which is the same for all rows."""
        inner, offset = self._posterior(given)
        out, total = df.withColumn("_sum", number_array((-offset).tolist())), F.col("_sum")
        for c in given:
            if c in self.numbers:
                load, own = self._load(c)
                m, s = self.numbers[c]
                value = time_number(df, c).cast("double") if is_time(self.types[c]) else as_number(df, c)
                total = _plus(total, _times(number_array(load), F.coalesce((value - m) / s, F.lit(0.0)) / F.lit(own)))
            else:
                side = self.table.filter(F.col("column") == c).select(F.col("value").alias(f"_v_{c}"), _times(F.col("load"), F.lit(1.0) / F.col("own")).alias(f"_l_{c}"))
                out = lookup(out.withColumn(f"_v_{c}", text_of(df, c)), side, [f"_v_{c}"], null_safe=True, salt_by=list(ids))
                total = _plus(total, F.coalesce(F.col(f"_l_{c}"), number_array([0.0] * self.rank)))
        return out.withColumn(name, _moved(total, inner)).drop("_sum", *[f"_{k}_{c}" for c in given if c not in self.numbers for k in "vl"]), inner

    def _load(self, column: str) -> tuple[list[float], float]:
        return tuple(self.table.filter(F.col("column") == column).select("load", "own").first())

    def _number(self, column: str, inner: np.ndarray, seed: int, ids) -> Column:
        """A number: what its factors expect, and noise as large as they and its own part leave open."""
        load, own = self._load(column)
        m, s = self.numbers[column]
        spread = float(np.sqrt(own + np.asarray(load) @ inner @ np.asarray(load)))
        return F.lit(m) + F.lit(s) * (dot(number_array(load), F.col("_factors")) + F.lit(spread) * normal(seed, f"own/{column}", *ids))

    def sample_given(self, df: DataFrame, given: list[str], wanted: list[str], seed: int, ids) -> DataFrame:
        """Add decoded draws of ``wanted`` given the row's ``given`` columns; each drawn column is given to the next.

        A category is drawn by the probabilities that the expected factors give to the categories of its column, negative ones counting as none.
        """
        out, known = df, list(given)
        for c in wanted:
            dtype = self.types[c]
            out, inner = self.factors(out, known, ids)
            if c in self.numbers:
                value = self._number(c, inner, seed, ids)
                out = out.withColumn(c, from_micros(F.rint(value), dtype) if is_time(dtype) else back_to(F.rint(value) if isinstance(dtype, T.IntegralType) else value, dtype))
            else:
                out = self._categories(out.withColumn("_u", uniform(seed, f"category/{c}", *ids)), c).withColumn(c, F.col("_drawn").cast(dtype)).drop("_u", "_drawn")
            out, known = out.drop("_factors"), [*known, c]
        return out

    def _categories(self, df: DataFrame, column: str) -> DataFrame:
        """Add ``_drawn``: one product of a batch's factors with the loadings of a column's categories."""
        own = self.table.filter(F.col("column") == column).select("value", "mean", "load").toArrow().sort_by([("mean", "descending"), ("value", "ascending")])
        if own.nbytes > BROADCAST_BYTES:
            raise ValueError(f"the categories of `{column}` take {own.nbytes} bytes, too much for a draw")
        means, loads = own.column("mean").to_numpy(), np.stack(own.column("load").to_pylist())
        shared = df.sparkSession.sparkContext.broadcast((own.column("value").to_pylist(), means, loads))

        def draw(batches):
            values, means, loads = shared.value
            values = pa.array(values, pa.string())
            for batch in batches:
                if not batch.num_rows:
                    continue
                picked = []
                for low in range(0, batch.num_rows, 512):
                    some = batch.slice(low, 512)
                    f = some.column("_factors").flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1)
                    upto = np.cumsum(np.clip(means + f @ loads.T, 0.0, None), axis=1)
                    u = some.column("_u").to_numpy(zero_copy_only=False) * upto[:, -1]
                    picked.append(np.minimum((upto <= u[:, None]).sum(axis=1), len(means) - 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, values.take(pa.array(np.concatenate(picked)))], names=[*batch.schema.names, "_drawn"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        return df.mapInArrow(draw, f"{fields}, _drawn string")

    def draw_given(self, df: DataFrame, given, wanted, seed: int = 0, id_col: str | None = None) -> DataFrame:
        """Add raw draws ``_draw_<column>`` of numeric columns given other columns of the row."""
        if id_col is None:
            df = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
        ids = [id_col or "_row"]
        out, inner = self.factors(df, given, ids)
        out = out.withColumns({f"_draw_{c}": self._number(c, inner, seed, ids) for c in wanted})
        return out.drop("_factors", *(["_row"] if id_col is None else []))
