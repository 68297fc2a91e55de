"""Rows drawn under given values directly, instead of drawing and rejecting.

``generate`` draws a pair of columns, a triple (label, a, b) of that pair, and everything else given the label. Under given
values the same model has a closed form: for every distinct combination of given values the weights of (label, and whether both
columns of the pair are given) are products of learned counts. They become intervals keyed by the combination; the
joint table is read under its given columns as well. A value that one row in a million carries is therefore met by the first draw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.random import index_below, uniform
from ..functions.vectors import number_array
from ..session import materialize
from .frequency import pair_names
from .generate import Model, finish_rows, id_columns
from .intervals import build_guide, cumulative, pick
from .joins import lookup
from .mixture import Mixture, _number
from .ordinals import dense_index
from .sampling import pair_columns

KNOWN = "_known_"
SCALE = 1e12  # weights of a combination are integer shares of the largest one


def known_values(df: DataFrame, model: Model, columns: list[str], keep: list[str]) -> DataFrame:
    """``keep`` and the given values: categories and the label as text in their learned type, numbers as doubles."""
    made = []
    for c in columns:
        value = F.col(f"`{c}`")
        if c in model.mixtures:
            value = _number(df, c)
        else:
            value = (value.cast(model.types[c]) if c in model.types else value).cast("string")
        made.append(value.alias(KNOWN + c))
    return df.select(*[F.col(f"`{c}`") for c in keep], *made)


def _known(name: str) -> Column:
    return F.col(f"`{KNOWN}{name}`")


def relative_density(value: Column, mix: Mixture, shares: Column) -> Column:
    """Density of ``value`` under the components with the given shares, relative to the nearest component's height."""
    means, stds = number_array(mix.means), number_array(mix.stds)
    squares = F.zip_with(means, stds, lambda m, s: F.pow((value - m) / s, F.lit(2.0)))
    nearest = F.array_min(squares)
    heights = F.zip_with(squares, stds, lambda z, s: F.exp(F.lit(-0.5) * (z - nearest)) / s)
    return F.aggregate(F.zip_with(shares, heights, lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)


class ConditionIndex:
    """Intervals of a model re-keyed by the given columns of some conditions."""

    def __init__(self, model: Model, conditions: DataFrame, columns: list[str]):
        """``conditions`` hold the given values of ``columns`` as made by ``known_values``."""
        self.model, self.columns = model, columns
        self.categories = [c for c in model.columns if c in columns]
        self.numbers = [c for c in model.mixtures if c in columns]
        self.label = model.label in columns
        pairs = pair_names(model.columns) if len(model.columns) >= 2 else []
        self.closed = [(x, y) for x, y in pairs if x in self.categories and y in self.categories]
        self.open = [p for p in pairs if p not in self.closed]
        self.keys = [KNOWN + c for c in [*self.categories, *self.numbers, *([model.label] if self.label else [])]]
        self.combinations = materialize(conditions.select(*[F.col(f"`{k}`") for k in self.keys]).distinct(), "combinations")
        self.entries = materialize(self._entries(), "given-weights")
        self.guide = build_guide(cumulative(self.entries, self.keys, ["kind", "label"]), self.keys)

    def impossible(self) -> DataFrame:
        """The combinations that the model cannot produce."""
        return lookup(self.combinations, self.entries.select(*[F.col(f"`{k}`") for k in self.keys]).distinct(), self.keys, "left_anti", null_safe=True)

    # -- learning ------------------------------------------------------------------
    def _labels(self) -> DataFrame:
        """(combination, label, _n_label, _n_<category>): the labels under which every given category occurs."""
        counts = self.model.counts.select("label", F.col("n").alias("_n_label"))
        out, on = self.combinations, []
        if self.label:
            out, on = out.withColumn("label", _known(self.model.label)), ["label"]
        for c in self.categories:
            own = self.model.conditional.filter(F.col("column") == c).select("label", F.col("value").alias(KNOWN + c), F.col("n").alias(f"_n_{c}"))
            out, on = lookup(out, own, [*on, KNOWN + c], "inner", null_safe=True, salt_by=self.keys), ["label"]
        if on:
            return lookup(out, counts, on, "inner", null_safe=True, salt_by=self.keys)
        # only numbers are given: every label can have any number
        numbered = materialize(dense_index(counts, "label", "_nth"), "numbered-labels")
        every = out.withColumn("_nth", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(numbered.count() - 1).cast("bigint"))))
        return lookup(every, numbered, ["_nth"], "inner", salt_by=self.keys).drop("_nth")

    def _entries(self) -> DataFrame:
        """(combination, kind, label, n): ``kind`` is a pair whose columns are both given, or empty for all other pairs together."""
        rows = self._labels()
        for i, (x, y) in enumerate(self.closed):
            own = self.model.joint.filter(F.col("pair") == f"{x}|{y}")
            own = own.select("label", F.col("a").alias(KNOWN + x), F.col("b").alias(KNOWN + y), F.col("n").alias(f"_pair{i}"))
            rows = lookup(rows, own, ["label", KNOWN + x, KNOWN + y], "left", null_safe=True, salt_by=self.keys)
        for j, c in enumerate(self.numbers):
            rows = lookup(rows, self._shares(c, f"_shares{j}"), ["label"], "left", null_safe=True, salt_by=self.keys)
            shares = F.coalesce(F.col(f"_shares{j}"), number_array([0.0] * self.model.mixtures[c].size))
            rows = rows.withColumn(f"_number{j}", relative_density(_known(c), self.model.mixtures[c], shares))

        def weight(start: Column, without: tuple) -> Column:
            for c in self.categories:
                if c not in without:
                    start = start * (F.col(f"`_n_{c}`").cast("double") / F.col("_n_label").cast("double"))
            for j in range(len(self.numbers)):
                start = start * F.col(f"_number{j}")
            return start

        entries = [F.struct(F.lit(f"{x}|{y}").alias("kind"), weight(F.coalesce(F.col(f"_pair{i}"), F.lit(0)).cast("double"), (x, y)).alias("_w")) for i, (x, y) in enumerate(self.closed)]
        if self.open or not self.closed:
            others = float(max(len(self.open), 1))
            entries.append(F.struct(F.lit("").alias("kind"), weight(F.lit(others) * F.col("_n_label").cast("double"), ()).alias("_w")))
        keys = [F.col(f"`{k}`") for k in self.keys]
        rows = rows.select(*keys, "label", F.inline(F.array(*entries)))
        most = F.max("_w").over(Window.partitionBy(*keys))
        return rows.withColumn("n", F.round(F.try_divide(F.col("_w"), most) * F.lit(SCALE)).cast("bigint")).filter("n > 0").drop("_w")

    def _shares(self, column: str, name: str) -> DataFrame:
        """(label, shares of the components in their order)."""
        own = self.model.components.filter(F.col("column") == column)
        size = self.model.mixtures[column].size
        sums = [F.coalesce(F.sum(F.when(F.col("component") == k, F.col("n"))), F.lit(0)).cast("double") for k in range(size)]
        return own.groupBy("label").agg(F.sum("n").alias("_all"), F.array(*sums).alias("_own")).select(
            "label", F.transform("_own", lambda v: v / F.col("_all")).alias(name)
        )

    # -- drawing -------------------------------------------------------------------
    def generate(self, ids: DataFrame, id_cols: list[str], seed: int) -> DataFrame:
        """One row per id, as ``generate`` makes them, with the values that the ids carry; ids of impossible combinations give no row."""
        key = id_columns(id_cols)
        rows = pick(ids.drop("label"), self.guide, uniform(seed, "guided", *key)).drop("n")
        if self.model.joint is not None:
            rows = self._with_pair(rows, key, seed)
        return finish_rows(rows.drop("kind"), ids, self.model, key, seed, {c: _known(c) for c in [*self.categories, *self.numbers]})

    def _with_pair(self, rows: DataFrame, key, seed: int) -> DataFrame:
        """Add the pair and its two values: given ones as they are, the others from the joint table under the given ones."""
        if self.open:
            names = F.array(*[F.lit(f"{x}|{y}") for x, y in self.open])
            chosen = F.element_at(names, (index_below(uniform(seed, "pair", *key), len(self.open)) + 1).cast("int"))
            rows = rows.withColumn("_pair", F.when(F.col("kind") == "", chosen).otherwise(F.col("kind")))
        else:
            rows = rows.withColumn("_pair", F.col("kind"))
        rows = rows.withColumn("pair", F.col("_pair"))
        x, y = pair_columns()
        given = lambda name: F.coalesce(*[F.when(name == c, _known(c)) for c in self.categories], F.lit(None).cast("string"))
        holds = lambda name: F.coalesce(*[F.when(name == c, True) for c in self.categories], F.lit(False))
        rows = rows.withColumns({"_x": x, "_y": y}).withColumns({"_a": given(F.col("_x")), "_b": given(F.col("_y"))})
        has_a, has_b = holds(F.col("_x")), holds(F.col("_y"))
        cases = [("second", ["a"], {"_b": "b"}, has_a & ~has_b), ("first", ["b"], {"_a": "a"}, ~has_a & has_b), ("pair", [], {"_a": "a", "_b": "b"}, ~has_a & ~has_b)]
        for name, by, found, test in cases:
            # a case that no pair falls into needs no join
            if not any((x in self.categories, y in self.categories) == {"second": (True, False), "first": (False, True), "pair": (False, False)}[name] for x, y in self.open):
                continue
            rows = rows.withColumn("pair", F.when(test, F.col("_pair"))).withColumns({k: F.col(f"_{k}") for k in by})
            rows = pick(rows, self.model.guide(name), uniform(seed, f"guided/{name}", *key), how="left")
            drawn = F.col("pair").isNotNull()
            rows = rows.withColumns({k: F.when(drawn, F.col(v)).otherwise(F.col(k)) for k, v in found.items()}).drop("n", "a", "b")
        return rows.withColumns({"a": F.col("_a"), "b": F.col("_b")}).drop("_a", "_b", "_pair", "pair")
