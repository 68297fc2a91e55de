"""Private releases of learned tables, and one account of what they cost together.

Normal noise belongs to every cell of a public domain, but most cells of a large domain are empty and stay below the threshold.
Noise is therefore added to the observed cells only; which empty cells come above the threshold is drawn directly: each does so with the tail
probability of the noise, so the gaps between them are geometric, and their values are drawn from the tail. The outcome is
distributed as if every cell had been listed; the work grows with the observed and the surviving cells.

A release whose tables one entity moves by at most ``m`` in the L2 norm gets noise of deviation ``sigma * m`` and costs
``alpha / (2 sigma^2)`` at Renyi order ``alpha``. Releases add up in a ``Ledger``; whatever is computed from released tables is free.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.random import normal, uniform, upper_quantile
from ..session import materialize
from .frequency import joint_counts, pair_names, text_of
from .generate import Model, conditional_counts
from .intervals import power_of_two
from .joins import lookup
from .mixture import ITERATIONS, MAX_CLUSTERS, WEIGHT_THRESHOLD, _em, _number, read_mixtures, with_probabilities
from .ordinals import dense_index
from .privacy import DELTA, MAX_ORDER, SIGMA, cap_rows, secret_seed

BLOCK_SURVIVORS = 64  # expected survivors of a block of cells
MOST_GAPS = 288  # a block has more survivors than this with probability below 1e-90
BINS = 64  # of a number between its public bounds


@dataclass
class Ledger:
    """Releases with their noise multipliers, and the epsilon of all of them together."""

    delta: float = DELTA
    entries: list[tuple[str, float]] = field(default_factory=list)

    def charge(self, name: str, sigma: float) -> None:
        self.entries.append((name, float(sigma)))

    @property
    def epsilon(self) -> float:
        """The best Renyi order on a grid up to 128."""
        rate = sum(1 / (2 * s**2) for _, s in self.entries)
        if not rate:
            return 0.0
        orders = [1 + i / 10 for i in range(1, int((MAX_ORDER - 1) * 10) + 1)]
        return min(a * rate + math.log(1 / self.delta) / (a - 1) for a in orders)


@dataclass
class Private:
    """How a table is learned privately.

    An entity (a person, say) is protected, of whom at most ``max_rows_per_entity`` rows count, the first by ``order_by``. ``domain`` lists the public
    values of the label and of every discrete column, ``bounds`` the public range of every number; columns named in neither are not learned. Cells
    below ``threshold`` noise deviations are dropped. Without a ``seed`` a secret one is drawn.
    """

    entity: str
    order_by: list[str]
    domain: dict[str, DataFrame | list]
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    max_rows_per_entity: int = 1
    sigma: float = SIGMA
    delta: float = DELTA
    threshold: float = 2.0
    seed: int | None = None


def tail_probability(threshold: float) -> float:
    """Probability that a standard normal number is at least ``threshold``."""
    return 0.5 * math.erfc(threshold / math.sqrt(2.0))


@dataclass
class Cells:
    """Tables of numbered cells, one after the other: (name, first cell, size)."""

    tables: list[tuple[str, int, int]]

    @classmethod
    def of(cls, sizes: list[tuple[str, int]]) -> Cells:
        out, start = [], 0
        for name, size in sizes:
            out.append((name, start, size))
            start += size
        return cls(out)


def _by_number(number, starts: list[int]):
    """0-based place of the last start that is not above ``number``; there are as many starts as tables."""
    return F.size(F.filter(F.array(*[F.lit(s).cast("bigint") for s in starts]), lambda s: s <= number)) - 1


def surviving_cells(spark: SparkSession, cells: Cells, seed: int, threshold: float) -> DataFrame:
    """(table, cell, z): cells whose noise alone reaches ``threshold`` deviations, and the noise.

    Cells are cut into blocks that hold ``BLOCK_SURVIVORS`` such cells on average; the gaps in a block are drawn one after the other.
    """
    p = min(tail_probability(threshold), 1.0 - 2.0**-53)
    width = power_of_two(math.ceil(BLOCK_SURVIVORS / p))
    blocks = [-(-size // width) for _, _, size in cells.tables]
    first_block = [sum(blocks[:i]) for i in range(len(blocks))]
    at = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("_i") + 1)
    rows = spark.range(sum(blocks)).withColumnRenamed("id", "block").withColumn("_i", _by_number(F.col("block"), first_block))
    rows = rows.withColumn("_from", (F.col("block") - at([int(b) for b in first_block]).cast("bigint")) * F.lit(width))
    rows = rows.select("block", at([n for n, _, _ in cells.tables]).alias("table"), at([s for _, s, _ in cells.tables]).cast("bigint").alias("_start"),
                       "_from", F.least(F.lit(width).cast("bigint"), at([k for _, _, k in cells.tables]).cast("bigint") - F.col("_from")).alias("_width"))
    gap = lambda draw: F.floor(F.ln(uniform(seed, "gap", "block", draw)) / F.lit(math.log1p(-p))).cast("bigint")
    gaps = rows.withColumn("gaps", F.transform(F.sequence(F.lit(0), F.lit(MOST_GAPS - 1)), gap))
    zero = F.struct(F.lit(-1).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("found"))
    walked = F.aggregate(
        "gaps", zero,
        lambda s, g: F.when(s["at"] < F.col("_width"), F.struct((s["at"] + g + 1).alias("at"), F.concat(s["found"], F.array(s["at"] + g + 1)).alias("found"))).otherwise(s),
    )
    found = gaps.select("table", "_start", "_from", "_width", F.explode(walked["found"]).alias("_at")).filter("_at < _width")
    found = found.select("table", (F.col("_start") + F.col("_from") + F.col("_at")).alias("cell"))
    return found.withColumn("z", upper_quantile(F.lit(p) * uniform(seed, "tail", "cell")))


def sparse_release(observed: DataFrame, cells: Cells, seed: int, deviation: float, threshold: float) -> DataFrame:
    """(table, cell, noisy): noisy counts of at least ``threshold`` deviations.

    ``observed`` are the counts (table, cell, n) of non-empty cells, ``cell`` numbering all tables together. Null counts nothing.
    """
    own = materialize(observed.groupBy("table", "cell").agg(F.sum("n").alias("n")), "observed-cells")
    kept = own.withColumn("noisy", F.col("n") + normal(seed, "noise", "cell") * F.lit(deviation)).filter(F.col("noisy") >= threshold * deviation)
    spare = surviving_cells(observed.sparkSession, cells, seed, threshold).withColumn("noisy", F.col("z") * F.lit(deviation))
    spare = lookup(spare, own.select("cell"), ["cell"], "left_anti")
    return kept.select("table", "cell", "noisy").unionByName(spare.select("table", "cell", "noisy"))


class Domain:
    """Public values of some columns, numbered per column in the order of their text."""

    def __init__(self, spark: SparkSession, values: dict[str, DataFrame | list], columns: list[str]):
        parts = None
        for i, c in enumerate(columns):
            own = values[c]
            if not isinstance(own, DataFrame):
                own = spark.createDataFrame([(None if v is None else str(v),) for v in own], "value string")
            own = own.select(F.lit(i).alias("place"), F.lit(c).alias("column"), F.col("value").cast("string").alias("value"))
            parts = own if parts is None else parts.unionByName(own)
        numbered = dense_index(parts.distinct(), ["place", "value"], "number")
        self.codes = materialize(numbered, "domain-codes")
        spans = self.codes.groupBy("column").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n")).collect()  # one row per column
        self.first = {r["column"]: r["first"] for r in spans}
        self.size = {r["column"]: r["n"] for r in spans}

    def code(self, df: DataFrame, column_of, value: str, name: str) -> DataFrame:
        """Add the number of ``value`` in the column ``column_of``; rows with a value outside the domain go."""
        found = self.codes.select(F.col("column").alias("_column"), F.col("value").alias(value), F.col("number").alias(name))
        out = lookup(df.withColumn("_column", column_of), found, ["_column", value], "inner", null_safe=True, salt_by=df.columns)
        return out.withColumn(name, F.col(name) - self._first(F.col("_column"))).drop("_column")

    def value(self, df: DataFrame, column_of, code: str, name: str) -> DataFrame:
        """Add the value with a number of the column ``column_of``."""
        found = self.codes.select(F.col("number").alias("_number"), F.col("value").alias(name))
        out = df.withColumn("_number", F.col(code) + self._first(column_of))
        return lookup(out, found, ["_number"], "inner", salt_by=df.columns).drop("_number")

    def _first(self, column_of):
        return F.coalesce(*[F.when(column_of == c, F.lit(n)) for c, n in self.first.items()]).cast("bigint")


def _pair_sides():
    return F.substring_index("pair", "|", 1), F.substring_index("pair", "|", -1)


def release_joint(rows: DataFrame, label: str, columns: list[str], domain: Domain, seed: int, deviation: float, threshold: float) -> DataFrame:
    """(pair, label, a, b, n): the joint counts as they are released, rounded; the domain's product is never listed."""
    pairs = pair_names(columns)
    cells = Cells.of([(f"{x}|{y}", domain.size[label] * domain.size[x] * domain.size[y]) for x, y in pairs])
    counts = joint_counts(rows, label, columns)
    x, y = _pair_sides()
    for of, value, name in ((F.lit(label), "label", "_l"), (x, "a", "_a"), (y, "b", "_b")):
        counts = domain.code(counts, of, value, name)
    pick = lambda values: F.coalesce(*[F.when(F.col("pair") == n, F.lit(v)) for n, v in values.items()]).cast("bigint")
    starts = pick({n: s for n, s, _ in cells.tables})
    size_a, size_b = pick({f"{a}|{b}": domain.size[a] for a, b in pairs}), pick({f"{a}|{b}": domain.size[b] for a, b in pairs})
    observed = counts.select(F.col("pair").alias("table"), (starts + (F.col("_l") * size_a + F.col("_a")) * size_b + F.col("_b")).alias("cell"), "n")
    kept = sparse_release(observed, cells, seed, deviation, threshold)
    kept = kept.select(F.col("table").alias("pair"), "cell", "noisy").withColumn("_c", F.col("cell") - starts)
    div = lambda a, b: F.call_function("div", a, b)
    kept = kept.withColumns({"_l": div(F.col("_c"), size_a * size_b), "_a": div(F.col("_c"), size_b) % size_a, "_b": F.col("_c") % size_b})
    for of, code, name in ((F.lit(label), "_l", "label"), (x, "_a", "a"), (y, "_b", "b")):
        kept = domain.value(kept, of, code, name)
    return kept.select("pair", "label", "a", "b", F.round("noisy").cast("bigint").alias("n")).filter("n > 0")


def release_bins(rows: DataFrame, label: str, bounds: dict[str, tuple[float, float]], domain: Domain, seed: int, deviation: float,
                 threshold: float, bins: int = BINS) -> DataFrame:
    """(column, label, bin, x, width, n): released histograms of the numbers under each label; numbers outside their bounds count at the edge."""
    entries = []
    for c, (low, high) in bounds.items():
        place = F.floor((_number(rows, c) - F.lit(float(low))) / F.lit((high - low) / bins))
        place = F.greatest(F.least(place, F.lit(bins - 1)), F.lit(0)).cast("bigint")
        entries.append(F.struct(F.lit(c).alias("column"), place.alias("bin")))
    flat = rows.select(text_of(rows, label).alias("label"), F.inline(F.array(*entries))).filter("bin is not null")
    counts = flat.groupBy("column", "label", "bin").agg(F.count(F.lit(1)).alias("n"))
    counts = domain.code(counts, F.lit(label), "label", "_l")
    cells = Cells.of([(c, domain.size[label] * bins) for c in bounds])
    starts = lambda c: F.coalesce(*[F.when(c == n, F.lit(s)) for n, s, _ in cells.tables]).cast("bigint")
    observed = counts.select(F.col("column").alias("table"), (starts(F.col("column")) + F.col("_l") * bins + F.col("bin")).alias("cell"), "n")
    kept = sparse_release(observed, cells, seed, deviation, threshold)
    kept = kept.select(F.col("table").alias("column"), (F.col("cell") - starts(F.col("table"))).alias("_c"), "noisy")
    kept = kept.withColumns({"bin": F.col("_c") % bins, "_l": F.call_function("div", F.col("_c"), F.lit(bins).cast("bigint"))})
    kept = domain.value(kept, F.lit(label), "_l", "label")
    of = lambda values: F.coalesce(*[F.when(F.col("column") == c, F.lit(float(v))) for c, v in values.items()])
    width = of({c: (high - low) / bins for c, (low, high) in bounds.items()})
    centre = of({c: low for c, (low, high) in bounds.items()}) + (F.col("bin") + F.lit(0.5)) * width
    return kept.select("column", "label", "bin", centre.alias("x"), width.alias("width"), F.round("noisy").cast("bigint").alias("n")).filter("n > 0")


def binned_mixtures(hist: DataFrame, columns: list[str], max_clusters: int = MAX_CLUSTERS):
    """Components by column, fitted to released histograms; each task sees the bins of one column."""
    spread = F.col("x") * F.col("x") + F.col("width") * F.col("width") / 12
    bins = hist.groupBy("column", "bin").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("x")).alias("total"), F.sum(F.col("n") * spread).alias("squares"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        return _em(pdf, max_clusters, WEIGHT_THRESHOLD, ITERATIONS)

    schema = "column string, component int, mean double, std double, weight double, converged boolean"
    return read_mixtures(bins.groupBy("column").applyInPandas(fit, schema), columns)


def binned_components(hist: DataFrame, mixtures: dict, scale: float = 1e6) -> DataFrame:
    """(label, column, component, n): how much of each label's released bins each component explains."""
    out = None
    for c, mix in mixtures.items():
        own = with_probabilities(hist.filter(F.col("column") == c), F.col("x"), mix, "_q")
        sums = [F.sum(F.col("n") * F.col(f"_q{i}")).alias(f"_q{i}") for i in range(mix.size)]
        one = own.groupBy("label").agg(*sums)
        entries = [F.struct(F.lit(i).alias("component"), F.round(F.col(f"_q{i}") * F.lit(scale)).cast("bigint").alias("n")) for i in range(mix.size)]
        one = one.select("label", F.lit(c).alias("column"), F.inline(F.array(*entries))).filter("n > 0")
        out = one if out is None else out.unionByName(one)
    return out


def fit_private_model(df: DataFrame, label: str, how: Private) -> tuple[Model, Ledger]:
    """A model of the columns in ``how.domain`` and ``how.bounds``, learned from released tables only.

    Two releases at most: the joint counts of all pairs of discrete columns, and the histograms of all numbers under each label. Label counts,
    frequencies given the label, mixtures and their shares are computed from those.
    """
    spark = df.sparkSession
    columns, seed = [c for c in how.domain if c != label], secret_seed() if how.seed is None else how.seed
    if label not in how.domain:
        raise ValueError(f"the public values of the label `{label}` are needed")
    if len(columns) < 2:
        raise ValueError("a private model needs two discrete columns or more besides the label")
    numbers = {c: (float(low), float(high)) for c, (low, high) in how.bounds.items()}
    types = {c: df.schema[c].dataType for c in [label, *columns, *numbers]}
    needed = list(dict.fromkeys([how.entity, *how.order_by, label, *columns, *numbers]))
    capped = cap_rows(df.select(*[F.col(f"`{c}`") for c in needed]), how.entity, how.order_by, how.max_rows_per_entity)
    capped = materialize(capped, "capped")
    domain, ledger = Domain(spark, how.domain, [label, *columns]), Ledger(how.delta)

    moved = how.max_rows_per_entity * math.sqrt(len(pair_names(columns)))
    joint = materialize(release_joint(capped, label, columns, domain, seed, how.sigma * moved, how.threshold), "joint")
    ledger.charge("joint counts", how.sigma)
    conditional = materialize(conditional_counts(joint, columns), "conditional")
    first = f"{columns[0]}|{columns[1]}"
    counts = materialize(joint.filter(F.col("pair") == first).groupBy("label").agg(F.sum("n").alias("n")), "labels")
    # a label that only other pairs kept has no share of the rows
    conditional = materialize(lookup(conditional, counts.select("label"), ["label"], "left_semi", null_safe=True), "conditional")
    mixtures, components = {}, None
    if numbers:
        moved = how.max_rows_per_entity * math.sqrt(len(numbers))
        hist = release_bins(capped, label, numbers, domain, seed + 1, how.sigma * moved, how.threshold)
        hist = materialize(hist, "released-bins")
        ledger.charge("histograms", how.sigma)
        mixtures = binned_mixtures(hist, list(numbers))
        lost = [c for c, mix in mixtures.items() if not mix.size]
        if lost:
            raise ValueError(f"no bin of {lost} came above the noise")
        components = materialize(_every_label(binned_components(hist, mixtures), counts, mixtures), "components")
    return Model(label, columns, mixtures, types, counts, joint, conditional, components), ledger


def _every_label(components: DataFrame, counts: DataFrame, mixtures: dict) -> DataFrame:
    """Labels none of whose bins was released take the components' overall weights."""
    missing = None
    for c, mix in mixtures.items():
        own = components.filter(F.col("column") == c)
        rest = lookup(counts.select("label"), own.select("label").distinct(), ["label"], "left_anti", null_safe=True)
        weights = F.array(*[F.struct(F.lit(i).alias("component"), F.lit(round(w * 1e6)).cast("bigint").alias("n")) for i, w in enumerate(mix.weights)])
        rest = rest.select("label", F.lit(c).alias("column"), F.inline(weights)).filter("n > 0")
        missing = rest if missing is None else missing.unionByName(rest)
    return components.unionByName(missing)
