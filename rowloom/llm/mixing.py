"""Mixing sources to target weights by entropy balancing.

Every document gets a rate between ``low`` and ``high`` that is an exponential tilt of its size,
``low + (high - low) * e / (1 + e)`` with ``e = exp(lambda * size)``: among all bounded rates whose words add up to the
target of the source, these have the greatest entropy. The multiplier of each source is the minimum of a
convex dual, found by Newton steps kept inside a bracket. A step needs one aggregation over the counts of equal
sizes. Rates are rounded into whole copies by a hash, and a few documents per size class and source then
absorb the rounding error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.joins import lookup
from ..session import materialize
from .common import unit, word_count
from .registry import query, table

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
ROUNDS = 60
CLOSE = 1e-9
SPARES = 16


def source_targets(sizes: DataFrame, weights: tuple[int, ...], budget: float, low: float, high: float) -> DataFrame:
    """(source, source_size, target) for (source, source_size): the shares of the weighted budget within the bounds.

    Sources are ordered by code point, null last, and take the weights in turn. Each target lies between
    ``low`` and ``high`` times the size of its source; what a bound cuts off is reshared by weight. The
    table has one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    named = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1))
    total = named.agg(F.sum("source_size")).first()[0] or 0
    # target = clip(level * w, low * size, high * size); the sum is piecewise linear in the level, with two corners a source
    corners = named.filter("source_size > 0").select(
        F.explode(F.array(
            F.struct((F.col("source_size") * low / F.col("w")).alias("at"), F.col("w").alias("slope")),
            F.struct((F.col("source_size") * high / F.col("w")).alias("at"), (-F.col("w")).alias("slope")),
        )).alias("c")
    ).select("c.at", "c.slope")
    corners = corners.groupBy("at").agg(F.sum("slope").alias("slope"))
    line = Window.orderBy("at")
    walk = corners.withColumn("after", F.sum("slope").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    walk = walk.withColumn("gap", F.col("at") - F.lag("at").over(line)).withColumn("before", F.lag("after").over(line))
    walk = walk.withColumn("sum", F.lit(total * low) + F.coalesce(F.sum(F.col("gap") * F.col("before")).over(line.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    wanted = min(max(total * budget, total * low), total * high)
    last = walk.filter(F.col("sum") <= F.lit(wanted * (1 + 1e-12))).agg(F.max_by(F.struct("at", "sum", "after"), "at").alias("x")).first()["x"]
    level = 0.0 if last is None else last["at"] + ((wanted - last["sum"]) / last["after"] if last["after"] > 1e-9 else 0.0)
    target = F.greatest(F.col("source_size") * low, F.least(F.col("source_size") * high, F.lit(level) * F.col("w")))
    return named.select("source", "source_size", target.cast("double").alias("target"))


def _rate(lam: Column, x: Column, low: float, high: float) -> Column:
    return F.lit(low) + F.lit(high - low) / (F.lit(1.0) + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -lam * x))))


def balance(groups: DataFrame, targets: DataFrame, low: float, high: float) -> DataFrame:
    """(source, unit, lam): the multiplier of each source, for sizes measured in ``unit``.

    ``groups`` counts the documents by (source, size). Targets at a bound get an infinite multiplier, given as
    a number so large that every rate equals the bound.
    """
    facts = groups.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("unit"))
    state = targets.join(facts, targets["source"].eqNullSafe(facts["source"])).select(
        targets["source"], "target", F.greatest("unit", F.lit(1e-9)).alias("unit"),
        F.lit(0.0).alias("lam"), F.lit(-1e6).alias("down"), F.lit(1e6).alias("up"), F.lit(1.0).alias("off"),
    )
    state = materialize(state, "multipliers")
    for _ in range(ROUNDS):
        g = groups.withColumnRenamed("source", "g_source")
        x = F.col("size") / F.col("unit")
        r = _rate(F.col("lam"), x, low, high)
        slope = (r - F.lit(low)) * (F.lit(high) - r) / F.lit(high - low)
        sums = state.join(g, state["source"].eqNullSafe(g["g_source"])).groupBy("source", "target", "unit", "lam", "down", "up").agg(
            F.sum(r * F.col("size") * F.col("n")).alias("words"), F.sum(slope * x * F.col("size") * F.col("n")).alias("slope")
        )
        gap = F.col("words") - F.col("target")
        down, up = F.when(gap < 0, F.greatest("down", "lam")).otherwise(F.col("down")), F.when(gap > 0, F.least("up", "lam")).otherwise(F.col("up"))
        step = F.col("lam") - gap / F.greatest("slope", F.lit(1e-12))
        inside = F.when((step > F.col("n_down")) & (step < F.col("n_up")), step).otherwise(
            F.when(F.col("n_up") >= 1e6, F.greatest(F.lit(1.0), F.col("lam") * 4)).when(F.col("n_down") <= -1e6, F.least(F.lit(-1.0), F.col("lam") * 4)).otherwise((F.col("n_down") + F.col("n_up")) / 2)
        )
        off = F.abs(gap) / F.greatest("target", F.lit(1.0))
        state = sums.withColumn("n_down", down).withColumn("n_up", up).select(
            "source", "target", "unit", F.when(off <= CLOSE, F.col("lam")).otherwise(F.least(F.lit(1e6), F.greatest(F.lit(-1e6), inside))).alias("lam"),
            F.col("n_down").alias("down"), F.col("n_up").alias("up"), F.when(F.abs("lam") >= 1e6, F.lit(0.0)).otherwise(off).alias("off"),
        )
        state = materialize(state, "multipliers")
        if (state.agg(F.max("off")).first()[0] or 0.0) <= CLOSE:
            break
    return state.select("source", "unit", "lam")


def _copies(id_col: Column, size: Column, rate: Column, low: float, high: float) -> Column:
    """Whole copies from a rate, by a hash of id and size; documents without words keep one where the bounds allow it."""
    drawn = F.floor(rate + unit(id_col, size, F.lit("copies"))).cast("int")
    return F.greatest(F.lit(int(low)), F.least(F.lit(int(high)), F.when(size == 0, F.lit(1)).otherwise(drawn)))


def _solve(sized: DataFrame, weights: tuple[int, ...], budget: float, low: float, high: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For rows (id, size, source, at): the plan of each source, the rows with rate and rounded copies, and corrections (f_at, by)."""
    groups = materialize(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "size-groups")
    totals = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = materialize(source_targets(totals, weights, budget, low, high), "targets")
    lam = balance(groups, targets, low, high)
    plan = materialize(targets.join(lam, targets["source"].eqNullSafe(lam["source"])).select(targets["source"], "source_size", "target", "unit", "lam"), "plan")

    rated = lookup(sized, plan, ["source"], "inner", null_safe=True, salt_by=["at"])
    rated = rated.withColumn("rate", _rate(F.col("lam"), F.col("size") / F.col("unit"), low, high))
    rated = rated.withColumn("copies", _copies(F.col("id"), F.col("size"), F.col("rate"), low, high))
    rated = materialize(rated.drop("unit", "lam"), "rounded")

    # what rounding missed, per source, is made up by documents from large to small
    misses = rated.groupBy("source").agg(F.round(F.first("target") - F.sum(F.col("copies") * F.col("size"))).cast("bigint").alias("miss"))
    spare = lookup(rated.filter("size > 0"), materialize(misses, "misses"), ["source"], "inner", null_safe=True, salt_by=["at"])
    spare = spare.filter(F.when(F.col("miss") > 0, F.col("copies") < int(high)).otherwise((F.col("miss") < 0) & (F.col("copies") > int(low))))
    spare = spare.select("source", "miss", "size", "at", F.floor(F.log2("size")).alias("scale"), F.xxhash64("id", F.lit("spare")).alias("pick"))
    spare = spare.withColumn("turn", F.row_number().over(Window.partitionBy("source", "scale").orderBy("pick", "at"))).filter(F.col("turn") <= SPARES)
    listed = spare.groupBy("source", "miss").agg(F.sort_array(F.collect_list(F.struct("size", "at")), asc=False).alias("cs"))  # at most SPARES a size class
    start = F.struct(F.abs("miss").alias("rest"), F.array().cast("array<bigint>").alias("ats"))
    fill = F.aggregate("cs", start, lambda acc, c: F.when(
        c["size"] <= acc["rest"], F.struct((acc["rest"] - c["size"]).alias("rest"), F.concat(acc["ats"], F.array(c["at"])).alias("ats"))
    ).otherwise(acc))
    fixes = listed.select(F.signum("miss").cast("int").alias("by"), F.explode(fill["ats"]).alias("f_at"))
    return plan, rated, materialize(fixes, "corrections")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return materialize(
        docs.select(F.col(id_col).alias("id"), word_count(F.col(text_col)).alias("size"), F.col(source_col).alias("source"), F.monotonically_increasing_id().alias("at")), "sizes"
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, low: float = 0.0, high: float = 2.0) -> DataFrame:
    """One row per input row: id, size, source, source_size, target, rate, copies, taken.

    A null text has size 0, a null source is a source of its own. Copies lie between the whole numbers around the
    rate, so between ``low`` and ``high``; documents without words keep one copy where the bounds allow it. The result depends on ids, sizes
    and sources only: reruns agree; of repeated rows any may be the one that is corrected. Other columns are ignored.
    An empty table gives an empty result.
    """
    _, rated, fixes = _solve(_sized(docs, id_col, text_col, source_col), weights, budget, low, high)
    out = rated.join(fixes, F.col("at") == F.col("f_at"), "left").withColumn("copies", F.col("copies") + F.coalesce("by", F.lit(0)))
    return out.select(F.col("id").alias(id_col), "size", "source", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"))


def repeat_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, low: float = 0.0, high: float = 2.0) -> DataFrame:
    """The mixed rows themselves: each row of ``docs``, with all its columns, as often as the mix takes it.

    Whole rows are not shuffled: the number of copies follows from the plan of the row's source and a hash, and from a bounded list of
    corrections by (id, size, source). Rows that repeat all three are corrected together. Otherwise as ``mix``.
    """
    sized = _sized(docs, id_col, text_col, source_col)
    plan, _, fixes = _solve(sized, weights, budget, low, high)
    fixes = sized.join(fixes, F.col("at") == F.col("f_at")).groupBy("id", "size", "source").agg(F.first("by").alias("_mix_by"))
    fixes = fixes.select(F.to_json(F.struct("id", "size", "source"), {"ignoreNullFields": "false"}).alias("_mix_key"), "_mix_by")
    plan = plan.select(F.col("source").alias("_mix_source"), F.col("unit").alias("_mix_unit"), F.col("lam").alias("_mix_lam"))
    rows = docs.withColumn("_mix_size", word_count(F.col(text_col))).withColumn("_mix_source", F.col(source_col))
    rows = lookup(rows, plan, ["_mix_source"], "inner", null_safe=True, salt_by=[id_col])
    rows = rows.withColumn("_mix_copies", _copies(F.col(id_col), F.col("_mix_size"), _rate(F.col("_mix_lam"), F.col("_mix_size") / F.col("_mix_unit"), low, high), low, high))
    key = F.struct(F.col(id_col).alias("id"), F.col("_mix_size").alias("size"), F.col("_mix_source").alias("source"))
    rows = lookup(rows.withColumn("_mix_key", F.to_json(key, {"ignoreNullFields": "false"})), materialize(fixes, "corrected"), ["_mix_key"], "left", salt_by=[id_col])
    rows = rows.withColumn("_mix_copies", F.col("_mix_copies") + F.coalesce("_mix_by", F.lit(0))).filter("_mix_copies > 0")
    return rows.withColumn("_mix_turn", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])


@query("op4_mix_sources")
def op4_mix_sources(spark, sf):
    out = mix(table(spark, sf, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")
