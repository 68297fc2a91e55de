"""Constraints: verdicts, filters, encoding and rebuilding."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.functions.random import uniform
from rowloom.operators.constraints import (
    Between, ColumnFormula, Custom, GreaterThan, Negative, OneHot, Positive, Rounding, Unique, UniqueCombinations,
    filter_valid, prepare, reverse_all, transform_all,
)

from .base import LO_SQL, RK, RK_SQL, lineitem_orders, query, r6, table, with_u

DROPPED = "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END"


def _chain(handling):
    return [
        Between("l_discount", 0.02, 0.08, handling=handling), GreaterThan("o_orderdate", "l_shipdate", handling=handling),
        UniqueCombinations(["l_returnflag", "l_linestatus"], handling=handling),
    ]


_VALID = "l_shipdate >= o_orderdate AND l_discount BETWEEN 0.02 AND 0.08 AND l_returnflag <> 'R'"


@query("c_filter_chain", f"SELECT {RK_SQL}, l_returnflag, l_linestatus FROM {LO_SQL} WHERE {_VALID}")
def c_filter_chain(spark, sf):
    lo = lineitem_orders(spark, sf)
    chain = prepare(_chain("reject_sampling"))
    for c in chain:
        c.fit(lo.filter("l_returnflag <> 'R'"))
    return filter_valid(lo, chain).select(*RK, "l_returnflag", "l_linestatus")


_KEY = ("sha256(concat_ws('|', CASE WHEN {a} IS NULL THEN 'n' ELSE 'v' || length({a}) || ':' || {a} END, "
        "CASE WHEN {b} IS NULL THEN 'n' ELSE 'v' || length({b}) || ':' || {b} END))")
_FLAGS = _KEY.format(a="l_returnflag", b="l_linestatus")


def _chain_rows(spark, sf):
    lo = lineitem_orders(spark, sf).select(*RK, "l_discount", "l_shipdate", "o_orderdate", "l_returnflag", "l_linestatus")
    return lo, prepare([
        Between("l_discount", 0.0, 0.1), GreaterThan("o_orderdate", "l_shipdate", drop="high"),
        UniqueCombinations(["l_returnflag", "l_linestatus"]),
    ])


@query("c_transform_chain", f"""
    SELECT {RK_SQL}, o_orderdate, {_FLAGS} AS flags,
           round(ln(p / (1 - p)), 6) AS discount_code, round(CASE WHEN gap > -1 THEN ln(gap + 1) END, 6) AS gap_code
    FROM (SELECT *, l_discount / 0.1 * 0.95 + 0.025 AS p,
                 (epoch_us(l_shipdate) - epoch_us(o_orderdate))::DOUBLE * 1000 AS gap FROM {LO_SQL})""")
def c_transform_chain(spark, sf):
    lo, chain = _chain_rows(spark, sf)
    for c in chain:
        lo = c.fit(lo).transform(lo)
    return lo.select(
        *RK, "o_orderdate", F.col("l_returnflag#l_linestatus").alias("flags"),
        r6(F.col("l_discount#0_0#0_1"), "discount_code"), r6(F.col("l_shipdate#o_orderdate"), "gap_code"),
    )


@query("c_roundtrip_chain", f"""
    SELECT {RK_SQL}, o_orderdate, l_returnflag, l_linestatus, round(l_discount, 6) AS l_discount,
           CASE WHEN l_shipdate >= o_orderdate THEN date_trunc('day', l_shipdate + INTERVAL 12 HOUR) END AS l_shipdate
    FROM {LO_SQL}""")
def c_roundtrip_chain(spark, sf):
    lo, chain = _chain_rows(spark, sf)
    coded = lo
    for c in chain:
        coded = c.fit(coded).transform(coded)
    back = reverse_all(coded, chain)
    # a gap of many days in nanoseconds loses its last digits in the logarithm: compare whole days
    day = F.date_trunc("day", F.col("l_shipdate") + F.expr("INTERVAL 12 HOURS")).cast("timestamp_ntz")
    return back.select(*RK, "o_orderdate", "l_returnflag", "l_linestatus", r6("l_discount", "l_discount"), day.alias("l_shipdate"))


# -- combinations -------------------------------------------------------------------------
_PARTS = """SELECT p_partkey, CASE WHEN p_size = 7 THEN NULL ELSE p_brand END AS brand,
    CASE WHEN p_size = 11 THEN NULL ELSE p_type END AS kind, p_retailprice FROM part"""
_SEEN = f"(SELECT DISTINCT brand, kind FROM ({_PARTS}) WHERE p_retailprice < 920 OR brand IS NULL)"
_PAIR_KEY = _KEY.format(a="t.brand", b="t.kind")


def _parts(spark, sf):
    p = table(spark, sf, "part").select(
        "p_partkey", F.expr("if(p_size = 7, null, p_brand)").alias("brand"), F.expr("if(p_size = 11, null, p_type)").alias("kind"),
        "p_retailprice",
    )
    return p, UniqueCombinations(["brand", "kind"]).fit(p.filter("p_retailprice < 920 OR brand IS NULL"))


@query("c_uc_fit", f"SELECT t.brand, t.kind, {_PAIR_KEY} AS combination FROM {_SEEN} t")
def c_uc_fit(spark, sf):
    return _parts(spark, sf)[1].table.withColumnRenamed("brand#kind", "combination")


_JOINED = f"FROM ({_PARTS}) t LEFT JOIN (SELECT *, true AS hit FROM {_SEEN}) s ON t.brand IS NOT DISTINCT FROM s.brand AND t.kind IS NOT DISTINCT FROM s.kind"


@query("c_uc_valid", f"SELECT t.p_partkey, coalesce(s.hit, false) AS is_valid {_JOINED}")
def c_uc_valid(spark, sf):
    p, c = _parts(spark, sf)
    return c.flag(p).select("p_partkey", "is_valid")


@query("c_uc_transform", f"SELECT t.p_partkey, CASE WHEN s.hit THEN {_PAIR_KEY} END AS combination {_JOINED}")
def c_uc_transform(spark, sf):
    p, c = _parts(spark, sf)
    return c.transform(p).select("p_partkey", F.col("brand#kind").alias("combination"))


@query("c_uc_roundtrip", f"SELECT t.p_partkey, s.brand, s.kind {_JOINED}")
def c_uc_roundtrip(spark, sf):
    p, c = _parts(spark, sf)
    return c.reverse(c.transform(p)).select("p_partkey", "brand", "kind")


# -- order --------------------------------------------------------------------------------
@query("c_gt_valid", f"""
    SELECT {RK_SQL}, coalesce(l_shipdate >= d, true) AS loose, coalesce(l_shipdate > d, true) AS strict
    FROM (SELECT *, {DROPPED} AS d FROM {LO_SQL})""")
def c_gt_valid(spark, sf):
    lo = lineitem_orders(spark, sf).withColumn("d", F.expr(DROPPED))
    lo = GreaterThan("d", "l_shipdate").flag(lo, "loose")
    return GreaterThan("d", "l_shipdate", strict=True).flag(lo, "strict").select(*RK, "loose", "strict")


@query("c_gt_multi_valid", f"SELECT {RK_SQL}, l_quantity >= l_discount * 100 AND l_quantity >= l_tax * 100 AS is_valid FROM lineitem")
def c_gt_multi_valid(spark, sf):
    li = table(spark, sf, "lineitem").withColumns({"d": F.expr("l_discount * 100"), "t": F.expr("l_tax * 100")})
    return GreaterThan(["d", "t"], "l_quantity").flag(li).select(*RK, "is_valid")


@query("c_gt_transform", """
    SELECT 'size' AS source, p_partkey AS id, round(CASE WHEN p_size - 20 > -1 THEN ln(p_size - 20.0::DOUBLE + 1) END, 6) AS code FROM part
    UNION ALL SELECT 'price', o_orderkey, round(CASE WHEN o_totalprice - 1000 > -1 THEN ln(o_totalprice - 1000 + 1) END, 6) FROM orders
    UNION ALL SELECT 'date', o_orderkey, round(CASE WHEN gap > -1 THEN ln(gap + 1) END, 6)
        FROM (SELECT *, (epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1998-01-01'))::DOUBLE * 1000 AS gap FROM orders)""")
def c_gt_transform(spark, sf):
    import datetime as dt

    p, o = table(spark, sf, "part"), table(spark, sf, "orders")
    size = GreaterThan(20, "p_size", scalar="low", drop="high").fit(p).transform(p)
    price = GreaterThan(1000, "o_totalprice", scalar="low").fit(o).transform(o)
    date = GreaterThan(dt.datetime(1998, 1, 1), "o_orderdate", scalar="low", drop="high").fit(o).transform(o)
    return (
        size.select(F.lit("size").alias("source"), F.col("p_partkey").alias("id"), r6("p_size#", "code"))
        .unionByName(price.select(F.lit("price").alias("source"), F.col("o_orderkey").alias("id"), r6("o_totalprice#", "code")))
        .unionByName(date.select(F.lit("date").alias("source"), F.col("o_orderkey").alias("id"), r6("o_orderdate#", "code")))
    )


@query("c_gt_reverse", """
    SELECT 'size' AS source, p_partkey AS id, CASE WHEN p_size - 20 > -1 THEN p_size::DOUBLE END AS value FROM part
    UNION ALL SELECT 'price', o_orderkey,
        round(CASE WHEN o_totalprice >= 1000 THEN o_totalprice WHEN o_totalprice - 1000 > -1 THEN 1000 + greatest(round_even(o_totalprice - 1000 + 1, 0) - 1, 0) END, 6)
        FROM orders""")
def c_gt_reverse(spark, sf):
    p, o = table(spark, sf, "part"), table(spark, sf, "orders")
    size = GreaterThan(20, "p_size", scalar="low", drop="high").fit(p)
    price = GreaterThan(1000, "o_totalprice", scalar="low").fit(o)
    one = size.reverse(size.transform(p)).select(F.lit("size").alias("source"), F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("value"))
    two = price.reverse(price.transform(o)).select(F.lit("price").alias("source"), F.col("o_orderkey").alias("id"), r6("o_totalprice", "value"))
    return one.unionByName(two)


@query("c_positive", """
    SELECT c_custkey, c_acctbal >= 0 AS is_valid, round(CASE WHEN c_acctbal > -1 THEN ln(c_acctbal + 1) END, 6) AS code FROM customer""")
def c_positive(spark, sf):
    c = table(spark, sf, "customer")
    rule = Positive("c_acctbal").fit(c)
    return rule.transform(rule.flag(c)).select("c_custkey", "is_valid", r6("c_acctbal#", "code"))


@query("c_negative", """
    SELECT c_custkey, c_acctbal < 0 AS is_valid, round(CASE WHEN -c_acctbal > -1 THEN ln(-c_acctbal + 1) END, 6) AS code,
           round(CASE WHEN -c_acctbal > -1 THEN -greatest(round_even(-c_acctbal + 1, 0) - 1, 0) END, 6) + 0.0 AS rebuilt FROM customer""")
def c_negative(spark, sf):
    c = table(spark, sf, "customer")
    rule = Negative("c_acctbal", strict=True, drop=True).fit(c)
    coded = rule.transform(rule.flag(c)).withColumn("code", F.col("c_acctbal#"))
    return rule.reverse(coded).select("c_custkey", "is_valid", r6("code", "code"), (F.round("c_acctbal", 6) + 0.0).alias("rebuilt"))


# -- formula ------------------------------------------------------------------------------
_NET = "l_extendedprice * (1 - l_discount)"
_MADE = f"CASE WHEN l_tax = 0.01 THEN NULL WHEN l_tax = 0.02 THEN {_NET} + 1 ELSE {_NET} END"


def _net(spark, sf):
    return table(spark, sf, "lineitem").withColumn("net", F.expr(_MADE))


@query("c_formula_valid", f"SELECT {RK_SQL}, ({_MADE}) IS NOT DISTINCT FROM {_NET} AS is_valid FROM lineitem")
def c_formula_valid(spark, sf):
    return ColumnFormula("net", _NET).flag(_net(spark, sf)).select(*RK, "is_valid")


@query("c_formula_roundtrip", f"SELECT {RK_SQL}, round({_NET}, 6) AS net FROM lineitem")
def c_formula_roundtrip(spark, sf):
    li = _net(spark, sf)
    rule = ColumnFormula("net", lambda df: df["l_extendedprice"] * (1 - df["l_discount"])).fit(li)
    return rule.reverse(rule.transform(li)).select(*RK, r6("net", "net"))


# -- between ------------------------------------------------------------------------------
_DISC = "CASE WHEN l_tax = 0.01 THEN NULL ELSE l_discount END"


def _disc(spark, sf):
    return table(spark, sf, "lineitem").withColumn("disc", F.expr(_DISC))


@query("c_between_valid", f"""
    SELECT {RK_SQL}, coalesce(d >= 0.02 AND d <= 0.08, true) AS loose, coalesce(d > 0.02 AND d < 0.08, true) AS strict
    FROM (SELECT *, {_DISC} AS d FROM lineitem)""")
def c_between_valid(spark, sf):
    li = Between("disc", 0.02, 0.08).flag(_disc(spark, sf), "loose")
    return Between("disc", 0.02, 0.08, strict=True).flag(li, "strict").select(*RK, "loose", "strict")


@query("c_between_transform", f"""
    SELECT {RK_SQL}, round(ln(p / (1 - p)), 6) AS code
    FROM (SELECT *, ({_DISC} - -0.01) / (0.12 - -0.01) * 0.95 + 0.025 AS p FROM lineitem)""")
def c_between_transform(spark, sf):
    li = _disc(spark, sf)
    rule = Between("disc", -0.01, 0.12).fit(li)
    return rule.transform(li).select(*RK, r6(F.col(f"`{rule.encoded}`"), "code"))


@query("c_between_roundtrip", f"SELECT {RK_SQL}, round({_DISC}, 6) AS disc FROM lineitem")
def c_between_roundtrip(spark, sf):
    li = _disc(spark, sf)
    rule = Between("disc", -0.01, 0.12).fit(li)
    return rule.reverse(rule.transform(li)).select(*RK, r6("disc", "disc"))


@query("c_between_cols", f"""
    SELECT {RK_SQL}, coalesce(l_shipdate >= d, true) AND coalesce(l_shipdate <= d + INTERVAL 90 DAY, true) AS is_valid
    FROM (SELECT *, {DROPPED} AS d FROM {LO_SQL})""")
def c_between_cols(spark, sf):
    lo = lineitem_orders(spark, sf).withColumn("d", F.expr(DROPPED)).withColumn("late", F.expr("d + INTERVAL 90 DAYS"))
    return Between("l_shipdate", "d", "late").flag(lo).select(*RK, "is_valid")


# -- rounding, one-hot, uniqueness, custom ------------------------------------------------
@query("c_round_valid", """
    SELECT o_orderkey, abs(o_totalprice - round_even(o_totalprice * 10, 0) / 10) <= 0.01 AS tenths,
           abs(o_totalprice - round_even(o_totalprice / 10, 0) * 10) <= 2.5 AS tens FROM orders""")
def c_round_valid(spark, sf):
    o = Rounding("o_totalprice", 1).flag(table(spark, sf, "orders"), "tenths")
    return Rounding("o_totalprice", -1, tolerance=2.5).flag(o, "tens").select("o_orderkey", "tenths", "tens")


@query("c_round_reverse", """
    SELECT o_orderkey, round_even(o_totalprice * 10, 0) / 10 AS tenths, round_even(o_totalprice / 10, 0) * 10 AS tens FROM orders""")
def c_round_reverse(spark, sf):
    o = table(spark, sf, "orders").withColumns({"tenths": F.col("o_totalprice"), "tens": F.col("o_totalprice")})
    return Rounding("tens", -1).reverse(Rounding("tenths", 1).reverse(o)).select("o_orderkey", "tenths", "tens")


KINDS = ["click", "error", "purchase", "signup", "view"]
_BITS = ", ".join(
    f"CASE WHEN value < 1 AND '{k}' = 'view' THEN NULL WHEN value > 150 THEN 1.0::DOUBLE WHEN event_type = '{k}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {k}"
    for k in KINDS)


def _bits(spark, sf):
    e = table(spark, sf, "events")
    return e.withColumns({
        k: F.when((F.col("value") < 1) & F.lit(k == "view"), F.lit(None)).when(F.col("value") > 150, 1.0)
        .when(F.col("event_type") == k, 1.0).otherwise(0.0) for k in KINDS})


@query("c_onehot_valid", f"""
    SELECT event_id, coalesce(click, 0) + coalesce(error, 0) + coalesce(purchase, 0) + coalesce(signup, 0) + coalesce(view, 0) = 1
        AND greatest(click, error, purchase, signup, view) = 1 AND least(click, error, purchase, signup, view) = 0 AS is_valid
    FROM (SELECT event_id, {_BITS} FROM events)""")
def c_onehot_valid(spark, sf):
    return OneHot(KINDS).flag(_bits(spark, sf)).select("event_id", "is_valid")


def _scores(spark, sf):
    e = table(spark, sf, "events")
    # one decimal, so that ties occur
    return e.select("event_id", *[F.floor(uniform(7, k, "event_id") * 10).cast("double").alias(k) for k in KINDS])


def scores_sql():
    q = "events"
    for k in KINDS:
        q = with_u(q, ["event_id"], 7, k, f"u_{k}")
    return f"(SELECT event_id, {', '.join(f'floor(u_{k} * 10)::DOUBLE AS {k}' for k in KINDS)} FROM {q})"


_BEST = "list_position([click, error, purchase, signup, view], greatest(click, error, purchase, signup, view))"


@query("c_onehot_reverse", f"""
    SELECT event_id, {', '.join(f'CASE WHEN best = {i + 1} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {k}' for i, k in enumerate(KINDS))}
    FROM (SELECT event_id, {_BEST} AS best FROM {scores_sql()})""")
def c_onehot_reverse(spark, sf):
    return OneHot(KINDS).reverse(_scores(spark, sf))


@query("c_onehot_fill", """
    SELECT event_id, 'one' AS given, CASE WHEN event_type = 'click' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS click,
           CASE WHEN event_type = 'click' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS other FROM events
    UNION ALL SELECT event_id, 'four', CASE WHEN event_type = 'click' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END,
           CASE WHEN event_type = 'view' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM events""")
def c_onehot_fill(spark, sf):
    e = table(spark, sf, "events")
    bits = {k: F.when(F.col("event_type") == k, 1.0).otherwise(0.0) for k in KINDS}
    two = e.select("event_id", bits["click"].alias("click"))
    one = OneHot(["click", "other"]).fill(two)
    four = OneHot(KINDS).fill(e.select("event_id", *[bits[k].alias(k) for k in KINDS[:4]]))
    return one.select("event_id", F.lit("one").alias("given"), "click", "other").unionByName(
        four.select("event_id", F.lit("four").alias("given"), "click", F.col("view").alias("other")))


_LINE = "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber END"


@query("c_unique", f"""
    SELECT {RK_SQL}, line IS NOT NULL AND row_number() OVER (PARTITION BY l_orderkey, line ORDER BY {RK_SQL}) = 1 AS is_valid
    FROM (SELECT *, {_LINE} AS line FROM lineitem)""")
def c_unique(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("line", F.expr(_LINE))
    return Unique(["l_orderkey", "line"], RK).flag(li).select(*RK, "is_valid")


@query("c_unique_filter", f"""
    SELECT {RK_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, line ORDER BY {RK_SQL}) AS k
    FROM (SELECT *, {_LINE} AS line FROM lineitem) WHERE line IS NOT NULL) WHERE k = 1""")
def c_unique_filter(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("line", F.expr(_LINE))
    return filter_valid(li, Unique(["l_orderkey", "line"], RK)).select(*RK)


@query("c_custom", """
    SELECT c_custkey, c_acctbal > 0 AS is_valid, round(ln(c_acctbal + 1000), 6) AS code, round(c_acctbal, 6) AS rebuilt FROM customer""")
def c_custom(spark, sf):
    c = table(spark, sf, "customer")
    rule = Custom("c_acctbal", lambda v: F.ln(v + 1000), lambda v: F.exp(v) - 1000, lambda v: v > 0)
    coded = rule.transform(rule.flag(c)).withColumn("code", F.col("c_acctbal"))
    return rule.reverse(coded).select("c_custkey", "is_valid", r6("code", "code"), r6("c_acctbal", "rebuilt"))


__all__ = ["KINDS", "scores_sql", "transform_all"]
