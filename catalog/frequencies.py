"""Frequency tables, orders of appearance and conditioned draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.operators.frequency import (
    category_codes, category_counts, category_freq, condition_groups, cumulative_freq, joint_counts, joint_freq, labels_by_appearance,
    triple_bounds, triple_ordinals,
)
from rowloom.operators.intervals import build_guide
from rowloom.operators.sampling import (
    condition_vector, decode_label, draw_conditions, draw_original, fixed_condition, sample_rows,
)
from rowloom.session import materialize

from .base import LO_SQL, RK, RK_SQL, below, lineitem_orders, query, r6, table, with_u

FLAGS = ["l_returnflag", "l_linestatus", "l_linenumber"]
LABEL, COLUMNS = "o_orderstatus", ["l_returnflag", "l_linestatus", "o_orderpriority"]
PAIRS = [(a, b) for i, a in enumerate(COLUMNS) for b in COLUMNS[i + 1:]]
SEED = 7


def counts_sql(columns=FLAGS, source="lineitem"):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS value, count(*) AS n FROM {source} GROUP BY 2" for c in columns)


def joint_sql(source=LO_SQL, label=LABEL, pairs=PAIRS):
    return " UNION ALL ".join(
        f"SELECT '{x}|{y}' AS pair, {label}::VARCHAR AS label, {x}::VARCHAR AS a, {y}::VARCHAR AS b, count(*) AS n FROM {source} GROUP BY 2, 3, 4"
        for x, y in pairs)


def bounds_sql(source, keys, order, weight="n"):
    """Intervals of integer weights per keys."""
    part = f"PARTITION BY {keys}" if keys else ""
    return (f"(SELECT * EXCLUDE (_upto, _all), (_upto - {weight}) / _all AS lo, _upto / _all AS hi FROM (SELECT *, "
            f"(sum({weight}) OVER ({part} ORDER BY {order} ROWS UNBOUNDED PRECEDING))::BIGINT AS _upto, "
            f"(sum({weight}) OVER ({part}))::BIGINT AS _all FROM {source} WHERE {weight} > 0))")


@query("f_category_freq", f"SELECT *, round(n / sum(n) OVER (PARTITION BY \"column\"), 6) AS p FROM ({counts_sql()})")
def f_category_freq(spark, sf):
    return category_freq(table(spark, sf, "lineitem"), FLAGS).withColumn("p", F.round("p", 6))


@query("f_category_freq_log", f"SELECT *, round(ln(n + 1) / sum(ln(n + 1)) OVER (PARTITION BY \"column\"), 6) AS p FROM ({counts_sql()})")
def f_category_freq_log(spark, sf):
    return category_freq(table(spark, sf, "lineitem"), FLAGS, log=True).withColumn("p", F.round("p", 6))


@query("f_cumulative", f"SELECT \"column\", value, n, round(lo, 6) AS lo, round(hi, 6) AS hi FROM {bounds_sql(f'({counts_sql()})', chr(34) + 'column' + chr(34), 'value')}")
def f_cumulative(spark, sf):
    out = cumulative_freq(table(spark, sf, "lineitem"), FLAGS)
    return out.select("column", "value", "n", r6("lo", "lo"), r6("hi", "hi"))


@query("f_joint_freq", f"SELECT *, round(n / sum(n) OVER (PARTITION BY pair), 6) AS p FROM ({joint_sql()})")
def f_joint_freq(spark, sf):
    return joint_freq(lineitem_orders(spark, sf), LABEL, COLUMNS).withColumn("p", F.round("p", 6))


def members_sql(extra=""):
    """Rows of every triple with their number in the order of the row key."""
    parts = " UNION ALL ".join(
        f"SELECT {RK_SQL}, '{x}|{y}' AS pair, {LABEL} AS label, {x}::VARCHAR AS a, {y}::VARCHAR AS b FROM {LO_SQL}" for x, y in PAIRS)
    return f"(SELECT *, row_number() OVER (PARTITION BY pair, label, a, b ORDER BY {RK_SQL}) - 1 AS ordinal{extra} FROM ({parts}))"


@query("f_triple_ordinals", f"SELECT * FROM {members_sql()}")
def f_triple_ordinals(spark, sf):
    return triple_ordinals(lineitem_orders(spark, sf), LABEL, COLUMNS, RK)


def draws_sql():
    """One (pair, label, a, b) per order."""
    ids = with_u(with_u("(SELECT o_orderkey FROM orders)", ["o_orderkey"], SEED, "pair", "up"), ["o_orderkey"], SEED, "triple", "ut")
    names = ", ".join(f"'{x}|{y}'" for x, y in PAIRS)
    picked = f"(SELECT o_orderkey, ut, [{names}][{below('up', '3')} + 1] AS dpair FROM {ids})"
    bounds = bounds_sql(f"({joint_sql()})", "pair", "label, a, b")
    return f"(SELECT o_orderkey, pair, label, a, b, n FROM {picked} d JOIN {bounds} i ON d.dpair = i.pair AND ut >= lo AND ut < hi)"


def drawn(spark, sf):
    lo = lineitem_orders(spark, sf)
    joint = materialize(joint_counts(lo, LABEL, COLUMNS), "joint")
    guide = build_guide(triple_bounds(joint), ["pair"])
    ids = table(spark, sf, "orders").select("o_orderkey")
    return lo, draw_conditions(guide, ids, "o_orderkey", COLUMNS, SEED)


@query("f_draw_category", f"SELECT o_orderkey, pair, label, a, b FROM {draws_sql()}")
def f_draw_category(spark, sf):
    return drawn(spark, sf)[1].select("o_orderkey", "pair", "label", "a", "b")


@query("f_sample_rows", f"""
    SELECT d.o_orderkey, d.pair, d.label, d.a, d.b, m.l_orderkey AS row_l_orderkey, m.l_linenumber AS row_l_linenumber,
           m.l_partkey AS row_l_partkey, m.l_suppkey AS row_l_suppkey
    FROM {with_u(draws_sql(), ['o_orderkey'], SEED, 'member', 'um')} d JOIN {members_sql()} m
      ON d.pair = m.pair AND d.label = m.label AND d.a = m.a AND d.b = m.b AND m.ordinal = {below('um', 'd.n')}""")
def f_sample_rows(spark, sf):
    lo, draws = drawn(spark, sf)
    return sample_rows(lo, LABEL, COLUMNS, RK, draws.drop("n"), "o_orderkey", SEED)


@query("f_draw_original", f"""
    WITH rows AS (SELECT *, row_number() OVER (ORDER BY {RK_SQL}, {', '.join(f'{c}::VARCHAR' for c in [LABEL, *COLUMNS])}) - 1 AS k, count(*) OVER () AS total FROM {LO_SQL}),
    d AS (SELECT o_orderkey, {below('um', '(SELECT count(*) FROM lineitem)')} AS k, {below('up', '3')} AS p
          FROM {with_u(with_u('(SELECT o_orderkey FROM orders)', ['o_orderkey'], SEED, 'member', 'um'), ['o_orderkey'], SEED, 'pair', 'up')})
    SELECT d.o_orderkey, [{', '.join(f"'{x}|{y}'" for x, y in PAIRS)}][p + 1] AS pair, {LABEL} AS label,
           [{', '.join(f'{x}::VARCHAR' for x, _ in PAIRS)}][p + 1] AS a, [{', '.join(f'{y}::VARCHAR' for _, y in PAIRS)}][p + 1] AS b,
           {', '.join(f'{c} AS row_{c}' for c in RK)}
    FROM d JOIN rows ON d.k = rows.k""")
def f_draw_original(spark, sf):
    ids = table(spark, sf, "orders").select("o_orderkey")
    out = draw_original(lineitem_orders(spark, sf), LABEL, COLUMNS, RK, ids, "o_orderkey", SEED)
    return out.select("o_orderkey", "pair", "label", "a", "b", *[f"row_{c}" for c in RK])


def _bits(vector):
    return F.array_join(F.transform(vector, lambda x: x.cast("int").cast("string")), "")


_POSITIONS = " UNION ALL ".join(
    f"SELECT {i} AS place, '{c}' AS name, {c}::VARCHAR AS v FROM {LO_SQL} GROUP BY 3" for i, c in enumerate([LABEL, *COLUMNS]))


@query("f_condvec", f"""
    SELECT o_orderkey, string_agg(CASE WHEN (place = 0 AND v = label) OR (name = split_part(pair, '|', 1) AND v = a)
        OR (name = split_part(pair, '|', 2) AND v = b) THEN '1' ELSE '0' END, '' ORDER BY place, v) AS bits,
        any_value('1' || CASE pair {' '.join(f"WHEN '{x}|{y}' THEN '{''.join(str(int(c in (x, y))) for c in COLUMNS)}'" for x, y in PAIRS)} END) AS mask
    FROM {draws_sql()}, ({_POSITIONS}) GROUP BY o_orderkey""")
def f_condvec(spark, sf):
    lo, draws = drawn(spark, sf)
    out = condition_vector(draws, LABEL, COLUMNS, category_codes(lo, [LABEL, *COLUMNS]))
    return out.select("o_orderkey", _bits(F.col("vector")).alias("bits"), _bits(F.col("mask")).alias("mask"))


@query("f_fixed_condvec", f"""
    SELECT o_orderkey, (SELECT string_agg(CASE WHEN name = 'o_orderpriority' AND v = '2-HIGH' THEN '1' ELSE '0' END, '' ORDER BY place, v)
        FROM ({_POSITIONS})) AS bits FROM orders""")
def f_fixed_condvec(spark, sf):
    codes = category_codes(lineitem_orders(spark, sf), [LABEL, *COLUMNS])
    out = fixed_condition(table(spark, sf, "orders").select("o_orderkey"), codes, "o_orderpriority", "2-HIGH")
    return out.select("o_orderkey", _bits(F.col("vector")).alias("bits"))


@query("f_decode_label", f"SELECT o_orderkey, label FROM {draws_sql()}")
def f_decode_label(spark, sf):
    lo, draws = drawn(spark, sf)
    codes = category_codes(lo, [LABEL, *COLUMNS])
    vectors = condition_vector(draws, LABEL, COLUMNS, codes).select("o_orderkey", "vector")
    return decode_label(vectors, "vector", codes, LABEL).select("o_orderkey", "label")


@query("f_labels_order", "SELECT c_mktsegment AS label, min(c_custkey) AS first_at FROM customer GROUP BY 1")
def f_labels_order(spark, sf):
    return labels_by_appearance(table(spark, sf, "customer"), "c_mktsegment", "c_custkey")


@query("f_condition_groups", """
    SELECT o_orderstatus, priority AS o_orderpriority, count(*) AS n
    FROM (SELECT *, CASE WHEN o_totalprice < 50000 THEN NULL ELSE o_orderpriority END AS priority FROM orders)
    WHERE priority IS NOT NULL AND o_orderstatus IS NOT NULL GROUP BY 1, 2""")
def f_condition_groups(spark, sf):
    o = table(spark, sf, "orders").withColumn("o_orderpriority", F.expr("if(o_totalprice < 50000, null, o_orderpriority)"))
    return condition_groups(o, ["o_orderstatus", "o_orderpriority"])
