"""Labels, column models, generation, rejection and privacy."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F, types as T

from rowloom.functions.numbers import time_number
from rowloom.functions.random import _FAR_TAIL, _TAIL, uniform
from rowloom.operators.constraints import Between, Unique, UniqueCombinations
from rowloom.operators.copula import Copula, _Dim, complete_conditions, copula_stats
from rowloom.operators.encoders import choose_encoders, decode, encode, fit_encoders
from rowloom.operators.factors import FactorModel
from rowloom.operators.frequency import labels_by_appearance
from rowloom.operators.generate import finalize, fit_model, generate
from rowloom.operators.intervals import power_of_two
from rowloom.operators.labels import label_fidelity, label_quota, label_to_iri, nearest_labels, normalise_key, with_embedding
from rowloom.operators.ordinals import dense_index
from rowloom.operators.privacy import private_freq
from rowloom.operators.release import BLOCK_SURVIVORS, MOST_GAPS, Private, tail_probability
from rowloom.operators.rejection import filter_conditions, make_conditions, repeat_fill, sample_conditional, sample_valid
from rowloom.plans.synthesizer import Profile, Synthesizer
from rowloom.session import materialize, scratch_path
from rowloom.sources import read_label_dict
from rowloom.spec import FieldSpec, TableSpec

from .base import LO_SQL, RK, RK_SQL, below, lineitem_orders, query, r6, table, with_normal, with_u
from .encodings import MIX, probabilities_sql
from .frequencies import COLUMNS, LABEL, PAIRS, SEED, bounds_sql, joint_sql
from .sources import write_dictionary

# -- labels -------------------------------------------------------------------------------


@query("l_label_iri", """
    SELECT c_name AS label, CASE WHEN c_mktsegment = 'BUILDING' THEN 'http://y/' ELSE 'http://x/' END || c_custkey AS iri FROM customer
    UNION ALL SELECT s_name, NULL FROM supplier""")
def l_label_iri(spark, sf):
    c = table(spark, sf, "customer")
    names = c.select(F.col("c_name").alias("label")).unionByName(table(spark, sf, "supplier").select(F.col("s_name").alias("label")))
    return label_to_iri(names, read_label_dict(spark, write_dictionary(spark, c)))


@query("l_embedding_join", """
    SELECT event_id, coalesce(len(embedding), 64)::INTEGER AS width, round(coalesce(list_sum(embedding::DOUBLE[]), 0), 6) AS total
    FROM events LEFT JOIN embeddings ON vec_id = user_id""")
def l_embedding_join(spark, sf):
    emb = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), "embedding")
    out = with_embedding(table(spark, sf, "events").select("event_id", "user_id"), emb, "user_id", 64, on_missing="zeros")
    return out.select("event_id", F.size("embedding").alias("width"), r6(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), "total"))


def _label_vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    vectors = e.groupBy(F.col("label").cast("string").alias("key")).agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return materialize(vectors, "vectors")


_VECTORS = "(SELECT label::VARCHAR AS key, arg_min(embedding, vec_id)::DOUBLE[] AS v FROM embeddings GROUP BY 1)"
_BCE = "greatest(x, 0) - x * y + ln(1 + exp(-abs(x)))"


@query("l_label_fidelity", f"""
    WITH rows AS (SELECT a.label::VARCHAR AS requested, b.label::VARCHAR AS produced FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
    cells AS (SELECT p.key AS produced, q.key AS requested, unnest(p.v) AS x, unnest(q.v) AS y FROM {_VECTORS} p, {_VECTORS} q),
    losses AS (SELECT produced, requested, avg({_BCE}) AS loss FROM cells GROUP BY 1, 2)
    SELECT requested, count(*) AS rows, round(avg(loss) * 5, 6) AS loss FROM rows JOIN losses USING (requested, produced) GROUP BY 1""")
def l_label_fidelity(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("string").alias("requested"))
    following = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("requested").alias("produced"))
    out = label_fidelity(e.join(following, "vec_id"), _label_vectors(spark, sf), "requested", "produced")
    return out.select("requested", "rows", r6("loss", "loss"))


@query("g_label_quota", """
    WITH l AS (SELECT event_type AS label, row_number() OVER (ORDER BY min(event_id)) - 1 AS k FROM events GROUP BY 1)
    SELECT o_orderkey, label FROM orders JOIN l ON k = o_orderkey % (SELECT count(*) FROM l)""")
def g_label_quota(spark, sf):
    labels = dense_index(labels_by_appearance(table(spark, sf, "events"), "event_type", "event_id"), "first_at", "position")
    return label_quota(labels, table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("g_knn_labels", """
    WITH s AS (SELECT u.vec_id::VARCHAR AS key, o.vec_id::VARCHAR AS neighbour,
                      list_cosine_similarity(u.embedding::DOUBLE[], o.embedding::DOUBLE[]) AS similarity
               FROM embeddings u JOIN embeddings o ON u.label = 9 AND o.label <> 9),
    t AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY similarity DESC, neighbour) AS rank FROM s)
    SELECT key, neighbour, rank, round(similarity, 6) AS similarity,
           round(exp(similarity) / sum(exp(similarity)) OVER (PARTITION BY key), 6) AS weight FROM t WHERE rank <= 3""")
def g_knn_labels(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), "embedding", "label")
    near = nearest_labels(e.filter("label = 9"), e.filter("label <> 9"), 3)
    return near.select("key", "neighbour", "rank", r6("similarity", "similarity"), r6("weight", "weight"))


# -- column model -------------------------------------------------------------------------
_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount"]


@query("g_copula_stats", " UNION ALL ".join(f"""
    SELECT '{a}' AS a, '{b}' AS b, round(avg({a}), 4) AS mean_a, round(avg({b}), 4) AS mean_b,
           round(stddev_pop({a}), 4) AS std_a, round(stddev_pop({b}), 4) AS std_b, round(corr({a}, {b}), 6) AS corr FROM lineitem"""
    for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i:]))
def g_copula_stats(spark, sf):
    out = copula_stats(table(spark, sf, "lineitem"), _NUMBERS)
    return out.select("a", "b", *[F.round(c, 4).alias(c) for c in ("mean_a", "mean_b", "std_a", "std_b")], r6("corr", "corr"))


def _copula():
    spread = np.diag([100.0, 10.0, 0.1])
    corr = np.array([[1.0, 0.6, -0.2], [0.6, 1.0, 0.1], [-0.2, 0.1, 1.0]])
    names = ["value", "quantity", "discount"]
    return Copula(names, {n: T.DoubleType() for n in names}, [_Dim(n) for n in names], [50.0, 25.0, 0.05], spread @ corr @ spread)


def _copula_sql():
    model = _copula()
    w, factor = model.conditional(["value"], ["quantity", "discount"])
    src = with_normal(with_normal("events", ["event_id"], 7, "copula/0", "z0"), ["event_id"], 7, "copula/1", "z1")
    cols = [
        f"round({float(model.mean[i + 1])!r} + {float(w[i, 0])!r} * (value - 50.0) + {float(factor[i, 0])!r} * z0 + {float(factor[i, 1])!r} * z1, 6) AS {n}"
        for i, n in enumerate(["quantity", "discount"])]
    return f"SELECT event_id, {', '.join(cols)} FROM {src}"


@query("g_copula_sample", _copula_sql())
def g_copula_sample(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    out = _copula().sample_given(e, ["value"], ["quantity", "discount"], 7, ["event_id"])
    return out.select("event_id", r6("quantity", "quantity"), r6("discount", "discount"))


@query("g_complete_conditions")
def g_complete_conditions(spark, sf):
    p = table(spark, sf, "part")
    rule = UniqueCombinations(["p_brand", "p_type"], fit_columns_model=True).fit(p)
    return complete_conditions(p.select("p_partkey", "p_brand"), rule, seed=7, id_col="p_partkey")


@query("g_wide_model", """
    SELECT p_brand AS a, p_type AS b, round(count(*) / n - any_value(nb) / n * (any_value(nt) / n) + 1.313e-7, 6) + 0.0 AS cov FROM (
        SELECT *, count(*) OVER (PARTITION BY p_brand) AS nb, count(*) OVER (PARTITION BY p_type) AS nt, (count(*) OVER ())::DOUBLE AS n FROM part)
    GROUP BY p_brand, p_type, n""")
def g_wide_model(spark, sf):
    """Covariances of a factored column model learned from all parts; with as many factors as dimensions they are exact."""
    p = table(spark, sf, "part")
    model = FactorModel.fit(p, ["p_brand", "p_type", "p_size"], rank=64)
    pairs = p.select(F.col("p_brand").alias("a"), F.col("p_type").alias("b")).distinct()
    return model.covariance(pairs, "p_brand", "p_type").withColumn("cov", F.round(F.col("cov") + F.lit(1.313e-7), 6) + F.lit(0.0))  # off the ties of fractions


@query("g_complete_invariants", """
    SELECT p_partkey, p_brand, true AS seen, true AS own_brand FROM part""")
def g_complete_invariants(spark, sf):
    """Whatever is drawn: each part keeps its brand, and the completed combination occurs among the parts."""
    p = table(spark, sf, "part")
    out = g_complete_conditions(spark, sf)
    known = p.select("p_brand", "p_type").distinct().withColumn("seen", F.lit(True))
    own = p.select("p_partkey", F.col("p_brand").alias("_brand"))
    out = out.join(known, ["p_brand", "p_type"], "left").join(own, "p_partkey")
    return out.select("p_partkey", "p_brand", F.coalesce("seen", F.lit(False)).alias("seen"), (F.col("_brand") == F.col("p_brand")).alias("own_brand"))


# -- generation ---------------------------------------------------------------------------
def pick_sql(draws, bounds, on, u, values):
    """``draws`` with the value columns of the interval that contains ``u``."""
    test = " AND ".join(f"_d.{a} = _i.{b}" for a, b in on)
    given = ", ".join(f"_i.{v} AS {n}" for v, n in values)
    return f"(SELECT _d.*, {given} FROM {draws} _d JOIN {bounds} _i ON {test + ' AND ' if test else ''}_d.{u} >= _i.lo AND _d.{u} < _i.hi)"


def _value_sql(component, z):
    return f"least(greatest({z} / 4, -1), 1) * 4 * {MIX.stds!r}[{component} + 1] + {MIX.means!r}[{component} + 1]"


def _seen_sql():
    joint = f"({joint_sql()})"
    q = "(SELECT o_orderkey FROM orders)"
    for stream, name in [("pair", "up"), ("triple", "ut"), ("component/l_extendedprice", "uc"), *[(f"value/{c}", f"uv{i}") for i, c in enumerate(COLUMNS)]]:
        q = with_u(q, ["o_orderkey"], SEED, stream, name)
    q = with_normal(q, ["o_orderkey"], SEED, "z/l_extendedprice", "zz")
    names = ", ".join(f"'{x}|{y}'" for x, y in PAIRS)
    q = f"(SELECT *, [{names}][{below('up', '3')} + 1] AS pair FROM {q})"
    q = pick_sql(q, bounds_sql(joint, "pair", "label, a, b"), [("pair", "pair")], "ut", [("label", "label"), ("a", "a"), ("b", "b")])
    for i, c in enumerate(COLUMNS):
        own = bounds_sql(f"(SELECT {LABEL} AS label, {c} AS value, count(*) AS n FROM {LO_SQL} GROUP BY 1, 2)", "label", "value")
        q = pick_sql(q, own, [("label", "label")], f"uv{i}", [("value", f"v{i}")])
    shares = " UNION ALL ".join(
        f"SELECT {LABEL} AS label, {i} AS component, round(sum(p{i}) * 1e6)::BIGINT AS n FROM {probabilities_sql(f'(SELECT * FROM {LO_SQL})', 'l_extendedprice')} GROUP BY 1"
        for i in range(3))
    q = pick_sql(q, bounds_sql(f"({shares})", "label", "component"), [("label", "label")], "uc", [("component", "component")])
    cols = ", ".join(
        f"CASE WHEN split_part(pair, '|', 1) = '{c}' THEN a WHEN split_part(pair, '|', 2) = '{c}' THEN b ELSE v{i} END AS {c}"
        for i, c in enumerate(COLUMNS))
    return f"SELECT o_orderkey, label AS {LABEL}, {cols}, round({_value_sql('component', 'zz')}, 4) AS l_extendedprice FROM {q}"


@query("g_generate_seen", _seen_sql())
def g_generate_seen(spark, sf):
    lo = lineitem_orders(spark, sf)
    model = fit_model(lo, LABEL, COLUMNS, ["l_extendedprice"], {"l_extendedprice": MIX})
    out = generate(model, table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], SEED)
    return out.withColumn("l_extendedprice", F.round("l_extendedprice", 4))


def _stored_sql():
    q = _seen_sql().replace("(SELECT o_orderkey FROM orders)", "(SELECT i AS o_orderkey FROM range(0, (SELECT count(*) FROM orders)) t(i))")
    return f"SELECT * EXCLUDE (o_orderkey) FROM ({q})"


@query("s_profile_store", _stored_sql())
def s_profile_store(spark, sf):
    """Rows of a profile that was saved twice and loaded again."""
    path = scratch_path(spark, "store")
    profile = _orders_profile(spark, sf)
    profile.save(path)
    profile.save(path)
    rows = Profile.load(spark, path).sample(table(spark, sf, "orders").count(), seed=SEED)
    return rows.withColumn("l_extendedprice", F.round("l_extendedprice", 4))


_TRAIN = "(SELECT * FROM (SELECT *, o_custkey % 10 AS label FROM orders) WHERE label <> 9)"


def _unseen_sql():
    near = f"""(SELECT neighbour, exp(s) / sum(exp(s)) OVER () AS w FROM (
        SELECT o.key AS neighbour, list_cosine_similarity(u.v, o.v) AS s FROM {_VECTORS} u JOIN {_VECTORS} o ON u.key = '9' AND o.key <> '9'
        WHERE o.key IN (SELECT label::VARCHAR FROM {_TRAIN}) ORDER BY s DESC, o.key LIMIT 3))"""
    pairs = f"""(SELECT a, b, round(sum(share * w) * 1e12)::BIGINT AS n FROM (
        SELECT label::VARCHAR AS label, o_orderstatus AS a, o_orderpriority AS b, count(*) / sum(count(*)) OVER (PARTITION BY label) AS share
        FROM {_TRAIN} GROUP BY 1, 2, 3, label) JOIN {near} ON neighbour = label GROUP BY 1, 2)"""
    raw = " UNION ALL ".join(
        f"SELECT label::VARCHAR AS label, {i} AS component, round(sum(p{i}) * 1e6)::BIGINT AS n FROM {probabilities_sql(_TRAIN, 'o_totalprice')} GROUP BY 1"
        for i in range(3))
    shares = f"""(SELECT component, round(sum(share * w) * 1e12)::BIGINT AS n FROM (
        SELECT label, component, n / sum(n) OVER (PARTITION BY label) AS share FROM ({raw})) JOIN {near} ON neighbour = label GROUP BY 1)"""
    q = with_u(with_u("(SELECT o_orderkey AS cand_id FROM orders)", ["cand_id"], SEED, "triple", "ut"), ["cand_id"], SEED, "component/o_totalprice", "uc")
    q = with_normal(q, ["cand_id"], SEED, "z/o_totalprice", "zz")
    q = pick_sql(q, bounds_sql(pairs, "", "a, b"), [], "ut", [("a", "o_orderstatus"), ("b", "o_orderpriority")])
    q = pick_sql(q, bounds_sql(shares, "", "component"), [], "uc", [("component", "component")])
    return f"SELECT cand_id, '9' AS label, o_orderstatus, o_orderpriority, round({_value_sql('component', 'zz')}, 4) AS o_totalprice FROM {q}"


@query("g_generate_unseen", _unseen_sql())
def g_generate_unseen(spark, sf):
    o = table(spark, sf, "orders")
    rows = o.withColumn("label", F.col("o_custkey") % 10).filter("label <> 9")  # 9 stays unseen
    rows = rows.select(F.col("label").cast("string").alias("label"), "o_orderstatus", "o_orderpriority", "o_totalprice")
    model = fit_model(rows, "label", ["o_orderstatus", "o_orderpriority"], ["o_totalprice"], {"o_totalprice": MIX})
    profile = Profile(TableSpec.infer(rows), "label", [], model, {}, {}, 0, _label_vectors(spark, sf))
    mixed = profile._unseen_model(spark, ["9"], 3)
    ids = o.select(F.col("o_orderkey").alias("cand_id"), F.lit("9").alias("label"))
    return generate(mixed, ids, ["cand_id"], SEED, given=True).withColumn("o_totalprice", F.round("o_totalprice", 4))


# -- rejection ----------------------------------------------------------------------------
def _topup_sql():
    """All candidates of the model, filtered; the first of each key, the first of those."""
    shares = " UNION ALL ".join(
        f"SELECT o_orderstatus AS label, {i} AS component, round(sum(p{i}) * 1e6)::BIGINT AS n FROM {probabilities_sql('orders', 'o_totalprice')} GROUP BY 1"
        for i in range(3))
    q = "(SELECT i AS cand_id FROM range(0, 20 * (SELECT count(*) FROM orders)) t(i))"
    for stream, name in [("label", "ul"), ("value/o_orderpriority", "uv"), ("component/o_totalprice", "uc")]:
        q = with_u(q, ["cand_id"], SEED, stream, name)
    q = with_normal(q, ["cand_id"], SEED, "z/o_totalprice", "zz")
    own = "(SELECT o_orderstatus AS label, o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1, 2)"
    q = pick_sql(q, bounds_sql("(SELECT o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 1)", "", "label"), [], "ul", [("label", "o_orderstatus")])
    q = pick_sql(q, bounds_sql(own, "label", "value"), [("o_orderstatus", "label")], "uv", [("value", "o_orderpriority")])
    q = pick_sql(q, bounds_sql(f"({shares})", "label", "component"), [("o_orderstatus", "label")], "uc", [("component", "component")])
    return f"""
    SELECT cand_id, o_orderstatus, o_orderpriority, round(price, 4) AS o_totalprice FROM (
        SELECT *, floor(price * 10)::BIGINT AS tenths FROM (SELECT *, {_value_sql('component', 'zz')} AS price FROM {q}) WHERE price >= 20000 AND price <= 60000)
    QUALIFY row_number() OVER (PARTITION BY o_orderpriority, tenths ORDER BY cand_id) = 1
    ORDER BY cand_id LIMIT (SELECT count(*) FROM orders)"""


@query("g_topup", _topup_sql())
def g_topup(spark, sf):
    """As many rows as there are orders, drawn from a model of them, within a price range and no two with one priority and price to a tenth.

    They are found among 20 candidates an order, as in the SQL. The range holds 400,001 tenths, so there are fewer rows where the orders are more than
    what that gives with their priorities.
    """
    o = table(spark, sf, "orders")
    model = fit_model(o, "o_orderstatus", ["o_orderpriority"], ["o_totalprice"], {"o_totalprice": MIX})
    rules = [Between("o_totalprice", 20000.0, 60000.0, handling="reject_sampling"), Unique(["o_orderpriority", "tenths"], "cand_id")]

    def source(ids):
        return generate(model, ids, ["cand_id"], SEED).withColumn("tenths", F.floor(F.col("o_totalprice") * 10).cast("bigint"))

    wanted = o.count()
    rows = sample_valid(spark, source, rules, wanted, graceful=True, max_candidates=20 * wanted)
    return rows.select("cand_id", "o_orderstatus", "o_orderpriority", F.round("o_totalprice", 4).alias("o_totalprice"))


@query("g_repeat_fill", """
    WITH v AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS k FROM customer WHERE c_acctbal < 0),
    s AS (SELECT row_number() OVER () - 1 AS fill_id FROM customer)
    SELECT fill_id, c_custkey FROM s JOIN v ON k = fill_id % (SELECT count(*) FROM v)""")
def g_repeat_fill(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return repeat_fill(c.filter("c_acctbal < 0").drop("c_acctbal"), "c_custkey", c.count())


@query("g_filter_conditions", "SELECT event_id, event_type, 50.0::DOUBLE AS value FROM events WHERE event_type = 'click' AND abs(value - 50) < 50 * 0.05")
def g_filter_conditions(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    return filter_conditions(e, {"value": 50.0, "event_type": "click"}, 0.05)


@query("g_make_conditions", """
    SELECT row_number() OVER (ORDER BY o_orderstatus, o_orderpriority) - 1 AS cond_id, o_orderstatus, o_orderpriority FROM orders""")
def g_make_conditions(spark, sf):
    return make_conditions(spark, table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority"))


def _tries_sql():
    q = "(SELECT o_orderkey AS cond_id, o_orderstatus, i AS attempt FROM orders, range(0, 120) t(i))"
    return with_u(with_u(q, ["cond_id", "attempt"], SEED, "status", "us"), ["cond_id", "attempt"], SEED, "v", "uv")


@query("g_conditional", f"""
    SELECT cond_id, o_orderstatus, round(arg_min(uv, attempt), 6) AS v FROM {_tries_sql()}
    WHERE ['F', 'O', 'P'][{below('us', '3')} + 1] = o_orderstatus AND uv BETWEEN 0.1 AND 0.9 GROUP BY 1, 2""")
def g_conditional(spark, sf):
    wanted = table(spark, sf, "orders").select(F.col("o_orderkey").alias("cond_id"), "o_orderstatus")

    def source(tries):
        states = F.array(*[F.lit(s) for s in "FOP"])
        at = (F.floor(uniform(SEED, "status", "cond_id", "attempt") * 3) + 1).cast("int")
        return tries.withColumns({"o_orderstatus": F.element_at(states, at), "v": uniform(SEED, "v", "cond_id", "attempt")})

    rows = sample_conditional(wanted, source, [Between("v", 0.1, 0.9, handling="reject_sampling")])
    return rows.select("cond_id", "o_orderstatus", r6("v", "v"))

def _conditional_profile_sql():
    """Weights of (label, pair) under the given flag and priority, then everything else given the label."""
    asked = "(SELECT o_orderkey AS cond_id, 0 AS attempt, ['A', 'N', 'R'][o_orderkey % 3 + 1] AS kx, o_orderpriority AS ky FROM orders)"
    own = lambda c: f"(SELECT {LABEL} AS label, {c} AS v, count(*) AS n FROM {LO_SQL} GROUP BY 1, 2)"
    weights = f"""(SELECT kx, ky, label, kind, w FROM (
        SELECT f.v AS kx, p.v AS ky, l.label, 2.0::DOUBLE * l.n * (f.n::DOUBLE / l.n::DOUBLE) * (p.n::DOUBLE / l.n::DOUBLE) AS w, '' AS kind
        FROM (SELECT {LABEL} AS label, count(*) AS n FROM {LO_SQL} GROUP BY 1) l JOIN {own('l_returnflag')} f USING (label) JOIN {own('o_orderpriority')} p USING (label)
        UNION ALL SELECT l_returnflag, o_orderpriority, {LABEL}, count(*)::DOUBLE, 'l_returnflag|o_orderpriority' FROM {LO_SQL} GROUP BY 1, 2, 3))"""
    whole = f"(SELECT * EXCLUDE (w), round(w / max(w) OVER (PARTITION BY kx, ky) * 1e12)::BIGINT AS n FROM {weights})"
    shares = " UNION ALL ".join(
        f"SELECT {LABEL} AS label, {i} AS component, round(sum(p{i}) * 1e6)::BIGINT AS n FROM {probabilities_sql(f'(SELECT * FROM {LO_SQL})', 'l_extendedprice')} GROUP BY 1"
        for i in range(3))
    q, ids = asked, ["cond_id", "attempt"]
    for stream, name in [("guided", "ug"), ("pair", "up"), ("guided/second", "us"), ("guided/first", "uf"), ("value/l_linestatus", "uv"), ("component/l_extendedprice", "uc")]:
        q = with_u(q, ids, SEED, stream, name)
    q = with_normal(q, ids, SEED, "z/l_extendedprice", "zz")
    q = pick_sql(q, bounds_sql(whole, "kx, ky", "kind, label"), [("kx", "kx"), ("ky", "ky")], "ug", [("kind", "kind"), ("label", "label")])
    q = f"(SELECT *, CASE kind WHEN '' THEN ['l_returnflag|l_linestatus', 'l_linestatus|o_orderpriority'][{below('up', '2')} + 1] ELSE kind END AS pair FROM {q})"
    joint = lambda x, y: f"(SELECT {LABEL} AS label, {x} AS a, {y} AS b, count(*) AS n FROM {LO_SQL} GROUP BY 1, 2, 3)"
    second = bounds_sql(joint("l_returnflag", "l_linestatus"), "label, a", "b")
    first = bounds_sql(joint("l_linestatus", "o_orderpriority"), "label, b", "a")
    q = f"(SELECT _d.*, s.b AS b FROM {q} _d LEFT JOIN {second} s ON pair = 'l_returnflag|l_linestatus' AND s.label = _d.label AND s.a = kx AND us >= s.lo AND us < s.hi)"
    q = f"(SELECT _d.*, s.a AS a FROM {q} _d LEFT JOIN {first} s ON pair = 'l_linestatus|o_orderpriority' AND s.label = _d.label AND s.b = ky AND uf >= s.lo AND uf < s.hi)"
    q = pick_sql(q, bounds_sql(f"(SELECT label, v AS value, n FROM {own('l_linestatus')})", "label", "value"), [("label", "label")], "uv", [("value", "own")])
    q = pick_sql(q, bounds_sql(f"({shares})", "label", "component"), [("label", "label")], "uc", [("component", "component")])
    return f"""SELECT cond_id, label AS {LABEL}, kx AS l_returnflag, coalesce(b, a, own) AS l_linestatus, ky AS o_orderpriority,
        round({_value_sql('component', 'zz')}, 4) AS l_extendedprice FROM {q}"""


def _orders_profile(spark, sf):
    lo = lineitem_orders(spark, sf).select(LABEL, *COLUMNS, "l_extendedprice")
    model = fit_model(lo, LABEL, COLUMNS, ["l_extendedprice"], {"l_extendedprice": MIX})
    return Profile(TableSpec.infer(lo), LABEL, [], model, {}, {f.name: f.dataType for f in lo.schema.fields}, 0)


@query("g_conditional_profile", _conditional_profile_sql())
def g_conditional_profile(spark, sf):
    """A row for every order with the order's priority and a given return flag, also where the two are rare together."""
    flag = F.element_at(F.array(*[F.lit(v) for v in "ANR"]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    asked = table(spark, sf, "orders").select(F.col("o_orderkey").alias("cond_id"), flag.alias("l_returnflag"), "o_orderpriority")
    out = _orders_profile(spark, sf).sample(conditions=asked, seed=SEED, max_retries=0)
    return out.withColumn("l_extendedprice", F.round("l_extendedprice", 4))


@query("g_finalize", "SELECT o_orderkey, o_orderkey AS row_id, o_orderstatus, round(o_totalprice, 2) AS o_totalprice, o_orderdate FROM orders")
def g_finalize(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    spec = TableSpec([
        FieldSpec("row_id", "id", "integer"), FieldSpec("o_orderstatus", "categorical"), FieldSpec("o_totalprice", "numerical", "float"),
        FieldSpec("o_orderdate", "datetime"),
    ], primary_key="row_id")
    rule = Between("o_totalprice", 0.0, 1e6).fit(o)
    coded = rule.transform(o)
    encoders = fit_encoders(coded, choose_encoders(coded, spec, [rule.encoded]), "o_orderkey")
    encoders[rule.encoded].digits = None
    rows = decode(encode(coded, encoders, keep=["o_orderkey"]), encoders)
    out = finalize(rows, spec, [rule], SEED, "o_orderkey", {f: o.schema[f].dataType for f in o.columns[1:]})
    return out.withColumn("o_totalprice", F.round("o_totalprice", 2))


# -- privacy ------------------------------------------------------------------------------
def _private_sql():
    capped = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {RK_SQL}) AS nth FROM {LO_SQL}) WHERE nth <= 3)"""
    code = lambda c: f"(SELECT {c}::VARCHAR AS v, row_number() OVER (ORDER BY {c}) - 1 AS k, count(*) OVER () AS size FROM (SELECT DISTINCT {c} FROM {LO_SQL}))"
    size = lambda c: f"(SELECT count(DISTINCT {c}) FROM {LO_SQL})"
    parts, start = [], "0"
    for x, y in PAIRS:
        parts.append(
            f"SELECT '{x}|{y}' AS pair, l.v AS label, a.v AS a, b.v AS b, {start} + (l.k * a.size + a.k) * b.size + b.k AS cell "
            f"FROM {code(LABEL)} l, {code(x)} a, {code(y)} b")
        start += f" + {size(LABEL)} * {size(x)} * {size(y)}"
    cells = with_normal(f"({' UNION ALL '.join(parts)})", ["cell"], SEED, "noise", "z")
    return f"""
        WITH c AS (SELECT cells.pair, cells.label, cells.a, cells.b, greatest(coalesce(n, 0) + z * {5.0 * 3 * 3**0.5!r}, 0) AS noisy
            FROM {cells} cells LEFT JOIN ({joint_sql(capped)}) j
            ON cells.pair = j.pair AND cells.label = j.label AND cells.a = j.a AND cells.b = j.b)
        SELECT pair, label, a, b, round(noisy, 6) AS noisy, round(noisy / sum(noisy) OVER (PARTITION BY pair), 6) AS p,
            round((SELECT min((1 + i / 10) / 50 + ln(1 / 2e-6) / (i / 10)) FROM range(1, 1271) t(i)), 6) AS epsilon FROM c"""


# the public value lists of the tables' specification
_DOMAIN = {
    "o_orderstatus": ["F", "O", "P"], "l_returnflag": ["A", "N", "R"], "l_linestatus": ["F", "O"],
    "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
}


@query("p_private_freq", _private_sql())
def p_private_freq(spark, sf):
    domain = {c: spark.createDataFrame([(v,) for v in values], "value string") for c, values in _DOMAIN.items()}
    out = private_freq(lineitem_orders(spark, sf), LABEL, COLUMNS, "o_custkey", RK, SEED, 5.0, 3, 2e-6, domain)
    return out.select("pair", "label", "a", "b", r6("noisy", "noisy"), r6("p", "p"), r6("epsilon", "epsilon"))


# the public value lists of a part's size and of the suppliers; most pairs of them occur in no row
_PRIVATE = ["l_returnflag", "p_size", "l_suppkey"]
_PRIVATE_SIGMA, _PRIVATE_ROWS, _PRIVATE_THRESHOLD = 1.0, 3, 2.0


def _poly(coefficients, x):
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def _private_profile_sql():
    """Observed cells with noise, and the cells whose noise alone passes the threshold, found by geometric gaps."""
    source = f"(SELECT * FROM {LO_SQL} JOIN part ON l_partkey = p_partkey)"
    capped = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {RK_SQL}) AS nth FROM {source}) WHERE nth <= {_PRIVATE_ROWS})"
    pairs = [(a, b) for i, a in enumerate(_PRIVATE) for b in _PRIVATE[i + 1:]]
    deviation = _PRIVATE_SIGMA * _PRIVATE_ROWS * len(pairs) ** 0.5
    p = tail_probability(_PRIVATE_THRESHOLD)
    width = power_of_two(math.ceil(BLOCK_SURVIVORS / p))
    values = {
        LABEL: "SELECT unnest(['F', 'O', 'P']) AS v", "l_returnflag": "SELECT unnest(['A', 'N', 'R']) AS v",
        "p_size": "SELECT unnest(range(1, 51))::VARCHAR AS v", "l_suppkey": "SELECT DISTINCT s_suppkey::VARCHAR AS v FROM supplier",
    }
    codes = " UNION ALL ".join(f"SELECT '{c}' AS c, v, row_number() OVER (ORDER BY v) - 1 AS k FROM ({q})" for c, q in values.items())
    noise = with_normal("(SELECT tab, cell, n FROM observed)", ["cell"], SEED, "noise", "z")
    gaps = with_u("(SELECT tab, start, size, block, (block - first_block) * " + str(width) + " AS lower, unnest(range(0, " + str(MOST_GAPS) + ")) AS draw FROM (SELECT *, first_block + unnest(range(0, blocks)) AS block FROM tabs))", ["block", "draw"], SEED, "gap", "ug")
    tails = with_u("(SELECT tab, cell FROM spare)", ["cell"], SEED, "tail", "ut")
    r = f"sqrt(-ln({p!r} * ut))"
    near, far = f"({r} - 1.6)", f"({r} - 5.0)"
    z = f"CASE WHEN {r} <= 5.0 THEN {_poly(_TAIL[0], near)} / {_poly(_TAIL[1], near)} ELSE {_poly(_FAR_TAIL[0], far)} / {_poly(_FAR_TAIL[1], far)} END"
    return f"""
    WITH codes AS MATERIALIZED ({codes}), sizes AS (SELECT c, count(*) AS k FROM codes GROUP BY 1),
    pairs AS (SELECT i, x || '|' || y AS tab, x, y, l.k * a.k * b.k AS size, a.k AS ka, b.k AS kb
              FROM (VALUES {', '.join(f"({i}, '{x}', '{y}')" for i, (x, y) in enumerate(pairs))}) t(i, x, y)
              JOIN sizes l ON l.c = '{LABEL}' JOIN sizes a ON a.c = x JOIN sizes b ON b.c = y),
    tabs AS (SELECT *, (sum(size) OVER (ORDER BY i) - size)::BIGINT AS start, (sum(blocks) OVER (ORDER BY i) - blocks)::BIGINT AS first_block
             FROM (SELECT *, ((size + {width} - 1) // {width})::BIGINT AS blocks FROM pairs)),
    counts AS MATERIALIZED ({joint_sql(capped, LABEL, pairs)}),
    observed AS (SELECT tab, (start + (l.k * ka + a.k) * kb + b.k)::BIGINT AS cell, n FROM counts JOIN tabs ON tab = pair
                 JOIN codes l ON l.c = '{LABEL}' AND l.v = label JOIN codes a ON a.c = x AND a.v = counts.a JOIN codes b ON b.c = y AND b.v = counts.b),
    spare AS (SELECT tab, (start + lower + at_)::BIGINT AS cell FROM (
                  SELECT *, sum(floor(ln(ug) / {math.log1p(-p)!r})::BIGINT + 1) OVER (PARTITION BY block ORDER BY draw) - 1 AS at_ FROM {gaps})
              WHERE at_ < least({width}, size - lower) AND (start + lower + at_)::BIGINT NOT IN (SELECT cell FROM observed)),
    kept AS (SELECT tab, cell, n + z * {deviation!r} AS noisy FROM {noise} WHERE n + z * {deviation!r} >= {_PRIVATE_THRESHOLD * deviation!r}
             UNION ALL SELECT tab, cell, ({z}) * {deviation!r} FROM {tails})
    SELECT kept.tab AS pair, l.v AS label, a.v AS a, b.v AS b, round(noisy)::BIGINT AS n,
           round((SELECT min((1 + i / 10) / {_PRIVATE_SIGMA**2!r} + ln(1 / 2e-6) / (i / 10)) FROM range(1, 1271) t(i)), 6) AS epsilon
    FROM kept JOIN tabs ON tabs.tab = kept.tab JOIN codes l ON l.c = '{LABEL}' AND l.k = (cell - start) // (ka * kb)
    JOIN codes a ON a.c = x AND a.k = (cell - start) // kb % ka JOIN codes b ON b.c = y AND b.k = (cell - start) % kb"""


@query("p_private_profile", _private_profile_sql())
def p_private_profile(spark, sf):
    """The joint counts of a profile learned privately, and the epsilon of its two releases."""
    rows = lineitem_orders(spark, sf).join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    how = Private(
        "o_custkey", RK, {
            LABEL: _DOMAIN[LABEL], "l_returnflag": _DOMAIN["l_returnflag"], "p_size": list(range(1, 51)),
            "l_suppkey": table(spark, sf, "supplier").select(F.col("s_suppkey").alias("value")),
        }, {"l_quantity": (0.0, 51.0)}, _PRIVATE_ROWS, _PRIVATE_SIGMA, threshold=_PRIVATE_THRESHOLD, seed=SEED)
    profile = Synthesizer(LABEL, private=how).fit(rows)
    return profile.model.joint.withColumn("epsilon", F.round(F.lit(profile.epsilon), 6))


@query("x_scalar_mix", """
    SELECT event_id, 'http://x/' || event_type AS key, epoch_us(ts) AS micros, date_diff('day', TIMESTAMP '2024-01-01', ts)::BIGINT AS days FROM events""")
def x_scalar_mix(spark, sf):
    e = table(spark, sf, "events").withColumn("label", F.concat(F.lit("EX."), F.col("event_type")))
    days = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint")
    out = normalise_key(e, "label", "EX.", "http://x/", "key")
    return out.select("event_id", "key", time_number(out, "ts").alias("micros"), days.alias("days"))
