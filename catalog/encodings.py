"""Reversible encoders, the mixture normaliser, anonymisation and ids."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rowloom.functions.names import WORDS
from rowloom.operators.anonymize import anon_map, anonymize, fresh_pii, make_ids, make_ids_unique
from rowloom.operators.constraints import Constraint, filter_valid, prepare
from rowloom.operators.encoders import (
    BinaryEnc, Encoder, LabelEnc, Numeric, OneHotEnc, UniformCat, UnixTs, argmax_decode, choose_encoders, decode, encode, fit_encoders,
)
from rowloom.operators.generate import ids_only
from rowloom.operators.mixture import Mixture, inverse_mixture, mixture_table, transform_mixture
from rowloom.operators.ordinals import dense_index
from rowloom.sources import profiles
from rowloom.spec import FieldSpec, TableSpec

from .base import RK, RK_SQL, below, query, r6, table, with_u
from .constraints import KINDS, _scores, scores_sql
from .frequencies import bounds_sql

_PRICE = "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END"
_DIGITS = "(SELECT max(length(rtrim(split_part(v::VARCHAR, '.', 2), '0'))) FROM x)"


@query("e_numeric", f"""
    WITH x AS (SELECT o_orderkey, {_PRICE} AS v FROM orders), s AS (SELECT avg(v) AS m, min(v) AS lo, max(v) AS hi FROM x)
    SELECT o_orderkey, round(coalesce(v, m), 6) AS code,
           round(round_even(least(greatest(coalesce(v, m) * 1.01 - 1000, lo), hi) * 10 ** {_DIGITS}, 0) / 10 ** {_DIGITS}, 6) AS back
    FROM x, s""")
def e_numeric(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.expr(_PRICE).alias("v"))
    enc = Numeric().fit(o, "v")
    coded = enc.encode(o, "c").withColumn("moved", F.transform("c", lambda x: x * 1.01 - 1000))
    return enc.decode(coded, "moved", "back").select("o_orderkey", r6(F.col("c")[0], "code"), r6("back", "back"))


@query("e_binary", """
    WITH x AS (SELECT doc_id, CASE WHEN quality = 0 THEN NULL ELSE toxic END AS v FROM labels)
    SELECT doc_id, coalesce(v, (SELECT CASE WHEN count(*) FILTER (v = 1) > count(*) FILTER (v = 0) THEN 1 ELSE 0 END FROM x))::DOUBLE AS code,
           coalesce(v, (SELECT CASE WHEN count(*) FILTER (v = 1) > count(*) FILTER (v = 0) THEN 1 ELSE 0 END FROM x))::INTEGER AS back FROM x""")
def e_binary(spark, sf):
    x = table(spark, sf, "labels").select("doc_id", F.expr("if(quality = 0, null, toxic)").alias("v"))
    enc = BinaryEnc().fit(x, "v")
    return enc.decode(enc.encode(x, "c"), "c", "back").select("doc_id", F.col("c")[0].alias("code"), "back")


@query("e_unix_ts", """
    WITH x AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE ts END AS v FROM events)
    SELECT event_id, coalesce(epoch_us(v), round((SELECT avg(epoch_us(v)) FROM x), 0))::BIGINT // 1000 AS code_ms,
           CASE WHEN v IS NULL THEN NULL ELSE v END AS back FROM x""")
def e_unix_ts(spark, sf):
    x = table(spark, sf, "events").select("event_id", F.expr("if(event_type = 'error', null, ts)").alias("v"))
    enc = UnixTs().fit(x, "v")
    out = enc.decode(enc.encode(x, "c"), "c", "back")
    code = F.floor(F.rint(F.col("c")[0] / 1000) / 1000).cast("bigint")
    return out.select("event_id", code.alias("code_ms"), F.when(F.col("v").isNotNull(), F.col("back")).alias("back"))


@query("e_uniform_cat", f"""
    SELECT o_orderkey, round(lo + u * (hi - lo), 6) AS code, o_orderpriority AS back
    FROM {with_u('orders', ['o_orderkey'], 7, 'cat/o_orderpriority')}
    JOIN {bounds_sql('(SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1)', '', 'value')} ON value = o_orderpriority""")
def e_uniform_cat(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    enc = UniformCat(seed=7).fit(o, "o_orderpriority")
    coded = enc.encode(o, "c", ["o_orderkey"])
    return enc.decode(coded, "c", "back").select("o_orderkey", r6(F.col("c")[0], "code"), "back")


_ORDER = "(SELECT o_orderpriority AS v, min(o_orderkey) AS first FROM orders GROUP BY 1)"


@query("e_onehot", f"""
    SELECT o_orderkey, string_agg(CASE WHEN v = o_orderpriority THEN '1' ELSE '0' END, '' ORDER BY first) AS bits,
           any_value(o_orderpriority) AS back FROM orders, {_ORDER} GROUP BY o_orderkey""")
def e_onehot(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    enc = OneHotEnc().fit(o, "o_orderpriority", order_by="o_orderkey")
    out = enc.decode(enc.encode(o, "c"), "c", "back")
    return out.select("o_orderkey", F.array_join(F.transform("c", lambda x: x.cast("int").cast("string")), "").alias("bits"), "back")


@query("e_label", f"""
    SELECT o_orderkey, k::DOUBLE AS code, o_orderpriority AS back
    FROM orders JOIN (SELECT v, row_number() OVER (ORDER BY first) - 1 AS k FROM {_ORDER}) ON v = o_orderpriority""")
def e_label(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    enc = LabelEnc().fit(o, "o_orderpriority", order_by="o_orderkey")
    return enc.decode(enc.encode(o, "c"), "c", "back").select("o_orderkey", F.col("c")[0].alias("code"), "back")


FIELDS = ["o_orderpriority", "o_orderstatus", "o_totalprice", "o_orderdate"]


def row_encoders(orders):
    made = {"o_orderpriority": OneHotEnc(), "o_orderstatus": LabelEnc(), "o_totalprice": Numeric(), "o_orderdate": UnixTs()}
    return fit_encoders(orders.select("o_orderkey", *FIELDS), made, "o_orderkey")


@query("e_encode_row", f"""
    WITH p AS (SELECT v, row_number() OVER (ORDER BY first) - 1 AS k FROM {_ORDER}),
    s AS (SELECT v, row_number() OVER (ORDER BY first) - 1 AS k FROM (SELECT o_orderstatus AS v, min(o_orderkey) AS first FROM orders GROUP BY 1))
    SELECT o_orderkey, k AS pos, CASE WHEN v = o_orderpriority THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS val FROM orders, p
    UNION ALL SELECT o_orderkey, (SELECT count(*) FROM p), k FROM orders JOIN s ON v = o_orderstatus
    UNION ALL SELECT o_orderkey, (SELECT count(*) FROM p) + 1, round(o_totalprice, 4) FROM orders
    UNION ALL SELECT o_orderkey, (SELECT count(*) FROM p) + 2, epoch_us(o_orderdate) * 1000.0::DOUBLE FROM orders""")
def e_encode_row(spark, sf):
    o = table(spark, sf, "orders")
    coded = encode(o, row_encoders(o), keep=["o_orderkey"])
    flat = coded.select("o_orderkey", F.posexplode("vector").alias("pos", "val"))
    return flat.select("o_orderkey", F.col("pos").cast("bigint").alias("pos"), F.round("val", 4).alias("val"))


@query("e_roundtrip", f"SELECT o_orderkey, {', '.join(FIELDS)} FROM orders")
def e_roundtrip(spark, sf):
    o = table(spark, sf, "orders")
    encoders = row_encoders(o)
    return decode(encode(o, encoders, keep=["o_orderkey"]), encoders)


@query("e_argmax_decode", f"""
    SELECT event_id, [{', '.join(f"'{k}'" for k in KINDS)}][list_position([{', '.join(KINDS)}], greatest({', '.join(KINDS)}))] AS winner
    FROM {scores_sql()}""")
def e_argmax_decode(spark, sf):
    return argmax_decode(_scores(spark, sf), KINDS).select("event_id", "winner")


# -- mixture ------------------------------------------------------------------------------
MIX = Mixture([20000.0, 50000.0, 80000.0], [8100.0, 9300.0, 10700.0], [0.3, 0.4, 0.3])


def probabilities_sql(source, value, mix=MIX):
    """``source`` with p0..: floored component probabilities of ``value``."""
    k = range(mix.size)
    logs = ", ".join(
        f"{math.log(mix.weights[i]) - math.log(mix.stds[i])!r} - 0.5 * (({value} - {mix.means[i]!r}) / {mix.stds[i]!r}) ** 2 AS l{i}" for i in k)
    exps = ", ".join(f"exp(l{i} - greatest({', '.join(f'l{j}' for j in k)})) AS r{i}" for i in k)
    total = " + ".join(f"r{i}" for i in k)
    drop = ", ".join(f"{t}{i}" for i in k for t in "lr")
    probs = ", ".join(f"(r{i} / ({total}) + 1e-6) / {1 + mix.size * 1e-6!r} AS p{i}" for i in k)
    return f"(SELECT * EXCLUDE ({drop}), {probs} FROM (SELECT *, {exps} FROM (SELECT *, {logs} FROM {source})))"


def _component_sql():
    src = with_u("lineitem", RK, 7, "component/l_extendedprice")
    for i in range(MIX.size):
        src = with_u(src, RK, 7, f"component/l_extendedprice/{i}", f"u{i}")
    logs = [
        f"{math.log(MIX.weights[i]) - math.log(MIX.stds[i])!r} - 0.5 * ((l_extendedprice - {MIX.means[i]!r}) / {MIX.stds[i]!r}) ** 2 - ln(-ln(u{i}))"
        for i in range(MIX.size)]
    rare = MIX.size * 1e-6 / (1 + MIX.size * 1e-6)
    best = f"CASE WHEN u < {rare!r} THEN least(floor(u / {rare!r} * {MIX.size}), {MIX.size - 1}) ELSE list_position(g, list_max(g)) - 1 END::INTEGER"
    return f"(SELECT *, {best} AS c FROM (SELECT *, [{', '.join(logs)}] AS g FROM {src}))"


_Z = f"least(greatest((l_extendedprice - {MIX.means!r}[c + 1]) / (4 * {MIX.stds!r}[c + 1]), -0.99), 0.99)"


@query("e_mixture_transform", f"SELECT {RK_SQL}, c AS component, round({_Z}, 6) AS z FROM {_component_sql()}")
def e_mixture_transform(spark, sf):
    out = transform_mixture(table(spark, sf, "lineitem"), "l_extendedprice", MIX, 7, RK, "v")
    return out.select(*RK, (F.array_position("v", 1.0) - 2).cast("int").alias("component"), r6(F.col("v")[0], "z"))


@query("e_mixture_inverse", f"SELECT {RK_SQL}, round({_Z} * 4 * {MIX.stds!r}[c + 1] + {MIX.means!r}[c + 1], 4) AS x FROM {_component_sql()}")
def e_mixture_inverse(spark, sf):
    out = transform_mixture(table(spark, sf, "lineitem"), "l_extendedprice", MIX, 7, RK, "v")
    return out.select(*RK, F.round(inverse_mixture(F.col("v"), MIX), 4).alias("x"))


@query("e_mixture_fit")
def e_mixture_fit(spark, sf):
    return mixture_table(table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity", "l_discount"])


# -- anonymisation and ids ----------------------------------------------------------------
_W = WORDS["en_US"]


def _list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _keyed(salt, stream, value):
    text = f"'{salt}/{stream}/' || {value}"
    return f"((('0x' || substr(sha256({text}), 1, 13))::BIGINT + 0.5) * {2.0**-52!r})"


def _name_sql(first, last):
    return (f"{_list(_W['first'])}[{below(first, str(len(_W['first'])))} + 1] || ' ' || "
            f"{_list(_W['last'])}[{below(last, str(len(_W['last'])))} + 1]")


_MAP = f"SELECT c_name AS value, {_name_sql(_keyed('s', 'first', 'c_name'), _keyed('s', 'last', 'c_name'))} AS fake FROM customer"


@query("a_map", _MAP)
def a_map(spark, sf):
    return anon_map(table(spark, sf, "customer"), "c_name", "name", "s")


@query("a_apply", f"SELECT c_custkey, fake AS c_name FROM customer LEFT JOIN ({_MAP} WHERE c_acctbal >= 0) ON value = c_name")
def a_apply(spark, sf):
    c = table(spark, sf, "customer")
    names = anon_map(c.filter("c_acctbal >= 0"), "c_name", "name", "s")  # values never seen become null
    return anonymize(c, {"c_name": names}).select("c_custkey", "c_name")


@query("a_fresh", f"""
    SELECT c_custkey, {_name_sql('uf', 'ul')} AS c_name
    FROM {with_u(with_u('customer', ['c_custkey'], 7, 'c_name/first', 'uf'), ['c_custkey'], 7, 'c_name/last', 'ul')}""")
def a_fresh(spark, sf):
    spec = TableSpec([FieldSpec("c_name", "categorical", pii=True, pii_category="name")])
    return fresh_pii(table(spark, sf, "customer").select("c_custkey", "c_name"), spec, 7, "c_custkey")


@query("a_make_ids", "SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS new_id FROM part")
def a_make_ids(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    return make_ids(p, FieldSpec("new_id", "id", "integer"), ["p_name", "p_partkey"]).select("p_partkey", "new_id")


def _regex_sql(k):
    letter = lambda step: f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', ({k} // {step} % 26 + 1)::INTEGER, 1)"
    lead = f"CASE {k} // 1757600 WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE 'c' END"
    return f"{lead} || {letter(67600)} || {letter(2600)} || {letter(100)} || {k} // 10 % 10 || {k} % 10"


_PATTERN = r"^[a-c]?[A-Z]{3}\d{2}$"


@query("a_regex_ids", f"SELECT p_partkey, {_regex_sql('k')} AS code FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS k FROM part)")
def a_regex_ids(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    return make_ids(p, FieldSpec("code", "id", "string", regex=_PATTERN), ["p_name", "p_partkey"]).select("p_partkey", "code")


@query("a_ids_unique", "SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS p_size FROM part")
def a_ids_unique(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("bigint").alias("p_size"))
    spec = TableSpec([FieldSpec("p_partkey", "id", "integer"), FieldSpec("p_size", "id", "integer")])
    return make_ids_unique(p, spec, "p_partkey")


@query("g_ids_only", f"SELECT p_partkey, k AS number, {_regex_sql('k')} AS code FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS k FROM part)")
def g_ids_only(spark, sf):
    """A table of ids as long as the parts, attached to them in the order of their names."""
    p = dense_index(table(spark, sf, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"], "number")
    spec = TableSpec([FieldSpec("number", "id", "integer"), FieldSpec("code", "id", "string", regex=_PATTERN)])
    ids = ids_only(spark, spec, p.count())
    return p.join(ids, "number").select("p_partkey", "number", "code")


class Folded(Encoder):
    """A number as its place between 0 and 1 on a folded scale: an encoder as a user would write it."""

    def statistics(self, df):
        return [F.avg(F.abs(F.col(self.name)))]

    def learn(self, values):
        self.scale = float(values[0])

    def encoded(self, df):
        value = F.col(self.name)
        return F.array(value / (F.lit(self.scale) + F.abs(value)))

    def decoded(self, vector):
        return vector[0] * F.lit(self.scale) / (F.lit(1.0) - F.abs(vector[0]))


@query("u_own_encoder", """
    SELECT event_id, round(value / ((SELECT avg(abs(value)) FROM events) + abs(value)), 6) AS code, round(value, 6) AS value FROM events""")
def u_own_encoder(spark, sf):
    """A user's encoder, named by the field, learned with the others, used both ways, and found again by its name after saving."""
    e = table(spark, sf, "events").select("event_id", "value")
    spec = TableSpec([FieldSpec("event_id", "id", "integer"), FieldSpec("value", "numerical", "float", encoder=Folded)])
    plain = profiles.to_plain({"encoder": spec["value"].encoder}, {})
    spec["value"].encoder = profiles.from_plain(plain, {})["encoder"]
    encoders = fit_encoders(e, choose_encoders(e, spec), "event_id")
    coded = encode(e, encoders, keep=["event_id"])
    back = decode(coded.withColumn("code", F.col("vector")[0]), encoders)
    return back.select("event_id", r6("code", "code"), r6("value", "value"))


class MultipleOf(Constraint):
    """Whole multiples of a step: a constraint as a user would write it."""

    def __init__(self, column, step, handling="reject_sampling"):
        self.column, self.step = column, step
        self.columns = (column,)
        super().__init__(handling)

    def valid(self, df):
        return F.coalesce(F.col(self.column) % self.step == 0, F.lit(False))


@query("u_named_constraint", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity % 5 = 0 AND l_partkey % 2 = 0")
def u_named_constraint(spark, sf):
    """Constraints named in a description: by their dotted path, and by the name of their class."""
    asked = [{"constraint": f"{__name__}.MultipleOf", "column": "l_quantity", "step": 5}, {"constraint": "MultipleOf", "column": "l_partkey", "step": 2}]
    return filter_valid(table(spark, sf, "lineitem"), prepare(asked)).select("l_orderkey", "l_linenumber", "l_quantity")
