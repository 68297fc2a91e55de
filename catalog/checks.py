"""Projection, field profiles and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.operators.constraints import Between, ColumnFormula, GreaterThan, Rounding, Unique, UniqueCombinations
from rowloom.operators.validate import constraint_audit, duplicate_keys, orphan_keys, profile_fields, validate_table
from rowloom.spec import FieldSpec, TableSpec, project

from .base import LO_SQL, RK, RK_SQL, lineitem_orders, query, table


@query("v_project", "SELECT o_orderdate, o_totalprice, o_orderstatus FROM orders")
def v_project(spark, sf):
    o = table(spark, sf, "orders")
    spec = TableSpec.infer(o, ["o_orderdate", "o_orderkey", "o_totalprice", "o_orderstatus"], primary_key="o_orderkey")
    return project(o, spec)


def _profile_sql(source, fields):
    parts = []
    for name, kind, sub in fields:
        sub_sql = f"'{sub}'" if sub else "NULL::VARCHAR"
        test = (
            f"(bool_or({name} = 0) AND bool_or({name} = 1) AND bool_and({name} IN (0, 1)))"
            if kind == "numerical" else str(kind in ("categorical", "boolean")).lower()
        )
        parts.append(f"SELECT '{source}' AS source, '{name}' AS field, '{kind}' AS type, {sub_sql} AS subtype, {test} AS discrete FROM {source}"
                     + ("" if kind == "numerical" else " LIMIT 1"))
    return " UNION ALL ".join(f"({p})" for p in parts)


_I, _D = ("numerical", "integer"), ("numerical", "float")


@query("v_profile_fields", _profile_sql("labels", [("doc_id", *_I), ("quality", *_I), ("toxic", *_I)]) + " UNION ALL " + _profile_sql(
    "lineitem", [
        ("l_orderkey", *_I), ("l_partkey", *_I), ("l_suppkey", *_I), ("l_linenumber", "categorical", None), ("l_quantity", *_D),
        ("l_extendedprice", *_D), ("l_discount", *_D), ("l_tax", *_D), ("l_returnflag", "categorical", None),
        ("l_linestatus", "categorical", None), ("l_shipdate", "datetime", None)]))
def v_profile_fields(spark, sf):
    one = profile_fields(table(spark, sf, "labels")).select(F.lit("labels").alias("source"), "*")
    two = profile_fields(table(spark, sf, "lineitem"), {"l_linenumber": {"type": "categorical"}})
    return one.unionByName(two.select(F.lit("lineitem").alias("source"), "*"))


@query("v_validate_types", """
    SELECT 'value' AS field, 'invalid values' AS problem, count(*) AS n FROM events WHERE value > 150 HAVING count(*) > 0
    UNION ALL SELECT 'props', 'unexpected column', 1 UNION ALL SELECT 'session', 'missing column', 1""")
def v_validate_types(spark, sf):
    e = table(spark, sf, "events").withColumn("value", F.when(F.col("value") > 150, "bad").otherwise(F.col("value").cast("string")))
    spec = TableSpec([
        FieldSpec("event_id", "id", "integer"), FieldSpec("ts", "datetime"), FieldSpec("user_id", "numerical", "integer"),
        FieldSpec("event_type", "categorical"), FieldSpec("value", "numerical", "float"), FieldSpec("session", "id", "string"),
    ])
    return validate_table(e, spec)


@query("v_pk_duplicates", """
    SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2
    HAVING count(*) > 1 OR l_orderkey IS NULL OR l_linenumber IS NULL""")
def v_pk_duplicates(spark, sf):
    return duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("v_fk_orphans", """
    SELECT o_custkey, count(*) AS n FROM orders
    WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal >= 0) GROUP BY 1""")
def v_fk_orphans(spark, sf):
    return orphan_keys(table(spark, sf, "orders"), table(spark, sf, "customer").filter("c_acctbal >= 0"), "o_custkey", "c_custkey")


@query("v_constraint_audit", f"""
    WITH lo AS (SELECT *, l_extendedprice * (1 - l_discount) + CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END AS net FROM {LO_SQL}),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {RK_SQL}) AS k FROM lo)
    SELECT 'ship after order' AS name, count(*) FILTER (NOT coalesce(l_shipdate >= o_orderdate, true)) AS invalid FROM lo
    UNION ALL SELECT 'discount', count(*) FILTER (NOT (l_discount >= 0.02 AND l_discount <= 0.08)) FROM lo
    UNION ALL SELECT 'price digits', count(*) FILTER (NOT abs(o_totalprice - round_even(o_totalprice * 10, 0) / 10) <= 0.01) FROM lo
    UNION ALL SELECT 'net price', count(*) FILTER (net <> l_extendedprice * (1 - l_discount)) FROM lo
    UNION ALL SELECT 'one per line', count(*) FILTER (k > 1) FROM firsts
    UNION ALL SELECT 'flags', count(*) FILTER (NOT EXISTS (SELECT 1 FROM lo b WHERE b.o_orderstatus = 'P'
        AND b.l_returnflag = lo.l_returnflag AND b.l_quantity = lo.l_quantity)) FROM lo""")
def v_constraint_audit(spark, sf):
    lo = lineitem_orders(spark, sf)
    lo = lo.withColumn("net", F.expr("l_extendedprice * (1 - l_discount) + if(l_tax > 0.07, 1, 0)"))
    return constraint_audit(lo, {
        "ship after order": GreaterThan("o_orderdate", "l_shipdate"),
        "discount": Between("l_discount", 0.02, 0.08),
        "price digits": Rounding("o_totalprice", 1),
        "net price": ColumnFormula("net", "l_extendedprice * (1 - l_discount)"),
        "one per line": Unique(["l_orderkey", "l_linenumber"], RK),
        "flags": UniqueCombinations(["l_returnflag", "l_quantity"]).fit(lo.filter("o_orderstatus = 'P'")),
    })
