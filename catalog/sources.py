"""Scans, sinks and saved profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.operators.frequency import joint_freq
from rowloom.session import scratch_path
from rowloom.sources import profiles, read_embeddings, read_label_dict, read_table, write_rows
from rowloom.sources.labels import embedding_widths
from rowloom.spec import FieldSpec, TableSpec

from .base import LO_SQL, lineitem_orders, query, table


@query("s_csv_typed", """
    SELECT lpad(o_orderkey::VARCHAR, 10, '0') AS id_text,
           CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS custkey,
           date_trunc('day', o_orderdate)::TIMESTAMP AS orderdate, o_totalprice AS price, o_orderpriority AS priority
    FROM orders""")
def s_csv_typed(spark, sf):
    path = scratch_path(spark, "csv")
    o = table(spark, sf, "orders")
    write_rows(o.select(
        F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("id_text"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("custkey"),
        F.concat(F.lit("on "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" (local)")).alias("orderdate"),
        F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"),
    ), path)
    spec = TableSpec([
        FieldSpec("id_text", "id", "string"), FieldSpec("custkey", "numerical", "integer"),
        FieldSpec("orderdate", "datetime", format="%Y-%m-%d"), FieldSpec("price", "numerical", "float"),
        FieldSpec("priority", "categorical"),
    ], primary_key="id_text", path=path)
    return read_table(spark, spec)


@query("s_csv_text", r"""
    SELECT doc_id::VARCHAR AS doc_id, nullif(CASE doc_id % 5 WHEN 0 THEN 'NA' ELSE lang END, 'NA') AS lang,
           CASE doc_id % 3 WHEN 0 THEN '"' || coalesce(text, '') || '"' || chr(10) || ',"",' || chr(10) || 'end' WHEN 1 THEN nullif(text, '') END AS text,
           n_chars::DOUBLE AS n_chars FROM documents""")
def s_csv_text(spark, sf):
    """Whole texts with quotes, commas, line breaks and missing-value marks, in files that order their columns differently."""
    path = scratch_path(spark, "csv-text")
    d = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.when(F.col("doc_id") % 5 == 0, "NA").otherwise(F.col("lang")).alias("lang"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('"'), F.coalesce("text", F.lit("")), F.lit('"\n,"",\nend'))).when(F.col("doc_id") % 3 == 1, F.col("text")).alias("text"),
        F.col("n_chars").cast("string").alias("n_chars"), F.lit("x\ny").alias("other"),
    )
    write_rows(d.filter("doc_id % 2 = 0"), f"{path}/even")
    write_rows(d.filter("doc_id % 2 = 1").select("n_chars", "text", "other", "lang", "doc_id"), f"{path}/odd")
    spec = TableSpec([
        FieldSpec("doc_id", "id", "string"), FieldSpec("lang", "categorical"), FieldSpec("text", "categorical"), FieldSpec("n_chars", "numerical", "float"),
    ], path=f"{path}/*")
    return read_table(spark, spec)


@query("s_label_dict", """
    SELECT c_name AS label, CASE WHEN c_mktsegment = 'BUILDING' THEN 'http://y/' ELSE 'http://x/' END || c_custkey AS iri
    FROM customer""")
def s_label_dict(spark, sf):
    c = table(spark, sf, "customer")
    return read_label_dict(spark, write_dictionary(spark, c))


def write_dictionary(spark, customers):
    """Two dictionary files; the second repeats the labels of one segment with another key."""
    first, second = scratch_path(spark, "dict"), scratch_path(spark, "dict")
    line = lambda base: F.concat(F.col("c_name"), F.lit(f";{base}"), F.col("c_custkey").cast("string")).alias("value")
    customers.select(line("http://x/")).write.text(first)
    customers.filter("c_mktsegment = 'BUILDING'").select(line("http://y/")).write.text(second)
    return [first, second]


@query("s_embeddings_width", "SELECT len(embedding)::INTEGER AS width, count(*) AS n FROM embeddings GROUP BY 1")
def s_embeddings_width(spark, sf):
    return embedding_widths(table(spark, sf, "embeddings"))


@query("s_embeddings_text", """
    SELECT 'v' || vec_id AS key, len(embedding)::INTEGER AS width, round(list_sum(list_transform(embedding, lambda x: x::FLOAT::DOUBLE)), 6) AS total,
           round(embedding[64]::FLOAT::DOUBLE, 6) AS last FROM embeddings""")
def s_embeddings_text(spark, sf):
    """All embeddings through a word-vector file, with its leading line."""
    path = scratch_path(spark, "vectors")
    e = table(spark, sf, "embeddings")
    line = F.concat(F.lit("v"), F.col("vec_id"), F.lit(" "), F.array_join(F.transform("embedding", lambda x: x.cast("string")), " "))
    e.select(line.alias("value")).write.text(f"{path}/vectors")
    e.agg(F.concat(F.count(F.lit(1)).cast("string"), F.lit(" 64")).alias("value")).write.text(f"{path}/head")
    back = read_embeddings(spark, [f"{path}/vectors", f"{path}/head"], 64, fmt="text")
    value = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return back.select("key", F.size("embedding").alias("width"), F.round(value, 6).alias("total"), F.round(F.col("embedding")[63].cast("double"), 6).alias("last"))


@query("s_roundtrip", "SELECT event_id, user_id, event_type, value FROM events")
def s_roundtrip(spark, sf):
    path = scratch_path(spark, "rows")
    write_rows(table(spark, sf, "events").select("event_id", "user_id", "value", "event_type"), path, "csv", "event_type")
    rows = spark.read.option("header", True).schema("event_id long, user_id long, value double, event_type string").csv(path)
    return rows.select("event_id", "user_id", "event_type", "value")


@query("s_profile_roundtrip", f"""
    SELECT 'o_orderpriority|l_returnflag' AS pair, o_orderstatus AS label, o_orderpriority AS a, l_returnflag AS b,
           count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS p
    FROM {LO_SQL} GROUP BY 2, 3, 4""")
def s_profile_roundtrip(spark, sf):
    path = scratch_path(spark, "profile")
    learned = joint_freq(lineitem_orders(spark, sf), "o_orderstatus", ["o_orderpriority", "l_returnflag"])
    profiles.save(spark, path, {"label": "o_orderstatus", "joint": learned})
    back = profiles.load(spark, path)["joint"]
    return back.select("pair", "label", "a", "b", "n", F.round("p", 6).alias("p"))
