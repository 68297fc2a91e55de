"""Exact deduplication by sorting content.

Texts are range-partitioned by their first characters and a hash, sorted outside memory so that equal texts
lie next to each other, and compared in full with their neighbours; the smallest id of a run stays. Only
short keys are sampled for the splitters, never whole texts. A text that holds a large share of all rows
is spread over salts: each salt keeps one representative, and the few representatives are compared again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from .common import SPACE
from .registry import query, table

HEAD = 32
HOT_SHARE = 0.001
SALTS = 64


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; all empty texts are one group. Runs of white space count as one space.
    Null ids sort last. Of repeated rows with the smallest id exactly one is kept. Other columns
    are ignored. An empty table gives an empty result.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " ").alias("norm")
    ).withColumn("h", F.xxhash64("norm"))
    counts = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts.filter("n > 1"), "copies")
    floor = int(docs.count() * HOT_SHARE)
    hot = counts.filter(F.col("n") > F.lit(max(floor, SALTS))).select(F.col("h").alias("hot_h"))  # at most 1 / HOT_SHARE rows

    keyed = rows.join(F.broadcast(hot), rows["h"] == F.col("hot_h"), "left").select(
        "id", "norm", "h", F.substring("norm", 1, HEAD).alias("head"),
        F.when(F.col("hot_h").isNotNull(), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).otherwise(F.lit(-1)).alias("salt"),
    )
    run = Window.partitionBy("head", "h", "salt", "norm")
    first = run.orderBy(F.col("id").asc_nulls_last())
    runs = keyed.repartitionByRange("head", "h", "salt").select(
        "id", "h", "salt", "norm", F.first("id").over(first).alias("keep_id"), F.row_number().over(first).alias("at"),
        F.count(F.lit(1)).over(run).alias("group_size"),
    )
    runs = materialize(
        runs.select(
            "id", "h", "salt", "keep_id", "at", "group_size", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"),
            F.when((F.col("salt") >= 0) & (F.col("at") == 1), F.col("norm")).alias("norm"),
        ),
        "runs",
    )
    plain = runs.filter("salt < 0").select("id", "keep_id", "group_size", (F.col("at") == 1).alias("kept"), "sha")

    whole = Window.partitionBy("h", "norm")
    heads = runs.filter("salt >= 0 and at = 1").select(  # one row per hot text and salt
        F.col("sha").alias("m_sha"), F.col("salt").alias("m_salt"),
        F.first("keep_id").over(whole.orderBy(F.col("keep_id").asc_nulls_last(), "salt")).alias("m_keep"),
        F.row_number().over(whole.orderBy(F.col("keep_id").asc_nulls_last(), "salt")).alias("m_at"),
        F.sum("group_size").over(whole).alias("m_size"),
    )
    salted = runs.filter("salt >= 0").join(F.broadcast(heads), (F.col("sha") == F.col("m_sha")) & (F.col("salt") == F.col("m_salt")))
    salted = salted.select("id", F.col("m_keep").alias("keep_id"), F.col("m_size").alias("group_size"), ((F.col("at") == 1) & (F.col("m_at") == 1)).alias("kept"), "sha")
    return plain.unionByName(salted).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


@query(
    "op5_exact_dedup",
    r"""
    SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
        row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
    FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
    """,
)
def op5_exact_dedup(spark, sf):
    return content_sort(table(spark, sf, "documents"))
