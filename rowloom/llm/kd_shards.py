"""Sharding by a k-d tree over document metadata.

Every node is split at a weighted median of its widest dimension, so that both sides get their share of the
bytes, until a leaf holds no more than the target. A median is found by refining a histogram: each round
groups the rows of all nodes of a level into equal bins, and keeps the bin in which the wanted sum lies. Ties
on the dimension (a hot source, a language) are split by a hash of the id. Only cuts, of which there
are fewer than leaves, reach the driver.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .common import number_within
from .registry import query, table

BINS = 1024
DIM_BITS, TIE_BITS = 20, 32
TOLERANCE = 0.0001


def text_number(col: Column) -> Column:
    """The first six bytes of a text as a number in the order of the bytes; null comes first."""
    lead = F.rpad(F.hex(F.substring(F.col(col) if isinstance(col, str) else col, 1, 6).cast("binary")), 12, "0")
    return F.coalesce(F.conv(F.substring(lead, 1, 12), 16, 10).cast("double"), F.lit(-1.0))


def small_table(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A short list as a table, spelled out inside the plan."""
    names = [part.split()[0] for part in schema.split(", ")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")))


def _assign(rows: DataFrame, levels: list[list[tuple]]) -> DataFrame:
    """The node of each row under the cuts found so far: a chain of joins with small tables."""
    out = rows.withColumn("node", F.lit(1).cast("bigint"))
    for cuts in levels:
        small = small_table(rows.sparkSession, cuts, "c_node bigint, c_dim int, c_cut bigint")
        out = out.join(F.broadcast(small), F.col("node") == F.col("c_node"), "left")
        right = (F.element_at("keys", F.col("c_dim") + 1) >= F.col("c_cut")).cast("bigint")
        out = out.withColumn("node", F.when(F.col("c_node").isNull(), F.col("node")).otherwise(F.col("node") * 2 + right))
        out = out.drop("c_node", "c_dim", "c_cut")
    return out


def _cuts(placed: DataFrame, wanted: dict[int, tuple[int, float]]) -> dict[int, int]:
    """For each node (dimension, bytes wanted on the left): the key at which to split."""
    spark = placed.sparkSession
    state = {n: (d, 0, 1 << (DIM_BITS + TIE_BITS), w) for n, (d, w) in wanted.items()}
    found: dict[int, int] = {}
    while state:
        rows = [(n, d, lo, max(1, width // BINS), w) for n, (d, lo, width, w) in state.items()]
        small = small_table(spark, rows, "s_node bigint, s_dim int, s_lo bigint, s_step bigint, s_want double")
        inside = placed.join(F.broadcast(small), F.col("node") == F.col("s_node")).withColumn("k", F.element_at("keys", F.col("s_dim") + 1) - F.col("s_lo"))
        inside = inside.filter((F.col("k") >= 0) & (F.col("k") < F.col("s_step") * BINS))
        bins = inside.groupBy("node", "s_step", "s_want", F.call_function("div", F.col("k"), F.col("s_step")).alias("bin")).agg(
            F.sum("size").cast("double").alias("b"), F.count(F.lit(1)).alias("n")
        )
        w = Window.partitionBy("node").orderBy("bin")
        cum = bins.withColumn("upto", F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        hit = cum.filter(F.col("upto") >= F.col("s_want")).groupBy("node").agg(F.min_by(F.struct("bin", "b", "n", "upto"), "bin").alias("x"))
        got = {r["node"]: r["x"] for r in hit.collect()}  # one row per node
        nxt = {}
        for n, (d, lo, width, want) in state.items():
            step = max(1, width // BINS)
            if n not in got:  # nothing left inside: everything lies before
                found[n] = lo + width
                continue
            x = got[n]
            at, before = lo + x["bin"] * step, want - (x["upto"] - x["b"])
            if step == 1 or x["n"] <= 1 or x["b"] <= TOLERANCE * wanted[n][1]:
                found[n] = at if before < x["b"] / 2 else at + step
            else:
                nxt[n] = (d, at, step, before)
        state = nxt
    return found


def kd_shards(docs: DataFrame, dims: dict[str, Column], size: Column, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot.

    ``dims`` are numeric expressions over the metadata (null counts as the smallest value), ``size`` the weight
    of a row. Either the number of shards or the bytes a leaf may hold is given. Sizes of the shards differ by
    no more than the rows next to a cut. Repeated rows have equal keys and may share a shard. Other columns are
    ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    names = list(dims)
    raw = docs.select(
        F.col(id_col).alias("id"), size.cast("bigint").alias("size"), F.crc32(text).alias("crc"),
        *[dims[n].cast("double").alias(f"d{i}") for i, n in enumerate(names)],
    )
    raw = materialize(raw, "metadata")
    span = raw.agg(F.sum("size"), *[f(f"d{i}") for i in range(len(names)) for f in (F.min, F.max)]).first()
    total = span[0] or 0
    parts = shards if shards else max(1, math.ceil(total / target_bytes))
    scaled = []
    for i in range(len(names)):
        low, high = span[1 + 2 * i], span[2 + 2 * i]
        low, wide = (low or 0.0), max((high or 0.0) - (low or 0.0), 1e-300)
        scaled.append(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.coalesce(F.col(f"d{i}"), F.lit(low)) - F.lit(low)) / F.lit(wide))))
    tie = F.shiftrightunsigned(F.xxhash64("id", "crc"), 64 - TIE_BITS)
    keys = F.array(*[F.shiftleft((s * F.lit(float((1 << DIM_BITS) - 1))).cast("bigint"), TIE_BITS) + tie for s in scaled])
    rows = raw.select("id", "size", "crc", keys.alias("keys"))

    share = {1: parts}  # leaves below each node that is still to be split
    levels: list[list[tuple]] = []
    while any(p > 1 for p in share.values()) and total:
        placed = _assign(rows, levels)
        stats = placed.groupBy("node").agg(F.sum("size").alias("b"), *[f(F.element_at("keys", i + 1)).alias(f"{n}{i}") for i in range(len(names)) for n, f in (("lo", F.min), ("hi", F.max))])
        wanted = {}
        for r in stats.collect():  # one row per node
            if share.get(r["node"], 1) > 1:
                wide = [(r[f"hi{i}"] >> TIE_BITS) - (r[f"lo{i}"] >> TIE_BITS) for i in range(len(names))]
                wanted[r["node"]] = (max(range(len(names)), key=lambda i: (wide[i], -i)), r["b"] * (share[r["node"]] // 2) / share[r["node"]])
        cuts = _cuts(placed, wanted)
        levels.append([(n, wanted[n][0], c) for n, c in sorted(cuts.items())])
        share = {m: p for n in cuts for m, p in ((2 * n, share[n] // 2), (2 * n + 1, share[n] - share[n] // 2))} | {n: p for n, p in share.items() if n not in cuts and p == 1}
    leaves = sorted(share, key=lambda n: [int(c) for c in bin(n)[3:]])
    small = small_table(rows.sparkSession, [(n, i) for i, n in enumerate(leaves)], "leaf bigint, shard int")
    placed = _assign(rows, levels).join(F.broadcast(small), F.col("node") == F.col("leaf")).select("id", "size", "crc", "shard")
    out = number_within(placed, "shard", ["id", "crc"], "slot")
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def document_dims() -> dict[str, Column]:
    """Length, language, source and id of a document."""
    return {"n_chars": F.log1p(F.greatest(F.col("n_chars"), F.lit(0))), "lang": text_number("lang"), "source": text_number("source"), "doc_id": F.col("doc_id")}


def text_size(col: str = "text") -> Column:
    """UTF-8 bytes of the text, none for null, plus one."""
    return F.coalesce(F.octet_length(F.col(col)), F.lit(0)) + F.lit(1)


@query("op7_kd_shards")
def op7_kd_shards(spark, sf):
    out = kd_shards(table(spark, sf, "documents"), document_dims(), text_size(), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
