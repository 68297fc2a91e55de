"""Helpers shared by the operators: words, folds, numbering, connected components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.joins import HOT_SHARE, lookup
from ..session import discard, fits_broadcast, materialize, written_bytes

BROADCAST_BYTES = 8 << 20  # many lookups belong to one job, so each of them may broadcast little
BROADCAST_FILES = 2 << 20  # of a written table, whose files are packed
FEW_ROWS = 10_000  # of one key, which a single task may meet

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(col, UPPER, LOWER)


def word_count(col: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("bigint")


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(parts)).cast("int")


def unit(*cols) -> Column:
    """A number in [0, 1) that depends on nothing but the given columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def number_within(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Number the rows 0, 1, 2 ... inside each value of ``key``.

    Rows are range-partitioned by key and order, so that a key with a third of the rows is spread over
    many tasks; each task numbers its own rows, and the row counts per (task, key), of which there are
    at most tasks + keys, give the offsets.
    """
    cols = [F.col(c) for c in [key, *order]]
    placed = df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed, "numbered").withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    counts = counts.select(F.col(key).alias("_key"), F.col("_part").alias("_p"), "_first", "_before")
    out = placed.join(F.broadcast(counts), placed[key].eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")))
    return out.withColumn(name, (F.col("_before") + F.col("_at") - F.col("_first")).cast("bigint")).drop(
        "_at", "_part", "_key", "_p", "_first", "_before"
    )


def light_lookup(rows: DataFrame, table: DataFrame, on: list[str], how: str = "left", salt_by: list[str] | None = None, fits: bool | None = None, counted: DataFrame | None = None) -> DataFrame:
    """``lookup`` for operators of many small jobs, each of which costs memory of the driver.

    A written table is measured by its files. Keys are salted, with two more broadcasts, only if one of them holds a large share of many rows;
    ``counted`` may name a table with the same keys as the rows that is read faster.
    """
    if fits is None:
        size = written_bytes(table)
        fits = fits_broadcast(table, BROADCAST_BYTES) if size is None else size <= BROADCAST_FILES
    if not fits:
        most = (rows if counted is None else counted).groupBy(*on).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("total")).first()
        if (most["most"] or 0) > max(FEW_ROWS, (most["total"] or 0) * HOT_SHARE):
            return lookup(rows, table, on, how, salt_by=salt_by, fits=False)
        names = {c: f"_key_{c}" for c in on}
        table = table.select(*on) if how in ("left_semi", "left_anti") else table
        renamed = table.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in table.columns])
        same = reduce(lambda x, y: x & y, [rows[c] == renamed[k] for c, k in names.items()])
        return rows.join(renamed, same, how).drop(*names.values())
    return lookup(rows, table, on, how, salt_by=salt_by, fits=True)


def _are_stars(ends: DataFrame) -> bool:
    """Whether each larger end has one edge and is no smaller end of another."""
    sides = ends.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    sides = sides.unionByName(ends.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return sides.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up > 0 and down > 0").isEmpty()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of the undirected edges (a, b): one row (node, root) per node, root the smallest.

    Alternating large and small stars: each round hangs every node's larger neighbours below its smallest
    one, then the smaller ones too, until every component is a star. Rounds are written tables, so no plan
    grows and a lost executor costs one round. A hub with very many edges is salted by ``lookup``.
    Null ends and loops are ignored.
    """
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u is not null and v is not null and u <> v")
    ends = materialize(ends.distinct(), "edges")
    while not _are_stars(ends):
        both = ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = light_lookup(both.filter("v > u"), least, ["u"], "inner", salt_by=["v"])
        large = materialize(large.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large")
        lower = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = light_lookup(large, lower, ["u"], "inner", salt_by=["v"])
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        stars = materialize(small.select("e.u", "e.v").filter("u <> v").distinct(), "stars")
        discard(least, large, lower, ends)  # finished rounds are read no more
        ends = stars
    return ends.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        ends.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
