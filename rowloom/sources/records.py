"""CSV records whose quoted values hold line breaks, read from splittable files.

A line break ends a record only where the number of quotes before it in the file is even. The first pass scans every file range by
itself and reports its quote parity and its last record start for both possible parities at its beginning; the ranges of a file are then
put in order, which tells each range how it begins. The second pass joins lines into records inside every range, and only the pieces of
records that cross a range border, two per range at most, are brought together.
"""

from __future__ import annotations

import csv
import io

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..errors import MetadataError
from ..operators.joins import lookup
from ..session import fits_broadcast, materialize

# fixed values: texts that common table readers take for a missing value
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)
_FACTS = "file string, block bigint, line bigint, odd int, even_start bigint, odd_start bigint"
_PIECES = "file string, block bigint, nth bigint, part bigint, whole boolean, record string"
MOST_HEADERS = 1000


def _lines(spark: SparkSession, path) -> DataFrame:
    """The lines between ``\\n`` with their file and the start of their range."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _scan(batches):
    """For each batch: itself, the lines' numbers in their range, and whether the quotes before a line in its range are odd."""
    last, number, parity = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks = batch.column("file").to_numpy(zero_copy_only=False), batch.column("block").to_numpy()
        quotes = pc.count_substring(batch.column("value"), '"').to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.ones(len(blocks), bool)
        new[1:] = (blocks[1:] != blocks[:-1]) | (files[1:] != files[:-1])
        new[0] = (files[0], blocks[0]) != last
        begins = np.flatnonzero(new)
        before = np.cumsum(quotes) - quotes
        rows = np.arange(len(blocks))
        # what a range brings along from the batch before
        carried_number, carried_parity = np.full(len(blocks), number), np.full(len(blocks), parity)
        if len(begins):
            at = begins[np.maximum(np.searchsorted(begins, rows, side="right") - 1, 0)]
            mine = rows >= begins[0]
            carried_number = np.where(mine, -at, number)
            carried_parity = np.where(mine, -before[at], parity)
        nth, odd = rows + carried_number, (before + carried_parity) % 2
        last = (files[-1], blocks[-1])
        number, parity = int(nth[-1]) + 1, int(odd[-1] + quotes[-1]) % 2
        yield batch, nth, odd, (odd + quotes) % 2


def _range_facts(batches):
    """One row per range and batch: its parity so far and the last line before which the quotes are even, or odd."""
    for batch, nth, odd, after in _scan(batches):
        found: dict[tuple, list] = {}
        for file, block, n, o, a in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), nth.tolist(), odd.tolist(), after.tolist()):
            facts = found.setdefault((file, block), [n, 0, None, None])
            facts[0], facts[1], facts[2 + o] = n, a, n
        yield pa.record_batch([
            pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int64()),
            # the parity of the range is the one after its last line, so it is reported with that line's number
            pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.int32()),
            pa.array([v[2] for v in found.values()], pa.int64()), pa.array([v[3] for v in found.values()], pa.int64()),
        ], names=["file", "block", "line", "odd", "even_start", "odd_start"])


def file_ranges(lines: DataFrame) -> DataFrame:
    """(file, block, begins, open_block, open_nth): quote parity at the start of each range and the record that is open there."""
    facts = lines.mapInArrow(_range_facts, _FACTS)
    facts = facts.groupBy("file", "block").agg(F.max_by("odd", "line").alias("odd"), F.max("even_start").alias("even_start"), F.max("odd_start").alias("odd_start"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = facts.withColumn("begins", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).cast("int"))
    start = F.when(F.col("begins") == 0, F.col("even_start")).otherwise(F.col("odd_start"))
    ranges = ranges.withColumn("_last", F.when(start.isNotNull(), F.struct("block", start.alias("nth"))))
    ranges = ranges.withColumn("_open", F.last("_last", ignorenulls=True).over(before))
    return ranges.select("file", "block", "begins", F.col("_open.block").alias("open_block"), F.col("_open.nth").alias("open_nth"))


def _joined(batches):
    """Records in the order of their first lines. A record that begins and surely ends in a range is whole; other pieces name its first line."""
    held = None  # [file, range, first line's range, its number, lines]

    def piece(whole: bool) -> tuple:
        return held[0], held[2], held[3], held[1], whole, "\n".join(held[4])

    for batch, nth, odd, _ in _scan(batches):
        out = []
        begins = batch.column("begins").to_numpy(zero_copy_only=False)
        starts = ((odd + begins) % 2 == 0).tolist()
        columns = [batch.column(c).to_pylist() for c in ("file", "block", "value", "open_block", "open_nth")]
        for file, block, value, open_block, open_nth, n, start in zip(*columns, nth.tolist(), starts):
            if held and (held[0], held[1]) != (file, block):  # the record may go on in the next range
                out.append(piece(False))
                held = None
            if not start and held:
                held[4].append(value)
                continue
            if held:
                out.append(piece(held[1] == held[2]))
            held = [file, block, block, n, [value]] if start else [file, block, open_block, open_nth, [value]]
        yield _pieces(out)
    if held:
        yield _pieces([piece(False)])


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
    parts = list(zip(*rows)) or [()] * len(kinds)
    return pa.record_batch([pa.array(p, k) for p, k in zip(parts, kinds)], names=["file", "block", "nth", "part", "whole", "record"])


def read_records(spark: SparkSession, path) -> DataFrame | None:
    """(file, block, nth, record): the records of CSV files and where they begin; None if the ranges of the files are too many to hand out.

    Joined records are written, so that both passes see the same ranges. A record is held by one task; other than that nothing grows with a file.
    """
    lines = _lines(spark, path)
    ranges = materialize(file_ranges(lines), "file-ranges")
    if not fits_broadcast(ranges):
        return None
    known = lines.join(F.broadcast(ranges), ["file", "block"])  # the lines keep their order
    pieces = materialize(known.mapInArrow(_joined, _PIECES), "records")
    whole = pieces.filter("whole").select("file", "block", "nth", "record")
    broken = pieces.filter("not whole").groupBy("file", "block", "nth").agg(F.sort_array(F.collect_list(F.struct("part", "record"))).alias("parts"))
    broken = broken.select("file", "block", "nth", F.array_join(F.col("parts.record"), "\n").alias("record"))
    out = whole.unionByName(broken)
    return out.withColumn("record", F.when(F.col("record").endswith("\r"), F.expr("left(record, length(record) - 1)")).otherwise(F.col("record")))


def read_texts(spark: SparkSession, path, columns: list[str], missing: tuple[str, ...] = MISSING) -> DataFrame | None:
    """The named columns of CSV files as text, found by each file's own header; None if ``read_records`` gives none.

    Files may order their columns differently and hold others besides. Values in ``missing``, quoted or not, are null.
    """
    records = read_records(spark, path)
    if records is None:
        return None
    first = (F.col("block") == 0) & (F.col("nth") == 0)
    headers = materialize(records.filter(first).select("file", F.ltrim(F.col("record"), F.lit("\ufeff")).alias("header")), "headers")
    kinds = [r["header"] for r in headers.select("header").distinct().limit(MOST_HEADERS + 1).collect()]
    if len(kinds) > MOST_HEADERS:
        raise MetadataError(f"the files have more than {MOST_HEADERS} different headers")
    names = {h: next(csv.reader(io.StringIO(h)), []) for h in kinds}
    for found in names.values():
        lost = [c for c in columns if c not in found]
        if lost:
            raise MetadataError(f"a file has no columns {lost}")
    width = max((len(n) for n in names.values()), default=len(columns))
    rows = records.filter(~first & (F.col("record") != ""))
    if len(kinds) > 1:
        rows = lookup(rows, headers, ["file"], "inner", salt_by=["block", "nth"])
    options = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"}
    values = F.from_csv("record", ", ".join(f"_c{i} string" for i in range(width)), options)
    rows = rows.withColumn("values", values)

    def value(name: str) -> Column:
        places = {h: F.col(f"values._c{n.index(name)}") for h, n in names.items()}
        found = next(iter(places.values()), F.lit(None)) if len(places) < 2 else F.coalesce(*[F.when(F.col("header") == h, v) for h, v in places.items()])
        return F.when(~found.isin(*missing), found).cast("string").alias(name)

    return rows.select(*[value(c) for c in columns])
