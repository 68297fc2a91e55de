"""Label dictionaries (``label;iri`` lines) and embedding tables."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialize


def read_label_dict(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(label, iri). A label in several files keeps the entry of the last one; within a file
    the last line wins. A line without exactly two parts is an error."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = []
    for i, path in enumerate(paths):
        # position of a line: where its file split starts, then its place in the split
        place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("nth"))
        lines = spark.read.text(path).select("value", place.alias("_at"))
        files.append(lines.withColumn("_file", F.lit(i)))
    parts = reduce(DataFrame.unionByName, files).withColumn("_parts", F.split(F.trim("value"), ";"))
    # written first: the row positions decide between duplicates and must not change
    parts = materialize(parts, "dictionary")
    bad = parts.filter(F.size("_parts") != 2).count()
    if bad:
        raise ValueError(f"{bad} lines of the label dictionary do not have two parts")
    entries = parts.select(F.col("_parts")[0].alias("label"), F.col("_parts")[1].alias("iri"), "_file", "_at")
    return entries.groupBy("label").agg(F.max_by("iri", F.struct("_file", "_at")).alias("iri"))


def read_embeddings(spark: SparkSession, path, size: int, key: str = "key", embedding: str = "embedding", fmt: str = "parquet") -> DataFrame:
    """(key, embedding) of an embedding store; a vector of another width is an error.

    ``fmt`` is ``parquet`` (columns ``key`` and ``embedding``), or one of the two forms of word-vector files: ``text``, lines of a key and its
    numbers, read in ranges of any file, and ``binary``, where a file, read whole, is a part of the store. A leading line with the number
    of vectors and their width is optional in texts.
    """
    if fmt == "parquet":
        table = spark.read.parquet(path).select(F.col(key).alias("key"), F.col(embedding).alias("embedding"))
    elif fmt == "text":
        table = _text_vectors(spark, path, size)
    elif fmt == "binary":
        files = spark.read.format("binaryFile").load(path).select("content")
        table = files.mapInArrow(_binary_vectors, "key string, embedding array<float>")
    else:
        raise ValueError(f"unknown form {fmt} of embeddings")
    wrong = embedding_widths(table).filter(F.col("width") != size).agg(F.sum("n")).first()[0]
    if wrong:
        raise ValueError(f"{wrong} embeddings do not have the width {size}")
    return table


def _text_vectors(spark: SparkSession, path, size: int) -> DataFrame:
    parts = spark.read.text(path).select(F.split(F.trim("value"), "[ \t]+").alias("p")).filter("p[0] <> ''")
    header = (F.size("p") == 2) & F.col("p")[0].rlike("^[0-9]+$") & (F.col("p")[1] == str(size))
    numbers = F.transform(F.slice("p", F.lit(2), F.size("p") - 1), lambda x: x.try_cast("float"))
    vectors = parts.filter(~header).select(F.col("p")[0].alias("key"), numbers.alias("embedding"))
    # a value that is no number leaves a vector too short
    return vectors.select("key", F.filter("embedding", lambda x: x.isNotNull()).alias("embedding"))


def _binary_vectors(batches):
    """Word-vector files: a line with the number of vectors and their width, then for each a key, a space and its 32-bit numbers."""
    for batch in batches:
        for content in batch.column("content"):
            data = content.as_buffer().to_pybytes()
            at = data.index(b"\n") + 1
            count, width = (int(x) for x in data[:at].split())
            keys, rows = [], []
            for _ in range(count):
                end = data.index(b" ", at)
                keys.append(data[at:end].lstrip(b"\n").decode())
                rows.append(np.frombuffer(data, "<f4", width, end + 1))
                at = end + 1 + 4 * width
            flat = np.concatenate(rows) if rows else np.empty(0, np.float32)
            offsets = pa.array(np.arange(len(rows) + 1) * width, pa.int32())
            yield pa.record_batch([pa.array(keys, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.float32()))], names=["key", "embedding"])


def embedding_widths(table: DataFrame) -> DataFrame:
    """(width, n): how many vectors have which width; a null vector counts as -1."""
    width = F.coalesce(F.size("embedding"), F.lit(-1))
    return table.groupBy(width.alias("width")).agg(F.count(F.lit(1)).alias("n"))
