"""Where intermediate tables live, and how their size is checked.

Everything the engine learns (frequency tables, combinations, mappings) and every
round of a resampling loop is written as parquet below the shared folder named by
``spark.checkpoint.dir``. That cuts the lineage, survives the loss of executors and
gives the optimizer real file sizes for its own broadcast decisions.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

BROADCAST_BYTES = 64 * 1024 * 1024
_RUN = uuid.uuid4().hex
_local_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors can reach."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_folder:
        _local_folder[app] = tempfile.mkdtemp(prefix="rowloom-")
    return _local_folder[app]


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/rowloom/{_RUN}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and return the written table."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that nothing will read again."""
    for df in tables:
        found = getattr(df, "_written_to", None)
        if found:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(found)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written_bytes(df: DataFrame) -> int | None:
    """Bytes of the files of a table that ``materialize`` wrote, without a job; null for any other."""
    found = getattr(df, "_written_to", None)
    if not found:
        return None
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(found)
    return path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables written by this process."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/rowloom/{_RUN}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _bytes(col: Column, dtype: T.DataType) -> Column:
    """Bytes of a value: exact for text and vectors, eight for other plain values."""
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0)) + 16
    if isinstance(dtype, T.ArrayType) and not isinstance(dtype.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
        return F.greatest(F.size(col), F.lit(0)) * 8 + 16
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(col))), F.lit(0)) + 16
    return F.lit(8)


def row_bytes(df: DataFrame) -> Column:
    """Bytes of each row of ``df``."""
    size = F.lit(16)
    for f in df.schema.fields:
        size = size + _bytes(F.col(f"`{f.name}`"), f.dataType)
    return size.cast("bigint")


def measure(df: DataFrame) -> tuple[int, int]:
    """Row count and bytes of ``df`` (one aggregation, no rows on the driver)."""
    row = df.select(row_bytes(df).alias("_bytes")).agg(F.count(F.lit(1)), F.coalesce(F.sum("_bytes"), F.lit(0))).first()
    return int(row[0]), int(row[1])


def fits_broadcast(df: DataFrame, limit: int | None = None) -> bool:
    """True when the measured size of ``df`` is below the broadcast bound."""
    return measure(df)[1] <= (BROADCAST_BYTES if limit is None else limit)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
