"""Typed CSV scans by description, and the sink for generated rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..errors import MetadataError
from ..spec import DatasetSpec, FieldSpec, TableSpec
from .records import MISSING, read_texts

# fixed values: strptime directive, date pattern letters, and the text it matches
_DIRECTIVES = {
    "%Y": ("yyyy", r"\d{4}"),
    "%y": ("yy", r"\d{2}"),
    "%m": ("MM", r"\d{2}"),
    "%d": ("dd", r"\d{2}"),
    "%H": ("HH", r"\d{2}"),
    "%I": ("hh", r"\d{2}"),
    "%M": ("mm", r"\d{2}"),
    "%S": ("ss", r"\d{2}"),
    "%f": ("SSSSSS", r"\d{6}"),
    "%p": ("a", r"[AaPp][Mm]"),
    "%b": ("MMM", r"[A-Za-z]{3}"),
    "%B": ("MMMM", r"[A-Za-z]+"),
    "%j": ("DDD", r"\d{3}"),
}


def time_patterns(fmt: str) -> tuple[str, str]:
    """(date pattern, regular expression) of a strptime format."""
    pattern, regex = "", ""
    for piece in re.findall(r"%.|[^%]+", fmt):
        if piece in _DIRECTIVES:
            letters, text = _DIRECTIVES[piece]
            pattern, regex = pattern + letters, regex + text
        elif piece.startswith("%"):
            raise MetadataError(f"unsupported time directive {piece}")
        else:
            quoted = "".join(f"'{c}'" if c.isalpha() else c for c in piece)
            pattern, regex = pattern + quoted, regex + re.escape(piece)
    return pattern, regex


def _typed(field: FieldSpec) -> Column:
    raw = F.col(f"`{field.name}`")
    if field.type == "datetime":
        if field.format:
            # the format may match anywhere inside the text
            pattern, regex = time_patterns(field.format)
            found = F.regexp_extract(raw, regex, 0)
            return F.try_to_timestamp(found, F.lit(pattern)).cast("timestamp_ntz")
        return raw.try_cast("timestamp_ntz")
    if isinstance(field.spark_type, T.LongType):
        # "3.0" is how a whole number with missing neighbours is often written
        return F.coalesce(raw.try_cast("bigint"), raw.try_cast("double").try_cast("bigint"))
    return raw.try_cast(field.spark_type)


def read_table(spark: SparkSession, spec: TableSpec, root: str = "", multi_line: bool = True, missing: tuple[str, ...] = MISSING) -> DataFrame:
    """The table's CSV with the declared types; columns are found by the names in each file's header.

    Doubled quotes and quoted line breaks belong to the value, and files stay splittable all the same. Texts in ``missing`` are null in every
    column. ``multi_line=False`` spares the search for records where no value holds a line break; all files then need the same header.
    """
    path = f"{root.rstrip('/')}/{spec.path}" if root else spec.path
    names = spec.names()
    raw = read_texts(spark, path, names, missing) if multi_line else None
    if raw is None:
        plain = spark.read.option("header", True).option("enforceSchema", False).option("escape", '"').option("multiLine", multi_line).csv(path)
        lost = [n for n in names if n not in plain.columns]
        if lost:
            raise MetadataError(f"a file has no columns {lost}")
        raw = plain.select(*[F.when(~F.col(f"`{n}`").isin(*missing), F.col(f"`{n}`")).alias(n) for n in names])
    return raw.select(*[_typed(f).alias(f.name) for f in spec.fields])


def read_tables(spark: SparkSession, spec: DatasetSpec, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Lazy frames of the named tables, or of all tables in use."""
    for n in names or []:
        if n not in spec.tables:
            raise ValueError(f'no table "{n}" in the description')
    return {n: read_table(spark, spec.tables[n], spec.root) for n in names or spec.tables}


def write_rows(df: DataFrame, path: str, fmt: str = "csv", partition_by=None, mode: str = "errorifexists") -> None:
    """Write generated rows, one folder per value of ``partition_by`` if given."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt}")
