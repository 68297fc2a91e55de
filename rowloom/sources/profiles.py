"""Saving and loading what was learned: parquet tables and a JSON manifest, no pickles.

A save writes its tables to a folder of their own and then, by one rename, the manifest that names them. Until that rename the
profile saved before stays the valid one, whatever happens to the save; the manifest also holds row counts and checksums.
"""

from __future__ import annotations

import datetime as dt
import importlib
import json
import re
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.encoders import Encoder


def dotted(kind: type) -> str:
    """Where a class is found again; one that was made inside a function is not."""
    if "<locals>" in kind.__qualname__:
        raise ValueError(f"{kind.__qualname__} cannot be saved; define it in a module")
    return f"{kind.__module__}:{kind.__qualname__}"


def _named(path: str):
    module, _, name = path.partition(":")
    found = importlib.import_module(module)
    for part in name.split("."):
        found = getattr(found, part)
    return found


def to_plain(value, tables: dict[str, DataFrame]):
    """JSON form of a learned value; DataFrames are put aside into ``tables``."""
    if isinstance(value, DataFrame):
        name = f"t{len(tables)}"
        tables[name] = value
        return {"$table": name}
    if isinstance(value, T.DataType):
        return {"$type": value.json()}
    if isinstance(value, dt.datetime):
        return {"$time": value.isoformat()}
    if isinstance(value, dt.date):
        return {"$date": value.isoformat()}
    if isinstance(value, np.ndarray):
        return {"$array": value.tolist()}
    if isinstance(value, type):
        return {"$class": dotted(value)}
    if isinstance(value, Encoder):
        return {"$encoder": dotted(type(value)), "state": to_plain(vars(value), tables)}
    if isinstance(value, dict):
        return {k: to_plain(v, tables) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [to_plain(v, tables) for v in value]
    if value is None or isinstance(value, (str, int, float, bool)):
        return value
    raise ValueError(f"{value!r} cannot be saved; name functions by their dotted path")


def from_plain(value, tables: dict[str, DataFrame]):
    if isinstance(value, list):
        return [from_plain(v, tables) for v in value]
    if not isinstance(value, dict):
        return value
    if "$table" in value:
        return tables[value["$table"]]
    if "$type" in value:
        return T._parse_datatype_json_string(value["$type"])
    if "$time" in value:
        return dt.datetime.fromisoformat(value["$time"])
    if "$date" in value:
        return dt.date.fromisoformat(value["$date"])
    if "$array" in value:
        return np.asarray(value["$array"])
    if "$class" in value:
        return _named(value["$class"])
    if "$encoder" in value:
        made = object.__new__(_named(value["$encoder"]))
        vars(made).update(from_plain(value["state"], tables))
        return made
    return {k: from_plain(v, tables) for k, v in value.items()}


def _files(spark: SparkSession, path: str):
    """The file system of ``path`` and its path class."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def _manifests(spark: SparkSession, path: str) -> list[str]:
    """Names of the complete manifests, oldest first."""
    files, make = _files(spark, path)
    if not files.exists(make(path)):
        return []
    names = [f.getPath().getName() for f in files.listStatus(make(path))]
    return sorted(n for n in names if re.fullmatch(r"manifest-\d{10}\.json", n))


def _checked(df: DataFrame) -> tuple[int, int]:
    """Row count and a checksum that does not depend on the order of rows."""
    mark = F.shiftright(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), 24) if df.columns else F.lit(0)
    row = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(mark), F.lit(0))).first()
    return int(row[0]), int(row[1])


def save(spark: SparkSession, path: str, content: dict, keep: int = 2) -> None:
    """Write ``content`` as the new version of the profile at ``path``; the ``keep`` latest versions stay."""
    tables: dict[str, DataFrame] = {}
    plain = to_plain(content, tables)
    folder, stored = f"versions/{uuid.uuid4().hex}", {}
    for name, df in tables.items():
        df.write.parquet(f"{path}/{folder}/{name}")
        rows, mark = _checked(spark.read.schema(df.schema).parquet(f"{path}/{folder}/{name}"))
        stored[name] = {"path": f"{folder}/{name}", "rows": rows, "checksum": mark, "schema": df.schema.jsonValue()}
    _commit(spark, path, json.dumps({"content": plain, "tables": stored, "folder": folder}))
    _prune(spark, path, keep)


def _commit(spark: SparkSession, path: str, text: str) -> None:
    files, make = _files(spark, path)
    files.mkdirs(make(path))
    draft = make(f"{path}/draft-{uuid.uuid4().hex}")
    out = files.create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    for _ in range(100):  # another save may take the next number at the same time
        last = _manifests(spark, path)
        number = int(last[-1][9:19]) + 1 if last else 0
        final = make(f"{path}/manifest-{number:010d}.json")
        if not files.exists(final) and files.rename(draft, final):
            return
    raise RuntimeError(f"the profile at {path} could not be saved: too many saves at once")


def _prune(spark: SparkSession, path: str, keep: int) -> None:
    """Delete the versions before the ``keep`` latest ones; folders of saves that did not finish are left to others."""
    files, make = _files(spark, path)
    for name in _manifests(spark, path)[:-keep]:
        folder = json.loads(_text(spark, f"{path}/{name}"))["folder"]
        files.delete(make(f"{path}/{name}"), False)
        files.delete(make(f"{path}/{folder}"), True)


def _text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def load(spark: SparkSession, path: str, verify: bool = True) -> dict:
    """The latest complete version. With ``verify`` every table is read once and compared with the manifest."""
    names = _manifests(spark, path)
    if not names:
        raise FileNotFoundError(f"there is no profile at {path}")
    stored = json.loads(_text(spark, f"{path}/{names[-1]}"))
    tables = {}
    for name, facts in stored["tables"].items():
        tables[name] = spark.read.schema(T.StructType.fromJson(facts["schema"])).parquet(f"{path}/{facts['path']}")
        if verify and _checked(tables[name]) != (facts["rows"], facts["checksum"]):
            raise ValueError(f"the table {name} of the profile at {path} is not what was saved")
    return from_plain(stored["content"], tables)
