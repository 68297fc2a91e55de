"""Descriptions of tables and datasets: fields, types, keys and how to read them."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field as dc_field
from pathlib import Path

from pyspark.sql import DataFrame, types as T

from .errors import MetadataError

# fixed values: declared (type, subtype) and the Spark type that holds it
SPARK_TYPES = {
    ("categorical", None): T.StringType(),
    ("boolean", None): T.BooleanType(),
    ("numerical", None): T.DoubleType(),
    ("numerical", "float"): T.DoubleType(),
    ("numerical", "integer"): T.LongType(),
    ("datetime", None): T.TimestampNTZType(),
    ("id", None): T.LongType(),
    ("id", "integer"): T.LongType(),
    ("id", "string"): T.StringType(),
}


@dataclass
class FieldSpec:
    name: str
    type: str
    subtype: str | None = None
    format: str | None = None
    regex: str | None = None
    ref: dict | None = None
    pii: bool = False
    pii_category: object = None
    pii_locales: object = None
    encoder: object = None

    @property
    def spark_type(self) -> T.DataType:
        try:
            return SPARK_TYPES[(self.type, self.subtype)]
        except KeyError:
            raise MetadataError(f'field "{self.name}" has the unknown type {self.type}/{self.subtype}') from None


def infer_field(name: str, dtype: T.DataType) -> FieldSpec:
    """Field description of a Spark column."""
    if isinstance(dtype, T.IntegralType):
        return FieldSpec(name, "numerical", "integer")
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return FieldSpec(name, "numerical", "float")
    if isinstance(dtype, T.StringType):
        return FieldSpec(name, "categorical")
    if isinstance(dtype, T.BooleanType):
        return FieldSpec(name, "boolean")
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return FieldSpec(name, "datetime")
    raise ValueError(f"column {name} has the unsupported type {dtype.simpleString()}")


@dataclass
class TableSpec:
    """What is known about one table. ``fields`` keeps the declared order."""

    fields: list[FieldSpec]
    name: str | None = None
    primary_key: str | list[str] | None = None
    constraints: list = dc_field(default_factory=list)
    path: str | None = None

    @classmethod
    def infer(cls, df: DataFrame, field_names=None, field_types=None, anonymize=None, encoders=None, **other) -> TableSpec:
        """Read the fields off a DataFrame; ``field_types`` overrides single fields.

        A list of ``field_names`` fixes the order, a set follows the order of the data.
        """
        if not field_names:
            names = df.columns
        elif isinstance(field_names, (set, frozenset)):
            names = [c for c in df.columns if c in field_names]
        else:
            names = list(field_names)
        fields = []
        for name in names:
            if name not in df.columns:
                raise ValueError(f"the data has no field {name}")
            given = (field_types or {}).get(name)
            spec = FieldSpec(name, **given) if given else infer_field(name, df.schema[name].dataType)
            if (anonymize or {}).get(name):
                spec.pii, spec.pii_category = True, anonymize[name]
            spec.encoder = (encoders or {}).get(name, spec.encoder)
            fields.append(spec)
        return cls(fields=fields, **other).checked_key()

    def __getitem__(self, name: str) -> FieldSpec:
        for f in self.fields:
            if f.name == name:
                return f
        raise KeyError(name)

    def __contains__(self, name: str) -> bool:
        return any(f.name == name for f in self.fields)

    def names(self, ids: bool = True) -> list[str]:
        return [f.name for f in self.fields if ids or f.type != "id"]

    def key_fields(self) -> list[str]:
        key = self.primary_key
        return [] if key is None else [key] if isinstance(key, str) else list(key)

    def checked_key(self) -> TableSpec:
        """Turn the declared primary key into ``id`` fields, or say why it cannot be one."""
        for name in self.key_fields():
            if name not in self:
                raise ValueError(f'key field "{name}" is not part of the table')
            spec = self[name]
            if spec.type == "id":
                continue
            if spec.type == "categorical":
                subtype = "string"
            elif spec.type == "numerical":
                subtype = spec.subtype
            else:
                raise ValueError(f'a {spec.type} field cannot be a key')
            if subtype not in ("integer", "string"):
                raise ValueError(f'a key must be an integer or a string, not {subtype}')
            spec.type, spec.subtype = "id", subtype
        return self

    def to_dict(self) -> dict:
        fields = {}
        for f in self.fields:
            entry = {k: v for k, v in asdict(f).items() if v not in (None, False) and k not in ("name", "encoder")}
            fields[f.name] = entry
        constraints = [c.to_dict() for c in self.constraints]
        return {"name": self.name, "primary_key": self.primary_key, "path": self.path, "fields": fields, "constraints": constraints}

    @classmethod
    def from_dict(cls, data: dict, name: str | None = None) -> TableSpec:
        from .operators.constraints import Constraint

        known = set(FieldSpec.__dataclass_fields__)
        entries = data["fields"]
        if isinstance(entries, list):
            entries = {e["name"]: {k: v for k, v in e.items() if k != "name"} for e in entries}
        fields = [FieldSpec(n, **{k: v for k, v in e.items() if k in known}) for n, e in entries.items()]
        constraints = [Constraint.from_dict(c) for c in data.get("constraints") or []]
        return cls(fields, data.get("name") or name, data.get("primary_key"), constraints, data.get("path"))

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2)

    @classmethod
    def from_json(cls, text: str) -> TableSpec:
        return cls.from_dict(json.loads(text))


@dataclass
class DatasetSpec:
    """Several tables with foreign keys; tables marked ``use: false`` are left out."""

    tables: dict[str, TableSpec]
    root: str = ""

    @classmethod
    def from_dict(cls, data: dict, root: str = "") -> DatasetSpec:
        entries = data.get("tables")
        if not entries:
            raise MetadataError('the description lists no tables')
        if isinstance(entries, list):
            entries = {e["name"]: e for e in entries}
        used = {n: e for n, e in entries.items() if e.get("use", True)}
        return cls({n: TableSpec.from_dict(e, n) for n, e in used.items()}, root)

    @classmethod
    def from_json_file(cls, path: str) -> DatasetSpec:
        return cls.from_dict(json.loads(Path(path).read_text()), str(Path(path).parent))

    def edges(self) -> list[tuple[str, str, str, str]]:
        """(child table, child field, parent table, parent field) of every reference."""
        return [
            (name, f.name, f.ref["table"], f.ref["field"])
            for name, table in self.tables.items()
            for f in table.fields
            if f.ref
        ]

    def children(self, table: str) -> set[str]:
        return {c for c, _, p, _ in self.edges() if p == table}

    def problems(self) -> list[str]:
        """Everything wrong with the description itself, before any data is read."""
        found = []
        for name, table in self.tables.items():
            for f in table.fields:
                try:
                    f.spark_type
                except MetadataError as e:
                    found.append(str(e))
                if f.type == "id" and f.name not in table.key_fields() and not f.ref:
                    found.append(f'id field "{f.name}" of table "{name}" is neither a primary key nor a reference')
            for key in table.key_fields():
                if key not in table:
                    found.append(f'table "{name}" has no field "{key}" for its primary key')
                elif table[key].type != "id":
                    found.append(f'primary key "{key}" of table "{name}" is not an id field')
        for child, field, parent, parent_field in self.edges():
            if parent not in self.tables:
                found.append(f'Table "{parent}" referenced by "{child}.{field}" does not exist')
                continue
            target = self.tables[parent]
            if parent_field not in target.key_fields():
                found.append(f'"{parent}.{parent_field}" referenced by "{child}.{field}" is not a primary key')
            elif (target[parent_field].subtype or "integer") != (self.tables[child][field].subtype or "integer"):
                found.append(f'"{child}.{field}" and "{parent}.{parent_field}" have different subtypes')
        for name in self.tables:
            if self._reaches(name, name):
                found.append(f'table "{name}" refers back to itself')
        return found

    def _reaches(self, start: str, goal: str) -> bool:
        seen, todo = set(), list(self.children(start))
        while todo:
            table = todo.pop()
            if table == goal:
                return True
            if table not in seen:
                seen.add(table)
                todo.extend(self.children(table))
        return False


def project(df: DataFrame, spec: TableSpec, ids: bool = False) -> DataFrame:
    """The declared fields in declared order, without id fields unless asked for."""
    missing = [n for n in spec.names() if n not in df.columns]
    if missing:
        raise ValueError(f"the data has no field {missing[0]}")
    return df.select(*[f"`{n}`" for n in spec.names(ids)])
