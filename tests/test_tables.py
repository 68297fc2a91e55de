"""Specs, sources, validation, anonymisation and ids."""

import datetime as dt
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F, types as T

from rowloom import Between, DatasetSpec, FieldSpec, MetadataError, TableSpec, project
from rowloom.operators.anonymize import (
    anon_map, anonymize, anonymize_stateless, fresh_pii, learn_maps, make_ids, make_ids_unique, new_salt,
)
from rowloom.operators.generate import ids_only
from rowloom.operators.validate import (
    check_primary_key, discrete_columns, duplicate_keys, orphan_keys, orphan_rows, profile_fields, validate_dataset, validate_table,
)
from rowloom.session import scratch_path
from rowloom.sources import read_embeddings, read_label_dict, read_table, read_tables, write_rows
from rowloom.sources.tables import time_patterns


@pytest.fixture
def people(spark):
    data = [(1, "Ann", 1.5, True, dt.datetime(2024, 1, 2)), (2, "Bob", None, False, None)]
    return spark.createDataFrame(data, "id int, name string, x double, ok boolean, at timestamp_ntz")


def test_infer(people):
    spec = TableSpec.infer(people, field_types={"x": {"type": "numerical", "subtype": "integer"}}, anonymize={"name": "name"}, primary_key="id")
    assert [(f.name, f.type, f.subtype) for f in spec.fields] == [
        ("id", "id", "integer"), ("name", "categorical", None), ("x", "numerical", "integer"), ("ok", "boolean", None), ("at", "datetime", None)]
    assert spec["name"].pii and spec["name"].pii_category == "name"
    assert project(people, spec).columns == ["name", "x", "ok", "at"]
    assert TableSpec.infer(people, {"x", "id"}).names() == ["id", "x"]
    assert TableSpec.infer(people, ["x", "id"]).names() == ["x", "id"]
    with pytest.raises(ValueError, match="no field"):
        TableSpec.infer(people, ["nope"])
    with pytest.raises(ValueError, match="unsupported type"):
        TableSpec.infer(people.withColumn("a", F.array("x")))
    with pytest.raises(ValueError, match="not part"):
        TableSpec.infer(people, primary_key="nope")
    with pytest.raises(ValueError, match="must be an integer"):
        TableSpec.infer(people, primary_key="x")
    with pytest.raises(ValueError, match="cannot be a key"):
        TableSpec.infer(people, primary_key="ok")


def test_json_round_trip(people):
    spec = TableSpec.infer(people, primary_key="id", constraints=[Between("x", 0, 2)])
    again = TableSpec.from_json(spec.to_json())
    assert again.to_dict() == spec.to_dict() and again.constraints[0].high == 2
    with pytest.raises(MetadataError):
        FieldSpec("a", "numerical", "complex").spark_type


def dataset():
    return {"tables": {
        "u": {"path": "u.csv", "primary_key": "id", "fields": {"id": {"type": "id", "subtype": "integer"}, "age": {"type": "numerical", "subtype": "integer"}}},
        "s": {"path": "s.csv", "primary_key": "sid", "fields": {
            "sid": {"type": "id", "subtype": "string"}, "uid": {"type": "id", "subtype": "integer", "ref": {"table": "u", "field": "id"}},
            "at": {"type": "datetime", "format": "%d/%m/%Y"}}},
        "old": {"use": False, "fields": {}},
    }}


def test_dataset_spec_and_csv(spark, tmp_path):
    (tmp_path / "u.csv").write_text("id,age\n1,3.0\n2,\n")
    (tmp_path / "s.csv").write_text("sid,uid,at\n007,1,on 05/02/2024 noon\n008,2,never\n")
    (tmp_path / "m.json").write_text(json.dumps(dataset()))
    spec = DatasetSpec.from_json_file(str(tmp_path / "m.json"))
    tables = read_tables(spark, spec)
    assert set(tables) == {"u", "s"}
    assert rows(tables["u"]) == [(1, 3), (2, None)]
    assert rows(tables["s"]) == [("007", 1, dt.datetime(2024, 2, 5)), ("008", 2, None)]
    assert tables["u"].schema["age"].dataType == T.LongType()
    with pytest.raises(ValueError):
        read_tables(spark, spec, ["old"])
    assert spec.edges() == [("s", "uid", "u", "id")] and spec.children("u") == {"s"}
    validate_dataset(spec, tables)
    with pytest.raises(MetadataError, match="no data given"):
        validate_dataset(spec, {"u": tables["u"]})


def test_dataset_problems():
    bad = dataset()
    bad["tables"]["u"]["fields"]["back"] = {"type": "id", "subtype": "string", "ref": {"table": "s", "field": "sid"}}
    bad["tables"]["u"]["fields"]["loose"] = {"type": "id", "subtype": "integer"}
    bad["tables"]["s"]["primary_key"] = "none"
    text = " ".join(DatasetSpec.from_dict(bad).problems())
    for part in ("refers back to itself", "loose", "for its primary key", "is not a primary key"):
        assert part in text
    with pytest.raises(MetadataError):
        DatasetSpec.from_dict({})


def test_time_patterns():
    assert time_patterns("%Y-%m-%dT%H:%M") == ("yyyy-MM-dd'T'HH:mm", r"\d{4}\-\d{2}\-\d{2}T\d{2}:\d{2}")
    with pytest.raises(MetadataError):
        time_patterns("%Q")


def test_write_and_read_back(spark, people, tmp_path):
    write_rows(people, str(tmp_path / "out"), "csv", "ok")
    spec = TableSpec([FieldSpec("id", "id"), FieldSpec("name", "categorical"), FieldSpec("x", "numerical"), FieldSpec("at", "datetime")],
                     path=str(tmp_path / "out" / "ok=true"))
    assert rows(read_table(spark, spec)) == [(1, "Ann", 1.5, dt.datetime(2024, 1, 2))]
    write_rows(people, str(tmp_path / "p"), "parquet")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    with pytest.raises(ValueError):
        write_rows(people, str(tmp_path / "q"), "xml")


def test_label_dictionary(spark, tmp_path):
    (tmp_path / "a").write_text("Ménière;http://x/1\nflu;http://x/2\nflu;http://x/3\n", encoding="utf8")
    (tmp_path / "b").write_text("Ménière;http://x/9\n", encoding="utf8")
    got = read_label_dict(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert rows(got) == [("Ménière", "http://x/9"), ("flu", "http://x/3")]
    (tmp_path / "c").write_text("a;b;c\n")
    with pytest.raises(ValueError, match="two parts"):
        read_label_dict(spark, str(tmp_path / "c"))


def test_embedding_width(spark):
    path = scratch_path(spark, "emb")
    spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0])], "key string, embedding array<float>").write.parquet(path)
    with pytest.raises(ValueError, match="width"):
        read_embeddings(spark, path, 2)


def test_profile_fields(spark):
    df = spark.createDataFrame([(0, 1.0, "a", True, 5), (1, 0.0, "b", None, 1)], "b int, f double, s string, t boolean, n int")
    got = {r["field"]: (r["type"], r["discrete"]) for r in profile_fields(df).collect()}
    assert got == {"b": ("numerical", True), "f": ("numerical", True), "s": ("categorical", True), "t": ("boolean", True), "n": ("numerical", False)}
    ones = spark.createDataFrame([(1,), (1,)], "b int")
    assert discrete_columns(ones) == []  # 1 alone is not a yes/no column
    with pytest.raises(ValueError, match="no such columns"):
        discrete_columns(df, ["nope"])


def test_validate_table(spark, people):
    spec = TableSpec([FieldSpec("id", "id"), FieldSpec("name", "numerical", "integer"), FieldSpec("x", "numerical"), FieldSpec("gone", "boolean")])
    got = {(r["field"], r["problem"]): r["n"] for r in validate_table(people, spec).collect()}
    assert got == {("name", "invalid values"): 2, ("ok", "unexpected column"): 1, ("at", "unexpected column"): 1, ("gone", "missing column"): 1}


def test_keys(spark):
    parent = spark.createDataFrame([(1,), (2,)], "pk long")
    child = spark.createDataFrame([(1, 1), (2, 9), (3, 9), (4, None)], "cid int, fk int")
    assert rows(orphan_keys(child, parent, "fk", "pk")) == [(9, 2)]
    assert rows(orphan_rows(child, parent, "fk", "pk").select("cid")) == [(2,), (3,)]
    assert rows(duplicate_keys(child, "fk")) == [(9, 2), (None, 1)]
    spec = TableSpec([FieldSpec("cid", "id")], primary_key="cid")
    assert check_primary_key(child, spec).count() == 0


def test_anonymise(spark, people):
    spec = TableSpec.infer(people, anonymize={"name": "first_name"})
    maps = learn_maps(people.filter("id = 1"), spec, "salt")
    got = rows(anonymize(people, maps), "id")
    assert got[0][1] is not None and got[1][1] is None and anonymize(people, maps).columns == people.columns
    assert rows(anonymize_stateless(people, "name", "first_name", "salt"), "id")[0][1] == got[0][1]
    assert anon_map(people, "name", "name", new_salt()).count() == 2
    one = rows(fresh_pii(people, spec, 1, "id").select("id", "name"), "id")
    assert one == rows(fresh_pii(people.repartition(3), spec, 1, "id").select("id", "name"), "id")


def test_ids(spark):
    df = spark.range(120).select((F.col("id") * 37 % 120).alias("k"), (F.col("id") % 5).alias("dup")).repartition(6)
    made = rows(make_ids(df, FieldSpec("i", "id"), "k").select("k", "i"), "k")
    assert made == [(i, i) for i in range(120)]
    text = rows(make_ids(df, FieldSpec("i", "id", "string", regex="[ab]{7}"), "k").select("k", "i"), "k")
    assert len({t for _, t in text}) == 120 and text[0][1] == "aaaaaaa" and text[1][1] == "aaaaaab"
    with pytest.raises(ValueError, match="too few for 120"):
        make_ids(df, FieldSpec("i", "id", "string", regex=r"\d{2}"), "k")
    spec = TableSpec([FieldSpec("k", "id"), FieldSpec("dup", "id")])
    fixed = make_ids_unique(df, spec, "k")
    assert rows(fixed, "k") == [(i, i) for i in range(120)]
    assert ids_only(spark, spec, 9).count() == 9
