"""CSV records in ranges, embedding files, saved profiles, and uniqueness over rounds."""

import csv
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.errors import MetadataError
from rowloom.operators.constraints import Between, Unique
from rowloom.operators.encoders import Encoder, Numeric
from rowloom.operators.rejection import sample_conditional, sample_valid
from rowloom.sources import profiles, read_embeddings, read_table, write_rows
from rowloom.sources.records import read_records
from rowloom.spec import FieldSpec, TableSpec

SPEC = [FieldSpec("id", "id", "integer"), FieldSpec("text", "categorical"), FieldSpec("x", "numerical", "float")]


def texts(n, seed=2):
    pick = random.Random(seed)
    parts = ['"', '""', "\n", "\r\n", ",", "word", "\\", " ", "\n\n", "'", "é", "NA "]
    return ["".join(pick.choice(parts) for _ in range(pick.randrange(1, 30))) for _ in range(n)]


@pytest.fixture
def small_ranges(spark):
    """Files are cut into ranges of a few hundred bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "300")
    spark.conf.set(names[1], "1")
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def test_records_across_ranges(spark, tmp_path, small_ranges):
    """Values full of quotes and line breaks, one of them longer than many ranges, files with other column orders and line ends."""
    values = texts(150)
    values[70] = "long \n \" line,\n" * 200
    with open(tmp_path / "a.csv", "w", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(["id", "text", "x"])
        out.writerows([i, v, i / 2] for i, v in enumerate(values[:100]))
    with open(tmp_path / "b.csv", "w", newline="") as f:
        out = csv.writer(f, lineterminator="\r\n", quoting=csv.QUOTE_ALL)
        out.writerow(["x", "other", "text", "id"])
        out.writerows([i / 2, "o\no", v, i] for i, v in enumerate(values) if i >= 100)
    got = {r["id"]: (r["text"], r["x"]) for r in read_table(spark, TableSpec(SPEC, path=str(tmp_path / "*.csv"))).collect()}
    assert got == {i: (v, i / 2) for i, v in enumerate(values)}
    lines = spark.read.text(str(tmp_path / "a.csv"))
    assert lines.select(F.col("_metadata.file_block_start")).distinct().count() > 20


def test_a_record_of_one_line_per_range(spark, tmp_path, small_ranges):
    (tmp_path / "c.csv").write_text("id,text,x\n" + "".join(f"{i},plain{i},{i}\n" for i in range(400)) + "\n\n400,last,400")
    got = read_table(spark, TableSpec(SPEC, path=str(tmp_path / "c.csv")))
    assert sorted((r["id"], r["text"]) for r in got.collect()) == [(i, f"plain{i}" if i < 400 else "last") for i in range(401)]


def test_missing_marks_and_columns(spark, tmp_path):
    (tmp_path / "d.csv").write_text('﻿id,text,x\n1,NA,n/a\n2,"NA",""\n3,,NaN\n4,nothing,1.5\n5,null,2\n')
    spec = TableSpec(SPEC, path=str(tmp_path / "d.csv"))
    assert sorted(tuple(r) for r in read_table(spark, spec).collect()) == [(1, None, None), (2, None, None), (3, None, None), (4, "nothing", 1.5), (5, None, 2.0)]
    kept = {r["id"]: r["text"] for r in read_table(spark, spec, missing=("",)).collect()}
    assert kept == {1: "NA", 2: "NA", 3: None, 4: "nothing", 5: "null"}
    with pytest.raises(MetadataError, match="no columns"):
        read_table(spark, TableSpec([*SPEC, FieldSpec("gone", "categorical")], path=str(tmp_path / "d.csv")))
    assert read_records(spark, str(tmp_path / "d.csv")).count() == 6


def test_written_rows_come_back(spark, tmp_path, small_ranges):
    values = [f" {v} " for v in texts(60, 9)] + ["  lead", "trail  ", '"', "\n"]
    df = spark.createDataFrame(list(enumerate(values)), "id long, text string").withColumn("x", F.col("id") * 1.0)
    write_rows(df.repartition(3), str(tmp_path / "w"))
    got = {r["id"]: r["text"] for r in read_table(spark, TableSpec(SPEC, path=str(tmp_path / "w")), missing=()).collect()}
    assert got == dict(enumerate(values))


def test_embedding_files(spark, tmp_path):
    vectors = np.random.default_rng(1).normal(size=(50, 7)).astype(np.float32)
    keys = [f"http://x/{i}" for i in range(50)]
    (tmp_path / "v.txt").write_text("50 7\n" + "".join(f"{k} {' '.join(map(repr, map(float, v)))}\n" for k, v in zip(keys, vectors)))
    with open(tmp_path / "v.bin", "wb") as f:
        f.write(b"50 7\n")
        for k, v in zip(keys, vectors):
            f.write(k.encode() + b" " + v.tobytes() + b"\n")
    for name, fmt in (("v.txt", "text"), ("v.bin", "binary")):
        got = {r["key"]: r["embedding"] for r in read_embeddings(spark, str(tmp_path / name), 7, fmt=fmt).collect()}
        assert set(got) == set(keys) and all(np.allclose(got[k], v) for k, v in zip(keys, vectors))
        with pytest.raises(ValueError, match="width"):
            read_embeddings(spark, str(tmp_path / name), 8, fmt=fmt)
    (tmp_path / "bad.txt").write_text("a 1 2 x\nb 1 2 3\n")
    with pytest.raises(ValueError, match="1 embeddings"):
        read_embeddings(spark, str(tmp_path / "bad.txt"), 3, fmt="text")
    with pytest.raises(ValueError, match="unknown form"):
        read_embeddings(spark, str(tmp_path / "bad.txt"), 3, fmt="other")


class Doubled(Encoder):
    """Kept by its name."""


def test_a_killed_save_leaves_the_old_profile(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "p")
    with pytest.raises(FileNotFoundError):
        profiles.load(spark, path)
    for n in range(4):
        profiles.save(spark, path, {"n": n, "rows": spark.range(n + 1)})
    assert profiles.load(spark, path)["n"] == 3 and profiles.load(spark, path)["rows"].count() == 4
    assert len(list((tmp_path / "p" / "versions").iterdir())) == 2  # older ones are gone

    def killed(*args):
        raise KeyboardInterrupt

    monkeypatch.setattr(profiles, "_commit", killed)
    with pytest.raises(KeyboardInterrupt):
        profiles.save(spark, path, {"n": 9, "rows": spark.range(99)})
    monkeypatch.undo()
    assert profiles.load(spark, path)["n"] == 3
    profiles.save(spark, path, {"n": 10, "rows": spark.range(2)})
    assert profiles.load(spark, path)["n"] == 10


def test_damaged_tables_are_noticed(spark, tmp_path):
    path = str(tmp_path / "p")
    profiles.save(spark, path, {"rows": spark.range(10)})
    table = next((tmp_path / "p" / "versions").glob("*/t0"))
    spark.range(11).write.mode("overwrite").parquet(str(table))
    with pytest.raises(ValueError, match="not what was saved"):
        profiles.load(spark, path)
    assert profiles.load(spark, path, verify=False)["rows"].count() == 11


def test_encoders_are_saved_by_name():
    fitted = Numeric(rounding=2)
    fitted.mean, fitted.low = 1.5, None
    plain = profiles.to_plain({"kind": Numeric, "own": fitted}, {})
    back = profiles.from_plain(plain, {})
    assert back["kind"] is Numeric and vars(back["own"]) == vars(fitted) and isinstance(back["own"], Numeric)

    class Local(Encoder):
        pass

    with pytest.raises(ValueError, match="define it in a module"):
        profiles.to_plain(Local, {})


def source(ids):
    return ids.withColumns({"key": F.pmod(F.xxhash64("cand_id"), F.lit(3000)), "v": F.pmod(F.xxhash64("cand_id", F.lit(1)), F.lit(100))})


def test_rounds_judge_their_own_rows(spark, monkeypatch):
    """What is written grows with the rows accepted, not with rounds times rows, and a key accepted once stays."""
    from rowloom.operators import rejection

    written = []
    plain = rejection.materialize

    def counted(df, tag="table"):
        out = plain(df, tag)
        if tag == "round":
            written.append(out.count())
        return out

    monkeypatch.setattr(rejection, "materialize", counted)
    rules = [Between("v", 0, 30, handling="reject_sampling"), Unique("key", "cand_id")]
    got = sample_valid(spark, source, rules, 2000, max_rows_multiplier=2).collect()
    assert len(got) == 2000 and len({r["key"] for r in got}) == 2000 and all(0 <= r["v"] <= 30 for r in got)
    assert len(written) > 2 and sum(written) < 3000
    # the first candidate of each key that holds
    tried = spark.range(max(r["cand_id"] for r in got) + 1).withColumnRenamed("id", "cand_id")
    first = {}
    for r in source(tried).filter("v <= 30").orderBy("cand_id").collect():
        first.setdefault(r["key"], r["cand_id"])
    assert {r["key"]: r["cand_id"] for r in got} == dict(sorted(first.items(), key=lambda kv: kv[1])[:2000])


def test_rounds_end_with_their_candidates(spark):
    """More rows are asked for than there are keys: all candidates are judged, and no round comes after them."""
    rules = [Between("v", 0, 30, handling="reject_sampling"), Unique("key", "cand_id")]
    tried = []

    def counted(ids):
        tried.append(ids.count())
        return source(ids)

    with pytest.warns(UserWarning, match="missing after 80000 candidates"):
        got = sample_valid(spark, counted, rules, 4000, graceful=True, max_candidates=80_000).collect()
    first = {}
    for r in source(spark.range(80_000).withColumnRenamed("id", "cand_id")).filter("v <= 30").orderBy("cand_id").collect():
        first.setdefault(r["key"], r["cand_id"])
    assert sum(tried) == 80_000 and {r["key"]: r["cand_id"] for r in got} == first
    with pytest.raises(ValueError, match="candidates"):
        sample_valid(spark, source, rules, 4000, max_candidates=80_000)


def test_unique_conditional_rows(spark):
    asked = spark.range(300).select(F.col("id").alias("cond_id"), (F.col("id") % 2).alias("kind"))

    def make(tries):
        return tries.withColumns({"kind": F.col("_want_kind"), "key": F.pmod(F.xxhash64("cond_id", "attempt"), F.lit(400))})

    got = sample_conditional(asked, make, [Unique("key", "cond_id")]).collect()
    assert len(got) == 300 and len({(r["kind"], r["key"]) for r in got}) == 300
