"""The stages of the pipeline: what goes, what stays, and that columns and special rows survive."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TEXT = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, TEXT, "en", "a", 1), (1, TEXT, "en", "a", 1), (2, TEXT + " more", "en", "a", 1), (None, TEXT, "en", None, 1), (3, None, None, None, None), (3, None, None, None, None),
    (4, "", "en", "b", 0), (5, "", "en", "b", 0), (1, "another text under the same id", "en", "a", 1), (6, "x " * 9000, "en", "b", 18000),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("clash") for c in ("score", "k", "row_mark", "id", "at")})


def test_one_of_each_group_stays(spark, docs, sf):
    got = pipeline.near_duplicates(spark, docs, sf)
    assert got.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter(
        {(1, TEXT): 1, (1, "another text under the same id"): 1, (3, None): 2, (4, ""): 1, (5, ""): 1, (6, "x " * 9000): 1}
    )
    assert pipeline.near_duplicates(spark, docs.limit(0), sf).count() == 0


def test_leaking_rows_go(spark, docs, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    leak = docs.limit(1).withColumn("text", F.lit(f"before it {item} after it"))
    got = pipeline.benchmark_leaks(spark, docs.unionByName(leak), sf)
    assert sorted(map(str, got.collect())) == sorted(map(str, docs.collect())) and got.columns == docs.columns


def test_mixing_repeats_and_keeps(spark, docs, sf):
    got = pipeline.mix_sources(spark, docs, sf)
    assert got.columns == docs.columns
    count, before = Counter(map(str, got.collect())), Counter(map(str, docs.collect()))
    assert set(count) == set(before) and all(before[k] <= n <= 2 * before[k] for k, n in count.items())
    assert pipeline.mix_sources(spark, docs.limit(0), sf).count() == 0


def test_shards_hold_every_row(spark, docs, sf):
    got = pipeline.shard(spark, docs, sf)
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(r["doc_id"] for r in docs.collect())
    assert pipeline.shard(spark, docs.limit(0), sf).count() == 0


def test_whole_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = pipeline.run(spark, sf)
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "benchmark_leaks", "mix_sources", "shard"]
    assert 0 < out.select("doc_id").distinct().count() <= docs.count() and out.filter("shard is null or slot is null").count() == 0
