"""The corpus pipeline: toxicity, near duplicates, benchmark passages, mixing, sharding.

Every stage reads what its predecessor kept and works on all of it. All stages but the last return the columns of documents;
columns beyond doc_id and text are optional for the first three stages and are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowloom.llm.kd_shards import kd_shards, text_number, text_size
from rowloom.llm.latent_leaks import find_leaks
from rowloom.llm.mixing import repeat_rows
from rowloom.llm.ngram_join import ngram_join
from rowloom.llm.toxicity import THRESHOLD, fit_toxicity, labelled_rows, score_toxicity
from rowloom.operators.joins import lookup
from rowloom.session import materialize

SHARDS = 16
MIX_LOW, MIX_HIGH, MIX_BUDGET = 1, 2, 1.25  # every document stays once; sources are repeated up to twice


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not use."""
    while name in docs.columns:
        name = "_" + name
    return name


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold by a classifier learned from the labelled ones among them.

    Without labels of both kinds nothing can be learned and all documents stay. Null and empty texts stay. Repeated rows are judged alike.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    names, weights = fit_toxicity(labelled_rows(docs, labels))
    if not names:
        return docs
    score = _free(docs, "score")
    return score_toxicity(docs, (names, weights), name=score).filter(F.col(score) < THRESHOLD).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity of 0.8 or more): the one with the smallest doc_id.

    Texts without words are no duplicates of anything and stay. Of repeated rows of the document that stays, one stays; documents whose id is null
    stay only if their text belongs to no other id. Rows that go are found by (doc_id, text), so an id used for two texts is no reason to drop either.
    """
    row = F.xxhash64("doc_id", "text")
    named = docs.select(F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), row.alias("h")).alias("mark"), "text")
    found = materialize(ngram_join(named, "mark", "text", n=5, num=80, den=100), "duplicates").filter("n_shingles > 0")
    # rows to drop, and rows of which one of several equal ones stays
    drop = materialize(found.filter("mark.h <> component_id.h").select("mark.h").distinct(), "dropped")
    again = found.groupBy("mark.h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    again = materialize(again.join(drop, "h", "left_anti"), "repeated")
    key = _free(docs, "k")
    keyed = docs.withColumn(key, row)
    kept = lookup(keyed, drop.withColumnRenamed("h", key), [key], "left_anti", salt_by=["doc_id"])
    if again.limit(1).count():
        same = again.withColumnRenamed("h", key)
        one = lookup(kept, same, [key], "left_semi", salt_by=["doc_id"]).dropDuplicates([key])
        kept = lookup(kept, same, [key], "left_anti", salt_by=["doc_id"]).unionByName(one)
    return kept.drop(key).select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found. An id found to hold one goes with all its rows whose text is the same.

    Null and empty texts stay, and everything stays if there are no items.
    """
    key = _free(docs, "k")
    keyed = docs.withColumn(key, F.to_json(F.struct(F.col("doc_id"), F.xxhash64("text").alias("h"))))
    leaks = find_leaks(keyed.select(key, "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key)
    leaks = materialize(leaks.select(key).distinct(), "leaks")
    return lookup(keyed, leaks, [key], "left_anti", salt_by=["doc_id"]).drop(key).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated once or twice so that the words of the sources come to their targets; no document goes.

    Rows without words stay once. Null sources are a source of their own.
    """
    return repeat_rows(docs, budget=MIX_BUDGET, low=MIX_LOW, high=MIX_HIGH)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row: shards of nearly equal bytes."""
    dims = {"n_chars": F.log1p(F.greatest(F.col("n_chars"), F.lit(0))), "lang": text_number("lang"), "source": text_number("source"), "doc_id": F.col("doc_id")}
    return kd_shards(docs, dims, text_size(), shards=SHARDS)


STAGES = [
    ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("mix_sources", mix_sources), ("shard", shard),
]
# the classifier, the balancing and the tree are iterative: the stages are compared with brute-force versions in tests/llm
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
