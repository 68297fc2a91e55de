import pytest
from pyspark.sql import functions as F

from rowloom import Between, GreaterThan, UniqueCombinations
from rowloom.session import scratch_path
from rowloom.streaming import filter_valid_stream, flag_valid_stream


def test_row_local_checks_on_a_stream(spark):
    path = scratch_path(spark, "stream")
    spark.range(100).select("id", (F.col("id") / 100).alias("v")).write.parquet(path)
    stream = spark.readStream.schema("id long, v double").parquet(path)
    rules = [Between("v", 0.2, 0.5), GreaterThan(25, "id", scalar="low")]
    query = filter_valid_stream(stream, rules).writeStream.format("memory").queryName("kept").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["id"] for r in spark.table("kept").collect()) == list(range(25, 51))
    assert flag_valid_stream(stream, rules).isStreaming
    with pytest.raises(ValueError, match="stream"):
        filter_valid_stream(stream, [UniqueCombinations(["id", "v"])])
