"""Time the headline queries: prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local threads, and
``BENCH_REPEAT`` how often a query runs after its warm-up; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import DataFrame, SparkSession

import catalog
from catalog.base import lineitem_orders
from catalog.encodings import MIX
from catalog.frequencies import COLUMNS, LABEL
from rowloom.operators.generate import fit_model, generate

HEADLINE = [
    "f_joint_freq", "f_triple_ordinals", "f_draw_category", "f_sample_rows", "v_constraint_audit", "c_filter_chain",
    "c_transform_chain", "c_unique_filter", "e_encode_row", "e_mixture_fit", "e_mixture_transform", "l_embedding_join",
    "g_knn_labels", "g_topup", "g_conditional", "p_private_freq",
]


def consume(df: DataFrame) -> None:
    """Compute every column of every row without collecting them."""
    df.write.format("noop").mode("overwrite").save()


def generate_millions(spark: SparkSession, sf: str, n: int = 10_000_000) -> DataFrame:
    """Ten million rows from a model of the whole tables."""
    model = fit_model(lineitem_orders(spark, sf), LABEL, COLUMNS, ["l_extendedprice"], {"l_extendedprice": MIX})
    return generate(model, spark.range(n).withColumnRenamed("id", "cand_id"), ["cand_id"], 7)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    named = {n: catalog.QUERIES[n] for n in sys.argv[1:] or HEADLINE}
    if not sys.argv[1:]:
        named["g_generate_10m"] = generate_millions
    times = {}
    for name, run in named.items():
        consume(run(spark, sf))
        taken = []
        for _ in range(repeat):
            start = time.perf_counter()
            consume(run(spark, sf))
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
    print(json.dumps({"metric": "total headline time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
