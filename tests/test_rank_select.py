"""Real rows by rank, ordinals of triples, and joint counts through distinct combinations."""

import random
from collections import Counter, defaultdict

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from rowloom.operators import frequency, sampling
from rowloom.operators.frequency import joint_counts, pair_names, triple_ordinals
from rowloom.operators.sampling import sample_rows

COLUMNS = ["x", "y", "z"]


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows share one triple; nulls are categories of their own."""
    pick = random.Random(5)
    data = [(i * 7 % 10_007, "hot" if i % 3 == 0 else pick.choice(["a", "b", None]), "u" if i % 3 == 0 else pick.choice(["u", "v"]), i % 3 and i % 11, None if i % 50 == 0 else i % 3 > 0) for i in range(6000)]
    return data, spark.createDataFrame(data, "id long, label string, x string, y int, z boolean")


def text(v):
    return None if v is None else str(v).lower() if isinstance(v, bool) else str(v)


def triples(data):
    groups = defaultdict(list)
    for i, label, *values in sorted(data):
        by = dict(zip(COLUMNS, values))
        for a, b in pair_names(COLUMNS):
            groups[f"{a}|{b}", label, text(by[a]), text(by[b])].append(i)
    return groups


@pytest.mark.parametrize("bits", [20, 8])
def test_ordinals(rows, monkeypatch, bits):
    monkeypatch.setattr(frequency, "BLOCK_BITS", bits)
    data, df = rows
    got = {(r["pair"], r["label"], r["a"], r["b"], r["ordinal"]): r["id"] for r in triple_ordinals(df.repartition(5), "label", COLUMNS, ["id"]).collect()}
    want = {(*key, n): i for key, ids in triples(data).items() for n, i in enumerate(ids)}
    assert got == want


@pytest.mark.parametrize("bits", [20, 6])
def test_rows_by_rank(spark, rows, monkeypatch, bits):
    """Few bits: many blocks, and blocks that are copied for their draws."""
    monkeypatch.setattr(frequency, "BLOCK_BITS", bits)
    monkeypatch.setattr(sampling, "BLOCK_BITS", bits)
    data, df = rows
    groups = triples(data)
    keys = list(groups)
    draws = [(n, *keys[n % len(keys)]) for n in range(2000)] + [(5000 + n, "x|y", "hot", "u", "0") for n in range(2000)] + [(9999, "x|y", "nobody", "u", "0")]
    drawn = spark.createDataFrame(draws, "draw long, pair string, label string, a string, b string")
    got = sample_rows(df, "label", COLUMNS, ["id"], drawn, "draw", 3).collect()
    assert {r["draw"] for r in got} == {d[0] for d in draws[:-1]} and len(got) == 4000
    assert all(r["row_id"] in groups[r["pair"], r["label"], r["a"], r["b"]] for r in got)
    assert Counter((r["draw"], r["row_id"]) for r in got) == Counter(
        (r["draw"], r["row_id"]) for r in sample_rows(df.repartition(9), "label", COLUMNS, ["id"], drawn, "draw", 3).collect()
    )
    hot = Counter(r["row_id"] for r in got if r["draw"] >= 5000)
    assert len(hot) > 1000 and max(hot.values()) < 12


def test_rows_are_dealt_once(spark, rows):
    """No exchange carries a row per pair of columns: pairs are laid out after the last shuffle of rows."""
    _, df = rows
    text = plan_of(triple_ordinals(df, "label", COLUMNS, ["id"]))
    assert text.index("Generate inline") < text.index("Exchange")


def test_joint_counts_of_many_columns(spark):
    columns = [f"c{i}" for i in range(40)]
    df = spark.range(50_000).select(F.concat(F.lit("l"), F.col("id") % 2).alias("label"), *[((F.col("id") % 20) * (i + 3) % 7).alias(c) for i, c in enumerate(columns)])
    counts = joint_counts(df, "label", columns)
    plan = plan_of(counts)
    # rows are counted by whole combinations before any pair is laid out
    assert plan.index("Generate inline") < plan.rindex("HashAggregate(keys=[_label") and plan.count("Generate") == 1
    data = [tuple(r) for r in df.limit(0).union(df).collect()]
    want = Counter()
    for (label, *values), n in Counter(data).items():
        for i in range(40):
            for j in range(i + 1, 40):
                want[f"c{i}|c{j}", label, str(values[i]), str(values[j])] += n
    assert {(r["pair"], r["label"], r["a"], r["b"]): r["n"] for r in counts.collect()} == want


def test_tasks_number_bounded_ranges(spark, monkeypatch):
    """However few shuffle partitions there are, a task numbers one range of rows."""
    from rowloom.operators import ordinals

    monkeypatch.setattr(ordinals, "RANGE_ROWS", 500, raising=False)
    df = spark.range(10_000).selectExpr("id", "cast(id % 3 AS string) AS label", "cast(id % 4 AS string) AS a", "nullif(cast(id % 5 AS string), '0') AS b")
    got = frequency.triple_ordinals(df, "label", ["a", "b"], ["id"])
    tasks = got.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(t["count"] for t in tasks) == 10_000 and max(t["count"] for t in tasks) <= 1500
    seen, want = {}, []
    for i in range(10_000):
        triple = (str(i % 3), str(i % 4), str(i % 5) if i % 5 else None)
        want.append((i, *triple, seen.get(triple, 0)))
        seen[triple] = seen.get(triple, 0) + 1
    assert sorted((r["id"], r["label"], r["a"], r["b"], r["ordinal"]) for r in got.collect()) == want
