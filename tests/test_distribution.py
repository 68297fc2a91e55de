"""Numbering, running sums, interval lookups, member draws and joins, also in their large-data paths."""

from collections import Counter

import pytest
from conftest import plan_of, rows
from pyspark.sql import Window, functions as F

from rowloom.functions.random import uniform
from rowloom.operators import joins, ordinals
from rowloom.operators.frequency import category_codes, group_ordinals, joint_counts, joint_freq, labels_by_appearance, triple_ordinals
from rowloom.operators.intervals import build_guide, cumulative, pick
from rowloom.operators.sampling import condition_vector, decode_label, draw_members, fixed_condition, with_pair


@pytest.fixture
def skewed(spark):
    """A third of the rows in one group, the rest in many small ones."""
    g = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 97).cast("string")))
    return spark.range(6000).withColumn("g", g).repartition(5)


def test_dense_index(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id")).repartition(7)
    got = rows(ordinals.dense_index(df, "k", "n").select("n", "k"), "n")
    assert [n for n, _ in got] == list(range(1000))
    assert [k for _, k in got] == sorted(k for _, k in got)


def test_cut_and_first_rows(spark):
    df = spark.range(100_000).filter(F.xxhash64("id") % 3 == 0)
    ids = [r[0] for r in rows(df, "id")]
    for n in (0, 1, 17, 5000, len(ids) - 1):
        assert [r[0] for r in rows(ordinals.first_rows(df, "id", n), "id")] == ids[:n]
    assert ordinals.cut_after(df, "id", len(ids)) is None
    assert ordinals.cut_after(df, "id", len(ids) + 5) is None


def test_running_sum_both_ways(spark, monkeypatch):
    df = spark.range(3000).select((F.col("id") % 2).alias("k"), "id", (F.col("id") % 7).alias("v")).repartition(5)
    small = rows(ordinals.running_sum(df, ["k"], ["id"], "v", "s"), "k", "id")
    monkeypatch.setattr(ordinals, "WINDOW_ROWS", 10)
    assert rows(ordinals.running_sum(df, ["k"], ["id"], "v", "s"), "k", "id") == small


def _weights(spark):
    data = [("p", f"v{i:04d}", 1) for i in range(600)] + [("p", "zz", 100_000)] + [("q", "a", 1), ("q", "b", 0), ("q", "c", 3)]
    return spark.createDataFrame(data, "k string, v string, n long")


@pytest.mark.parametrize("crowded", [2, 64, 10_000])
def test_pick_equals_interval_test(spark, crowded):
    bounds = cumulative(_weights(spark), ["k"], ["v"])
    guide = build_guide(bounds, ["k"], buckets=16, crowded=crowded)
    assert (guide.crowded is None) == (crowded == 10_000)
    edges = [r[0] for r in bounds.select("lo").collect()] + [0.999999, 1 - 2.0**-53, 2.0**-53]
    u = spark.createDataFrame([(i, x, "p" if i % 3 else "q") for i, x in enumerate(edges)], "id int, u double, k string")
    more = spark.range(20_000).select((F.col("id") + 1000).cast("int").alias("id"), uniform(1, "u", "id").alias("u"),
                                      F.when(F.col("id") % 2 == 0, "p").otherwise("q").alias("k"))
    draws = u.unionByName(more)
    got = pick(draws, guide, F.col("u"))
    assert got.count() == draws.count()
    table = [tuple(r) for r in bounds.select("k", "v", "lo", "hi").collect()]
    want = {(k, v): (lo, hi) for k, v, lo, hi in table}
    assert all(want[r["k"], r["v"]][0] <= r["u"] < want[r["k"], r["v"]][1] for r in got.collect())
    assert not got.filter("v = 'b'").count()


def test_fixed_key_prunes_the_guide(spark):
    guide = build_guide(cumulative(_weights(spark), ["k"], ["v"]), ["k"])
    got = pick(spark.range(2000), guide, uniform(1, "u", "id"), fixed={"k": "q"})
    counts = Counter(r["v"] for r in got.collect())
    assert set(counts) == {"a", "c"} and 350 < counts["a"] < 650


def test_cumulative_ends_at_one(spark):
    got = rows(cumulative(_weights(spark), ["k"], ["v"]).filter("k = 'q'").select("v", "lo", "hi"), "v")
    assert got == [("a", 0.0, 0.25), ("c", 0.25, 1.0)]


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_group_ordinals_do_not_depend_on_partitions(spark, skewed, parts):
    w = Window.partitionBy("g").orderBy("id")
    want = rows(skewed.select("g", "id", F.row_number().over(w) - 1))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = group_ordinals(skewed.repartition(parts), ["g"], ["id"])
        assert rows(got.select("g", "id", "ordinal")) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_members_are_uniform_and_match_their_group(spark, skewed):
    draws = spark.range(9000).select(F.col("id").alias("d"), F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 4 == 1, "g5").otherwise("none").alias("g"))
    got = draw_members(skewed, ["g"], ["id"], draws, ["d"], 3)
    assert got.count() == 6750  # draws of a group without rows are dropped
    assert got.join(skewed.select(F.col("id").alias("row_id"), F.col("g").alias("real")), "row_id").filter("real <> g").count() == 0
    hot = Counter(r["row_id"] for r in got.filter("g = 'hot'").collect())
    assert len(hot) > 1700 and max(hot.values()) < 14
    whole = draw_members(skewed, [], ["id"], spark.range(3000).withColumnRenamed("id", "d"), ["d"], 3)
    assert whole.count() == 3000 and whole.select("row_id").distinct().count() > 2200


def test_salted_lookup_equals_broadcast(spark, skewed, monkeypatch):
    table = skewed.select("g").distinct().withColumn("name", F.upper("g")).filter("g <> 'g7'")
    calm = {how: rows(joins.lookup(skewed, table, ["g"], how)) for how in ("left", "inner", "left_semi", "left_anti")}
    monkeypatch.setattr(joins, "fits_broadcast", lambda *a: False)
    for how, want in calm.items():
        got = joins.lookup(skewed, table, ["g"], how)
        assert rows(got) == want
    nulls = skewed.withColumn("g", F.when(F.col("g") != "hot", F.col("g")))
    known = table.unionByName(spark.createDataFrame([(None, "NULL")], "g string, name string"))
    got = joins.lookup(nulls, known, ["g"], "inner", null_safe=True)
    assert got.filter("name = 'NULL'").count() == 2000


def test_joint_frequency_against_counting(spark):
    data = [("x", "a", 1), ("x", "a", 1), ("x", None, 2), ("y", "b", 1)]
    df = spark.createDataFrame(data, "label string, s string, t int")
    got = {tuple(r)[:4]: r["n"] for r in joint_counts(df, "label", ["s", "t"]).collect()}
    assert got == {("s|t", "x", "a", "1"): 2, ("s|t", "x", None, "2"): 1, ("s|t", "y", "b", "1"): 1}
    assert sum(r["p"] for r in joint_freq(df, "label", ["s", "t"]).collect()) == pytest.approx(1)
    assert triple_ordinals(df.withColumn("id", F.monotonically_increasing_id()), "label", ["s", "t"], ["id"]).count() == 4


def test_pairs_are_equally_likely(spark):
    got = Counter(r["pair"] for r in with_pair(spark.range(6000), "id", ["a", "b", "c"], 1).collect())
    assert set(got) == {"a|b", "a|c", "b|c"} and all(1800 < n < 2200 for n in got.values())
    with pytest.raises(ValueError):
        with_pair(spark.range(1), "id", ["a"], 1)


def test_condition_vectors(spark):
    df = spark.createDataFrame([("x", "b", 1, "p"), ("y", "a", 2, "p")], "l string, s string, t int, w string")
    codes = category_codes(df, ["l", "s", "t", "w"])
    assert [(r["column"], r["value"]) for r in codes.orderBy("at").collect()] == [
        ("l", "x"), ("l", "y"), ("s", "a"), ("s", "b"), ("t", "1"), ("t", "2"), ("w", "p")]
    drawn = spark.createDataFrame([("s|w", "y", "b", "p")], "pair string, label string, a string, b string")
    got = condition_vector(drawn, "l", ["s", "t", "w"], codes).first()
    assert got["vector"] == [0, 1, 0, 1, 0, 0, 1] and got["mask"] == [1, 1, 0, 1]
    strange = spark.createDataFrame([("s|t", "z", None, "2")], "pair string, label string, a string, b string")
    got = condition_vector(strange, "l", ["s", "t", "w"], codes)
    assert got.first()["vector"] == [0, 0, 0, 0, 0, 1, 0] and decode_label(got, "vector", codes, "l", "found").first()["found"] is None
    codes = category_codes(df, ["l", "s", "t"])
    fixed = fixed_condition(spark.range(2), codes, "s", "a").first()["vector"]
    assert fixed == [0, 0, 1, 0, 0, 0]
    with pytest.raises(ValueError, match="not a discrete column"):
        fixed_condition(spark.range(2), codes, "z", "a")
    with pytest.raises(ValueError, match="not a category"):
        fixed_condition(spark.range(2), codes, "l", "q")


def test_labels_by_appearance(spark):
    df = spark.createDataFrame([(3, "a"), (1, "b"), (2, "a")], "k int, l string")
    assert rows(labels_by_appearance(df, "l", "k"), "first_at") == [("b", 1), ("a", 2)]


def test_no_python_and_no_nested_loops_in_draws(spark):
    guide = build_guide(cumulative(_weights(spark), ["k"], ["v"]), ["k"])
    text = plan_of(pick(spark.range(2000).withColumn("k", F.lit("p")), guide, uniform(1, "u", "id")))
    assert "NestedLoop" not in text and "Cartesian" not in text and "Python" not in text
    assert "BroadcastHashJoin" in text


def test_hot_keys_are_cut_before_the_shuffle(spark, skewed):
    from rowloom import Unique
    from rowloom.operators.privacy import cap_rows

    for df in (Unique("g", "id").filter_valid(skewed), cap_rows(skewed, "g", ["id"], 3)):
        text = plan_of(df)
        assert text.count("WindowGroupLimit") == 2 and "Partial" in text
    counted = plan_of(joint_counts(skewed.withColumns({"s": F.col("g"), "t": F.col("id") % 3}), "g", ["s", "t"]))
    assert "partial_count" in counted


def test_lost_partitions_give_the_same_rows(spark, skewed):
    """What a task computes again after a loss equals what it computed first, on any layout."""
    one = draw_members(skewed, ["g"], ["id"], skewed.select(F.col("id").alias("d"), "g"), ["d"], 5)
    two = draw_members(skewed.repartition(2, "id"), ["g"], ["id"], skewed.repartition(3).select(F.col("id").alias("d"), "g"), ["d"], 5)
    assert rows(one.select("d", "row_id"), "d") == rows(two.select("d", "row_id"), "d")
