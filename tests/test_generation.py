"""Labels, column models, generation, rejection, privacy, and the whole flow."""

import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from conftest import plan_of, rows
from pyspark.sql import functions as F

from rowloom import (
    Between, ConstraintsNotMetError, FieldSpec, GreaterThan, Profile, Synthesizer, TableSpec, Unique, UniqueCombinations,
)
from rowloom.functions.random import normal, uniform
from rowloom.operators.copula import Copula, complete_conditions, copula_stats, root
from rowloom.operators.labels import label_fidelity, label_quota, label_to_iri, nearest_labels, normalise_key, with_embedding
from rowloom.operators.privacy import cap_rows, domain_cells, epsilon, private_freq, secret_seed
from rowloom.operators.rejection import (
    _attempts, filter_conditions, make_conditions, next_batch, repeat_fill, sample_conditional, sample_valid,
)
from rowloom.session import scratch_path


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    data = [(f"l{i:03d}", [float(x) for x in rng.normal(size=6)]) for i in range(60)]
    return spark.createDataFrame(data, "key string, embedding array<double>"), data


@pytest.mark.parametrize("block", [7, 4096])
def test_nearest_labels_are_exact(spark, vectors, block):
    df, data = vectors
    got = nearest_labels(df.filter("key < 'l010'"), df.filter("key >= 'l010'"), 4, block)
    unit = {k: np.array(v) / np.linalg.norm(v) for k, v in data}
    for key in ("l000", "l009"):
        want = sorted(((-float(unit[key] @ unit[o]), o) for o in unit if o >= "l010"))[:4]
        mine = got.filter(F.col("key") == key).orderBy("rank").collect()
        assert [r["neighbour"] for r in mine] == [o for _, o in want]
        assert [r["similarity"] for r in mine] == pytest.approx([-s for s, _ in want])
        assert sum(r["weight"] for r in mine) == pytest.approx(1)
    assert got.count() == 40


def test_embeddings_and_dictionary(spark, vectors):
    df, data = vectors
    asked = spark.createDataFrame([(1, "l001"), (2, "nope"), (3, None)], "id int, k string")
    got = rows(with_embedding(asked, df, "k", 6, on_missing="zeros").select("id", "embedding"), "id")
    assert got[0][1] == pytest.approx(data[1][1]) and got[1][1] == [0.0] * 6 and got[2][1] == [0.0] * 6
    with pytest.raises(Exception, match="no embedding for key nope"):
        with_embedding(asked.filter("id = 2"), df, "k", 6).collect()
    book = spark.createDataFrame([("l001", "http://x/1")], "label string, iri string")
    assert rows(label_to_iri(asked.select("id", F.col("k").alias("label")), book).select("id", "iri"), "id")[:2] == [(1, "http://x/1"), (2, None)]
    assert normalise_key(asked, "k", "l", "http://x/").filter("k = 'http://x/001'").count() == 1


def test_label_fidelity(spark):
    emb = spark.createDataFrame([("a", [0.0, 2.0]), ("b", [1.0, -1.0])], "key string, embedding array<double>")
    made = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "want string, got string")

    def bce(x, y):
        return np.mean([max(p, 0) - p * q + math.log(1 + math.exp(-abs(p))) for p, q in zip(x, y)])

    got = {r["requested"]: (r["rows"], r["loss"]) for r in label_fidelity(made, emb, "want", "got").collect()}
    assert got["a"][0] == 2 and got["a"][1] == pytest.approx(5 * (bce([0, 2], [0, 2]) + bce([1, -1], [0, 2])) / 2)
    assert got["b"] == (1, pytest.approx(5 * bce([1, -1], [1, -1])))


def test_label_quota(spark):
    table = spark.createDataFrame([("x", 0), ("y", 1), ("z", 2)], "label string, position long")
    got = Counter(r["label"] for r in label_quota(table, spark.range(100), "id").collect())
    assert sorted(got.values()) == [33, 33, 34]


# -- column model -------------------------------------------------------------------------
def test_copula(spark):
    df = spark.range(20_000).select(normal(1, "a", "id").alias("x"), F.col("id"))
    df = df.select("id", "x", (F.col("x") * 2 + normal(1, "b", "id") + 3).alias("y"), F.when(F.col("x") > 0, "p").otherwise("n").alias("s"))
    stats = {(r["a"], r["b"]): r for r in copula_stats(df, ["x", "y"]).collect()}
    assert stats["x", "y"]["corr"] == pytest.approx(2 / math.sqrt(5), abs=0.02)
    assert stats["y", "y"]["mean_a"] == pytest.approx(3, abs=0.05)
    model = Copula.fit(df, ["x", "y", "s"])
    given = df.select("id", F.lit(1.0).alias("x"))
    drawn = model.sample_given(given, ["x"], ["y", "s"], 5, ["id"])
    y = drawn.agg(F.avg("y"), F.stddev("y")).first()
    assert y[0] == pytest.approx(5, abs=0.15) and y[1] == pytest.approx(1, abs=0.1)
    assert drawn.filter("s = 'p'").count() > 15_000
    m = np.array([[4.0, 2.0], [2.0, 1.0]])  # singular
    assert root(m) @ root(m).T == pytest.approx(m)


def test_completed_conditions_hold(spark):
    pairs = spark.createDataFrame([("DE", "Bonn"), ("DE", "Ulm"), ("FR", "Lyon")] * 20, "country string, city string")
    rule = UniqueCombinations(["country", "city"], fit_columns_model=True).fit(pairs)
    asked = spark.createDataFrame([(i, "DE" if i % 3 else "FR", i * 1.0) for i in range(90)], "i int, country string, other double")
    got = rule.transform(asked)
    assert got.count() == 90 and set(got.columns) == {"i", "other", "country#city"}
    full = complete_conditions(asked, rule, seed=3, id_col="i")
    assert full.filter("country = 'FR' AND city <> 'Lyon'").count() == 0
    assert full.filter("city IN ('Bonn', 'Ulm')").count() == 60
    with pytest.raises(ValueError, match="no completion"):
        complete_conditions(spark.createDataFrame([("XX",)], "country string"), rule, rounds=2)


# -- rejection ----------------------------------------------------------------------------
def maker(ids):
    return ids.withColumns({"v": uniform(1, "v", "cand_id"), "k": F.floor(uniform(1, "k", "cand_id") * 500)})


def test_next_batch():
    assert next_batch(100, 50, 100) == int(50 / (51 / 101))
    assert next_batch(100, 0, 100) == 1000


def test_first_valid_candidates_in_order(spark):
    rule = Between("v", 0.3, 0.4, handling="reject_sampling")
    got = sample_valid(spark, maker, [rule], 2000)
    every = maker(spark.range(200_000).withColumnRenamed("id", "cand_id")).filter("v BETWEEN 0.3 AND 0.4")
    assert rows(got, "cand_id") == [tuple(r) for r in every.orderBy("cand_id").limit(2000).collect()]
    assert sample_valid(spark, maker, [], 0).count() == 0
    never = [Between("v", 2, 3, handling="reject_sampling")]
    with pytest.raises(ValueError, match="10 rows of 10"):
        sample_valid(spark, maker, never, 10, max_retries=2)
    with pytest.warns(UserWarning, match="still missing"):
        assert sample_valid(spark, maker, never, 10, max_retries=2, graceful=True).count() == 0


def test_equal_conditions_are_numbered_in_many_tasks(spark):
    same = spark.range(20_000).select(F.when(F.col("id") % 5 < 3, "hot").otherwise("cold").alias("c"))
    got = make_conditions(spark, same)
    assert got.agg(F.min("cond_id"), F.max("cond_id"), F.countDistinct("cond_id")).first() == (0, 19_999, 20_000)
    assert got.filter("c = 'hot'").agg(F.min("cond_id")).first()[0] == 8_000
    most = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 12_000


def test_unique_over_all_rounds(spark):
    got = sample_valid(spark, maker, [Unique("k", "cand_id")], 400)
    assert got.count() == 400 and got.select("k").distinct().count() == 400
    with pytest.warns(UserWarning):
        short = sample_valid(spark, maker, [Unique("k", "cand_id")], 600, max_retries=3, graceful=True)
    assert 450 < short.count() <= 500 and short.select("k").distinct().count() == short.count()


def test_repeat_fill(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k int, v string")
    assert [r[2] for r in rows(repeat_fill(df, "k", 8), "fill_id")] == list("abcabcab")
    with pytest.raises(ValueError):
        repeat_fill(df.filter("k > 9"), "k", 3)


def test_filter_conditions(spark):
    df = spark.createDataFrame([(1, 10.05, "a"), (2, 10.2, "a"), (3, -10.05, "a"), (4, 0.0, "a"), (5, 9.95, "b")], "id int, x double, s string")
    assert rows(filter_conditions(df, {"x": 10.0, "s": "a"})) == [(1, 10.0, "a")]
    assert rows(filter_conditions(df, {"x": -10.0})) == [(3, -10.0, "a")]
    assert filter_conditions(df, {"x": 0.0}).count() == 0  # nothing is near zero in relative terms


def test_make_conditions(spark):
    assert rows(make_conditions(spark, {"a": 1, "b": "x"}, 3)) == [(0, 1, "x"), (1, 1, "x"), (2, 1, "x")]
    assert make_conditions(spark, pd.Series({"a": 1}), 2).count() == 2
    assert rows(make_conditions(spark, {"a": [1, 2]})) == [(0, 1), (1, 2)]
    assert rows(make_conditions(spark, pd.DataFrame({"a": [5]}), 1)) == [(0, 5)]
    with pytest.raises(ValueError):
        make_conditions(spark, pd.DataFrame({"a": [5]}), 2)
    with pytest.raises(TypeError):
        make_conditions(spark, [1, 2])


def letters(tries):
    at = (F.floor(uniform(1, "s", "cond_id", "attempt") * 3) + 1).cast("int")
    return tries.withColumns({
        "s": F.element_at(F.array(*[F.lit(x) for x in "abc"]), at), "v": uniform(1, "v", "cond_id", "attempt"),
        "k": F.floor(uniform(1, "k", "cond_id", "attempt") * 40)})


def test_one_row_per_condition(spark):
    asked = spark.range(900).select(F.col("id").alias("cond_id"), F.when(F.col("id") % 3 == 0, "b").when(F.col("id") == 1, None).otherwise("a").alias("s"))
    got = sample_conditional(asked, letters, [Between("v", 0.1, 0.9, handling="reject_sampling")])
    assert got.count() == 899 and got.select("cond_id").distinct().count() == 899
    assert got.join(asked.withColumnRenamed("s", "want"), "cond_id").filter("s <> want").count() == 0
    assert got.filter("v < 0.1 OR v > 0.9").count() == 0
    again = sample_conditional(asked.repartition(9), letters, [Between("v", 0.1, 0.9, handling="reject_sampling")])
    assert rows(got, "cond_id") == rows(again.select(*got.columns), "cond_id")


def test_unique_within_a_condition(spark):
    asked = spark.range(60).select(F.col("id").alias("cond_id"), F.when(F.col("id") < 30, "a").otherwise("b").alias("s"))
    got = sample_conditional(asked, letters, [Unique("k", "cond_id")])
    assert got.count() == 60 and got.groupBy("s", "k").count().filter("count > 1").count() == 0


def test_attempts_in_levels(spark):
    one = spark.range(2).select(F.col("id").alias("cond_id"))
    for count in (1, 2, 3, 4, 9, 10, 28, 100):
        got = _attempts(one, 5, count, "cond_id", fan=3)
        assert rows(got) == sorted([(c, a) for c in range(2) for a in range(5, 5 + count)], key=repr)


def test_shortfall(spark):
    asked = spark.range(20).select(F.col("id").alias("cond_id"), F.lit("a").alias("s"))
    with pytest.raises(ValueError, match="never met"):
        sample_conditional(asked.withColumn("s", F.lit("zzz")), letters, max_retries=1)
    narrow = [Between("v", 0.0, 0.2, handling="reject_sampling")]
    with pytest.raises(ValueError, match="still missing"):
        sample_conditional(asked, letters, narrow, max_retries=1)
    with pytest.warns(UserWarning):
        assert 0 < sample_conditional(asked, letters, narrow, max_retries=1, graceful=True).count() < 20
    with pytest.raises(ValueError, match="unknown column"):
        sample_conditional(asked, letters, fields=["v"])


# -- privacy ------------------------------------------------------------------------------
def test_privacy(spark):
    df = spark.range(3000).select(
        "id", F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("who"), F.when(F.col("id") % 5 == 0, "x").otherwise("y").alias("l"),
        (F.col("id") % 2).cast("string").alias("a"), (F.col("id") % 3).cast("string").alias("b"))
    assert cap_rows(df, "who", ["id"], 2).count() == 2002
    cells = domain_cells(df, "l", ["a", "b"])
    assert rows(cells.select("cell")) == [(i,) for i in sorted(range(12), key=repr)] or cells.select("cell").distinct().count() == 12
    got = private_freq(df, "l", ["a", "b"], "who", ["id"], seed=4, sigma=2.0, max_rows_per_entity=2)
    assert got.count() == 12 and got.agg(F.sum("p")).first()[0] == pytest.approx(1)
    calm = private_freq(df, "l", ["a", "b"], "who", ["id"], seed=4, sigma=1e-9, max_rows_per_entity=1)
    assert calm.agg(F.sum("noisy")).first()[0] == pytest.approx(2001, abs=1e-3)
    wider = private_freq(df, "l", ["a", "b"], "who", ["id"], seed=4, domain={"a": spark.createDataFrame([("0",), ("1",), ("9",)], "value string")})
    assert wider.count() == 18 and wider.filter("a = '9'").count() == 6
    assert wider.filter("epsilon IS NOT NULL").count() == 0  # the other columns tell which categories occur
    lists = {c: spark.createDataFrame([(v,) for v in vs], "value string") for c, vs in {"l": "xy", "a": "01", "b": "012"}.items()}
    public = private_freq(df, "l", ["a", "b"], "who", ["id"], seed=4, domain=lists)
    assert {r["epsilon"] for r in public.collect()} == {epsilon(5.0, 2e-6)}
    assert secret_seed() != secret_seed()


def test_epsilon():
    best = 1 + 5 * math.sqrt(2 * math.log(1 / 2e-6))
    exact = best / 50 + math.log(1 / 2e-6) / (best - 1)
    assert exact <= epsilon(5.0, 2e-6) <= exact * 1.001
    assert epsilon(1.0, 1e-5) > epsilon(5.0, 1e-5)


# -- the whole flow -----------------------------------------------------------------------
@pytest.fixture(scope="module")
def trips(spark):
    zone = F.element_at(F.array(*[F.lit(z) for z in ("north", "south", "west")]), (F.col("id") % 3 + 1).cast("int"))
    base = spark.range(3000).select("id", zone.alias("zone"))
    return base.select(
        F.concat(F.lit("u"), F.col("id").cast("string")).alias("code"), "zone",
        F.when(F.col("zone") == "north", F.when(F.col("id") % 2 == 0, "bus").otherwise("car")).otherwise("car").alias("kind"),
        F.when(uniform(1, "p", "id") < 0.7, "day").otherwise("night").alias("part"),
        F.concat(F.lit("Mr "), F.col("id").cast("string")).alias("driver"),
        F.round(F.when(F.col("zone") == "north", 10.0).otherwise(50.0) + normal(1, "d", "id"), 1).alias("dist"),
        F.floor(uniform(1, "st", "id") * 100).cast("int").alias("start"),
        (F.floor(uniform(1, "st", "id") * 100) + F.floor(uniform(1, "en", "id") * 20)).cast("int").alias("finish"))


@pytest.fixture(scope="module")
def profile(spark, trips):
    rules = [GreaterThan("start", "finish", drop="high"), Between("dist", 0.0, 100.0, handling="all")]
    emb = spark.createDataFrame([("north", [1.0, 0.0]), ("south", [0.0, 1.0]), ("west", [0.1, 1.0]), ("far north", [1.0, 0.05])], "key string, embedding array<double>")
    made = Synthesizer("zone", embeddings=emb, anonymize_fields={"driver": "name"}, primary_key="code", constraints=rules,
                       field_types={"code": {"type": "id", "subtype": "string", "regex": "[A-Z]{4}"}})
    return made.fit(trips)


def test_generated_rows_look_like_the_data(spark, trips, profile):
    got = profile.sample(4000, seed=3).cache()
    assert got.columns == trips.columns and [f.dataType for f in got.schema] == [f.dataType for f in trips.schema]
    assert got.count() == 4000 and got.select("code").distinct().count() == 4000
    assert got.filter("NOT finish >= start OR NOT dist BETWEEN 0 AND 100").count() == 0
    assert got.filter("zone <> 'north' AND kind = 'bus'").count() == 0
    share = got.filter("part = 'day'").count() / 4000
    assert abs(share - 0.7) < 4 * math.sqrt(0.21 / 4000) + 0.02
    means = {r["zone"]: r["m"] for r in got.groupBy("zone").agg(F.avg("dist").alias("m")).collect()}
    assert means["north"] == pytest.approx(10, abs=1) and means["south"] == pytest.approx(50, abs=1)
    assert not set(r[0] for r in got.select("driver").collect()) & set(r[0] for r in trips.select("driver").collect())
    same = profile.sample(4000, seed=3)
    assert rows(same, "code") == rows(got, "code")


def test_seen_labels_and_default_size(profile):
    got = Counter(r["zone"] for r in profile.sample(1000, labels=["north", "west"], seed=1).collect())
    assert got == {"north": 500, "west": 500}
    assert profile.sample(seed=1).count() == 3000


def test_unseen_label_follows_its_neighbours(profile):
    got = profile.sample(900, unseen=["far north"], k=1, seed=1, sort=True)
    r = got.agg(F.avg("dist"), F.count_if(F.col("kind") == "bus"), F.min("zone"), F.max("zone")).first()
    assert r[0] == pytest.approx(10, abs=1) and 350 < r[1] < 550 and (r[2], r[3]) == ("far north", "far north")
    with pytest.raises(KeyError):
        profile.sample(10, unseen=["atlantis"])


def test_conditions(spark, profile):
    got = profile.sample(conditions={"zone": "north", "kind": "bus"}, n=50, seed=1)
    assert got.count() == 50 and got.filter("zone = 'north' AND kind = 'bus'").count() == 50
    frame = pd.DataFrame({"zone": ["west", "north"] * 10, "part": ["night", "day"] * 10})
    made = profile.sample(conditions=frame, seed=1, sort=True).collect()
    assert [(r["zone"], r["part"]) for r in made] == list(zip(frame["zone"], frame["part"]))
    assert len({r["code"] for r in made}) == 20
    with pytest.raises(ValueError, match="unknown column"):
        profile.sample(conditions={"nope": 1}, n=2)
    with pytest.raises(ConstraintsNotMetError):
        profile.sample(conditions={"start": 9, "finish": 3}, n=2)
    with pytest.raises(ValueError, match="never met"):
        profile.sample(conditions={"zone": "south", "kind": "bus"}, n=2, max_retries=1)


def test_save_and_load(spark, profile):
    path = scratch_path(spark, "saved")
    profile.save(path)
    again = Profile.load(spark, path)
    assert rows(again.sample(300, seed=9), "code") == rows(profile.sample(300, seed=9), "code")
    assert again.spec["code"].regex == "[A-Z]{4}" and again.rows == 3000


def test_refused_data(spark, trips):
    bad = trips.withColumn("finish", F.col("start") - 1)
    with pytest.raises(ConstraintsNotMetError):
        Synthesizer("zone", constraints=[GreaterThan("start", "finish")]).fit(bad.drop("code", "driver"))
    with pytest.raises(ValueError, match="excludes"):
        Synthesizer("zone", spec=TableSpec([]), field_names=["a"])


def test_one_or_no_discrete_column(spark, trips):
    few = Synthesizer("zone").fit(trips.select("zone", "part", "dist")).sample(200, seed=1)
    assert few.count() == 200 and few.columns == ["zone", "part", "dist"]
    none = Synthesizer("zone").fit(trips.select("zone", "dist")).sample(200, seed=1)
    assert none.select("zone").distinct().count() == 3


def test_ids_only(spark):
    df = spark.range(5).withColumnRenamed("id", "k")
    made = Synthesizer("k", spec=TableSpec([FieldSpec("k", "id")], primary_key="k")).fit(df).sample(7)
    assert rows(made) == [(i,) for i in range(7)]


def test_generated_plan_has_no_python_and_no_nested_loop(spark, profile):
    from rowloom.operators.generate import generate

    text = plan_of(generate(profile.model, spark.range(100).withColumnRenamed("id", "cand_id"), ["cand_id"], 1))
    assert "Python" not in text and "NestedLoop" not in text and "Cartesian" not in text
    assert "hashpartitioning" not in text  # small learned tables are broadcast: rows do not move
