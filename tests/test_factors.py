"""The column model of any width."""

from collections import Counter

import numpy as np
import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from rowloom import Profile, Synthesizer, UniqueCombinations
from rowloom.operators import factors
from rowloom.operators.copula import Copula
from rowloom.operators.factors import FactorModel


@pytest.fixture(scope="module")
def places(spark):
    """Cities lie in one country each; height goes with the country, and warmth with height."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(6000):
        country = int(rng.integers(0, 4))
        height = 100.0 * country + float(rng.normal(0, 5))
        rows.append((f"c{country}", None if i % 97 == 0 else f"city{country}_{int(rng.integers(0, 3))}", height, 30 - height / 20 + float(rng.normal(0, 1)), int(rng.integers(1, 5))))
    return spark.createDataFrame(rows, "country string, city string, height double, warmth double, size int")


def test_full_rank_gives_the_covariance(spark, places):
    model = FactorModel.fit(places, ["country", "city", "height", "warmth"], rank=40)
    table = {(r["column"], r["value"]): r for r in model.table.collect()}
    data = places.toPandas()
    x = {("height", None): (data["height"] - data["height"].mean()) / data["height"].std(ddof=0), ("warmth", None): (data["warmth"] - data["warmth"].mean()) / data["warmth"].std(ddof=0)}
    for c in ("country", "city"):
        for v in set(data[c]):
            x[c, v] = (data[c].isna() if v is None else data[c] == v).astype(float)
    assert set(table) == set(x)
    keys = list(x)
    cov = np.cov(np.stack([x[k] for k in keys]), bias=True)
    made = np.array([[float(np.dot(table[a]["load"], table[b]["load"])) for b in keys] for a in keys])
    assert np.allclose(made, cov, atol=1e-6)


def test_draws_follow_the_given_columns(spark, places):
    model = FactorModel.fit(places, ["country", "city", "height", "warmth"], rank=20)
    asked = spark.range(4000).select("id", F.concat(F.lit("c"), F.col("id") % 4).alias("country"))
    got = model.sample_given(asked, ["country"], ["city", "height", "warmth"], 3, ["id"]).collect()
    assert len(got) == 4000
    own = Counter((r["city"] or "none").split("_")[0] == r["country"].replace("c", "city") for r in got if r["city"])
    assert own[True] / sum(own.values()) > 0.9
    for k in range(4):
        mine = [r for r in got if r["country"] == f"c{k}"]
        assert np.mean([r["height"] for r in mine]) == pytest.approx(100 * k, abs=6) and np.mean([r["warmth"] for r in mine]) == pytest.approx(30 - 5 * k, abs=0.6)
    again = {r["id"]: r["city"] for r in model.sample_given(asked.repartition(7), ["country"], ["city"], 3, ["id"]).collect()}
    first = {r["id"]: r["city"] for r in model.sample_given(asked, ["country"], ["city"], 3, ["id"]).collect()}
    assert again == first


def test_given_numbers(spark, places):
    model = FactorModel.fit(places, ["height", "warmth", "size"], rank=6)
    asked = spark.createDataFrame([(i, 300.0 if i % 2 else 0.0) for i in range(2000)], "id long, height double")
    got = model.sample_given(asked, ["height"], ["warmth", "size"], 3, ["id"]).collect()
    assert np.mean([r["warmth"] for r in got if r["height"] == 300.0]) == pytest.approx(15, abs=0.5)
    assert np.mean([r["warmth"] for r in got if r["height"] == 0.0]) == pytest.approx(30, abs=0.5)
    assert all(isinstance(r["size"], int) for r in got)


def test_thousands_of_categories(spark):
    """More categories than a full covariance takes: each label keeps to its own codes."""
    rows = spark.range(60_000).select(F.concat(F.lit("label"), F.col("id") % 4243).alias("label"), F.concat(F.lit("code"), F.floor((F.col("id") % 4243) / 40)).alias("code"))
    rule = UniqueCombinations(["label", "code"], fit_columns_model=True).fit(rows)
    assert isinstance(rule.model, FactorModel) and rule.model.table.count() == 4243 + 107
    asked = spark.createDataFrame([(i, f"code{i}") for i in range(100)], "id long, code string")
    full = rule.model.sample_given(asked, ["code"], ["label"], 3, ["id"])
    assert full.filter("label is not null").count() == 100


def test_a_profile_keeps_its_factored_model(spark, places, tmp_path, monkeypatch):
    monkeypatch.setattr("rowloom.operators.copula.MODEL_WIDTH", 3)
    rule = UniqueCombinations(["country", "city"], fit_columns_model=True)
    rows = places.filter("city is not null").select("country", "city", "size", F.col("height").alias("h"))
    rule.fit(rows)
    profile = Synthesizer("size", constraints=[rule]).fit(rows)
    profile.save(str(tmp_path / "p"))
    back = Profile.load(spark, str(tmp_path / "p"))
    kept = back.constraints[0].model
    assert isinstance(kept, FactorModel) and kept.rank == profile.constraints[0].model.rank
    got = back.sample(conditions={"country": "c2"}, n=30, seed=1).collect()
    assert len(got) == 30 and all(r["country"] == "c2" and r["city"].startswith("city2") for r in got)


def test_narrow_models_stay_full(places):
    assert isinstance(Copula.fit(places, ["country", "height"]), Copula)


def test_rows_are_projected_without_laying_out_their_dimensions(spark, monkeypatch):
    """Neither vector sum of a fit makes a row of every value of every row."""
    plans, plain = [], factors.materialize

    def seen(df, tag="table"):
        if tag in ("entries", "range"):
            plans.append(plan_of(df))
        return plain(df, tag)

    gram = factors._gram
    monkeypatch.setattr(factors, "materialize", seen)
    monkeypatch.setattr(factors, "_gram", lambda df, name, width: (plans.append(plan_of(df)), gram(df, name, width))[1])
    df = spark.range(300).selectExpr("cast(id % 7 AS string) AS a", "nullif(cast(id % 5 AS string), '0') AS b", "cast(id AS double) AS x")
    model = factors.FactorModel.fit(df, ["a", "b", "x"], rank=16)
    assert len(plans) == 4 and not any("Generate" in p for p in plans)
    pair = model.covariance(df.select("a", "b").distinct().filter("a = '1'"), "a", "b").collect()
    rows = [(r["a"], r["b"]) for r in df.collect()]
    for r in pair:
        both, own, other = (sum(f(a, b) for a, b in rows) / 300 for f in (lambda a, b: a == r["a"] and b == r["b"], lambda a, b: a == r["a"], lambda a, b: b == r["b"]))
        assert abs(r["cov"] - (both - own * other)) < 1e-9
    assert {r["b"] for r in pair} == {None, "1", "2", "3", "4"}
