"""Private learning: sparse releases, the account, and profiles learned from released tables only."""

import math
from collections import Counter
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from rowloom import GreaterThan, Private, Profile, Synthesizer, UniqueCombinations
from rowloom.functions.random import upper_quantile
from rowloom.operators.privacy import epsilon
from rowloom.operators.release import Cells, Ledger, sparse_release, surviving_cells, tail_probability


def test_quantiles(spark):
    points = [1e-300, 1e-40, 1e-12, 1e-6, 0.01, 0.0749, 0.0751, 0.3, 0.5, 0.7, 0.92499, 0.9251, 0.999, 1 - 1e-9]
    got = [r["z"] for r in spark.createDataFrame([(p,) for p in points], "p double").select(upper_quantile(F.col("p")).alias("z")).collect()]
    for p, z in zip(points, got):
        assert z == pytest.approx(-NormalDist().inv_cdf(p), rel=1e-12, abs=1e-12)


def test_ledger_composes():
    ledger = Ledger(2e-6)
    assert ledger.epsilon == 0.0
    ledger.charge("one", 5.0)
    assert ledger.epsilon == pytest.approx(epsilon(5.0, 2e-6))
    ledger.charge("two", 5.0)
    # two releases with one multiplier cost as much as one with sqrt(2) less noise
    assert ledger.epsilon == pytest.approx(epsilon(5.0 / math.sqrt(2), 2e-6)) and ledger.epsilon < 2 * epsilon(5.0, 2e-6)


@pytest.mark.parametrize("threshold", [0.0, 1.0, 2.5])
def test_survivors_are_as_many_as_the_tail_says(spark, threshold):
    cells = Cells.of([("a", 100_000), ("b", 37), ("c", 250_001)])
    got = surviving_cells(spark, cells, 11, threshold).collect()
    total, p = 350_038, tail_probability(threshold)
    assert abs(len(got) - total * p) < 5 * math.sqrt(total * p * (1 - p))
    assert len({r["cell"] for r in got}) == len(got) and min(r["z"] for r in got) >= threshold - 1e-9
    inside = {"a": range(100_000), "b": range(100_000, 100_037), "c": range(100_037, 350_038)}
    assert all(r["cell"] in inside[r["table"]] for r in got)
    # even over the cells, and the values follow the tail
    halves = Counter(r["cell"] < 50_000 for r in got if r["table"] == "a")
    assert abs(halves[True] - halves[False]) < 5 * math.sqrt(sum(halves.values()))
    above = sum(r["z"] > threshold + 0.5 for r in got) / len(got)
    assert above == pytest.approx(tail_probability(threshold + 0.5) / p, abs=5 / math.sqrt(len(got)))


def test_work_grows_with_survivors_not_with_cells(spark):
    """A trillion cells, of which few pass the threshold."""
    cells = Cells.of([("huge", 10**12)])
    observed = spark.createDataFrame([("huge", 5, 1000), ("huge", 10**12 - 1, 2000), ("huge", 77, 1)], "table string, cell long, n long")
    threshold = 6.5  # about forty cells
    got = {r["cell"]: r["noisy"] for r in sparse_release(observed, cells, 3, 10.0, threshold).collect()}
    assert got[5] == pytest.approx(1000, abs=60) and got[10**12 - 1] == pytest.approx(2000, abs=60) and 77 not in got
    assert 10 < len(got) < 90 and min(got.values()) >= 65


def test_observed_cells_get_plain_noise(spark):
    cells = Cells.of([("t", 20_000)])
    observed = spark.range(20_000).select(F.lit("t").alias("table"), F.col("id").alias("cell"), F.lit(500).cast("long").alias("n"))
    noise = [r["noisy"] - 500 for r in sparse_release(observed, cells, 8, 20.0, 2.0).collect()]
    assert len(noise) == 20_000 and abs(sum(noise) / 20_000) < 1 and math.sqrt(sum(x * x for x in noise) / 20_000) == pytest.approx(20, rel=0.05)


@pytest.fixture(scope="module")
def visits(spark):
    i = F.col("id")
    return spark.range(60_000).select(
        (i % 20_000).alias("person"), i.alias("visit"), F.when(i % 4 == 0, "north").otherwise("south").alias("zone"),
        F.when(i % 4 == 0, "bus").when(i % 4 == 1, "bike").otherwise("car").alias("kind"), (i % 2 == 0).alias("paid"),
        F.when(i % 4 == 0, 10.0 + i % 3).otherwise(80.0 + i % 5).alias("dist"), (i % 30).cast("int").alias("start"), (i % 30 + 2 + i % 3).cast("int").alias("finish"),
        F.concat(F.lit("secret"), i).alias("note"),
    )


def how(**more):
    given = dict(
        entity="person", order_by=["visit"], domain={"zone": ["north", "south", "west"], "kind": ["bus", "bike", "car", "boat"], "paid": ["true", "false"]},
        bounds={"dist": (0.0, 100.0)}, max_rows_per_entity=2, seed=5,
    )
    return Private(**{**given, **more})


def test_private_profile(spark, visits, tmp_path):
    profile = Synthesizer("zone", private=how()).fit(visits)
    assert profile.ledger.entries == [("joint counts", 5.0), ("histograms", 5.0)]
    assert profile.epsilon == pytest.approx(epsilon(5.0 / math.sqrt(2), 2e-6))
    assert profile.spec.names() == ["zone", "kind", "paid", "dist"]
    rows = profile.sample(8000, seed=1).collect()
    zones = Counter(r["zone"] for r in rows)
    assert zones["north"] / 8000 == pytest.approx(0.25, abs=0.03) and zones["west"] < 200
    north = [r for r in rows if r["zone"] == "north"]
    assert sum(r["kind"] == "bus" for r in north) / len(north) > 0.9 and sum(r["dist"] for r in north) / len(north) == pytest.approx(11, abs=2.5)
    assert all(0 <= r["dist"] <= 100 for r in rows)
    assert abs(profile.rows - 40_000) < 1500  # two rows of each person count
    profile.save(str(tmp_path / "p"))
    back = Profile.load(spark, str(tmp_path / "p"))
    assert back.epsilon == profile.epsilon and back.ledger == profile.ledger
    assert sorted(map(str, back.sample(50, seed=3).collect())) == sorted(map(str, profile.sample(50, seed=3).collect()))


def test_one_person_moves_little(visits):
    """Without one person, whose rows are all of one kind, the released counts differ by that person's rows at most."""
    more = visits.unionByName(visits.limit(1).withColumns({"person": F.lit(-1).cast("long"), "visit": F.col("visit") - 1}))
    counts = [{tuple(r)[:4]: r["n"] for r in Synthesizer("zone", private=how(threshold=-50.0)).fit(df).model.joint.collect()} for df in (visits, more)]
    moved = [abs(counts[0].get(k, 0) - counts[1].get(k, 0)) for k in set(counts[0]) | set(counts[1])]
    assert max(moved) <= 1 and sum(moved) <= 3


def test_private_constraints_and_refusals(visits):
    rule = GreaterThan("start", "finish", drop="high")
    gap = "finish#start"
    profile = Synthesizer("zone", constraints=[rule], private=how(bounds={"start": (0, 30), gap: (0.0, 4.0)})).fit(visits)
    rows = profile.sample(500, seed=2).collect()
    assert all(r["start"] <= r["finish"] for r in rows) and set(profile.spec.names()) == {"zone", "kind", "paid", "start", "finish"}
    with pytest.raises(ValueError, match="learns from rows"):
        Synthesizer("zone", constraints=[UniqueCombinations(["kind", "paid"])], private=how()).fit(visits)
    with pytest.raises(ValueError, match="neither public values nor bounds"):
        Synthesizer("zone", constraints=[rule], private=how()).fit(visits)
    with pytest.raises(ValueError, match="public values of the label"):
        Synthesizer("note", private=how()).fit(visits)
