"""Rows drawn under given values."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from rowloom import Profile
from rowloom.operators.constraints import GreaterThan
from rowloom.operators.frequency import pair_names
from rowloom.operators.generate import fit_model
from rowloom.operators.guided import KNOWN, ConditionIndex, known_values
from rowloom.operators.mixture import Mixture
from rowloom.spec import TableSpec

MIX = {"size": Mixture([0.0, 100.0], [5.0, 10.0], [0.5, 0.5])}


@pytest.fixture(scope="module")
def people(spark):
    """Labels x, y, z; town and job depend on the label; one row in a million has the job 'rare'."""
    i = F.col("id")
    rows = spark.range(1_000_000).select(
        F.when(i % 10 < 6, "x").when(i % 10 < 9, "y").otherwise("z").alias("label"),
        F.when(i == 123_457, "rare").when((i % 7 < 3) | (i % 10 == 9), "cook").otherwise("clerk").alias("job"),
        F.concat(F.lit("t"), (F.floor(i / 10) % F.when(i % 10 < 6, 3).otherwise(5)).cast("string")).alias("town"),
        (F.floor(i / 3) % 2).cast("int").alias("flag"),
        F.when(i % 10 < 6, F.lit(0.0)).otherwise(F.lit(100.0)).alias("size"),
    )
    return fit_model(rows, "label", ["job", "town", "flag"], ["size"], MIX), rows


@pytest.fixture(scope="module")
def profile(people):
    model, rows = people
    return Profile(TableSpec.infer(rows), "label", [], model, {}, {f.name: f.dataType for f in rows.schema.fields}, 1_000_000)


def shares(model, known):
    """P(label | known) summed over the pairs, from the learned counts."""
    counts = {r["label"]: r["n"] for r in model.counts.collect()}
    own = {(r["column"], r["label"], r["value"]): r["n"] for r in model.conditional.collect()}
    joint = {(r["pair"], r["label"], r["a"], r["b"]): r["n"] for r in model.joint.collect()}
    out = Counter()
    for label, n in counts.items():
        for x, y in pair_names(model.columns):
            if x in known and y in known:
                w = joint.get((f"{x}|{y}", label, known[x], known[y]), 0)
                rest = [c for c in known if c not in (x, y)]
            else:
                w, rest = n, list(known)
            for c in rest:
                w *= own.get((c, label, known[c]), 0) / n
            out[label] += w
    total = sum(out.values())
    return {k: v / total for k, v in out.items() if v}


def test_a_value_of_one_row_in_a_million_is_met_at_once(profile):
    got = profile.sample(conditions={"job": "rare"}, n=300, max_retries=0, seed=5).collect()
    assert len(got) == 300 and {r["job"] for r in got} == {"rare"} and {r["label"] for r in got} == {"y"}


@pytest.mark.parametrize("known", [{"job": "cook"}, {"town": "t1", "flag": 1}, {"job": "cook", "town": "t4", "flag": 0}, {"label": "y", "job": "clerk"}])
def test_labels_follow_the_given_values(profile, known):
    got = profile.sample(conditions=known, n=6000, max_retries=0, seed=2).collect()
    assert all(r[c] == v for r in got for c, v in known.items())
    found = Counter(r["label"] for r in got)
    if "label" in known:
        assert set(found) == {known["label"]}
        return
    want = shares(profile.model, {c: str(v) for c, v in known.items()})
    assert set(found) == set(want)
    for label, p in want.items():
        assert abs(found[label] / 6000 - p) < 4 * (p * (1 - p) / 6000) ** 0.5 + 1e-3


def test_open_values_follow_the_given_ones(profile):
    """Towns of label x are t0-t2 only."""
    got = profile.sample(conditions={"label": "x", "job": "cook"}, n=3000, max_retries=0, seed=3).collect()
    towns = Counter(r["town"] for r in got)
    assert set(towns) == {"t0", "t1", "t2"} and min(towns.values()) > 850
    assert abs(sum(r["flag"] for r in got) / 3000 - 0.5) < 0.04


def test_a_given_number_tells_the_label(profile):
    near, far = (profile.sample(conditions={"size": v}, n=500, max_retries=0, seed=1).collect() for v in (1.0, 96.0))
    assert {r["label"] for r in near} == {"x"} and {r["size"] for r in near} == {1.0}
    assert {r["label"] for r in far} == {"y", "z"} and 0.15 < sum(r["label"] == "z" for r in far) / 500 < 0.35


def test_many_different_conditions(spark, profile):
    asked = spark.range(900).select(
        F.col("id").alias("cond_id"), F.element_at(F.array(*[F.lit(v) for v in ("cook", "clerk", "rare")]), (F.col("id") % 3 + 1).cast("int")).alias("job"),
        (F.col("id") % 7 + F.lit(0.5)).alias("size"),
    )
    got = profile.sample(conditions=asked, seed=9, max_retries=0, sort=True).collect()
    assert [(r["cond_id"], r["job"], r["size"]) for r in got] == [(i, ("cook", "clerk", "rare")[i % 3], i % 7 + 0.5) for i in range(900)]


def test_what_cannot_be(profile):
    for known in ({"job": "king"}, {"label": "x", "town": "t4"}, {"label": "x", "job": "rare"}):
        with pytest.raises(ValueError, match="never met"):
            profile.sample(conditions=known, n=3)


def test_null_conditions_are_left_out(spark, profile):
    asked = spark.createDataFrame([(0, "cook", 1), (1, None, 1), (2, "clerk", None)], "cond_id long, job string, flag int")
    assert [r["cond_id"] for r in profile.sample(conditions=asked, seed=1).collect()] == [0]


def test_same_rows_on_any_partitioning(spark, profile):
    asked = spark.range(200).select(F.col("id").alias("cond_id"), F.when(F.col("id") % 2 == 0, "cook").otherwise("rare").alias("job"))
    first = sorted(map(str, profile.sample(conditions=asked, seed=4).collect()))
    assert first == sorted(map(str, profile.sample(conditions=asked.repartition(13), seed=4).collect()))


def test_constraints_are_part_of_the_conditions(spark):
    """low and high are learned as low and a gap; both given, the gap is given too."""
    from rowloom import Synthesizer

    rows = spark.range(3000).select(
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("label"), (F.col("id") % 50).cast("int").alias("low"),
        (F.col("id") % 50 + 1 + F.col("id") % 9).cast("int").alias("high"), F.when(F.col("id") % 3 == 0, "p").otherwise("q").alias("kind"),
    )
    profile = Synthesizer("label", constraints=[GreaterThan("low", "high", drop="high")]).fit(rows)
    got = profile.sample(conditions={"low": 10, "high": 15}, n=20, seed=1, max_retries=0).collect()
    assert len(got) == 20 and {(r["low"], r["high"]) for r in got} == {(10, 15)}


def test_one_column_beside_the_label(spark):
    rows = spark.range(1000).select((F.col("id") % 4).alias("label"), F.when(F.col("id") % 4 < 2, "u").otherwise("v").alias("kind"))
    model = fit_model(rows, "label", ["kind"], [], {})
    known = known_values(spark.createDataFrame([(1, "u")], "cond_id long, kind string"), model, ["kind"], ["cond_id"])
    index = ConditionIndex(model, known, ["kind"])
    ids = spark.range(400).select(F.col("id").alias("cond_id"), F.lit("u").alias(KNOWN + "kind"))
    got = Counter((r["label"], r["kind"]) for r in index.generate(ids, ["cond_id"], 1).collect())
    assert set(got) == {(0, "u"), (1, "u")} and min(got.values()) > 150
