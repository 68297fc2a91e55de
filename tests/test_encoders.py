import datetime as dt
import math
from collections import Counter

import numpy as np
import pytest
from conftest import plan_of, rows
from pyspark.sql import functions as F

from rowloom.functions.random import normal
from rowloom.operators.encoders import (
    BinaryEnc, Encoder, LabelEnc, Numeric, OneHotEnc, UniformCat, UnixTs, choose_encoders, decimals, decode, encode, fit_encoders, layout,
)
from rowloom.operators.mixture import Mixture, MixtureNorm, fit_mixtures, inverse_mixture, label_components, transform_mixture
from rowloom.spec import TableSpec


def codes(enc, df, order="id", ids=()):
    return [list(r[0]) for r in enc.encode(df, "c", ids).orderBy(order).select("c").collect()]


def back(enc, df, ids=()):
    return [r[0] for r in enc.decode(enc.encode(df, "c", ids), "c", "b").orderBy("id").select("b").collect()]


def test_numeric(spark):
    df = spark.createDataFrame([(1, 1.25), (2, None), (3, 3.5), (4, float("nan"))], "id int, x double")
    enc = Numeric().fit(df, "x")
    assert (enc.mean, enc.low, enc.high, enc.digits) == (2.375, 1.25, 3.5, 2)
    assert codes(enc, df) == [[1.25], [2.375], [3.5], [2.375]]
    moved = spark.createDataFrame([(1, [0.0]), (2, [9.0]), (3, [2.128])], "id int, c array<double>")
    assert [r["b"] for r in rows_of(enc.decode(moved, "c", "b"))] == [1.25, 3.5, 2.13]
    free = Numeric(rounding=None, minimum=None, maximum=2).fit(df, "x")
    assert [r["b"] for r in rows_of(free.decode(moved, "c", "b"))] == [0.0, 2.0, 2.0]
    whole = Numeric().fit(spark.createDataFrame([(1, 2), (2, 5)], "id int, x int"), "x")
    assert [r["b"] for r in rows_of(whole.decode(moved, "c", "b"))] == [2, 5, 2]


def rows_of(df):
    return df.orderBy("id").collect()


def test_decimals(spark):
    df = spark.createDataFrame([(0.0,), (1.5,), (2.675,), (1e20,), (1e-9,), (123456789.25,)], "x double")
    assert [r[0] for r in df.select(decimals(F.col("x"))).collect()] == [0, 1, 3, 0, 9, 2]


def test_binary_and_time(spark):
    df = spark.createDataFrame([(1, True), (2, None), (3, False), (4, True)], "id int, x boolean")
    assert codes(BinaryEnc().fit(df, "x"), df) == [[1.0], [1.0], [0.0], [1.0]]
    assert back(BinaryEnc().fit(df, "x"), df) == [True, True, False, True]
    when = dt.datetime(2024, 5, 6, 7, 8, 9, 123456)
    ts = spark.createDataFrame([(1, when), (2, None), (3, when)], "id int, x timestamp_ntz")
    assert back(UnixTs().fit(ts, "x"), ts) == [when] * 3
    assert codes(UnixTs().fit(ts, "x"), ts)[0][0] == pytest.approx((when - dt.datetime(1970, 1, 1)).total_seconds() * 1e9)
    days = spark.createDataFrame([(1, dt.date(2024, 2, 29))], "id int, x date")
    assert back(UnixTs().fit(days, "x"), days) == [dt.date(2024, 2, 29)]


@pytest.fixture
def words(spark):
    return spark.createDataFrame([(3, "b"), (1, "c"), (2, "b"), (4, None), (5, "a")], "id int, x string")


def test_one_hot_and_label_follow_appearance(spark, words):
    hot = OneHotEnc().fit(words, "x", "id")
    assert rows(hot.table.select("code", "value")) == [(0, "c"), (1, "b"), (2, None), (3, "a")] and hot.width == 4
    assert codes(hot, words)[:3] == [[1, 0, 0, 0], [0, 1, 0, 0], [0, 1, 0, 0]]
    assert back(hot, words) == ["c", "b", "b", None, "a"]
    other = spark.createDataFrame([(1, "zzz")], "id int, x string")
    assert codes(hot, other) == [[0, 0, 0, 0]]
    label = LabelEnc().fit(words, "x", "id")
    assert codes(label, words) == [[0.0], [1.0], [1.0], [2.0], [3.0]]
    assert back(label, words) == ["c", "b", "b", None, "a"]
    assert codes(label, other) == [[None]]


def test_one_hot_of_many_categories(spark):
    wide = spark.range(12_000).select("id", F.concat(F.lit("v"), "id").alias("x"))
    hot = OneHotEnc().fit(wide, "x", "id")
    some = hot.encode(wide.filter("id IN (0, 11999)"), "c")
    assert hot.width == 12_000
    assert sorted(r[0] for r in some.select(F.array_position("c", 1.0)).collect()) == [1, 12_000]
    assert sorted(r[0] for r in hot.decode(some.drop("x"), "c", "x").select("x").collect()) == ["v0", "v11999"]


def test_uniform_category(spark):
    df = spark.range(4000).withColumn("x", F.when(F.col("id") % 4 == 0, "rare").otherwise("often"))
    enc = UniformCat(seed=2).fit(df, "x")
    coded = enc.encode(df, "c", ["id"])
    assert coded.filter("x = 'often' AND (c[0] < 0 OR c[0] >= 0.75)").count() == 0
    assert enc.decode(coded, "c", "b").filter("x <> b OR b IS NULL").count() == 0
    # a uniform number decodes to the categories by their frequency, also at and beyond the ends
    ends = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [-0.5]), (4, [1.5])], "id int, c array<double>")
    assert [r["b"] for r in rows_of(enc.decode(ends, "c", "b"))] == ["often", "rare", "often", "rare"]
    with pytest.raises(ValueError):
        enc.encode(df, "c")


class Doubled(Encoder):
    def encoded(self, df):
        return F.array(df[self.name] * 2.0)

    def decoded(self, vector):
        return vector[0] / 2.0


def test_row_codec_with_user_encoder(spark):
    df = spark.createDataFrame([(1, "a", 2.5, True, 7.0), (2, "b", 3.5, False, 8.0)], "id int, s string, x double, f boolean, d double")
    spec = TableSpec.infer(df, encoders={"d": Doubled, "s": "label_encoding"}, primary_key="id")
    encoders = fit_encoders(df, choose_encoders(df, spec), "id")
    assert [(s.column, s.start, s.width, s.kind) for s in layout(encoders)] == [("s", 0, 1, "tanh"), ("x", 1, 1, "tanh"), ("f", 2, 1, "tanh"), ("d", 3, 1, "tanh")]
    coded = encode(df, encoders, keep=["id"])
    assert [r["vector"] for r in rows_of(coded)] == [[0.0, 2.5, 1.0, 14.0], [1.0, 3.5, 0.0, 16.0]]
    assert rows(decode(coded, encoders).select(*df.columns), "id") == rows(df, "id")


MIX = Mixture([0.0, 10.0], [1.0, 2.0], [0.5, 0.5])


def test_mixture_transform_against_numpy(spark):
    df = spark.range(2000).withColumn("x", normal(1, "x", "id") * 5 + 5)
    got = transform_mixture(df, "x", MIX, 3, ["id"], "v")
    picked = Counter()
    for r in got.collect():
        z, *hot = r["v"]
        c = int(np.argmax(hot))
        assert sum(hot) == 1 and -0.99 <= z <= 0.99
        want = (r["x"] - MIX.means[c]) / (4 * MIX.stds[c])
        assert z == pytest.approx(min(max(want, -0.99), 0.99))
        picked[c] += 1
        dens = [w / s * math.exp(-0.5 * ((r["x"] - m) / s) ** 2) for m, s, w in zip(MIX.means, MIX.stds, MIX.weights)]
        if dens[0] > 1e4 * dens[1]:
            assert c == 0
    assert min(picked.values()) > 500
    text = plan_of(got)
    assert "Python" not in text and "Exchange" not in text
    restored = got.withColumn("b", inverse_mixture(F.col("v"), MIX)).filter("abs(v[0]) < 0.99 AND abs(b - x) > 1e-9")
    assert restored.count() == 0


def test_mixture_fit_finds_the_components(spark):
    big = F.when(F.col("id") % 10 < 3, normal(1, "a", "id") * 2).otherwise(normal(1, "b", "id") * 5 + 100)
    df = spark.range(40_000).select("id", big.alias("x"), (normal(1, "c", "id") + 3).alias("y"), F.when(F.col("id") % 2 == 0, "e").otherwise("o").alias("l"))
    mix = fit_mixtures(df, ["x", "y"])
    assert all(1 <= m.size <= 10 and sum(m.weights) == pytest.approx(1) for m in mix.values())
    low = sum(w for w, m in zip(mix["x"].weights, mix["x"].means) if m < 50)
    assert low == pytest.approx(0.3, abs=0.02)
    mean = sum(w * m for w, m in zip(mix["y"].weights, mix["y"].means))
    assert mean == pytest.approx(3, abs=0.05)
    again = fit_mixtures(df.repartition(11), ["x", "y"])
    assert again["x"].means == pytest.approx(mix["x"].means, rel=1e-3, abs=1e-2)
    shares = label_components(df, "l", mix)
    assert shares.filter("column = 'y'").groupBy("label").sum("n").first()[1] == pytest.approx(20_000 * 1e6, rel=1e-3)


def test_mixture_fit_of_extreme_and_constant_columns(spark):
    df = spark.range(5000).select((normal(1, "a", "id") + F.when(F.col("id") == 7, 1e12).otherwise(0)).alias("x"), F.lit(4.0).alias("k"), F.lit(None).cast("double").alias("n"))
    mix = fit_mixtures(df, ["x", "k"])
    assert min(abs(m) for m in mix["x"].means) < 1.0 and mix["k"].means == pytest.approx([4.0] * mix["k"].size)
    assert all(s > 0 for m in mix.values() for s in m.stds)


def test_mixture_encoder(spark):
    df = spark.range(500).withColumn("x", F.when(F.col("id") == 3, F.lit(None)).otherwise(normal(1, "x", "id")))
    enc = MixtureNorm(seed=1).fit(df, "x")
    coded = enc.encode(df, "c", ["id"])
    assert coded.first()["c"].__len__() == enc.width
    far = enc.decode(coded, "c", "b").filter("x IS NOT NULL AND abs(c[0]) < 0.99 AND abs(b - x) > 1e-6")
    assert far.count() == 0
    noisy = MixtureNorm(seed=1, sigma=0.01, mixture=enc.mixture).fit(df, "x")
    moved = noisy.decode(noisy.encode(df, "c", ["id"]), "c", "b", ["id"]).filter("abs(b - x) > 0").count()
    assert moved > 400
