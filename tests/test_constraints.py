import datetime as dt
import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rowloom import (
    Between, ColumnFormula, Constraint, ConstraintsNotMetError, Custom, GreaterThan, MissingConstraintColumnError, Negative,
    NotFittedError, OneHot, Positive, Rounding, Unique, UniqueCombinations,
)
from rowloom.operators.constraints import filter_valid, prepare, reverse_all, transform_all
from rowloom.operators.validate import assert_constraints, constraint_audit


@pytest.fixture
def pairs(spark):
    data = [(1, 1.0, 3.0), (2, 3.0, 3.0), (3, 4.0, 3.0), (4, None, 3.0), (5, 1.0, None), (6, 1.25, 3.5)]
    return spark.createDataFrame(data, "id int, low double, high double")


def verdicts(df, c):
    return [r[1] for r in rows(c.flag(df).select("id", "is_valid"), "id")]


def test_greater_than_verdicts(pairs):
    assert verdicts(pairs, GreaterThan("low", "high")) == [True, True, False, True, True, True]
    assert verdicts(pairs, GreaterThan("low", "high", strict=True)) == [True, False, False, True, True, True]
    assert verdicts(pairs, GreaterThan("low", 3.2, scalar="high")) == [True, True, False, True, True, True]
    assert verdicts(pairs, GreaterThan(3.2, "high", scalar="low")) == [False, False, False, False, True, True]


def test_greater_than_nan_is_unknown(spark):
    df = spark.createDataFrame([(1, float("nan"), 1.0), (2, 2.0, float("nan"))], "id int, low double, high double")
    assert verdicts(df, GreaterThan("low", "high")) == [True, True]


def test_greater_than_gap_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["a", "b", "c", "b#a"])
    assert GreaterThan("a", "b").fit(df).gap_names == ["b##a"]
    assert GreaterThan("a", ["b", "c"]).fit(df).gap_names == ["b##a", "c#a"]
    assert GreaterThan(["a", "b"], "c").fit(df).gap_names == ["a#c", "b#c"]
    assert GreaterThan(0, "c", scalar="low").fit(df).gap_names == ["c#"]


def test_greater_than_round_trip(pairs):
    high = GreaterThan("low", "high", drop="high").fit(pairs)
    coded = high.transform(pairs)
    assert coded.columns == ["id", "low", "high#low"]
    assert coded.orderBy("id").first()["high#low"] == pytest.approx(math.log(3))
    # whole gaps come back, 2.25 becomes 2; a negative or unknown gap is lost
    assert [r[2] for r in rows(high.reverse(coded).select("id", "low", "high"), "id")] == [3.0, 3.0, None, None, None, 3.25]
    low = GreaterThan("low", "high", drop="low").fit(pairs)
    assert [r[1] for r in rows(low.reverse(low.transform(pairs)).select("id", "low"), "id")] == [1.0, 3.0, None, None, None, 1.5]


def test_greater_than_rebuilds_only_broken_rows(spark):
    df = spark.createDataFrame([(1, 5, 2.0), (2, 5, 9.0)], "id int, low int, high double")
    rule = GreaterThan("low", "high").fit(df)
    broken = df.withColumn("high#low", F.lit(math.log(4.0)))
    assert rows(rule.reverse(broken), "id") == [(1, 5, 8.0), (2, 5, 9.0)]


def test_greater_than_times(spark):
    day = lambda d: dt.datetime(2024, 3, d, 5, 6, 7)
    df = spark.createDataFrame([(1, day(1), day(3)), (2, day(9), day(2)), (3, None, day(4))], "id int, a timestamp_ntz, b timestamp_ntz")
    rule = GreaterThan("a", "b", drop="high").fit(df)
    assert verdicts(df, rule) == [True, False, True]
    coded = rule.transform(df)
    assert coded.orderBy("id").first()["b#a"] == pytest.approx(math.log(2 * 86400e9 + 1))
    back = rows(rule.reverse(coded).select("id", "b"), "id")
    assert abs((back[0][1] - day(3)).total_seconds()) < 0.01
    since = GreaterThan(day(3), "b", scalar="low").fit(df)
    assert verdicts(df, since) == [True, False, True]
    with pytest.raises(ValueError, match="times"):
        GreaterThan("id", "b").fit(df)


def test_times_do_not_bend_with_the_session_zone(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 9, 12), dt.datetime(2024, 3, 11, 12))], "a timestamp_ntz, b timestamp_ntz")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        coded = GreaterThan("a", "b").fit(df).transform(df).first()["b#a"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert coded == pytest.approx(math.log(2 * 86400e9 + 1), abs=1e-9)


def test_greater_than_arguments(pairs):
    with pytest.raises(ValueError):
        GreaterThan(["a", "b"], ["c", "d"])
    with pytest.raises(ValueError):
        GreaterThan(1, "a", scalar="low", drop="low")
    with pytest.raises(ValueError):
        GreaterThan(1, "a", scalar="middle")
    with pytest.raises(KeyError):
        GreaterThan("low", "absent").fit(pairs)
    with pytest.raises(ValueError):
        GreaterThan("a", "b", handling="never")


def test_positive_negative(spark):
    df = spark.createDataFrame([(1, -2.0), (2, 0.0), (3, 4.0), (4, None)], "id int, x double")
    assert verdicts(df, Positive("x")) == [False, True, True, True]
    assert verdicts(df, Positive("x", strict=True)) == [False, False, True, True]
    assert verdicts(df, Negative("x")) == [True, True, False, True]
    rule = Positive("x", drop=True).fit(df)
    assert [r[1] for r in rows(rule.reverse(rule.transform(df)).select("id", "x"), "id")] == [None, 0.0, 4.0, None]


def test_between(spark):
    data = [(1, 0.0, 0.0, 1.0), (2, 1.0, 0.0, 1.0), (3, 2.0, 0.0, 1.0), (4, None, 0.0, 1.0), (5, 5.0, None, 6.0), (6, 5.0, 5.0, 5.0)]
    df = spark.createDataFrame(data, "id int, x double, lo double, hi double")
    assert verdicts(df, Between("x", "lo", "hi")) == [True, True, False, True, True, True]
    assert verdicts(df, Between("x", "lo", "hi", strict=True)) == [False, False, False, True, True, False]
    assert verdicts(df, Between("x", 0.5, "hi")) == [False, True, False, True, True, True]
    rule = Between("x", "lo", "hi").fit(df)
    coded = rule.transform(df)
    assert coded.columns == ["id", "lo", "hi", "x#lo#hi"]
    back = [r[1] for r in rows(rule.reverse(coded).select("id", "x"), "id")]
    assert back[0] == pytest.approx(0.0, abs=1e-9) and back[1] == pytest.approx(1.0)
    assert back[2] is None or back[2] == pytest.approx(1.0)
    assert back[3:] == [None, None, None]


def test_between_times(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    df = spark.createDataFrame([(1, day(2), day(1), day(3)), (2, day(5), day(1), day(3))], "id int, x timestamp_ntz, lo timestamp_ntz, hi timestamp_ntz")
    assert verdicts(df, Between("x", "lo", "hi")) == [True, False]
    rule = Between("x", day(1), day(9), low_is_scalar=True, high_is_scalar=True).fit(df)
    back = rows(rule.reverse(rule.transform(df)).select("id", "x"), "id")
    assert all(abs((b[1] - w).total_seconds()) < 0.01 for b, w in zip(back, [day(2), day(5)]))
    with pytest.raises(ValueError):
        Between("x", 1, 2).fit(df)


def test_rounding(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0.5, 1.5, 2.5, 2.675, 0.125, 1.005, None])], "id int, x double")
    assert [r[1] for r in rows(Rounding("x", 0).reverse(df), "id")] == [0.0, 2.0, 2.0, 3.0, 0.0, 1.0, None]
    assert [r[1] for r in rows(Rounding("x", 2).reverse(df), "id")] == [0.5, 1.5, 2.5, 2.68, 0.12, 1.0, None]
    assert verdicts(df, Rounding("x", 1)) == [True, True, True, False, False, True, False]
    assert [r[1] for r in rows(Rounding("x", -1).reverse(df), "id")] == [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, None]
    with pytest.raises(ValueError):
        Rounding("x", 16)
    with pytest.raises(ValueError):
        Rounding("x", 2, tolerance=0.01)


def test_one_hot(spark):
    data = [(1, 1.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0), (3, 1.0, 1.0, 0.0), (4, 0.5, 0.5, 0.0), (5, None, 1.0, 0.0), (6, None, None, None)]
    df = spark.createDataFrame(data, "id int, a double, b double, c double")
    rule = OneHot(["a", "b", "c"])
    assert verdicts(df, rule) == [True, False, False, False, True, False]
    won = [r[1:] for r in rows(rule.reverse(df.filter("id < 5")), "id")]
    assert won == [(1.0, 0.0, 0.0), (1.0, 0.0, 0.0), (1.0, 0.0, 0.0), (1.0, 0.0, 0.0)]


def test_one_hot_fill(spark):
    data = [(float(i % 3 == 0), float(i % 3 == 1), float(i % 3 == 2)) for i in range(90)]
    rule = OneHot(["a", "b", "c"]).fit(spark.createDataFrame(data, "a double, b double, c double"))
    conds = spark.createDataFrame([(i, float(i < 5)) for i in range(40)], "id long, a double")
    filled = rule.fill(conds, seed=3, id_col="id")
    assert filled.filter(rule.valid(filled)).count() == 40
    drawn = filled.filter("a = 0").groupBy().sum("b", "c").first()
    assert drawn[0] > 3 and drawn[1] > 3
    with pytest.raises(ValueError, match="zeros and ones"):
        rule.fill(spark.createDataFrame([(0.5, 0.0)], "a double, b double"))
    with pytest.raises(ValueError, match="more than one"):
        rule.fill(spark.createDataFrame([(1.0, 1.0)], "a double, b double"))


def test_unique_keeps_the_first_row_and_refuses_null_keys(spark):
    data = [(1, "a", 1), (2, "a", 1), (3, "a", 2), (4, None, 1), (5, None, 1), (6, "b", 1)]
    df = spark.createDataFrame(data, "id int, x string, y int")
    rule = Unique(["x", "y"], "id")
    assert verdicts(df, rule) == [True, False, True, False, False, True]
    assert [r[0] for r in rows(rule.filter_valid(df), "id")] == [1, 3, 6]


def test_unique_combinations_with_nulls(spark):
    seen = spark.createDataFrame([("a", 1), ("a", 1), (None, 2), ("b", None)], "x string, y int")
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, None, 2), (4, "b", None), (5, None, None)], "id int, x string, y int")
    rule = UniqueCombinations(["x", "y"], handling="all")
    with pytest.raises(NotFittedError):
        rule.flag(df)
    rule.fit(seen)
    assert rule.table.count() == 3
    assert verdicts(df, rule) == [True, False, True, True, False]
    coded = rule.transform(df)
    assert [r[1] is None for r in rows(coded.select("id", "x#y"), "id")] == [False, True, False, False, True]
    back = rows(rule.reverse(coded).select("id", "x", "y"), "id")
    assert back == [(1, "a", 1), (2, None, None), (3, None, 2), (4, "b", None), (5, None, None)]
    assert [r[0] for r in rows(rule.filter_valid(df), "id")] == [1, 3, 4]
    with pytest.raises(ValueError):
        UniqueCombinations(["x"])


def test_combination_names_avoid_clashes(spark):
    df = spark.createDataFrame([("a", 1, 2)], ["x", "y", "x#y"])
    assert UniqueCombinations(["x", "y"]).fit(df).joint == "x##y"


def test_formula(spark):
    df = spark.createDataFrame([(1, 2.0, 4.0), (2, 2.0, 5.0), (3, None, None), (4, 1.0, None)], "id int, a double, b double")
    rule = ColumnFormula("b", "a * 2")
    assert verdicts(df, rule) == [True, False, True, False]
    assert verdicts(df, ColumnFormula("b", lambda d: d["a"] * 2)) == [True, False, True, False]
    assert rule.transform(df).columns == ["id", "a"]
    assert ColumnFormula("b", "a * 2", drop_column=False).transform(df).columns == ["id", "a", "b"]
    assert [r[2] for r in rows(rule.reverse(rule.transform(df)), "id")] == [4.0, 4.0, None, 2.0]


def test_custom(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, -1.0, 2.0)], "id int, a double, b double")
    rule = Custom(["a", "b"], lambda c: c + 1, lambda c: c - 1, lambda c: c > 0)
    assert verdicts(df, rule) == [True, False]
    assert rows(rule.transform(df), "id") == [(1, 2.0, 3.0), (2, 0.0, 3.0)]
    order = []
    noted = Custom(["a", "b"], reverse=lambda d, c: order.append(c) or d)
    noted.reverse(df)
    assert order == ["b", "a"]
    whole = Custom(is_valid=lambda d: d["a"] < d["b"], transform=lambda d: d.drop("b"))
    assert whole.transform(df).columns == ["id", "a"]
    assert verdicts(df, whole) == [True, True]


def test_handling(pairs):
    only_filter = GreaterThan("low", "high", handling="reject_sampling").fit(pairs)
    assert only_filter.transform(pairs) is pairs and only_filter.rebuilds == ()
    assert only_filter.filter_valid(pairs).count() == 5
    only_code = GreaterThan("low", "high").fit(pairs)
    assert only_code.filter_valid(pairs) is pairs
    both = GreaterThan("low", "high", handling="all").fit(pairs)
    assert both.filter_valid(pairs).count() == 5 and "high#low" in both.transform(pairs).columns


def test_order_and_conflicts():
    checks, codes = Unique("a", "id"), GreaterThan("a", "b")
    assert prepare([codes, checks]) == [checks, codes]
    with pytest.raises(ValueError, match="two constraints"):
        prepare([Between("b", 0, 1), GreaterThan("a", "b")])
    prepare([Between("b", 0, 1), GreaterThan("a", "b", handling="reject_sampling")])


def test_unique_judges_only_what_earlier_filters_kept(spark):
    df = spark.createDataFrame([(1, "a", -1.0), (2, "a", 1.0)], "id int, x string, v double")
    positive = Positive("v", handling="reject_sampling").fit(df)
    assert [r[0] for r in rows(filter_valid(df, [positive, Unique("x", "id")]))] == [2]
    assert rows(filter_valid(df, [Unique("x", "id"), positive])) == []


def test_missing_columns(pairs):
    chain = [GreaterThan("low", "high").fit(pairs)]
    with pytest.warns(UserWarning), pytest.raises(MissingConstraintColumnError):
        transform_all(pairs.select("low"), chain)
    with pytest.warns(UserWarning):
        assert transform_all(pairs.select("id", "low"), chain, "drop").columns == ["id"]
    with pytest.raises(ValueError):
        transform_all(pairs, chain, "other")
    assert reverse_all(pairs, []).columns == pairs.columns


def test_audit_and_error(pairs):
    found = {r["name"]: r["invalid"] for r in constraint_audit(pairs, {
        "gt": GreaterThan("low", "high"), "u": Unique("high", "id"), "skipped": Between("absent", 0, 1)}).collect()}
    assert found == {"gt": 1, "u": 4}
    with pytest.raises(ConstraintsNotMetError) as e:
        assert_constraints(pairs, [GreaterThan("low", "high")])
    assert list(e.value.counts.values()) == [1]


class Even(Constraint):
    def __init__(self, column):
        self.column = column
        super().__init__("reject_sampling")

    def valid(self, df):
        return df[self.column] % 2 == 0


def test_user_constraints_by_name(pairs):
    rule = Constraint.from_dict({"constraint": "Even", "column": "id"})
    assert verdicts(pairs, rule) == [False, True, False, True, False, True]
    assert rule.to_dict() == {"constraint": "Even", "column": "id"}
    again = Constraint.from_dict(Between("x", 0, 1, strict=True).to_dict())
    assert again.strict and again.high == 1
    assert isinstance(Constraint.from_dict({"constraint": "rowloom.Positive", "columns": "id"}), Positive)
