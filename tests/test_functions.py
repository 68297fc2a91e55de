import itertools
import re
import string

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rowloom.functions.names import fake, keyed_uniform, row_uniform
from rowloom.functions.patterns import capacity, kth_string
from rowloom.functions.random import index_below, normal, uniform


def spelled(spark, pattern, n):
    return [r[0] for r in spark.range(n).select(kth_string(F.col("id"), pattern)).collect()]


@pytest.mark.parametrize("pattern, expected", [
    ("[ab]?c", ["c", "ac", "bc"]),
    (r"\d{2}", [f"{i:02d}" for i in range(100)]),
    ("^[A-B]$", ["A", "B"]),
    ("x+", ["x" * i for i in range(1, 17)]),
    ("[ba]{1,2}z", ["bz", "az", "bbz", "baz", "abz", "aaz"]),
    ("a*", ["a" * i for i in range(17)]),
    ("é[0-1]", ["é0", "é1"]),
])
def test_every_string_of_a_pattern(spark, pattern, expected):
    assert capacity(pattern) == len(expected)
    assert spelled(spark, pattern, len(expected)) == expected


def test_classes_follow_printable_order(spark):
    for c in ("\\s", "\\S", "\\w", "\\W", "\\D"):
        want = [x for x in string.printable if re.match(c, x)]
        assert spelled(spark, c, len(want)) == want
    assert spelled(spark, ".", 100) == list(string.printable)


def test_two_places_against_enumeration(spark):
    want = ["".join(p) for p in itertools.product("abc", "01", "xy")]
    assert spelled(spark, "[a-c][01][xy]", len(want)) == want


def test_default_pattern_is_distinct_far_out(spark):
    assert capacity("[a-zA-Z]+") == sum(52**i for i in range(1, 17))
    ids = F.col("id") * 1_000_000_007_000
    got = [r[0] for r in spark.range(2000).select(kth_string(ids, "[a-zA-Z]+")).collect()]
    assert len(set(got)) == 2000 and got[0] == "a" and all(g.isalpha() for g in got)


@pytest.mark.parametrize("pattern", ["(ab)", "ab|cd", "[^a]", "(?:ab)+"])
def test_refused_patterns(pattern):
    with pytest.raises(ValueError):
        capacity(pattern)


def test_random_numbers_do_not_depend_on_partitions(spark):
    ids = spark.range(5000)
    one = rows(ids.repartition(1).select("id", uniform(1, "s", "id"), normal(1, "s", "id")), "id")
    many = rows(ids.repartition(17).select("id", uniform(1, "s", "id"), normal(1, "s", "id")), "id")
    assert one == many
    assert all(0 < u < 1 for _, u, _ in one)
    assert abs(sum(u for _, u, _ in one) / 5000 - 0.5) < 0.02
    assert abs(sum(z for _, _, z in one) / 5000) < 0.06
    assert abs(sum(z * z for _, _, z in one) / 5000 - 1) < 0.08


def test_index_below_stays_in_range(spark):
    edge = spark.range(1).select(index_below(F.lit(1.0 - 2.0**-53), F.lit(2**51)).alias("k"), index_below(F.lit(2.0**-53), 7).alias("z"))
    assert tuple(edge.first()) == (2**51 - 1, 0)


def test_fake_values(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "v string")
    made = [r[0] for r in df.select(fake("name", keyed_uniform(F.col("v"), "salt"))).collect()]
    assert made[0] == made[2] and len(made[0].split()) == 2
    for category in ("first_name", "last_name", "email", "phone_number", "city", "address", "company", ("numerify", "##-#"), ("random_int", 5, 9)):
        got = spark.range(50).select(fake(category, row_uniform(1, "f", "id"))).collect()
        assert all(r[0] for r in got)
    numbers = [r[0] for r in spark.range(50).select(fake(("numerify", "##-#"), row_uniform(1, "f", "id"))).collect()]
    assert all(re.fullmatch(r"\d\d-\d", n) for n in numbers)
    german = {r[0] for r in spark.range(200).select(fake("first_name", row_uniform(1, "f", "id"), "de_DE")).collect()}
    assert "Bernd" in german or "Greta" in german
    with pytest.raises(ValueError):
        fake("shoe_size", row_uniform(1, "f", "id"))
    with pytest.raises(ValueError):
        fake("name", row_uniform(1, "f", "id"), "xx_XX")
