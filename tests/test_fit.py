"""How often a fit reads its input, and how many blocks a label search opens."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from rowloom import Between, ConstraintsNotMetError, GreaterThan, Synthesizer, UniqueCombinations
from rowloom.operators.labels import PivotIndex, _unit, nearest_labels
from rowloom.operators.mixture import number_ranges
from rowloom.operators.summary import write_observed
from rowloom.operators.validate import discrete_columns


def counted(spark, df):
    """The same rows and an accumulator that counts the partitions read."""
    read = spark.sparkContext.accumulator(0)

    def passing(batches):
        read.add(1)
        yield from batches

    return df.mapInArrow(passing, df.schema), read


@pytest.fixture(scope="module")
def trips(spark):
    return spark.createDataFrame(
        [(("north", "south", "south")[n % 3], ("bus", "car")[n % 2], f"p{n % 2}", n % 2, n % 40, n % 40 + 1 + n % 7, (n**0.5) / 3) for n in range(4000)],
        "zone string, kind string, park string, paid int, start int, finish int, dist double",
    ).repartition(4)


def test_a_fit_reads_its_input_a_few_times(spark, trips):
    df, read = counted(spark, trips)
    parts = df.rdd.getNumPartitions()
    read.value = 0
    rules = [GreaterThan("start", "finish", drop="high"), Between("dist", 0.0, 30.0), UniqueCombinations(["kind", "park"])]
    rules[2].fit(trips)
    profile = Synthesizer("zone", constraints=rules).fit(df)
    assert profile.rows == 4000 and read.value <= 3 * parts
    rows = profile.sample(300, seed=1).collect()
    assert all(r["start"] <= r["finish"] and (r["kind"], r["park"]) in {("bus", "p0"), ("car", "p1")} for r in rows)


def test_a_plain_fit_reads_its_input_once(spark, trips):
    df, read = counted(spark, trips)
    parts = df.rdd.getNumPartitions()
    read.value = 0
    Synthesizer("zone").fit(df)
    assert read.value <= 2 * parts


def test_what_is_seen_while_writing(spark, trips):
    rows, seen = write_observed(trips, {})
    assert seen.rows == 4000 == rows.count()
    assert [c for c in trips.columns if seen.discrete(c)] == discrete_columns(trips)
    found = number_ranges(trips, ["start", "dist"])
    assert {c: seen.range(c) for c in found} == found
    assert seen.numeric("dist")[1:] == [0.0, found["dist"][4], seen.numeric("dist")[3]] and seen.numeric("start")[3] == 0


def test_broken_rows_stop_a_fit(trips):
    with pytest.raises(ConstraintsNotMetError, match="GreaterThan"):
        Synthesizer("zone", constraints=[GreaterThan("finish", "start")]).fit(trips)


@pytest.fixture(scope="module")
def clusters(spark):
    """Twenty well separated groups of similar vectors."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    data = [(f"s{i:04d}", (centres[i % 20] + 0.02 * rng.normal(size=16)).tolist()) for i in range(2000)]
    asked = [(f"q{i:03d}", (centres[i % 20] + 0.02 * rng.normal(size=16)).tolist()) for i in range(100)] + [("zero", [0.0] * 16)]
    make = lambda rows: spark.createDataFrame(rows, "key string, embedding array<double>")
    return data, asked, make(data), make(asked)


def test_a_search_opens_few_blocks(clusters):
    data, asked, seen, unseen = clusters
    index = PivotIndex(seen, 20)
    assert len(index.pivots) == 100
    queries = unseen.filter("key <> 'zero'")
    index.search(queries, 5)
    opened = sum(o.count() for o in index.opened)
    assert opened < 0.35 * 100 * 100  # of all pairs of a query and a pivot


@pytest.mark.parametrize("block", [20, 300, 5000])
def test_a_search_is_exact(clusters, block):
    data, asked, seen, unseen = clusters
    unit = lambda rows: np.array([v for _, v in rows]) / np.maximum(np.linalg.norm([v for _, v in rows], axis=1, keepdims=True), 1e-300)
    close = unit(asked) @ unit(data).T
    want = {}
    for (key, _), row in zip(asked, close):
        order = sorted(range(len(data)), key=lambda j: (-row[j], data[j][0]))[:5]
        want[key] = [round(float(row[j]), 9) for j in order]
    got = {}
    for r in nearest_labels(unseen, seen, 5, block).orderBy("key", "rank").collect():
        got.setdefault(r["key"], []).append(round(r["similarity"], 9))
    assert got == want


def test_opened_blocks_are_sent_in_bounded_batches():
    """Queries that open every block do not lay out all their copies at once."""
    rng, every = np.random.default_rng(3), 400
    vectors = lambda n: rng.normal(size=(n, 8))

    class Asked:
        def mapInArrow(self, opening, schema):
            return opening

    index = object.__new__(PivotIndex)
    index.shared, index.count, index.radius = SimpleNamespace(value=_unit(vectors(every))), np.ones(every, int), np.full(every, np.pi)
    asked = pa.record_batch({
        "key": pa.array([str(i) for i in range(500)]), "embedding": pa.array(vectors(500).tolist()), "bound": pa.array([np.pi] * 500),
    })
    sent = list(index._opening(Asked(), 3)([asked]))
    assert max(b.num_rows for b in sent) <= 8192
    met = {(k, p) for b in sent for k, p in zip(b.column("key").to_pylist(), b.column("pivot").to_pylist())}
    assert len(met) == sum(b.num_rows for b in sent) == 500 * (every - 3)
