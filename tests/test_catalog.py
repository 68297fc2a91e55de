"""Every query against its SQL on the small tables, and rules about the plans."""

import pytest
from conftest import SMALL, plan_of

import __spark_entry__ as entry
from catalog import ORACLES, QUERIES
from catalog.compare import connect, difference


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_entry_offers_all_queries():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_only_random_fits_have_no_sql():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"e_mixture_fit", "g_complete_conditions"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    assert len(got)
    if name in ORACLES:
        assert difference(got, duck.execute(ORACLES[name]).df()) is None


@pytest.mark.parametrize("name", ["c_filter_chain", "c_transform_chain", "e_mixture_transform", "f_joint_freq", "e_encode_row", "g_topup", "f_draw_category"])
def test_plans_stay_in_the_jvm_without_nested_loops(spark, name):
    text = plan_of(QUERIES[name](spark, SMALL))
    assert "Python" not in text and "Pandas" not in text
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert "SinglePartition" not in text


def test_csv_text_is_written_by_as_many_tasks_as_read_it(spark, tmp_path, monkeypatch):
    from catalog import sources

    docs = spark.range(400).selectExpr("id AS doc_id", "concat('a,b', id, '\"') AS text", "'en' AS lang", "'web' AS source", "5L AS n_chars")
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    plain, tasks = sources.write_rows, []
    monkeypatch.setattr(sources, "write_rows", lambda df, path: (tasks.append(df.rdd.getNumPartitions()), plain(df, path)))
    got = QUERIES["s_csv_text"](spark, str(tmp_path))
    assert got.count() == 400 and len(tasks) == 2 and min(tasks) >= 4
