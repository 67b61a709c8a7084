"""Every query against its SQL, and the plans of the flagship."""

import duckdb
import pytest

from skillgrid.plans import catalogue

from .duck import connect, same


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, sf_dir, con, name):
    same(catalogue.QUERIES[name](spark, sf_dir), con, catalogue.ORACLES[name])


def test_valid_times_outside_years_of_four_digits(spark, tmp_path):
    con, path = duckdb.connect(), tmp_path / "events.parquet"
    ids = "[NULL, 0, 2921881, 2921882, 5999999, 100000000, -730000, -730543, -730544, -740000, -5000000]"
    con.execute(f"COPY (SELECT i::BIGINT AS event_id, 1::BIGINT AS user_id, TIMESTAMP '2024-01-01 12:34:56.789' + to_days(greatest(0, i)) AS ts, 1.0 AS value FROM unnest({ids}) AS u(i)) TO '{path}'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}'")
    same(catalogue.QUERIES["valid_time_units"](spark, str(tmp_path)), con, catalogue.ORACLES["valid_time_units"])


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_time_range_reaches_the_scan(spark, sf_dir):
    assert "PushedFilters: [IsNotNull(ts), IsNotNull(user_id), GreaterThanOrEqual(ts" in _plan(catalogue.QUERIES["time_slice_bbox"](spark, sf_dir))


def test_flagship_reads_few_columns_and_has_no_nested_loops(spark, sf_dir):
    plan = _plan(catalogue.QUERIES["event_probability"](spark, sf_dir))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "l_comment" not in plan and "l_discount" not in plan.split("Physical Plan")[1]


def test_skill_sums_points_before_they_move(spark):
    from skillgrid.operators.verification import rank_skill

    rows = spark.createDataFrame([("a", 0.1, 0.0), ("a", 0.2, 1.0)], "cell string, probability double, observed double")
    plan = _plan(rank_skill(rows, ["cell"])).split("Physical Plan")[1]
    assert "functions=[partial_count(1)" in plan and "collect_list" not in plan


def test_temperature_panels_read_each_table_once(spark, sf_dir):
    plan = catalogue.QUERIES["temperature_panels"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_") == 1 and plan.count("Relation [o_") == 1
