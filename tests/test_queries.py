"""Every registered query against its SQL, and the plans of the heavy ones."""

from __future__ import annotations

from pathlib import Path

import pytest

import oracle
from tagtide.catalogue import QUERIES

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@needs_tables
@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    df = QUERIES[name].run(spark, SF_DIR)
    # No Python workers, and no join that pairs all rows.
    plan = physical_plan(df)
    assert not [word for word in ("EvalPython", "MapInPandas", "CartesianProduct", "NestedLoop") if word in plan]
    assert QUERIES[name].sql is not None
    assert oracle.difference(df, QUERIES[name].sql, con) is None


def physical_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@needs_tables
def test_rank_limit_runs_before_the_shuffle(spark):
    plan = physical_plan(QUERIES["first_use_rank_n"].run(spark, SF_DIR))
    assert "Partial" in plan[plan.rindex("Exchange") :] or plan.count("WindowGroupLimit") >= 4


@needs_tables
def test_scans_read_only_the_columns_they_need(spark):
    plan = physical_plan(QUERIES["weekly_counts"].run(spark, SF_DIR))
    assert "ReadSchema: struct<o_orderdate:timestamp_ntz,o_orderpriority:string>" in plan


@needs_tables
def test_filters_reach_the_scan(spark):
    plan = physical_plan(QUERIES["wide_series_in_range"].run(spark, SF_DIR))
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(o_orderdate" in plan


@needs_tables
def test_result_does_not_depend_on_the_number_of_partitions(spark):
    def result(name):
        df = QUERIES[name].run(spark, SF_DIR)
        return oracle.sorted_rows(df.columns, df.collect())

    names = ("first_use_rank_n", "cumulative_with_baseline", "vector_index")
    several = {name: result(name) for name in names}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert {name: result(name) for name in names} == several
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@needs_tables
@pytest.mark.parametrize(
    ("name", "base"),
    [
        ("adoption_table", "events"),
        ("early_appearance_frame", "events"),
        ("cumulative_with_baseline", "events"),
        ("post_series_only", "lineitem"),
        ("multi_value_label_counts", "customer"),
        ("stemmed_tokens", "documents"),
    ],
)
def test_base_tables_are_read_twice_at_most(spark, name, base):
    """Scans of the final plan; those of stored intermediate results read other files."""
    df = QUERIES[name].run(spark, SF_DIR)
    scans = sum("FileScan" in line and f"{base}.parquet" in line for line in physical_plan(df).split("\n"))
    assert 1 <= scans <= (3 if name == "cumulative_with_baseline" else 2)
