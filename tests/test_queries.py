"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

import duckdb
import pytest

import camwatch.plans as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("" if x != x or x is None else str(x).removesuffix(".0") for x in r) for r in frame.astype(object).where(frame.notna(), None).values.tolist())


@pytest.mark.parametrize("name", sorted(plans.all_sql()))
def test_same_rows(spark, duck, name):
    got, want = plans.all_queries()[name](spark, SF).toPandas(), duck.sql(plans.all_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(plans.all_queries()) == set(plans.all_sql())


@pytest.mark.parametrize("name", ["w24_event_phase", "w25_apply_review_flags"])
def test_equal_times_as_in_the_sql(spark, tmp_path, name):
    c = duckdb.connect()
    c.sql(f"copy (select * replace (date_trunc('day', ts) as ts) from '{SF}/events.parquet' order by event_id) to '{tmp_path}/events.parquet'")
    c.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    assert rows(plans.all_queries()[name](spark, str(tmp_path)).toPandas()) == rows(c.sql(plans.all_sql()[name]).df())


def test_the_plan_with_requests_that_wait(spark, tmp_path):
    """Events 40,000 times as dense, so that queues fill, overflow and drain."""
    c = duckdb.connect()
    c.sql(f"copy (select * replace (make_timestamp(epoch_us(ts) // 40000) as ts) from '{SF}/events.parquet' order by event_id) to '{tmp_path}/events.parquet'")
    c.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    got, want = plans.all_queries()["q11_notification_plan"](spark, str(tmp_path)).toPandas(), c.sql(plans.all_sql()["q11_notification_plan"]).df()
    assert {"sent", "queued", "overflow", "dropped"} == set(want["outcome"])
    assert rows(got) == rows(want)
