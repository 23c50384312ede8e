"""The percentiles per five seconds and code, and the level that fits a budget."""

import datetime as dt

from conftest import rows

import __spark_entry__ as entry


def test_percentiles_of_size_and_delay(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    made = [(at(1), 200, 10, at(2)), (at(4), 200, None, at(9)), (at(5), 200, 30, at(5)), (at(6), None, 40, at(9)), (None, 200, 50, at(9))]
    spark.createDataFrame(made, "time timestamp, response_code int, avg_size_sum int, arrival_time timestamp").write.parquet(f"{tmp_path}/web_requests.parquet")
    got = entry.queries()["quantiles_by_5s_code"](spark, str(tmp_path))
    zero = 1704067200
    assert rows(got.select("time", "response_code", "size_p95", "delay_p95", "requests")) == [(zero, 200, 10, 5000, 2), (zero + 5, 200, 30, 0, 1), (zero + 5, None, 40, 3000, 1)]


def test_the_finest_level_that_fits(spark, tmp_path):
    made = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), i, "view", 1.0, "{}") for i in range(50)]
    spark.createDataFrame(made, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert entry.queries()["coarsen_to_budget"](spark, str(tmp_path)).count() == 50  # fifty seconds fit as they are
