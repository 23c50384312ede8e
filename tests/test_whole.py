"""Queries without a time window keep what has no time."""

import datetime as dt

import pytest
from conftest import rows

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("whole"))
    at = dt.datetime(2024, 1, 1, 0, 0, 7)
    made = [
        (1, "a", 1, at, "http://x.test/1.js", 200, 2, 100, 1, at),
        (2, "a", 2, None, "http://x.test/1.js", 404, 5, 90000, 1, at),
        (3, "b", 3, None, "http://y.test/2.js", 200, None, 300, 1, at),
    ]
    columns = "tuple_id long, site string, version long, time timestamp, url string, response_code int, count int, avg_size_sum int, avg_size_count int, arrival_time timestamp"
    spark.createDataFrame(made, columns).write.parquet(f"{folder}/web_requests.parquet")
    return folder


WANT = {
    "agent_counts": [("http://x.test/1.js", 2), ("http://y.test/2.js", 1)],
    "exact_topk": [("http://x.test/1.js", 7), ("http://y.test/2.js", 1)],
    "tput_topk": [("http://x.test/1.js", 7), ("http://y.test/2.js", 1)],
    "slow_requests": [(2, "http://x.test/1.js")],
    "anomalous_requests": [(2, "http://x.test/1.js", 90000)],
    "dist_grep_count": [("a", 2), ("b", 1)],
    "bad_domains": [("x.test", 5)],
    "cube_version_max": [("a", 2, 2), ("b", 1, 3)],
    "quantiles_by_code": [(200, 300, 2), (404, 90000, 1)],
}


@pytest.mark.parametrize("name", WANT)
def test_rows_without_time_count(spark, small, name):
    assert rows(entry.queries()[name](spark, small)) == WANT[name]


def test_leaf_cells_without_time(spark, small):
    assert rows(entry.queries()["cube_leaf_web"](spark, small).select("time", "count")) == [(1704067207, 2), (None, 1), (None, 5)]


def test_time_windows_need_a_time(spark, small):
    assert rows(entry.queries()["windowed_topk"](spark, small).select("key", "total")) == [("http://x.test/1.js", 2)]
