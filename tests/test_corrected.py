"""Period results before and after late rows correct them, over a whole table."""

import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rillcube.operators import lateness


def test_late_rows_correct_totals_and_medians(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    made = [
        (1, "a", at(10), 1, 100, at(20)),
        (2, "a", at(20), 2, 100, at(30)),
        (3, "a", at(30), 9, 5, at(300)),  # as the period ends: late
        (4, "a", at(40), 9, 7, at(400)),
        (5, "a", at(310), 4, 1, at(700)),  # a period with late rows only
        (6, "a", at(2000), 3, 1, at(2001)),
        (7, "a", at(50), 50, 1, at(2100)),  # beyond the cut-off
        (8, "a", None, 50, 1, at(2200)),
    ]
    columns = "tuple_id long, site string, time timestamp, count int, avg_size_sum int, arrival_time timestamp"
    spark.createDataFrame(made, columns).write.parquet(f"{tmp_path}/web_requests.parquet")
    got = entry.queries()["p6_corrected_totals"](spark, str(tmp_path))
    zero = 1704067200
    assert rows(got.select("period", "rows_before", "size_before", "p50_before", "rows", "size_total", "p50")) == [
        (zero, 2, 200, 1, 4, 212, 2),
        (zero + 300, None, None, None, 1, 1, 4),
        (zero + 1800, 1, 1, 3, 1, 1, 3),
    ]


def test_corrections_are_an_adjustment(spark, data):
    df = spark.read.parquet(f"{data}/web_requests.parquet")
    found = lateness.corrected_periods(df, F.coalesce("count", F.lit(1)), F.coalesce("avg_size_sum", F.lit(0)))
    assert rows(lateness.adjust(found.early, found.late)) == rows(found.corrected)
    assert found.late.count() > 0
