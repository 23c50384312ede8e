"""Count-min sketches: point estimates and merging."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from rillcube.functions import loghist

ITEMS = [("", 3), ("a", 5), ("abc", 1), ("abcd", 2), ("\u00e9t\u00e9-\u4e2d\u6587", 7), *[(f"http://x.test/{i}", 1 + i % 4) for i in range(3000)]]


def test_estimates_are_those_of_spark(spark):
    rows = spark.createDataFrame(ITEMS, "url string, times int").select("url", F.explode(F.sequence(F.lit(1), "times")).alias("i"))
    whole = bytes(rows.agg(loghist.count_min(F.col("url")).alias("s")).first()["s"])
    sketch = spark._jvm.org.apache.spark.util.sketch.CountMinSketch.readFrom(whole)
    parts = rows.groupBy("i").agg(loghist.count_min(F.col("url")).alias("s"))
    exact = rows.groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    got = {r["url"]: (r["n"], r["estimate"]) for r in loghist.count_min_estimate(exact, "url", loghist.count_min_cells(parts, [], "s")).collect()}
    assert {u: n for u, (n, _) in got.items()} == dict(ITEMS)
    assert all(n <= e for n, e in got.values())
    assert all(sketch.estimateCount(u) == got[u][1] for u in list(got)[::20] + [u for u, _ in ITEMS[:5]])


def test_query_bounds(spark, data):
    got = entry.queries()["cm_point_estimate"](spark, data).collect()
    total = sum(r["requests"] for r in got)
    assert got and all(r["requests"] <= r["estimate"] for r in got)
    assert sum(r["estimate"] > r["requests"] + 0.001 * total for r in got) <= 0.01 * len(got)
