from collections import Counter

from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillcube.operators.once import first_deliveries

SCHEMA = "site string, version int, tie int, may_repeat string, w0 int"


def brute(made):
    best = {}
    for r in made:
        key = (r[0], r[1]) if r[0] is not None and r[1] is not None else ("", r[2], "")
        if key not in best or r[2] < best[key][2]:
            best[key] = r
    return sorted(best.values(), key=repr)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from([1, 2, 3, None])), max_size=30), st.sampled_from([10, 27]))
def test_as_brute_force(spark, keys, bits):
    made = [(s, v, i, f"x{i}", None) for i, (s, v) in enumerate(keys)]
    df = spark.createDataFrame(made, SCHEMA).repartition(3)
    got = first_deliveries(df, ["site", "version"], "tie", bits)
    assert got.columns == df.columns and rows(got) == brute(made)


def test_shared_bits_and_hot_keys(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("tie"))
    for bits in (9, 12, 27):  # with few bits most keys share one
        got = first_deliveries(df, ["k"], "tie", bits)
        found = [r["tie"] for r in got.collect()]
        assert len(found) == len(set(found)) == 13_333 + 1 and min(found) == 0


def test_empty(spark):
    assert first_deliveries(spark.createDataFrame([], SCHEMA), ["site", "version"], "tie").count() == 0


def test_only_repeats_are_shuffled(spark):
    df = spark.range(5000).select("id", F.lit("x" * 50).alias("body"))
    plan = first_deliveries(df.unionByName(df.where("id < 5")), ["id"], "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") and Counter(w in plan for w in ("BroadcastHashJoin",))[True]
