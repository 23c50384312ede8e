import random
from datetime import datetime, timedelta, timezone
from statistics import median_low

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rillcube.operators.lateness import adjust, period_multiset, period_results, split_late
from rillcube.streaming.windows import PeriodStore

ZERO = datetime(2013, 1, 1, tzinfo=timezone.utc)
SCHEMA = "tuple_id bigint, site string, time timestamp, arrival_time timestamp, v int, usable int, beyond int, c0 int"


def made(n=600):
    random.seed(9)
    out, clock = [], 0.0
    for i in range(n):
        clock += random.choice([0, 0, 1, 7, 30])
        at = clock - random.choice([0, 1, 400, 900, 1500, 5000, -20])
        out.append((i, random.choice(["a", "a", "b", None]), None if i % 50 == 0 else ZERO + timedelta(seconds=at), None if i % 97 == 0 else ZERO + timedelta(seconds=clock), random.choice([None, 1, 2, 9]), 0, 1, 2))
    random.shuffle(out)
    return [*out, *[(r[0] + n, *r[1:]) for r in out[:30]]]


def brute(table, period=300, lateness=600):
    beyond, usable = set(), set()
    for site in {r[1] for r in table}:
        mark = None
        for r in sorted((r for r in table if r[1] == site and r[3] is not None), key=lambda r: (r[3], r[0])):
            if r[2] is None or r[2] > r[3]:
                continue
            usable.add(r[0])
            at = (r[2] - ZERO).total_seconds()
            if mark is not None and (at // period + 1) * period <= mark - lateness:
                beyond.add(r[0])
            mark = at if mark is None else max(mark, at)
    return usable - beyond, beyond


@pytest.mark.parametrize("period, lateness", [(300, 600), (60, 90), (600, 0)])
def test_cut_off(spark, period, lateness):
    table = made()
    df = spark.createDataFrame(table, SCHEMA)
    in_time, beyond = split_late(df, period=period, lateness=lateness)
    want_in, want_beyond = brute(table, period, lateness)
    assert {r[0] for r in in_time.select("tuple_id").collect()} == want_in
    assert {r[0] for r in beyond.select("tuple_id").collect()} == want_beyond and want_beyond
    assert beyond.columns == df.columns
    assert [x.count() for x in split_late(df.where("false"))] == [0, 0]


def test_multiset_is_corrected(spark):
    table = made()
    df = spark.createDataFrame(table, SCHEMA).where("time is not null")
    first, late = df.where("tuple_id % 4 <> 0"), df.where("tuple_id % 4 = 0")
    state = lambda x: period_multiset(x, F.col("v"), F.lit(2))
    corrected = adjust(state(first), state(late))
    assert rows(corrected) == rows(state(df))
    back = adjust(corrected, state(late).withColumns({"n": -F.col("n"), "s_total": -F.col("s_total")}))
    assert rows(back) == rows(state(first))
    got = {r["period"]: r for r in period_results(corrected, [0.5]).collect()}
    periods = {}
    for r in table:
        if r[2] is not None:
            periods.setdefault(int(r[2].timestamp() // 300 * 300), []).append(r[4])
    assert set(got) == set(periods)
    for p, vs in periods.items():
        known = sorted(v for v in vs if v is not None)
        r = got[p]
        assert (r["rows"], r["total"], r["distinct_values"]) == (len(vs), 2 * len(vs), len(set(known)))
        assert (r["min_value"], r["max_value"], r["p50"]) == ((known[0], known[-1], median_low(known)) if known else (None, None, None))


def test_store_over_batches(spark, tmp_path):
    """Micro-batches in the order of arrival give what one batch gives, and a repeated batch changes nothing."""
    table = sorted((r for r in made(200) if r[3] is not None), key=lambda r: (r[3], r[0]))
    df = spark.createDataFrame(table, SCHEMA)
    bounds = sorted({r[3] for r in table})
    cut = bounds[len(bounds) // 2]
    store = PeriodStore(spark, str(tmp_path / "store"), F.col("v"), F.lit(1))
    store.take(df.where(F.col("arrival_time") < F.lit(cut)), 0)
    store.take(df.where(F.col("arrival_time") >= F.lit(cut)), 1)
    store.take(df.where(F.col("arrival_time") >= F.lit(cut)), 1)
    in_time, beyond = split_late(df)
    assert rows(store.beyond().select("tuple_id")) == rows(beyond.select("tuple_id"))
    assert rows(store.state()) == rows(period_multiset(in_time, F.col("v"), F.lit(1)))
    assert store.results().count() > 0
