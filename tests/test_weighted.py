import math
import random
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rillcube.operators.weighted import at_place, combine_counts, key_totals, percentiles, value_counts

P = [0.0, 0.25, 0.5, 0.9, 1.0]


def made(n=3000):
    random.seed(3)
    out = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else random.choice(["a", "b", None])
        out.append((key, random.choice([None, -5, 0, random.randrange(-9000, 70_000), 7]), random.choice([None, 1, 2]), i))
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(made(), "k string, v int, w int, value int")


def counts_of(df):
    return value_counts(df, {"k": F.col("k")}, F.col("v"), {"w": F.coalesce("w", F.lit(1))})


def groups():
    out = {}
    for k, v, w, _ in made():
        out.setdefault(k, []).append((v, 1 if w is None else w))
    return out


def test_totals(table):
    got = {r["k"]: r for r in key_totals(counts_of(table), value_sum="v_total").collect()}
    assert set(got) == {"hot", "a", "b", None}
    for k, vs in groups().items():
        known = [v for v, _ in vs if v is not None]
        top = max(Counter(known).values())
        r = got[k]
        assert (r["rows"], r["w"], r["distinct_values"], r["v_total"]) == (len(vs), sum(w for _, w in vs), len(set(known)), sum(known))
        assert (r["mode_rows"], r["mode_value"]) == (top, min(v for v, n in Counter(known).items() if n == top))


@pytest.mark.parametrize("bits", [2, 12, 31])
def test_percentiles(table, bits):
    got = {(r["k"], r["p"]): (r["value"], r["rows"]) for r in percentiles(counts_of(table), P, bits).collect()}
    for k, vs in groups().items():
        known = sorted(v for v, _ in vs if v is not None)
        for p in P:
            assert got[k, p] == (known[max(1, math.ceil(p * len(known))) - 1], len(known))


def test_place_and_combination(table):
    parts = [counts_of(table.where(F.col("value") % 3 == i)) for i in range(3)]
    whole, combined = counts_of(table), combine_counts(*parts)
    assert rows(whole.select("k_k", "value", "n", "s_w")) == rows(combined.select("k_k", "value", "n", "s_w"))
    got = {(r["k"], r["p"]): r["value"] for r in percentiles(combined, [0.6, 1.0], rank=at_place).collect()}
    for k, vs in groups().items():
        known = sorted(v for v, _ in vs if v is not None)
        assert got[k, 0.6] == known[int(len(known) * 0.6)] and got[k, 1.0] == known[-1]


def test_empty_and_valueless(spark, table):
    assert percentiles(counts_of(table.where("false")), P).count() == 0
    assert key_totals(counts_of(table.where("false"))).count() == 0
    none = spark.createDataFrame([("x", None, 1, 1)], "k string, v int, w int, value int")
    assert percentiles(counts_of(none), P).count() == 0
    r = key_totals(counts_of(none)).first()
    assert (r["rows"], r["distinct_values"], r["mode_value"]) == (1, 0, None)
    assert percentiles(value_counts(table, {}, F.col("v")), [0.5]).count() == 1
