"""The operators for training data against brute force."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rillcube.llm import frequent, mixing, packing, percentiles, queries, stuffing
from rillcube.llm.tokens import default_path, token_count

SCHEMA = "tuple_id bigint, site string, version bigint, url string, i_val int, summary array<int>, k_url int, value int"


# problem 4


def latency(n=1500):
    random.seed(5)
    out = []
    for i in range(n):
        single = random.choice([None, -1, 0, random.randrange(1, 3_000_000)])
        many = None if single is not None else random.choice([None, [], [random.randrange(5000) for _ in range(4)], [None, -1, 3]])
        out.append((i, random.choice(["s", "t", None]), i, "hot" if i % 3 == 0 else random.choice(["a", None]), single, many, 1, 2))
    return [*out, *[(r[0] + n, *r[1:]) for r in out[:60]]]


def expected(table):
    best = {}
    for r in table:
        key = (r[1], r[2]) if r[1] is not None else ("row", r[0])
        if key not in best or r[0] < best[key][0]:
            best[key] = r
    out = {}
    for r in best.values():
        vs = [v for v in r[5] or [] if v is not None] + ([r[4]] if r[4] not in (None, -1) else [])
        out.setdefault(r[3], []).extend(vs)
    return {k: sorted(v) for k, v in out.items() if v}


@pytest.mark.parametrize("bits", [None, 4, 10])
def test_percentiles_and_error(spark, bits):
    df = spark.createDataFrame(latency(), SCHEMA)
    values = percentiles.measurements(df, {"url": F.col("url"), "site": F.col("site")})
    apart = percentiles.combine(*[percentiles.state(values.where(c), ["url", "site"], bits) for c in ("site = 's'", "site = 't'", "site is null")])
    got = {(r["url"], r["p"]): (r["value"], r["rows"]) for r in percentiles.percentiles(percentiles.roll_up(apart, ["url"]), [0.0, 0.5, 0.99, 1.0]).collect()}
    want = expected(latency())
    assert {k for k, _ in got} == set(want)
    for k, vs in want.items():
        for p in (0.0, 0.5, 0.99, 1.0):
            exact = vs[max(1, int(np.ceil(p * len(vs)))) - 1]
            assert got[k, p][1] == len(vs)
            assert abs(got[k, p][0] - exact) <= (0 if bits is None else abs(exact) * 2.0 ** -(bits + 1))


def test_percentiles_edges(spark):
    df = spark.createDataFrame(latency(), SCHEMA)
    values = percentiles.measurements(df.where("false"), {"url": F.col("url")})
    assert percentiles.percentiles(percentiles.state(values, ["url"]), [0.5]).count() == 0
    cells = spark.range(-5000, 5000).select(F.col("id").alias("v"), percentiles.cell(F.col("id"), 5).alias("c")).collect()
    assert all(abs(r["c"] - r["v"]) <= abs(r["v"]) * 2.0**-6 for r in cells) and len({r["c"] for r in cells}) < 600


# problem 5


def weights(n=5000):
    random.seed(6)
    return [("hot" if i % 3 == 0 else random.choice([None, "", f"u{int(random.paretovariate(1))}", f"é{i}"]), random.choice([None, 0, 1, 5]), "x") for i in range(n)]


@pytest.mark.parametrize("run_rows", [7, 200_000])
def test_heaviest(spark, run_rows):
    df = spark.createDataFrame(weights(), "url string, count int, value string").repartition(5)
    sums = Counter()
    for u, c, _ in weights():
        if u is not None:
            sums[u] += 1 if c is None else c
    want = sorted(sums.items(), key=lambda x: (-x[1], x[0].encode()))[:40]
    got = [(r["value"], r["weight"]) for r in frequent.heaviest(df, "url", "count", 40, run_rows=run_rows).collect()]
    assert got == want
    whole = sum(1 if c is None else c for _, c, _ in weights())
    assert set(rows(frequent.at_least(df, "url", "count", 0.02))) == {(u, n) for u, n in sums.items() if n >= 0.02 * whole}
    assert frequent.heaviest(df, "url", None, 1).first()["value"] == "hot"
    assert frequent.heaviest(df.where("false"), "url", "count", 5).count() == 0
    assert frequent.heaviest(df.where("url is null"), "url", "count", 5).count() == 0


# problem 7


@given(st.lists(st.integers(1, 50), max_size=60))
@settings(max_examples=200, deadline=None)
def test_pack_holds(sizes):
    where, bins = packing.pack(sizes, 50)
    load = Counter()
    for s, b in zip(sizes, where):
        load[b] += s
    assert set(load) == set(range(bins)) and all(v <= 50 for v in load.values())
    assert bins <= 2 * max(1, -(-sum(sizes) // 50)) or not sizes


def test_two_fit_beats_greedy():
    # greedy puts 6 and 3 into a bin of 10; two items of 2 fill the gap that the 3 leaves
    where, _ = packing.pack([6, 3, 2, 2], 10)
    assert where[0] == where[2] == where[3] != where[1]


def test_pack_items(spark):
    random.seed(7)
    sizes = [(i, random.choice([0, 1, 100, 250, random.randrange(1, 3000)])) for i in range(900)] + [(5, 77), (None, 9)]
    df = spark.createDataFrame(sizes, "id bigint, size bigint")
    got = packing.pack_items(df, [("small", 256), ("large", 1024)], 900, shard_items=300).collect()
    for name, capacity in (("small", 256), ("large", 1024)):
        own = [r for r in got if r["container"] == name]
        load, by_id = Counter(), {}
        for r in own:
            load[r["bin"]] += r["size"]
            by_id.setdefault(r["id"], []).append(r)
        assert all(v <= capacity for v in load.values())
        assert sum(load.values()) == sum(s for _, s in sizes)
        assert set(by_id) == {i for i, _ in sizes}
        for i, size in sizes[:900]:
            if i == 5:
                continue
            pieces = sorted(by_id[i], key=lambda r: r["piece"])
            assert [p["first"] for p in pieces] == [k * capacity for k in range(len(pieces))]
            assert all(p["size"] == capacity for p in pieces[:-1]) and len(pieces) == max(1, -(-size // capacity))
        assert sum(load.values()) / (capacity * len(load)) > 0.97
    again = packing.pack_items(df.repartition(3), [("small", 256)], 900, shard_items=300)
    assert set(rows(again)) == {tuple(r) for r in got if r["container"] == "small"}
    assert packing.pack_items(df.where("false"), [("small", 256)], 0).count() == 0


# problem 8


def test_mix(spark):
    random.seed(8)
    data = [(i, random.choice(["Big", "big ", "big", "small-one", "Small_One", "other", None, "gone "]) if i % 3 else "BIG", random.randrange(0, 200), "t", 1) for i in range(6000)]
    df = spark.createDataFrame(data, "id bigint, source string, size bigint, h string, copies int").withColumn("source", mixing.label(F.col("source")))
    records = mixing.hashed(df)
    targets = [mixing.Target("big", 0.5, 1), mixing.Target("small_one", 0.3, 3), mixing.Target("absent", 0.2, 4)]
    sizes = {r["source"]: r["s"] for r in df.groupBy("source").agg(F.sum("size").alias("s")).collect()}
    plans = mixing.make_plan(records, targets)
    got = {r["source"]: r for r in mixing.shares(mixing.take(records, plans), plans).collect()}
    assert abs(got["big"]["actual_share"] - 0.625) < 0.005 and abs(got["small_one"]["actual_share"] - 0.375) < 0.005 and got["absent"]["actual_share"] == 0
    assert all(r["mean_repeats"] <= t.max_repeats for t in targets for r in [got[t.source]])
    taken = mixing.take(records, plans)
    assert taken.agg(F.max("copies")).first()[0] <= 3 and set(r["source"] for r in taken.select("source").distinct().collect()) == {"big", "small_one"}
    half = mixing.take(records, mixing.make_plan(records, targets, 0.5 * sizes["big"]))
    more = mixing.take(records, mixing.make_plan(records, targets, 0.7 * sizes["big"]))
    assert set(rows(half.select("id"))) < set(rows(more.select("id")))
    for p in mixing.make_plan(records, targets, 10.0 * sizes["big"]):
        if p.source != "absent":
            assert (p.repeats, p.threshold) == ({"big": 1, "small_one": 3}[p.source], 0)
    budget = [p for p in mixing.make_plan(records, targets, 0.5 * sizes["big"]) if p.source == "big"][0]
    reached = half.where("source = 'big'").agg(F.sum(F.col("size") * F.col("copies"))).first()[0]
    assert 0 <= budget.budget - reached <= max(200, mixing.TOLERANCE * budget.budget)
    empty = mixing.make_plan(records.where("false"), targets)
    assert mixing.take(records.where("false"), empty).count() == 0 and mixing.shares(mixing.take(records.where("false"), empty), empty).count() == 3


def test_tokens(spark):
    import base64

    import tiktoken

    df = spark.createDataFrame([("Hello world, hello",), ("",), (None,), ("x" * 100_000,)], "text string")
    got = [r["n"] for r in df.select(token_count(F.col("text"), default_path()).alias("n")).collect()]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(default_path(), "rb"))}
    import public_tokenizers

    own = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert got == [len(own.encode_ordinary("Hello world, hello")), 0, 0, len(own.encode_ordinary("x" * 100_000))]


# problem 9

PROSE = [
    "The report lists nine cases in which the key finds the door. Nobody knows why the lamp is so rare.",
    "“The dog sees the hotel,” Sano wrote at midnight. When the coat is green, Tajor waits at home.\nIs the school really free?",
    "1. In Rone, 71 people saw the roof.\n2. The roof costs 4 crowns, but the roof is young.",
    "the lamp is urgent, and the boat follows the horse. nobody knows why.",
    "Das Brot kostet 42 Kronen, aber der Mantel ist riesig. Niemand weiß, warum die Uhr so selten ist.",
    "因为灯很容易，钥匙代替歌。没有人知道为什么马今天这么坚固。",
    "Правда ли, что песня — вещь грустная? Никто не знает, почему сад снова такой.",
    "The bird opens the cloud every morning. See also https://a.test/b for the rest of it.",
    "The cloud is huge. #salt #clock #book",
    "Is the do", "", "   ", "word",
]
LISTS = [
    "best harbor * sale boat * cheap tower * cheap tower * SALE BOAT * best harbor",
    "buy bridge shop\nbuy bridge shop cheap\nshop bridge price\nnew bridge buy",
    "Chair > Law > Cloud (219) > Top > Cart > Lamp > Login",
    "Home  Roof (129)  Top  Next page  Painter  Next page  Garden (356)",
    "<a href=\"http://a.test/x\">bird road</a>\n* <a href=\"www.b.test\">law lamp</a>\n[c d](http://e.test) | f g: www.h.test/i",
    "#shoe #horse #shoe_sale #soup #screw #roof_new #ticket #coat",
    "<b>cloth_new <tag>cheese <tag>tower <li>winter_discount <b>wall",
    "Wald RO/4883 neu\nMarkt RO-4338 761.74\nApfel RO/6443 499.37",
    "Want cheap lamp? price cheap lamp means cheap lamp! Our cheap lamp is the best cheap lamp for cheap lamp friends. Want cheap lamp?",
    "The shoe finds the book, soup, soup buy, soup, cheap soup, soup sale, best soup, soup shop, price soup, buy soup, soup and soup.",
    "便宜面包, 折扣面包新款, 折扣面包, 新款折扣面包, 在线折扣面包, 购买折扣面包",
    "lamp roof lamp roof lamp roof roof lamp lamp roof roof lamp LAMP roof lamp",
]


def test_pages(spark):
    assert [t for t in PROSE if stuffing.is_stuffed(t)] == [] and [t for t in LISTS if not stuffing.is_stuffed(t)] == []
    assert not stuffing.is_stuffed(None)
    long = PROSE[0] + "\n"
    assert not stuffing.is_stuffed(long * 400 + LISTS[0]) and stuffing.is_stuffed(LISTS[0] * 2000 + "\n" + long)
    mixed = long * 2 + LISTS[0]
    assert not stuffing.is_stuffed(mixed) and stuffing.is_stuffed(long + "\n".join([LISTS[0]] * 3))
    df = spark.createDataFrame([(i, t, "page") for i, t in enumerate([*PROSE, *LISTS, None])], "id int, text string, page string")
    got = {r["id"] for r in stuffing.judge_pages(df).where("page.stuffed").collect()}
    assert got == set(range(len(PROSE), len(PROSE) + len(LISTS)))
    assert stuffing.judge_pages(df.where("false")).count() == 0


# all queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert name in entry.queries()
    if name in queries.SQL:
        con = duckdb.connect()
        for table in set(re.findall(r"\b(latency_elements|web_requests|documents)\b", queries.SQL[name])):
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
        want = con.sql(queries.SQL[name]).project(", ".join(columns)).fetchall()
        assert got == sorted(want, key=repr)
