import random

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillcube.cube.catalog import CubeCatalog
from rillcube.cube.cube import Cube, CubeQuery, agg_tree
from rillcube.cube.levels import level_for_budget, level_within
from rillcube.cube.spec import Aggregate, CubeSpec, Dimension, is_name
from rillcube.functions import loghist
from rillcube.schema import EngineSchemaError

T = 1365793980  # a full minute
SPEC = CubeSpec(
    "web", [Dimension("time", "time_containment"), Dimension("url"), Dimension("response_code", "int")],
    [Aggregate("count", "count", ("n",)), Aggregate("avg_size", "avg", ("s", "n"))], "v",
)
SCHEMA = "time bigint, url string, response_code int, s int, n int, v bigint"


def table(spark, *data):
    return spark.createDataFrame([(*d, i) for i, d in enumerate(data)], SCHEMA)


def test_insert_and_average(spark):
    cube = Cube.build(SPEC, table(spark, (T, "u", 200, 50, 1)))
    assert rows(cube.finalize()) == [(T, "u", 200, 1, 50.0, 0)]
    more = cube.insert(table(spark, (T, "u", 200, 100, 1)))
    assert rows(more.cells) == [(T, "u", 200, 2, 150.0, 2, 0)]
    assert more.finalize().first()["avg_size"] == 75
    assert more.leaf_count().first()["cells"] == 1


def test_slices_sorts_limits(spark):
    cube = Cube.build(SPEC, table(spark, *[(T, "u", c, 100, 1) for c in (500, 100, 300, 200, 400)]))
    ask = lambda **q: [r["response_code"] for r in cube.query(CubeQuery(**q)).collect()]
    assert ask(sort=["response_code"])[0] == 100 and ask(sort=["-response_code"])[0] == 500
    assert ask(sort=["-response_code"], limit=1) == [500] and len(ask(limit=3)) == 3
    assert sorted(ask(bounds={"response_code": (250, 350)})) == [300]
    assert sorted(ask(bounds={"response_code": (200, 300)})) == [200, 300]
    assert ask(bounds={"response_code": (510, None)}) == []
    with pytest.raises(EngineSchemaError):
        ask(sort=["nothing"])
    with pytest.raises(EngineSchemaError):
        ask(bounds={"nothing": (1, 2)})


def test_rollups(spark):
    flat = Cube.build(SPEC, table(spark, *[(T, "u", c, 100 * n, n) for c, n in ((100, 1), (200, 2), (300, 3), (400, 4), (500, 5))]))
    assert rows(flat.query(CubeQuery(levels={"response_code": 0}))) == [(T, "u", 0, 15, 100.0, 4)]
    timed = Cube.build(SPEC, table(spark, *[(T + dt, "u", 200, 500, 100) for dt in (1, 2, 7, 61)]))
    at = lambda level: [(r["time"], r["count"], r["avg_size"]) for r in timed.query(CubeQuery(levels={"time": level}, sort=["time"])).collect()]
    assert at(9) == at(10) == [(T + 1, 100, 5.0), (T + 2, 100, 5.0), (T + 7, 100, 5.0), (T + 61, 100, 5.0)]
    assert at(8) == [(T, 200, 5.0), (T + 5, 100, 5.0), (T + 60, 100, 5.0)]
    assert at(5) == [(T, 300, 5.0), (T + 60, 100, 5.0)] and at(0) == [(0, 400, 5.0)]
    empty = Cube.build(SPEC, table(spark, (T, "u", 1, 1, 1)).where("false"))
    assert empty.finalize().count() == 0
    whole = empty.query(CubeQuery(levels={"time": 0, "url": 0, "response_code": 0})).collect()
    assert [(r["time"], r["url"], r["count"]) for r in whole] == [(0, "0", None)]


def test_points_and_mixed_levels(spark):
    cube = Cube.build(SPEC, table(spark, (T + 1, "u", 200, 1, 1), (T + 2, None, 404, 2, 1)))
    assert cube.cell({"time": T + 2, "url": None, "response_code": 404}).count() == 1
    assert cube.cell({"time": T + 3, "url": "u", "response_code": 200}).count() == 0
    keys = spark.createDataFrame([(T + 2, None, 404), (T + 9, "u", 1)], "time bigint, url string, response_code int")
    assert cube.lookup(keys).count() == 1
    both = cube.levels_of({}, {"time": 5})
    assert both.count() == 4 and set(r["time_level"] for r in both.collect()) == {9, 5}
    with pytest.raises(EngineSchemaError):
        cube.cell({"time": 1})


def test_all_aggregates_and_delta(spark):
    spec = CubeSpec("all", [Dimension("time", "time")], [Aggregate("count"), Aggregate("a", "avg", ("s", "n")), Aggregate("i", "min_i", ("s",)), Aggregate("d", "min_d", ("x",)), Aggregate("last", "string", ("w",)), Aggregate("total", "sum", ("s",))], "v")
    df = spark.createDataFrame([(1, 20, 2, 2.0, "late", 5), (1, 10, 1, 1.0, "early", 3), (1, None, None, None, None, 9)], "time bigint, s int, n int, x double, w string, v bigint")
    assert rows(Cube.build(spec, df).finalize()) == [(1, 3, 10.0, 10, 1.0, "late", 30, 9)]
    parts = [Cube.build(spec, df.where(F.col("v") == v)) for v in (3, 5, 9)]
    assert rows(Cube.merge(*parts).cells) == rows(Cube.build(spec, df).cells)
    assert Cube.merge(*parts).query(CubeQuery(levels={"time": 0})).first()["last"] == "late"
    delta = CubeSpec("delta", [Dimension("time", "time")], [Aggregate("a", "avg", ("s", "n"))])
    one = lambda s, n: spark.createDataFrame([(1, s, n)], "time bigint, s int, n int")
    assert rows(Cube.build(delta, one(10, 1)).apply_delta(one(10, 1), one(15, 3)).cells) == [(1, 15.0, 3, 0)]


def test_summaries(spark):
    spec = CubeSpec("sum", [Dimension("k")], [Aggregate("h", "quantile_histogram", ("v",), 30), Aggregate("s", "quantile_sample", ("v",), 10), Aggregate("q", "quantile_sketch", ("v",))])
    df = spark.range(60).select((F.col("id") % 3).cast("string").alias("k"), (F.col("id") % 20).cast("int").alias("v"))
    df = df.unionByName(df)
    cube = Cube.build(spec, df)
    assert cube.query().columns == ["k", "h", "s", "q", "version"]
    whole = cube.rollup({"k": 0}).finalize().select("k", loghist.population(F.col("h")).alias("n"), "s.seen", F.size("s.items").alias("kept"), loghist.sketch_quantile(F.col("q"), 0.5).alias("m")).first()
    assert (whole["k"], whole["n"], whole["seen"], whole["kept"]) == ("0", 120, 120, 10) and 7 <= whole["m"] <= 12
    halves = Cube.merge(Cube.build(spec, df.where("v < 10")), Cube.build(spec, df.where("v >= 10")))
    assert rows(halves.cells.select("k", "h", "s.seen")) == rows(cube.cells.select("k", "h", "s.seen"))


@given(st.lists(st.integers(0, 3), min_size=30, max_size=30))
@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_any_partition_merges_to_the_whole(spark, parts):
    random.seed(4)
    data = [(T + random.randrange(90), random.choice(["a", "b", None]), 200, random.randrange(9), 1, i) for i in range(30)]
    whole = rows(Cube.build(SPEC, spark.createDataFrame(data, SCHEMA)).cells)
    cubes = [Cube.build(SPEC, spark.createDataFrame([d for d, p in zip(data, parts) if p == i], SCHEMA)) for i in set(parts)]
    assert rows(Cube.merge(*cubes).cells) == whole


def test_tree(spark):
    df = table(spark, *[(T, "u", 200 + i % 2, i, 1) for i in range(8)]).withColumn("site", F.col("v") % 4)
    flat = rows(Cube.build(SPEC, df).cells)
    assert rows(agg_tree(SPEC, df, "site").cells) == flat
    assert rows(agg_tree(SPEC, df, "site", F.col("site_key") < "2").cells) == flat


def test_specs_are_checked(spark):
    dim, agg = [Dimension("a")], [Aggregate("c")]
    for bad in (lambda: CubeSpec("x", [], agg), lambda: CubeSpec("x", dim, []), lambda: CubeSpec("bad name!", dim, agg), lambda: CubeSpec("x", dim, [Aggregate("a")]), lambda: CubeSpec("x", dim, [Aggregate("m", "max", ("b",))]), lambda: CubeSpec("x", dim, [Aggregate("m", "min_i")]), lambda: CubeSpec("x", [Dimension("a", "url")], agg), lambda: CubeSpec("x", dim, [Aggregate("s", "string", ("b",))])):
        with pytest.raises(EngineSchemaError):
            bad()
    df = spark.createDataFrame([("x", 1)], "a string, b int")
    with pytest.raises(EngineSchemaError):
        Cube.build(CubeSpec("x", [Dimension("b")], agg), df)
    past = CubeSpec.positional("p", df, [("a", "string", 0)], [("n", "count", [7]), ("s", "sum", [1])])
    assert rows(Cube.build(past, df).finalize()) == [("x", 1, 1, 0)]


def test_catalog(spark, tmp_path):
    catalog = CubeCatalog(spark, str(tmp_path / "cubes"))
    catalog.create(SPEC)
    assert catalog.create(CubeSpec("web", SPEC.dims[:1], SPEC.aggs, "v")) == catalog.spec("web") and catalog.names() == ["web"]
    assert catalog.spec("web").dim_names == SPEC.dim_names
    with pytest.raises(EngineSchemaError):
        catalog.get("web")
    a, b = table(spark, (T, "u", 200, 1, 1)), table(spark, (T, "u", 200, 3, 1), (T, "w", 200, 3, 1))
    catalog.insert("web", a, 0)
    catalog.insert("web", b, 1)
    catalog.insert("web", b, 1)
    want = rows(Cube.build(SPEC, a.unionByName(b)).finalize())
    assert rows(catalog.get("web").finalize()) == want
    catalog.compact("web")
    assert len(catalog.batches("web")) == 1 and rows(catalog.get("web").finalize()) == want
    catalog.create(SPEC, overwrite=True)
    assert catalog.batches("web") == []
    catalog.destroy("web")
    assert catalog.names() == []


def test_catalog_compacts_again_and_again(spark, tmp_path):
    catalog = CubeCatalog(spark, str(tmp_path / "cubes"))
    catalog.create(SPEC)
    a, b, c = (table(spark, (T + i, "u", 200, 1, 1)) for i in range(3))
    whole = lambda *parts: rows(Cube.build(SPEC, parts[0] if len(parts) == 1 else parts[0].unionByName(whole_of(parts[1:]))).finalize())
    whole_of = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(whole_of(parts[1:]))
    catalog.insert("web", a, 0)
    catalog.insert("web", b, 1)
    before = catalog.get("web").finalize()
    catalog.compact("web")
    catalog.insert("web", b, 1)  # folded: changes nothing
    assert rows(catalog.get("web").finalize()) == rows(before) == whole(a, b)
    catalog.insert("web", b, 1, "other stream")
    catalog.insert("web", c, "named")
    catalog.compact("web")
    for again in (catalog, CubeCatalog(spark, str(tmp_path / "cubes"))):
        again.insert("web", c, "named")
        again.insert("web", a, 0)
        assert len(again.batches("web")) == 1 and rows(again.get("web").finalize()) == whole(a, b, b, c)
    catalog.insert("web", a)
    catalog.insert("web", a)
    catalog.compact("web")
    catalog.compact("web")
    assert rows(catalog.get("web").finalize()) == whole(a, a, a, b, b, c)
    # only the part in force and those that the last compaction replaced are left
    assert len(catalog._listed(f"{tmp_path}/cubes/web/data")) == 4


def test_catalog_survives_lost_and_rival_writers(spark, tmp_path):
    catalog = CubeCatalog(spark, str(tmp_path / "cubes"))
    catalog.create(SPEC)
    a, b = table(spark, (T, "u", 200, 1, 1)), table(spark, (T, "u", 200, 3, 1))
    catalog.insert("web", a, 0)
    # a writer that was lost before its manifest: its folder is no part of the cube
    Cube.build(SPEC, b).cells.write.parquet(str(tmp_path / "cubes" / "web" / "data" / "lost"))
    assert rows(catalog.get("web").finalize()) == rows(Cube.build(SPEC, a).finalize())
    assert not catalog._put(f"{tmp_path}/cubes/web/manifest/{1:012d}", "{}")
    # a rival folds the parts between reading and the commit: this one's fold is dropped
    rival, commit = CubeCatalog(spark, str(tmp_path / "cubes")), catalog._commit
    catalog.insert("web", b, 1)
    catalog._commit = lambda name, change: (rival.compact(name), commit(name, change))[1]
    catalog.compact("web")
    assert rows(catalog.get("web").finalize()) == rows(Cube.build(SPEC, a.unionByName(b)).finalize())


def test_stored_rollups(spark, tmp_path):
    catalog = CubeCatalog(spark, str(tmp_path / "cubes"))
    catalog.create(SPEC)
    a, b = table(spark, (T, "u", 200, 1, 1)), table(spark, (T + 1, "u", 300, 3, 1))
    catalog.insert("web", a)
    catalog.store_rollup("web", {"time": 5})
    catalog.insert("web", b)
    stored = lambda: rows(catalog.stored_rollup("web", {"time": 5}).finalize())
    assert stored() == rows(Cube.build(SPEC, a).rollup({"time": 5}).finalize())  # as of when it was stored
    catalog.store_rollup("web", {"time": 5})
    catalog.compact("web")
    assert stored() == rows(Cube.build(SPEC, a.unionByName(b)).rollup({"time": 5}).finalize())
    with pytest.raises(EngineSchemaError):
        catalog.stored_rollup("web", {"time": 1})


def test_names():
    assert all(is_name(n) for n in ("a", "3_b", "12/web")) and not any(is_name(n) for n in ("", "a b", "/a", "x/a", "a/", "1/2/3", "é"))


def test_levels():
    assert level_for_budget({0: 1, 1: 10, 5: 100}, 50) == 1 and level_for_budget({0: 5, 1: 10}, 2) == 0
    assert level_within(300) == 4 and level_within(7) == 8 and level_within(86400) == 1


def test_log_histograms(spark):
    s = loghist.starts(30)
    assert s[:2] == (0, 1) and len(s) == 30 and s[-1] == 2**28
    assert loghist.starts(600)[:30] == tuple(range(30)) and len(set(loghist.starts(500))) == 500
    assert all(a[1] + 1 == b[0] for a, b in zip(loghist.bounds(30), loghist.bounds(30)[1:]))
    values = spark.range(1000).select(F.col("id").alias("v"))
    placed = values.select("v", loghist.bucket_of(F.col("v"), 30).alias("b")).collect()
    assert all(loghist.bounds(30)[r["b"]][0] <= r["v"] <= loghist.bounds(30)[r["b"]][1] for r in placed)
    small = spark.createDataFrame([(2,), (4,), (6,), (None,)], "v int")
    h = loghist.histogram(small, [], F.col("v"), 500)
    got = h.select(loghist.quantile(F.col("histogram"), 500, 0.6).alias("q"), loghist.population(F.col("histogram")).alias("n")).first()
    assert (got["q"], got["n"]) == (4, 3)
    assert len(h.select(loghist.degrade_to(F.col("histogram"), 500, 0.5).alias("d")).first()["d"]) == 250
    squares = spark.range(100).select((F.col("id") * F.col("id")).alias("v"))
    fine = loghist.histogram(squares, [], F.col("v"), 600)
    direct = loghist.histogram(squares, [], F.col("v"), 100).first()["histogram"]
    assert fine.select(loghist.degrade(F.col("histogram"), 600, 100).alias("d")).first()["d"] == direct
    whole = loghist.histogram(values, [], F.col("v"), 100)
    for q in (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95):
        mid = whole.select(loghist.quantile(F.col("histogram"), 100, q).alias("m")).first()["m"]
        low, high = loghist.bounds(100)[[b[0] <= mid <= b[1] for b in loghist.bounds(100)].index(True)]
        assert low <= q * 1000 <= high + 1
    assert loghist.histogram(small.where("v is null"), [], F.col("v"), 30).select(loghist.quantile(F.col("histogram"), 30, 0.5).alias("q")).first()["q"] is None
    exact = loghist.sample_quantile(values.withColumn("k", F.lit(1)), ["k"], F.col("v"), 0.6)
    assert rows(exact) == [(1, 600)]
    a = loghist.bottom_k(values.where("v < 500"), [], F.col("v"), 20, F.col("v"))
    b = loghist.bottom_k(values.where("v >= 500"), [], F.col("v"), 20, F.col("v"))
    assert rows(loghist.smallest(a.unionByName(b), [], 20)) == rows(loghist.bottom_k(values, [], F.col("v"), 20, F.col("v")))


def test_lazy_summaries(spark):
    df = spark.createDataFrame([(k, v) for k, n in (("a", 3), ("b", 5), (None, 2)) for v in range(n)] + [("a", None), ("empty", None)], "k string, v int")
    lazy = loghist.lazy_summary(df, ["k"], F.col("v"), 30, limit=4)
    got = {r["k"]: (r["values"], r["histogram"]) for r in lazy.collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": [0, 1, 2], "b": None, None: [0, 1], "empty": []} and sum(got["b"][1]) == 5
    one = lambda rows_, limit: loghist.lazy_merged(rows_.withColumn("k", F.lit("all")), ["k"], 30, limit).first()
    assert one(lazy, 100)["values"] is None and sum(one(lazy, 100)["histogram"]) == 10  # a histogram stays one
    assert one(lazy.where("k = 'a' or k is null"), 5)["values"] == [0, 0, 1, 1, 2]
    assert sum(one(lazy.where("k = 'a' or k is null"), 4)["histogram"]) == 5


def test_dyadic_cover():
    for low, high in ((0, 0), (3, 17), (5, 1000), (0, 2**32 - 1)):
        spans = [(int(n) << int(b), (int(n) + 1) << int(b)) for b, n in (i.split(":") for i in loghist.dyadic_cover(low, high))]
        assert spans[0][0] == low and spans[-1][1] == high + 1 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and len(spans) <= 6 * 17
