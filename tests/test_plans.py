import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rillcube.cube.cube import Cube, CubeQuery
from rillcube.cube.spec import Aggregate, CubeSpec, Dimension
from rillcube.plans import subscriptions as subs
from rillcube.plans.degrade import Ladder, Policy, choose_level
from rillcube.plans.flow import Flow
from rillcube.plans.registry import names, operator, register_operator
from rillcube.schema import EngineSchemaError
from rillcube.sources import files
from rillcube.streaming import windows

NOW = 1_000_000
SPEC = CubeSpec("c", [Dimension("url"), Dimension("time", "time_containment")], [Aggregate("count", "count", ("n",))])


def cells(spark):
    return spark.createDataFrame([("foo.com", 10_000, 2), *[("foo.com", NOW - i, i + 1) for i in range(3)]], "url string, time bigint, n int")


def test_once_and_windows(spark):
    cube = Cube.build(SPEC, cells(spark))
    assert subs.one_shot(cube).count() == 4
    assert rows(subs.one_shot(cube, CubeQuery(levels={"time": 0})).select("url", "count")) == [("foo.com", 8)]
    got = subs.windowed(cube, "time", 100, 10_000)
    assert set(rows(got.groupBy("window_start").agg(F.sum("count")))) == {(10_000, 2), (NOW - 100, 5), (NOW, 1)}
    top = subs.windowed(cube, "time", 100, 10_000, CubeQuery(sort=["-count"], limit=1))
    assert set(rows(top.select("window_start", "count"))) == {(10_000, 2), (NOW - 100, 3), (NOW, 1)}
    assert subs.windowed(cube, "time", 100, NOW - 1).count() == 2


def test_lateness_and_coarsening(spark):
    df = spark.createDataFrame([(5, 12), (5, 13), (5, None)], "t int, a int")
    assert [r["on_time"] for r in subs.on_time(df, F.col("t"), F.col("a"), 10, 3).collect()] == [True, False, False]
    cube = Cube.build(SPEC, cells(spark))
    sizes = {r["level"]: r["cells"] for r in subs.level_rows(cube, "time").collect()}
    assert sizes[9] == 4 and sizes[0] == 1
    assert subs.fitting_level(cube, "time", 3) == max(k for k, v in sizes.items() if v <= 3)
    assert subs.coarsened(cube, "time", 0).count() == 1


def test_thresholds(spark):
    df = spark.createDataFrame([("a", 5, 1), ("a", 9, 2), ("b", 1, 3), (None, 4, 4)], "k string, v int, t int")
    bounds = spark.createDataFrame([("a", 6), (None, 4)], "k string, threshold int")
    assert rows(subs.above_threshold(df, "v", bounds, ["k"]).select("v")) == [(1,), (4,), (9,)]
    assert subs.above_threshold(df, "v", bounds.where("false")).count() == 4
    assert rows(subs.above_threshold(df, "v", bounds.where("k = 'a'")).select("v")) == [(9,)]
    control = spark.createDataFrame([(2, 7.0), (2, 6.0), (4000, 1.0)], "at int, bound double")
    rows_ = spark.createDataFrame([(1,), (2,), (3999,), (4000,), (90_000,), (None,)], "t int")
    for size in (10, 3600):
        got = {r["t"]: r["threshold"] for r in subs.in_force(rows_, "t", control, "at", "bound", size).collect()}
        assert got == {1: None, 2: 7.0, 3999: 7.0, 4000: 1.0, 90_000: 1.0, None: None}


def test_latency_and_changes(spark):
    ms = spark.createDataFrame([(float(x),) for x in (3, 9.9, 57, 999, 1234, -57)], "ms double")
    assert sorted(r["bucket"] for r in ms.select(subs.latency_bucket(F.col("ms")).alias("bucket")).collect()) == [-50, 2, 8, 50, 980, 1200]
    hosts = ms.withColumn("h", F.lit("x"))
    assert subs.latency_histogram(hosts, "h", F.col("ms")).count() == 6
    old = Cube.build(SPEC, cells(spark))
    new = old.insert(spark.createDataFrame([("foo.com", 10_000, 1), ("bar", 1, 1)], "url string, time bigint, n int"))
    assert rows(subs.changes(old, new).select("url", "old_count", "new_count")) == [("bar", None, 1), ("foo.com", 2, 3)]


def test_degrading():
    levels = [i / 10 for i in range(11)]
    assert choose_level(1.0, levels, 10) == 10 and choose_level(0.5, levels, 10) == 5 and choose_level(0.01, levels, 3) == 0
    assert choose_level(2.0, levels, 4) == 6 and choose_level(5.0, levels, 10) == 10
    policy = Policy([Ladder("first", levels), Ladder("second", levels)])
    assert policy.react(0.5, 0.0) == "first" and policy.react(0.5, 0.5) is None
    while policy.ladders[0].current:
        policy.react(0.1, policy.last + 1)
    assert policy.react(0.5, policy.last + 1) == "second" and policy.react(3.0, policy.last + 1) == "second"


def test_flow(spark):
    lines = spark.createDataFrame([("1,200,5",), ("2,404,7",)], "line string")
    flow = Flow()
    source = flow.add_source(lines)
    parsed = flow.add_operator("csv_parse", column="line", types="III", names=["t", "code", "n"])
    spec = CubeSpec("codes", [Dimension("code", "int")], [Aggregate("n", "sum", ("n",))])
    cube, ask = flow.add_cube(spec), flow.add_query(CubeQuery(sort=["-n"]))
    flow.chain([source, parsed, cube, ask])
    assert [r["n"] for r in flow.build(ask).collect()] == [7, 5]
    assert len(flow.validate()) == 4 and flow.sources() == [source] and flow.outputs(source) == [parsed]
    clones = flow.clone_back_from(cube, [lines.where("line like '1%'"), lines.where("line like '2%'")])
    both = flow.add_query(CubeQuery(sort=["-n"]))
    for c in clones:
        flow.connect(c, both)
    assert rows(flow.build(both)) == rows(flow.build(ask))
    with pytest.raises(EngineSchemaError):
        flow.connect(parsed, source)
    with pytest.raises(EngineSchemaError):
        flow.connect(source, parsed)
    flow.remove(ask)
    with pytest.raises(EngineSchemaError):
        flow.connect(cube, ask)
    with pytest.raises(EngineSchemaError):
        Flow().validate()


def test_flow_schema_errors(spark):
    def fails(build):
        flow = Flow()
        build(flow)
        with pytest.raises(EngineSchemaError):
            flow.validate()

    numbers, text = spark.range(2), spark.createDataFrame([("a",)], "s string")
    fails(lambda f: f.chain([f.add_source(numbers), f.add_operator("csv_parse", column="id", types="S", names=["a"])]))
    fails(lambda f: f.chain([f.add_source(text), f.add_operator("round_time", column="t", round_to=5)]))
    fails(lambda f: f.add_operator("grep", column="s", pattern="x"))

    def mixed(f):
        out = f.add_operator("no_op")
        f.connect(f.add_source(numbers), out)
        f.connect(f.add_source(text), out)

    fails(mixed)
    register_operator("twice", lambda df: df.union(df), replace=True)
    assert "twice" in names() and operator("twice")(numbers).count() == 4
    with pytest.raises(EngineSchemaError):
        register_operator("twice", lambda df: df)
    with pytest.raises(EngineSchemaError):
        operator("nothing")


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(3):
        (source / f"{i}.txt").write_text("".join(f"{i * 100 + j}\n" for j in range(0, 100, 10)))
        os.utime(source / f"{i}.txt", (1000 + i, 1000 + i))  # files are read in this order
    stream = files.text_stream(spark, str(source)).select(F.timestamp_seconds(F.col("line").cast("long")).alias("ts"))
    out = windows.windowed_stream(stream, "ts", "50 seconds", "0 seconds", [], [F.count(F.lit(1)).alias("n")])
    assert sorted(r["n"] for r in windows.run_available(out, str(tmp_path / "c1"), "complete").collect()) == [5] * 6
    closed = windows.run_available(out, str(tmp_path / "c2"))
    assert {r["n"] for r in closed.collect()} == {5} and 3 <= closed.count() < 6
    # of two inputs, the one that is behind holds the windows back
    behind = stream.where("unix_seconds(ts) < 150")
    both = windows.closed_windows([stream, behind], "ts", "50 seconds", "0 seconds", [], [F.count(F.lit(1)).alias("n")])
    assert [r["n"] for r in windows.run_available(both, str(tmp_path / "c4")).collect()] == [10, 10]
    with pytest.raises(EngineSchemaError):
        windows.run_available(out, str(tmp_path / "c5"), "update")
    taken = []
    got = windows.delayed_one_shot(files.text_stream(spark, str(source)), lambda df, n: taken.append(df.count()), lambda: spark.createDataFrame([(sum(taken),)], "n int"), str(tmp_path / "c3"))
    assert rows(got) == [(30,)]


def test_a_policy_moves_the_plans_of_a_flow(spark):
    flow, ladder = Flow(), Ladder("limit", [0.25, 0.5, 1.0])
    source = flow.add_source(spark.range(100).select(F.col("id").alias("n")))
    cut = flow.add_operator(lambda df, step: df.where(F.col("n") < [25, 50, 100][step]), ladder, "step")
    flow.connect(source, cut)
    flow.add_policy(Policy([ladder]))
    assert flow.build(cut).count() == 100 and flow.react(1.0, 0.0) == []
    assert flow.react(0.5, 1.0) == ["limit"] and flow.build(cut).count() == 50
    assert flow.react(0.1, 1.5) == [] and flow.react(0.1, 2.5) == ["limit"] and flow.build(cut).count() == 25


def test_external_reader(spark):
    flow = Flow()
    a = flow.add_source(spark.createDataFrame([("x", 1), ("y", 2)], "k string, n int"))
    cube = flow.add_cube(CubeSpec("c", [Dimension("k")], [Aggregate("n", "count", ("n",))]))
    flow.connect(a, cube)
    assert sorted(tuple(r) for r in flow.connect_external(cube)) == [("x", 1, 0), ("y", 2, 0)]
    assert len(list(flow.connect_external(a))) == 2


def test_levels_of_null_times_and_one_dimension(spark):
    spec = CubeSpec("c", [Dimension("time", "time_containment", "t")], [Aggregate("n")])
    cube = Cube.build(spec, spark.createDataFrame([(-1,), (0,), (4,), (5,), (3599,), (3600,), (86400,), (None,)], "t bigint"))
    got = {r["level"]: r["cells"] for r in subs.level_rows(cube, "time").collect()}
    assert got == {0: 1, 1: 5, 2: 6, 3: 6, 4: 6, 5: 6, 6: 6, 7: 6, 8: 7, 9: 8}


def test_period_store_stream(spark, tmp_path):
    source = tmp_path / "in"
    schema = "tuple_id bigint, site string, time timestamp, arrival_time timestamp"
    for i, at in enumerate((100, 2000, 150)):
        one = spark.createDataFrame([(i, "a", at, 2100 + i)], "tuple_id bigint, site string, t bigint, a bigint")
        one.select("tuple_id", "site", F.timestamp_seconds("t").alias("time"), F.timestamp_seconds("a").alias("arrival_time")).coalesce(1).write.mode("append").parquet(str(source))
    store = windows.PeriodStore(spark, str(tmp_path / "store"), F.lit(1), F.lit(1))
    store.run(spark.readStream.schema(schema).parquet(str(source)), str(tmp_path / "c")).awaitTermination()
    assert rows(store.beyond().select("tuple_id")) == [(2,)] and rows(store.results().select("period", "rows")) == [(0, 1), (1800, 1)]
