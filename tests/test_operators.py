"""Expectations of the engine's operators, row by row."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rillcube.operators import evaluate, filters, parse, sampling, topk, transform
from rillcube.schema import EngineSchemaError, require, same_schema
from rillcube.sources import files, generators, sinks


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "line string")


def test_csv(spark):
    df = lines(spark, 'Field 1,"putting quotes around fields, allows commas", 3', "too,short", "a,b,c,d", None, "", 'x,"say \\"hi\\"",y')
    got = rows(parse.csv_parse(df, "line", "SSI", ["a", "b", "c"]))
    assert got == [("Field 1", "putting quotes around fields, allows commas", 3), ("x", 'say "hi"', None)]
    assert rows(parse.csv_parse(df.limit(1), "line", "SSI", ["a", "b", "c"], "1 2")) == [("putting quotes around fields, allows commas", 3)]
    short = rows(parse.csv_parse(lines(spark, "too,short"), "line", "SSI", ["a", "b", "c"], discard_off_size=False))
    assert short == [("too", "short", None)]
    assert rows(parse.csv_parse_blanks(lines(spark, 'a "b c",  3', "a b"), "line", "SSI", ["a", "b", "c"])) == [("a", "b c", 3)]
    assert rows(parse.csv_parse_strict(df, "line", "SSI", ["a", "b", "c"])) == [("Field 1", "putting quotes around fields, allows commas", 3)]
    with pytest.raises(EngineSchemaError):
        parse.csv_parse(spark.range(1), "id", "S", ["a"])


def test_generic_parse(spark):
    df = spark.createDataFrame([("1", "foo 7", "1.2"), ("2", "no match at all", "3"), ("3", None, "4")], "a string, b string, c string")
    assert rows(parse.generic_parse(df, "b", r"(\w+) (\d+)", "SI", ["w", "n"])) == [("1", "foo", 7, "1.2")]
    assert rows(parse.generic_parse(df, "b", r"(\w+) (\d+)", "SI", ["w", "n"], keep_unparsed=False)) == [("foo", 7)]
    assert parse.generic_parse(df, "b", r"(\w+) (\d+)", "SI", ["w", "n"], on_no_match="null").count() == 3
    with pytest.raises(Exception):
        parse.generic_parse(df, "b", r"(\w+", "S", ["w"]).collect()
    with pytest.raises(EngineSchemaError):
        parse.generic_parse(df, "b", r"(\w+) (\d+)", "SI", ["a", "n"])


def test_filters(spark):
    df = lines(spark, "/usr/bar", "/var/bar", "/var/usr/bar", None)
    assert rows(filters.grep(df, "line", "/usr")) == [("/usr/bar",), ("/var/usr/bar",)]
    n = spark.createDataFrame([(1, 2.0, 0.0), (5, 9.0, 3.0), (None, 1.0, 1.0), (7, None, 1.0)], "i int, a double, b double")
    assert rows(filters.equals(n, "i", 5).select("i")) == [(5,)]
    assert rows(filters.greater_than(n, "i", 1).select("i")) == [(5,), (7,)]
    assert rows(filters.ratio_above(n, "a", "b", 2).select("i")) == [(1,), (5,)]
    w = spark.createDataFrame([("x", 5, 1), ("x", 5, 2), ("x", 9, 3), ("y", 1, 4)], "w string, v int, id int")
    assert rows(filters.window_limit(w, "w", "v", 2, ["id"])) == [("x", 5, 1, 5), ("x", 9, 3, 5), ("y", 1, 4, None)]
    assert filters.coarser_limits(100, 20)[0] == 5 and filters.coarser_limits(100, 20)[-1] == 100


def test_transforms(spark):
    df = spark.createDataFrame([(6, 1231151151.510341, "http://foo.com/blah"), (-7, -3.9, "plain"), (None, None, None)], "t bigint, d double, u string")
    assert sorted((r[0] for r in transform.round_time(df, "t", 5).select("t").collect()), key=repr) == sorted([5, -5, None], key=repr)
    assert transform.round_time(df, "d", 5, 17).first()["d"] == 1231151151 // 5 * 5 + 17
    assert [r["u"] for r in transform.url_to_domain(df, "u").collect()] == ["foo.com", "plain", None]
    warped = transform.time_warp(spark.createDataFrame([(1000,), (1100,), (1250,)], "t bigint"), "t", 100, 50)
    assert rows(warped) == [(50,), (51,), (52,)]
    assert transform.project_drop(df, "t").columns == ["d", "u"]
    got = transform.extend(df, [("I", 3), ("S", "${HOSTNAME}")], hostname="h").first()
    assert (got["0"], got["1"], got["u"]) == (3, "h", "http://foo.com/blah")
    for bad in (lambda: transform.project_drop(df, "x"), lambda: transform.round_time(df, "u", 5), lambda: transform.extend(df, [("I", 1)], ["t"])):
        with pytest.raises(EngineSchemaError):
            bad()
    assert dict(transform.stamp(df, "us").dtypes)["timestamp"] == "double"
    r = spark.createDataFrame([("a", 200, 3), ("a", 404, 1), ("b", 500, 0)], "u string, c int, n int")
    assert rows(transform.success_ratio(r, {"u": F.col("u")}, "c", "n")) == [("a", 4, 0.75), ("b", 0, None)]


def test_samplers(spark):
    df = spark.range(1000).select((F.col("id") % 100).alias("k"), "id")
    assert 330 < sampling.bernoulli(df, 0.6, 1).count() < 470
    kept = sampling.hash_sample(df, "k", 0.5).groupBy("k").count().collect()
    assert all(r["count"] == 10 for r in kept) and 40 <= len(kept) <= 60
    text = df.withColumn("k", F.col("k").cast("string"))
    assert all(r["count"] == 10 for r in sampling.hash_sample(text, "k", 0.5).groupBy("k").count().collect())
    low, high = (set(rows(sampling.variable_sample(df, "k", i))) for i in (3, 8))
    assert low < high and sampling.variable_sample(df, "k", 10).count() == 1000 and sampling.variable_sample(df, "k", 0).count() == 0
    assert [r["id"] for r in sampling.interval_sample(df, ["id"], 1).orderBy("id").collect()] == list(range(1, 1000, 2))
    assert sampling.interval_sample(df, ["id"], 9, ["k"]).count() == 100
    assert sampling.interval_sample(df.where("false"), ["id"], 1).count() == 0
    kinds = df.withColumn("c0", F.when(F.col("id") % 10 > 2, F.lit("hot")).when(F.col("id") % 10 > 0, F.lit("b")))
    kept = sorted((r["c0"] or "", r["id"]) for r in sampling.interval_sample(kinds, ["id"], 2, ["c0"]).collect())
    want = []
    for kind in ("hot", "b", None):
        own = sorted(r["id"] for r in kinds.collect() if r["c0"] == kind)
        want += [(kind or "", i) for i in own[2::3]]
    assert kept == sorted(want)


def sites(spark, n=2):
    return spark.createDataFrame([(f"s{s}", f"url{i}", (i + s) % 10) for s in range(n) for i in range(10)], "site string, url string, n int")


def test_topk(spark):
    df = sites(spark)
    assert [r["total"] for r in topk.tput_topk(df, "site", "url", F.col("n"), 3).collect()] == [17, 15, 13]
    for n, k in ((1, 3), (5, 4), (3, 50)):
        many = sites(spark, n)
        assert rows(topk.tput_topk(many, "site", "url", F.col("n"), k)) == rows(topk.exact_topk(many, "url", F.col("n"), k))
    assert topk.tput_topk(df.where("false"), "site", "url", F.col("n"), 3).count() == 0
    w = topk.windowed_topk(df, F.col("site"), "url", F.col("n"), 1)
    assert rows(w) == [("s0", "url9", 9, 1), ("s1", "url8", 9, 1)]


def test_evaluators(spark):
    even = spark.createDataFrame([(0, "a", 3), (0, "b", 1), (1, "a", 4)], "t int, l string, n int")
    got = {r["period"]: r["evenness"] for r in evaluate.evenness(even, F.col("t"), "l", F.col("n"), {"a": 1, "b": 1}).collect()}
    assert got == {0: 0.5, 1: 0.0}
    seen, figures = evaluate.observed(even, "figures", F.col("n"))
    seen.collect()
    assert figures.get == {"rows": 3, "bytes": 8}
    urls = spark.createDataFrame([(0, "http://a/1"), (3, "http://a/2"), (7, "http://a/1")], "t bigint, u string")
    assert rows(evaluate.key_compression(urls, F.col("t"), F.col("u"), [5, 0]).select("fold", "url_keys", "domain_keys")) == [(0, 2, 1), (5, 3, 2)]
    h = evaluate.hierarchy_counts(spark.createDataFrame([("a.b", 2), ("a.c", 1), (None, 5)], "h string, n int"), {"h": F.col("h")}, {"h": r"\."}, F.col("n"))
    assert rows(h) == [("", 8), ("a", 3), ("a.b", 2), ("a.c", 1)]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in.txt").write_text("# a\n\n/bin/sh\n")
    assert files.text_lines(spark, str(tmp_path / "in.txt")).count() == 3
    assert files.text_lines(spark, str(tmp_path / "in.txt"), skip_empty=True).count() == 2
    (tmp_path / "img1.bin").write_bytes(b"12345")
    (tmp_path / "img2.bin").write_bytes(b"1" * 50)
    assert rows(files.blobs(spark, str(tmp_path), "img", max_bytes=20).select(F.length("bytes"))) == [(5,)]
    (tmp_path / "blobs").mkdir()
    (tmp_path / "blobs" / "img1").write_bytes(b"12345")
    sinks.to_memory(files.blob_stream(spark, str(tmp_path / "blobs"), "img").select(F.length("bytes").alias("n")), "blob_rows").awaitTermination()
    assert rows(spark.table("blob_rows")) == [(5,)]
    assert rows(generators.send_k(spark, 3)) == [("foo", 0), ("foo", 1), ("foo", 2)]
    assert generators.continuous(spark, 5).isStreaming
    even = evaluate.evenness(generators.random_labels(spark, 5000, 5000), F.col("time"), "label", F.lit(1), generators.STATES)
    assert even.first()["evenness"] > 0.95
    zipf = generators.random_labels(spark, 3000, 3000, generators.zipf_weights(20))
    assert zipf.groupBy("label").count().orderBy(F.desc("count")).first()["label"] == "item_0"
    hist = generators.random_histograms(spark, 20, 4, 30).first()
    assert len(hist["histogram"]) == 30 and sum(hist["histogram"]) == 50
    sinks.ground(zipf)
    sinks.to_text(zipf.limit(2), str(tmp_path / "out"))
    sinks.to_text(zipf.limit(2), str(tmp_path / "out"))
    assert files.text_lines(spark, str(tmp_path / "out")).count() == 4
    assert len(list(sinks.client_rows(zipf.limit(5)))) == 5
    assert sinks.echo(zipf.limit(1)).count() == 1


def test_schema(spark):
    df = spark.range(1)
    with pytest.raises(EngineSchemaError):
        require(df, "id", "S")
    with pytest.raises(EngineSchemaError):
        same_schema([df, df.withColumnRenamed("id", "x")])
