from conftest import rows
from pyspark.sql import functions as F

from rillcube.operators import logs
from rillcube.operators.logs import log_entries

T = 1357000000  # 2013-01-01 00:26:40
SCHEMA = "tuple_id int, log_file string, version bigint, s_val string, t_val int, entry string, block int"
HEADS = [
    ("[Tue Jan 01 00:10:22.209601 2013] [liveness:notice] [pid 31106] config key", 1356999022, "INFO", "liveness", "config key"),
    ("E0101 00:10:22.059759  2682 cube_manager.h:702] flushed", 1356999022, "ERROR", "cube_manager.h", "flushed"),
    ("W1231 23:59:59.9 19661 chain_ops.cc:1] late", 1356998399, "WARN", "chain_ops.cc", "late"),
    ("2013-01-01 00:10:22,307 [worker-9] FATAL app.cube.node_agent - boom - x", 1356999022, "FATAL", "app.cube.node_agent", "boom - x"),
    ("1356999022.774 fetchd/DEBUG: a", 1356999022, "DEBUG", "fetchd", "a"),
    ("01/Jan/2013:00:10:22 +0100|CRIT|web_ui|b | c", 1356995422, "FATAL", "web_ui", "b | c"),
    ("01/Jan/2013:00:10:22 +0000 | WARNING | web_ui | b", 1356999022, "WARN", "web_ui", "b"),
    ("2013-01-01T05:40:22+05:30 topk_tput INFO: d", 1356999022, "INFO", "topk_tput", "d"),
    ("2012-12-31T16:10:22-0800 topk_tput CRITICAL: d", 1356999022, "FATAL", "topk_tput", "d"),
    ("2013-01-01T00:10:22 topk_tput ERROR: d", 1356999022, "ERROR", "topk_tput", "d"),
    ("Jan  1 00:10:22 site-04 node_agent[19661]: level: e", 1356999022, "NONE", "node_agent", "level: e"),
    ("Dec 31 23:10:22 site-04 node_agent: <emerg> f", 1356995422, "FATAL", "node_agent", "f"),
    ('time=2013-01-01T00:10:22Z pid=3 component=rollup level=warn msg="say \\"g\\" level=error"', 1356999022, "WARN", "rollup", 'say "g" level=error'),
    ('{"pid": 3, "ts": 1356999022465, "lvl": "Info", "comp": "congest", "msg": "h"}', 1356999022, "INFO", "congest", "h"),
    ('{"message":"i","time":"2013-01-01T00:10:22.9Z","component":"congest","level":"fatal"}', 1356999022, "FATAL", "congest", "i"),
]
FOLLOWERS = ["", "  at x", "\tat y(z:1)", "Traceback (most recent call last):", "{", '  "a": 1,', "}", "00000000  d1 e1 96", "#1 0x60ca65e4 in f ()", "peer said:", "    2013-01-01T00:00:00Z a INFO: quoted", "INSERT INTO cells", '{"a": 1}', "2013-99-99T00:10:22Z x INFO: no such day", None]


def table(spark, lines, file="f"):
    return spark.createDataFrame([(i, file, i, s, T + 50 * i, "e", 0) for i, s in enumerate(lines, 1)], SCHEMA)


def test_layouts(spark):
    got = log_entries(table(spark, [h[0] for h in HEADS])).orderBy("first_version").collect()
    assert [(r["ts"], r["level"], r["component"], r["message"]) for r in got] == [h[1:] for h in HEADS]
    assert [(r["first_version"], r["last_version"]) for r in got] == [(i, i) for i in range(1, len(HEADS) + 1)]


def test_long_headers(spark):
    """No length of a name or number hides a header."""
    long = [".".join(f"{a}{i}-x" for i in range(12)) for a in ("a", "7b")] + ["aa." * 200 + "b", "1.2.3.4.5.6.7.8.9.10.11.12.13.14"]
    lines = [line for c in long for line in (f"1356999022.774 {c}/DEBUG: m", f"2013-01-01T00:10:22 {c} INFO: m", f"2013-01-01 00:10:22 [w] WARN {c} - m", f"[Tue Jan 01 00:10:22.1 2013] [{c}:crit] m", f"01/Jan/2013:00:10:22 +0000|ERR|{c}|m")]
    got = log_entries(table(spark, lines)).orderBy("first_version").collect()
    assert [(r["first_version"], r["ts"], r["component"], r["message"]) for r in got] == [(i, 1356999022, long[(i - 1) // 5], "m") for i in range(1, len(lines) + 1)]


def test_an_entry_over_many_blocks(spark):
    lines = [HEADS[0][0], *[f"  {i}" for i in range(50)], HEADS[4][0], "x"]
    df = table(spark, lines).withColumn("t_val", F.lit(None).cast("int"))
    got = log_entries(df, block_lines=4).orderBy("first_version").collect()
    assert [(r["first_version"], r["last_version"]) for r in got] == [(1, 51), (52, 53)]
    assert got[0]["message"] == "\n".join(["config key", *[f"  {i}" for i in range(50)]])


def test_continuations(spark):
    lines = ["lost begin", *FOLLOWERS, HEADS[0][0], *FOLLOWERS, HEADS[4][0]]
    for block in (1, 3, 4096):
        got = log_entries(table(spark, lines), block_lines=block).orderBy("first_version").collect()
        n = len(FOLLOWERS)
        assert [(r["first_version"], r["last_version"]) for r in got] == [(n + 2, 2 * n + 2), (2 * n + 3, 2 * n + 3)]
        assert got[0]["message"] == "\n".join(["config key", *[f or "" for f in FOLLOWERS]])


def test_year_from_near_line(spark):
    df = table(spark, [HEADS[2][0], HEADS[1][0], "x"]).withColumn("t_val", F.when(F.col("version") == 3, T))
    for block in (1, 2, 4096):
        assert [r["ts"] for r in log_entries(df, block_lines=block).orderBy("first_version").collect()] == [1356998399, 1356999022]


def test_repeats_nulls_and_empty(spark):
    df = table(spark, [HEADS[0][0], "x", HEADS[4][0]])
    twice = df.unionByName(df.withColumn("tuple_id", F.col("tuple_id") + 100))
    assert rows(log_entries(twice)) == rows(log_entries(df))
    lost = df.unionByName(df.withColumn("log_file", F.lit(None).cast("string"))).unionByName(df.withColumn("version", F.lit(None).cast("bigint")))
    assert rows(log_entries(lost)) == rows(log_entries(df))
    assert log_entries(df.where("false")).count() == 0
    long = table(spark, [HEADS[4][0] + "y" * 200_000, "z" * 200_000])
    assert len(log_entries(long).first()["message"]) == 400_002


def test_files_are_apart_and_rules_unbounded(spark, monkeypatch):
    df = table(spark, [HEADS[0][0], "x"], "f").unionByName(table(spark, ["y", HEADS[4][0]], "g"))
    want = rows(log_entries(df))
    assert [(r[0], r[1], r[2]) for r in want] == [("f", 1, 2), ("g", 2, 2)]
    monkeypatch.setattr(logs, "MAX_RULES", 1)
    assert rows(log_entries(df)) == want


def test_blocks_do_not_matter(spark, data):
    df = spark.read.parquet(f"{data}/log_elements.parquet")
    assert rows(log_entries(df, block_lines=5)) == rows(log_entries(df))


def test_no_session_time_zone_matters(spark):
    df = table(spark, [h[0] for h in HEADS])
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert [r["ts"] for r in log_entries(df).orderBy("first_version").collect()] == [h[1] for h in HEADS]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_what_only_resembles_a_clock(spark):
    lines = [HEADS[0][0], "time=2013 level=info", "time=2013-01-01 level=info", "time=2013-01-01T00:10 level=info", "2013-02-30T00:10:22 x INFO: no such day", "2013-01-01T24:10:22 x INFO: no such hour", "E0230 00:10:22.1 26 a.h:7] no such day", "time=a:b:c level=info"]
    assert [(r["first_version"], r["last_version"]) for r in log_entries(table(spark, lines)).collect()] == [(1, len(lines))]
    leap = log_entries(table(spark, ["E0229 00:10:22.1 26 a.h:7] a day of 2012"]).withColumn("t_val", F.lit(1330500000))).first()
    assert leap["ts"] == 1330474222
