"""Queries for the engine's own operators over the driver's tables, each with the SQL that gives the same rows.

Amounts are whole numbers (cents), so that sums do not depend on the order of addition.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillcube.cube.catalog import CubeCatalog
from rillcube.cube.cube import Cube, CubeQuery, agg_tree
from rillcube.cube.spec import Aggregate, CubeSpec, Dimension
from rillcube.functions import loghist
from rillcube.operators import evaluate, filters, parse, sampling, topk, transform
from rillcube.plans import subscriptions as subs
from rillcube.plans.degrade import Ladder, Policy
from rillcube.plans.flow import Flow
from rillcube.session import checkpoint_dir, load
from rillcube.sources import files, generators
from rillcube.streaming import windows

QUERIES: dict = {}
SQL: dict[str, str] = {}

_E = "e AS (SELECT event_id, epoch_us(ts) // 1000000 AS t, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS cents, props, 'site-' || (user_id % 4) AS site FROM events)"
_R = "r AS (SELECT tuple_id, site, version, epoch_us(time) // 1000000 AS t, url, response_code, coalesce(count, 1)::BIGINT AS n, avg_size_sum::BIGINT AS size, avg_size_count::BIGINT AS sizes FROM web_requests)"
_T = _R.replace("FROM web_requests", "FROM web_requests WHERE time IS NOT NULL")  # for time windows


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, d: str) -> DataFrame:
    raw = load(spark, d, "events")
    return raw.select(
        "event_id",
        transform.epoch_seconds(raw, "ts").alias("t"),
        "user_id",
        "event_type",
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        "props",
        F.concat(F.lit("site-"), (F.col("user_id") % 4).cast("string")).alias("site"),
    )


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Every row of web_requests; ``t`` is null where the time is."""
    raw = load(spark, d, "web_requests")
    return raw.select("tuple_id", "site", "version", F.unix_seconds("time").alias("t"), "url", "response_code", F.coalesce("count", F.lit(1)).cast("bigint").alias("n"), F.col("avg_size_sum").cast("bigint").alias("size"), F.col("avg_size_count").cast("bigint").alias("sizes"))


def timed_requests(spark: SparkSession, d: str) -> DataFrame:
    """The rows of web_requests that have a time: for queries that place them in time windows."""
    return requests(spark, d).where("t is not null")


def kept(df: DataFrame, root: str) -> DataFrame:
    """``df`` written to the checkpoint folder, so that the files it was made from can go."""
    out = df.checkpoint()
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out


EVENT_SPEC = CubeSpec(
    "events",
    [Dimension("time", "time_containment", "t"), Dimension("event_type")],
    [Aggregate("cnt"), Aggregate("total", "sum", ("cents",)), Aggregate("mean", "avg", ("cents",)), Aggregate("least", "min_i", ("cents",))],
    "event_id",
)
WEB_SPEC = CubeSpec(
    "web_requests",
    [Dimension("time", "time_containment", "t"), Dimension("url"), Dimension("response_code", "int")],
    [Aggregate("count", "count", ("n",)), Aggregate("avg_size", "avg", ("size", "sizes"))],
    "version",
)


def event_cube(spark: SparkSession, d: str) -> Cube:
    return Cube.build(EVENT_SPEC, events(spark, d))


def web_cube(spark: SparkSession, d: str, rows=requests) -> Cube:
    return Cube.build(WEB_SPEC, rows(spark, d))


# cubes

_CELL = "count(*) AS cnt, sum(cents)::BIGINT AS total, sum(cents)::DOUBLE / count(*) AS mean, min(cents) AS least, max(event_id) AS version"


@query(f"WITH {_E} SELECT t AS time, event_type, {_CELL} FROM e GROUP BY 1, 2")
def cube_leaf_events(spark, d):
    return event_cube(spark, d).finalize()


@query(f"WITH {_R} SELECT t AS time, url, response_code, sum(n)::BIGINT AS count, sum(size)::DOUBLE / nullif(sum(sizes), 0) AS avg_size, max(version) AS version FROM r GROUP BY 1, 2, 3")
def cube_leaf_web(spark, d):
    return web_cube(spark, d).finalize()


@query(f"WITH {_E} SELECT event_type, sum(cents)::DOUBLE AS mean_sum, count(*) AS mean_count, sum(cents)::DOUBLE / count(*) AS mean FROM e GROUP BY 1")
def cube_avg_partial_final(spark, d):
    rolled = event_cube(spark, d).rollup({"time": 0})
    partial = rolled.cells.select(F.col("event_type").alias("k"), "mean_sum", "mean_count")
    return rolled.finalize().select("event_type", "mean").join(partial, F.col("event_type") == F.col("k")).drop("k")


@query(f"WITH {_E} SELECT t // 300 * 300 AS time, event_type, {_CELL} FROM e GROUP BY 1, 2")
def cube_rollup_time_5min(spark, d):
    return event_cube(spark, d).query(CubeQuery(levels={"time": 4}))


@query(f"WITH {_E} SELECT t // 3600 * 3600 AS time, event_type, {_CELL} FROM e GROUP BY 1, 2")
def cube_rollup_hour_type(spark, d):
    return event_cube(spark, d).query(CubeQuery(levels={"time": 1}))


@query(f"WITH {_E} SELECT 0::BIGINT AS time, '0' AS event_type, {_CELL} FROM e")
def cube_rollup_full(spark, d):
    return event_cube(spark, d).query(CubeQuery(levels={"time": 0, "event_type": 0}))


@query(f"WITH {_E} SELECT t AS time, event_type, {_CELL} FROM e WHERE t BETWEEN 1704200000 AND 1704900000 AND event_type BETWEEN 'click' AND 'purchase' GROUP BY 1, 2")
def cube_slice_range(spark, d):
    return event_cube(spark, d).query(CubeQuery({"time": (1704200000, 1704900000), "event_type": ("click", "purchase")}))


@query(f"WITH {_E} SELECT t // 3600 * 3600 AS time, event_type, {_CELL} FROM e WHERE t // 3600 * 3600 = 1704672000 AND event_type = 'view' GROUP BY 1, 2")
def cube_point_lookup(spark, d):
    return event_cube(spark, d).rollup({"time": 1}).cell({"time": 1704672000, "event_type": "view"})


@query(f"WITH {_E}, k AS (SELECT event_type, max(t) // 3600 * 3600 AS time FROM e GROUP BY 1), c AS (SELECT t // 3600 * 3600 AS time, event_type, {_CELL} FROM e GROUP BY 1, 2) SELECT c.* FROM c SEMI JOIN k USING (time, event_type)")
def cube_multi_lookup(spark, d):
    hours = event_cube(spark, d).rollup({"time": 1})
    keys = events(spark, d).groupBy("event_type").agg(F.max("t").alias("t")).select("event_type", (F.col("t") - F.col("t") % 3600).alias("time"))
    return hours.lookup(keys)


@query(f"WITH {_E} SELECT t // 3600 * 3600 AS time, '0' AS event_type, {_CELL} FROM e WHERE t BETWEEN 1704200000 AND 1705900000 GROUP BY 1 ORDER BY total DESC, time LIMIT 10")
def cube_slice_and_rollup_topk(spark, d):
    return event_cube(spark, d).query(CubeQuery({"time": (1704200000, 1705900000)}, {"time": 1, "event_type": 0}, ["-total"], 10))


_STRING_SPEC = CubeSpec("last", [Dimension("time", "time_containment", "t"), Dimension("site")], [Aggregate("last_type", "string", ("event_type",)), Aggregate("cnt")], "event_id")


@query(f"WITH {_E} SELECT t AS time, site, arg_max(event_type, event_id) AS last_type, count(*) AS cnt, max(event_id) AS version FROM e GROUP BY 1, 2")
def cube_string_last(spark, d):
    return Cube.build(_STRING_SPEC, events(spark, d)).finalize()


@query(f"WITH {_E}, c AS (SELECT t, site, arg_max(event_type, event_id) AS s, count(*) AS n, max(event_id) AS v FROM e GROUP BY 1, 2) SELECT t // 3600 * 3600 AS time, site, array_to_string(list_sort(list_distinct(list(s))), ',') AS last_type, sum(n)::BIGINT AS cnt, max(v) AS version FROM c GROUP BY 1, 2")
def cube_string_rollup(spark, d):
    return Cube.build(_STRING_SPEC, events(spark, d)).query(CubeQuery(levels={"time": 1}))


@query(f"WITH {_R} SELECT site, max(version) AS version, count(*) AS cnt FROM r GROUP BY 1")
def cube_version_max(spark, d):
    return Cube.build(CubeSpec("v", [Dimension("site")], [Aggregate("cnt")], "version"), requests(spark, d)).finalize()


@query(f"WITH {_E} SELECT count(*) AS cells FROM (SELECT DISTINCT t, event_type FROM e)")
def cube_leaf_count(spark, d):
    return event_cube(spark, d).leaf_count()


@query(f"""WITH {_E} SELECT t // 60 * 60 AS time, event_type, count(*) AS cnt, 5 AS time_level, 1 AS event_type_level FROM e GROUP BY 1, 2
        UNION ALL SELECT t // 3600 * 3600, '0', count(*), 1, 0 FROM e GROUP BY 1""")
def cube_mixed_levels(spark, d):
    return event_cube(spark, d).levels_of({"time": 5}, {"time": 1, "event_type": 0}).select("time", "event_type", "cnt", "time_level", "event_type_level")


@query(f"WITH {_E} SELECT t AS time, event_type, {_CELL} FROM e GROUP BY 1, 2")
def agg_tree_two_level(spark, d):
    return agg_tree(EVENT_SPEC, events(spark, d), "site").finalize()


@query(f"WITH {_E} SELECT t AS time, event_type, {_CELL} FROM e GROUP BY 1, 2")
def agg_tree_three_level(spark, d):
    region = F.when(F.col("site_key").isin("site-0", "site-1"), F.lit("west")).otherwise(F.lit("east"))
    return agg_tree(EVENT_SPEC, events(spark, d), "site", region).finalize()


@query(f"""WITH {_E}, s AS (SELECT t // 3600 * 3600 AS time, cents, event_id, 1 AS n FROM e UNION ALL SELECT t // 3600 * 3600, -cents, event_id, -1 FROM e WHERE event_type = 'error'
        UNION ALL SELECT t // 3600 * 3600, cents + 5, event_id, 1 FROM e WHERE event_type = 'error')
        SELECT time, sum(n)::BIGINT AS cnt, sum(cents)::DOUBLE / nullif(sum(n), 0) AS mean, max(event_id) AS version FROM s GROUP BY 1""")
def delta_retraction(spark, d):
    spec = CubeSpec("delta", [Dimension("time", "time_containment", "t")], [Aggregate("cnt"), Aggregate("mean", "avg", ("cents",))], "event_id")
    rows = events(spark, d).withColumn("t", F.col("t") - F.col("t") % 3600)
    old = rows.where("event_type = 'error'")
    return Cube.build(spec, rows).apply_delta(old, old.withColumn("cents", F.col("cents") + 5)).finalize()


@query(f"WITH {_E} SELECT t AS time, event_type, {_CELL} FROM e GROUP BY 1, 2")
def cube_catalog_batches(spark, d):
    """Three inserts, each repeated before and after it is folded, with a compaction after the second and the third; then the cube as another process finds it."""
    root = f"{checkpoint_dir(spark)}/cubes-{uuid.uuid4().hex}"
    catalog, parts = CubeCatalog(spark, root), [events(spark, d).where(F.col("event_id") % 3 == i) for i in range(3)]
    catalog.create(EVENT_SPEC)
    for i in (0, 0, 1):
        catalog.insert("events", parts[i], i)
    catalog.compact("events")
    for i in (1, 2, 2, 0):
        catalog.insert("events", parts[i], i)
    catalog.compact("events")
    catalog.insert("events", parts[2], 2)
    return kept(CubeCatalog(spark, root).get("events").finalize(), root)


@query(f"WITH {_E} SELECT t // 300 * 300 AS time, event_type, {_CELL} FROM e WHERE t // 300 * 300 BETWEEN 1704200000 AND 1704900000 GROUP BY 1, 2")
def cube_stored_rollup(spark, d):
    """Rollups written beside a cube at two vectors of levels, and a slice of the one at exactly the asked levels."""
    root = f"{checkpoint_dir(spark)}/cubes-{uuid.uuid4().hex}"
    catalog = CubeCatalog(spark, root)
    catalog.create(EVENT_SPEC)
    catalog.insert("events", events(spark, d), 0)
    catalog.store_rollup("events", {"time": 1, "event_type": 0})
    catalog.store_rollup("events", {"time": 4})
    return kept(CubeCatalog(spark, root).stored_rollup("events", {"time": 4}).query(CubeQuery({"time": (1704200000, 1704900000)})), root)


@query(f"WITH {_E} SELECT t // 3600 * 3600 AS time, event_type, min(cents) AS least_cents, min(cents / 100.0::DOUBLE) AS least_value, min(t) AS earliest, max(event_id) AS version FROM e GROUP BY 1, 2")
def cube_minima(spark, d):
    """Least whole number, least double and earliest time of a cube, rolled up from its cells."""
    aggs = [Aggregate("least_cents", "min_i", ("cents",)), Aggregate("least_value", "min_d", ("value",)), Aggregate("earliest", "min_t", ("t",))]
    spec = CubeSpec("minima", EVENT_SPEC.dims, aggs, "event_id")
    leaf = Cube.build(spec, events(spark, d).withColumn("value", F.col("cents") / F.lit(100.0)))
    return Cube(spec, leaf.cells).query(CubeQuery(levels={"time": 1}))


# parsing and transforms


@query("SELECT doc_id, source FROM documents WHERE regexp_matches(text, '[0-9]+ (people|crowns)')")
def grep_documents(spark, d):
    return filters.grep(load(spark, d, "documents"), "text", "[0-9]+ (people|crowns)").select("doc_id", "source")


@query(r"""SELECT event_id, regexp_extract(props, '^\{"(\w+)": (\d+)\}$', 1) AS name, CAST(regexp_extract(props, '^\{"(\w+)": (\d+)\}$', 2) AS INTEGER) AS number FROM events WHERE regexp_matches(props, '^\{"(\w+)": (\d+)\}$')""")
def regex_parse_props(spark, d):
    rows = load(spark, d, "events").select("event_id", "props")
    return parse.generic_parse(rows, "props", r'\{"(\w+)": (\d+)\}', "SI", ["name", "number"])


@query(f"WITH {_E} SELECT CAST(event_id AS INTEGER) AS id, event_type || ', ' || site AS what, CAST(cents AS INTEGER) AS amount FROM e")
def csv_parse_lines(spark, d):
    line = F.concat(F.col("event_id").cast("string"), F.lit(',"'), F.col("event_type"), F.lit(", "), F.col("site"), F.lit('", '), F.col("cents").cast("string"))
    return parse.csv_parse(events(spark, d).select(line.alias("line")), "line", "ISI", ["id", "what", "amount"])


@query(f"WITH {_E} SELECT event_type || ' ' || site AS what, CAST(cents AS DOUBLE) AS amount FROM e")
def csv_parse_blanks(spark, d):
    line = F.concat(F.col("event_id").cast("string"), F.lit(' "'), F.col("event_type"), F.lit(" "), F.col("site"), F.lit('",  '), F.col("cents").cast("string"))
    return parse.csv_parse_blanks(events(spark, d).select(line.alias("line")), "line", "ISD", ["id", "what", "amount"], "1 2")


@query(f"WITH {_E} SELECT CAST(event_id AS INTEGER) AS id, event_type || ', ' || site AS what, CAST(cents AS DOUBLE) AS amount FROM e")
def csv_parse_strict(spark, d):
    line = F.concat(F.col("event_id").cast("string"), F.lit(' , "'), F.col("event_type"), F.lit(", "), F.col("site"), F.lit('" ,'), F.col("cents").cast("string"))
    return parse.csv_parse_strict(events(spark, d).select(line.alias("line")), "line", "ISD", ["id", "what", "amount"])


@query("SELECT event_id, 'a' AS \"0\", 7 AS \"1\", 1.5::DOUBLE AS \"2\", 'node' AS \"3\" FROM events")
def extend_constants(spark, d):
    return transform.extend(load(spark, d, "events").select("event_id"), [("S", "a"), ("I", 7), ("D", 1.5), ("S", "${HOSTNAME}")], hostname="node")


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def project_drop(spark, d):
    return transform.project_drop(load(spark, d, "supplier"), "s_acctbal")


@query("SELECT event_id, epoch_us(ts) // 1000000 // 30 * 30 + 17 AS ts FROM events")
def time_round(spark, d):
    return transform.round_time(load(spark, d, "events").select("event_id", "ts"), "ts", 30, 17)


@query("SELECT tuple_id, coalesce(string_split(url, '/')[3], url) AS url FROM web_requests")
def url_to_domain(spark, d):
    return transform.url_to_domain(load(spark, d, "web_requests").select("tuple_id", "url"), "url")


@query(f"WITH {_E} SELECT event_id, CAST(trunc((t - (SELECT min(t) FROM e)) / 100.0::DOUBLE + 1000) AS BIGINT) AS t FROM e")
def time_warp(spark, d):
    return transform.time_warp(events(spark, d).select("event_id", "t"), "t", 100, 1000)


@query(f"WITH {_R} SELECT url, sum(n)::BIGINT AS total, sum(CASE WHEN response_code = 200 THEN n ELSE 0 END)::DOUBLE / sum(n) AS ratio FROM r GROUP BY 1")
def success_ratio(spark, d):
    return transform.success_ratio(requests(spark, d), {"url": F.col("url")}, "response_code", "n")


@query()
def stamp_seconds(spark, d):
    return transform.stamp(load(spark, d, "nation").select("n_nationkey"), "s")


@query("SELECT tuple_id, url FROM web_requests WHERE response_code = 404")
def filter_eq(spark, d):
    return filters.equals(load(spark, d, "web_requests"), "response_code", 404).select("tuple_id", "url")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45")
def filter_gt(spark, d):
    return filters.greater_than(load(spark, d, "lineitem"), "l_quantity", 45).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount = 0 OR l_tax / nullif(l_discount, 0) > 1.5")
def filter_ratio(spark, d):
    return filters.ratio_above(load(spark, d, "lineitem"), "l_tax", "l_discount", 1.5).select("l_orderkey", "l_linenumber")


@query(f"""WITH {_E}, w AS (SELECT t // 3600 * 3600 AS hour, event_id, cents, row_number() OVER (PARTITION BY t // 3600 * 3600 ORDER BY cents DESC, event_id) AS r FROM e)
        SELECT hour, event_id, cents, (SELECT max(x.cents) FROM w x WHERE x.hour = w.hour AND x.r = 4) AS error_bound FROM w WHERE r <= 3""")
def window_limit(spark, d):
    rows = events(spark, d).select((F.col("t") - F.col("t") % 3600).alias("hour"), "event_id", "cents")
    return filters.window_limit(rows, "hour", "cents", 3, ["event_id"])


@query(f"""WITH {_E}, w AS (SELECT t // 3600 * 3600 AS hour, event_id, cents, row_number() OVER (PARTITION BY t // 3600 * 3600 ORDER BY cents DESC, event_id) AS r FROM e), l(bound) AS (VALUES {", ".join(f"({b})" for b in filters.coarser_limits(6, 3))})
        SELECT bound, hour, count(*) AS kept, (SELECT max(x.cents) FROM w x WHERE x.hour = w.hour AND x.r = bound + 1) AS error_bound FROM w, l WHERE r <= bound GROUP BY bound, hour""")
def window_limit_ladder(spark, d):
    """What the steps of a ladder of window limits keep of each hour, and the largest value each cuts."""
    rows, out = events(spark, d).select((F.col("t") - F.col("t") % 3600).alias("hour"), "event_id", "cents"), None
    for bound in filters.coarser_limits(6, 3):
        kept_rows = filters.window_limit(rows, "hour", "cents", bound, ["event_id"])
        one = kept_rows.groupBy("hour").agg(F.count(F.lit(1)).alias("kept"), F.max("error_bound").alias("error_bound")).withColumn("bound", F.lit(bound))
        out = one if out is None else out.unionByName(one)
    return out


# sampling

_PLACE = "(user_id % 4294967296 * 2654435761) % 4294967296"


@query(f"SELECT event_id, user_id FROM events WHERE {_PLACE} >= 2147483648")
def hash_sample(spark, d):
    return sampling.hash_sample(load(spark, d, "events").select("event_id", "user_id"), "user_id", 0.5)


@query(f"SELECT event_id, user_id FROM events WHERE {_PLACE} >= {int((1 - 3 / 10) * 2**32)}")
def variable_sample(spark, d):
    return sampling.variable_sample(load(spark, d, "events").select("event_id", "user_id"), "user_id", 3)


@query(f"SELECT event_id, user_id FROM events WHERE {_PLACE} >= {int((1 - 5 / 10) * 2**32)}")
def degraded_flow(spark, d):
    """A flow whose policy has put its sampling stage to the step that half the capacity carries."""
    flow, ladder = Flow(), Ladder("sample", sampling.ladder())
    source = flow.add_source(load(spark, d, "events").select("event_id", "user_id"))
    sampled = flow.add_operator("variable_sample", ladder, key="user_id")
    flow.connect(source, sampled)
    flow.add_policy(Policy([ladder]))
    flow.react(0.5, 0.0)
    return flow.build(sampled)


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS n FROM events) WHERE n % 4 = 0")
def interval_sample(spark, d):
    return sampling.interval_sample(load(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"], 3).select("event_id")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events) WHERE n % 4 = 0")
def interval_sample_by_type(spark, d):
    return sampling.interval_sample(load(spark, d, "events").select("event_id", "event_type", "ts"), ["ts", "event_id"], 3, ["event_type"]).select("event_id")


@query()
def bernoulli_sample(spark, d):
    return sampling.bernoulli(load(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), 0.6, 7)


# summaries

_STARTS = {n: loghist.starts(n) for n in (30, 50, 100)}


def _hist_sql(n: int, keys: str, value: str, table: str) -> str:
    values = ", ".join(f"({i}, {s})" for i, s in enumerate(_STARTS[n]))
    return f"s{n}(b, s) AS (VALUES {values}), h{n} AS (SELECT {keys}, (SELECT max(b) FROM s{n} WHERE s <= greatest(0, {value})) AS b, count(*) AS n FROM {table} WHERE {value} IS NOT NULL GROUP BY ALL)"


def _type_hist(spark, d, n: int) -> DataFrame:
    return loghist.histogram(events(spark, d), ["event_type"], F.col("cents"), n)


def _exploded(df: DataFrame, keys: list[str], column: str = "histogram") -> DataFrame:
    return df.select(*keys, F.posexplode(column).alias("bucket", "n")).where("n > 0")


@query(f"WITH {_E}, {_hist_sql(100, 'event_type', 'cents', 'e')} SELECT event_type, b::INTEGER AS bucket, n FROM h100")
def loghist_build(spark, d):
    return _exploded(_type_hist(spark, d, 100), ["event_type"])


@query(f"""WITH {_E}, {_hist_sql(100, 'event_type', 'cents', 'e')}, s30(b, s) AS (VALUES {", ".join(f"({i}, {s})" for i, s in enumerate(_STARTS[30]))}),
        m AS (SELECT h.event_type, (SELECT max(x.b) FROM s30 x, s100 y WHERE y.b = h.b AND x.s <= y.s) AS b, h.n FROM h100 h) SELECT event_type, b::INTEGER AS bucket, sum(n)::BIGINT AS n FROM m GROUP BY 1, 2""")
def loghist_merge_coarsen(spark, d):
    fine = _type_hist(spark, d, 100)
    return _exploded(fine.select("event_type", loghist.degrade(F.col("histogram"), 100, 30).alias("histogram")), ["event_type"])


@query(f"""WITH {_E}, {_hist_sql(100, 'event_type', 'cents', 'e')}, s50(b, s) AS (VALUES {", ".join(f"({i}, {s})" for i, s in enumerate(_STARTS[50]))}),
        m AS (SELECT h.event_type, (SELECT max(x.b) FROM s50 x, s100 y WHERE y.b = h.b AND x.s <= y.s) AS b, h.n FROM h100 h) SELECT event_type, b::INTEGER AS bucket, sum(n)::BIGINT AS n FROM m GROUP BY 1, 2""")
def loghist_degrade_ratio(spark, d):
    """Histograms cut to the half that a link can carry."""
    fine = _type_hist(spark, d, 100)
    return _exploded(fine.select("event_type", loghist.degrade_to(F.col("histogram"), 100, 0.5).alias("histogram")), ["event_type"])


_BOUNDS100 = ", ".join(f"({i}, {(a + b) // 2})" for i, (a, b) in enumerate(loghist.bounds(100)))


@query(f"""WITH {_E}, {_hist_sql(100, 'event_type', 'cents', 'e')}, m(b, mid) AS (VALUES {_BOUNDS100}),
        c AS (SELECT event_type, b, sum(n) OVER (PARTITION BY event_type ORDER BY b) AS cum, sum(n) OVER (PARTITION BY event_type) AS total FROM h100),
        f AS (SELECT event_type, min(b) AS b, max(total)::BIGINT AS population FROM c WHERE cum >= total * 0.95 GROUP BY 1)
        SELECT event_type, mid::INTEGER AS p95, population FROM f JOIN m USING (b)""")
def loghist_quantile(spark, d):
    h = _type_hist(spark, d, 100)
    return h.select("event_type", loghist.quantile(F.col("histogram"), 100, 0.95).alias("p95"), loghist.population(F.col("histogram")).alias("population"))


@query(f"""WITH {_E}, k AS (SELECT 'hour' AS level, t // 3600 AS period, cents FROM e UNION ALL SELECT 'month', 0, cents FROM e), n AS (SELECT level, period, count(*) AS n FROM k GROUP BY 1, 2),
        x AS (SELECT level, period, cents, row_number() OVER (PARTITION BY level, period ORDER BY cents) AS r, count(*) OVER (PARTITION BY level, period) AS n FROM k), {_hist_sql(100, 'level, period', 'cents', 'k')}, m(b, mid) AS (VALUES {_BOUNDS100}),
        c AS (SELECT level, period, b, sum(n) OVER (PARTITION BY level, period ORDER BY b) AS cum, sum(n) OVER (PARTITION BY level, period) AS total FROM h100), f AS (SELECT level, period, min(b) AS b FROM c WHERE cum >= total * 0.5 GROUP BY 1, 2)
        SELECT level, period, false AS raw, mid::BIGINT AS median FROM f JOIN m USING (b) JOIN n USING (level, period) WHERE n.n > 300
        UNION ALL SELECT level, period, true, cents FROM x WHERE n <= 300 AND r = least(floor(n * 0.5)::BIGINT + 1, n)""")
def lazy_summaries(spark, d):
    """Summaries of hours, which stay lists of raw values while they are small, and of all hours merged, which is a histogram."""
    hours = loghist.lazy_summary(events(spark, d).withColumn("period", F.floor(F.col("t") / 3600)), ["period"], F.col("cents"), 100)
    whole = loghist.lazy_merged(hours.withColumn("period", F.lit(0).cast("long")), ["period"], 100)
    both = hours.select(F.lit("hour").alias("level"), "*").unionByName(whole.select(F.lit("month").alias("level"), "*"))
    return both.select("level", "period", F.col("values").isNotNull().alias("raw"), loghist.lazy_quantile(F.col("values"), F.col("histogram"), 100, 0.5).alias("median"))


@query(f"WITH {_E}, {_hist_sql(50, 'event_type', 'cents', 'e')} SELECT '0' AS event_type, b::INTEGER AS bucket, sum(n)::BIGINT AS n FROM h50 GROUP BY 2")
def loghist_cube_rollup(spark, d):
    """A histogram aggregate of a cube, rolled up over all its cells."""
    spec = CubeSpec("h", [Dimension("time", "time_containment", "t"), Dimension("event_type")], [Aggregate("histogram", "quantile_histogram", ("cents",), 50)], "event_id")
    hours = Cube.build(spec, events(spark, d).withColumn("t", F.col("t") - F.col("t") % 3600))
    return _exploded(hours.rollup({"time": 0, "event_type": 0}).finalize(), ["event_type"])


@query(f"WITH {_E} SELECT event_type, count(*) FILTER (WHERE cents >= 0) AS population FROM e GROUP BY 1")
def summary_count(spark, d):
    return _type_hist(spark, d, 30).select("event_type", loghist.population(F.col("histogram")).alias("population"))


@query(f"WITH {_E}, n AS (SELECT event_type, cents, row_number() OVER (PARTITION BY event_type ORDER BY cents) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM e) SELECT event_type, cents AS quantile FROM n WHERE r = least(floor(n * 0.6)::BIGINT + 1, n)")
def sample_quantile_exact(spark, d):
    return loghist.sample_quantile(events(spark, d), ["event_type"], F.col("cents"), 0.6)


def _type_sketches(spark, d) -> DataFrame:
    spec = CubeSpec("k", [Dimension("time", "time_containment", "t"), Dimension("event_type")], [Aggregate("sketch", "quantile_sketch", ("cents",))], "event_id")
    return Cube.build(spec, events(spark, d).withColumn("t", F.col("t") - F.col("t") % 3600)).rollup({"time": 0}).finalize()


@query()
def sketch_quantile(spark, d):
    """Hourly sketches of a cube, merged and asked."""
    return _type_sketches(spark, d).select("event_type", loghist.sketch_quantile(F.col("sketch"), 0.5).alias("median"))


@query(f"WITH {_E} SELECT event_type, count(*) AS cnt, true AS within FROM e GROUP BY 1")
def sketch_rank_error(spark, d):
    """Whether the exact rank of each type's estimated median lies within 3 % of the middle."""
    asked = sketch_quantile(spark, d).select(F.col("event_type").alias("k"), "median")
    below = F.count(F.when(F.col("cents") < F.col("median"), 1)) / F.count(F.lit(1))
    upto = F.count(F.when(F.col("cents") <= F.col("median"), 1)) / F.count(F.lit(1))
    return events(spark, d).join(asked, F.col("event_type") == F.col("k")).groupBy("event_type").agg(F.count(F.lit(1)).alias("cnt"), ((below <= 0.53) & (upto >= 0.47)).alias("within"))


@query()
def cm_point_estimate(spark, d):
    """Per url its requests, exact and as the response codes' sketches, merged, estimate them."""
    rows = load(spark, d, "web_requests").where("url is not null")
    sketches = rows.groupBy("response_code").agg(loghist.count_min(F.col("url")).alias("sketch"))
    exact = rows.groupBy("url").agg(F.count(F.lit(1)).alias("requests"))
    return loghist.count_min_estimate(exact, "url", loghist.count_min_cells(sketches, [], "sketch"))


@query("SELECT count(DISTINCT url) AS urls, count(url) AS requests, 0::BIGINT AS below, true AS within FROM web_requests")
def cm_error_bound(spark, d):
    """How many urls ``cm_point_estimate`` puts below their count (none), and whether at most 1 % are above by more than 0.1 % of all."""
    found = cm_point_estimate(spark, d)
    whole = found.agg(F.sum("requests").alias("n")).scalar()
    far = F.count(F.when(F.col("estimate") - F.col("requests") > whole * 0.001, 1))
    return found.agg(F.count(F.lit(1)).alias("urls"), F.sum("requests").alias("requests"), F.count(F.when(F.col("estimate") < F.col("requests"), 1)).alias("below"), (far <= 0.01 * F.count(F.lit(1))).alias("within"))


_RANGES = ((0, 999), (1000, 9_999), (12_345, 67_890), (0, 2**31 - 1))


@query("WITH r(low, high) AS (VALUES " + ", ".join(f"({a}::BIGINT, {b}::BIGINT)" for a, b in _RANGES) + ") SELECT low, high, count(avg_size_sum) AS requests, true AS within FROM r LEFT JOIN web_requests ON avg_size_sum BETWEEN low AND high GROUP BY 1, 2")
def cm_range_sums(spark, d):
    """Requests by ranges of size from one sketch of dyadic ranges: exact, and whether the estimate is not below and above by 2 % of all at most."""
    sizes = load(spark, d, "web_requests").select(F.col("avg_size_sum").cast("bigint").alias("size")).where("size >= 0")
    items = sizes.select(F.explode(loghist.dyadic_items(F.col("size"))).alias("item"))
    cells = loghist.count_min_cells(items.agg(loghist.count_min(F.col("item"), 0.0001).alias("sketch")), [], "sketch")
    asked = spark.createDataFrame([(a, b, i) for a, b in _RANGES for i in loghist.dyadic_cover(a, b)], "low bigint, high bigint, item string")
    found = loghist.range_estimates(asked, cells, 0.0001).select(F.col("low").alias("l"), F.col("high").alias("h_"), "estimate")
    held = F.array(*[F.struct(F.lit(a).cast("long").alias("low"), F.lit(b).cast("long").alias("high"), F.col("size").between(a, b).alias("in")) for a, b in _RANGES])
    exact = sizes.select(F.explode(held).alias("h")).groupBy("h.low", "h.high").agg(F.count(F.when(F.col("h.in"), 1)).alias("requests"), F.count(F.lit(1)).alias("all"))
    over = F.col("estimate") - F.col("requests")
    return exact.join(found, (F.col("low") == F.col("l")) & (F.col("high") == F.col("h_"))).select("low", "high", "requests", ((over >= 0) & (over <= F.col("all") * 0.02)).alias("within"))


@query(f"WITH {_E} SELECT event_type, count(cents) AS seen, least(40, count(cents))::INTEGER AS kept, least(40, count(cents)) AS known FROM e GROUP BY 1")
def reservoir_sample(spark, d):
    """A sample aggregate of a cube: 40 values per type of all its hours, and how many of them are the type's (``known``: all)."""
    spec = CubeSpec("s", [Dimension("time", "time_containment", "t"), Dimension("event_type")], [Aggregate("sample", "quantile_sample", ("cents",), 40)], "event_id")
    rows = events(spark, d)
    sampled = Cube.build(spec, rows.withColumn("t", F.col("t") - F.col("t") % 86400)).rollup({"time": 0}).finalize()
    items = sampled.select("event_type", F.explode("sample.items").alias("i")).select("event_type", F.col("i.value").alias("cents"))
    known = items.join(rows.select("event_type", "cents"), ["event_type", "cents"], "left_semi").groupBy(F.col("event_type").alias("k")).agg(F.count(F.lit(1)).alias("known"))
    return sampled.join(known, F.col("event_type") == F.col("k")).select("event_type", F.col("sample.seen").alias("seen"), F.size("sample.items").alias("kept"), "known")


# top-k

_TOP = f"WITH {_R} SELECT url AS key, sum(n)::BIGINT AS total FROM r GROUP BY 1 ORDER BY total DESC, key NULLS FIRST LIMIT 10"


@query(_TOP)
def exact_topk(spark, d):
    return topk.exact_topk(requests(spark, d), "url", F.col("n"), 10)


@query(_TOP)
def tput_topk(spark, d):
    return topk.tput_topk(requests(spark, d), "site", "url", F.col("n"), 10)


@query(f"""WITH {_T}, s AS (SELECT t // 3600 * 3600 AS "window", url AS key, sum(n)::BIGINT AS total FROM r GROUP BY 1, 2)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "window" ORDER BY total DESC, key NULLS FIRST)::INTEGER AS rank FROM s) WHERE rank <= 5""")
def windowed_topk(spark, d):
    """Of the requests that have a time."""
    return topk.windowed_topk(timed_requests(spark, d), F.col("t") - F.pmod(F.col("t"), F.lit(3600)), "url", F.col("n"), 5)


# subscriptions


@query(f"WITH {_E} SELECT t AS time, event_type, {_CELL}, (t - 1704067200) // 1800 * 1800 + 1704067200 AS window_start FROM e WHERE t >= 1704067200 GROUP BY t, event_type")
def timesub_windows(spark, d):
    return subs.windowed(event_cube(spark, d), "time", 1800, 1704067200)


@query(f"""WITH {_E}, c AS (SELECT t // 3600 * 3600 AS time, event_type, {_CELL} FROM e GROUP BY 1, 2), w AS (SELECT *, (time - 1704067200) // 86400 * 86400 + 1704067200 AS window_start FROM c WHERE time >= 1704067200)
        SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY cnt DESC, time, event_type) AS r FROM w) WHERE r <= 2""")
def timesub_topk(spark, d):
    return subs.windowed(event_cube(spark, d), "time", 86400, 1704067200, CubeQuery(levels={"time": 1}, sort=["-cnt"], limit=2))


@query(f"WITH {_E} SELECT level, count(*) AS cells FROM (SELECT DISTINCT event_type, s.level, CASE WHEN s.size = 0 THEN 0 ELSE t // nullif(s.size, 0) * s.size END AS at FROM e, (VALUES (0, 0), (1, 3600), (2, 1800), (3, 600), (4, 300), (5, 60), (6, 30), (7, 10), (8, 5), (9, 1)) s(level, size)) GROUP BY 1")
def coarsen_levels(spark, d):
    return subs.level_rows(event_cube(spark, d), "time")


_FIT = """lv(level, size) AS (VALUES (0, 0), (1, 3600), (2, 1800), (3, 600), (4, 300), (5, 60), (6, 30), (7, 10), (8, 5), (9, 1)), n AS (SELECT level, size, count(*) AS cells FROM (SELECT DISTINCT event_type, level, size, CASE WHEN size = 0 THEN 0 ELSE t // nullif(size, 0) * size END FROM e, lv) GROUP BY 1, 2),
        f AS (SELECT coalesce(arg_max(size, level) FILTER (WHERE cells <= 4000), 0) AS size FROM n)"""


@query(f"WITH {_E}, {_FIT}, c AS (SELECT CASE WHEN size = 0 THEN 0 ELSE t // nullif(size, 0) * size END AS time, event_type, {_CELL} FROM e, f GROUP BY 1, 2) SELECT * FROM c")
def coarsen_to_budget(spark, d):
    """The finest level of at most 4000 cells, whichever it is."""
    cube = event_cube(spark, d)
    return subs.coarsened(cube, "time", subs.fitting_level(cube, "time", 4000))


_LATE = "SELECT tuple_id, coalesce(epoch_us(arrival_time) < (floor(epoch_us(time) / 60000000.0)::BIGINT + 1) * 60000000 + 30000000, false) AS on_time FROM web_requests"


@query(_LATE)
def late_data_split(spark, d):
    rows = load(spark, d, "web_requests")
    micro = lambda c: F.unix_micros(c) / 1e6
    return subs.on_time(rows, micro("time"), micro("arrival_time"), 60, 30).select("tuple_id", "on_time")


@query(f"""WITH {_E}, n AS (SELECT event_id, event_type, cents, row_number() OVER (PARTITION BY event_type, t // 86400 ORDER BY cents) AS r, count(*) OVER (PARTITION BY event_type, t // 86400) AS n, t // 86400 AS day FROM e),
        q AS (SELECT event_type, day, min(cents) FILTER (WHERE r >= ceil(0.95 * n)) AS bound FROM n GROUP BY 1, 2) SELECT event_id, event_type, cents FROM n JOIN q USING (event_type, day) WHERE cents >= bound""")
def threshold_filter_anomalous(spark, d):
    rows = events(spark, d).withColumn("day", F.floor(F.col("t") / 86400))
    bounds = subs.quantile_thresholds(rows, {"event_type": F.col("event_type"), "day": F.col("day")}, F.col("cents"), 0.95)
    return subs.above_threshold(rows, "cents", bounds, ["event_type", "day"]).select("event_id", "event_type", "cents")


@query(f"WITH {_E}, c AS (SELECT t, max(cents)::DOUBLE AS bound FROM e WHERE event_type = 'signup' GROUP BY 1) SELECT event_id, (SELECT arg_max(bound, c.t) FROM c WHERE c.t <= e.t) AS threshold FROM e WHERE event_type = 'purchase'")
def threshold_in_force(spark, d):
    rows = events(spark, d)
    return subs.in_force(rows.where("event_type = 'purchase'"), "t", rows.where("event_type = 'signup'").select("t", "cents"), "t", "cents").select("event_id", "threshold")


_WAIT_SQL = "(unix_micros(arrival_time) - unix_micros(time)) div 1000"
_STEP = "CASE WHEN abs(ms) < 10 THEN 2 WHEN abs(ms) < 100 THEN 10 WHEN abs(ms) < 1000 THEN 20 ELSE 100 END"


@query(f"WITH l AS (SELECT site, (epoch_us(arrival_time) - epoch_us(time)) // 1000 AS ms FROM web_requests WHERE time IS NOT NULL) SELECT site AS host, 'arrival' AS label, ms - ms % ({_STEP}) AS bucket, count(*) AS count FROM l GROUP BY 1, 3")
def latency_histogram(spark, d):
    rows = load(spark, d, "web_requests").where("time is not null")
    return subs.latency_histogram(rows, "site", F.expr(_WAIT_SQL), "arrival")


@query(f"""WITH {_E}, a AS (SELECT t // 3600 * 3600 AS time, event_type, count(*) AS n FROM e WHERE event_id % 10 <> 0 GROUP BY 1, 2), b AS (SELECT t // 3600 * 3600 AS time, event_type, count(*) AS n FROM e GROUP BY 1, 2)
        SELECT b.time, b.event_type, a.n AS old_cnt, b.n AS new_cnt FROM b LEFT JOIN a USING (time, event_type) WHERE a.n IS DISTINCT FROM b.n""")
def cube_changes(spark, d):
    spec = CubeSpec("c", [Dimension("time", "time", "t"), Dimension("event_type")], [Aggregate("cnt")])
    rows = events(spark, d).withColumn("t", F.col("t") - F.col("t") % 3600)
    return subs.changes(Cube.build(spec, rows.where("event_id % 10 <> 0")), Cube.build(spec, rows))


@query("SELECT doc_id AS id, text FROM documents WHERE lang = 'de' UNION ALL SELECT doc_id, text_b FROM documents WHERE lang_b = 'de'")
def union_streams(spark, d):
    """Two edges of a flow into one operator."""
    docs, flow = load(spark, d, "documents"), Flow()
    a = flow.add_source(docs.where("lang = 'de'").select(F.col("doc_id").alias("id"), "text"))
    b = flow.add_source(docs.where("lang_b = 'de'").select(F.col("doc_id").alias("id"), F.col("text_b").alias("text")))
    out = flow.add_operator("no_op")
    flow.connect(a, out)
    flow.connect(b, out)
    return flow.build(out)


# sources


@query()
def read_blobs(spark, d):
    """The tables' files as blobs, and those that are left out for their size."""
    name = F.regexp_extract("path", "[^/]*$", 0).alias("name")
    read = files.blobs(spark, d).select(name, F.length("bytes").cast("bigint").alias("size"), F.lit(False).alias("omitted"))
    return read.unionByName(files.omitted_blobs(spark, d).select(name, F.col("length").alias("size"), F.lit(True).alias("omitted")))


@query("SELECT 'foo' AS text, range AS version FROM range(1000)")
def send_k(spark, d):
    return generators.send_k(spark, 1000)


_MADE = "v AS (SELECT r.range AS id, ((r.range * 50 + i.range) * 2654435761) % 4294967296 % 10000 AS value FROM range(2000) r, range(50) i)"


@query(f"""WITH {_MADE}, k AS (SELECT (id % 10)::INTEGER AS key, value FROM v), {_hist_sql(100, 'key', 'value', 'k')}, m(b, mid) AS (VALUES {_BOUNDS100}),
        c AS (SELECT key, b, sum(n) OVER (PARTITION BY key ORDER BY b) AS cum, sum(n) OVER (PARTITION BY key) AS total FROM h100), f AS (SELECT key, min(b) AS b, max(total)::BIGINT AS population FROM c WHERE cum >= total * 0.5 GROUP BY 1)
        SELECT key, population, mid::INTEGER AS median FROM f JOIN m USING (b)""")
def random_histograms(spark, d):
    made = generators.random_histograms(spark, 2000, 10, 100)
    return made.groupBy("key").agg(loghist.merged("histogram", 100).alias("h")).select("key", loghist.population(F.col("h")).alias("population"), loghist.quantile(F.col("h"), 100, 0.5).alias("median"))


@query(f"""WITH {_MADE}, k AS (SELECT CASE WHEN id // 100 < 8 THEN 100 WHEN id // 100 < 15 THEN 50 ELSE 30 END AS buckets, value FROM v),
        h AS ({" UNION ALL ".join(f"SELECT buckets, b FROM (SELECT buckets, (SELECT max(b) FROM (VALUES {', '.join(f'({i}, {s})' for i, s in enumerate(_STARTS[n]))}) x(b, s) WHERE s <= value) AS b FROM k WHERE buckets = {n})" for n in (100, 50, 30))})
        SELECT buckets, b::INTEGER AS bucket, count(*) AS n FROM h GROUP BY 1, 2""")
def adaptive_histograms(spark, d):
    """Histograms whose size steps down on a schedule, as under congestion; merged by size."""
    made = generators.random_histograms(spark, 2000, 10, 100, schedule=[(8, 50), (15, 30)])
    bars = made.select("buckets", F.posexplode("histogram").alias("bucket", "n")).where("n > 0")
    return bars.groupBy("buckets", "bucket").agg(F.sum("n").alias("n"))


_WHOLE = sum(generators.STATES.values())


def _label_sql() -> str:
    upto, cases = 0.0, []
    for label, weight in generators.STATES.items():
        upto += weight / _WHOLE
        cases.append((upto, label))
    return "CASE " + " ".join(f"WHEN place < {u!r}::DOUBLE THEN '{n}'" for u, n in cases[:-1]) + f" ELSE '{cases[-1][1]}' END"


@query(f"""WITH l AS (SELECT range // 1000 AS period, {_label_sql()} AS label FROM (SELECT range, (range * 0.6180339887498949::DOUBLE) % 1.0::DOUBLE AS place FROM range(20000))), c AS (SELECT period, label, count(*) AS n FROM l GROUP BY 1, 2), p AS (SELECT period, sum(n)::BIGINT AS rows FROM c GROUP BY 1),
        x AS (SELECT p.period, p.rows, coalesce(c.n, 0)::DOUBLE AS real, p.rows * w.share AS want FROM p, (VALUES {", ".join(f"('{n}', {w / _WHOLE!r}::DOUBLE)" for n, w in generators.STATES.items())}) w(label, share) LEFT JOIN c ON c.period = p.period AND c.label = w.label)
        SELECT period, rows, min(least(real, want) / greatest(real, want)) AS evenness FROM x GROUP BY 1, 2""")
def random_label_evenness(spark, d):
    made = generators.random_labels(spark, 20_000)
    return evaluate.evenness(made, F.col("time"), "label", F.lit(1), generators.STATES)


_TYPES = {"view": 1.0, "click": 1.0, "purchase": 1.0, "signup": 1.0, "error": 1.0}


@query(f"""WITH {_E}, c AS (SELECT t // 86400 AS period, event_type, count(*) AS n FROM e GROUP BY 1, 2), p AS (SELECT period, sum(n)::BIGINT AS rows FROM c GROUP BY 1),
        x AS (SELECT p.period, p.rows, k.event_type, coalesce(c.n, 0)::DOUBLE AS real, p.rows * 0.2::DOUBLE AS want FROM p, (VALUES ('view'), ('click'), ('purchase'), ('signup'), ('error')) k(event_type) LEFT JOIN c ON c.period = p.period AND c.event_type = k.event_type)
        SELECT period, rows, min(least(real, want) / greatest(real, want)) AS evenness FROM x GROUP BY 1, 2""")
def evenness_eval(spark, d):
    return evaluate.evenness(events(spark, d), F.floor(F.col("t") / 86400), "event_type", F.lit(1), _TYPES)


# the reference workloads over web requests


@query(f"WITH {_R} SELECT site AS host, count(*) AS n FROM r WHERE regexp_matches(url, '\\.(png|js)$') GROUP BY 1")
def dist_grep_count(spark, d):
    return filters.grep(requests(spark, d), "url", r"\.(png|js)$").groupBy(F.col("site").alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_T}, s AS (SELECT t // 1800 * 1800 AS "window", url AS key, count(*) AS total FROM r WHERE url IS NOT NULL AND NOT contains(url, ' ') GROUP BY 1, 2)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "window" ORDER BY total DESC, key)::INTEGER AS rank FROM s) WHERE rank <= 20""")
def apache_topk(spark, d):
    """Access lines that have a time, parsed for their url, and the top 20 of each half hour."""
    raw = timed_requests(spark, d).select("t", F.concat(F.lit("GET "), "url", F.lit(" HTTP")).alias("line"))
    parsed = parse.generic_parse(raw, "line", r".*GET ([^ ]*) .*", "S", ["url"])
    return topk.windowed_topk(parsed, F.col("t") - F.pmod(F.col("t"), F.lit(1800)), "url", F.lit(1), 20)


_WEB = "sum(n)::BIGINT AS count, sum(size)::DOUBLE / nullif(sum(sizes), 0) AS avg_size, max(version) AS version"


@query(f"WITH {_R} SELECT 0::BIGINT AS time, '0' AS url, response_code, {_WEB} FROM r GROUP BY response_code")
def respcode_counts(spark, d):
    return web_cube(spark, d).query(CubeQuery(levels={"time": 0, "url": 0}))


@query(f"WITH {_T} SELECT t // 5 * 5 AS time, '0' AS url, 0 AS response_code, {_WEB} FROM r GROUP BY 1")
def requests_by_5s(spark, d):
    """Of the requests that have a time."""
    return web_cube(spark, d, timed_requests).query(CubeQuery(levels={"time": 8, "url": 0, "response_code": 0}))


@query(f"""WITH {_T}, s AS (SELECT t // 30 * 30 AS time, url, 0 AS response_code, {_WEB} FROM r GROUP BY 1, 2)
        SELECT * EXCLUDE (k) FROM (SELECT *, time AS window_start, row_number() OVER (PARTITION BY time ORDER BY count DESC, url NULLS FIRST) AS k FROM s) WHERE k <= 10""")
def url_counts_30s(spark, d):
    """Of the requests that have a time."""
    return subs.windowed(web_cube(spark, d, timed_requests), "time", 30, -(2**40) * 30, CubeQuery(levels={"time": 6, "response_code": 0}, sort=["-count"], limit=10))


@query(f"""WITH {_T}, s AS (SELECT t // 300 * 300 AS "window", coalesce(string_split(url, '/')[3], url) AS key, sum(n)::BIGINT AS total FROM r GROUP BY 1, 2)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "window" ORDER BY total DESC, key NULLS FIRST)::INTEGER AS rank FROM s) WHERE rank <= 10""")
def domain_counts_5min(spark, d):
    """Of the requests that have a time."""
    return topk.windowed_topk(transform.url_to_domain(timed_requests(spark, d), "url"), F.col("t") - F.pmod(F.col("t"), F.lit(300)), "url", F.col("n"), 10)


@query(f"""WITH {_R}, x AS (SELECT response_code, size FROM r WHERE size IS NOT NULL), c AS (SELECT response_code, size, row_number() OVER (PARTITION BY response_code ORDER BY size) AS k, count(*) OVER (PARTITION BY response_code) AS n FROM x)
        SELECT response_code, min(size) FILTER (WHERE k >= ceil(0.95 * n)) AS size_p95, max(n) AS requests FROM c GROUP BY 1""")
def quantiles_by_code(spark, d):
    from rillcube.operators.weighted import percentiles, value_counts

    counts = value_counts(requests(spark, d), {"response_code": F.col("response_code")}, F.col("size"))
    return percentiles(counts, [0.95]).select("response_code", F.col("value").alias("size_p95"), F.col("rows").alias("requests"))


@query(f"""WITH x AS (SELECT epoch_us(time) // 1000000 // 5 * 5 AS time, response_code, avg_size_sum::BIGINT AS size, (epoch_us(arrival_time) - epoch_us(time)) // 1000 AS delay FROM web_requests WHERE time IS NOT NULL),
        s AS (SELECT time, response_code, size, row_number() OVER (PARTITION BY time, response_code ORDER BY size) AS k, count(*) OVER (PARTITION BY time, response_code) AS n FROM x WHERE size IS NOT NULL),
        l AS (SELECT time, response_code, delay, row_number() OVER (PARTITION BY time, response_code ORDER BY delay) AS k, count(*) OVER (PARTITION BY time, response_code) AS n FROM x),
        p AS (SELECT time, response_code, min(size) FILTER (WHERE k >= ceil(0.95 * n)) AS size_p95 FROM s GROUP BY 1, 2), q AS (SELECT time, response_code, min(delay) FILTER (WHERE k >= ceil(0.95 * n)) AS delay_p95, max(n) AS requests FROM l GROUP BY 1, 2)
        SELECT q.time, q.response_code, size_p95, delay_p95, requests FROM q LEFT JOIN p ON q.time = p.time AND q.response_code IS NOT DISTINCT FROM p.response_code""")
def quantiles_by_5s_code(spark, d):
    """Of the requests that have a time: 95th percentiles of size and arrival delay (ms) per five seconds and code."""
    from rillcube.operators.weighted import percentiles, value_counts

    rows = load(spark, d, "web_requests").where("time is not null")
    seconds = F.unix_seconds("time")
    keys = {"measure": F.col("m.measure"), "time": F.col("t"), "response_code": F.col("response_code")}
    measures = F.array(F.struct(F.lit("size").alias("measure"), F.col("avg_size_sum").cast("long").alias("v")), F.struct(F.lit("delay").alias("measure"), F.expr(_WAIT_SQL).alias("v")))
    both = rows.select((seconds - F.pmod(seconds, F.lit(5))).alias("t"), "response_code", F.explode(measures).alias("m"))
    found = percentiles(value_counts(both, keys, F.col("m.v")), [0.95])
    of = lambda measure, column: F.max(F.when(F.col("measure") == measure, F.col(column)))
    return found.groupBy("time", "response_code").agg(of("size", "value").alias("size_p95"), of("delay", "value").alias("delay_p95"), of("delay", "rows").alias("requests"))


@query(f"WITH {_R} SELECT tuple_id, url FROM r WHERE sizes = 0 OR size / nullif(sizes, 0)::DOUBLE > 20000")
def slow_requests(spark, d):
    return filters.ratio_above(requests(spark, d), "size", "sizes", 20000).select("tuple_id", "url")


@query(f"""WITH {_R}, s AS (SELECT coalesce(string_split(url, '/')[3], url) AS domain, sum(n)::BIGINT AS total, sum(CASE WHEN response_code = 200 THEN n ELSE 0 END)::DOUBLE / sum(n) AS ratio FROM r GROUP BY 1)
        SELECT * FROM s ORDER BY ratio DESC, domain NULLS FIRST LIMIT 5""")
def worst_domains(spark, d):
    ratios = transform.success_ratio(requests(spark, d), {"domain": transform.domain(F.col("url"))}, "response_code", "n")
    return ratios.orderBy(F.desc("ratio"), F.asc_nulls_first("domain")).limit(5)


@query(f"WITH {_R} SELECT coalesce(string_split(url, '/')[3], url) AS key, sum(n)::BIGINT AS total FROM r WHERE response_code = 404 GROUP BY 1 ORDER BY total DESC, key NULLS FIRST LIMIT 10")
def bad_domains(spark, d):
    missing = transform.url_to_domain(filters.equals(requests(spark, d), "response_code", 404), "url")
    return topk.exact_topk(missing, "url", F.col("n"), 10)


@query(f"WITH {_T} SELECT site, t // 300 * 300 AS time, sum(size)::BIGINT AS bytes FROM r GROUP BY 1, 2")
def bw_by_node(spark, d):
    """Of the requests that have a time."""
    spec = CubeSpec("bw", [Dimension("site"), Dimension("time", "time_containment", "t")], [Aggregate("bytes", "sum", ("size",))])
    return Cube.build(spec, timed_requests(spark, d)).query(CubeQuery(levels={"time": 4})).drop("version")


@query(f"WITH {_R}, {_hist_sql(100, 'site', 'size', 'r')}, c AS (SELECT site, b, sum(n) OVER (PARTITION BY site ORDER BY b) AS cum, sum(n) OVER (PARTITION BY site) AS total FROM h100), f AS (SELECT site, min(b) AS b FROM c WHERE cum >= total * 0.95 GROUP BY 1), m(b, mid) AS (VALUES {_BOUNDS100}) SELECT site, mid::INTEGER AS p95 FROM f JOIN m USING (b)")
def bw_histogram(spark, d):
    h = loghist.histogram(requests(spark, d), ["site"], F.col("size"), 100)
    return h.select("site", loghist.quantile(F.col("histogram"), 100, 0.95).alias("p95"))


@query(f"""WITH {_R}, x AS (SELECT size, row_number() OVER (ORDER BY size) AS k, count(*) OVER () AS n FROM r WHERE size IS NOT NULL), q AS (SELECT min(size) AS bound FROM x WHERE k >= ceil(0.95 * n))
        SELECT tuple_id, url, size FROM r, q WHERE size >= bound""")
def anomalous_requests(spark, d):
    found = requests(spark, d)
    return subs.above_threshold(found, "size", subs.quantile_thresholds(found, {}, F.col("size"), 0.95)).select("tuple_id", "url", "size")


@query(f"""WITH {_T}, x AS (SELECT t // 3600 AS hour, size, row_number() OVER (PARTITION BY t // 3600 ORDER BY size) AS k, count(*) OVER (PARTITION BY t // 3600) AS n FROM r WHERE size IS NOT NULL), q AS (SELECT hour, min(size) AS bound FROM x WHERE k >= ceil(0.95 * n) GROUP BY 1)
        SELECT tuple_id, url, size FROM r LEFT JOIN q ON t // 3600 = hour WHERE bound IS NULL OR size >= bound""")
def anomalous_by_hour(spark, d):
    """Requests of at least their hour's 95th percentile of size; of the requests that have a time."""
    found = timed_requests(spark, d).withColumn("hour", F.floor(F.col("t") / 3600))
    return subs.above_threshold(found, "size", subs.quantile_thresholds(found, {"hour": F.col("hour")}, F.col("size"), 0.95), ["hour"]).select("tuple_id", "url", "size")


@query(f"WITH {_R}, s AS (SELECT url AS key, sum(n)::BIGINT AS total FROM r GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY total DESC, key NULLS FIRST) AS i FROM s) SELECT k::INTEGER AS k, key, total FROM o, (VALUES (1), (5), (20)) x(k) WHERE i <= k")
def multiround_sweep(spark, d):
    out, local = None, topk.local_sums(requests(spark, d), "site", "url", F.col("n"))
    for k in (1, 5, 20):
        one = topk.tput_rounds(local, k).select(F.lit(k).alias("k"), "key", "total")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {_R} SELECT url, count(*) AS n FROM r GROUP BY 1")
def agent_counts(spark, d):
    return requests(spark, d).groupBy("url").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_R} SELECT t AS time, coalesce(string_split(url, '/')[3], url) AS url, response_code, {_WEB} FROM r GROUP BY 1, 2, 3")
def raw_cube_by_domain(spark, d):
    return Cube.build(WEB_SPEC, transform.url_to_domain(requests(spark, d), "url")).finalize()


def _report_sql(condition: str = "true") -> str:
    return f"""WITH l AS (SELECT floor(epoch_us(arrival_time) / 3600000000.0)::BIGINT AS period, site AS source, coalesce(avg_size_sum, 0)::BIGINT AS size, (epoch_us(arrival_time) - epoch_us(time)) // 1000 AS latency FROM web_requests WHERE time IS NOT NULL AND time <= arrival_time AND {condition}),
        s AS (SELECT period, source, sum(size) AS size FROM l GROUP BY 1, 2), g AS (SELECT period, round(stddev_pop(size), 3) AS source_deviation, count(*) AS sources FROM s GROUP BY 1),
        k AS (SELECT period, latency, row_number() OVER (PARTITION BY period ORDER BY latency) AS k, count(*) OVER (PARTITION BY period) AS n FROM l), q AS (SELECT period, min(latency) FILTER (WHERE k >= ceil(0.5 * n)) AS median, min(latency) FILTER (WHERE k >= ceil(0.95 * n)) AS p95, min(latency) FILTER (WHERE k >= ceil(0.999 * n)) AS p999 FROM k GROUP BY 1)
        SELECT period, sum(size)::BIGINT AS bytes, count(*) AS items, any_value(median) AS median, any_value(p95) AS p95, any_value(p999) AS p999, max(latency) AS max_latency, count(*) FILTER (WHERE latency > 30000) AS very_late, any_value(source_deviation) AS source_deviation, any_value(sources) AS sources FROM l JOIN g USING (period) JOIN q USING (period) GROUP BY 1"""


def _report(rows: DataFrame) -> DataFrame:
    report = evaluate.latency_report(rows, F.floor(F.unix_micros("arrival_time") / 3_600_000_000), "site", F.coalesce("avg_size_sum", F.lit(0)).cast("bigint"), F.expr(_WAIT_SQL), 30_000)
    return report.withColumn("source_deviation", F.round("source_deviation", 3))


@query(_report_sql())
def image_quality_stats(spark, d):
    """Of the requests that have a time not after their arrival."""
    return _report(load(spark, d, "web_requests").where("time is not null and time <= arrival_time"))


@query(_report_sql("(tuple_id % 4294967296 * 2654435761) % 4294967296 >= 2147483648"))
def image_quality_sampled(spark, d):
    """The same behind a sampling stage that keeps half of the requests by a hash of their id."""
    rows = load(spark, d, "web_requests").where("time is not null and time <= arrival_time")
    return _report(sampling.hash_sample(rows, "tuple_id", 0.5))


_FOLDS = (5, 60, 300, 3600, 0)


@query(f"""WITH {_T}, f AS (SELECT x.fold, CASE WHEN x.fold = 0 THEN 0 ELSE t - t % nullif(x.fold, 0) END AS b, url, coalesce(string_split(url, '/')[3], url) AS d FROM r, (VALUES (5), (60), (300), (3600), (0)) x(fold)),
        u AS (SELECT fold, sum(n)::BIGINT AS rows, count(*) AS url_keys FROM (SELECT fold, b, url, count(*) AS n FROM f GROUP BY 1, 2, 3) GROUP BY 1), v AS (SELECT fold, count(*) AS domain_keys FROM (SELECT DISTINCT fold, b, d FROM f) GROUP BY 1)
        SELECT fold, rows, url_keys, domain_keys, rows / url_keys::DOUBLE AS url_ratio, rows / domain_keys::DOUBLE AS domain_ratio FROM u JOIN v USING (fold)""")
def key_compression(spark, d):
    """Of the requests that have a time."""
    return evaluate.key_compression(timed_requests(spark, d), F.col("t"), F.col("url"), _FOLDS)


@query(f"""WITH {_E}, x AS (SELECT t // 86400 * 86400 AS day, cents, row_number() OVER (PARTITION BY t // 86400 ORDER BY cents) AS k, count(*) OVER (PARTITION BY t // 86400) AS n FROM e)
        SELECT day, p, cents AS value FROM x, (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE)) q(p) WHERE k = least(floor(p * n)::BIGINT + 1, n)""")
def truth_quantiles(spark, d):
    from rillcube.operators.weighted import at_place, percentiles, value_counts

    counts = value_counts(events(spark, d), {"day": F.col("t") - F.col("t") % 86400}, F.col("cents"))
    return percentiles(counts, [0.05, 0.1, 0.5, 0.9, 0.95], rank=at_place).select("day", "p", "value")


@query(f"""WITH {_R}, s AS (SELECT coalesce(string_split(url, '/')[3], url, '') AS host, n FROM r), a AS (SELECT array_to_string(list_slice(string_split(host, '.'), 1, i), '.') AS host, n FROM (SELECT host, n, unnest(range(0, CASE WHEN host = '' THEN 1 ELSE len(string_split(host, '.')) + 1 END)) AS i FROM s)) SELECT host, sum(n)::BIGINT AS n FROM a GROUP BY 1""")
def hierarchy_counts(spark, d):
    hosts = requests(spark, d).select(F.coalesce(transform.domain(F.col("url")), F.lit("")).alias("host"), "n")
    return evaluate.hierarchy_counts(hosts, {"host": F.col("host")}, {"host": r"\."}, F.col("n"))


# streams


@query(f"WITH {_E} SELECT t // 3600 * 3600 AS time, event_type, count(*) AS cnt FROM e GROUP BY 1, 2")
def stream_windows(spark, d):
    """Hourly windows of the event file read as a stream, in complete mode."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = windows.windowed_stream(stream, "ts", "1 hour", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("cnt")])
    root = f"{checkpoint_dir(spark)}/stream-windows-{uuid.uuid4().hex}"
    return kept(windows.run_available(out, root, "complete").select(F.unix_seconds("window_start").alias("time"), "event_type", "cnt"), root)


@query(f"""WITH {_E}, mark AS (SELECT least(max(epoch_us(ts)) FILTER (WHERE event_type = 'view'), max(epoch_us(ts)) FILTER (WHERE event_type <> 'view')) - 3600000000 AS us FROM events)
        SELECT t // 3600 * 3600 AS time, event_type, count(*) AS cnt FROM e, mark WHERE (t // 3600 + 1) * 3600 * 1000000 <= us // 1000 * 1000 GROUP BY 1, 2""")
def stream_closed_windows(spark, d):
    """Hourly windows of two streams that the lesser of their watermarks has closed, in append mode."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = lambda: spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = windows.closed_windows([stream().where("event_type = 'view'"), stream().where("event_type <> 'view'")], "ts", "1 hour", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("cnt")])
    root = f"{checkpoint_dir(spark)}/stream-closed-{uuid.uuid4().hex}"
    return kept(windows.run_available(out, root).select(F.unix_seconds("window_start").alias("time"), "event_type", "cnt"), root)


@query(f"WITH {_E} SELECT t AS time, event_type, {_CELL} FROM e GROUP BY 1, 2")
def stream_cube(spark, d):
    """The event file as a stream into a cube at rest, asked once the stream has ended."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    raw = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet")
    rows = raw.select("event_id", transform.epoch_seconds(raw, "ts").alias("t"), "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    root = f"{checkpoint_dir(spark)}/stream-cube-{uuid.uuid4().hex}"
    catalog = CubeCatalog(spark, f"{root}/cubes")
    catalog.create(EVENT_SPEC)
    return kept(windows.delayed_one_shot(rows, lambda df, n: catalog.insert("events", df, int(n)), lambda: catalog.get("events").finalize(), f"{root}/checkpoint"), root)
