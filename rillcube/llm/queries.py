"""The queries of problems 4, 5, 7, 8 and 9, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillcube.llm import frequent, mixing, packing, percentiles, stuffing
from rillcube.llm.tokens import token_count
from rillcube.session import checkpoint_dir, load

PROBABILITIES = (0.5, 0.9, 0.95, 0.99)
STATE_BITS = 10
HEAVY_SHARE = 0.005


def _values(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    known = {"url": F.col("url"), "site": F.col("site"), "day": F.floor(F.col("t_val") / 86400).cast("long")}
    return percentiles.measurements(load(spark, d, "latency_elements"), {k: known[k] for k in keep})


def p4_url_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of download times per url."""
    counts = percentiles.state(_values(spark, d, "url"), ["url"])
    return percentiles.percentiles(counts, PROBABILITIES).select("url", "p", "value", F.col("rows").alias("measured"))


def p4_combined_states(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per url from states computed apart by site and day, with a relative error of at most 2 ** -11."""
    apart = percentiles.state(_values(spark, d, "url", "site", "day"), ["url", "site", "day"], STATE_BITS)
    return percentiles.percentiles(percentiles.roll_up(apart, ["url"]), PROBABILITIES).select("url", "p", "value", F.col("rows").alias("measured"))


def p4_daily_medians(spark: SparkSession, d: str) -> DataFrame:
    counts = percentiles.state(_values(spark, d, "url", "day"), ["url", "day"])
    return percentiles.percentiles(counts, [0.5]).select("url", "day", "value", F.col("rows").alias("measured"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return frequent.at_least(load(spark, d, "web_requests"), "url", "count", HEAVY_SHARE).select(F.col("value").alias("url"))


def p5_top_urls(spark: SparkSession, d: str) -> DataFrame:
    return frequent.heaviest(load(spark, d, "web_requests"), "url", "count", 100).select(F.col("value").alias("url"), F.col("weight").alias("count_total"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    """Ids, labels and token counts; a written table, as counting tokens is dear and each plan reads it more than once."""
    checkpoint_dir(spark)
    return load(spark, d, "documents").select(F.col("doc_id").alias("id"), mixing.label(F.col("source")).alias("source"), token_count(F.col("text")).alias("size")).checkpoint()


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sized = _sized(spark, d).select("id", "size")
    kinds = [(r["container"], r["capacity_tokens"]) for r in load(spark, d, "pack_sizes").collect()]  # three rows, fixed
    return packing.pack_items(sized, kinds, sized.count())


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).withColumnsRenamed({"id": "doc_id", "first": "first_token", "size": "tokens"})


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are: tokens against capacity."""
    bins = _packed(spark, d).groupBy("container", "capacity", "bin").agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("pieces"))
    return bins.groupBy("container", "capacity").agg(F.count(F.lit(1)).alias("bins"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), F.sum("pieces").alias("pieces")).withColumn("fill", F.col("tokens") / (F.col("bins") * F.col("capacity")))


def p7_violations(spark: SparkSession, d: str) -> DataFrame:
    """What a sound packing has none of: overfull containers, items cut without need, and items that are not there in full."""
    sized = _sized(spark, d).select("id", "size")
    kinds = [(r["container"], r["capacity_tokens"]) for r in load(spark, d, "pack_sizes").collect()]  # three rows, fixed
    packed = packing.pack_items(sized, kinds, sized.count())
    overfull = packed.groupBy("container", "capacity", "bin").agg(F.sum("size").alias("tokens")).where("tokens > capacity").select("container", F.lit("overfull").alias("kind"), F.col("bin").alias("id"))
    items = packed.groupBy("container", "capacity", "id").agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("pieces"), F.max("size").alias("largest"))
    cut = items.where("pieces > 1 and tokens <= capacity").select("container", F.lit("cut").alias("kind"), "id")
    wanted = sized.select(F.col("id").alias("w_id"), "size", F.explode(F.array(*[F.lit(n) for n, _ in kinds])).alias("w_container"))
    both = wanted.join(items, (F.col("w_id") == F.col("id")) & (F.col("w_container") == F.col("container")), "full")
    lost = both.where("tokens is null or size is null or tokens <> size").select(F.coalesce("container", "w_container").alias("container"), F.lit("lost").alias("kind"), F.coalesce("id", "w_id").alias("id"))
    return overfull.unionByName(cut).unionByName(lost)


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, list[mixing.Plan]]:
    records = mixing.hashed(_sized(spark, d))
    targets = load(spark, d, "mix_targets").select(mixing.label(F.col("source")).alias("source"), "target_share", "max_repeats").collect()  # eight rows, fixed
    plans = mixing.make_plan(records, [mixing.Target(r["source"], r["target_share"], r["max_repeats"]) for r in targets])
    return mixing.take(records, plans), plans


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    taken, _ = _mixed(spark, d)
    return taken.select(F.col("id").alias("doc_id"), "source", F.col("size").alias("tokens"), "copies")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*_mixed(spark, d))


def p8_violations(spark: SparkSession, d: str) -> DataFrame:
    """What a sound mix has none of: records given more often than their source may repeat, records of no source of the targets, and
    sources whose share is off what is wanted by more than records on the boundaries explain."""
    taken, plans = _mixed(spark, d)
    caps = load(spark, d, "mix_targets").select(mixing.label(F.col("source")).alias("c_source"), "max_repeats")
    joined = taken.join(F.broadcast(caps), F.col("source") == F.col("c_source"), "left")  # eight rows, fixed
    over = joined.where("max_repeats is null or copies > max_repeats").select("source", F.lit("copies").alias("kind"), F.col("id").alias("doc_id"))
    whole = taken.agg(F.sum(F.col("size") * F.col("copies")).alias("w")).scalar()
    largest = taken.groupBy(F.col("source").alias("l_source")).agg(F.max("size").alias("largest"))
    off = mixing.shares(taken, plans).join(largest, F.col("source") == F.col("l_source"), "left")
    # the tolerance of a plan, and one record of this and of the other sources
    off = off.where(F.abs(F.col("actual_share") - F.col("wanted_share")) > 2 * mixing.TOLERANCE + (F.coalesce("largest", F.lit(0)) + taken.agg(F.max("size").alias("m")).scalar() * len(plans)) / whole)
    return over.unionByName(off.select("source", F.lit("share").alias("kind"), F.lit(None).cast("bigint").alias("doc_id")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.judge_pages(load(spark, d, "documents").select("doc_id", "text")).where("page.stuffed").select("doc_id")


QUERIES = {f.__name__: f for f in (p4_url_percentiles, p4_combined_states, p4_daily_medians, p5_found, p5_top_urls, p7_packed, p7_fill, p7_violations, p8_mix, p8_shares, p8_violations, p9_found)}

_MEASURED = """
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, version, CASE WHEN site IS NULL OR version IS NULL THEN tuple_id END ORDER BY tuple_id) AS nth FROM latency_elements) WHERE nth = 1),
v AS (SELECT url, site, floor(t_val / 86400)::BIGINT AS day, i_val::BIGINT AS v FROM once WHERE i_val IS NOT NULL AND i_val <> -1
      UNION ALL SELECT url, site, floor(t_val / 86400)::BIGINT, unnest(summary)::BIGINT FROM once)
"""


def _ranked(groups: str, probabilities: tuple[float, ...], value: str = "v") -> str:
    """Percentiles by cumulative frequencies over the table v."""
    return f"""
        n AS (SELECT {groups}, {value} AS v, count(*) AS n FROM v WHERE v IS NOT NULL GROUP BY ALL),
        c AS (SELECT *, sum(n) OVER (PARTITION BY {groups} ORDER BY v) AS cum, sum(n) OVER (PARTITION BY {groups}) AS total FROM n),
        p AS (SELECT unnest([{", ".join(map(str, probabilities))}])::DOUBLE AS p),
        r AS (SELECT {groups}, p, v::BIGINT AS value, total::BIGINT AS measured FROM c, p WHERE greatest(1, ceil(p * total)) <= cum AND greatest(1, ceil(p * total)) > cum - n)"""


_CELL = "(CASE WHEN v < 0 THEN -1 ELSE 1 END) * (CASE WHEN abs(v) < 2048 THEN abs(v) ELSE ((abs(v) >> (length(bin(abs(v))) - 11)) << (length(bin(abs(v))) - 11)) + (1::BIGINT << (length(bin(abs(v))) - 12)) END)"

SQL = {
    "p4_url_percentiles": f"WITH {_MEASURED}, {_ranked('url', PROBABILITIES)} SELECT * FROM r",
    "p4_combined_states": f"WITH {_MEASURED}, {_ranked('url', PROBABILITIES, _CELL)} SELECT * FROM r",
    "p4_daily_medians": f"WITH {_MEASURED}, {_ranked('url, day', (0.5,))} SELECT url, day, value, measured FROM r",
    "p7_violations": "SELECT '' AS container, '' AS kind, 0::BIGINT AS id WHERE false",
    "p8_violations": "SELECT '' AS source, '' AS kind, 0::BIGINT AS doc_id WHERE false",
    "p5_found": "SELECT url FROM web_requests WHERE url IS NOT NULL GROUP BY url HAVING sum(coalesce(count, 1)) >= 0.005 * (SELECT sum(coalesce(count, 1)) FROM web_requests)",
    "p5_top_urls": "SELECT url, sum(coalesce(count, 1))::BIGINT AS count_total FROM web_requests WHERE url IS NOT NULL GROUP BY url ORDER BY count_total DESC, url LIMIT 100",
}
