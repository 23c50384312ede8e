"""Top-k: direct, per window and by the three-round threshold algorithm.

Keys with equal sums go by the key, ascending.  Null keys take part like any key; null values add nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillcube.session import checkpoint_dir


def exact_topk(df: DataFrame, key: str, value: Column, k: int) -> DataFrame:
    """``key, total`` of the k largest sums: map-side combine, one shuffle, a bounded heap per task."""
    return df.groupBy(F.col(f"`{key}`").alias("key")).agg(F.sum(value).alias("total")).orderBy(F.desc_nulls_last("total"), F.asc_nulls_first("key")).limit(k)


def windowed_topk(df: DataFrame, window: Column, key: str, value: Column, k: int) -> DataFrame:
    """The k largest sums of each window: ``window, key, total, rank``."""
    sums = df.groupBy(window.alias("window"), F.col(f"`{key}`").alias("key")).agg(F.sum(value).alias("total"))
    order = Window.partitionBy("window").orderBy(F.desc_nulls_last("total"), F.asc_nulls_first("key"))
    return sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def local_sums(df: DataFrame, site: str, key: str, value: Column) -> DataFrame:
    """What the sites hold: ``site, key, v``, written once (every round asks it again)."""
    checkpoint_dir(df.sparkSession)
    sums = df.groupBy(F.col(f"`{site}`").alias("site"), F.col(f"`{key}`").alias("key")).agg(F.sum(value).alias("v"))
    return sums.where("v is not null").checkpoint()


def tput_topk(df: DataFrame, site: str, key: str, value: Column, k: int) -> DataFrame:
    """The k largest sums over sites that each hold part of every key, for sums that are not negative."""
    return tput_rounds(local_sums(df, site, key, value), k)


def tput_rounds(local: DataFrame, k: int) -> DataFrame:
    """The three rounds over the sites' sums.

    Round 1 takes each site's own top k and lifts the k-th partial sum to a threshold; round 2 adds what any site has at
    or above threshold / sites and raises it; round 3 fetches exact sums of the keys whose upper bound reaches it.
    Thresholds are scalar subqueries, and candidates go to the sites as a semi-join.
    """
    sites = local.agg(F.count_distinct(F.struct("site")).alias("m"))
    own = Window.partitionBy("site").orderBy(F.desc("v"), F.asc_nulls_first("key"))
    first = local.withColumn("r", F.row_number().over(own)).where(F.col("r") <= k).drop("r")

    def kth(parts: DataFrame) -> DataFrame:
        # the least of the k largest sums; with fewer than k keys nothing may be cut
        top = parts.orderBy(F.desc("seen")).limit(k)
        return top.agg(F.when(F.count(F.lit(1)) >= k, F.min("seen")).otherwise(F.lit(0)).cast("double").alias("tau"))

    tau1 = kth(first.groupBy("key").agg(F.sum("v").alias("seen")))
    least = tau1.scalar() / sites.scalar()
    second = local.where(F.col("v") >= least).unionByName(first).distinct()
    partial = second.groupBy("key").agg(F.sum("v").alias("seen"), F.count(F.lit(1)).alias("answers"))
    tau2 = kth(partial.select("key", "seen"))
    upper = F.col("seen") + (sites.scalar() - F.col("answers")) * least
    candidates = partial.where(upper >= tau2.scalar()).select(F.col("key").alias("c"))
    exact = local.join(candidates, F.col("key").eqNullSafe(F.col("c")), "left_semi").groupBy("key").agg(F.sum("v").alias("total"))
    return exact.orderBy(F.desc("total"), F.asc_nulls_first("key")).limit(k)
