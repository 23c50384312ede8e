"""Evaluators: evenness of random data, stream figures, key compression, latency reports, hierarchy counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import gcd, lcm

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from rillcube.operators.transform import domain
from rillcube.operators.weighted import percentiles, value_counts


def evenness(df: DataFrame, period: Column, label: str, count: Column, weights: Mapping[str, float]) -> DataFrame:
    """Per period, how near the labels' counts come to their weights: the least of min(expected / real, real / expected).

    Labels without weight are in the total only; a weighted label that is absent from a period makes it 0.
    """
    whole = float(sum(weights.values()))
    wide = df.groupBy(period.alias("period")).agg(F.sum(count).alias("rows"), *[F.sum(F.when(F.col(f"`{label}`") == n, count).otherwise(0)).alias(f"l{i}") for i, n in enumerate(weights)])

    def nearness(i: int, weight: float) -> Column:
        expected, real = F.col("rows") * F.lit(weight / whole), F.col(f"l{i}").cast("double")
        return F.when((expected == 0) & (real == 0), F.lit(1.0)).otherwise(F.least(expected, real) / F.greatest(expected, real))

    parts = [nearness(i, w) for i, w in enumerate(weights.values())]
    return wide.select("period", "rows", (F.least(*parts) if len(parts) > 1 else parts[0]).alias("evenness"))


def observed(df: DataFrame, name: str, size: Column | None = None) -> tuple[DataFrame, Observation]:
    """``df`` passed through, with figures (rows, bytes) in an observation once an action has run."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(size if size is not None else F.lit(0)).alias("bytes")), seen


def latency_report(df: DataFrame, period: Column, source: str, size: Column, latency: Column, very_late: float) -> DataFrame:
    """Per period: bytes, items, exact median, 95th and 99.9th percentile (by weighted values) and maximum of a whole-number latency, deviation of bytes over sources, very late items."""
    named = df.select(period.alias("period"), F.col(f"`{source}`").alias("source"), size.alias("size"), latency.cast("long").alias("latency"))
    by_source = named.groupBy("period", "source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("items"), F.max("latency").alias("max_latency"), F.count(F.when(F.col("latency") > very_late, 1)).alias("very_late"))
    figures = by_source.groupBy("period").agg(F.sum("size").alias("bytes"), F.sum("items").alias("items"), F.max("max_latency").alias("max_latency"), F.sum("very_late").alias("very_late"), F.stddev_pop("size").alias("source_deviation"), F.count(F.lit(1)).alias("sources"))
    ranks = percentiles(value_counts(named, {"p_period": F.col("period")}, F.col("latency")), [0.5, 0.95, 0.999])
    wide = ranks.groupBy("p_period").agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for n, p in (("median", 0.5), ("p95", 0.95), ("p999", 0.999))])
    return figures.join(wide, F.col("period").eqNullSafe(F.col("p_period")), "left").drop("p_period")


def _opened(cells: DataFrame, key: str, folds: Sequence[int], name: str) -> DataFrame:
    """``fold, <name>``: the distinct (key, time bucket) pairs of each fold, from cells put in order within a key and the span in which
    all buckets close; a cell opens a bucket if its neighbour before is of another one."""
    span = lcm(*[f for f in folds if f]) if any(folds) else 1
    order = Window.partitionBy(key, F.floor(F.col("t") / span)).orderBy("t")
    cells = cells.select(key, "t", F.lag("t").over(order).alias("before"))
    first = F.col("before").isNull()
    opens = [F.struct(F.lit(f).alias("fold"), F.count(F.when(first | (F.floor(F.col("t") / f) != F.floor(F.col("before") / f)), 1)).alias(name)) for f in folds if f]
    counts = cells.agg(F.array(*opens).alias("c")).select(F.explode("c").alias("c")).select("c.*") if opens else None
    if 0 not in folds:
        return counts
    whole = cells.where(first).select(key).distinct().agg(F.lit(0).alias("fold"), F.count(F.lit(1)).alias(name))
    return whole if counts is None else counts.unionByName(whole)


def key_compression(df: DataFrame, time: Column, url: Column, folds: Sequence[int]) -> DataFrame:
    """Rows per distinct (key, time bucket) for urls and their domains, for each fold of time (0: all time).

    Rows are combined by the folds' common step first, and no row is multiplied by the number of folds; a hot url has at most one cell a step.
    """
    step = gcd(*folds) or 1
    at = F.floor(time / step).cast("long") * step if any(folds) else F.lit(0).cast("long")
    cells = df.select(at.alias("t"), url.alias("url")).groupBy("url", "t").agg(F.count(F.lit(1)).alias("n"))
    by_domain = cells.groupBy(domain(F.col("url")).alias("domain"), "t").agg(F.sum("n").alias("n"))
    urls = _opened(cells, "url", folds, "url_keys")
    domains = _opened(by_domain, "domain", folds, "domain_keys").withColumnRenamed("fold", "f")
    joined = urls.join(domains, F.col("fold") == F.col("f"))
    rows = F.coalesce(cells.agg(F.sum("n").alias("rows")).scalar(), F.lit(0).cast("long"))
    joined = joined.withColumn("rows", rows)
    return joined.select("fold", "rows", "url_keys", "domain_keys", F.try_divide("rows", "url_keys").alias("url_ratio"), F.try_divide("rows", "domain_keys").alias("domain_ratio"))


def hierarchy_counts(df: DataFrame, axes: Mapping[str, Column], separators: Mapping[str, str], count: Column) -> DataFrame:
    """Counts for every combination of prefixes of hierarchical keys, the empty prefix (all) included.

    A row adds (levels + 1) cells per axis, bounded by the depth of its own keys; equal cells combine before the shuffle.
    """
    rows = df.select(count.alias("n"), *[c.cast("string").alias(a) for a, c in axes.items()])
    for a in axes:
        parts = F.split(F.coalesce(F.col(a), F.lit("")), separators[a])
        prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), separators[a].replace("\\", "")))
        rows = rows.withColumn(a, F.explode(F.array_distinct(prefixes)))
    return rows.groupBy(*axes).agg(F.sum("n").alias("n"))
