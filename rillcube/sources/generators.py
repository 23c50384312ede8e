"""Synthetic sources; all are functions of the row number, so that every run gives the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labels and weights of the default distribution (fixed values).
STATES = {"California": 37.7, "Texas": 25.7, "New York": 19.5, "Florida": 19.1, "Illinois": 12.9}


def zipf_weights(items: int = 100, parameter: float = 1.2) -> dict[str, float]:
    return {f"item_{i}": 100 / (i + 2) ** parameter for i in range(items)}


def _label(place: Column, weights: dict[str, float]) -> Column:
    """The label at a place in [0, 1) of the cumulative distribution."""
    whole, upto, bounds = sum(weights.values()), 0.0, []
    for weight in weights.values():
        upto += weight / whole
        bounds.append(upto)
    index = F.size(F.filter(F.array(*[F.lit(b) for b in bounds[:-1]]), lambda b: b <= place))
    return F.element_at(F.array(*[F.lit(n) for n in weights]), index + 1)


def random_labels(spark: SparkSession, rows: int, rate: int = 1000, weights: dict[str, float] | None = None, part: int = 0, parts: int = 1, start: int = 0) -> DataFrame:
    """``label, time``: labels by weight, ``rate`` rows a second; part ``part`` of ``parts`` of the distribution."""
    step = F.pmod(F.col("id") * F.lit(0.6180339887498949), F.lit(1.0))
    place = (step + part) / parts
    return spark.range(rows).select(_label(place, weights or STATES).alias("label"), (F.lit(start) + F.floor(F.col("id") / rate)).cast("long").alias("time"))


def random_histograms(spark: SparkSession, rows: int, unique_values: int = 10, buckets: int = 100, values_each: int = 50, rate: int = 100, start: int = 0, schedule: Sequence[tuple[int, int]] = ()) -> DataFrame:
    """``time, key, buckets, histogram``: each row holds the log histogram of ``values_each`` values that depend on the row's number.

    ``schedule`` gives the sizes that a ladder of degradation takes over time, as (second from the start, buckets), ascending; the
    first seconds have ``buckets``.
    """
    from rillcube.functions.loghist import bucket_of

    value = lambda i: F.pmod(F.pmod(F.col("id") * values_each + i, F.lit(2**31)) * F.lit(2654435761), F.lit(2**32)) % 10_000
    second = F.floor(F.col("id") / rate).cast("long")
    size, sizes = F.lit(buckets), {buckets}
    for since, n in schedule:
        size, sizes = F.when(second >= since, F.lit(n)).otherwise(size), sizes | {n}
    made = spark.range(rows).withColumn("buckets", size)
    counts = F.lit(None).cast("array<bigint>")
    for n in sorted(sizes):
        held = F.transform(F.sequence(F.lit(0), F.lit(values_each - 1)), lambda i: bucket_of(value(i).cast("int"), n))  # noqa: B023
        counts = F.when(F.col("buckets") == n, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.size(F.filter(held, lambda h: h == b)).cast("long"))).otherwise(counts)  # noqa: B023
    return made.select((F.lit(start) + second).alias("time"), (F.col("id") % unique_values).cast("int").alias("key"), "buckets", counts.alias("histogram"))


def send_k(spark: SparkSession, k: int, text: str = "foo") -> DataFrame:
    """k rows ``text, version`` with versions from 0."""
    return spark.range(k).select(F.lit(text).alias("text"), F.col("id").alias("version"))


def continuous(spark: SparkSession, rows_per_second: int = 1, text: str = "foo") -> DataFrame:
    """A stream of such rows at a steady rate."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select(F.lit(text).alias("text"), F.col("value").alias("version"), "timestamp")
