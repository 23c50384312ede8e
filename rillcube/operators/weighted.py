"""Group-value counts: per-key results without imbalance (problem 2) and the exact order statistics built on them.

``value_counts`` groups by key and value before key.  The first shuffle is keyed by both, so a key with a third of all
rows spreads over as many tasks as it has values; a hot (key, value) pair is combined before the shuffle.  Everything
per key then comes from the far fewer weighted values: totals, exact distinct counts, modes and percentiles.

Percentiles never put a key into one task either.  Values are cut into ranges by their high bits; a table of one row
per key and range carries the running sum up to each range (the offset), the ranges that hold a target rank are known
from it, and running sums are taken only within those ranges.

Defined results: a null key is a key like any other; a null value counts in ``rows`` but is no value (not in distinct,
mode or percentiles); null weights count as given by the caller's ``coalesce``; ties in the mode go to the smallest
value; a percentile ``p`` of ``n`` values is the first value whose cumulative count reaches ``max(1, ceil(p * n))``; keys
without any value have null percentiles; a row that was delivered again counts again (``rillcube.operators.once`` takes
repeats out beforehand); empty tables give empty tables; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values per range at most, for integers: 2 to this power.
RANGE_BITS = 12


def value_counts(df: DataFrame, keys: Mapping[str, Column], value: Column, sums: Mapping[str, Column] | None = None, weight: Column | None = None) -> DataFrame:
    """Columns: the keys, ``value``, ``n`` (rows, or the sum of ``weight``) and one sum for each of ``sums``."""
    named = df.select(*[c.alias(f"k_{n}") for n, c in keys.items()], value.alias("value"), (F.lit(1) if weight is None else weight).cast("long").alias("w"), *[c.cast("long").alias(f"s_{n}") for n, c in (sums or {}).items()])
    return named.groupBy(*[f"k_{n}" for n in keys], "value").agg(F.sum("w").alias("n"), *[F.sum(f"s_{n}").alias(f"s_{n}") for n in sums or {}])


def combine_counts(*parts: DataFrame) -> DataFrame:
    """Counts computed apart (by site, day or run), put together; exact, in any order."""
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    keys = [c for c in first.columns if c.startswith("k_")]
    return first.groupBy(*keys, "value").agg(*[F.sum(c).alias(c) for c in first.columns if c == "n" or c.startswith("s_")])


def key_totals(counts: DataFrame, value_sum: str | None = None) -> DataFrame:
    """Per key: ``rows``, the sums, ``distinct_values``, ``mode_value`` and ``mode_rows``; with ``value_sum``, the sum of values under that name."""
    keys = [c for c in counts.columns if c.startswith("k_")]
    sums = [c for c in counts.columns if c.startswith("s_")]
    known = F.col("value").isNotNull()
    best = F.min(F.when(known, F.struct((-F.col("n")).alias("less"), F.col("value"))))  # of the most frequent the smallest, whatever its type
    aggs = [F.sum("n").alias("rows"), *[F.sum(s).alias(s[2:]) for s in sums], F.count("value").alias("distinct_values"), best.alias("best")]
    if value_sum:
        aggs.append(F.sum(F.col("value").cast("long") * F.col("n")).alias(value_sum))
    out = counts.groupBy(*keys).agg(*aggs)
    return out.select(*[F.col(k).alias(k[2:]) for k in keys], *[c for c in out.columns if c not in keys and c != "best"], F.col("best.value").alias("mode_value"), (-F.col("best.less")).alias("mode_rows"))


def reaching(p: Column, n: Column) -> Column:
    """The rank of a percentile, from 1: the first value whose cumulative count reaches p * n."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(p * n).cast("long"))


def at_place(p: Column, n: Column) -> Column:
    """The rank, from 1, of the value at place ``int(n * p)`` from 0 of the sorted values."""
    return F.least(F.floor(p * n).cast("long") + 1, n)


def percentiles(counts: DataFrame, probabilities: Sequence[float], range_bits: int = RANGE_BITS, rank: Callable[[Column, Column], Column] = reaching) -> DataFrame:
    """Exact percentiles of weighted integer values: keys, ``p``, ``value``, and ``rows``, the count of all values of the key.

    ``counts`` is as ``value_counts`` or ``combine_counts`` make it; ``rank`` gives the rank from probability and count.
    """
    # the keys as one struct: structs compare null-safe, so the join and the windows share one partitioning; a range that
    # is never null keeps both uses of the counts alike, and their shuffle is done once
    keys = [c for c in counts.columns if c.startswith("k_")]
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("none"))
    given = counts.where("value is not null and n > 0").select(key.alias("key"), F.col("value").cast("long").alias("value"), "n")
    given = given.withColumn("range", F.coalesce(F.shiftright("value", range_bits), F.lit(0)))
    ranges = given.groupBy("key", "range").agg(F.sum("n").alias("held"))
    whole = Window.partitionBy("key")
    upto = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = ranges.withColumn("upto", F.sum("held").over(upto)).withColumn("rows", F.sum("held").over(whole))
    wanted = F.array(*[F.struct(F.lit(float(p)).alias("p"), rank(F.lit(float(p)), F.col("rows")).alias("rank")) for p in probabilities])
    offset = F.col("upto") - F.col("held")
    here = F.filter(wanted, lambda w: (w["rank"] > offset) & (w["rank"] <= F.col("upto")))
    targets = ranges.withColumn("targets", here).where(F.size("targets") > 0).select("key", "range", offset.alias("offset"), "rows", "targets")
    inside = Window.partitionBy("key", "range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    sums = given.join(targets, ["key", "range"]).withColumn("cum", F.col("offset") + F.sum("n").over(inside))
    reached = F.filter("targets", lambda t: (t["rank"] <= F.col("cum")) & (t["rank"] > F.col("cum") - F.col("n")))
    return sums.select("key", "value", "rows", F.explode(reached).alias("t")).select(*[F.col(f"key.{k}").alias(k[2:]) for k in keys], F.col("t.p").alias("p"), "value", "rows")
