"""Log histograms as arrays of bucket counts, and other mergeable summaries.

A histogram of n buckets starts them at 0 and at the first n - 1 numbers odd * 2 ** e in this order: for each odd number,
its doublings up to the first above 2 ** 27.  The last bucket is open.  Values below 0 go into the first bucket; null
values are no values; a histogram of no values has all counts 0 and null quantiles.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from functools import lru_cache
from math import ceil, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillcube.operators.weighted import at_place, percentiles, value_counts

TOP = 2**31 - 1
_WRAP = 2**27
DYADIC_BITS = 32
#: A lazy summary holds raw values up to so many.
LAZY_LIMIT = 300


@lru_cache(maxsize=64)
def starts(n: int) -> tuple[int, ...]:
    """The buckets' starts, ascending."""
    if n < 2:
        raise ValueError("a histogram has two buckets at least")
    found, odd = [0], 1
    while len(found) < n:
        value = odd
        while len(found) < n:
            found.append(value)
            if value > _WRAP:
                break
            value *= 2
        odd += 2
    return tuple(sorted(found))


def bounds(n: int) -> list[tuple[int, int]]:
    """First and last value of each bucket."""
    s = starts(n)
    return [(a, b - 1) for a, b in zip(s, s[1:])] + [(s[-1], TOP)]


def bucket_of(value: Column, n: int) -> Column:
    """The bucket's number from 0: a binary search in the literal array of starts."""
    array = F.array(*[F.lit(s) for s in starts(n)])
    steps = F.array(*[F.lit(2**i) for i in range(n.bit_length() - 1, -1, -1)])
    step = lambda at, by: F.when((at + by < n) & (F.get(array, at + by) <= value), at + by).otherwise(at)
    return F.when(value.isNotNull(), F.aggregate(steps, F.lit(0), step))


def histogram(df: DataFrame, keys: Sequence[str], value: Column, n: int, name: str = "histogram") -> DataFrame:
    """Per key, the array of n counts.  Equal buckets combine before the shuffle; a group then has n rows at most."""
    return _gathered(df.select(*[F.col(f"`{k}`") for k in keys], bucket_of(value.cast("long"), n).alias("__b"), F.lit(1).cast("long").alias("__one")), keys, n, name)


def _gathered(cells: DataFrame, keys: Sequence[str], n: int, name: str) -> DataFrame:
    """Per key the array of n sums of ``__one`` by bucket ``__b``; a null bucket is of none."""
    cells = cells.groupBy(*keys, "__b").agg(F.coalesce(F.sum(F.when(F.col("__b").isNotNull(), F.col("__one"))), F.lit(0).cast("long")).alias("__n"))
    held = F.map_from_entries(F.collect_list(F.when(F.col("__b").isNotNull(), F.struct("__b", "__n"))))
    grouped = cells.groupBy(*keys).agg(held.alias("__m"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("__m", i), F.lit(0).cast("long")))
    return grouped.select(*keys, counts.alias(name))


def merged(column: str, n: int) -> Column:
    """Aggregate: the sum of histograms of n buckets, bucket by bucket, in bounded memory."""
    return F.array(*[F.coalesce(F.sum(F.get(F.col(f"`{column}`"), F.lit(i))), F.lit(0).cast("long")) for i in range(n)])


def degrade(hist: Column, n: int, to: int) -> Column:
    """A histogram of n buckets as one of fewer: each bucket goes where its start lies."""
    if to > n:
        raise ValueError("a histogram cannot be refined")
    target = [bisect_right(starts(to), s) - 1 for s in starts(n)]
    first = [target.index(j) if j in target else n for j in range(to)]
    size = [target.count(j) for j in range(to)]
    spans = F.array(*[F.struct(F.lit(a + 1).alias("a"), F.lit(c).alias("c")) for a, c in zip(first, size)])
    return F.transform(spans, lambda s: F.aggregate(F.slice(hist, s["a"], s["c"]), F.lit(0).cast("long"), lambda x, y: x + y))


def degrade_to(hist: Column, n: int, ratio: float) -> Column:
    """A histogram at ``int(n * ratio)`` buckets, the share of its size that a congested link can carry."""
    return degrade(hist, n, max(2, int(n * ratio)))


def population(hist: Column) -> Column:
    """How many values a histogram holds."""
    return F.aggregate(hist, F.lit(0).cast("long"), lambda x, y: x + y)


def quantile(hist: Column, n: int, q: float) -> Column:
    """The middle of the first bucket at which the cumulative count reaches ``q`` of all."""
    target = population(hist) * F.lit(q)
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("at"), F.lit(0).alias("i"))

    def step(acc: Column, count: Column) -> Column:
        total = acc["sum"] + count
        return F.struct(total.alias("sum"), F.when((acc["at"] < 0) & (total >= target), acc["i"]).otherwise(acc["at"]).alias("at"), (acc["i"] + 1).alias("i"))

    middles = F.array(*[F.lit((a + b) // 2) for a, b in bounds(n)])
    return F.when(population(hist) > 0, F.get(middles, F.aggregate(hist, start, step)["at"]))


def lazy_summary(df: DataFrame, keys: Sequence[str], value: Column, n: int, limit: int = LAZY_LIMIT) -> DataFrame:
    """Per key ``values`` (the sorted raw values) while there are at most ``limit``, else ``histogram`` (n buckets); the other one is null.

    No key's list grows beyond the limit: ranks are cut before the shuffle.
    """
    rows = df.select(*[F.col(f"`{k}`") for k in keys], value.cast("long").alias("value"))
    whole = histogram(rows, keys, F.col("value"), n).select(*[F.col(f"`{k}`").alias(f"h_{k}") for k in keys], "histogram")
    order = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy("value")
    few = rows.where("value is not null").withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= limit + 1)
    lists = few.groupBy(*[F.col(f"`{k}`").alias(f"l_{k}") for k in keys]).agg(F.array_sort(F.collect_list("value")).alias("values"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"`h_{k}`").eqNullSafe(F.col(f"`l_{k}`"))
    values = F.coalesce("values", F.array().cast("array<bigint>"))
    lazy = F.size(values) <= limit
    return whole.join(lists, same, "left").select(*[F.col(f"`h_{k}`").alias(k) for k in keys], F.when(lazy, values).alias("values"), F.when(~lazy, F.col("histogram")).alias("histogram"))


def lazy_merged(summaries: DataFrame, keys: Sequence[str], n: int, limit: int = LAZY_LIMIT) -> DataFrame:
    """Lazy summaries under equal keys as one: a list while all that is merged are lists of at most ``limit`` values together, else a histogram."""
    named = [F.col(f"`{k}`") for k in keys]
    size = F.coalesce(F.size("values").cast("long"), F.lit(limit + 1).cast("long"))
    held = summaries.withColumn("__fits", F.sum(size).over(Window.partitionBy(*named)) <= limit)
    lists = held.where("__fits").groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list("values"))).alias("values"))
    bars = F.transform("histogram", lambda x, i: F.struct(i.alias("b"), x.alias("n")))
    raw = F.transform("values", lambda v: F.struct(bucket_of(v, n).alias("b"), F.lit(1).cast("long").alias("n")))
    cells = held.where("not __fits").select(*named, F.explode(F.coalesce(bars, raw)).alias("__c")).select(*named, F.col("__c.b").alias("__b"), F.col("__c.n").alias("__one"))
    return lists.withColumn("histogram", F.lit(None).cast("array<bigint>")).unionByName(_gathered(cells, keys, n, "histogram").withColumn("values", F.lit(None).cast("array<bigint>")))


def lazy_quantile(values: Column, hist: Column, n: int, q: float) -> Column:
    """Exact of a list (the value at place ``int(count * q)``), else the middle of the histogram's bucket."""
    place = F.least(F.floor(F.size(values) * F.lit(q)).cast("int"), F.size(values) - 1)
    return F.when(values.isNotNull(), F.get(values, place)).otherwise(quantile(hist, n, q).cast("long"))


def sample_quantile(df: DataFrame, keys: Sequence[str], value: Column, q: float, name: str = "quantile") -> DataFrame:
    """Exact: of n sorted values the one at place ``int(n * q)``, from 0; by weighted values, never a group's list."""
    counts = value_counts(df, {k: F.col(f"`{k}`") for k in keys}, value)
    return percentiles(counts, [q], rank=at_place).select(*[F.col(f"`{k}`") for k in keys], F.col("value").alias(name))


def bottom_k(df: DataFrame, keys: Sequence[str], value: Column, k: int, identity: Column) -> DataFrame:
    """A uniform sample of k values per key that merges: the rows with the smallest hashes of ``identity``; rows ``keys, value, h``.

    Ranks are cut to k within each task before the shuffle.
    """
    rows = df.select(*[F.col(f"`{c}`") for c in keys], value.alias("value"), F.xxhash64(identity).alias("h")).where("value is not null")
    return smallest(rows, keys, k)


def smallest(rows: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("h", "value")
    return rows.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k).drop("__r")


def sketch(value: Column, k: int = 200) -> Column:
    """Aggregate: a mergeable quantile sketch (KLL; the normalised rank error is about 1.65 % at k = 200)."""
    return F.kll_sketch_agg_bigint(value.cast("long"), F.lit(k))


def sketch_merged(column: Column) -> Column:
    return F.kll_merge_agg_bigint(column)


def sketch_quantile(column: Column, q: float) -> Column:
    return F.kll_sketch_get_quantile_bigint(column, F.lit(q))


def count_min(value: Column, eps: float = 0.001, confidence: float = 0.99, seed: int = 1) -> Column:
    """Aggregate: a count-min sketch; point estimates are never below the count, and above by ``eps`` of all at most, with that confidence."""
    return F.count_min_sketch(value, F.lit(eps), F.lit(confidence), F.lit(seed))


def count_min_size(eps: float = 0.001, confidence: float = 0.99) -> tuple[int, int]:
    """(rows, cells a row) of a count-min sketch."""
    return ceil(-log1p(-confidence) / log(2)), ceil(2 / eps)


def count_min_cells(df: DataFrame, keys: Sequence[str], sketch: str) -> DataFrame:
    """Count-min sketches as rows ``keys, cm_cell, cm_n``; sketches of one size merge by addition, so those under equal keys are added up."""
    cells = F.arrow_udf(_cells, returnType="array<bigint>")(F.col(f"`{sketch}`"))
    flat = df.select(*[F.col(f"`{k}`") for k in keys], F.posexplode(cells).alias("cm_cell", "cm_n"))
    return flat.groupBy(*keys, "cm_cell").agg(F.sum("cm_n").alias("cm_n"))


def count_min_estimate(items: DataFrame, item: str, cells: DataFrame, eps: float = 0.001, confidence: float = 0.99) -> DataFrame:
    """``items`` (distinct strings, not null) with ``estimate``: the least of the item's cells, one in each row of the sketch."""
    depth, width = count_min_size(eps, confidence)
    places = F.arrow_udf(lambda found: _places(found, depth, width), returnType="array<int>")(F.col(f"`{item}`"))
    asked = items.withColumn("cm_cell", F.explode(places))
    return asked.join(cells, "cm_cell").groupBy(*items.columns).agg(F.min("cm_n").alias("estimate"))


def dyadic_items(value: Column, top: int = DYADIC_BITS) -> Column:
    """A value in [0, 2 ** top) as the array of the ranges that hold it, named ``<bits>:<number>``: widths of powers of four, the whole last."""
    return F.array(*[F.concat(F.lit(f"{b}:"), F.shiftright(value.cast("long"), b).cast("string")) for b in range(0, top + 1, 2)])


def dyadic_cover(low: int, high: int, top: int = DYADIC_BITS) -> list[str]:
    """The fewest of these ranges that make up [low, high]."""
    out, low, end = [], max(0, low), min(high + 1, 2**top)
    while low < end:
        bits = max(b for b in range(0, top + 1, 2) if low % 2**b == 0 and low + 2**b <= end)
        out.append(f"{bits}:{low >> bits}")
        low += 2**bits
    return out


def range_estimates(ranges: DataFrame, cells: DataFrame, eps: float = 0.001, confidence: float = 0.99) -> DataFrame:
    """``ranges`` (rows ``low, high, item``, one for each item of the cover) with their sums: ``low, high, estimate``; never below the count."""
    items = ranges.select("item").distinct()
    found = count_min_estimate(items, "item", cells, eps, confidence)
    return ranges.join(found, "item").groupBy("low", "high").agg(F.sum("estimate").alias("estimate"))


def _cells(sketches: pa.Array) -> pa.Array:
    """The counts in Spark's binary form: version, total, rows, cells a row, one hash factor a row, then the counts."""
    out = []
    for raw in sketches.to_pylist():
        depth, width = np.frombuffer(raw, ">i4", 2, 12)
        out.append(np.frombuffer(raw, ">i8", depth * width, 20 + 8 * depth).astype(np.int64))
    return pa.array(out, pa.list_(pa.int64()))


def _places(items: pa.Array, depth: int, width: int) -> pa.Array:
    """Spark's cells of each string: row i takes the hash h1 + i * h2."""
    raw = [x.encode() for x in items.to_pylist()]
    lengths = np.array([len(b) for b in raw], np.int64)
    out = np.empty((len(raw), depth), np.int32)
    rows = np.arange(depth, dtype=np.uint32)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        data = np.frombuffer(b"".join(raw[i] for i in at), np.uint8).reshape(len(at), n)
        first = _murmur3(data, np.zeros(len(at), np.uint32))
        second = _murmur3(data, first)
        hashes = (first[:, None] + rows * second[:, None]).view(np.int32).astype(np.int64)
        out[at] = np.abs(hashes) % width + rows.astype(np.int64) * width
    return pa.array(list(out), pa.list_(pa.int32()))


def _murmur3(data: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Murmur3 of byte strings of one length as Spark's sketches take it: each byte after the last whole word is a word, with its sign."""
    turn = lambda x, by: (x << np.uint32(by)) | (x >> np.uint32(32 - by))
    whole = data.shape[1] // 4 * 4
    words = [*np.ascontiguousarray(data[:, :whole]).view("<u4").T, *data[:, whole:].view(np.int8).astype(np.int32).view(np.uint32).T]
    h = seed.copy()
    for k in words:
        h ^= turn(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = turn(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(data.shape[1])
    for by, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint32(by))) * np.uint32(factor)
    return h ^ (h >> np.uint32(16))
