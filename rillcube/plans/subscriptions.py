"""Subscriptions to cubes and event tables: once, by time window, coarsened, by threshold; batch and stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillcube.cube.cube import Cube, CubeQuery
from rillcube.cube.levels import TIME_LEVELS, level_for_budget
from rillcube.operators.weighted import percentiles, value_counts


def one_shot(cube: Cube, query: CubeQuery = CubeQuery()) -> DataFrame:
    return cube.query(query)


def windowed(cube: Cube, time: str, window_seconds: int, start: int = 0, query: CubeQuery = CubeQuery()) -> DataFrame:
    """Every cell in its tumbling window ``[window_start, window_start + window_seconds)``, counted from ``start``; cells before ``start`` are left out.

    With a limit, the query's sort and limit hold within each window.
    """
    inner = CubeQuery(query.bounds, query.levels, (), 0, query.final)
    rows = cube.query(inner).where(F.col(f"`{time}`") >= start)
    begun = F.lit(start) + F.floor((F.col(f"`{time}`") - start) / window_seconds).cast("long") * window_seconds
    rows = rows.withColumn("window_start", begun)
    if query.limit > 0:
        order = [F.col(f"`{s.lstrip('-')}`").desc_nulls_last() if s.startswith("-") else F.col(f"`{s}`").asc_nulls_first() for s in query.sort]
        ties = [F.col(f"`{n}`").asc_nulls_first() for n in cube.spec.dim_names]
        rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy("window_start").orderBy(*order, *ties))).where(F.col("__r") <= query.limit).drop("__r")
    return rows


def on_time(df: DataFrame, event: Column, arrival: Column, window_seconds: int, offset_seconds: int) -> DataFrame:
    """``df`` with ``on_time``: whether a row arrived before its window was closed, ``offset_seconds`` after the window's end.

    A cube takes all rows; a subscriber shows those that were on time.
    """
    end = (F.floor(event / window_seconds) + 1).cast("long") * window_seconds
    return df.withColumn("on_time", F.coalesce(arrival < end + offset_seconds, F.lit(False)))


def coarsened(cube: Cube, time: str, level: int) -> DataFrame:
    """The cube at a level of its time dimension."""
    return cube.query(CubeQuery(levels={time: level}))


def level_rows(cube: Cube, time: str) -> DataFrame:
    """Rows of the cube at every time level, in one pass over its cells: ``level, cells``; input of ``fitting_level``.

    Every level's periods lie within days, so cells are put in order within a day and their other dimensions, and a cell opens
    a period of a level if its neighbour before is of another one.
    """
    others = [n for n in cube.spec.dim_names if n != time]
    cells = cube.cells.select(*[F.col(f"`{o}`").alias(f"o{i}") for i, o in enumerate(others)], F.col(f"`{time}`").alias("t"))
    keys = [f"o{i}" for i in range(len(others))]
    day = Window.partitionBy(*keys, F.floor(F.col("t") / 86400)).orderBy("t")
    cells = cells.withColumn("before", F.lag("t").over(day))
    opens = [F.count(F.when(F.col("before").isNull() | (F.floor(F.col("t") / size) != F.floor(F.col("before") / size)), 1)).alias("cells") for size in TIME_LEVELS[1:]]
    counts = cells.agg(F.array(*opens).alias("cells")).select(F.posexplode("cells").alias("level", "cells")).select((F.col("level") + 1).alias("level"), "cells")
    whole = cells.where("before is null").select(*keys).distinct() if keys else cells.select(F.lit(0)).distinct()
    return counts.unionByName(whole.agg(F.lit(0).alias("level"), F.count(F.lit(1)).alias("cells")))


def fitting_level(cube: Cube, time: str, budget: int) -> int:
    """The finest level whose rows stay within the budget; reads ten rows to the driver."""
    return level_for_budget({r["level"]: r["cells"] for r in level_rows(cube, time).collect()}, budget)


def above_threshold(df: DataFrame, value: str, thresholds: DataFrame, keys: Sequence[str] = (), threshold: str = "threshold") -> DataFrame:
    """Rows whose value is at least the threshold of their key; rows without a threshold pass.

    ``thresholds`` has one row per key (or one row, without keys: then it is a scalar subquery).
    """
    v = F.col(f"`{value}`")
    if not keys:
        bound = thresholds.select(threshold).scalar()
        return df.where(bound.isNull() | (v >= bound))
    named = thresholds.select(*[F.col(f"`{k}`").alias(f"__{k}") for k in keys], F.col(f"`{threshold}`").alias("__bound"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"__{k}"))
    return df.join(named, same, "left").where(F.col("__bound").isNull() | (v >= F.col("__bound"))).drop(*[f"__{k}" for k in keys], "__bound")


def in_force(df: DataFrame, time: str, control: DataFrame, control_time: str, threshold: str, bucket_seconds: int = 3600) -> DataFrame:
    """``df`` with ``threshold``: the one last set at or before the row's time; null before the first.

    Per bucket of time, the controls within it are an ordered array of at most one a second, so the join is on equal buckets
    and a row looks into one short array; rows of the same bucket may lie in any number of tasks.  The setting that
    is carried into a bucket comes from a running last over one small row a bucket, as many as the tables' time has buckets.
    """
    t, ct = F.col(f"`{time}`").cast("long"), F.col(f"`{control_time}`").cast("long")
    settings = control.where(ct.isNotNull()).groupBy(ct.alias("at")).agg(F.max(F.col(f"`{threshold}`").cast("double")).alias("bound"))
    settings = settings.select(F.floor(F.col("at") / bucket_seconds).alias("b"), F.struct("at", "bound").alias("s"))
    buckets = df.where(t.isNotNull()).select(F.floor(t / bucket_seconds).alias("b")).distinct()
    line = buckets.select("b", F.lit(None).cast(settings.schema["s"].dataType).alias("s")).unionByName(settings)
    line = line.groupBy("b").agg(F.max("s").alias("last"))
    carried = line.select("b", F.last("last", True).over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    inside = settings.groupBy("b").agg(F.array_sort(F.collect_list("s")).alias("set"))
    line = carried.join(inside, "b", "left").select(F.col("b").alias("__b"), F.array_compact(F.concat(F.array("carried"), F.coalesce("set", F.array().cast(inside.schema["set"].dataType)))).alias("__set"))
    joined = df.join(line, F.floor(t / bucket_seconds) == F.col("__b"), "left")
    return joined.withColumn("threshold", F.try_element_at(F.filter("__set", lambda s: s["at"] <= t), F.lit(-1))["bound"]).drop("__b", "__set")


def quantile_thresholds(df: DataFrame, keys: dict[str, Column], value: Column, q: float) -> DataFrame:
    """Per key, the exact quantile of whole numbers, to feed ``above_threshold``."""
    return percentiles(value_counts(df, keys, value), [q]).select(*keys, F.col("value").alias("threshold"))


def latency_bucket(ms: Column) -> Column:
    """Steps of 2 below 10 ms, 10 below 100, 20 below 1000 and 100 above, cut toward zero, with sign."""
    whole = ms.cast("long")
    size = F.abs(whole)
    step = F.when(size < 10, 2).when(size < 100, 10).when(size < 1000, 20).otherwise(100)
    return whole - whole % step


def latency_histogram(df: DataFrame, host: str, ms: Column, label: str = "latency") -> DataFrame:
    """``host, label, bucket, count`` of latencies."""
    return df.groupBy(F.col(f"`{host}`").alias("host"), F.lit(label).alias("label"), latency_bucket(ms).alias("bucket")).agg(F.count(F.lit(1)).alias("count"))


def changes(old: Cube, new: Cube) -> DataFrame:
    """Cells that came or changed between two states of a cube: dimensions, ``old_<aggregate>`` and ``new_<aggregate>``."""
    names = [a.name for a in new.spec.aggs]
    a = old.finalize().select(*[F.col(f"`{d}`").alias(f"__{d}") for d in new.spec.dim_names], *[F.col(n).alias(f"old_{n}") for n in names])
    b = new.finalize().select(*[F.col(f"`{d}`") for d in new.spec.dim_names], *[F.col(n).alias(f"new_{n}") for n in names])
    same = F.lit(True)
    for d in new.spec.dim_names:
        same = same & F.col(f"`{d}`").eqNullSafe(F.col(f"__{d}"))
    differ = F.lit(False)
    for n in names:
        differ = differ | ~F.col(f"old_{n}").eqNullSafe(F.col(f"new_{n}"))
    return b.join(a, same, "left").where(differ).drop(*[f"__{d}" for d in new.spec.dim_names])
