"""Samplers.  Hash samples keep or drop all rows of a key, in every run and on every site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillcube.session import checkpoint_dir

SPACE = 2**32
_FACTOR = 2654435761  # the golden ratio's share of 2 ** 32


def bernoulli(df: DataFrame, drop: float, seed: int = 0) -> DataFrame:
    """Each row dropped with probability ``drop``."""
    return df.sample(withReplacement=False, fraction=1 - drop, seed=seed)


def point(key: Column, kind: str) -> Column:
    """A key's place in [0, 2 ** 32).  Integers by multiplication (so that any SQL engine can repeat it), all else by xxhash64."""
    if kind in ("int", "bigint", "smallint", "tinyint"):
        # in two halves: the product of 31 and 32 bits stays within 64
        k = F.pmod(key.cast("bigint"), F.lit(SPACE))
        high, low = F.shiftright(k, 16), k.bitwiseAND(0xFFFF)
        return F.pmod(F.pmod(high * _FACTOR, F.lit(SPACE)) * 65536 + low * _FACTOR, F.lit(SPACE))
    return F.pmod(F.xxhash64(key), F.lit(SPACE))


def hash_sample(df: DataFrame, key: str, drop: float) -> DataFrame:
    """All rows of about a share ``1 - drop`` of the keys; a null key is a key."""
    place = F.coalesce(point(F.col(f"`{key}`"), dict(df.dtypes)[key]), F.lit(0))
    return df.where(place >= int(drop * SPACE))


def ladder(steps: int = 11) -> list[float]:
    """The pass shares a variable sampler steps along, from none to all."""
    return [i / (steps - 1) for i in range(steps)]


def variable_sample(df: DataFrame, key: str, level: int, steps: int = 11) -> DataFrame:
    """A hash sample at one step of the ladder; what a lower level keeps, a higher one keeps too."""
    return hash_sample(df, key, 1 - ladder(steps)[level])


def interval_sample(df: DataFrame, order: list[str], drops: int, groups: list[str] | None = None) -> DataFrame:
    """One row of every ``drops + 1`` in the given order, within each of ``groups`` if given; ``drops=0`` keeps all.

    The rows' numbers come from a range-sorted table and the counts of its partitions, not from one global window:
    every partition numbers its own rows and starts where the ones before it end.  A group as large as the table lies in as
    many partitions as the table.
    """
    groups = list(groups or [])
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}  # so no name can clash
    by = [F.col(names[o]).asc_nulls_first() for o in [*groups, *order]]
    checkpoint_dir(df.sparkSession)
    ordered = df.toDF(*names.values()).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("id", F.monotonically_increasing_id())
    # the id is the partition (upper bits) and the row's place in it (lower 33 bits)
    indexed = ordered.withColumns({"part": F.shiftright("id", 33), "at": F.col("id").bitwiseAND(2**33 - 1)}).drop("id").checkpoint()
    own = [names[g] for g in groups]
    held = indexed.groupBy("part", *own).agg(F.count(F.lit(1)).alias("held"), F.min("at").alias("first_at"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy(*own).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = held.select(F.col("part").alias("p"), *[F.col(c).alias(f"g_{c}") for c in own], (before - F.col("first_at")).alias("start"))
    same = F.col("part") == F.col("p")
    for c in own:
        same = same & F.col(c).eqNullSafe(F.col(f"g_{c}"))
    # without groups one row a partition
    numbered = indexed.join(starts if own else F.broadcast(starts), same)
    return numbered.where((F.col("start") + F.col("at") + 1) % (drops + 1) == 0).select(*names.values()).toDF(*df.columns)
