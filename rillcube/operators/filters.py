"""Row filters.  A null never passes, except that a ratio over a null or zero denominator is as stated."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillcube.schema import require


def grep(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows where the pattern is found anywhere in the string column."""
    require(df, column, "S")
    return df.where(F.col(f"`{column}`").rlike(pattern))


def equals(df: DataFrame, column: str, target: int) -> DataFrame:
    require(df, column, "I")
    return df.where(F.col(f"`{column}`") == target)


def greater_than(df: DataFrame, column: str, bound: float) -> DataFrame:
    require(df, column, "IDT")
    return df.where(F.col(f"`{column}`") > bound)


def ratio_above(df: DataFrame, numerator: str, denominator: str, bound: float) -> DataFrame:
    """Rows with a zero denominator, or a ratio above the bound; nulls drop."""
    require(df, numerator, "ID")
    require(df, denominator, "ID")
    n, d = F.col(f"`{numerator}`").cast("double"), F.col(f"`{denominator}`").cast("double")
    return df.where((d == 0) | (F.try_divide(n, d) > bound))


def window_limit(df: DataFrame, window: str, value: str, bound: int, ties: list[str]) -> DataFrame:
    """At most ``bound`` rows per window, the largest values first (ties by the given columns); ``error_bound`` is the largest value cut from the window, null if none was.

    The rank filter runs before the shuffle too (only ``bound + 1`` rows of a window leave a task), so a hot window is no burden.
    """
    require(df, window)
    order = Window.partitionBy(F.col(f"`{window}`")).orderBy(F.col(f"`{value}`").desc_nulls_last(), *[F.col(f"`{t}`") for t in ties])
    ranked = df.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= bound + 1)
    cut = F.max(F.when(F.col("__rank") == bound + 1, F.col(f"`{value}`"))).over(Window.partitionBy(F.col(f"`{window}`")))
    return ranked.withColumn("error_bound", cut).where(F.col("__rank") <= bound).drop("__rank")


def coarser_limits(bound: int, levels: int = 20) -> list[int]:
    """The ladder of bounds that a window limit steps along under congestion, tightest first."""
    return [max(1, bound * i // levels) for i in range(1, levels + 1)]
