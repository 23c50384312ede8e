"""Percentiles of very large numeric columns (problem 4), with a stated error, from states that can be put together.

The state is a table of group, value and count.  States of separate sites, days or runs are combined by adding counts,
in any order.  With ``bits=None`` values are kept as they are and percentiles are exact.  With ``bits=b`` a value is
replaced by the middle of its cell, where cells keep the ``b`` highest binary digits after the leading one: the relative
error of any percentile is at most 2 ** -(b + 1), and a group has at most ``2 ** b`` cells per power of two, whatever
the number of its values.

Percentiles come from cumulative frequencies: ranges of values with partition offsets, window running sums within the
ranges that hold a target rank, and the first value that reaches the rank (``rillcube.operators.weighted``).  No group
is ever in one task as a whole.

Defined results: a null group is a group; measurements that are null, and single values that mean "not measured", are no
values; empty lists hold none; rows repeated under the same (site, version) count once if ``once`` is set, and rows
with a null in that key count each; groups without values have no row; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillcube.operators import weighted
from rillcube.operators.once import first_deliveries


def measurements(df: DataFrame, keep: Mapping[str, Column], single: str = "i_val", many: str = "summary", missing: int = -1, once: Sequence[str] | None = ("site", "version"), tie: str = "tuple_id") -> DataFrame:
    """One row per value: the columns ``keep`` and ``value`` (bigint).

    ``single`` is of the type of the items of ``many`` or narrower; ``missing`` is the value of ``single`` that stands for
    not measured.  Of rows with the same ``once`` key one counts, the one of the smallest ``tie``; repeats are found by their keys, so rows that
    have none are not shuffled for it.
    """
    alone = F.col(f"`{single}`")
    kind = df.schema[many].dataType
    values = F.concat(F.coalesce(F.col(f"`{many}`"), F.array().cast(kind)), F.when(alone.isNotNull() & (alone != missing), F.array(alone.cast(kind.elementType))).otherwise(F.array().cast(kind)))
    rows = df.select(*[c.alias(f"m_{n}") for n, c in keep.items()], values.alias("values"), *([F.col(f"`{k}`").alias(f"o_{k}") for k in [*once, tie]] if once else []))
    if once:
        rows = first_deliveries(rows, [f"o_{k}" for k in once], f"o_{tie}")
    return rows.select(*[F.col(f"m_{n}").alias(n) for n in keep], F.explode("values").alias("value")).where("value is not null").withColumn("value", F.col("value").cast("long"))


def cell(value: Column, bits: int | None) -> Column:
    """The middle of the cell that keeps ``bits`` binary digits after the leading one."""
    if bits is None:
        return value.cast("long")
    size = F.abs(value.cast("long"))
    drop = F.greatest(F.lit(0), F.length(F.bin(size)) - 1 - bits)
    low = F.call_function("shiftleft", F.call_function("shiftright", size, drop), drop)
    middle = low + F.when(drop > 0, F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(drop - 1, F.lit(0)))).otherwise(F.lit(0).cast("long"))
    return F.when(value < 0, -middle).otherwise(middle)


def state(values: DataFrame, groups: Sequence[str], bits: int | None = None, value: str = "value") -> DataFrame:
    """The mergeable state: ``k_<group>...``, ``value`` and ``n``."""
    return weighted.value_counts(values, {g: F.col(f"`{g}`") for g in groups}, cell(F.col(f"`{value}`"), bits))


def roll_up(states: DataFrame, groups: Sequence[str]) -> DataFrame:
    """A coarser state: the counts of the kept groups, added over the others."""
    return states.groupBy(*[f"k_{g}" for g in groups], "value").agg(F.sum("n").alias("n"))


combine = weighted.combine_counts
percentiles = weighted.percentiles
