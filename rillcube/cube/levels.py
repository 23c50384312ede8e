"""Rollup levels of dimensions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds per level of a time dimension; level 0 is all time (fixed values).
TIME_LEVELS = (0, 3600, 1800, 600, 300, 60, 30, 10, 5, 1)
TIME_LEAF = len(TIME_LEVELS) - 1
FLAT_LEAF = 1


def time_at_level(seconds: Column, level: int) -> Column:
    """Epoch seconds at a level: 0 for all time, else down to the level's multiple; levels beyond the leaf are the leaf."""
    size = TIME_LEVELS[min(level, TIME_LEAF)]
    return F.lit(0).cast("long") if size == 0 else seconds - F.pmod(seconds, F.lit(size))


def level_for_budget(rows_at_level: dict[int, int], budget: int) -> int:
    """The finest level whose number of rows stays within the budget; the coarsest if none does."""
    fitting = [level for level, rows in rows_at_level.items() if rows <= budget]
    return max(fitting) if fitting else min(rows_at_level)


def level_within(window_seconds: int) -> int:
    """The coarsest time level of at most so many seconds: what a window that long can be coarsened to."""
    sizes = [(size, level) for level, size in enumerate(TIME_LEVELS) if 0 < size <= window_seconds]
    return min(level for size, level in sizes if size == max(sizes)[0]) if sizes else TIME_LEAF
