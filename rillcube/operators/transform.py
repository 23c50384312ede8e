"""Row transforms.  Nulls stay null unless stated."""

from __future__ import annotations

import socket
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillcube.schema import TYPE_CODES, EngineSchemaError, absent, require

MAX_CONSTANTS = 10


def extend(df: DataFrame, constants: list[tuple[str, object]], names: list[str] | None = None, hostname: str | None = None) -> DataFrame:
    """Constants, given as (type code, value), as further columns named ``0`` to ``9`` or by ``names``; ``${HOSTNAME}`` is the host's name."""
    names = names or [str(i) for i in range(len(constants))]
    if len(constants) > MAX_CONSTANTS or len(names) != len(constants):
        raise EngineSchemaError(f"at most {MAX_CONSTANTS} constants, and as many names")
    absent(df, names)
    host = hostname or socket.gethostname()
    fixed = {n: F.lit(host if v == "${HOSTNAME}" else v).cast(TYPE_CODES[c]) for n, (c, v) in zip(names, constants)}
    return df.withColumns(fixed) if fixed else df


def project_drop(df: DataFrame, column: str) -> DataFrame:
    """All columns but one."""
    require(df, column)
    return df.drop(column)


def stamp(df: DataFrame, unit: str = "s", name: str = "timestamp") -> DataFrame:
    """The query's wall-clock time as whole seconds, or as milli- or microseconds (double)."""
    absent(df, [name])
    now = F.current_timestamp()
    value = {"s": F.unix_seconds(now), "ms": F.unix_millis(now).cast("double"), "us": F.unix_micros(now).cast("double")}
    if unit not in value:
        raise EngineSchemaError("the unit is s, ms or us")
    return df.withColumn(name, value[unit])


def epoch_seconds(df: DataFrame, column: str) -> Column:
    """Whole seconds of a column that holds epoch numbers or timestamps (without zone: UTC)."""
    kind = require(df, column, "TID").simpleString()
    c = F.col(f"`{column}`")
    if kind == "timestamp_ntz":
        return F.unix_seconds(F.convert_timezone(F.lit("UTC"), F.current_timezone(), c).cast("timestamp"))
    return F.unix_seconds(c) if kind == "timestamp" else c.cast("long")


def round_time(df: DataFrame, column: str, round_to: int, add_offset: int = 0) -> DataFrame:
    """Epoch seconds down to multiples of ``round_to`` (toward zero), plus an offset."""
    if round_to <= 0:
        raise EngineSchemaError("round_to is positive")
    seconds = epoch_seconds(df, column)
    rounded = seconds - seconds % round_to + add_offset  # the remainder has the sign of the number: toward zero
    return df.withColumn(column, rounded)


def url_to_domain(df: DataFrame, column: str) -> DataFrame:
    """What stands between the second and third slash, port and all; texts with fewer than two slashes stay."""
    require(df, column, "S")
    return df.withColumn(column, domain(F.col(f"`{column}`")))


def domain(url: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(url, "/"), F.lit(3)), url)


def time_warp(df: DataFrame, column: str, warp: float, delta: int) -> DataFrame:
    """Time since the earliest row, divided by ``warp``, from ``delta`` on; whole seconds, cut toward zero.

    The earliest time is a scalar subquery over this one column.
    """
    seconds = epoch_seconds(df, column)
    first = df.select(seconds.alias("s")).agg(F.min("s").alias("s"))
    warped = (seconds - first.scalar()) / F.lit(float(warp)) + F.lit(int(delta))
    return df.withColumn(column, warped.cast("long"))


def success_ratio(df: DataFrame, keys: Mapping[str, Column], code: str, total: str, success: int = 200) -> DataFrame:
    """Per key, the share of ``total`` that has the code of success; null where the totals add up to 0 or are all null."""
    require(df, code, "I")
    good = F.sum(F.when(F.col(f"`{code}`") == success, F.col(f"`{total}`")).otherwise(0))
    named = df.groupBy(*[c.alias(n) for n, c in keys.items()])
    return named.agg(F.sum(f"`{total}`").alias("total"), F.try_divide(good.cast("double"), F.sum(f"`{total}`")).alias("ratio"))
