"""Rows that were delivered more than once, counted once, without shuffling the rows that were not.

Repeats are found from their keys alone.  The repeated keys go out as a bit table of fixed size (``BITS`` bits by the
hash of the key, as rows of eight words, some 20 MB when full), rows whose bit is not set are alone and stay where
they are, and only the others are shuffled by key and cut to the first of each.  A bit that two keys share costs a shuffle of
a row, never a wrong result; should there be so many repeated keys that most bits are set, this is the plain shuffle
of all rows again.  A key that repeats without end is cut to one row a task before the shuffle.

Defined results: of rows with equal keys the one with the smallest tie stays; a row with a null among its keys stays, as nothing
says that it is a repeat; an empty table stays empty; further columns are kept whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 27
_SLOTS = 8


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))


def _slot(place: Column) -> Column:
    return F.shiftright(place, 6).bitwiseAND(_SLOTS - 1)


def repeated_bits(keyed: DataFrame, keys: Sequence[str], bits: int = BITS) -> DataFrame:
    """The bit table of the keys that more than one row of ``keyed`` has: ``word`` and eight words of bits; at most 2 ** (bits - 9) rows."""
    repeated = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(_place(keys, bits).alias("place"))
    words = [F.coalesce(F.bit_or(F.when(_slot(F.col("place")) == i, _bit(F.col("place")))), F.lit(0).cast("long")).alias(f"w{i}") for i in range(_SLOTS)]
    return repeated.groupBy(F.shiftright("place", 9).alias("word")).agg(*words)


def _place(keys: Sequence[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(2**bits))


def first_deliveries(df: DataFrame, keys: Sequence[str], tie: str, bits: int = BITS) -> DataFrame:
    """``df`` with one row for each set of rows with the same ``keys``, the one of the smallest ``tie``."""
    place = {c: f"c{i}" for i, c in enumerate(df.columns)}  # so no name can clash
    rows, own = df.toDF(*place.values()), [place[k] for k in keys]
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in own])
    table = F.broadcast(repeated_bits(rows.where(known).select(*own), own, bits))
    at = _place(own, bits)
    looked = rows.join(table, F.shiftright(at, 9) == F.col("word"), "left")
    word = reduce(lambda rest, i: F.when(_slot(at) == i, F.col(f"w{i}")).otherwise(rest), range(_SLOTS), F.lit(0).cast("long"))
    may_repeat = known & (F.coalesce(word, F.lit(0).cast("long")).bitwiseAND(_bit(at)) != 0)
    looked = looked.select(*place.values(), may_repeat.alias("may_repeat"))
    first = Window.partitionBy(*own).orderBy(place[tie])
    cut = looked.where("may_repeat").withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    return looked.where("not may_repeat").unionByName(cut).drop("may_repeat").toDF(*df.columns)
