"""Most frequent items among billions, in bounded memory (problem 5).

External sort and run-length counting: each map task combines equal values of a bounded number of rows into sorted
runs, which are written once; runs are range-partitioned by value, each range merges its sorted runs (Spark's external sort) and adds up equal
neighbours as they stream by, and keeps a bounded heap of its heaviest values.  The heaviest of all ranges' heaps are
the result: exact, as a value lies in one range only.  A value with a third of all rows reaches its range as one row
per run.  Memory: ``run_rows`` distinct values in a map task, one batch and ``k`` values in a range.

Defined results: null values are never items; null weights count as ``missing_weight``; ties go to the smaller value;
values are equal only byte for byte; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillcube.session import checkpoint_dir

RUN_ROWS = 200_000
_OUT = "value string, weight bigint"
_SCHEMA = pa.schema([("value", pa.string()), ("weight", pa.int64())])
_SLICE = 10_000


def _added(parts: list[pa.Table]) -> pa.Table:
    table = pa.concat_tables(parts).group_by("value").aggregate([("weight", "sum")])
    return pa.table({"value": table["value"], "weight": table["weight_sum"]})


def _runs(run_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        waiting: list[pa.Table] = []
        rows = 0

        def sorted_run(table: pa.Table):
            ordered = table.sort_by("value").cast(_SCHEMA).combine_chunks()
            yield from ordered.to_batches(max_chunksize=_SLICE)

        for batch in batches:
            waiting.append(pa.table({"value": batch.column(0).cast(pa.string()), "weight": batch.column(1).cast(pa.int64())}))
            rows += batch.num_rows
            if rows >= run_rows:
                held = _added([*([held] if held is not None else []), *waiting])
                waiting, rows = [], 0
                if held.num_rows >= run_rows:
                    yield from sorted_run(held)
                    held = None
        if held is not None or waiting:
            yield from sorted_run(_added([*([held] if held is not None else []), *waiting]))

    return run


def _heaviest(values: pa.Array, weights: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray]:
    """The k heaviest; of equal weights the smaller values, which come first in a sorted range."""
    if len(weights) <= k:
        return values, weights
    order = np.argsort(-weights, kind="stable")[:k]
    order.sort()
    return values.take(pa.array(order)), weights[order]


def _count_runs(k: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top_values, top_weights = pa.array([], pa.string()), np.zeros(0, np.int64)
        open_value, open_weight = None, 0  # the run at the end of the last batch

        def keep(values: pa.Array, weights: np.ndarray) -> None:
            nonlocal top_values, top_weights
            both = pa.concat_arrays([top_values, values.cast(pa.string())])
            top_values, top_weights = _heaviest(both, np.concatenate([top_weights, weights]), k)

        for batch in batches:
            if not batch.num_rows:
                continue
            values, weights = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            changes = pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(changes) + 1]).astype(np.int64)
            sums = np.add.reduceat(weights, starts)
            heads = values.take(pa.array(starts))
            if open_value is not None:
                if heads[0].as_py() == open_value:
                    sums[0] += open_weight
                else:
                    keep(pa.array([open_value], pa.string()), np.array([open_weight], np.int64))
            open_value, open_weight = heads[-1].as_py(), int(sums[-1])
            keep(heads[:-1], sums[:-1])
        if open_value is not None:
            keep(pa.array([open_value], pa.string()), np.array([open_weight], np.int64))
        for at in range(0, len(top_weights), _SLICE):
            yield pa.RecordBatch.from_arrays([top_values[at : at + _SLICE], pa.array(top_weights[at : at + _SLICE])], schema=_SCHEMA)

    return count


def counted_runs(df: DataFrame, value: str, weight: str | None, missing_weight: int = 1, run_rows: int = RUN_ROWS) -> DataFrame:
    """The map tasks' sorted runs ``value, weight``, nulls too, written once: what follows reads them several times."""
    amount = F.lit(1) if weight is None else F.coalesce(F.col(f"`{weight}`"), F.lit(missing_weight))
    checkpoint_dir(df.sparkSession)
    return df.select(F.col(f"`{value}`").cast("string").alias("value"), amount.cast("long").alias("weight")).mapInArrow(_runs(run_rows), _OUT).checkpoint()


def _heaviest_of(runs: DataFrame, k: int) -> DataFrame:
    ranges = runs.where("value is not null").repartitionByRange(F.col("value")).sortWithinPartitions("value")
    return ranges.mapInArrow(_count_runs(k), _OUT).orderBy(F.desc("weight"), "value").limit(k)


def heaviest(df: DataFrame, value: str, weight: str | None, k: int, missing_weight: int = 1, run_rows: int = RUN_ROWS) -> DataFrame:
    """The ``k`` values with the largest sums of ``weight`` (rows, if None): ``value, weight``; exact for weights of any sign."""
    return _heaviest_of(counted_runs(df, value, weight, missing_weight, run_rows), k)


def at_least(df: DataFrame, value: str, weight: str | None, share: float, missing_weight: int = 1, run_rows: int = RUN_ROWS) -> DataFrame:
    """All values that hold at least ``share`` of the whole weight, null values' included: ``value, weight``.

    Weights must not be negative: then at most ``1 / share`` values can qualify, and a heap of that size loses none.
    """
    runs = counted_runs(df, value, weight, missing_weight, run_rows)
    whole = runs.agg(F.sum("weight").alias("weight"))
    exact = Fraction(str(share))  # whole numbers, so that a value of exactly that share is in
    return _heaviest_of(runs, int(1 / exact) + 1).where(F.col("weight") * exact.denominator >= whole.scalar() * exact.numerator)
