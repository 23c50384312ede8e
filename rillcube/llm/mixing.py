"""Mixing sources to target weights (problem 8): hash-threshold histograms.

Every record gets a hash of its id.  Sizes are summed by source and the hash's first ten bits; the budget of a source
then falls into one bucket of its histogram, only that bucket is split by the next ten bits, and so on until what is
left undecided is below ``tolerance`` of the budget.  Records below the threshold are taken, so a source stays below its
budget by less than the one record on the boundary or the tolerance.  That is a filter: nothing is
sorted or shuffled, and a larger budget keeps all records of a smaller one.  Whole repeats come before: a source whose
budget is 2.4 times its size gives each record twice and the records below the threshold of 0.4 once more.

The driver holds at most sources x 1024 sums at a time, where the sources are those of the target table, which is fixed.

Defined results: labels are compared without case, outer blanks and the difference of blank, hyphen and underscore;
records of no listed source (or null) are not taken; a listed source without records has share 0 and the others keep
their proportions; ``max_repeats`` null or below 1 is taken as 1; records of size zero follow the same threshold;
repeated rows are taken alike; an empty table gives an empty mix; further columns are kept, but ``h`` and ``copies`` are
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, LEVELS, TOLERANCE = 10, 6, 1e-4


@dataclass(frozen=True)
class Target:
    source: str
    share: float
    max_repeats: int


@dataclass(frozen=True)
class Plan:
    source: str
    target_share: float
    size: int
    budget: float
    repeats: int
    threshold: int


def label(source: Column) -> Column:
    """A source's label in one spelling."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s_-]+", "_")


def hashed(records: DataFrame, key: str = "id") -> DataFrame:
    """``records`` with ``h``, a hash of 60 bits."""
    return records.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.col(f"`{key}`")), 64 - BITS * LEVELS))


def _sums(records: DataFrame, digit: Column, condition: Column) -> dict[str, dict[int, int]]:
    rows = records.where(condition).groupBy("source", digit.alias("digit")).agg(F.sum("size").alias("size")).collect()
    out: dict[str, dict[int, int]] = {}
    for r in rows:
        out.setdefault(r["source"], {})[r["digit"]] = r["size"]
    return out


def make_plan(records: DataFrame, targets: list[Target], total: float | None = None, tolerance: float = TOLERANCE) -> list[Plan]:
    """Thresholds for ``records`` (``source`` in one spelling, ``size``, ``h``).

    ``total`` is the size of the mix; by default the largest at which no source has to be repeated too often, so that
    shares come out as wanted.  With a larger one, sources that reach their cap fall short.
    """
    known = F.col("source").isin([t.source for t in targets])
    digit = lambda level: F.shiftright("h", BITS * (LEVELS - 1 - level)).bitwiseAND(2**BITS - 1)
    first = _sums(records, digit(0), known)
    sizes = {s: sum(b.values()) for s, b in first.items()}
    present = [t for t in targets if sizes.get(t.source, 0) > 0 and t.share > 0]
    whole = sum(t.share for t in present)
    caps = {t.source: max(1, t.max_repeats or 1) for t in targets}
    if total is None:
        total = min((caps[t.source] * sizes[t.source] * whole / t.share for t in present), default=0.0)
    plans, open_ = {}, {}
    for t in targets:
        size = sizes.get(t.source, 0)
        budget = min(total * t.share / whole, caps[t.source] * size) if t in present else 0.0
        repeats = int(budget // size) if size else 0
        plans[t.source] = [t, size, budget, repeats, 0]
        rest = budget - repeats * size
        if rest > tolerance * budget:
            open_[t.source] = rest
    sums = first
    for level in range(LEVELS):
        width = BITS * (LEVELS - 1 - level)
        follow = {}
        for source, rest in open_.items():
            plan = plans[source]
            for d in sorted(sums.get(source, {})):
                held = sums[source][d]
                if held > rest:
                    plan[4] += d << width
                    follow[source] = rest
                    break
                rest -= held
            else:
                plan[4] += 1 << (width + BITS)  # all of it
        open_ = {s: r for s, r in follow.items() if r > tolerance * plans[s][2]}
        if not open_ or level == LEVELS - 1:
            break
        inside = F.lit(False)
        for source in open_:
            inside = inside | ((F.col("source") == source) & (F.shiftright("h", width) == plans[source][4] >> width))
        sums = _sums(records, digit(level + 1), inside)
    return [Plan(t.source, t.share, size, budget, repeats, threshold) for t, size, budget, repeats, threshold in plans.values()]


def take(records: DataFrame, plans: list[Plan]) -> DataFrame:
    """``records`` of the mix with ``copies``, the number of times each is in it."""
    copies = F.lit(0)
    for p in plans:
        copies = F.when(F.col("source") == p.source, F.lit(p.repeats) + (F.col("h") < p.threshold).cast("int")).otherwise(copies)
    return records.withColumn("copies", F.coalesce(copies, F.lit(0))).where("copies > 0").drop("h")


def shares(taken: DataFrame, plans: list[Plan]) -> DataFrame:
    """Per target source: ``source, target_share, wanted_share, actual_share, size, records, mean_repeats``; the wanted share is the target's among the
    sources that have records."""
    spark = taken.sparkSession
    present = sum(p.target_share for p in plans if p.size > 0) or 1.0
    rows = [(p.source, p.target_share, p.target_share / present if p.size > 0 else 0.0, p.size) for p in plans]
    wanted = spark.createDataFrame(rows, "source string, target_share double, wanted_share double, available bigint")
    got = taken.groupBy(F.col("source").alias("s")).agg(F.sum(F.col("size") * F.col("copies")).alias("size"), F.sum("copies").alias("records"))
    whole = got.agg(F.sum("size").alias("w"))
    joined = wanted.join(got, F.col("source") == F.col("s"), "left").select("source", "target_share", "wanted_share", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("records", F.lit(0)).alias("records"), "available")
    return joined.select(
        "source", "target_share", "wanted_share", F.coalesce(F.try_divide(F.col("size").cast("double"), whole.scalar()), F.lit(0.0)).alias("actual_share"), "size", "records",
        F.coalesce(F.try_divide(F.col("size").cast("double"), F.col("available")), F.lit(0.0)).alias("mean_repeats"),
    )
