"""Late and out-of-order events (problem 6): what lies beyond the cut-off, and period results that late rows correct.

Per source, rows count in the order of arrival.  The high mark before a row is the largest event time of the source's
earlier usable rows; a usable row whose period ended ``lateness`` before that mark is beyond the cut-off.  No row has to
be put in order for this.  For each source and period, one number decides: the earliest arrival of a usable row whose event
time lies ``lateness`` past the period's end or later.  It is a minimum per source and period (combined before the
shuffle), then a running minimum from the last period down over that small table; a row is beyond the cut-off if it
came after it.  A source with a third of all rows is as many groups as it has periods.

The period state is a multiset: one row per period and value with its count.  A late row within the cut-off adds to its
period's counts, and exact medians, distinct counts and extremes follow again from the cumulative counts, without the
earlier rows.

Defined results: rows with null event time, null arrival or an event time after the arrival are not usable: they are
never beyond the cut-off and raise no mark; a null source is a source like any other; repeated rows count each; ties of
arrival go by the tie column; empty tables give empty tables; further columns are kept whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillcube.operators.weighted import key_totals, percentiles

PERIOD, LATENESS = 300, 600


def period_start(time: Column, period: int = PERIOD) -> Column:
    """Epoch seconds at which the period of an event time starts."""
    return F.floor(F.unix_micros(time) / (period * 1_000_000)).cast("long") * period


def _flagged(df: DataFrame, source: str, time: str, arrival: str, tie: str, period: int, lateness: int) -> DataFrame:
    """``df`` under the column names c0, c1 and so on (so no name can clash), with ``usable`` and ``beyond``."""
    place = {c: f"c{i}" for i, c in enumerate(df.columns)}
    src = F.col(place[source])
    happened, came = F.col(place[time]).cast("timestamp"), F.col(place[arrival]).cast("timestamp")
    micros = period * 1_000_000
    rows = df.toDF(*place.values()).withColumns({"usable": F.coalesce(happened <= came, F.lit(False)), "came": F.struct(F.unix_micros(came).alias("at"), F.col(place[tie]).alias("tie"))})
    # a row of period k is beyond the cut-off once a row of reach >= k + 1 has come
    rows = rows.withColumns({"need": F.floor(F.unix_micros(happened) / micros).cast("long") + 1, "reach": F.floor((F.unix_micros(happened) - lateness * 1_000_000) / micros).cast("long")})
    cells = rows.where("usable").groupBy(src.alias("m_source"), "need", "reach").agg(F.min("came").alias("came"))
    steps = F.explode(F.array(F.struct(F.col("reach").alias("x"), F.col("came").alias("came")), F.struct(F.col("need").alias("x"), F.lit(None).cast(cells.schema["came"].dataType).alias("came"))))
    steps = cells.select("m_source", steps.alias("s")).groupBy("m_source", F.col("s.x").alias("m_need")).agg(F.min("s.came").alias("came"))
    down = Window.partitionBy("m_source").orderBy(F.desc("m_need")).rowsBetween(Window.unboundedPreceding, 0)
    closed = steps.select("m_source", "m_need", F.min("came").over(down).alias("closed"))
    joined = rows.join(closed, src.eqNullSafe(F.col("m_source")) & (F.col("need") == F.col("m_need")), "left")
    beyond = F.col("usable") & F.coalesce(F.col("came") > F.col("closed"), F.lit(False))
    return joined.select(*place.values(), "usable", beyond.alias("beyond"))


def split_late(df: DataFrame, source: str = "site", time: str = "time", arrival: str = "arrival_time", tie: str = "tuple_id", period: int = PERIOD, lateness: int = LATENESS) -> tuple[DataFrame, DataFrame]:
    """(usable rows in time for their period, rows beyond the cut-off); ``tie`` is unique within a source and arrival."""
    flagged = _flagged(df, source, time, arrival, tie, period, lateness)
    back = lambda rows: rows.drop("usable", "beyond").toDF(*df.columns)
    return back(flagged.where("usable and not beyond")), back(flagged.where("beyond"))


def period_multiset(df: DataFrame, value: Column, weight: Column, time: str = "time", period: int = PERIOD) -> DataFrame:
    """The state: ``k_period, value, n, s_total`` (rows per period and value, and their weights' sum)."""
    named = df.select(period_start(F.col(f"`{time}`").cast("timestamp"), period).alias("k_period"), value.cast("long").alias("value"), weight.cast("long").alias("w"))
    return named.groupBy("k_period", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("s_total"))


def adjust(state: DataFrame, delta: DataFrame) -> DataFrame:
    """The state after the rows of ``delta`` (a state too; negative counts retract); empty cells vanish."""
    both = state.unionByName(delta)
    return both.groupBy("k_period", "value").agg(F.sum("n").alias("n"), F.sum("s_total").alias("s_total")).where("n <> 0 or s_total <> 0")


@dataclass(frozen=True)
class CorrectedPeriods:
    """The whole answer.  ``counts``: per period and value what the rows that came before the period's end hold (``n_early``,
    ``s_early``) and what later ones add (``n_late``, ``s_late``); ``beyond``: the rows beyond the cut-off, which correct nothing."""

    counts: DataFrame
    beyond: DataFrame

    def _state(self, n: Column, total: Column) -> DataFrame:
        return self.counts.select("k_period", "value", n.alias("n"), total.alias("s_total")).where("n <> 0")

    @property
    def early(self) -> DataFrame:
        """The state before the corrections."""
        return self._state(F.col("n_early"), F.col("s_early"))

    @property
    def late(self) -> DataFrame:
        """The corrections: ``adjust(early, late)`` is ``corrected``."""
        return self._state(F.col("n_late"), F.col("s_late"))

    @property
    def corrected(self) -> DataFrame:
        """The state after the corrections."""
        both = F.when(F.col("s_early").isNull() & F.col("s_late").isNull(), None).otherwise(F.coalesce("s_early", F.lit(0)) + F.coalesce("s_late", F.lit(0)))
        return self._state(F.col("n_early") + F.col("n_late"), both)

    def results(self, probabilities: Sequence[float] = (0.5,)) -> DataFrame:
        """``period_results`` of the corrected state, and those before the corrections with the suffix ``_before``, from one pass over the counts."""
        total = F.when(F.col("s_early").isNull() & F.col("s_late").isNull(), None).otherwise(F.coalesce("s_early", F.lit(0)) + F.coalesce("s_late", F.lit(0)))
        two = F.array(F.struct(F.lit(False).alias("corrected"), F.col("n_early").alias("n"), F.col("s_early").alias("s_total")), F.struct(F.lit(True).alias("corrected"), (F.col("n_early") + F.col("n_late")).alias("n"), total.alias("s_total")))
        states = self.counts.select("k_period", "value", F.explode(two).alias("two")).where("two.n <> 0")
        found = period_results(states.select(F.struct(F.col("k_period").alias("at"), "two.corrected").alias("k_period"), "value", "two.n", "two.s_total"), probabilities)
        names = [c for c in found.columns if c != "period"]
        of = lambda c, after: F.max(F.when(F.col("period.corrected") == after, F.col(c)))
        wide = found.groupBy(F.col("period.at").alias("at")).agg(*[of(c, True).alias(c) for c in names], *[of(c, False).alias(f"{c}_before") for c in names])
        return wide.withColumnRenamed("at", "period")


def corrected_periods(df: DataFrame, value: Column, weight: Column, source: str = "site", time: str = "time", arrival: str = "arrival_time", tie: str = "tuple_id", period: int = PERIOD, lateness: int = LATENESS) -> CorrectedPeriods:
    """Multiset states per period, what late rows change in them, and the rows beyond the cut-off, all from one pass; only what is asked for is computed."""
    in_time, beyond = split_late(df, source, time, arrival, tie, period, lateness)
    start = period_start(F.col(f"`{time}`").cast("timestamp"), period)
    late = F.unix_micros(F.col(f"`{arrival}`").cast("timestamp")) >= (start + period) * 1_000_000
    named = in_time.select(start.alias("k_period"), value.cast("long").alias("value"), weight.cast("long").alias("w"), late.alias("late"))
    early, later = ~F.col("late"), F.col("late")
    sums = [f(F.when(c, x)).alias(f"{p}_{n}") for n, c in (("early", early), ("late", later)) for p, f, x in (("n", F.count, F.lit(1)), ("s", F.sum, F.col("w")))]
    return CorrectedPeriods(named.groupBy("k_period", "value").agg(*sums), beyond)


def period_results(state: DataFrame, probabilities: Sequence[float] = (0.5,)) -> DataFrame:
    """Per period: ``rows``, ``total``, ``distinct_values``, ``min_value``, ``max_value`` and one ``p<percent>`` for each probability."""
    totals = key_totals(state).select("period", "rows", "total", "distinct_values")
    ends = state.where("value is not null").groupBy(F.col("k_period").alias("e_period")).agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"))
    ranks = percentiles(state.select("k_period", "value", "n"), probabilities)
    wide = ranks.groupBy(F.col("period").alias("r_period")).agg(*[F.max(F.when(F.col("p") == float(p), F.col("value"))).alias(f"p{p * 100:g}".replace(".", "_")) for p in probabilities])
    joined = totals.join(ends, F.col("period").eqNullSafe(F.col("e_period")), "left").join(wide, F.col("period").eqNullSafe(F.col("r_period")), "left")
    return joined.drop("e_period", "r_period")
