"""Structured Streaming twins of the batch subscriptions, and the period state kept by micro-batches.

Event times are timestamps.  In append mode a window comes out once the watermark has passed it, and later rows of it are
dropped from the output; update and complete mode keep correcting.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rillcube.operators import lateness
from rillcube.schema import EngineSchemaError


def windowed_stream(stream: DataFrame, time: str, window: str, delay: str, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Tumbling windows of a stream: ``window_start``, the keys and the aggregates."""
    grouped = stream.withWatermark(time, delay).groupBy(F.window(F.col(time), window).alias("w"), *keys).agg(*aggs)
    return grouped.select(F.col("w.start").alias("window_start"), *[c for c in grouped.columns if c != "w"])


def closed_windows(streams: Sequence[DataFrame], time: str, window: str, delay: str, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Windows over several inputs, each with its own watermark: in append mode a window comes out once all inputs have passed it, as
    the watermark that holds is the least of the inputs' (the session's default policy)."""
    marked = [s.withWatermark(time, delay) for s in streams]
    whole = marked[0]
    for other in marked[1:]:
        whole = whole.unionByName(other)
    grouped = whole.groupBy(F.window(F.col(time), window).alias("w"), *keys).agg(*aggs)
    return grouped.select(F.col("w.start").alias("window_start"), *[c for c in grouped.columns if c != "w"])


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Everything that is there now, into a table under ``folder``, and that table; ``mode`` is append or complete."""
    if mode not in ("append", "complete"):
        raise EngineSchemaError(f"a table takes a stream in append or complete mode, not {mode}")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{folder}/table")
    else:
        writer = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/table"))
    writer.start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/table")


def delayed_one_shot(stream: DataFrame, insert: Callable[[DataFrame, int], None], ask: Callable[[], DataFrame], checkpoint: str) -> DataFrame:
    """Take in a stream to its present end, then ask once."""
    stream.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return ask()


class PeriodStore:
    """The multiset state of event-time periods, on disk, corrected by every micro-batch.

    A batch appends its own value counts (and its rows beyond the cut-off, apart) under its number; running it again replaces
    them.  Results come from all counts together: a late row changes its period's median as if it had been on time.

    Across batches the cut-off needs each source's high mark: batches keep theirs, one row per source, and a batch is judged
    with the marks of the batches before it.
    """

    def __init__(self, spark: SparkSession, root: str, value: Column, weight: Column, source: str = "site", time: str = "time", arrival: str = "arrival_time", tie: str = "tuple_id", period: int = lateness.PERIOD, late: int = lateness.LATENESS):
        self.spark, self.root, self.value, self.weight = spark, root.rstrip("/"), value, weight
        self.source, self.time, self.arrival, self.tie, self.period, self.late = source, time, arrival, tie, period, late

    def _read(self, part: str, before: int | None = None) -> DataFrame | None:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{part}")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return None
        found = sorted(s.getPath().getName() for s in fs.listStatus(folder))
        found = [f for f in found if before is None or f < f"b{before:012d}"]
        return self.spark.read.parquet(*[f"{self.root}/{part}/{f}" for f in found]) if found else None

    def take(self, rows: DataFrame, batch: int) -> None:
        """One micro-batch; arrivals within it come after those of earlier batches."""
        columns = rows.columns
        if "mark_row" in columns:
            raise EngineSchemaError("the column name mark_row is taken")
        marks = self._read("marks", batch)
        judged = rows.withColumn("mark_row", F.lit(False))
        if marks is not None:
            # a source's mark so far enters as a usable row that arrived first
            known = marks.groupBy("source").agg(F.max("mark").alias("mark"))
            types = dict(rows.dtypes)
            entry = {self.source: F.col("source"), self.time: F.col("mark"), self.arrival: F.col("mark")}
            marks_as_rows = known.select(*[entry.get(c, F.lit(None)).cast(types[c]).alias(c) for c in columns], F.lit(True).alias("mark_row"))
            judged = judged.unionByName(marks_as_rows)
        in_time, beyond = lateness.split_late(judged, self.source, self.time, self.arrival, self.tie, self.period, self.late)
        name = f"b{batch:012d}"
        state = lateness.period_multiset(in_time.where("not mark_row"), self.value, self.weight, self.time, self.period)
        state.write.mode("overwrite").parquet(f"{self.root}/counts/{name}")
        beyond.where("not mark_row").select(*columns).write.mode("overwrite").parquet(f"{self.root}/beyond/{name}")
        usable = rows.where(F.col(f"`{self.time}`") <= F.col(f"`{self.arrival}`"))
        usable.groupBy(F.col(f"`{self.source}`").alias("source")).agg(F.max(f"`{self.time}`").alias("mark")).write.mode("overwrite").parquet(f"{self.root}/marks/{name}")

    def run(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(lambda df, n: self.take(df, int(n))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def state(self) -> DataFrame:
        parts = self._read("counts")
        if parts is None:
            raise EngineSchemaError("no batch was taken yet")
        return parts.groupBy("k_period", "value").agg(F.sum("n").alias("n"), F.sum("s_total").alias("s_total"))

    def results(self, probabilities: Sequence[float] = (0.5,)) -> DataFrame:
        return lateness.period_results(self.state(), probabilities)

    def beyond(self) -> DataFrame:
        return self._read("beyond")
