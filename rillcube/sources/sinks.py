"""Where rows end: memory, nowhere, the console, files, or an iterator of the client."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StreamingQuery


def ground(df: DataFrame) -> None:
    """Run the plan in full and keep nothing."""
    df.write.format("noop").mode("overwrite").save()


def to_memory(stream: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    """A stream into an in-memory table of that name, for tests and small results."""
    return stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()


def echo(df: DataFrame, rows: int = 20) -> DataFrame:
    """Print the first rows and pass all on."""
    df.show(rows, truncate=False)
    return df


def to_text(df: DataFrame, path: str, append: bool = True) -> None:
    """Rows as lines of comma-separated fields."""
    df.write.mode("append" if append else "overwrite").csv(path)


def client_rows(df: DataFrame) -> Iterator[Row]:
    """Rows one by one at the client, a partition at a time."""
    return df.toLocalIterator(prefetchPartitions=True)
