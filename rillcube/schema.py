"""Type codes of the data model and schema checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Type codes (fixed values): string, 32-bit integer, double, epoch seconds, bytes.
TYPE_CODES = {"S": T.StringType(), "I": T.IntegerType(), "D": T.DoubleType(), "T": T.LongType(), "B": T.BinaryType()}
_KINDS = {
    "S": (T.StringType,),
    "I": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "D": (T.FloatType, T.DoubleType, T.DecimalType),
    "T": (T.LongType, T.IntegerType, T.TimestampType, T.TimestampNTZType),
    "B": (T.BinaryType,),
}
MAX_DIMENSION_BYTES = 254


class EngineSchemaError(ValueError):
    """A column is missing or of the wrong type, or streams that are put together differ."""


def require(df: DataFrame, column: str, codes: str = "") -> T.DataType:
    """The type of a column that has to exist and, with ``codes``, to be of one of these type codes."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    if column not in fields:
        raise EngineSchemaError(f"there is no column {column}; there are {', '.join(fields)}")
    if codes and not any(isinstance(fields[column], _KINDS[c]) for c in codes):
        raise EngineSchemaError(f"column {column} is {fields[column].simpleString()}; wanted one of the codes {codes}")
    return fields[column]


def absent(df: DataFrame, columns: Iterable[str]) -> None:
    """New columns must not clash with existing ones."""
    clash = sorted(set(df.columns) & set(columns))
    if clash:
        raise EngineSchemaError(f"the input has {', '.join(clash)} already")


def same_schema(parts: list[DataFrame]) -> None:
    """Streams that flow together have the same names and types in the same order."""
    first = [(f.name, f.dataType) for f in parts[0].schema.fields]
    for part in parts[1:]:
        if [(f.name, f.dataType) for f in part.schema.fields] != first:
            raise EngineSchemaError(f"schemas differ: {parts[0].schema.simpleString()} and {part.schema.simpleString()}")
