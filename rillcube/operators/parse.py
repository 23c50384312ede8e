"""Lines into typed columns: CSV records and regular expressions.

Null lines never parse; values that do not convert become null (``try_cast``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillcube.operators.records import RecordFormat, parse_records
from rillcube.schema import TYPE_CODES, EngineSchemaError, absent, require

_SQL = {"S": "string", "I": "int", "D": "double"}


def typed(text: Column, code: str) -> Column:
    """A string as one of the codes S, I or D; null where it is no such value."""
    return text if code == "S" else F.trim(text).try_cast(TYPE_CODES[code])


def _kept(types: str, keep: Sequence[int] | str) -> list[int]:
    positions = range(len(types)) if keep == "all" else sorted({int(k) for k in (keep.split() if isinstance(keep, str) else keep)})
    if set(types) - set("SID") or any(not 0 <= k < len(types) for k in positions):
        raise EngineSchemaError("types are out of S, I and D, and kept fields are positions in them")
    return list(positions)


def csv_parse(df: DataFrame, column: str, types: str, names: Sequence[str], fields_to_keep: Sequence[int] | str = "all", discard_off_size: bool = True) -> DataFrame:
    """Records with comma, double quote and backslash escape; kept fields in their order, all other columns dropped.

    Rows of another field count than ``types`` has are dropped; with ``discard_off_size=False`` short ones are kept, with
    nulls, and long ones still dropped.  The split is JVM-side: an escaped-list pattern takes the fields one by one.
    """
    require(df, column, "S")
    kept = _kept(types, fields_to_keep)
    field = r'\s*("(?:[^"\\]|\\.)*"|(?:[^",\\]|\\.)*)\s*(?:,|$)'
    # one more comma makes the last field end like the others
    found = F.regexp_extract_all(F.concat(F.col(f"`{column}`"), F.lit(",")), F.lit(field.replace("(?:,|$)", ",")), F.lit(1))
    rows = df.select(found.alias("fields"))
    size = F.size("fields")
    rows = rows.where(size == len(types)) if discard_off_size else rows.where(size <= len(types))

    def value(i: int) -> Column:
        raw = F.trim(F.get("fields", F.lit(i)))
        inner = F.regexp_replace(F.regexp_replace(raw, r'^"(.*)"$', "$1"), r'\\(["\\,])', "$1")
        return typed(inner, types[i]).alias(names[i])

    return rows.select(*[value(i) for i in kept])


def csv_parse_blanks(df: DataFrame, column: str, types: str, names: Sequence[str], fields_to_keep: Sequence[int] | str = "all") -> DataFrame:
    """As ``csv_parse``, where runs of blanks and commas both part fields, except within double quotes."""
    require(df, column, "S")
    kept = _kept(types, fields_to_keep)
    found = F.regexp_extract_all(F.col(f"`{column}`"), F.lit(r'("[^"]*"|[^\s,"]+)'), F.lit(1))
    rows = df.select(found.alias("fields")).where(F.size("fields") == len(types))
    return rows.select(*[typed(F.regexp_replace(F.get("fields", F.lit(i)), '^"|"$', ""), types[i]).alias(names[i]) for i in kept])


def csv_parse_strict(df: DataFrame, column: str, types: str, names: Sequence[str]) -> DataFrame:
    """By the finite-state tokenizer: rows with any error dropped (``records.split_records`` gives them with reasons)."""
    form = RecordFormat(types, tuple(names))
    parsed = parse_records(df.select(F.col(f"`{column}`").alias("raw")), "raw", form, "record")
    return parsed.where("record.reason is null").select(*[F.col(f"record.`{n}`").alias(n) for n in names])


def generic_parse(df: DataFrame, column: str, pattern: str, types: str, names: Sequence[str], keep_unparsed: bool = True, on_no_match: str = "drop") -> DataFrame:
    """A full match of ``pattern``; each group becomes a typed column in the place of ``column``.

    ``keep_unparsed`` keeps the columns before and after.  Rows without a match are dropped, or with
    ``on_no_match="null"`` get nulls.
    """
    require(df, column, "S")
    if len(types) != len(names) or set(types) - set("SID"):
        raise EngineSchemaError("give one type code out of S, I and D for each name")
    text, whole = F.col(f"`{column}`"), f"^(?:{pattern})$"
    rows = df.where(text.rlike(whole)) if on_no_match == "drop" else df
    matched = text.rlike(whole)
    parts = [F.when(matched, typed(F.regexp_extract(text, whole, i + 1), t)).alias(n) for i, (t, n) in enumerate(zip(types, names))]
    at = df.columns.index(column)
    before, after = ([F.col(f"`{c}`") for c in cs] for cs in (df.columns[:at], df.columns[at + 1 :]))
    if keep_unparsed:
        absent(df.drop(column), names)
        return rows.select(*before, *parts, *after)
    return rows.select(*parts)
