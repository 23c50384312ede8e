"""Raw delimited records into typed rows, and the ones that fail with reason and place (problem 1).

A batch of records is one byte buffer.  A finite automaton with six states runs over it; the buffer is cut into equal
chunks that do not respect record borders, each chunk yields the map from every possible state before it to the state
after it, those maps are composed by a parallel prefix, and a second pass over all chunks at once gives the state at
each byte.  A record of any length therefore costs the same per byte as many short ones.  The operator is an Arrow UDF
on one column: it adds no shuffle, keeps all other columns and runs wherever the scan runs.

Defined results: null, empty and blank records are rejected as ``column_count``; repeated records are judged each on
its own; an empty table gives an empty table; columns of the input are all kept, and the result goes into one struct
column whose name the caller picks (a column of that name is replaced; ``split_records`` picks a free one).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OTHER, COMMA, QUOTE, BACKSLASH, LETTER_N, BLANK, END = range(7)
START, TEXT, QUOTED, ESCAPE, CLOSED, BAD = range(6)
_STATES, _WIDTH = 6, 8
_CHUNK = 512

#: The state after a byte, by class of the byte (rows) and the state before it (columns, in the order above).
TRANSITIONS = np.array(
    [
        [TEXT, TEXT, QUOTED, BAD, BAD, BAD],  # other
        [START, START, QUOTED, BAD, START, BAD],  # comma
        [QUOTED, BAD, CLOSED, QUOTED, BAD, BAD],  # quote
        [TEXT, TEXT, ESCAPE, QUOTED, BAD, BAD],  # backslash
        [TEXT, TEXT, QUOTED, QUOTED, BAD, BAD],  # the letter n
        [START, TEXT, QUOTED, BAD, CLOSED, BAD],  # blank
        [START] * 6,  # end of record
    ],
    dtype=np.uint8,
)
_FLAT = np.zeros((7, _WIDTH), dtype=np.uint8)
_FLAT[:, :_STATES] = TRANSITIONS
_FLAT = _FLAT.ravel()

_ARROW = {"S": pa.string(), "I": pa.int32(), "D": pa.float64()}
_SQL = {"S": "string", "I": "int", "D": "double"}


@dataclass(frozen=True)
class RecordFormat:
    """Separator, type codes (S, I or D) and names of the fields of a record."""

    types: str
    names: Sequence[str]
    separator: str = ","

    def __post_init__(self):
        if len(self.types) != len(self.names) or set(self.types) - set("SID"):
            raise ValueError("give one type code out of S, I and D for each name")
        if len(self.separator) != 1 or not self.separator.isascii() or self.separator in '"\\n \t':
            raise ValueError("the separator is one ASCII character that is no quote, backslash, n or blank")

    @property
    def sql(self) -> str:
        fields = ", ".join(f"`{n}` {_SQL[t]}" for n, t in zip(self.names, self.types))
        return f"struct<reason: string, error_at: int, {fields}>".replace("`: ", "` ")


def states_before(classes: np.ndarray, chunk: int = _CHUNK) -> np.ndarray:
    """The automaton's state before each byte, starting in ``START``."""
    n = len(classes)
    chunks = max(1, -(-n // chunk))
    padded = np.full(chunks * chunk, END, dtype=np.uint8)
    padded[:n] = classes
    rows = np.ascontiguousarray(padded.reshape(chunks, chunk).T) * _WIDTH  # the i-th byte of all chunks
    # the map of each chunk: the state after it for every state before it
    maps = np.repeat(np.arange(_STATES, dtype=np.uint8)[:, None], chunks, axis=1)
    for row in rows:
        maps = _FLAT[row[None, :] + maps]
    # parallel prefix: after the step of width w, a map covers its own chunk and the 2w - 1 before it
    width = 1
    while width < chunks:
        maps = np.concatenate([maps[:, :width], np.take_along_axis(maps[:, width:], maps[:, :-width], axis=0)], axis=1)
        width *= 2
    state = np.full(chunks, START, dtype=np.uint8)
    state[1:] = maps[START, :-1]
    out = np.empty((chunk, chunks), dtype=np.uint8)
    for i, row in enumerate(rows):
        out[i] = state
        state = _FLAT[row + state]
    return out.T.reshape(-1)[:n]


def _class_table(separator: str) -> np.ndarray:
    table = np.full(256, OTHER, dtype=np.uint8)
    for char, cls in ((separator, COMMA), ('"', QUOTE), ("\\", BACKSLASH), ("n", LETTER_N), (" ", BLANK), ("\t", BLANK)):
        table[ord(char)] = cls
    return table


def _integers(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    sound = pc.match_substring_regex(text, r"^-?[0-9]+$")
    digits = pc.replace_substring_regex(text, r"^(-?)0+([0-9])", r"\1\2")
    short = pc.and_(sound, pc.less_equal(pc.utf8_length(digits), 11))
    wide = pc.cast(pc.if_else(short, digits, pa.scalar(None, pa.string())), pa.int64())
    fits = pc.fill_null(pc.and_(pc.greater_equal(wide, -(2**31)), pc.less_equal(wide, 2**31 - 1)), False)
    return pc.cast(pc.if_else(fits, wide, pa.scalar(None, pa.int64())), pa.int32()), fits.to_numpy(zero_copy_only=False)


def _doubles(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    sound = pc.match_substring_regex(text, r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    given = pc.if_else(sound, text, pa.scalar(None, pa.string()))
    try:
        values = pc.fill_null(pc.cast(pc.replace_substring_regex(given, r"^\+", ""), pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    except pa.ArrowInvalid:  # a number beyond the range of doubles is among them
        values = np.array([float(x) if x is not None else np.nan for x in given.to_pylist()], dtype=np.float64)
    finite = np.isfinite(values)
    return pa.array(values, mask=~finite), finite


def parse_batch(records: pa.Array, form: RecordFormat) -> pa.StructArray:
    """The UDF's body: reason, byte offset of the error and typed fields of each record."""
    if isinstance(records, pa.ChunkedArray):
        records = records.combine_chunks()
    records = pc.cast(records, pa.large_string())
    rows, width = len(records), len(form.types)
    null = pc.is_null(records).to_numpy(zero_copy_only=False)
    records = pc.fill_null(records, "")
    if isinstance(records, pa.ChunkedArray):
        records = records.combine_chunks()
    if rows:
        starts = np.frombuffer(records.buffers()[1], dtype=np.int64)[records.offset : records.offset + rows + 1]
        body = records.buffers()[2]
        raw = np.frombuffer(body, dtype=np.uint8)[starts[0] : starts[-1]] if body is not None else np.zeros(0, np.uint8)
        starts = starts - starts[0]
    else:
        starts, raw = np.zeros(1, np.int64), np.zeros(0, np.uint8)

    ends = starts[1:] + np.arange(rows)  # where each record's end mark goes
    is_byte = np.ones(len(raw) + rows, dtype=bool)
    is_byte[ends] = False
    data = np.zeros(len(raw) + rows, dtype=np.uint8)
    data[is_byte] = raw
    cls = np.full(len(raw) + rows, END, dtype=np.uint8)
    cls[is_byte] = _class_table(form.separator)[raw]
    before = states_before(cls)
    after = _FLAT[cls * _WIDTH + before]
    first = ends - np.diff(starts)  # of each record, in the marked buffer

    error_at = np.full(rows, -1, dtype=np.int64)
    broken = np.flatnonzero((after == BAD) & (before != BAD))
    which = np.searchsorted(ends, broken)
    error_at[which] = broken - first[which]
    quoting = error_at >= 0
    at_end = before[ends]
    open_end = (at_end == QUOTED) | (at_end == ESCAPE)
    error_at[open_end] = (ends - first)[open_end]
    quoting |= open_end

    closes = (cls == END) | ((cls == COMMA) & ((before == START) | (before == TEXT) | (before == CLOSED)))
    field_end = np.flatnonzero(closes)
    field_record = np.searchsorted(ends, field_end)
    count = np.bincount(field_record, minlength=rows)
    # every record has its end mark, so no segment is empty
    black = np.add.reduceat(((cls != BLANK) & (cls != END)).astype(np.int64), first) if rows else np.zeros(0, np.int64)
    odd = ~quoting & ((count != width) | (black == 0) | null)
    last_field = np.cumsum(count) - 1
    extra = odd & (count > width)
    error_at[odd] = (ends - first)[odd]
    error_at[extra] = field_end[(last_field - count + 1 + width - 1)[extra]] - first[extra]

    # the bytes that are a field's content, and the fields made of them
    escape_n = (before == ESCAPE) & (cls == LETTER_N)
    keep = (
        ((before == START) & ((cls == OTHER) | (cls == LETTER_N) | (cls == BACKSLASH)))
        | ((before == TEXT) & (cls != COMMA) & (cls != END))
        | ((before == QUOTED) & (cls != QUOTE) & (cls != BACKSLASH) & (cls != END))
        | ((before == ESCAPE) & (cls != END))
    )
    data[escape_n] = 10
    field_of = np.cumsum(closes) - closes
    lengths = np.bincount(field_of[keep], minlength=len(field_end))
    offsets = np.zeros(len(field_end) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    fields = pa.LargeStringArray.from_buffers(len(field_end), pa.py_buffer(offsets), pa.py_buffer(data[keep].tobytes()))
    enclosed = np.zeros(len(field_end), dtype=bool)
    enclosed[field_of[(before == START) & (cls == QUOTE)]] = True

    good = ~(quoting | odd)
    value = np.zeros(rows, dtype=bool)
    base = last_field - width + 1
    out: list[pa.Array] = []
    for j, code in enumerate(form.types):
        index = pa.array(np.where(good, base + j, 0), mask=~good)
        text = fields.take(index)
        quoted = pa.array(enclosed[np.where(good, base + j, 0)] if len(field_end) else good)
        text = pc.cast(pc.if_else(quoted, text, pc.ascii_rtrim(text, " \t")), pa.string())
        if code == "S":
            out.append(text)
            continue
        column, sound = (_integers if code == "I" else _doubles)(text)
        out.append(column)
        wrong = good & ~sound
        place = wrong & ~value
        if place.any():
            prior = field_end[np.maximum(base + j - 1, 0)] + 1
            begin = prior if j else first
            error_at[place] = (begin - first)[place]
        value |= wrong
    reason = np.full(rows, None, dtype=object)
    reason[value] = "value"
    reason[odd] = "column_count"
    reason[quoting] = "quoting"
    fine = ~(quoting | odd | value)
    # a record is either whole or rejected: no half-typed rows
    out = [pc.if_else(pa.array(fine), c, pa.scalar(None, c.type)) for c in out]
    arrays = [pa.array(reason.tolist(), pa.string()), pa.array(error_at, mask=error_at < 0).cast(pa.int32()), *out]
    arrays = [a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays]
    return pa.StructArray.from_arrays(arrays, names=["reason", "error_at", *form.names])


def parse_records(df: DataFrame, column: str, form: RecordFormat, into: str = "record") -> DataFrame:
    """``df`` with a struct column ``into``: ``reason`` (null if sound), ``error_at`` and the typed fields.

    ``reason`` is the first that holds of ``quoting``, ``column_count`` and ``value``; ``error_at`` is the byte offset
    within the record (for quoting the offending byte or the end, for column_count the first surplus separator or the
    end, for value the field's start).  Fields of a rejected record are null.
    """

    def body(records: pa.Array) -> pa.Array:
        return parse_batch(records, form)

    udf = F.arrow_udf(body, returnType=form.sql)
    return df.withColumn(into, udf(F.col(f"`{column}`").cast("string")))


def split_records(df: DataFrame, column: str, form: RecordFormat, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The sound rows, typed, and the rejected ones with ``reason``, ``error_at`` and the raw record; both with ``keep``.

    A field whose name is among ``keep`` comes out with the prefix ``field_``; ``reason`` and ``error_at`` then with ``record_``.
    """
    at = "record"
    while at in df.columns:
        at += "_"
    parsed = parse_records(df, column, form, at)
    kept = [F.col(f"`{k}`") for k in keep]
    names = [(n, f"field_{n}" if n in keep else n) for n in form.names]
    sound = parsed.where(F.col(f"{at}.reason").isNull()).select(*kept, *[F.col(f"{at}.`{a}`").alias(b) for a, b in names])
    label = {n: f"record_{n}" if n in keep or n == column else n for n in ("reason", "error_at")}
    raw = [] if column in keep else [F.col(f"`{column}`")]
    failed = parsed.where(F.col(f"{at}.reason").isNotNull()).select(*kept, *raw, F.col(f"{at}.reason").alias(label["reason"]), F.col(f"{at}.error_at").alias(label["error_at"]))
    return sound, failed


#: The CDN access log: types and names of its 17 columns (fixed values).
ACCESS_LOG = RecordFormat(
    "IDSSSSSSIIIIIIISS",
    (
        "version", "timestamp", "IN_OUT", "from_cache", "client_ip", "server_ip", "URL_requested", "Referrer_URL", "HTTP_stat",
        "nbytes", "CORAL1", "CORAL2", "CORAL3", "CORAL4", "dl_utime", "X_Forwarded_For_header", "VIA_header",
    ),
)
