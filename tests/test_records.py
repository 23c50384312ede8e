import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillcube.operators.records import ACCESS_LOG, TRANSITIONS, RecordFormat, parse_batch, parse_records, split_records, states_before

FORM = RecordFormat("ISD", ("a", "b", "c"))


def brute_fields(s):
    """Character by character; the fields, or None for a quoting error."""
    out, state, buf, quoted = [], "start", "", False
    for ch in s + "\0":
        end = ch == "\0"
        if state == "esc":
            if end or ch not in '"\\n':
                return None
            buf, state = buf + ("\n" if ch == "n" else ch), "quoted"
        elif state == "quoted":
            if end:
                return None
            if ch == '"':
                state = "closed"
            elif ch == "\\":
                state = "esc"
            else:
                buf += ch
        elif end or ch == ",":
            out.append(buf if state == "closed" else buf.rstrip(" \t"))
            state, buf = "start", ""
        elif state == "start":
            if ch == '"':
                state, quoted = "quoted", True
            elif ch not in " \t":
                state, buf = "text", ch
        elif state == "text":
            if ch == '"':
                return None
            buf += ch
        elif ch not in " \t":
            return None
    return out


def brute(s, types):
    if s is None or not s.strip(" \t"):
        return "column_count", None
    fields = brute_fields(s)
    if fields is None:
        return "quoting", None
    if len(fields) != len(types):
        return "column_count", None
    out = []
    for f, t in zip(fields, types):
        if t == "I":
            if not re.fullmatch("-?[0-9]+", f) or not -(2**31) <= int(f) < 2**31:
                return "value", None
            out.append(int(f))
        elif t == "D":
            if not re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", f) or not math.isfinite(float(f)):
                return "value", None
            out.append(float(f))
        else:
            out.append(f)
    return None, out


def check(lines, form):
    got = parse_batch(pa.array(lines, pa.string()), form).to_pylist()
    for line, g in zip(lines, got, strict=True):
        reason, fields = brute(line, form.types)
        assert g["reason"] == reason, (line, g)
        assert (g["error_at"] is None) == (reason is None)
        assert [g[n] for n in form.names] == (fields or [None] * len(form.names)), line


@given(st.lists(st.one_of(st.none(), st.text(alphabet='",\\n \t1-.exé港', max_size=14)), max_size=12))
@settings(max_examples=300, deadline=None)
def test_against_brute_force(lines):
    check(lines, FORM)


@given(st.binary(max_size=400), st.integers(1, 17))
@settings(max_examples=100, deadline=None)
def test_chunks_compose(data, chunk):
    classes = np.frombuffer(data, np.uint8) % 7
    state, want = 0, []
    for c in classes:
        want.append(state)
        state = TRANSITIONS[c, state]
    assert states_before(classes, chunk).tolist() == want


def test_cases_and_offsets():
    lines = ['1,x,2.5', ' "1" , "a, \\"b\\" \\\\ \\n" ,\t1e3', '1,a"b,2', '1,"ab,2', '1,"a"b,2', '1,"a\\x",2', "1,a", "1,a,2,3", "", "  ", None, "x,a,2", "1,a,nan", "1,a,1e999", "2147483648,a,1", "-2147483648,,1", "1.0,a,1"]
    check(lines, FORM)
    got = parse_batch(pa.array(lines), FORM).to_pylist()
    assert got[1]["b"] == 'a, "b" \\ \n' and got[1]["c"] == 1000.0
    assert got[2]["error_at"] == 3 and got[3]["error_at"] == 7 and got[7]["error_at"] == 5 and got[11]["error_at"] == 0 and got[12]["error_at"] == 4


def test_long_and_sliced():
    random.seed(1)
    long = "1,\"" + "x,é" * 40_000 + '\\"",2'
    batch = pa.array(["junk", long, "1,y,3"]).slice(1)
    got = parse_batch(batch, FORM).to_pylist()
    assert got[0]["reason"] is None and got[0]["b"].endswith('"') and got[1]["b"] == "y"


def test_format_is_checked():
    with pytest.raises(ValueError):
        RecordFormat("IX", ("a", "b"))
    with pytest.raises(ValueError):
        RecordFormat("I", ("a",), '"')


def test_split(spark):
    df = spark.createDataFrame([(1, "7,x,1", "k", 5), (2, "7,x", None, 6), (2, "7,x", None, 6), (3, None, "n", None)], "id int, raw string, a string, record int")
    sound, failed = split_records(df, "raw", FORM, keep=["id", "a", "record"])
    assert sound.columns == ["id", "a", "record", "field_a", "b", "c"]
    assert rows(sound) == [(1, "k", 5, 7, "x", 1.0)]
    assert rows(failed.select("id", "reason", "error_at")) == [(2, "column_count", 3), (2, "column_count", 3), (3, "column_count", 0)]
    none = df.where("id < 0")
    assert [x.count() for x in split_records(none, "raw", FORM, keep=["id"])] == [0, 0]
    again = parse_records(df, "raw", FORM, "a").select("id", "a.reason")
    assert again.count() == 4
    clash = df.withColumnRenamed("a", "reason")
    assert "record_reason" in split_records(clash, "raw", FORM, keep=["reason"])[1].columns


def test_whole_table(spark, data):
    df = spark.read.parquet(f"{data}/csv_elements.parquet")
    want = sorted((r["tuple_id"], brute(r["s_val"], ACCESS_LOG.types)[0]) for r in df.collect() if brute(r["s_val"], ACCESS_LOG.types)[0])
    _, failed = split_records(df, "s_val", ACCESS_LOG, keep=["tuple_id"])
    assert rows(failed.select("tuple_id", "reason")) == sorted(want, key=repr)
    sound, _ = split_records(df.where(F.length("s_val") > 0), "s_val", ACCESS_LOG, keep=["tuple_id"])
    assert dict(sound.dtypes)["dl_utime"] == "int" and sound.count() + len(want) >= df.count()
