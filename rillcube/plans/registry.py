"""Operators by name: ``(DataFrame, **cfg) -> DataFrame``.  Users register their own the same way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from rillcube.operators import filters, parse, sampling, transform
from rillcube.schema import EngineSchemaError

Operator = Callable[..., DataFrame]
_OPERATORS: dict[str, Operator] = {}


def register_operator(name: str, operator: Operator, replace: bool = False) -> None:
    if name in _OPERATORS and not replace:
        raise EngineSchemaError(f"there is an operator {name} already")
    _OPERATORS[name] = operator


def operator(name: str) -> Operator:
    if name not in _OPERATORS:
        raise EngineSchemaError(f"there is no operator {name}; there are {', '.join(sorted(_OPERATORS))}")
    return _OPERATORS[name]


def names() -> list[str]:
    return sorted(_OPERATORS)


def identity(df: DataFrame) -> DataFrame:
    return df


for _name, _operator in {
    "csv_parse": parse.csv_parse, "csv_parse_blanks": parse.csv_parse_blanks, "csv_parse_strict": parse.csv_parse_strict, "generic_parse": parse.generic_parse,
    "extend": transform.extend, "project_drop": transform.project_drop, "stamp": transform.stamp, "round_time": transform.round_time,
    "url_to_domain": transform.url_to_domain, "time_warp": transform.time_warp, "grep": filters.grep, "equals": filters.equals,
    "greater_than": filters.greater_than, "ratio_above": filters.ratio_above, "window_limit": filters.window_limit,
    "bernoulli": sampling.bernoulli, "hash_sample": sampling.hash_sample, "variable_sample": sampling.variable_sample,
    "interval_sample": sampling.interval_sample, "no_op": identity,
}.items():
    register_operator(_name, _operator)
