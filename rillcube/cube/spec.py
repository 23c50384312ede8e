"""What a cube holds: dimensions and aggregates, with the columns they come from."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillcube.cube.levels import FLAT_LEAF, TIME_LEAF, time_at_level
from rillcube.operators.transform import epoch_seconds
from rillcube.schema import EngineSchemaError, require

DIMENSIONS = {"string": "S", "int": "I", "double": "D", "time": "TID", "time_containment": "TID"}
AGGREGATES = ("count", "sum", "avg", "min_i", "min_d", "min_t", "string", "quantile_histogram", "quantile_sample", "quantile_sketch")


def is_name(text: str) -> bool:
    """Whether a text can name a cube or column: ASCII letters, digits and underscores, after a number and a slash if there is one."""
    number, slash, own = text.rpartition("/")
    return text.isascii() and own.replace("_", "x").isalnum() and (not slash or number.isdigit())


@dataclass(frozen=True)
class Dimension:
    """``kind`` is one of string, int, double, time and time_containment; ``column`` is the input's, by default of the same name."""

    name: str
    kind: str = "string"
    column: str | None = None

    @property
    def source(self) -> str:
        return self.column or self.name

    @property
    def leaf(self) -> int:
        return TIME_LEAF if self.kind == "time_containment" else FLAT_LEAF

    @property
    def collapsed(self) -> Column:
        """The constant that stands for "all" at level 0."""
        return {"string": F.lit("0"), "int": F.lit(0), "double": F.lit(0.0)}.get(self.kind, F.lit(0).cast("long"))

    def leaf_value(self, df: DataFrame) -> Column:
        if self.kind in ("time", "time_containment"):
            return epoch_seconds(df, self.source)
        return F.col(f"`{self.source}`")

    def at(self, level: int, leaf: Column | None = None) -> Column:
        """The dimension's value at a level, from its leaf value (by default the cube's column)."""
        leaf = F.col(f"`{self.name}`") if leaf is None else leaf
        if self.kind == "time_containment":
            return time_at_level(leaf, level)
        return leaf if level > 0 else self.collapsed


@dataclass(frozen=True)
class Aggregate:
    """``columns``: none for a count of rows, (sum, count) or (sum,) for avg, else one; ``size`` is a summary's."""

    name: str
    kind: str = "count"
    columns: tuple[str, ...] = ()
    size: int = 100

    @property
    def partials(self) -> tuple[str, ...]:
        """The columns that hold its mergeable state."""
        return (f"{self.name}_sum", f"{self.name}_count") if self.kind == "avg" else (self.name,)


@dataclass(frozen=True)
class CubeSpec:
    name: str
    dims: Sequence[Dimension]
    aggs: Sequence[Aggregate]
    version: str | None = None

    def __post_init__(self):
        names = [x.name for x in (*self.dims, *self.aggs)]
        if not self.dims or not self.aggs:
            raise EngineSchemaError("a cube has at least one dimension and one aggregate")
        for name in (self.name, *names):
            if not is_name(name):
                raise EngineSchemaError(f"{name!r} is no name for a cube or column")
        if len(set(names)) < len(names):
            raise EngineSchemaError("names of dimensions and aggregates differ")
        for d in self.dims:
            if d.kind not in DIMENSIONS:
                raise EngineSchemaError(f"{d.kind} is no kind of dimension")
        for a in self.aggs:
            if a.kind not in AGGREGATES:
                raise EngineSchemaError(f"{a.kind} is no kind of aggregate")
            if a.kind not in ("count", "avg") and len(a.columns) != 1 or len(a.columns) > (2 if a.kind == "avg" else 1) or a.kind == "avg" and not a.columns:
                raise EngineSchemaError(f"aggregate {a.name} has the wrong number of columns")
        if any(a.kind == "string" for a in self.aggs) and self.version is None:
            raise EngineSchemaError("a last-writer string needs the column that orders the writers")

    @property
    def dim_names(self) -> list[str]:
        return [d.name for d in self.dims]

    def dim(self, name: str) -> Dimension:
        for d in self.dims:
            if d.name == name:
                return d
        raise EngineSchemaError(f"cube {self.name} has no dimension {name}")

    @property
    def output(self) -> list[str]:
        """Finalized columns: dimensions, then aggregates."""
        return [*self.dim_names, *[a.name for a in self.aggs]]

    def check(self, df: DataFrame) -> None:
        for d in self.dims:
            require(df, d.source, DIMENSIONS[d.kind])
        for a in self.aggs:
            for c in a.columns:
                require(df, c, {"string": "S", "min_d": "DI", "min_t": "TID"}.get(a.kind, "ID"))
        if self.version:
            require(df, self.version)

    @classmethod
    def positional(cls, name: str, df: DataFrame, dims: Sequence[tuple[str, str, int]], aggs: Sequence[tuple[str, str, Sequence[int]]], version: str | None = None) -> CubeSpec:
        """From positions in the input; a position past the last column means "count 1"."""
        col = df.columns
        return cls(name, [Dimension(n, k, col[i]) for n, k, i in dims], [Aggregate(n, k, tuple(col[i] for i in at if i < len(col))) for n, k, at in aggs], version)
