"""Cubes: leaf cells of mergeable partial states, and the queries on them.

A cube's table has one row per distinct combination of dimension values, the partial states of its aggregates and
``version``, the largest version seen.  Merging tables of partial states, in any grouping and order, gives the state of
all rows: local, regional and union cubes are one partial/final hash aggregate each.

Defined results: null dimension values are values; null measures add nothing (a count column's null counts 0, a count
without column counts rows); an average of no values is null; an empty input gives an empty cube, whose full rollup is
one row of nulls and zeros as in SQL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence, Set
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillcube.cube.spec import Aggregate, CubeSpec, Dimension
from rillcube.functions import loghist
from rillcube.schema import EngineSchemaError, same_schema


@dataclass(frozen=True)
class CubeQuery:
    """A slice with inclusive bounds (None: unbounded), a level vector, a sort (``-`` is descending) and a limit (0: none)."""

    bounds: Mapping[str, tuple[object, object]] = field(default_factory=dict)
    levels: Mapping[str, int] | None = None
    sort: Sequence[str] = ()
    limit: int = 0
    final: bool = True


def _same_keys(a: Sequence[str], b: Sequence[str]) -> Column:
    out = F.lit(True)
    for x, y in zip(a, b):
        out = out & F.col(f"`{x}`").eqNullSafe(F.col(f"`{y}`"))
    return out


_DIRECT = ("count", "sum", "avg", "min_i", "min_d", "min_t")


class Cube:
    """Immutable: inserts and merges give new cubes.

    ``rows`` is what a cube was built from, if it was just built: a rollup of sums and minima then groups the rows by the
    level at once, with one small shuffle instead of the leaf cells' and its own.
    """

    def __init__(self, spec: CubeSpec, cells: DataFrame, rows: DataFrame | None = None):
        self.spec, self.cells, self.rows = spec, cells, rows

    # building

    @staticmethod
    def _first(spec: CubeSpec, a: Aggregate, version: Column) -> list[Column]:
        """The partial state from input rows."""
        c = F.col(f"`{a.columns[0]}`") if a.columns else None
        if a.kind == "count":
            return [(F.count(F.lit(1)) if c is None else F.coalesce(F.sum(c), F.lit(0))).cast("long").alias(a.name)]
        if a.kind == "sum":
            return [F.sum(c).alias(a.name)]
        if a.kind == "avg":
            n = F.sum(F.col(f"`{a.columns[1]}`")) if len(a.columns) == 2 else F.count(c)
            return [F.sum(c).cast("double").alias(a.partials[0]), F.coalesce(n, F.lit(0)).cast("long").alias(a.partials[1])]
        if a.kind in ("min_i", "min_d", "min_t"):
            return [F.min(c).alias(a.name)]
        if a.kind == "string":
            return [F.max(F.when(c.isNotNull(), F.struct(version.alias("version"), c.alias("text")))).alias(a.name)]
        return [loghist.sketch(c).alias(a.name)]  # quantile_sketch

    @staticmethod
    def _again(a: Aggregate, rollup: bool) -> list[Column]:
        """The partial state from partial states."""
        if a.kind in ("count", "sum", "avg"):
            return [F.sum(p).alias(p) for p in a.partials]
        if a.kind in ("min_i", "min_d", "min_t"):
            return [F.min(a.name).alias(a.name)]
        if a.kind == "string":
            if rollup:  # a rollup lists the distinct strings of its cells
                joined = F.array_join(F.array_sort(F.collect_set(F.col(f"{a.name}.text"))), ",")
                return [F.when(F.count(a.name) > 0, F.struct(F.max(F.col(f"{a.name}.version")).alias("version"), joined.alias("text"))).alias(a.name)]
            return [F.max(a.name).alias(a.name)]
        if a.kind == "quantile_histogram":
            return [loghist.merged(a.name, a.size).alias(a.name)]
        return [loghist.sketch_merged(F.col(a.name)).alias(a.name)]

    @classmethod
    def build(cls, spec: CubeSpec, df: DataFrame) -> Cube:
        """The cube of the rows of ``df``."""
        spec.check(df)
        version = F.col(f"`{spec.version}`").cast("long") if spec.version else F.lit(0).cast("long")
        used = {c for a in spec.aggs for c in a.columns}
        rows = df.select(*[d.leaf_value(df).alias(f"__d_{d.name}") for d in spec.dims], *[F.col(f"`{c}`") for c in sorted(used)], version.alias("__version"))
        clash = {d.name: f"__d_{d.name}" for d in spec.dims}
        plain = [a for a in spec.aggs if a.kind not in ("quantile_histogram", "quantile_sample")]
        keys = list(clash.values())
        cells = rows.groupBy(*keys).agg(*[p for a in plain for p in cls._first(spec, a, F.col("__version"))], F.max("__version").alias("version"))
        for a in spec.aggs:
            if a.kind == "quantile_histogram":
                part = loghist.histogram(rows, keys, F.col(f"`{a.columns[0]}`"), a.size, a.name)
            elif a.kind == "quantile_sample":
                part = cls._sampled(rows, keys, F.col(f"`{a.columns[0]}`"), a)
            else:
                continue
            part = part.withColumnsRenamed({k: f"j{k}" for k in keys})
            cells = cells.join(part, _same_keys(keys, [f"j{k}" for k in keys]), "left").drop(*[f"j{k}" for k in keys])
        ordered = [F.col(v).alias(k) for k, v in clash.items()]
        return cls(spec, cells.select(*ordered, *[p for a in spec.aggs for p in a.partials], "version"), df)

    @classmethod
    def _at_levels(cls, spec: CubeSpec, df: DataFrame, levels: Mapping[str, int]) -> DataFrame:
        """Cells at a level vector, straight from the rows."""
        version = F.col(f"`{spec.version}`").cast("long") if spec.version else F.lit(0).cast("long")
        used = sorted({c for a in spec.aggs for c in a.columns})
        kept = [d for d in spec.dims if levels.get(d.name, d.leaf) > 0]
        values = [d.at(levels.get(d.name, d.leaf), d.leaf_value(df)).alias(f"__d_{d.name}") for d in kept]
        rows = df.select(*values, *[F.col(f"`{c}`") for c in used], version.alias("__version"))
        # over no rows at all, every aggregate is null, as it is over no cells
        some = F.count(F.lit(1)) > 0
        names = [p for a in spec.aggs for p in a.partials]
        partials = [p for a in spec.aggs for p in cls._first(spec, a, F.col("__version"))]
        grouped = rows.groupBy(*[f"__d_{d.name}" for d in kept]).agg(*[F.when(some, p).alias(n) for n, p in zip(names, partials)], F.max("__version").alias("version"))
        return grouped.select(*[(F.col(f"__d_{d.name}") if d in kept else d.collapsed).alias(d.name) for d in spec.dims], *names, "version")

    @staticmethod
    def _sampled(rows: DataFrame, keys: Sequence[str], value: Column, a: Aggregate) -> DataFrame:
        """``struct<seen, items>`` per key; an item keeps its hash, so samples merge."""
        identity = F.struct(*[F.col(f"`{c}`") for c in rows.columns], F.monotonically_increasing_id())
        picked = loghist.bottom_k(rows, keys, value, a.size, identity)
        items = picked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("h", "value"))).alias("items"))
        seen = rows.groupBy(*[F.col(k).alias(f"s{k}") for k in keys]).agg(F.count(value).alias("seen"))
        joined = seen.join(items, _same_keys(keys, [f"s{k}" for k in keys]), "left")
        return joined.select(*[F.col(f"s{k}").alias(k) for k in keys], F.struct("seen", "items").alias(a.name))

    @classmethod
    def merge(cls, *cubes: Cube) -> Cube:
        """The union of cubes of one spec: counts add, minima and versions combine, later strings win."""
        same_schema([c.cells for c in cubes])
        cells = cubes[0].cells
        for cube in cubes[1:]:
            cells = cells.unionByName(cube.cells)
        return cls(cubes[0].spec, cls._regrouped(cubes[0].spec, cells, {n: F.col(f"`{n}`") for n in cubes[0].spec.dim_names}, rollup=False))

    @classmethod
    def _regrouped(cls, spec: CubeSpec, cells: DataFrame, dims: Mapping[str, Column], rollup: bool, collapsed: Set[str] = frozenset()) -> DataFrame:
        # under other names first: a collapsed dimension has to hide its leaf column
        named = cells.select(*[c.alias(f"__d_{n}") for n, c in dims.items()], *[p for a in spec.aggs for p in a.partials], "version")
        keys = [f"__d_{n}" for n in dims]
        grouping = [f"__d_{n}" for n in dims if n not in collapsed]
        aggs = [p for a in spec.aggs if a.kind != "quantile_sample" for p in cls._again(a, rollup)]
        out = named.groupBy(*grouping).agg(*aggs, F.max("version").alias("version"))
        out = out.withColumns({f"__d_{n}": dims[n] for n in collapsed}) if collapsed else out
        for a in spec.aggs:
            if a.kind != "quantile_sample":
                continue
            items = named.select(*keys, F.explode(f"{a.name}.items").alias("i")).select(*keys, "i.h", "i.value")
            picked = loghist.smallest(items, keys, a.size).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("h", "value"))).alias("items"))
            seen = named.groupBy(*[F.col(k).alias(f"s{k}") for k in keys]).agg(F.sum(f"{a.name}.seen").alias("seen"))
            part = seen.join(picked, _same_keys(keys, [f"s{k}" for k in keys]), "left").select(*[F.col(f"s{k}").alias(f"j{k}") for k in keys], F.struct("seen", "items").alias(a.name))
            out = out.join(part, _same_keys(keys, [f"j{k}" for k in keys]), "left").drop(*[f"j{k}" for k in keys])
        return out.select(*[F.col(k).alias(k[4:]) for k in keys], *[p for a in spec.aggs for p in a.partials], "version")

    def insert(self, df: DataFrame) -> Cube:
        return Cube.merge(self, Cube.build(self.spec, df))

    def apply_delta(self, old: DataFrame, new: DataFrame) -> Cube:
        """Replace rows: counts, sums and averages take ``new - old``; minima, strings and versions only the new rows.

        Both have the input's columns; summaries cannot retract.
        """
        if any(a.kind.startswith("quantile") for a in self.spec.aggs):
            raise EngineSchemaError("summaries cannot retract")
        minus = Cube.build(self.spec, old).cells
        signed = []
        for a in self.spec.aggs:
            for p in a.partials:
                kind = minus.schema[p].dataType
                signed.append((-F.col(p) if a.kind in ("count", "sum", "avg") else F.lit(None)).cast(kind).alias(p))
        minus = minus.select(*self.spec.dim_names, *signed, F.col("version"))
        return Cube.merge(self, Cube(self.spec, minus), Cube.build(self.spec, new))

    # queries

    def where(self, bounds: Mapping[str, tuple[object, object]]) -> Cube:
        """Leaf cells within inclusive bounds; strings compare byte by byte."""
        cells, rows = self.cells, self.rows
        for name, (low, high) in bounds.items():
            dim = self.spec.dim(name)
            for bound, within in ((low, lambda c: c >= F.lit(low)), (high, lambda c: c <= F.lit(high))):  # noqa: B023
                if bound is not None:
                    cells = cells.where(within(F.col(f"`{name}`")))
                    rows = rows if rows is None else rows.where(within(dim.leaf_value(rows)))
        return Cube(self.spec, cells, rows)

    def rollup(self, levels: Mapping[str, int]) -> Cube:
        """All cells at one vector of levels (dimensions that are not named stay at the leaf).

        Level 0 collapses a dimension to its constant; it is then no grouping column, so that no task groups by it.
        """
        for name in levels:
            self.spec.dim(name)
        if self.rows is not None and all(a.kind in _DIRECT for a in self.spec.aggs):
            return Cube(self.spec, self._at_levels(self.spec, self.rows, levels))
        dims = {d.name: d.at(levels.get(d.name, d.leaf)) for d in self.spec.dims}
        collapsed = {n for n, level in levels.items() if level == 0}
        return Cube(self.spec, self._regrouped(self.spec, self.cells, dims, rollup=True, collapsed=collapsed))

    def finalize(self) -> DataFrame:
        """Dimensions and finished aggregates: averages divided, strings and histograms as they are, ``version`` last."""
        done = []
        for a in self.spec.aggs:
            if a.kind == "avg":
                done.append(F.try_divide(F.col(a.partials[0]), F.col(a.partials[1])).alias(a.name))
            elif a.kind == "string":
                done.append(F.col(f"{a.name}.text").alias(a.name))
            else:
                done.append(F.col(a.name))
        return self.cells.select(*[F.col(f"`{n}`") for n in self.spec.dim_names], *done, "version")

    def _ordered(self, rows: DataFrame, sort: Sequence[str], limit: int) -> DataFrame:
        order = []
        for s in sort:
            name = s.lstrip("-")
            if name not in rows.columns:
                raise EngineSchemaError(f"cannot sort by {name}: no such column")
            order.append(F.col(f"`{name}`").desc_nulls_last() if s.startswith("-") else F.col(f"`{name}`").asc_nulls_first())
        ties = [F.col(f"`{n}`").asc_nulls_first() for n in self.spec.dim_names]
        if order or limit > 0:
            rows = rows.orderBy(*order, *ties)
        return rows.limit(limit) if limit > 0 else rows

    def query(self, q: CubeQuery = CubeQuery()) -> DataFrame:
        """Slice, then roll up, then sort (ties by the dimensions), then limit."""
        cube = self.where(q.bounds)
        if q.levels is not None:
            cube = cube.rollup(q.levels)
        return self._ordered(cube.finalize() if q.final else cube.cells, q.sort, q.limit)

    def cell(self, key: Mapping[str, object], final: bool = True) -> DataFrame:
        """The one cell of a full key; empty if there is none."""
        if set(key) != set(self.spec.dim_names):
            raise EngineSchemaError("a cell's key has every dimension")
        cells = self.cells
        for name, value in key.items():
            cells = cells.where(F.col(f"`{name}`").eqNullSafe(F.lit(value)))
        cube = Cube(self.spec, cells)
        return cube.finalize() if final else cells

    def lookup(self, keys: DataFrame, final: bool = True) -> DataFrame:
        """The cells of many keys (a table with the dimensions' columns); the join strategy is the optimizer's, by size."""
        wanted = keys.select(*[F.col(f"`{n}`").alias(f"__k_{n}") for n in self.spec.dim_names])
        names = self.spec.dim_names
        found = self.cells.join(wanted, _same_keys(names, [f"__k_{n}" for n in names]), "left_semi")
        return Cube(self.spec, found).finalize() if final else found

    def leaf_count(self) -> DataFrame:
        return self.cells.agg(F.count(F.lit(1)).alias("cells"))

    def levels_of(self, *vectors: Mapping[str, int]) -> DataFrame:
        """Several level vectors in one table, each cell with ``<dim>_level`` columns: cells of different grain side by side."""
        out = None
        for levels in vectors:
            cells = self.rollup(levels).cells.withColumns({f"{d.name}_level": F.lit(min(levels.get(d.name, d.leaf), d.leaf)) for d in self.spec.dims})
            out = cells if out is None else out.unionByName(cells)
        return out


def agg_tree(spec: CubeSpec, df: DataFrame, site: str, region: Column | None = None) -> Cube:
    """The union cube by way of local cubes (per site) and regional ones (``region`` is an expression over ``site_key``, the
    site as text): equal to the flat cube, as partial states merge.

    In one cluster the partial and final aggregation of ``Cube.build`` do this already; this form is for sites whose
    partial tables are kept.
    """
    local = CubeSpec(spec.name, [*spec.dims, Dimension("site_key", "string")], spec.aggs, spec.version)
    cells = Cube.build(local, df.withColumn("site_key", F.col(f"`{site}`").cast("string"))).cells
    names = {n: F.col(f"`{n}`") for n in spec.dim_names}
    if region is not None:
        cells = Cube._regrouped(spec, cells, {**names, "region_key": region}, rollup=False)
    return Cube(spec, Cube._regrouped(spec, cells, names, rollup=False))
