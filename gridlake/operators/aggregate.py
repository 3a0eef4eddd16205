"""Block aggregation and reductions."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..cells import Cells
from ..functions.reducers import reduce_column
from ..grid import LOCI, Grid, Selector, select_indices


def scales(grid: Grid, scale: Any) -> dict[str, int]:
    """A5: every form of scale as whole cells for each axis. An int skips categorical and unordered axes."""
    whole = lambda name, s: grid[name].n if s in (":", None, slice(None)) else (max(1, len(list(select_indices(grid[name], s)))) if isinstance(s, Selector) else int(s))
    if isinstance(scale, int):
        out = {d.name: scale for d in grid.dims if d.labels is None and d.order != "unordered"}
        if not out:
            raise ValueError("no axis can be aggregated")
    elif isinstance(scale, dict):
        out = {name: whole(name, s) for name, s in scale.items()}
    else:
        out = {d.name: whole(d.name, s) for d, s in zip(grid.dims, scale, strict=True)}
    if any(s < 1 for s in out.values()):
        raise ValueError("a scale is below 1")
    return {name: min(s, grid[name].n) for name, s in out.items()}


def aggregate(cells: Cells, reducer: str | Callable[[Column], Column], scale: Any, skipmissing: bool = False) -> Cells:
    """A1-A3: reduce blocks of cells; cells beyond the last whole block are dropped.

    Without skipmissing a block with any missing cell (absent ones count) is missing; with it, only a block without any
    value is. Partial aggregates are made before the shuffle.
    """
    by = scales(cells.grid, scale)
    df, grid, block = cells.df.withColumn("_order", F.struct(*cells.columns)), cells.grid, 1
    for name, s in by.items():
        d = cells.grid[name]
        block *= s
        grid = grid.with_dim(d.aggregate(s))
        if s > 1:
            df = df.filter(F.col(d.column) <= d.n // s * s).withColumn(d.column, (F.floor((F.col(d.column) - 1) / s) + 1).cast("int"))
    value = lambda x: reduce_column(reducer, F.col(x), F.col("_order"))
    out = df.groupBy(*grid.columns).agg(*((value(x) if skipmissing else F.when(F.count(x) == block, value(x))).alias(x) for x in cells.layers))
    return Cells(out, grid, cells.layers, cells.missingval)


def aggregate_locus(cells: Cells, locus: str | Sequence[str], scale: Any) -> Cells:
    """A4: of each block the cell at its start, center or end. No shuffle."""
    by = scales(cells.grid, scale)
    loci = dict(zip(by, [locus] * len(by) if isinstance(locus, str) else locus, strict=True))
    df, grid = cells.df, cells.grid
    for name, s in by.items():
        d = cells.grid[name]
        if loci[name] not in LOCI:
            raise ValueError(f"no locus {loci[name]}")
        k = math.ceil((s - 1) / 2) if loci[name] == "center" else 0 if loci[name] == "start" else s - 1
        grid = grid.with_dim(d.aggregate(s, loci[name]))
        df = df.filter((F.col(d.column) <= d.n // s * s) & ((F.col(d.column) - 1) % s == k)).withColumn(d.column, (F.floor((F.col(d.column) - 1) / s) + 1).cast("int"))
    return cells.of(df, grid)


def reduce_dims(cells: Cells, reducer: str | Callable[[Column], Column], dims: Sequence[str], skipmissing: bool = True) -> Cells:
    """Reduce whole axes away."""
    gone = [cells.grid[n] for n in dims]
    grid = cells.grid
    for d in gone:
        grid = grid.without(d.name, ":")
    block, order = math.prod(d.n for d in gone), F.struct(*(d.column for d in gone))
    value = lambda x: reduce_column(reducer, F.col(x), order)
    out = cells.df.groupBy(*grid.columns).agg(*((value(x) if skipmissing else F.when(F.count(x) == block, value(x))).alias(x) for x in cells.layers))
    return Cells(out, grid, cells.layers, cells.missingval)


def weighted_mean(cells: Cells, weight: Column, by: Sequence[str] = ()) -> Any:
    """The mean of each layer weighted by an expression over index columns, over the cells that have a value."""
    out = [(F.sum(F.col(x) * weight) / F.sum(F.when(F.col(x).isNotNull(), weight))).alias(x) for x in cells.layers]
    return cells.df.groupBy(*(cells.grid[n].column for n in by)).agg(*out)
