"""Union grids, extension, slices, concatenation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..cells import Cells
from ..functions.reducers import reduce_column
from ..grid import Dim, Grid
from .join import located


def _moved(cells: Cells, grid: Grid) -> Cells:
    """The same cells numbered on a grid that covers theirs."""
    columns = []
    for d, to in zip(cells.grid.dims, grid.dims, strict=True):
        i = F.col(d.column)
        if to.regular:
            shift = round((d.coord(1) - to.coord(1)) / to.step)
            columns.append((i + shift).cast("int").alias(d.column))
        elif d == to or (d.coords is None and d.labels is None and d.bounds is None):
            columns.append(i)
        else:
            place = {v: k for k, v in enumerate(to.bounds if to.bounds is not None else to.values(), 1)}
            at = [place[v] for v in (d.bounds if d.bounds is not None else d.values())]
            columns.append(F.element_at(F.array(*(F.lit(k) for k in at)), i).alias(d.column))
    return Cells(cells.df.select(*columns, *cells.layers), grid, cells.layers, cells.missingval)


def mosaic(reducer: str | Callable[[Column], Column], regions: Sequence[Cells], missingval: Any = None, dense: bool = True, to: Grid | None = None, atol: float = 0.0) -> Cells:
    """All regions on their union grid; overlapping cells are reduced, missing ones skipped, in region order.

    With a grid to, points take the cell whose coordinate is within atol of theirs, intervals the cell that contains it;
    without one, regular axes of the regions may be atol out of line.
    """
    grid = to or reduce(lambda a, b: a.union(b, atol), (r.grid for r in regions))
    if to is None:
        parts = [_moved(r, grid).df.withColumn("_region", F.lit(k)) for k, r in enumerate(regions)]
    else:
        parts = []
        for k, r in enumerate(regions):
            at = r.coords().drop(*r.columns)
            for d in r.grid.dims:
                at = located(at, F.col(d.name), to[d.name], atol)
            at = at.select(*grid.columns, *r.layers)
            parts.append(at.dropna("any", subset=grid.columns).withColumn("_region", F.lit(k)))
    layers = regions[0].layers
    union = reduce(lambda a, b: a.unionByName(b), parts)
    out = union.groupBy(*grid.columns).agg(*(reduce_column(reducer, F.col(x), F.col("_region")).alias(x) for x in layers))
    made = Cells(out, grid, layers, missingval)
    return made.dense(missingval) if dense else made


def mosaic_by(cells: Cells, region: str, reducer: str | Callable[[Column], Column]) -> Cells:
    """U1 where regions are rows of one frame, told apart by a column: no union of plans, however many regions."""
    out = cells.df.groupBy(*cells.columns).agg(*(reduce_column(reducer, F.col(x), F.col(region)).alias(x) for x in cells.layers))
    return Cells(out, cells.grid, cells.layers, cells.missingval)


def extend(cells: Cells, to: Grid | dict[str, tuple[int, int]], fill: Any = None) -> Cells:
    """A larger grid (or so many cells before and after on each axis); new cells get fill or are missing."""
    if isinstance(to, dict):
        grid = cells.grid
        for name, (before, after) in to.items():
            d = grid[name]
            if not d.regular:
                raise ValueError(f"axis {name} is not regular")
            from dataclasses import replace

            grid = grid.with_dim(replace(d, n=d.n + before + after, first=d.first - before))
    else:
        grid = cells.grid.union(to)
        if any(a.n != b.n for a, b in zip(grid.dims, to.dims, strict=True)):
            raise ValueError("the target does not contain the grid")
    return _moved(cells, grid).dense(fill)


def extend_all(parts: Sequence[Cells], fill: Any = None) -> list[Cells]:
    """Each extended to the grid that covers all."""
    grid = reduce(lambda a, b: a.union(b), (p.grid for p in parts))
    return [_moved(p, grid).dense(fill) for p in parts]


def slice_dims(cells: Cells, dims: Sequence[str]) -> tuple[Cells, list[str]]:
    """A series of slices: the axes become its keys. Cells do not move."""
    keys = [cells.grid[n].column for n in dims]
    rest = Grid(tuple(d for d in cells.grid.dims if d.name not in dims), cells.grid.refdims)
    return Cells(cells.df, rest, (*keys, *cells.layers), cells.missingval), keys


def combine_series(series: Cells, keys: Sequence[str], dims: Sequence[Dim]) -> Cells:
    """The series' keys become axes again."""
    grid = Grid((*series.grid.dims, *dims), series.grid.refdims)
    layers = [x for x in series.layers if x not in keys]
    return Cells(series.df.select(*grid.columns, *layers), grid, tuple(layers), series.missingval)


def cat(parts: Sequence[Cells], dims: str | Sequence[str], fill: Any = None) -> Cells:
    """U8: one after another along an axis; along several, block-diagonal with fill."""
    names = [dims] if isinstance(dims, str) else list(dims)
    frames, grid, at = [], parts[0].grid, dict.fromkeys(names, 0)
    for p in parts:
        frames.append(p.df.select(*((F.col(d.column) + at[d.name]).cast("int").alias(d.column) if d.name in at else F.col(d.column) for d in p.grid.dims), *p.layers))
        for n in names:
            at[n] += p.grid[n].n
    for n in names:
        d = parts[0].grid[n]
        values = [v for p in parts for v in p.grid[n].values()]
        steps = {round(b - a, 9) for a, b in zip(values, values[1:], strict=False)} if d.regular else {0, 1}
        from dataclasses import replace

        grid = grid.with_dim(replace(d, n=at[n]) if len(steps) <= 1 else Dim(n, at[n], labels=tuple(values) if d.labels is not None else None, coords=tuple(values) if d.labels is None else None, sampling=d.sampling))
    out = Cells(reduce(lambda a, b: a.unionByName(b), frames), grid, parts[0].layers, parts[0].missingval)
    return out.dense(fill) if len(names) > 1 and fill is not None else out


def layers_to_band(cells: Cells, layer: str = "value", band: str = "Band") -> Cells:
    """Layers along a new axis."""
    d = Dim(band, len(cells.layers), labels=cells.layers)
    rows = F.explode(F.array(*(F.struct(F.lit(k).cast("int").alias(d.column), F.col(x).alias(layer)) for k, x in enumerate(cells.layers, 1))))
    out = cells.df.select(*cells.columns, rows.alias("_s")).select(*cells.columns, f"_s.{d.column}", f"_s.{layer}")
    return Cells(out, Grid((*cells.grid.dims, d), cells.grid.refdims), (layer,), cells.missingval)
