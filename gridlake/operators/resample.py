"""Resolution and reference systems (R1-R11): finer cells, resampling, axis reprojection, affine grids."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cells import Cells
from ..functions import crs as crs_functions
from ..functions.reducers import reduce_column
from ..grid import Dim, Grid
from .aggregate import scales


def disaggregate(cells: Cells, scale: Any) -> Cells:
    """Each cell scale times along each axis."""
    df, grid = cells.df, cells.grid
    for name, s in scales_up(grid, scale).items():
        d = grid[name]
        grid = grid.with_dim(d.disaggregate(s))
        if s > 1:
            df = df.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(s)))).withColumn(d.column, ((F.col(d.column) - 1) * s + F.col("_k")).cast("int")).drop("_k")
    return cells.of(df, grid)


def scales_up(grid: Grid, scale: Any) -> dict[str, int]:
    if isinstance(scale, int):
        return {d.name: scale for d in grid.dims if d.labels is None}
    return dict(scale) if isinstance(scale, dict) else {d.name: s for d, s in zip(grid.dims, scale, strict=True)}


def _taps(position: float, n: int, kernel: Callable[[float], float], reach: int) -> list[tuple[int, float]]:
    """Source cells and weights about a position in index space (cell centres are whole)."""
    low = math.floor(position) - reach + 1
    return [(k, w) for k in range(low, low + 2 * reach) if 1 <= k <= n and abs(w := kernel(position - k)) > 1e-12]


def _cubic(t: float) -> float:
    t = abs(t)
    return 1.5 * t**3 - 2.5 * t**2 + 1 if t <= 1 else -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2 if t < 2 else 0.0


def _spline(t: float) -> float:
    t = abs(t)
    return (4 - 6 * t**2 + 3 * t**3) / 6 if t <= 1 else (2 - t) ** 3 / 6 if t < 2 else 0.0


def _lanczos(t: float) -> float:
    return 1.0 if t == 0 else 0.0 if abs(t) >= 3 else 3 * math.sin(math.pi * t) * math.sin(math.pi * t / 3) / (math.pi * t) ** 2


KERNELS = {"bilinear": (lambda t: max(0.0, 1 - abs(t)), 1), "cubic": (_cubic, 2), "cubicspline": (_spline, 2), "lanczos": (_lanczos, 3)}
AREAS = {"average": "mean", "sum": "sum", "min": "min", "max": "max", "med": "median", "q1": "q1", "q3": "q3", "mode": "mode", "rms": "rms"}


def _axis_map(source: Dim, target: Dim, method: str) -> list[tuple[int, int, float]]:
    """(source cell, target cell, weight) for one axis."""
    to_source = crs_functions.axis_transform(target.name, target.crs, source.crs) if source.crs and target.crs and source.crs != target.crs else (lambda v: v)
    edge = lambda v: (v - source.origin) / source.step  # noqa: E731  in cells from the outer edge of cell 1
    if source.sampling != "intervals":
        edge = lambda v: (v - source.coord(1)) / source.step + 0.5
    out = []
    for j in range(1, target.n + 1):
        low, high = target.interval(j)
        if method == "near":
            i = math.floor(edge(to_source((low + high) / 2))) + 1
            out += [(i, j, 1.0)] if 1 <= i <= source.n else []
        elif method in KERNELS:
            kernel, reach = KERNELS[method]
            at = edge(to_source((low + high) / 2)) + 0.5
            if 0.5 <= at <= source.n + 0.5:
                out += [(i, j, float(w)) for i, w in _taps(at, source.n, kernel, reach)]
        else:
            a, b = sorted((edge(to_source(low)), edge(to_source(high))))
            for i in range(max(1, math.floor(a + 1e-9) + 1), min(source.n, math.ceil(b - 1e-9)) + 1):
                out.append((i, j, float(min(b, i) - max(a, i - 1))))
    return out


def resample(cells: Cells, to: Grid | None = None, res: Any = None, size: Any = None, crs: str | None = None, method: str = "near") -> Cells:
    """Cells on another grid. Each axis gives a table of (source, target, weight); cells join both and are summed.

    near takes the cell that holds the target's centre; bilinear, cubic, cubicspline and lanczos weight the cells about
    it, over those that have a value; the rest reduce the cells that the target overlaps.
    """
    if res is not None and size is not None:
        raise ValueError("give either res or size")
    if method != "near" and method not in KERNELS and method not in AREAS:
        raise ValueError(f"no method {method}; there are near, {', '.join([*KERNELS, *AREAS])}")
    if to is None:
        target = crs or cells.grid.crs
        extent = {}
        for name in ("X", "Y"):
            d = cells.grid[name]
            ends = d.extent()
            if target and d.crs and target != d.crs:
                ends = tuple(sorted(map(crs_functions.axis_transform(name, d.crs, target), ends)))
            extent[name] = ends
        if res is None and size is None:
            size = [cells.grid["X"].n, cells.grid["Y"].n]
        to = Grid.from_extent(extent, res, size, crs=target)
        to = Grid(tuple(t.reverse() if cells.grid[t.name].order == "reverse" else t for t in to.dims))
    spark = cells.df.sparkSession
    df = cells.df
    for name in ("X", "Y"):
        c = cells.grid[name].column
        rows = spark.createDataFrame(_axis_map(cells.grid[name], to[name], method), f"{c} int, _to_{c} int, _w_{c} double")
        df = df.join(rows, c)  # an axis table is small: Catalyst broadcasts it
    grid = cells.grid
    for name in ("X", "Y"):
        grid = grid.with_dim(to[name])
    df = df.drop("xi", "yi").withColumnsRenamed({"_to_xi": "xi", "_to_yi": "yi"}).withColumn("_w", F.col("_w_xi") * F.col("_w_yi"))
    if method == "near":
        return cells.of(df, grid)

    def value(x: str) -> Column:
        v, w = F.col(x), F.when(F.col(x).isNotNull(), F.col("_w"))
        if method in KERNELS or method == "average":
            return F.sum(v * w) / F.sum(w)
        if method == "sum":
            return F.sum(v * w)
        if method == "rms":
            return F.sqrt(F.sum(v * v * w) / F.sum(w))
        return reduce_column(AREAS[method], v)

    out = df.groupBy(*grid.columns).agg(*(value(x).alias(x) for x in cells.layers))
    return Cells(out, grid, cells.layers, cells.missingval)


def warp(cells: Cells, flags: dict[str, Any]) -> Cells:
    """Resampling by flags: tr (x, y sizes), ts (x, y counts), te (xmin, ymin, xmax, ymax), r (method), t_srs."""
    unknown = set(flags) - {"tr", "ts", "te", "r", "t_srs"}
    if unknown:
        raise ValueError(f"flags {sorted(unknown)} are not supported")
    to = None
    if "te" in flags:
        x0, y0, x1, y1 = flags["te"]
        to = Grid.from_extent({"X": (x0, x1), "Y": (y0, y1)}, flags.get("tr"), flags.get("ts"), crs=flags.get("t_srs") or cells.grid.crs)
        return resample(cells, to, method=flags.get("r", "near"))
    return resample(cells, None, flags.get("tr"), flags.get("ts"), flags.get("t_srs"), flags.get("r", "near"))


def reproject_dim(d: Dim, target: str) -> Dim:
    """An axis in another system; regular if its steps stay even, else irregular."""
    if not d.crs:
        raise ValueError(f"axis {d.name} has no reference system")
    if d.crs == target:
        return d
    f = crs_functions.axis_transform(d.name, d.crs, target)
    values = [f(v) for v in d.values()]
    steps = [b - a for a, b in zip(values, values[1:], strict=False)]
    if steps and all(math.isclose(s, steps[0], rel_tol=1e-9) for s in steps):
        return replace(d, start=values[0], step=steps[0], coords=None, bounds=None, first=1, crs=target)
    bounds = tuple(tuple(sorted(map(f, d.interval(i)))) for i in range(1, d.n + 1)) if d.sampling == "intervals" else None
    return Dim(d.name, d.n, coords=tuple(values), bounds=bounds, sampling=d.sampling, locus=d.locus, crs=target, mappedcrs=d.mappedcrs)


def reproject(cells: Cells, target: str) -> Cells:
    """Axis coordinates in another system; no cell changes."""
    grid = cells.grid
    for name in ("X", "Y"):
        grid = grid.with_dim(reproject_dim(grid[name], target))
    return replace(cells, grid=grid)


def convert_lookup(d: Dim, mapped: bool) -> Dim:
    """An axis in its mapped system, or back in its own."""
    to = d.mappedcrs if mapped else d.crs
    if not to:
        raise ValueError(f"axis {d.name} has no {'mapped ' if mapped else ''}reference system")
    return reproject_dim(d, to)


def mapped_values(d: Dim) -> list[float]:
    """Coordinates in the mapped system."""
    return convert_lookup(d, True).values()


def mapped_bounds(d: Dim) -> tuple[float, float]:
    """The extent in the mapped system."""
    f = crs_functions.axis_transform(d.name, d.crs, d.mappedcrs)
    return tuple(sorted(map(f, d.extent())))


def projected_values(d: Dim) -> list[float]:
    """Coordinates of a mapped axis in its own system."""
    f = crs_functions.axis_transform(d.name, d.mappedcrs, d.crs)
    return [f(v) for v in d.values()]


@dataclass(frozen=True)
class Affine:
    """A rotated or skewed grid: x = a + b i + c j, y = d + e i + f j, for i and j from 0."""

    a: float
    b: float
    c: float
    d: float
    e: float
    f: float

    @property
    def aligned(self) -> bool:
        return self.c == 0 and self.e == 0

    def columns(self, xi: Column, yi: Column, locus: float = 0.5) -> tuple[Column, Column]:
        """Coordinates of cells."""
        i, j = xi - 1 + locus, yi - 1 + locus
        return self.a + self.b * i + self.c * j, self.d + self.e * i + self.f * j

    def index_columns(self, x: Column, y: Column) -> tuple[Column, Column]:
        """The cell that holds a place; not clipped to the grid."""
        det = self.b * self.f - self.c * self.e
        u, v = x - self.a, y - self.d
        return (F.floor((self.f * u - self.c * v) / det) + 1).cast("int"), (F.floor((self.b * v - self.e * u) / det) + 1).cast("int")

    def bounds(self, nx: int, ny: int) -> dict[str, tuple[float, float]]:
        """The box about the four corners."""
        corners = [(self.a + self.b * i + self.c * j, self.d + self.e * i + self.f * j) for i in (0, nx) for j in (0, ny)]
        return {"X": (min(p[0] for p in corners), max(p[0] for p in corners)), "Y": (min(p[1] for p in corners), max(p[1] for p in corners))}

    def slice(self, xi: int, yi: int) -> Affine:
        """The grid that begins at a cell."""
        return replace(self, a=self.a + self.b * (xi - 1) + self.c * (yi - 1), d=self.d + self.e * (xi - 1) + self.f * (yi - 1))

    def grid(self, nx: int, ny: int, crs: str | None = None) -> Grid:
        """Plain axes, where the grid is aligned."""
        if not self.aligned:
            raise ValueError("a rotated grid has no independent axes")
        return Grid((Dim("X", nx, self.a, self.b, sampling="intervals", locus="start", crs=crs), Dim("Y", ny, self.d, self.f, sampling="intervals", locus="start", crs=crs)))


def affine_select(df: DataFrame, affine: Affine, nx: int, ny: int, x: str = "x", y: str = "y") -> DataFrame:
    """Rows with the cell of their place, null off the grid."""
    xi, yi = affine.index_columns(F.col(x), F.col(y))
    inside = xi.between(1, nx) & yi.between(1, ny)
    return df.withColumn("xi", F.when(inside, xi)).withColumn("yi", F.when(inside, yi))


def fractional_resample(cells: Cells, scale: Any) -> DataFrame:
    """Of each block of cells, the share of each value."""
    df, total = cells.df, 1
    for name, s in scales(cells.grid, scale).items():
        d = cells.grid[name]
        total *= s
        df = df.filter(F.col(d.column) <= d.n // s * s).withColumn(d.column, (F.floor((F.col(d.column) - 1) / s) + 1).cast("int"))
    return df.groupBy(*cells.columns, F.col(cells.layers[0]).alias("class")).agg((F.count("*") / total).alias("share"))
