"""Cell areas (V14-V18). Areas of longitude-latitude cells depend on the row only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cells import Cells, grid_frame
from ..functions import crs as crs_functions
from ..grid import Grid
from .resample import reproject_dim

RADIUS = 6371008.8  # metres


def _intervals(grid: Grid) -> None:
    if any(grid[n].sampling != "intervals" for n in ("X", "Y")):
        raise ValueError("points have no area; the axes need intervals")


def planar(spark: SparkSession, grid: Grid) -> Cells:
    """Width times height."""
    _intervals(grid)
    (x1, x2), (y1, y2) = grid["X"].bounds_columns(), grid["Y"].bounds_columns()
    return _cells(spark, grid, (x2 - x1) * (y2 - y1))


def lonlat_area(x1: Column, x2: Column, y1: Column, y2: Column, radius: float = RADIUS) -> Column:
    """Area of cells between meridians and parallels, in degrees, on a sphere."""
    return F.abs((x2 - x1) / 360 * (2 * math.pi * radius * radius) * (F.sin(F.radians(y2)) - F.sin(F.radians(y1))))


def spherical(spark: SparkSession, grid: Grid, radius: float = RADIUS) -> Cells:
    """On a sphere: by formula for degrees, through the mapped system if that is degrees, else by corners."""
    _intervals(grid)
    x, y = grid["X"], grid["Y"]
    if not grid.crs:
        raise ValueError("the grid has no reference system")
    if grid.crs not in crs_functions.DEGREES and grid.mappedcrs in crs_functions.DEGREES:
        x, y = (reproject_dim(d, grid.mappedcrs) for d in (x, y))
    (x1, x2), (y1, y2) = x.bounds_columns(), y.bounds_columns()
    if x.crs in crs_functions.DEGREES:
        return _cells(spark, grid, lonlat_area(x1, x2, y1, y2, radius))
    lon, lat = (crs_functions.axis_transform(n, x.crs, "EPSG:4326") for n in ("X", "Y"))
    a, b, c, d = ((lon(i), lat(j)) for i, j in ((x1, y1), (x2, y1), (x2, y2), (x1, y2)))
    return _cells(spark, grid, (_triangle(a, b, c) + _triangle(c, d, a)) * (radius * radius))


def cellsize(spark: SparkSession, grid: Grid) -> Cells:
    """Square kilometres."""
    return spherical(spark, grid, RADIUS / 1000)


def _triangle(*corners: tuple[Column, Column]) -> Column:
    """The area of a triangle on the unit sphere from its corners' longitudes and latitudes (Eriksson's formula)."""

    def point(p: tuple[Column, Column]) -> list[Column]:
        lon, lat = F.radians(p[0]), F.radians(p[1])
        return [F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)]

    a, b, c = map(point, corners)
    less = lambda p, q: [i - j for i, j in zip(p, q, strict=True)]
    plus = lambda p, q: [i + j for i, j in zip(p, q, strict=True)]
    dot = lambda p, q: sum(i * j for i, j in zip(p, q, strict=True))
    u, v = less(b, a), less(c, a)
    cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    return 2 * F.atan(F.abs(dot(a, cross) / dot(plus(b, a), plus(c, a))))


def _cells(spark: SparkSession, grid: Grid, area: Column) -> Cells:
    flat = Grid((grid["X"], grid["Y"]))
    return Cells(grid_frame(spark, flat).withColumn("area", area), flat, ("area",))


def with_area(cells: Cells, radius: float = RADIUS) -> DataFrame:
    """Cells with their area as a column, computed in place: nothing is joined."""
    (x1, x2), (y1, y2) = cells.grid["X"].bounds_columns(), cells.grid["Y"].bounds_columns()
    return cells.df.withColumn("area", lonlat_area(x1, x2, y1, y2, radius))
