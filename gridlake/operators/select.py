"""Selection (F1-F17): by index, coordinate, extent or presence. Predicates stay on the raw index columns."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cells import Cells
from ..functions import crs as crs_functions
from ..grid import Between, Dim, Grid, Touches, select_indices


def _keep(column: Column, indices: list[int] | range) -> Column:
    """A predicate for ascending indices: a range where they have no gap."""
    x = list(indices)
    if x and x[-1] - x[0] + 1 == len(x):
        return column == x[0] if len(x) == 1 else column.between(x[0], x[-1])
    return column.isin(x)


def sel(cells: Cells, **selectors: Any) -> Cells:
    """Select along axes by name. An int, or a selector of one cell, drops its axis; the rest are numbered anew."""
    from ..grid import At, Contains, Near

    df, grid = cells.df, cells.grid
    for name, s in selectors.items():
        d = grid[name]
        if d.mappedcrs and d.crs and d.mappedcrs != d.crs and hasattr(s, "mapped"):
            s = s.mapped(crs_functions.axis_transform(d.name, d.mappedcrs, d.crs))  # values come in the mapped system
        found = list(select_indices(d, s))
        if isinstance(s, (int, At, Near, Contains)):
            df = df.filter(F.col(d.column) == found[0])
            grid = grid.without(name, d.coord(found[0]))
            df = df.select(*grid.columns, *cells.layers)
            continue
        if not found:
            raise KeyError(f"axis {name}: nothing selected")
        found.sort()
        df = df.filter(_keep(F.col(d.column), found))
        if found[-1] - found[0] + 1 == len(found):
            grid = grid.with_dim(d.slice(found[0], found[-1]))
            if found[0] > 1:
                df = df.withColumn(d.column, (F.col(d.column) - (found[0] - 1)).cast("int"))
        else:
            # Gaps: the new index is the rank among the chosen ones.
            df = df.withColumn(d.column, F.array_position(F.array(*(F.lit(i) for i in found)), F.col(d.column)).cast("int"))
            values = [d.coord(i) for i in found]
            grid = grid.with_dim(Dim(name, len(found), coords=tuple(values) if d.labels is None else None, labels=tuple(values) if d.labels is not None else None, crs=d.crs, mappedcrs=d.mappedcrs))
    return cells.of(df, grid)


def where(cells: Cells, predicate: Column) -> Cells:
    """Cells for which an expression over coordinate columns (named as the axes) holds; others become absent."""
    return cells.of(cells.coords().filter(predicate))


def _extent_of(to: Any) -> dict[str, tuple]:
    if isinstance(to, Cells):
        return to.grid.extent()
    if isinstance(to, Grid):
        return to.extent()
    if isinstance(to, DataFrame):  # geometries: rings, or x and y
        if "rings" in to.columns:
            to = to.select(F.explode(F.flatten("rings")).alias("p")).select("p.x", "p.y")
        r = to.agg(*(f(c).alias(f"{c}{k}") for c in ("x", "y") for k, f in enumerate((F.min, F.max)))).first()
        return {"X": (r["x0"], r["x1"]), "Y": (r["y0"], r["y1"])}
    return dict(to)


def crop(cells: Cells, to: Any, touches: bool = False) -> Cells:
    """the part inside an extent, or the extent of cells, a grid or geometries."""
    pick = Touches if touches else Between
    return sel(cells, **{name: pick(*e) for name, e in _extent_of(to).items() if name in cells.grid})


def crop_all(parts: list[Cells]) -> list[Cells]:
    """each cropped to the extent that all share."""
    extents = [p.grid.extent() for p in parts]
    common = {n: (max(e[n][0] for e in extents), min(e[n][1] for e in extents)) for n in extents[0] if all(n in e for e in extents)}
    return [crop(p, common) for p in parts]


def trim(cells: Cells, pad: int = 0, dims: tuple[str, ...] = ("X", "Y")) -> Cells:
    """the smallest box with any value in any layer, padded; unchanged where all is missing."""
    some = F.coalesce(*(F.when(F.col(x).isNotNull(), True) for x in cells.layers))
    own = [cells.grid[d] for d in dims]
    found = cells.df.filter(some).agg(*(f(d.column).alias(f"{d.column}{k}") for d in own for k, f in enumerate((F.min, F.max)))).first()
    if found[0] is None:
        return cells
    return sel(cells, **{d.name: slice(max(1, found[f"{d.column}0"] - pad), min(d.n, found[f"{d.column}1"] + pad)) for d in own})


def skipmissing(cells: Cells) -> DataFrame:
    """the first layer's values that are not missing."""
    return cells.df.select(cells.layers[0]).filter(F.col(cells.layers[0]).isNotNull())


def points(cells: Cells, ignore_missing: bool = False, order: tuple[str, ...] = ("X", "Y")) -> DataFrame:
    """each cell's coordinates, null where the first layer is missing unless that is ignored."""
    point = F.struct(*(cells.grid[n].coord_column().alias(n) for n in order))
    present = F.lit(True) if ignore_missing else F.col(cells.layers[0]).isNotNull()
    return cells.dense().df.select(*cells.columns, F.when(present, point).alias("point"))


def lookup(cells: Cells, name: str) -> list:
    """an axis's coordinates."""
    return cells.grid[name].values()


def reverse(cells: Cells, name: str) -> Cells:
    """The axis the other way round."""
    d = cells.grid[name]
    return cells.of(cells.df.withColumn(d.column, (F.lit(d.n + 1) - F.col(d.column)).cast("int")), cells.grid.with_dim(d.reverse()))


def permute(cells: Cells, order: tuple[str, ...]) -> Cells:
    """Axes in another order; cells do not move."""
    return cells.of(cells.df, Grid(tuple(cells.grid[n] for n in order), cells.grid.refdims))


def reorder(cells: Cells, order: str | dict[str, str]) -> Cells:
    """Each named axis (or, for one word, each that has an order) forward or reverse; cells keep their coordinates."""
    wanted = order if isinstance(order, dict) else {d.name: order for d in cells.grid.dims if d.order != "unordered"}
    for name, way in wanted.items():
        has = cells.grid[name].order
        if way not in ("forward", "reverse") or has == "unordered":
            raise ValueError(f"axis {name} is {has} and cannot be put {way}")
        cells = reverse(cells, name) if way != has else cells
    return cells


def rotate(cells: Cells, quarters: int = 1) -> Cells:
    """The first two axes turned to the left by quarters of a turn: one is rotl90, two rot180, three (or -1) rotr90."""
    a, b, *others = (d.name for d in cells.grid.dims)
    turned = quarters % 4
    if turned in (1, 2):
        cells = reverse(cells, b)
    if turned in (2, 3):
        cells = reverse(cells, a)
    return permute(cells, (b, a, *others)) if turned % 2 else cells
