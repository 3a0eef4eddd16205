"""Cell frames: a DataFrame with one row per cell, integer index columns and one column per layer, and its grid.

Frames are sparse: a cell may be absent, which means the same as null. ``dense()`` gives every cell a row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .grid import Dim, Grid


@dataclass(frozen=True)
class Cells:
    df: DataFrame
    grid: Grid
    layers: tuple[str, ...]
    missingval: Any = None  # written back for nulls by sinks; inside the engine missing is null
    layer_dims: dict[str, tuple[str, ...]] | None = None  # of layers that lack some axes

    @property
    def columns(self) -> list[str]:
        return self.grid.columns

    def of(self, df: DataFrame, grid: Grid | None = None, layers: Sequence[str] | None = None) -> Cells:
        grid, layers = grid or self.grid, tuple(layers if layers is not None else self.layers)
        return replace(self, df=df.select(*grid.columns, *layers), grid=grid, layers=layers)

    def map(self, f: Callable[[Column], Column]) -> Cells:
        """The same expression on every layer."""
        return self.of(self.df.select(*self.columns, *(f(F.col(x)).alias(x) for x in self.layers)))

    def with_layer(self, name: str, value: Column) -> Cells:
        return self.of(self.df.withColumn(name, value), layers=[*self.layers, name] if name not in self.layers else self.layers)

    def __getitem__(self, names: str | Sequence[str]) -> Cells:
        """layers by name."""
        return self.of(self.df, layers=[names] if isinstance(names, str) else list(names))

    def coords(self) -> DataFrame:
        """The frame with a coordinate column, named as the axis, for each axis."""
        return self.df.select(*self.columns, *(d.coord_column().alias(d.name) for d in self.grid.dims), *self.layers)

    def dense(self, fill: Any = None) -> Cells:
        """Every cell as a row; absent cells are null, or fill."""
        full = grid_frame(self.df.sparkSession, self.grid).join(self.df, self.columns, "left")
        return self.of(full if fill is None else full.select(*self.columns, *(F.coalesce(F.col(x), F.lit(fill)).alias(x) for x in self.layers)))

    def sparse(self) -> Cells:
        """Only cells with a value in some layer."""
        return self.of(self.df.dropna("all", subset=list(self.layers)))

    def cache(self) -> Cells:
        """Materialise for reuse."""
        return replace(self, df=self.df.persist())

    def renamed(self, names: dict[str, str]) -> Cells:
        """Rename layers."""
        return replace(self, df=self.df.withColumnsRenamed(names), layers=tuple(names.get(x, x) for x in self.layers))


def grid_frame(spark: SparkSession, grid: Grid, partitions: int | None = None) -> DataFrame:
    """S3: one row for each cell of a grid, made in the executors."""
    rows = spark.range(0, grid.size, 1, partitions) if partitions else spark.range(grid.size)
    below, columns = 1, []
    for d in grid.dims:
        columns.append((F.pmod(F.floor(F.col("id") / below) if below > 1 else F.col("id"), F.lit(d.n)) + 1).cast("int").alias(d.column))
        below *= d.n
    return rows.select(*columns)


def allocate(spark: SparkSession, grid: Grid, layers: dict[str, str], fill: Any = None) -> Cells:
    """Cells of given SQL types, all null or fill."""
    df = grid_frame(spark, grid)
    return Cells(df.select(*grid.columns, *(F.lit(fill).cast(t).alias(x) for x, t in layers.items())), grid, tuple(layers))


def create(spark: SparkSession, template: Grid | Cells, layers: dict[str, str], fill: Any = None, f: Callable[[Cells], Cells] | None = None) -> Cells:
    """Cells on a template's grid; f may set them before they are used."""
    made = allocate(spark, template.grid if isinstance(template, Cells) else template, layers, fill)
    return f(made) if f else made


def from_array(spark: SparkSession, array: np.ndarray, dims: Sequence[Dim], layer: str = "value", missingval: Any = None) -> Cells:
    """From a dense array whose axes are the dims in order. For arrays that fit the driver; missing cells are left out."""
    array = np.asarray(array, dtype=object if array.dtype == object else None)
    if array.shape != tuple(d.n for d in dims):
        raise ValueError(f"the array is {array.shape}, the axes are {tuple(d.n for d in dims)}")
    rows = [(*(int(i) + 1 for i in at), None if _missing(v, missingval) else (v.item() if hasattr(v, "item") else v)) for at, v in np.ndenumerate(array)]
    kind = {"b": "boolean", "i": "long", "u": "long", "f": "double", "U": "string"}.get(array.dtype.kind, None) or _kind([r[-1] for r in rows])
    grid = Grid(tuple(dims))
    schema = ", ".join(f"{c} int" for c in grid.columns) + f", {layer} {kind}"
    return Cells(spark.createDataFrame(rows, schema), grid, (layer,), missingval)


def from_vector(spark: SparkSession, values: Sequence, dims: Sequence[Dim], layer: str = "value", missingval: Any = None) -> Cells:
    """From a vector in which the first axis runs fastest."""
    return from_array(spark, np.array(values, dtype=object).reshape([d.n for d in dims], order="F"), dims, layer, missingval)


def from_table(df: DataFrame, grid: Grid, layers: Sequence[str], atol: float = 0.0) -> Cells:
    """From rows with coordinate columns named as the axes; rows off the grid are dropped."""
    indexed = df.select(*(grid[d.name].index_column(F.col(d.name), atol).alias(d.column) for d in grid.dims), *layers)
    return Cells(indexed.dropna("any", subset=grid.columns), grid, tuple(layers))


def band_layers(cells: Cells, names: Sequence[str], band: str = "Band") -> Cells:
    """A Band axis as one layer for each band; at most 200."""
    if len(names) > 200:
        raise ValueError("more than 200 layers")
    d, layer = cells.grid[band], cells.layers[0]
    rest = [c for c in cells.columns if c != d.column]
    wide = cells.df.groupBy(*rest).agg(*(F.max(F.when(F.col(d.column) == i, F.col(layer))).alias(x) for i, x in enumerate(names, 1)))
    return Cells(wide, cells.grid.without(band), tuple(names), cells.missingval)


def stack(parts: dict[str, Cells]) -> Cells:
    """Single-layer frames as the layers of one; layers that lack axes of the largest grid repeat along them."""
    largest = max(parts.values(), key=lambda c: len(c.grid.dims))
    ordered = sorted(parts.items(), key=lambda kv: -len(kv[1].grid.dims))
    df = None
    for name, c in ordered:
        own = c.df.select(*c.columns, F.col(c.layers[0]).alias(name))
        df = own if df is None else df.join(own, c.columns, "full" if set(c.columns) == set(largest.columns) else "left")
    dims = {name: tuple(d.name for d in c.grid.dims) for name, c in parts.items() if len(c.grid.dims) < len(largest.grid.dims)}
    return Cells(df.select(*largest.columns, *parts), largest.grid, tuple(parts), layer_dims=dims or None)


def _missing(v: Any, missingval: Any) -> bool:
    return v is None or (missingval is not None and (v == missingval or (v != v and missingval != missingval)))


def _kind(values: list) -> str:
    got = {type(v) for v in values if v is not None}
    return "boolean" if got == {bool} else "long" if got == {int} else "string" if got == {str} else "double"
