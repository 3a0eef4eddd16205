"""Reading and writing cells: single files, stacks, series, and partitioned Parquet with the grid beside it."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cells import Cells, stack
from ..grid import Dim, Grid
from .files import read_file
from .formats import format_of

TILE = 256  # cells along each side of a tile


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _put_text(spark: SparkSession, path: str, text: str) -> None:
    p, files = _hadoop(spark, path)
    out = files.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def _get_text(spark: SparkSession, path: str) -> str:
    p, files = _hadoop(spark, path)
    stream = files.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def read(spark: SparkSession, path: str, raw: bool = False, dropband: bool = True, name: str | None = None, crs: str | None = None, mappedcrs: str | None = None) -> Cells:
    """One file, or a Parquet folder that write() made."""
    if path.rstrip("/").endswith(".parquet") or not os.path.splitext(path.rstrip("/"))[1]:
        cells = read_parquet(spark, path)
    else:
        cells = read_file(spark, format_of(path), path, raw, dropband, name)
    return Cells(cells.df, cells.grid.with_crs(crs, mappedcrs), cells.layers, cells.missingval) if crs or mappedcrs else cells


def read_stack(spark: SparkSession, paths: dict[str, str], resize: Callable[[Cells, Cells], Cells] | None = None) -> Cells:
    """Files as layers by name. resize(cells, first) fits grids that differ."""
    parts = {k: read(spark, p, name=k) for k, p in paths.items()}
    first = next(iter(parts.values()))
    return stack({k: resize(c, first) if resize and c.grid != first.grid else c for k, c in parts.items()})


def read_series(spark: SparkSession, paths: Sequence[str], dim: str = "Ti", separator: str = "_", parse: Callable[[str], Any] = str, duplicate_first: bool = False) -> Cells:
    """Files along a new axis, whose coordinates are the ends of the file names. With duplicate_first all files
    take the first one's header as their grid."""
    stems = [os.path.splitext(os.path.basename(p.rstrip("/")))[0] for p in paths]
    values = [parse(re.split(re.escape(separator), s)[-1]) for s in stems]
    order = sorted(range(len(paths)), key=lambda k: values[k])
    parts = [read(spark, paths[k]) for k in order]
    first = parts[0]
    if not duplicate_first and any(p.grid.size != first.grid.size for p in parts):
        raise ValueError("the files have different grids")
    ordered = tuple(values[k] for k in order)
    numbers = all(isinstance(v, (int, float)) for v in ordered)
    d = Dim(dim, len(parts), coords=ordered if numbers else None, labels=None if numbers else ordered)
    frames = [p.df.select(*first.columns, F.lit(k).alias(d.column), F.col(p.layers[0]).alias(first.layers[0])) for k, p in enumerate(parts, 1)]
    return Cells(reduce(lambda a, b: a.unionByName(b), frames), Grid((*first.grid.dims, d)), first.layers[:1], first.missingval)


def tiled(cells: Cells, tile: int = TILE, partitions: int | None = None) -> DataFrame:
    """Cells dealt to partitions by tile and sorted in it, so that row groups are local in both axes."""
    x, y = (F.floor((F.col(c) - 1) / tile).cast("int") for c in ("xi", "yi"))
    df = cells.df.withColumn("tile_x", x).withColumn("tile_y", y)
    df = df.repartition(partitions, "tile_x", "tile_y") if partitions else df.repartition("tile_x", "tile_y")
    return df.sortWithinPartitions("tile_y", "tile_x", "yi", "xi")


def write(cells: Cells, path: str, force: bool = False, by: Sequence[str] = (), tile: int | None = TILE, **how: Any) -> None:
    """Cells to Parquet (series axes as partition folders) or, by extension, to one file. Existing data stays
    unless force."""
    ext = os.path.splitext(path.rstrip("/"))[1]
    if ext and ext != ".parquet":
        if os.path.exists(path) and not force:
            raise FileExistsError(path)
        form = format_of(path)
        if len(cells.layers) == 1:
            form.write(cells, path, **how)
        else:  # S17: one file a layer where a format has none
            for x in cells.layers:
                form.write(cells, f"{path[: -len(ext)]}_{x}{ext}", x, **how)
        return
    df = (tiled(cells, tile) if tile else cells.df).select(*cells.columns, *cells.layers)
    out = df.write.mode("overwrite" if force else "errorifexists")
    keys = [cells.grid[n].column for n in by]
    (out.partitionBy(*keys) if keys else out).parquet(path)
    _put_text(cells.df.sparkSession, f"{path.rstrip('/')}/_grid.json", cells.grid.to_json())


def read_parquet(spark: SparkSession, path: str) -> Cells:
    """A folder that write() made; filters on index columns and layers are pushed into the scan."""
    grid = Grid.from_json(_get_text(spark, f"{path.rstrip('/')}/_grid.json"))
    df = spark.read.parquet(path)
    layers = [c for c in df.columns if c not in grid.columns]
    return Cells(df.select(*grid.columns, *layers), grid, tuple(layers))
