"""Raster files as Spark data sources: a common reader of row strips and a writer of whole files.

A format gives a header (axes, bands, type, sentinel) and the values of a strip of rows. Each strip is one Spark
partition; strips are read by range where the format has fixed places.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..cells import Cells
from ..grid import Dim, Grid
from ..operators.values import scaled

STRIP_CELLS = 1_000_000
#: numpy kinds to SQL types; unsigned ones widen.
SQL_TYPES = {"b1": "boolean", "i1": "tinyint", "i2": "smallint", "i4": "int", "i8": "bigint", "u1": "smallint", "u2": "int", "u4": "bigint", "u8": "decimal(20,0)", "f4": "float", "f8": "double"}


def open_file(uri: str):
    """A random-access file of a path or URI."""
    files, path = fs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri.removeprefix("file:")))
    return files.open_input_file(path)


def read_range(uri: str, offset: int, length: int) -> bytes:
    with open_file(uri) as f:
        return f.read_at(length, offset)


def read_text(uri: str) -> str:
    with open_file(uri) as f:
        return f.read().decode()


@dataclass
class Header:
    nx: int
    ny: int
    bands: int
    kind: np.dtype
    x: tuple[float, float]  # coordinate of the first column's lower bound, and step
    y: tuple[float, float]  # the same of the first row; the step is mostly negative
    missing: float | None = None
    layer: str = "value"
    crs: str | None = None
    more: dict = field(default_factory=dict)

    def grid(self, dropband: bool = True) -> Grid:
        (x0, sx), (y0, sy) = self.x, self.y
        dims = [Dim("X", self.nx, x0, sx, sampling="intervals", locus="start", crs=self.crs), Dim("Y", self.ny, y0, sy, sampling="intervals", locus="start", crs=self.crs)]
        return Grid((*dims, *([] if dropband and self.bands == 1 else [Dim("Band", self.bands)])))

    def schema(self) -> str:
        return f"xi int, yi int, band int, `{self.layer}` {SQL_TYPES[self.kind.str[1:]]}"


class Format:
    """One file format."""

    name = ""
    extensions: tuple[str, ...] = ()

    @staticmethod
    def header(path: str) -> Header:
        raise NotImplementedError

    @staticmethod
    def rows(path: str, h: Header, band: int, low: int, high: int) -> np.ndarray:
        """Values of rows low..high-1 (from 0) of a band, as (rows, columns)."""
        raise NotImplementedError


@dataclass
class Strip(InputPartition):
    band: int
    low: int
    high: int


def source_class(form: type[Format]) -> type[DataSource]:
    """The Spark data source of a format. Options: path, raw (keep the sentinel)."""

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.path, self.raw = options["path"], options.get("raw", "false") == "true"
            self.head = form.header(self.path)

        def partitions(self) -> list[Strip]:
            step = max(1, STRIP_CELLS // self.head.nx)
            block = self.head.more.get("rows", 1)
            step = max(step - step % block, 1)  # whole blocks, where a strip holds any
            return [Strip(b, k, min(self.head.ny, k + step)) for b in range(self.head.bands) for k in range(0, self.head.ny, step)]

        def read(self, partition: Strip) -> Iterator[pa.RecordBatch]:
            h = self.head
            v = form.rows(self.path, h, partition.band, partition.low, partition.high)
            y, x = np.divmod(np.arange(v.size, dtype=np.int64), h.nx)
            flat = v.ravel()
            gone = np.zeros(flat.size, bool)
            if h.missing is not None and not self.raw:
                gone = np.isnan(flat) if h.missing != h.missing else flat == h.kind.type(h.missing)
            kind = {"boolean": pa.bool_(), "tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "decimal(20,0)": pa.decimal128(20, 0)}[SQL_TYPES[h.kind.str[1:]]]
            values = pa.array(flat.astype(h.kind.newbyteorder("=")), mask=gone).cast(kind)
            yield pa.record_batch([pa.array((x + 1).astype(np.int32)), pa.array((y + partition.low + 1).astype(np.int32)), pa.array(np.full(flat.size, partition.band + 1, np.int32)), values], names=["xi", "yi", "band", h.layer])

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return form.name

        def schema(self) -> str:
            return form.header(self.options["path"]).schema()

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

    return Source


def read_file(spark: SparkSession, form: type[Format], path: str, raw: bool = False, dropband: bool = True, name: str | None = None) -> Cells:
    """One file as cells; missing cells are null rows unless raw."""
    spark.dataSource.register(source_class(form))
    h = form.header(path)
    df: DataFrame = spark.read.format(form.name).option("path", path).option("raw", str(raw).lower()).load()
    grid = h.grid(dropband)
    layer = name or h.layer
    df = scaled(df.withColumnRenamed(h.layer, layer), layer, h.more.get("scale", 1.0), h.more.get("offset", 0.0), raw=raw)
    return Cells(df.select(*grid.columns, layer), grid, (layer,), h.missing)


def dense_array(cells: Cells, layer: str, kind: np.dtype, missing: float) -> np.ndarray:
    """A layer as a (Y, X) or (Band, Y, X) array on the driver, for formats of one file; parts arrive one at a time."""
    shape = [d.n for d in reversed(cells.grid.dims)]
    out = np.full(shape, missing, kind)
    for batch in cells[layer].sparse().df.toLocalIterator(prefetchPartitions=True):
        out[tuple(batch[c] - 1 for c in reversed(cells.columns))] = batch[layer]
    return out
