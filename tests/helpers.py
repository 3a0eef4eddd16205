"""Small rasters of the tests, and cells as arrays."""

import numpy as np

from gridlake.cells import Cells, from_array
from gridlake.grid import Dim, Grid


def array(cells: Cells, layer=None):
    """A dense array, axes in grid order; missing cells are None."""
    layer = layer or cells.layers[0]
    out = np.full([d.n for d in cells.grid.dims], None, dtype=object)
    for r in cells.df.collect():
        out[tuple(r[c] - 1 for c in cells.columns)] = r[layer]
    return out.tolist()


def raster(spark, rows, x=None, y=None, layer="value", **how):
    values = np.array(rows, dtype=object)
    nx, ny = values.shape
    dims = [x or Dim("X", nx, 1.0, 1.0), y or Dim("Y", ny, 1.0, 1.0)]
    return from_array(spark, values, dims, layer, **how)


def square_grid(sampling="intervals"):
    return Grid((Dim("X", 26, -20.0, 1.0, sampling=sampling), Dim("Y", 31, 0.0, 1.0, sampling=sampling)))


SQUARE = [[(-20.0, 30.0), (-20.0, 10.0), (0.0, 10.0), (0.0, 30.0), (-20.0, 30.0)]]
