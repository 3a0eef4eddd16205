"""Streaming block aggregation: a file stream of points to cells and time windows.

The reference has no streams; this runs the same cell arithmetic on one, with a watermark for late rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.reducers import reduce_column
from ..grid import Grid


def rollup(stream: DataFrame, grid: Grid, time: str, x: Column, y: Column, value: str, reducer: str = "sum", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Per window and cell the reduction of a value: start, xi, yi, value. Rows off the grid are dropped first."""
    cells = stream.select(F.col(time).alias("_t"), grid["X"].index_column(x).alias("xi"), grid["Y"].index_column(y).alias("yi"), F.col(value).alias("_v"))
    kept = cells.filter(F.col("xi").isNotNull() & F.col("yi").isNotNull()).withWatermark("_t", late)
    out = kept.groupBy(F.window("_t", window).alias("_w"), "xi", "yi").agg(reduce_column(reducer, F.col("_v")).alias("value"))
    return out.select(F.col("_w.start").alias("start"), "xi", "yi", "value")
