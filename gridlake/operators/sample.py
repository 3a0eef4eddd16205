"""Random cells (M1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cells import Cells
from .join import in_buckets

BLOCKS = 65_536  # of cells, for draws with replacement; their sums are as many rows


def sample(cells: Cells, n: int, seed: int, weights: Column | None = None, skipmissing: bool = False, replace: bool = True, geometry: bool = True, index: bool = False, layers: Sequence[str] | None = None) -> DataFrame:
    """n random cells as rows like extract's. weights is an expression over index columns and layers.

    Without replacement the n greatest keys log(u)/w win, one pass and a top-n. With replacement n uniform numbers meet
    the ranges of the cumulated weights: cells are summed by salted blocks, so that no task orders all of them.
    """
    names = list(layers or cells.layers)
    base = cells.sparse() if skipmissing else cells.dense()
    df = base.df.dropna("any", subset=names) if skipmissing else base.df
    df = df.withColumn("_w", F.lit(1.0) if weights is None else weights.cast("double")).filter("_w > 0")
    # Hashes of the cell, not rand(): the same cells whatever the partitioning.
    uniform = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), *cells.columns), F.lit(1 << 53)) + 0.5) / (1 << 53)
    if not replace:
        got = df.withColumn("_key", F.ln(uniform(0)) / F.col("_w")).orderBy(F.desc("_key"), *cells.columns).limit(n)
    else:
        blocks = BLOCKS
        df = df.withColumn("_b", F.pmod(F.xxhash64(*cells.columns), F.lit(blocks)).cast("int"))
        sums = df.groupBy("_b").agg(F.sum("_w").alias("_s"))  # at most BLOCKS rows
        upto = F.sum("_s").over(Window.orderBy("_b"))
        starts = sums.select("_b", (upto - F.col("_s")).alias("_from"), upto.alias("_to"))
        total = sums.agg(F.sum("_s")).first()[0] or 0.0
        draws = df.sparkSession.range(n).select("id", ((F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 53)) + 0.5) / (1 << 53) * F.lit(float(total))).alias("_u"))
        ranges, bucket = in_buckets(starts, "_from", "_to", 0.0, float(total), blocks)
        placed = draws.withColumn("_at", bucket(F.col("_u"))).join(ranges, F.col("_at") == F.col("_bucket")).filter((F.col("_u") >= F.col("_from")) & (F.col("_u") < F.col("_to"))).drop("_at", "_bucket")
        inside = Window.partitionBy("_b").orderBy(*cells.columns)
        hit = placed.select("_b").distinct()  # only blocks that were drawn are ordered
        ranged = df.join(hit, "_b", "left_semi").withColumn("_hi", F.sum("_w").over(inside)).withColumn("_lo", F.col("_hi") - F.col("_w"))
        got = placed.join(ranged, "_b").filter((F.col("_u") - F.col("_from") >= F.col("_lo")) & (F.col("_u") - F.col("_from") < F.col("_hi")))
    out = []
    if geometry:
        out.append(F.struct(*(cells.grid[d].coord_column().alias(d.lower()) for d in ("X", "Y"))).alias("geometry"))
    if index:
        out.append(F.struct(*cells.columns).alias("index"))
    return got.select(*out, *names)
