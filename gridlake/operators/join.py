"""Joins of cell frames (J1-J3, J10, J11): equi-joins on index columns; nearest and interval joins on coordinates."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cells import Cells
from ..grid import Dim


def combine(a: Cells, b: Cells, f: Callable[[Column, Column], Column], layer: str = "value") -> Cells:
    """A cell-wise function of two frames on one grid; cells that either lacks are absent."""
    left = a.df.select(*a.columns, F.col(a.layers[0]).alias("_a"))
    right = b.df.select(*b.columns, F.col(b.layers[0]).alias("_b"))
    return a.of(left.join(right, a.columns).withColumn(layer, f(F.col("_a"), F.col("_b"))), layers=[layer])


def broadcast_dims(a: Cells, b: Cells, f: Callable[[Column, Column], Column], layer: str = "value") -> Cells:
    """The same where b has only some of a's axes: b repeats along the others. Catalyst picks the join by size."""
    shared = [c for c in a.columns if c in b.columns]
    right = b.df.select(*shared, F.col(b.layers[0]).alias("_b"))
    return a.of(a.df.join(right, shared, "left").withColumn(layer, f(F.col(a.layers[0]), F.col("_b"))), layers=[layer])


def quotient(a: Column, b: Column) -> Column:
    """a / b of doubles as arrays and SQL have it: over zero it is infinite, 0 / 0 is NaN. Spark's own / raises there."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / b)  # a power of -1 keeps the sign of a zero


def mask(cells: Cells, by: Cells, invert: bool = False, missingval: Any = None) -> Cells:
    """Values where the first layer of ``by`` has one (or, inverted, has none); elsewhere missingval."""
    shared = [c for c in cells.columns if c in by.columns]
    right = by.df.filter(F.col(by.layers[0]).isNotNull()).select(*shared, F.lit(True).alias("_in"))
    keep = F.col("_in").isNull() if invert else F.col("_in")
    joined = cells.df.join(right, shared, "left")
    return cells.of(joined.select(*cells.columns, *(F.when(keep, F.col(x)).otherwise(F.lit(missingval)).alias(x) for x in cells.layers)))


def axis_table(spark, dim: Dim) -> DataFrame:
    """An irregular axis as rows: index, coord, lo, hi."""
    rows = [(i, float(dim.coord(i)), *map(float, dim.interval(i))) for i in range(1, dim.n + 1)]
    return spark.createDataFrame(rows, f"{dim.column} int, coord double, lo double, hi double")


def in_buckets(ranges: DataFrame, low: str, high: str, first: float, last: float, n: int) -> tuple[DataFrame, Callable[[Column], Column]]:
    """Ranges, which do not overlap, by buckets of a line from first to last (column _bucket), and the bucket of a value.

    A range is in each bucket it meets, so there are at most n rows more than ranges; a join on the bucket finds a value's
    range without comparing it with all.
    """
    size = (last - first) / n or 1.0
    bucket = lambda c: F.when(c.isNotNull(), F.least(F.lit(n), F.greatest(F.lit(-1), F.floor((c - first) / size))).cast("long"))
    return ranges.withColumn("_bucket", F.explode(F.sequence(bucket(F.col(low)), bucket(F.col(high))))), bucket


def interval_join(df: DataFrame, value: str, dim: Dim) -> DataFrame:
    """The cell whose [lo, hi) holds a value, by an equi-join on buckets of the axis; Catalyst picks the join by size."""
    axis = axis_table(df.sparkSession, dim)
    cells, bucket = in_buckets(axis, "lo", "hi", *map(float, dim.extent()), dim.n)
    inside = (F.col(value) >= F.col("lo")) & (F.col(value) < F.col("hi"))
    return df.withColumn("_at", bucket(F.col(value))).join(cells, (F.col("_at") == F.col("_bucket")) & inside, "left").drop("_at", "_bucket", "coord", "lo", "hi")


def located(df: DataFrame, value: Column, dim: Dim, atol: float = 0.0) -> DataFrame:
    """The cell of a coordinate, as the axis's column: the cell that contains it on intervals, the equal point (within
    atol) on points, else null. An irregular axis is joined by buckets, a regular one is arithmetic."""
    if dim.regular:
        return df.withColumn(dim.column, dim.index_column(value, atol))
    at = df.withColumn("_value", value.cast("double"))
    if dim.sampling == "intervals":
        return interval_join(at, "_value", dim).drop("_value")
    found = _nearest(at, "_value", dim)
    near = F.abs(F.col("_value") - F.col("_coord")) <= F.lit(float(atol))
    return found.withColumn(dim.column, F.when(near, F.col(dim.column))).drop("_value", "_coord")


def _nearest(df: DataFrame, value: str, dim: Dim) -> DataFrame:
    """The cell of an irregular axis that is nearest to a value, with its coordinate as _coord. The axis is a table."""
    by_coord = sorted(range(1, dim.n + 1), key=dim.coord)
    x = [float(dim.coord(i)) for i in by_coord]
    mids = [(a + b) / 2 for a, b in zip(x, x[1:], strict=False)]
    # Cells reach from one middle to the next; a value beyond the outer coordinates counts as the nearer of them.
    rows = list(zip(by_coord, x, [x[0], *mids], [*mids, x[-1]], strict=True))
    axis = df.sparkSession.createDataFrame(rows, f"{dim.column} int, _coord double, _lo double, _hi double")
    cells, bucket = in_buckets(axis, "_lo", "_hi", x[0], x[-1], dim.n)
    v, low, high, i = F.col("_near"), F.col("_lo"), F.col("_hi"), F.col(dim.column)
    # A middle is as near to both cells; the lower index has it, which on a falling axis is the greater coordinate.
    if by_coord[0] <= by_coord[-1]:
        inside = ((v > low) & (v <= high)) | ((v == x[0]) & (i == by_coord[0]))
    else:
        inside = ((v >= low) & (v < high)) | ((v == x[-1]) & (i == by_coord[-1]))
    clamped = F.least(F.lit(x[-1]), F.greatest(F.lit(x[0]), F.col(value).cast("double")))
    at = df.drop(dim.column).withColumn("_near", F.when(F.col(value).isNotNull(), clamped)).withColumn("_at", bucket(v))
    return at.join(cells, (F.col("_at") == F.col("_bucket")) & inside, "left").drop("_near", "_at", "_bucket", "_lo", "_hi")


def nearest_join(df: DataFrame, value: str, dim: Dim) -> DataFrame:
    """The cell nearest to a value; of two as near, the lower index. Ends catch all beyond them; null has none. A
    regular axis is arithmetic, another one is joined by buckets of its coordinates."""
    if not dim.regular:
        return _nearest(df, value, dim).drop("_coord")
    x = F.ceil((F.col(value) - F.lit(float(dim.coord(1)))) / F.lit(float(dim.step)) + 0.5)
    return df.withColumn(dim.column, F.when(F.col(value).isNotNull(), F.least(F.lit(dim.n), F.greatest(F.lit(1), x)).cast("int")))


def as_of_join(left: DataFrame, right: DataFrame, key: str, by: list[str], value: str, splits: Sequence[Any] = ()) -> DataFrame:
    """Each left row with the right value at the greatest key that is not above its own, by one sort per group.

    splits are keys at which groups are cut into parts that are sorted apart, so that a large group is many tasks;
    key_splits() gives even ones. A part without an earlier value of its own takes the last one of the parts before it.
    Equal nulls in by are one group. Of right rows with one key any may be taken.
    """
    a = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType))
    b = right.select(*by, key, F.col(value).alias("_v")).withColumn("_side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    cut = F.size(F.filter(F.array(*map(F.lit, splits)), lambda at: at <= F.col(key))) if splits else F.lit(0)
    both = both.withColumn("_part", cut)
    order = Window.partitionBy(*by, "_part").orderBy(key, "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn(value, F.last("_v", ignorenulls=True).over(order)).filter("_side = 1")
    if not splits:
        return found.drop("_side", "_v", "_part")
    # One value a group and part, so a group's list is no longer than splits.
    ends = b.filter("_v is not null").withColumn("_part", cut).groupBy(*by, "_part").agg(F.max_by("_v", F.struct(key)).alias("_v"))
    names = [f"_by{k}" for k in range(len(by))]
    ends = ends.groupBy(*(F.col(c).alias(n) for c, n in zip(by, names, strict=True)), F.lit(0).alias("_all")).agg(F.collect_list(F.struct("_part", "_v")).alias("_ends"))
    same = reduce(lambda p, q: p & q, (F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names, strict=True)), F.col("_zero") == F.col("_all"))
    joined = found.withColumn("_zero", F.lit(0)).join(ends, same, "left")
    earlier = F.array_max(F.filter("_ends", lambda e: e["_part"] < F.col("_part")))["_v"]
    return joined.withColumn(value, F.coalesce(value, earlier)).drop("_side", "_v", "_part", "_zero", "_all", "_ends", *names)


def key_splits(df: DataFrame, key: str, n: int) -> list:
    """Keys that cut a frame of numbers into n parts of about the same number of rows."""
    found = df.agg(F.percentile_approx(key, [k / n for k in range(1, n)], 100 * n)).first()[0]
    return sorted(set(found or []))
