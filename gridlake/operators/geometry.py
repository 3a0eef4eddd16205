"""Geometry burning (B1-B7, B20-B22): which cells a point, line or polygon covers, as frames of (geom_id, xi, yi).

A geometry frame has ``geom_id``, ``kind`` (point, line, polygon) and ``rings`` (arrays of x, y structs: a polygon's
rings, a line's parts, a point's places). All work is Column expressions in index space, where a cell's centre is its
index; a reversed axis is burned forward and numbered back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..grid import Dim, Grid
from .join import located

RINGS = "array<array<struct<x:double,y:double>>>"


def from_rows(spark: SparkSession, rows: list[tuple[int, str, list[list[tuple[float, float]]]]]) -> DataFrame:
    """Geometries from (geom_id, kind, rings) tuples; for small literals."""
    return spark.createDataFrame([(i, k, [[(float(x), float(y)) for x, y in r] for r in rings]) for i, k, rings in rows], f"geom_id long, kind string, rings {RINGS}")


def from_points(df: DataFrame, x: str = "x", y: str = "y", geom_id: str = "id") -> DataFrame:
    """A table with coordinate columns as point geometries; a missing coordinate makes a missing point."""
    place = F.array(F.array(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))))
    rest = [c for c in df.columns if c not in (x, y, geom_id)]
    return df.select(F.col(geom_id).cast("long").alias("geom_id"), F.lit("point").alias("kind"), F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), place).cast(RINGS).alias("rings"), *rest)


def _forward(d: Dim) -> tuple[float, float]:
    """The lowest cell centre and the size of steps."""
    centres = d.shifted("center") if d.sampling == "intervals" else d
    return min(centres.coord(1), centres.coord(d.n)), abs(d.step)


def _back(d: Dim, i: Column) -> Column:
    return (F.lit(d.n + 1) - i if d.step < 0 else i).cast("int")


def segments(geoms: DataFrame, carry: list[str], closed: bool) -> DataFrame:
    """Edges: geom_id, carry, ring, seg, x1, y1, x2, y2. closed: a ring that ends elsewhere than it began is closed."""
    last = lambda r: F.element_at(r, -1)
    shut = lambda r: F.when(last(r) != F.element_at(r, 1), F.concat(r, F.slice(r, 1, 1))).otherwise(r)
    ring = geoms.filter(F.col("rings").isNotNull()).select("geom_id", *carry, F.posexplode("rings").alias("ring", "r")).filter(F.size("r") > 0)
    ring = ring.withColumn("r", shut(F.col("r"))) if closed else ring
    pairs = F.arrays_zip(F.slice("r", 1, F.size("r") - 1).alias("a"), F.slice("r", 2, F.size("r") - 1).alias("b"))
    seg = ring.filter(F.size("r") > 1).select("geom_id", *carry, "ring", F.posexplode(pairs).alias("seg", "s"))
    return seg.select("geom_id", *carry, "ring", "seg", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))


def spans(geoms: DataFrame, grid: Grid, carry: list[str]) -> DataFrame:
    """Polygons' runs of cells by row, in forward index space: geom_id, carry, iy, x_low, x_high.

    An edge crosses row iy iff y_low < iy <= y_high; a cell is inside iff an odd number of crossings is at or before it.
    Rows are clipped to the grid before they are made.
    """
    x, y = grid["X"], grid["Y"]
    (x0, sx), (y0, sy) = _forward(x), _forward(y)
    u = lambda c: (F.col(c) - F.lit(x0)) / F.lit(sx) + 1
    v = lambda c: (F.col(c) - F.lit(y0)) / F.lit(sy) + 1
    e = segments(geoms, carry, True).select("geom_id", *carry, u("x1").alias("u1"), v("y1").alias("v1"), u("x2").alias("u2"), v("y2").alias("v2"))
    e = e.filter((F.col("v1") != F.col("v2")) & (F.greatest("v1", "v2") >= 1) & (F.least("v1", "v2") < y.n))
    first, last = F.greatest(F.lit(1), F.floor(F.least("v1", "v2")) + 1), F.least(F.lit(y.n), F.floor(F.greatest("v1", "v2")))
    start = F.when(F.col("v1") < F.col("v2"), F.struct("u1", "v1")).otherwise(F.struct(F.col("u2").alias("u1"), F.col("v2").alias("v1")))
    e = e.withColumn("first", first).withColumn("last", last).filter("first <= last").withColumn("start", start)
    slope = (F.col("u2") - F.col("u1")) / (F.col("v2") - F.col("v1"))
    rows = e.withColumn("slope", slope).select("geom_id", *carry, "start", "slope", F.explode(F.sequence("first", "last")).alias("iy"))
    crossing = F.col("start.u1") + (F.col("iy") - F.col("start.v1")) * F.col("slope")
    order = Window.partitionBy("geom_id", "iy").orderBy("c")
    ranked = rows.select("geom_id", *carry, "iy", crossing.alias("c")).withColumn("k", F.row_number().over(order)).withColumn("next", F.lead("c").over(order))
    low, high = F.greatest(F.lit(1), F.ceil("c")), F.least(F.lit(x.n), F.ceil("next") - 1)
    return ranked.filter("k % 2 = 1 and next is not null").select("geom_id", *carry, F.col("iy").cast("int").alias("iy"), low.cast("int").alias("x_low"), high.cast("int").alias("x_high")).filter("x_low <= x_high")


def burn_polygons(geoms: DataFrame, grid: Grid, carry: list[str]) -> DataFrame:
    """B2: cells whose centre is inside."""
    cells = spans(geoms, grid, carry).withColumn("ix", F.explode(F.sequence("x_low", "x_high")))
    return cells.select("geom_id", *carry, _back(grid["X"], F.col("ix")).alias("xi"), _back(grid["Y"], F.col("iy")).alias("yi"))


def burn_lines(geoms: DataFrame, grid: Grid, carry: list[str], closed: bool = False) -> DataFrame:
    """Cells that a line passes: one for its start and one for each cell edge it crosses; where it crosses both at
    once, y goes first. Segment by segment, in order (columns ring, seg, k)."""
    x, y = grid["X"], grid["Y"]
    (x0, sx), (y0, sy) = _forward(x), _forward(y)
    u = lambda c: (F.col(c) - F.lit(x0 - sx / 2)) / F.lit(sx)
    v = lambda c: (F.col(c) - F.lit(y0 - sy / 2)) / F.lit(sy)
    s = segments(geoms, carry, closed).select("geom_id", *carry, "ring", "seg", u("x1").alias("u1"), v("y1").alias("v1"), u("x2").alias("u2"), v("y2").alias("v2"))
    s = s.filter((F.greatest("u1", "u2") >= 0) & (F.least("u1", "u2") <= x.n) & (F.greatest("v1", "v2") >= 0) & (F.least("v1", "v2") <= y.n))

    # The part of a segment that is on the grid or a cell beside it: from t_in to t_out of its length. What it crosses
    # before is counted, not listed, so a segment makes no more rows than the grid has on its way.
    def reach(a: str, b: str, n: int, least: bool) -> Column:
        a_, d = F.col(a), F.col(b) - F.col(a)
        ends = [(F.lit(-1.0) - a_) / d, (F.lit(n + 1.0) - a_) / d]
        return F.when(d == 0, 0.0 if least else 1.0).otherwise(F.least(*ends) if least else F.greatest(*ends))

    s = s.withColumn("t_in", F.greatest(F.lit(0.0), reach("u1", "u2", x.n, True), reach("v1", "v2", y.n, True)))
    s = s.withColumn("t_out", F.least(F.lit(1.0), reach("u1", "u2", x.n, False), reach("v1", "v2", y.n, False))).filter("t_in <= t_out")

    def crossing(a: str, b: str, k: Column) -> Column:
        a_, b_ = F.col(a), F.col(b)
        lead = F.when(b_ > a_, F.floor(a_) - a_ + 1).otherwise(a_ - F.floor(a_))
        return (lead + k - 1) / F.abs(b_ - a_)

    def before(a: str, b: str, t: str, also: bool) -> Column:
        """How many crossings are before t (also: or at it); the guess is put right by the crossings themselves."""
        a_, b_ = F.col(a), F.col(b)
        all_ = F.abs(F.floor(b_) - F.floor(a_))
        lead = F.when(b_ > a_, F.floor(a_) - a_ + 1).otherwise(a_ - F.floor(a_))
        guess = F.floor(F.col(t) * F.abs(b_ - a_) - lead + 1)
        is_before = lambda k: (crossing(a, b, k) <= F.col(t)) if also else (crossing(a, b, k) < F.col(t))
        k = guess - F.when(~is_before(guess), 1).otherwise(0) + F.when(is_before(guess + 1), 1).otherwise(0)
        return F.when(all_ > 0, F.least(all_, F.greatest(F.lit(0), k))).otherwise(F.lit(0)).cast("long")

    s = s.withColumns({"skip_u": before("u1", "u2", "t_in", False), "skip_v": before("v1", "v2", "t_in", False), "end_u": before("u1", "u2", "t_out", True), "end_v": before("v1", "v2", "t_out", True)})

    def moves(a: str, b: str, skip: str, end: str, is_x: int) -> Column:
        at = lambda k: F.struct(crossing(a, b, k).alias("t"), F.lit(is_x).alias("is_x"))
        return F.when(F.col(end) > F.col(skip), F.transform(F.sequence(F.col(skip) + 1, F.col(end)), at)).otherwise(F.array().cast("array<struct<t:double,is_x:int>>"))

    path = F.array_sort(F.concat(F.array(F.struct(F.lit(-1.0).alias("t"), F.lit(-1).alias("is_x"))), moves("u1", "u2", "skip_u", "end_u", 1), moves("v1", "v2", "skip_v", "end_v", 0)))
    steps = s.select("geom_id", *carry, "ring", "seg", "u1", "v1", "u2", "v2", "skip_u", "skip_v", F.posexplode(path).alias("k", "m"))
    order = Window.partitionBy("geom_id", "ring", "seg").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    side = lambda a, b: F.when(F.col(b) < F.col(a), -1).otherwise(1)
    gone = lambda which: F.sum((F.col("m.is_x") == which).cast("int")).over(order)
    cells = steps.withColumn("i", F.floor("u1") + 1 + side("u1", "u2") * (F.col("skip_u") + gone(1))).withColumn("j", F.floor("v1") + 1 + side("v1", "v2") * (F.col("skip_v") + gone(0)))
    inside = cells.filter(F.col("i").between(1, x.n) & F.col("j").between(1, y.n))
    return inside.select("geom_id", *carry, "ring", "seg", "k", _back(x, F.col("i")).alias("xi"), _back(y, F.col("j")).alias("yi"))


def burn_points(geoms: DataFrame, grid: Grid, carry: list[str], atol: float = 0.0) -> DataFrame:
    """The cell of each point; points off the grid have none."""
    p = geoms.select("geom_id", *carry, F.explode(F.flatten("rings")).alias("p"))
    at = located(located(p, F.col("p.x"), grid["X"], atol), F.col("p.y"), grid["Y"], atol)
    return at.select("geom_id", *carry, "xi", "yi").dropna("any", subset=["xi", "yi"])


def within(geoms: DataFrame, grid: Grid) -> DataFrame:
    """Geometries whose box meets the grid's."""
    e = grid.extent()
    flat = F.flatten("rings")
    side = lambda f, c: f(F.transform(flat, lambda p: p[c]))
    return geoms.filter((side(F.array_max, "x") >= e["X"][0]) & (side(F.array_min, "x") <= e["X"][1]) & (side(F.array_max, "y") >= e["Y"][0]) & (side(F.array_min, "y") <= e["Y"][1]))


def only_points(geoms: DataFrame, grid: Grid) -> DataFrame:
    """On an irregular axis, which only points can be burned on, another kind is an error; on regular ones nothing is."""
    if grid["X"].regular and grid["Y"].regular:
        return geoms
    wrong = F.raise_error(F.lit("lines and polygons need regular axes")).cast("boolean")
    return geoms.filter(F.when(F.col("kind") == "point", F.lit(True)).otherwise(wrong))


def burn(geoms: DataFrame, grid: Grid, carry: list[str] | None = None, boundary: str = "center", shape: str | None = None, kinds: tuple[str, ...] = ("point", "line", "polygon"), atol: float = 0.0) -> DataFrame:
    """The cells of each line and polygon, each once, and of each point: geom_id, carry, xi, yi. On an irregular
    axis only points can be burned.

    shape burns every geometry as that kind. kinds: those that occur, where the caller knows. boundary of polygons:
    center, touches (also the cells of their edges) or inside (without those); with points sampling only center has a
    meaning.
    """
    if boundary not in ("center", "touches", "inside"):
        raise ValueError(f"boundary is {boundary}, not center, touches or inside")
    carry = carry or []
    if shape:
        geoms, kinds = geoms.withColumn("kind", F.lit(shape)), (shape,)
    if not (grid["X"].regular and grid["Y"].regular):
        return burn_points(only_points(geoms, grid), grid, carry, atol)
    parts = []
    for kind in kinds:
        own = geoms.filter(F.col("kind") == kind)
        if kind == "point":
            parts.append(burn_points(own, grid, carry, atol))
        elif kind == "line":
            parts.append(burn_lines(within(own, grid), grid, carry).drop("ring", "seg", "k").dropDuplicates(["geom_id", "xi", "yi"]))
        else:
            own = within(own, grid)
            filled = burn_polygons(own, grid, carry)
            if boundary != "center" and grid["X"].sampling == "intervals":
                edge = burn_lines(own, grid, carry, closed=True).drop("ring", "seg", "k")
                if boundary == "touches":
                    filled = filled.unionByName(edge).dropDuplicates(["geom_id", "xi", "yi"])
                else:
                    filled = filled.join(edge.select("geom_id", "xi", "yi").distinct(), ["geom_id", "xi", "yi"], "left_anti").select(edge.columns)
            parts.append(filled)
    return reduce(lambda a, b: a.unionByName(b), parts)


def missed(geoms: DataFrame, burned: DataFrame) -> DataFrame:
    """Geometries that cover no cell."""
    return geoms.join(burned.select("geom_id").distinct(), "geom_id", "left_anti")
