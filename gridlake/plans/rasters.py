"""Rasters, points and polygons derived from the driver's tables, and the same as SQL.

Values are whole numbers of cents held as doubles, so sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cells import Cells
from ..grid import Dim, Grid
from ..operators.geometry import RINGS

_CENTS = "cast(round({0} * 100) as bigint)"
LI = Grid((Dim("X", 50, 1.0, 1.0, sampling="intervals"), Dim("Y", 11, 0.0, 1.0, sampling="intervals")))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _users(spark: SparkSession, sf_dir: str) -> int:
    return int(read(spark, sf_dir, "events").agg(F.max("user_id")).first()[0]) + 1


def ev_day(spark: SparkSession, sf_dir: str) -> Cells:
    """X: user, Y: day of the month; layers n (events) and v (their value). Some cells are missing."""
    e = read(spark, sf_dir, "events").select((F.col("user_id") + 1).cast("int").alias("xi"), F.dayofmonth("ts").alias("yi"), F.expr(_CENTS.format("value")).alias("c"))
    grid = Grid((Dim("X", _users(spark, sf_dir), 0.0, 1.0, sampling="intervals"), Dim("Y", 30, 1.0, 1.0)))
    return Cells(e.groupBy("xi", "yi").agg(F.count("*").alias("n"), F.sum("c").cast("double").alias("v")), grid, ("n", "v"))


def ev_grid(spark: SparkSession, sf_dir: str) -> Cells:
    """X: user, Y: hour, Ti: day; layers n and v. Most cells are missing."""
    e = read(spark, sf_dir, "events").select(
        (F.col("user_id") + 1).cast("int").alias("xi"), (F.hour("ts") + 1).alias("yi"), F.dayofmonth("ts").alias("ti"), F.expr(_CENTS.format("value")).alias("c")
    )
    grid = Grid((Dim("X", _users(spark, sf_dir), 0.0, 1.0, sampling="intervals"), Dim("Y", 24, 0.0, 1.0), Dim("Ti", 30, 1.0, 1.0)))
    return Cells(e.groupBy("xi", "yi", "ti").agg(F.count("*").alias("n"), F.sum("c").cast("double").alias("v")), grid, ("n", "v"))


def _li(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").cast("int").alias("xi"), (F.round(F.col("l_discount") * 100) + 1).cast("int").alias("yi"), F.expr(_CENTS.format("l_extendedprice")).alias("c"), *more
    )


def li_grid(spark: SparkSession, sf_dir: str) -> Cells:
    """X: quantity, Y: discount in per cent; layers price and n. Dense, or nearly."""
    return Cells(_li(spark, sf_dir).groupBy("xi", "yi").agg(F.sum("c").cast("double").alias("price"), F.count("*").alias("n")), LI, ("price", "n"))


def li_regions(spark: SparkSession, sf_dir: str) -> Cells:
    """li_grid's price for each line number, as regions of a mosaic (column region)."""
    df = _li(spark, sf_dir, "l_linenumber").groupBy(F.col("l_linenumber").alias("region"), "xi", "yi").agg(F.sum("c").cast("double").alias("price"))
    return Cells(df, LI, ("price",))


def geo_pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points id, x, y, val over li_grid; some are off it."""
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), (F.col("l_quantity") + F.round(F.col("l_tax") * 100) / 4).alias("x"), (F.round(F.col("l_discount") * 100) + 0.25).alias("y"),
        F.expr(_CENTS.format("l_extendedprice")).cast("double").alias("val"),
    )


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One quadrilateral for each nation, in li_grid's coordinates."""
    k = F.col("n_nationkey")
    x0, y0 = 1 + (7 * k) % 40, (3 * k) % 8
    at = lambda a, b: F.struct((x0 + a).cast("double").alias("x"), (y0 + b).cast("double").alias("y"))
    ring = F.array(at(0.0, 0.0), at(6.5, 0.75), at(5.25, 3.5), at(-0.5, 2.25))
    return read(spark, sf_dir, "nation").select(k.cast("long").alias("geom_id"), F.lit("polygon").alias("kind"), F.array(ring).cast(RINGS).alias("rings"))


SQL = {
    "users": "users as (select cast(max(user_id) + 1 as int) as nx from events)",
    "ev_day": "ev_day as (select cast(user_id + 1 as int) as xi, cast(extract(day from ts) as int) as yi, count(*) as n, cast(sum(cast(round(value * 100) as bigint)) as double) as v from events group by 1, 2)",
    "ev_dense": "ev_dense as (select cast(a.i as int) as xi, cast(b.i as int) as yi, e.n, e.v from users, range(1, 100000) a(i), range(1, 31) b(i) left join ev_day e on e.xi = a.i and e.yi = b.i where a.i <= nx)",
    "ev_grid": "ev_grid as (select cast(user_id + 1 as int) as xi, cast(extract(hour from ts) + 1 as int) as yi, cast(extract(day from ts) as int) as ti, count(*) as n, cast(sum(cast(round(value * 100) as bigint)) as double) as v from events group by 1, 2, 3)",
    "li_grid": "li_grid as (select cast(l_quantity as int) as xi, cast(round(l_discount * 100) + 1 as int) as yi, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as double) as price, count(*) as n from lineitem group by 1, 2)",
    "li_regions": "li_regions as (select l_linenumber as region, cast(l_quantity as int) as xi, cast(round(l_discount * 100) + 1 as int) as yi, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as double) as price from lineitem group by 1, 2, 3)",
    "li_cells": "li_cells as (select cast(a.i as int) as xi, cast(b.i as int) as yi from range(1, 51) a(i), range(1, 12) b(i))",
    "geo_pts": "geo_pts as (select l_orderkey * 8 + l_linenumber as id, l_quantity + round(l_tax * 100) / 4 as x, round(l_discount * 100) + 0.25 as y, cast(cast(round(l_extendedprice * 100) as bigint) as double) as val from lineitem)",
    "pts": "pts as (select id, val, x, y, case when floor(x - 0.5) + 1 between 1 and 50 and floor(y + 0.5) + 1 between 1 and 11 then cast(floor(x - 0.5) + 1 as int) end as xi, case when floor(x - 0.5) + 1 between 1 and 50 and floor(y + 0.5) + 1 between 1 and 11 then cast(floor(y + 0.5) + 1 as int) end as yi from geo_pts)",
    "edges": "edges as (select cast(k as bigint) as geom_id, cast(x0 + a1 as double) as x1, cast(y0 + b1 + 1 as double) as y1, cast(x0 + a2 as double) as x2, cast(y0 + b2 + 1 as double) as y2 from (select n_nationkey as k, 1 + (7 * n_nationkey) % 40 as x0, (3 * n_nationkey) % 8 as y0 from nation) z, (values (0.0, 0.0, 6.5, 0.75), (6.5, 0.75, 5.25, 3.5), (5.25, 3.5, -0.5, 2.25), (-0.5, 2.25, 0.0, 0.0)) e(a1, b1, a2, b2))",
    "up": "up as (select geom_id, case when y1 < y2 then x1 else x2 end as xs, least(y1, y2) as ys, greatest(y1, y2) as ye, (x2 - x1) / (y2 - y1) as slope from edges)",
    "segs": "segs as (select cast(k as bigint) as geom_id, k * 4 + e as seg, e, x0 + a1 - 0.5 as u1, y0 + b1 + 0.5 as v1, x0 + a2 - 0.5 as u2, y0 + b2 + 0.5 as v2 from (select n_nationkey as k, cast(1 + (7 * n_nationkey) % 40 as double) as x0, cast((3 * n_nationkey) % 8 as double) as y0 from nation) z, (values (0, 0.0, 0.0, 6.5, 0.75), (1, 6.5, 0.75, 5.25, 3.5), (2, 5.25, 3.5, -0.5, 2.25), (3, -0.5, 2.25, 0.0, 0.0)) q(e, a1, b1, a2, b2))",
    "steps": "steps as (select *, cast(-1 as double) as t, -1 as is_x from segs"
    " union all select s.*, ((case when u2 > u1 then floor(u1) - u1 + 1 else u1 - floor(u1) end) + k.i - 1) / abs(u2 - u1), 1 from segs s, range(1, 60) k(i) where k.i <= abs(floor(u2) - floor(u1))"
    " union all select s.*, ((case when v2 > v1 then floor(v1) - v1 + 1 else v1 - floor(v1) end) + k.i - 1) / abs(v2 - v1), 0 from segs s, range(1, 60) k(i) where k.i <= abs(floor(v2) - floor(v1)))",
    "walk": "walk as (select geom_id, e, row_number() over w as k, cast(floor(u1) + 1 + (case when u2 < u1 then -1 else 1 end) * sum(case when is_x = 1 then 1 else 0 end) over w as int) as xi, cast(floor(v1) + 1 + (case when v2 < v1 then -1 else 1 end) * sum(case when is_x = 0 then 1 else 0 end) over w as int) as yi"
    " from steps window w as (partition by seg order by t, is_x rows unbounded preceding))",
    "burned": "burned as (select geom_id, cast(a.i as int) as xi, cast(b.i as int) as yi from up, range(1, 12) b(i), range(1, 51) a(i) where ys < b.i and b.i <= ye and xs + (b.i - ys) * slope <= a.i group by 1, 2, 3 having count(*) % 2 = 1)",
}
