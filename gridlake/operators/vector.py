"""Raster and vector together: rasterize, boolmask, mask, zonal, extract, coverage."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cells import Cells
from ..functions.reducers import REDUCERS, fold, reduce_column
from ..grid import Dim, Grid
from . import geometry
from .join import located
from .join import mask as mask_by
from .select import crop


def boolmask(geoms: DataFrame, grid: Grid, collapse: bool = True, invert: bool = False, dense: bool = True, **how: Any) -> Cells:
    """True where any geometry covers the cell; without collapse for each geometry on a ``geometry`` axis, whose
    labels are the geometries' ids in order. dense=False gives the cells that are covered alone, as a dense mask has as
    many rows as cells times geometries."""
    if invert and not dense:
        raise ValueError("cells that no geometry covers are listed by a dense mask only")
    burned = geometry.burn(geoms, grid, **how)
    if collapse:
        hit = Cells(burned.select("xi", "yi").distinct().withColumn("mask", F.lit(True)), grid, ("mask",))
    else:
        ids = [r[0] for r in geoms.select("geom_id").distinct().orderBy("geom_id").collect()]  # the result's axis
        number = geoms.sparkSession.createDataFrame(list(enumerate(ids, 1)), f"geometry int, geom_id {dict(geoms.dtypes)['geom_id']}")
        on = Grid((*grid.dims, Dim("geometry", len(ids), labels=tuple(ids))))
        hit = Cells(burned.join(number, "geom_id").select("xi", "yi", "geometry", F.lit(True).alias("mask")).distinct(), on, ("mask",))
    return hit.dense().map(lambda v: v.isNull() if invert else v.isNotNull()) if dense else hit


def mask(cells: Cells, geoms: DataFrame, invert: bool = False, missingval: Any = None, **how: Any) -> Cells:
    """Values in cells that a geometry covers (or, inverted, does not); others are missing."""
    flat = Grid((cells.grid["X"], cells.grid["Y"]))
    hit = geometry.burn(geoms, flat, **how).select("xi", "yi").distinct().withColumn("hit", F.lit(True))
    return mask_by(cells, Cells(hit, flat, ("hit",)), invert, missingval)


def rasterize(
    reducer: str | Callable[[Column], Column], geoms: DataFrame, grid: Grid, fill: Any = 1, order: str = "geom_id", op: Callable[[Column, Column], Column] | None = None, init: Any = None, onto: Cells | None = None, dense: bool = True, missingval: Any = None, **how: Any,
) -> Cells:
    """Each cell's reduction of the fill of the geometries that cover it.

    fill: a literal, a column name, or a dict of layer to either (a stack). op and init fold the fills in order instead.
    onto: existing cells, whose values come before the geometries' (B15); along further axes they repeat (B16).
    """
    fills = fill if isinstance(fill, dict) else {"value": fill}
    expr = lambda f: F.col(f) if isinstance(f, str) and f in geoms.columns else f if isinstance(f, Column) else F.lit(f)
    source = geoms.withColumns({f"_f_{k}": expr(f) for k, f in fills.items()} | {"_ord": F.col(order)})
    carry = [f"_f_{k}" for k in fills] + ["_ord"]
    burned = geometry.burn(source, Grid((grid["X"], grid["Y"])), carry, **how)
    if onto is not None:
        extra = [c for c in onto.columns if c not in ("xi", "yi")]
        if extra:
            burned = _repeat(burned, onto, extra)
        old = onto.df.select(*onto.columns, *(F.col(x).alias(f"_f_{k}") for x, k in zip(onto.layers, fills, strict=True)))
        burned = burned.select(*onto.columns, *carry).unionByName(old.withColumn("_ord", F.lit(None).cast(dict(burned.dtypes)["_ord"])))
        grid = onto.grid
    order_column = F.struct(F.col("_ord").isNotNull(), F.col("_ord"))
    reduced = lambda c: fold(c, order_column, op, F.lit(init)) if op is not None else reduce_column(reducer, c, order_column)
    out = burned.groupBy(*grid.columns).agg(*(reduced(F.col(f"_f_{k}")).alias(k) for k in fills))
    made = Cells(out, grid, tuple(fills), missingval)
    empty = REDUCERS[reducer].empty if isinstance(reducer, str) and reducer in REDUCERS else None
    return made.dense(empty if missingval is None else missingval) if dense else made


def _repeat(burned: DataFrame, onto: Cells, extra: list[str]) -> DataFrame:
    """Burned cells along all of the other axes."""
    for d in onto.grid.dims:
        if d.column in extra:
            burned = burned.withColumn(d.column, F.explode(F.sequence(F.lit(1), F.lit(d.n))))
    return burned


def zonal(
    reducer: str | Callable[[Column], Column], cells: Cells, geoms: DataFrame, emptyval: Any = None, skipmissing: bool = True, **how: Any,
) -> DataFrame:
    """Each geometry's reduction of the cells it covers, one column a layer; all geometries have a row.

    A geometry without a cell that has a value gives emptyval; one whose box is off the grid gives null.
    """
    flat = Grid((cells.grid["X"], cells.grid["Y"]))
    burned = geometry.burn(geoms, flat, **how)
    order = F.struct(*cells.columns)
    values = [reduce_column(reducer, F.col(x), order) if skipmissing else F.when(F.count(x) == F.count(F.lit(1)), reduce_column(reducer, F.col(x), order)) for x in cells.layers]
    found = burned.join(cells.df, ["xi", "yi"], "inner" if skipmissing else "left").groupBy("geom_id").agg(*(v.alias(x) for v, x in zip(values, cells.layers, strict=True)))
    everyone = geoms.select("geom_id")
    if emptyval is not None:
        found = everyone.join(geometry.within(geoms, flat).select("geom_id", F.lit(True).alias("_in")), "geom_id", "left").join(found, "geom_id", "left")
        return found.select("geom_id", *(F.when(F.col("_in"), F.coalesce(F.col(x), F.lit(emptyval))).alias(x) for x in cells.layers))
    return everyone.join(found, "geom_id", "left").select("geom_id", *cells.layers)


def zonal_apply(f: Callable, cells: Cells, geoms: DataFrame, schema: str, **how: Any) -> DataFrame:
    """A10: f gets each geometry's cells, with their coordinates, as a pandas frame. A geometry's cells come together."""
    flat = Grid((cells.grid["X"], cells.grid["Y"]))
    return geometry.burn(geoms, flat, **how).join(cells.coords(), ["xi", "yi"], "left").groupBy("geom_id").applyInPandas(f, schema)


def zonal_extent(reducer: str | Callable[[Column], Column], cells: Cells, of: Any) -> DataFrame:
    """The reduction of each layer over an extent, grid or cells; cropping is all there is to do."""
    part = crop(cells, of, touches=True)
    return part.df.agg(*(reduce_column(reducer, F.col(x), F.struct(*part.columns)).alias(x) for x in cells.layers))


def extract(
    cells: Cells, geoms: DataFrame, skipmissing: bool = False, geometry_column: bool = True, index: bool = False, flatten: bool = True, layers: Sequence[str] | None = None, atol: float = 0.0, **how: Any,
) -> DataFrame:
    """Rows of values under geometries: id, geometry (a point or the cell's centre), index, layers.

    Points without a cell stay with nulls unless skipmissing, which drops rows where any layer is missing. Lines give
    the cells on their way, a cell that follows itself once; polygons the cells they cover. flatten=False gives each
    geometry's rows as one array.
    """
    names = list(layers or cells.layers)
    flat = Grid((cells.grid["X"], cells.grid["Y"]))
    x, y = flat["X"], flat["Y"]
    extra = [c for c in cells.columns if c not in ("xi", "yi")]
    p = geometry.only_points(geoms, flat).filter("kind = 'point'").select("geom_id", F.posexplode_outer(F.flatten("rings")).alias("_k", "_p"))
    p = located(located(p, F.col("_p.x"), x, atol), F.col("_p.y"), y, atol).select("geom_id", F.struct(F.coalesce("_k", F.lit(0)).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c")).alias("_o"), "_p", "xi", "yi")
    found = p
    if x.regular and y.regular:
        line = geometry.burn_lines(geometry.within(geoms.filter("kind = 'line'"), flat), flat, [])
        before = Window.partitionBy("geom_id").orderBy("ring", "seg", "k")
        line = line.withColumn("_same", (F.lag("xi").over(before) == F.col("xi")) & (F.lag("yi").over(before) == F.col("yi"))).filter("_same is null or not _same")
        centre = F.struct(x.coord_column().cast("double").alias("x"), y.coord_column().cast("double").alias("y"))
        line = line.select("geom_id", F.struct(F.col("ring").alias("a"), F.col("seg").alias("b"), F.col("k").alias("c")).alias("_o"), centre.alias("_p"), "xi", "yi")
        area = geometry.burn(geoms, flat, kinds=("polygon",), **how)
        area = area.select("geom_id", F.struct(F.col("yi").alias("a"), F.col("xi").alias("b"), F.lit(0).alias("c")).alias("_o"), centre.alias("_p"), "xi", "yi")
        found = p.unionByName(line).unionByName(area)
    joined = found.join(cells.df, ["xi", "yi"], "inner" if skipmissing else "left")
    if skipmissing:
        joined = joined.dropna("any", subset=names)
    out = [F.col("geom_id").alias("id")]
    if geometry_column:
        out.append(F.col("_p").alias("geometry"))
    if index:
        out.append(F.when(F.col("xi").isNotNull(), F.struct("xi", "yi")).alias("index"))
    rows = joined.select(*out, "_o", *extra, *names)
    if flatten:
        return rows.drop("_o")
    kept = [c for c in rows.columns if c not in ("id", "_o")]
    return rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", *extra, *(c for c in kept if c not in extra)))), lambda s: F.struct(*(s[c].alias(c) for c in kept))).alias("rows"))


def coverage(geoms: DataFrame, grid: Grid, mode: str = "union", scale: int = 10, dense: bool = True) -> Cells:
    """The covered share of each cell. Cells whose centre is inside and that no edge passes count as whole; only
    cells on an edge are cut into scale x scale, and the runs of fine rows are counted, not their cells."""
    if mode not in ("union", "sum"):
        raise ValueError(f"mode is {mode}, not union or sum")
    flat = Grid((replace(grid["X"].shifted("center"), sampling="intervals"), replace(grid["Y"].shifted("center"), sampling="intervals")))
    x, y = flat["X"], flat["Y"]
    near = geometry.within(geoms.filter("kind = 'polygon'"), flat)
    key = ["geom_id", "xi", "yi"]
    edge = geometry.burn_lines(near, flat, [], closed=True).select(key).distinct()
    whole = geometry.burn_polygons(near, flat, []).join(edge, key, "left_anti").select(key)
    fine = Grid((x.disaggregate(scale), y.disaggregate(scale)))
    runs = geometry.spans(near, fine, [])
    # An edge cell's fine columns and rows, forward as the runs are.
    fx = (F.lit(x.n) - F.col("xi") if x.step < 0 else F.col("xi") - 1) * scale
    fy = (F.lit(y.n) - F.col("yi") if y.step < 0 else F.col("yi") - 1) * scale
    rows = edge.withColumn("fx", fx).withColumn("iy", F.explode(F.sequence((fy + 1).cast("int"), (fy + scale).cast("int"))))
    parts = rows.join(runs, ["geom_id", "iy"]).withColumn("low", F.greatest(F.col("x_low"), F.col("fx") + 1)).withColumn("high", F.least(F.col("x_high"), F.col("fx") + scale)).filter("low <= high")
    if mode == "sum":
        share = parts.groupBy("xi", "yi").agg((F.sum(F.col("high") - F.col("low") + 1) / (scale * scale)).alias("coverage"))
        both = share.unionByName(whole.groupBy("xi", "yi").agg(F.count("*").cast("double").alias("coverage")))
        out = both.groupBy("xi", "yi").agg(F.sum("coverage").alias("coverage"))
    else:
        sub = parts.select("xi", "yi", "iy", F.explode(F.sequence("low", "high")).alias("ix")).distinct()
        share = sub.groupBy("xi", "yi").agg((F.count("*") / (scale * scale)).alias("coverage"))
        both = share.unionByName(whole.select("xi", "yi").distinct().withColumn("coverage", F.lit(1.0)))
        out = both.groupBy("xi", "yi").agg(F.max("coverage").alias("coverage"))
    made = Cells(out, grid if len(grid.dims) == 2 else Grid((grid["X"], grid["Y"])), ("coverage",))
    return made.dense(0.0) if dense else made
