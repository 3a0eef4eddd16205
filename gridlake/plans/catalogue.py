"""The registered queries of the raster operators, each with its DuckDB twin where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cells import Cells, allocate, band_layers, from_table, stack
from ..grid import At, Between, Contains, Dim, Grid, Near, Not, Touches, Where
from ..operators import aggregate as ag
from ..operators import area, geometry, join, resample, select, setops, values, vector
from ..operators.sample import sample
from . import rasters as R

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def _with(*names: str) -> str:
    return "with " + ", ".join(R.SQL[n] for n in names) + " "


def _add(name: str, query: Query, sql: str | None = None, *needs: str) -> None:
    _queries[name] = query
    if sql is not None:
        _oracles[name] = (_with(*needs) if needs else "") + sql


def _on(raster: Callable, f: Callable[[Cells], Cells | DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = f(raster(spark, sf_dir))
        return out.df if isinstance(out, Cells) else out

    return run


day, grid3, li = R.ev_day, R.ev_grid, R.li_grid
DAY = ("ev_day",)
DENSE = ("users", "ev_day", "ev_dense")

# Selection, F1-F17.
_add("select_index", _on(day, lambda c: select.sel(c, X=slice(3, 12), Y=5)), "select cast(xi - 2 as int) as xi, n, v from ev_day where xi between 3 and 12 and yi = 5", *DAY)
_add("select_at", _on(day, lambda c: select.sel(c, Y=At(7.0))), "select xi, n, v from ev_day where yi = 7", *DAY)
_add("select_near", _on(day, lambda c: select.sel(c, Y=Near(11.5))), "select xi, n, v from ev_day where yi = (select i from range(1, 31) r(i) order by abs(i - 11.5), i limit 1)", *DAY)
_add("select_contains", _on(day, lambda c: select.sel(c, X=Contains(12.4))), "select yi, n, v from ev_day where xi = 13", *DAY)
_add("select_between", _on(day, lambda c: select.sel(c, X=Between(9.5, 30.0), Y=Between(3, 9))), "select cast(xi - 10 as int) as xi, cast(yi - 2 as int) as yi, n, v from ev_day where xi - 1.5 >= 9.5 and xi - 0.5 <= 30.0 and yi between 3 and 9", *DAY)
_add("select_touches", _on(day, lambda c: select.sel(c, X=Touches(9.6, 30.2))), "select cast(xi - 10 as int) as xi, yi, n, v from ev_day where xi - 0.5 >= 9.6 and xi - 1.5 <= 30.2", *DAY)
_add("select_where", _on(day, lambda c: select.sel(c, Y=Where(lambda v: v % 7 == 0))), "select xi, cast(yi / 7 as int) as yi, n, v from ev_day where yi % 7 = 0", *DAY)
_add("select_where_columns", _on(day, lambda c: select.where(c, (F.col("X") + F.col("Y")) % 5 == 0)), "select xi, yi, n, v from ev_day where (xi - 1 + yi) % 5 = 0", *DAY)
_add("select_not", _on(day, lambda c: select.sel(c, Y=Not(Between(4, 27)))), "select xi, cast(case when yi > 3 then yi - 24 else yi end as int) as yi, n, v from ev_day where yi < 4 or yi > 27", *DAY)
_add("select_many", _on(day, lambda c: select.sel(c, Y=[At(2.0), At(9.0), At(16.0)])), "select xi, cast((yi + 5) / 7 as int) as yi, n, v from ev_day where yi in (2, 9, 16)", *DAY)
_add("select_layer", _on(day, lambda c: c["n"]), "select xi, yi, n from ev_day", *DAY)
_add("select_coords", _on(day, lambda c: c.coords()), 'select xi, yi, cast(xi - 1 as double) as "X", cast(yi as double) as "Y", n, v from ev_day', *DAY)
_add("crop_extent", _on(day, lambda c: select.crop(c, {"X": (9.5, 60.5), "Y": (5, 20)})), "select cast(xi - 10 as int) as xi, cast(yi - 4 as int) as yi, n, v from ev_day where xi between 11 and 61 and yi between 5 and 20", *DAY)
_add("crop_touches", _on(day, lambda c: select.crop(c, {"X": (9.7, 60.2)}, touches=True)), "select cast(xi - 10 as int) as xi, yi, n, v from ev_day where xi between 11 and 61", *DAY)
_add("crop_intersection", _on(day, lambda c: select.crop_all([select.sel(c, X=slice(1, 12), Y=slice(5, 30)), select.sel(c, X=slice(4, 15), Y=slice(1, 25))])[0]), "select cast(xi - 3 as int) as xi, cast(yi - 4 as int) as yi, n, v from ev_day where xi between 4 and 12 and yi between 5 and 25", *DAY)
_add(
    "trim_pad1", _on(day, lambda c: select.trim(c.of(c.df.filter("n >= 4 and xi > 20 and yi between 6 and 20")), pad=1)),
    ", f as (select * from ev_day where n >= 4 and xi > 20 and yi between 6 and 20), b as (select greatest(1, min(xi) - 1) as x0, greatest(1, min(yi) - 1) as y0 from f) select cast(xi - x0 + 1 as int) as xi, cast(yi - y0 + 1 as int) as yi, n, v from f, b", *DAY,
)
_add("skipmissing_count", _on(day, lambda c: select.skipmissing(c.dense()).agg(F.count("*").alias("cells"))), "select count(*) as cells from ev_dense where n is not null", *DENSE)
_add("points_valid", _on(day, lambda c: select.points(c).select("xi", "yi", F.col("point.X").alias("x"), F.col("point.Y").alias("y"))), "select xi, yi, case when n is not null then cast(xi - 1 as double) end as x, case when n is not null then cast(yi as double) end as y from ev_dense", *DENSE)
_add("reverse_axis", _on(day, lambda c: select.reverse(c, "Y")), "select xi, cast(31 - yi as int) as yi, n, v from ev_day", *DAY)
_add("rotate_half", _on(day, lambda c: select.rotate(c, 2)), "select cast((select max(user_id) + 2 from events) - xi as int) as xi, cast(31 - yi as int) as yi, n, v from ev_day", *DAY)
_add("rotate_left", _on(day, lambda c: select.rotate(c)), "select xi, cast(31 - yi as int) as yi, n, v from ev_day", *DAY)
_add("reorder_axes", _on(day, lambda c: select.reorder(c, {"X": "reverse", "Y": "forward"})), "select cast((select max(user_id) + 2 from events) - xi as int) as xi, yi, n, v from ev_day", *DAY)
_add("lookup_axis", _on(day, lambda c: c.df.sparkSession.createDataFrame(list(enumerate(select.lookup(c, "Y"), 1)), "i int, coord double")), "select cast(i as int) as i, cast(i as double) as coord from range(1, 31) r(i)")
_add("extent_of", _on(li, lambda c: c.df.sparkSession.createDataFrame([(*c.grid.extent()["X"], *c.grid.extent()["Y"])], "x0 double, x1 double, y0 double, y1 double")), "select cast(0.5 as double) as x0, cast(50.5 as double) as x1, cast(-0.5 as double) as y0, cast(10.5 as double) as y1")

# Values, V1-V13, and masks.
_add("densify", _on(day, lambda c: c.dense()), "select xi, yi, n, v from ev_dense", *DENSE)
_add("replace_missing", _on(day, lambda c: values.replace_missing(c["v"], -1.0)), "select xi, yi, coalesce(v, -1.0) as v from ev_dense", *DENSE)
_add("boolmask", _on(day, lambda c: values.boolmask(c, alllayers=False)), "select xi, yi, n is not null as mask from ev_dense", *DENSE)
_add("boolmask_inverted", _on(day, lambda c: values.boolmask(c, invert=True)), "select xi, yi, n is null as mask from ev_dense", *DENSE)
_add("boolmask_alllayers", _on(day, lambda c: values.boolmask(c.with_layer("w", F.when(F.col("n") > 1, F.col("v"))))), "select xi, yi, coalesce(n > 1, false) as mask from ev_dense", *DENSE)
_add("missingmask", _on(day, lambda c: values.missingmask(c)), "select xi, yi, case when n is not null then true end as mask from ev_dense", *DENSE)
_add("cellwise", _on(day, lambda c: c.map(lambda x: x * 2 + 1)), "select xi, yi, n * 2 + 1 as n, v * 2 + 1 as v from ev_day", *DAY)
_add("classify_ranges", _on(li, lambda c: values.classify(c["n"], [((0, 50), 1), ((50, 100), 2), (lambda x: x >= 150, 9)])), "select xi, yi, cast(case when n < 50 then 1 when n < 100 then 2 when n >= 150 then 9 else n end as bigint) as n from li_grid", "li_grid")
_add("classify_matrix", _on(li, lambda c: values.classify(c["n"].map(lambda x: x.cast("double")), [(0, 60, 1.0), (60, 110, 2.0), (110, 1e9, 3.0)])), "select xi, yi, cast(case when n < 60 then 1 when n < 110 then 2 else 3 end as double) as n from li_grid", "li_grid")
_add("classify_others", _on(li, lambda c: values.classify(c["n"], [((90, 110), 1)], lower=lambda v, x: v > x, upper=lambda v, x: v <= x, others=0)), "select xi, yi, cast(case when n > 90 and n <= 110 then 1 else 0 end as int) as n from li_grid", "li_grid")
_add("rasters_equal", _on(li, lambda c: c.df.sparkSession.createDataFrame([(values.same(c, c.dense()),)], "equal boolean")), "select true as equal")
_add("cell_join", _on(day, lambda c: join.combine(c["n"], c["v"], lambda a, b: b / a, "mean")), "select xi, yi, v / n as mean from ev_day", *DAY)
_add("broadcast_dims", _on(grid3, lambda c: join.broadcast_dims(c["v"], ag.reduce_dims(c["v"], "max", ["Ti"]), join.quotient, "share")), ", m as (select xi, yi, max(v) as m from ev_grid group by 1, 2) select e.xi, e.yi, e.ti, e.v / m.m as share from ev_grid e join m using (xi, yi)", "ev_grid")
_add("mask_raster", _on(day, lambda c: join.mask(c, c.of(c.df.filter("n >= 3")))), "select xi, yi, case when n >= 3 then n end as n, case when n >= 3 then v end as v from ev_day", *DAY)
_add("mask_raster_inverted", _on(day, lambda c: join.mask(c, c.of(c.df.filter("n >= 3")), invert=True, missingval=0)), "select xi, yi, case when n < 3 then n else 0 end as n, case when n < 3 then v else 0 end as v from ev_day", *DAY)
_add("mask_broadcast_dims", lambda s, d: join.mask(grid3(s, d), Cells(day(s, d).df.filter("n >= 4").select("xi", F.lit(1).alias("m")).distinct(), Grid((Dim("X", 1),)), ("m",))).df, "select xi, yi, ti, case when k then n end as n, case when k then v end as v from ev_grid left join (select distinct xi, true as k from ev_day where n >= 4) m using (xi)", "ev_day", "ev_grid")
_HOURS = Dim("Y", 4, bounds=((0.0, 6.0), (6.0, 9.0), (9.0, 18.0), (18.0, 24.0)), sampling="intervals")
_add(
    "interval_join", lambda s, d: join.interval_join(R.read(s, d, "events").select("event_id", (F.hour("ts") + F.minute("ts") / 60).alias("h")), "h", _HOURS).groupBy("yi").agg(F.count("*").alias("n")),
    "select cast(case when h < 6 then 1 when h < 9 then 2 when h < 18 then 3 else 4 end as int) as yi, count(*) as n from (select extract(hour from ts) + extract(minute from ts) / 60 as h from events) e group by 1",
)
_add("nearest_join", lambda s, d: join.nearest_join(R.read(s, d, "events").select("event_id", F.col("value")), "value", Dim("X", 3, coords=(10.0, 100.0, 400.0))), "select event_id, value, cast(case when value <= 55 then 1 when value <= 250 then 2 else 3 end as int) as xi from events")
_add(
    "as_of_join", lambda s, d: join.as_of_join(day(s, d)["n"].df.select("xi", F.col("yi").alias("t")), day(s, d).df.filter("n >= 3").select("xi", F.col("yi").alias("t"), F.col("n").alias("last")), "t", ["xi"], "last"),
    "select e.xi, e.yi as t, (select arg_max(f.n, f.yi) from ev_day f where f.xi = e.xi and f.yi <= e.yi and f.n >= 3) as last from ev_day e", *DAY,
)

# Aggregation, A1-A6, A11-A13.
_BLOCK = "select cast((xi - 1) // {sx} + 1 as int) as xi, cast((yi - 1) // {sy} + 1 as int) as yi, {what} from ev_day, users where xi <= nx // {sx} * {sx} and yi <= 30 // {sy} * {sy} group by 1, 2"
_add("agg_sum_skip", _on(day, lambda c: ag.aggregate(c, "sum", 2, skipmissing=True)), _BLOCK.format(sx=2, sy=2, what="cast(sum(n) as bigint) as n, sum(v) as v"), "users", "ev_day")
_add("agg_sum_noskip", _on(day, lambda c: ag.aggregate(c, "sum", (2, 3))), _BLOCK.format(sx=2, sy=3, what="case when count(*) = 6 then cast(sum(n) as bigint) end as n, case when count(*) = 6 then sum(v) end as v"), "users", "ev_day")
_add("agg_mean", _on(day, lambda c: ag.aggregate(c["v"], "mean", 4, skipmissing=True)), _BLOCK.format(sx=4, sy=4, what="avg(v) as v"), "users", "ev_day")
_add("agg_count", _on(day, lambda c: ag.aggregate(c["n"], "count", 7, skipmissing=True)), _BLOCK.format(sx=7, sy=7, what="count(*) as n"), "users", "ev_day")
_add("agg_median", _on(day, lambda c: ag.aggregate(c["v"], "median", 3, skipmissing=True)), _BLOCK.format(sx=3, sy=3, what="median(v) as v"), "users", "ev_day")
_add("agg_min_max", _on(day, lambda c: ag.aggregate(c["v"], "min", 5, skipmissing=True).df.join(ag.aggregate(c.renamed({"v": "w"})["w"], "max", 5, skipmissing=True).df, ["xi", "yi"])), _BLOCK.format(sx=5, sy=5, what="min(v) as v, max(v) as w"), "users", "ev_day")
_add("agg_first_last", _on(day, lambda c: ag.aggregate(c["v"], "first", 5, skipmissing=True).df.join(ag.aggregate(c.renamed({"v": "w"})["w"], "last", 5, skipmissing=True).df, ["xi", "yi"])), _BLOCK.format(sx=5, sy=5, what="arg_min(v, xi * 100 + yi) as v, arg_max(v, xi * 100 + yi) as w"), "users", "ev_day")
_add("agg_std", _on(day, lambda c: ag.aggregate(c["v"], "std", 10, skipmissing=True).map(lambda x: F.round(x, 4))), _BLOCK.format(sx=10, sy=10, what="round(stddev_samp(v), 4) as v"), "users", "ev_day")
_add("agg_custom", _on(day, lambda c: ag.aggregate(c["v"], lambda x: F.max(x) - F.min(x), 6, skipmissing=True)), _BLOCK.format(sx=6, sy=6, what="max(v) - min(v) as v"), "users", "ev_day")
_add("agg_colon_dim", _on(day, lambda c: ag.aggregate(c, "sum", {"X": 10, "Y": ":"}, skipmissing=True)), _BLOCK.format(sx=10, sy=30, what="cast(sum(n) as bigint) as n, sum(v) as v"), "users", "ev_day")
for _locus, _k in (("start", 0), ("center", 1), ("end", 2)):
    _add(f"agg_locus_{_locus}", _on(day, lambda c, locus=_locus: ag.aggregate_locus(c, locus, 3)), f"select cast((xi - 1) // 3 + 1 as int) as xi, cast((yi - 1) // 3 + 1 as int) as yi, n, v from ev_day, users where xi <= nx // 3 * 3 and (xi - 1) % 3 = {_k} and (yi - 1) % 3 = {_k}", "users", "ev_day")
_add("agg_locus_mixed", _on(day, lambda c: ag.aggregate_locus(c, ("end", "start"), 3)), "select cast((xi - 1) // 3 + 1 as int) as xi, cast((yi - 1) // 3 + 1 as int) as yi, n, v from ev_day, users where xi <= nx // 3 * 3 and (xi - 1) % 3 = 2 and (yi - 1) % 3 = 0", "users", "ev_day")
_add("reduce_dim_mean", _on(grid3, lambda c: ag.reduce_dims(c["v"], "mean", ["Ti"])), "select xi, yi, avg(v) as v from ev_grid group by 1, 2", "ev_grid")
_add("reduce_dims_sum", _on(grid3, lambda c: ag.reduce_dims(c, "sum", ["Y", "Ti"])), "select xi, cast(sum(n) as bigint) as n, sum(v) as v from ev_grid group by 1", "ev_grid")
_add("reduce_noskip", _on(day, lambda c: ag.reduce_dims(c["v"], "sum", ["X"], skipmissing=False)), "select yi, case when count(*) = max(nx) then sum(v) end as v from ev_day, users group by 1", "users", "ev_day")
_add("weighted_mean", _on(li, lambda c: ag.weighted_mean(c["price"], F.col("xi").cast("double"), ["Y"]).select("yi", F.round("price", 4).alias("price"))), "select yi, round(sum(price * xi) / sum(cast(xi as double)), 4) as price from li_grid group by 1", "li_grid")

# Resolution and reference systems.
_add("disaggregate_2x3", _on(li, lambda c: resample.disaggregate(c, (2, 3))), "select cast((xi - 1) * 2 + a.i as int) as xi, cast((yi - 1) * 3 + b.i as int) as yi, price, n from li_grid, range(1, 3) a(i), range(1, 4) b(i)", "li_grid")
_FINE = Grid((Dim("X", 25, 1.5, 2.0, sampling="intervals"), Dim("Y", 22, -0.25, 0.5, sampling="intervals")))
_HALF = Grid((Dim("X", 20, 2.0, 2.5, sampling="intervals"), Dim("Y", 4, 1.0, 2.5, sampling="intervals")))
_add("resample_near", _on(li, lambda c: resample.resample(c, _FINE)), "select cast(a.i as int) as xi, cast(b.i as int) as yi, price, n from range(1, 26) a(i), range(1, 23) b(i), li_grid l where l.xi = floor(1.5 + (a.i - 1) * 2.0 - 0.5) + 1 and l.yi = floor(-0.25 + (b.i - 1) * 0.5 + 0.5) + 1", "li_grid")
_WEIGHTS = "wx as (select j.i as j, k.i as k, 1 - abs(1.5 + (j.i - 1) * 2.0 - k.i) as w from range(1, 26) j(i), range(1, 51) k(i) where abs(1.5 + (j.i - 1) * 2.0 - k.i) < 1), wy as (select j.i as j, k.i as k, 1 - abs(-0.25 + (j.i - 1) * 0.5 - (k.i - 1)) as w from range(1, 23) j(i), range(1, 12) k(i) where abs(-0.25 + (j.i - 1) * 0.5 - (k.i - 1)) < 1)"
_add("resample_bilinear", _on(li, lambda c: resample.resample(c["price"], _FINE, method="bilinear").map(lambda x: F.round(x, 3))), f", {_WEIGHTS} select cast(wx.j as int) as xi, cast(wy.j as int) as yi, round(sum(price * (wx.w * wy.w)) / sum(wx.w * wy.w), 3) as price from li_grid l join wx on wx.k = l.xi join wy on wy.k = l.yi group by 1, 2", "li_grid")
_OVER = "ox as (select j.i as j, k.i as k, least(2.0 + (j.i - 1) * 2.5 + 1.25, k.i + 0.5) - greatest(2.0 + (j.i - 1) * 2.5 - 1.25, k.i - 0.5) as w from range(1, 21) j(i), range(1, 51) k(i)), oy as (select j.i as j, k.i as k, least(1.0 + (j.i - 1) * 2.5 + 1.25, k.i - 0.5) - greatest(1.0 + (j.i - 1) * 2.5 - 1.25, k.i - 1.5) as w from range(1, 5) j(i), range(1, 12) k(i))"
_FROM = "from li_grid l join ox on ox.k = l.xi and ox.w > 0 join oy on oy.k = l.yi and oy.w > 0 group by 1, 2"
for _m, _s in (("average", "round(sum(price * (ox.w * oy.w)) / sum(ox.w * oy.w), 3)"), ("sum", "round(sum(price * (ox.w * oy.w)), 3)"), ("min", "min(price)"), ("max", "max(price)"), ("med", "median(price)"), ("q1", "quantile_cont(price, 0.25)"), ("q3", "quantile_cont(price, 0.75)"), ("rms", "round(sqrt(sum(price * price * (ox.w * oy.w)) / sum(ox.w * oy.w)), 2)")):
    _r = {"average": 3, "sum": 3, "rms": 2}.get(_m)
    _add(f"resample_{_m}", _on(li, lambda c, m=_m, r=_r: resample.resample(c["price"], _HALF, method=m).map(lambda x: F.round(x, r) if r else x)), f", {_OVER} select cast(ox.j as int) as xi, cast(oy.j as int) as yi, {_s} as price {_FROM}", "li_grid")
_add("resample_mode", _on(li, lambda c: resample.resample(c["n"].map(lambda x: (x / 20).cast("int")), _HALF, method="mode")), f", {_OVER}, counted as (select ox.j as x, oy.j as y, cast(trunc(n / 20) as int) as v, count(*) as c {_FROM.replace('group by 1, 2', 'group by 1, 2, 3')}), ranked as (select *, row_number() over (partition by x, y order by c desc, v) as r from counted) select cast(x as int) as xi, cast(y as int) as yi, v as n from ranked where r = 1", "li_grid")
_KERNELS = {
    "cubic": "case when t <= 1 then 1.5 * t ** 3 - 2.5 * t ** 2 + 1 when t < 2 then -0.5 * t ** 3 + 2.5 * t ** 2 - 4 * t + 2 else 0 end",
    "cubicspline": "case when t <= 1 then (4 - 6 * t ** 2 + 3 * t ** 3) / 6 when t < 2 then (2 - t) ** 3 / 6 else 0 end",
    "lanczos": "case when t = 0 then 1 when t < 3 then 3 * sin(pi() * t) * sin(pi() * t / 3) / (pi() * t) ** 2 else 0 end",
}
_FAR = "fx as (select j.i as j, k.i as k, cast(abs(1.5 + (j.i - 1) * 2.0 - k.i) as double) as t from range(1, 26) j(i), range(1, 51) k(i)), fy as (select j.i as j, k.i as k, cast(abs(-0.25 + (j.i - 1) * 0.5 - (k.i - 1)) as double) as t from range(1, 23) j(i), range(1, 12) k(i))"
for _m, _k in _KERNELS.items():
    _add(f"resample_{_m}", _on(li, lambda c, m=_m: resample.resample(c["price"], _FINE, method=m).map(lambda x: F.round(x, 2))), f", {_FAR}, wx as (select j, k, {_k} as w from fx), wy as (select j, k, {_k} as w from fy) select cast(wx.j as int) as xi, cast(wy.j as int) as yi, round(sum(price * (wx.w * wy.w)) / sum(wx.w * wy.w), 2) as price from li_grid l join wx on wx.k = l.xi join wy on wy.k = l.yi where abs(wx.w) > 1e-12 and abs(wy.w) > 1e-12 group by 1, 2", "li_grid")
_add("warp_flags", _on(li, lambda c: resample.warp(c["price"], {"te": (0.5, -0.5, 50.5, 10.5), "ts": (25, 11), "r": "max"})), "select cast((xi + 1) // 2 as int) as xi, yi, max(price) as price from li_grid group by 1, 2", "li_grid")
_LONLAT = Grid((Dim("X", 36, -180.0, 10.0, sampling="intervals", locus="start", crs="EPSG:4326", mappedcrs="EPSG:4326"), Dim("Y", 16, -80.0, 10.0, sampling="intervals", locus="start", crs="EPSG:4326", mappedcrs="EPSG:4326")))
_MERCATOR_Y = "ln(tan(radians(-80 + (i - 1) * 10.0) / 2 + pi() / 4)) * 6378137.0"
_axis = lambda s, d: s.createDataFrame([(i, round(v, 4) + 0.0) for i, v in enumerate(d.values(), 1)], "i int, coord double")
_add("reproject_axis", lambda s, d: _axis(s, resample.reproject_dim(_LONLAT["Y"], "EPSG:3857")), f"select cast(i as int) as i, round({_MERCATOR_Y}, 4) + cast(0 as double) as coord from range(1, 17) r(i)")
_add("reproject_axis_x", lambda s, d: _axis(s, resample.reproject_dim(_LONLAT["X"], "EPSG:3857")), "select cast(i as int) as i, round(radians(-180 + (i - 1) * 10.0) * 6378137.0, 4) + cast(0 as double) as coord from range(1, 37) r(i)")
# The cylindrical equal-area northing on WGS 84 with standard parallel 30 degrees, from its published formula.
_CEA = "6378137.0 / 2 * (1 - e2) * (sp / (1 - e2 * sp * sp) - ln((1 - sqrt(e2) * sp) / (1 + sqrt(e2) * sp)) / (2 * sqrt(e2))) / (cos(radians(30.0)) / sqrt(1 - e2 * pow(sin(radians(30.0)), 2)))"
_add("reproject_equal_area", lambda s, d: _axis(s, resample.reproject_dim(_LONLAT["Y"], "EPSG:6933")), f"select i, round({_CEA}, 4) as coord from (select cast(i as int) as i, sin(radians(-80 + (i - 1) * 10.0)) as sp, 0.0066943799901413165 as e2 from range(1, 17) r(i)) a")
_add("select_projected", lambda s, d: select.sel(allocate(s, Grid((Dim("X", 3, 0.0, 1e5, sampling="intervals", locus="start", crs="EPSG:3857", mappedcrs="EPSG:4326"),)), {"value": "int"}, 1), X=Between(0.89, 2.7)).df, "select cast(i as int) as xi, cast(1 as int) as value from range(1, 3) r(i)")
_AFFINE = resample.Affine(0.0, 2.0, 0.5, 0.0, 0.25, 1.0)
_add("affine_select", lambda s, d: resample.affine_select(R.geo_pts(s, d).select("id", "x", "y"), _AFFINE, 20, 12), "select id, x, y, case when i between 0 and 19 and j between 0 and 11 then cast(i + 1 as int) end as xi, case when i between 0 and 19 and j between 0 and 11 then cast(j + 1 as int) end as yi from (select id, x, y, floor((1.0 * x - 0.5 * y) / 1.875) as i, floor((2.0 * y - 0.25 * x) / 1.875) as j from geo_pts) g", "geo_pts")
_add("fractional_resample", _on(li, lambda c: resample.fractional_resample(c["n"].map(lambda x: (x % 3).cast("int")), (5, 5))), 'select cast((xi - 1) // 5 + 1 as int) as xi, cast((yi - 1) // 5 + 1 as int) as yi, cast(n % 3 as int) as "class", count(*) / 25 as share from li_grid where yi <= 10 group by 1, 2, 3', "li_grid")
_add("cellarea_planar", lambda s, d: area.planar(s, _LONLAT).df, "select cast(a.i as int) as xi, cast(b.i as int) as yi, cast(100 as double) as area from range(1, 37) a(i), range(1, 17) b(i)")
_BAND = "6371008.8 * 6371008.8 * (sin(radians(-80 + b.i * 10.0)) - sin(radians(-80 + (b.i - 1) * 10.0)))"
_add("cellarea_spherical", lambda s, d: area.spherical(s, _LONLAT).map(lambda x: F.round(x / 1e6, 3)).df, f"select cast(a.i as int) as xi, cast(b.i as int) as yi, round(10.0 / 360 * (2 * pi() * {_BAND}) / 1e6, 3) as area from range(1, 37) a(i), range(1, 17) b(i)")
_add("cellsize", lambda s, d: area.cellsize(s, _LONLAT).map(lambda x: F.round(x, 3)).df, f"select cast(a.i as int) as xi, cast(b.i as int) as yi, round(10.0 / 360 * (2 * pi() * {_BAND}) / 1e6, 3) as area from range(1, 37) a(i), range(1, 17) b(i)")
# Parallel sides are arcs of great circles between corners; each bounds, with the equator, 2 atan(tan(width / 2) sin(latitude)).
_add("cellarea_projected", lambda s, d: area.spherical(s, Grid((Dim("X", 20, 0.0, 1e5, sampling="intervals", locus="start", crs="EPSG:3857"), Dim("Y", 20, 0.0, 1e5, sampling="intervals", locus="start", crs="EPSG:3857")))).map(lambda x: F.round(x, -3)).df, f"select cast(i.i as int) as xi, cast(j.i as int) as yi, round(2 * (atan(tan(1e5 / 6378137.0 / 2) * sin(2 * atan(exp(j.i * 1e5 / 6378137.0)) - pi() / 2)) - atan(tan(1e5 / 6378137.0 / 2) * sin(2 * atan(exp((j.i - 1) * 1e5 / 6378137.0)) - pi() / 2))) * {area.RADIUS} * {area.RADIUS}, -3) as area from range(1, 21) i(i), range(1, 21) j(i)")

# Union grids, slices and layers.
_mosaic = lambda reducer: lambda s, d: setops.mosaic_by(R.li_regions(s, d), "region", reducer).df
for _m, _s in (("sum", "sum(price)"), ("mean", "avg(price)"), ("min", "min(price)"), ("max", "max(price)"), ("first", "arg_min(price, region)"), ("last", "arg_max(price, region)"), ("length", "count(*)"), ("median", "median(price)")):
    _add(f"mosaic_{_m}", _mosaic(_m), f"select xi, yi, {_s} as price from li_regions group by 1, 2", "li_regions")


def _halves(s: SparkSession, d: str) -> list[Cells]:
    c = li(s, d)["price"]
    return [select.sel(c, X=slice(1, 30), Y=slice(1, 8)), select.sel(c, X=slice(21, 50), Y=slice(4, 11))]


_add("mosaic_union", lambda s, d: setops.mosaic("sum", _halves(s, d)).df, "select xi, yi, case when (xi <= 30 and yi <= 8) or (xi > 20 and yi > 3) then price * (case when xi between 21 and 30 and yi between 4 and 8 then 2 else 1 end) end as price from li_cells left join li_grid using (xi, yi)", "li_cells", "li_grid")
_add("extend_fill", lambda s, d: setops.extend(_halves(s, d)[1], R.LI, fill=-1.0).df, "select xi, yi, case when xi > 20 and yi > 3 then coalesce(price, -1.0) else -1.0 end as price from li_cells left join li_grid using (xi, yi)", "li_cells", "li_grid")
_add("slice_combine_roundtrip", _on(grid3, lambda c: setops.combine_series(*setops.slice_dims(c, ["Ti"]), [c.grid["Ti"]])), "select xi, yi, ti, n, v from ev_grid", "ev_grid")
_add("slice_reduce", _on(grid3, lambda c: setops.slice_dims(c, ["Ti"])[0].df.groupBy("ti").agg(F.sum("v").alias("v"))), "select ti, sum(v) as v from ev_grid group by 1", "ev_grid")
_add("cat_x", _on(li, lambda c: setops.cat([c, c], "X")), "select cast(xi + k * 50 as int) as xi, yi, price, n from li_grid, (values (0), (1)) t(k)", "li_grid")
_add("cat_diagonal", _on(li, lambda c: setops.cat([c["n"], c["n"]], ["X", "Y"])), "select cast(xi + k * 50 as int) as xi, cast(yi + k * 11 as int) as yi, n from li_grid, (values (0), (1)) t(k)", "li_grid")
_add("layers_to_band", _on(day, lambda c: setops.layers_to_band(c.map(lambda x: x.cast("double")))), "select xi, yi, cast(1 as int) as band, cast(n as double) as value from ev_day union all select xi, yi, cast(2 as int) as band, v as value from ev_day", *DAY)
_add("band_to_layers", _on(day, lambda c: band_layers(setops.layers_to_band(c.map(lambda x: x.cast("double"))), ["a", "b"])), "select xi, yi, cast(n as double) as a, v as b from ev_day", *DAY)
_add("stack_layers", _on(day, lambda c: stack({"a": c["n"], "b": c["v"]})), "select xi, yi, n as a, v as b from ev_day", *DAY)
_add("from_table", lambda s, d: from_table(R.read(s, d, "lineitem").select(F.col("l_quantity").alias("X"), F.round(F.col("l_discount") * 100).alias("Y"), "l_orderkey", "l_linenumber"), R.LI, ["l_orderkey", "l_linenumber"]).df, "select cast(l_quantity as int) as xi, cast(round(l_discount * 100) + 1 as int) as yi, l_orderkey, l_linenumber from lineitem")
_add("create_filled", lambda s, d: allocate(s, R.LI, {"value": "int"}, 7).df, "select xi, yi, cast(7 as int) as value from li_cells", "li_cells")

# Points, lines and polygons.
_points = lambda s, d: geometry.from_points(R.geo_pts(s, d))
_add("extract_points_left", lambda s, d: vector.extract(li(s, d), _points(s, d), geometry_column=False), "select id, price, n from pts left join li_grid using (xi, yi)", "geo_pts", "pts", "li_grid")
_add("extract_points_inner", lambda s, d: vector.extract(li(s, d), _points(s, d), skipmissing=True).select("id", F.col("geometry.x").alias("x"), F.col("geometry.y").alias("y"), "price", "n"), "select id, x, y, price, n from pts join li_grid using (xi, yi)", "geo_pts", "pts", "li_grid")
_add("extract_index", lambda s, d: vector.extract(li(s, d)["n"], _points(s, d), geometry_column=False, index=True).select("id", F.col("index.xi").alias("xi"), F.col("index.yi").alias("yi"), "n"), "select id, xi, yi, n from pts left join li_grid using (xi, yi)", "geo_pts", "pts", "li_grid")
_add("extract_stack_anymissing", lambda s, d: vector.extract(li(s, d).with_layer("w", F.when(F.col("n") > 100, F.col("n"))), _points(s, d), skipmissing=True, geometry_column=False), "select id, price, n, n as w from pts join li_grid using (xi, yi) where n > 100", "geo_pts", "pts", "li_grid")
_add("extract_polygon", lambda s, d: vector.extract(li(s, d), R.zones(s, d)).select("id", F.col("geometry.x").alias("x"), F.col("geometry.y").alias("y"), "price", "n"), "select geom_id as id, cast(xi as double) as x, cast(yi - 1 as double) as y, price, n from burned left join li_grid using (xi, yi)", "edges", "up", "burned", "li_grid")
_add("extract_grouped", lambda s, d: vector.extract(li(s, d)["n"], R.zones(s, d), geometry_column=False, flatten=False).select("id", F.size("rows").cast("long").alias("cells"), F.aggregate("rows", F.lit(0).cast("long"), lambda a, r: a + F.coalesce(r["n"], F.lit(0))).alias("n")), "select geom_id as id, count(*) as cells, cast(coalesce(sum(n), 0) as bigint) as n from burned left join li_grid using (xi, yi) group by 1", "edges", "up", "burned", "li_grid")
_add("extract_line", lambda s, d: vector.extract(li(s, d)["n"], R.zones(s, d).withColumn("kind", F.lit("line")), geometry_column=False, index=True).select("id", F.col("index.xi").alias("xi"), F.col("index.yi").alias("yi"), "n"), "select id, xi, yi, n from (select geom_id as id, xi, yi, lag(xi) over o as px, lag(yi) over o as py from walk where e < 3 and xi between 1 and 50 and yi between 1 and 11 window o as (partition by geom_id order by e, k)) w left join li_grid using (xi, yi) where px is null or px <> xi or py <> yi", "segs", "steps", "walk", "li_grid")
for _m, _s, _e in (("sum", "sum(val)", None), ("count", "count(val)", 0), ("mean", "avg(val)", None), ("first", "arg_min(val, id)", None), ("last", "arg_max(val, id)", None), ("median", "median(val)", None), ("max", "max(val)", None)):
    _sql = f"coalesce(r.value, {_e})" if _e is not None else "r.value"
    _add(f"rasterize_points_{_m}", lambda s, d, m=_m: vector.rasterize(m, _points(s, d), R.LI, "val", kinds=("point",)).df, f", r as (select xi, yi, {_s} as value from pts where xi is not null group by 1, 2) select c.xi, c.yi, {_sql} as value from li_cells c left join r using (xi, yi)", "geo_pts", "pts", "li_cells")
_poly = ("edges", "up", "burned", "li_cells")
for _m, _s, _e in (("sum", "sum(geom_id)", None), ("count", "count(*)", 0), ("min", "min(geom_id)", None), ("max", "max(geom_id)", None), ("first", "min(geom_id)", None), ("last", "max(geom_id)", None), ("mean", "avg(geom_id)", None)):
    _cast = "double" if _m == "mean" else "bigint"
    _sql = f"cast(coalesce(r.value, {_e}) as bigint)" if _e is not None else f"cast(r.value as {_cast})"
    _add(f"rasterize_polygons_{_m}", lambda s, d, m=_m: vector.rasterize(m, R.zones(s, d), R.LI, "geom_id", kinds=("polygon",)).df, f", r as (select xi, yi, {_s} as value from burned group by 1, 2) select c.xi, c.yi, {_sql} as value from li_cells c left join r using (xi, yi)", *_poly)
_add("rasterize_polygons_prod", lambda s, d: vector.rasterize("prod", R.zones(s, d), R.LI, 2.0, kinds=("polygon",), dense=False).df, "select xi, yi, cast(power(2.0, count(*)) as double) as value from burned group by 1, 2", "edges", "up", "burned")
_add("rasterize_polygons_vcat", lambda s, d: vector.rasterize("vcat", R.zones(s, d), R.LI, "geom_id", kinds=("polygon",), dense=False).df.select("xi", "yi", F.array_join("value", ",").alias("ids")), "select xi, yi, string_agg(cast(geom_id as varchar), ',' order by geom_id) as ids from burned group by 1, 2", "edges", "up", "burned")
_add("rasterize_fold", lambda s, d: vector.rasterize("sum", R.zones(s, d), R.LI, F.col("geom_id").cast("double"), op=lambda a, b: a * 2 + b, init=0.0, kinds=("polygon",), dense=False).df, ", n as (select *, row_number() over (partition by xi, yi order by geom_id desc) as k from burned) select xi, yi, cast(sum(geom_id * power(2.0, k - 1)) as double) as value from n group by 1, 2", "edges", "up", "burned")
_add("rasterize_stack", lambda s, d: vector.rasterize("sum", R.zones(s, d), R.LI, {"a": 3, "b": "geom_id"}, kinds=("polygon",), dense=False).df, "select xi, yi, cast(3 * count(*) as bigint) as a, cast(sum(geom_id) as bigint) as b from burned group by 1, 2", "edges", "up", "burned")
_add("rasterize_onto", lambda s, d: vector.rasterize("sum", R.zones(s, d), R.LI, "geom_id", onto=li(s, d)["n"], kinds=("polygon",), dense=False).df, "select xi, yi, cast(coalesce(n, 0) + coalesce(s, 0) as bigint) as value from li_grid full join (select xi, yi, sum(geom_id) as s from burned group by 1, 2) r using (xi, yi)", "edges", "up", "burned", "li_grid")
_add("boolmask_polygons", lambda s, d: vector.boolmask(R.zones(s, d), R.LI, kinds=("polygon",)).df, "select c.xi, c.yi, count(b.geom_id) > 0 as mask from li_cells c left join burned b using (xi, yi) group by 1, 2", *_poly)
_add("boolmask_uncollapsed", lambda s, d: vector.boolmask(R.zones(s, d), R.LI, collapse=False, kinds=("polygon",)).df, "select c.xi, c.yi, cast(g.i as int) as geometry, count(b.geom_id) > 0 as mask from li_cells c cross join (select n_nationkey as k, row_number() over (order by n_nationkey) as i from nation) g left join burned b on b.xi = c.xi and b.yi = c.yi and b.geom_id = g.k group by 1, 2, 3", *_poly)
_ZONAL = "select z.geom_id, {0} from (select cast(n_nationkey as bigint) as geom_id from nation) z left join (select b.geom_id, l.price, l.n from burned b join li_grid l using (xi, yi)) c using (geom_id) group by 1"
_z = ("edges", "up", "burned", "li_grid")
for _m, _s in (("sum", "sum(price)"), ("mean", "avg(price)"), ("median", "median(price)"), ("min", "min(price)"), ("max", "max(price)")):
    _add(f"zonal_{_m}", lambda s, d, m=_m: vector.zonal(m, li(s, d)["price"], R.zones(s, d), kinds=("polygon",)), _ZONAL.format(f"{_s} as price"), *_z)
_add("zonal_count", lambda s, d: vector.zonal("count", li(s, d)["price"], R.zones(s, d), kinds=("polygon",)), _ZONAL.format("count(price) as price"), *_z)
_add("zonal_stack", lambda s, d: vector.zonal("sum", li(s, d), R.zones(s, d), kinds=("polygon",)), _ZONAL.format("sum(price) as price, cast(sum(n) as bigint) as n"), *_z)
_add("zonal_emptyval", lambda s, d: vector.zonal("sum", li(s, d)["n"].of(li(s, d).df.filter("xi > 25")), R.zones(s, d), emptyval=-1, kinds=("polygon",)), "select z.geom_id, cast(coalesce(sum(case when xi > 25 then n end), -1) as bigint) as n from (select cast(n_nationkey as bigint) as geom_id from nation) z left join (select b.geom_id, xi, n from burned b join li_grid l using (xi, yi)) c using (geom_id) group by 1", *_z)
_add("zonal_extent", lambda s, d: vector.zonal_extent("sum", li(s, d), {"X": (10.2, 20.3), "Y": (2.0, 5.0)}), "select sum(price) as price, cast(sum(n) as bigint) as n from li_grid where xi between 10 and 20 and yi between 3 and 6", "li_grid")
_add("zonal_apply", lambda s, d: vector.zonal_apply(lambda g: g.groupby("geom_id", as_index=False).agg(n=("n", "sum")), li(s, d)["n"], R.zones(s, d), "geom_id long, n double", kinds=("polygon",)), "select geom_id, cast(sum(n) as double) as n from burned join li_grid using (xi, yi) group by 1", "edges", "up", "burned", "li_grid")
_add("mask_geometry", lambda s, d: vector.mask(li(s, d)["n"], R.zones(s, d), kinds=("polygon",)).df, "select l.xi, l.yi, case when b.k then n end as n from li_grid l left join (select distinct xi, yi, true as k from burned) b using (xi, yi)", *_z)
_add("mask_geometry_inverted", lambda s, d: vector.mask(li(s, d)["n"], R.zones(s, d), invert=True, kinds=("polygon",)).df, "select l.xi, l.yi, case when b.k is null then n end as n from li_grid l left join (select distinct xi, yi, true as k from burned) b using (xi, yi)", *_z)
_FINE_BURN = "fine as (select geom_id, cast(a.i as int) as fx, cast(b.i as int) as fy from up, range(1, 45) b(i), range(1, 201) a(i) where (ys - 0.5) * 4 + 0.5 < b.i and b.i <= (ye - 0.5) * 4 + 0.5 and ((xs - 0.5) * 4 + 0.5) + (b.i - ((ys - 0.5) * 4 + 0.5)) * slope <= a.i group by 1, 2, 3 having count(*) % 2 = 1)"
_add("coverage_sum", lambda s, d: vector.coverage(R.zones(s, d), R.LI, "sum", 4).df, f", {_FINE_BURN}, r as (select (fx - 1) // 4 + 1 as xi, (fy - 1) // 4 + 1 as yi, count(*) / 16 as coverage from fine group by 1, 2) select c.xi, c.yi, coalesce(coverage, 0.0) as coverage from li_cells c left join r using (xi, yi)", "edges", "up", "li_cells")
_add("coverage_union", lambda s, d: vector.coverage(R.zones(s, d), R.LI, "union", 4).df, f", {_FINE_BURN}, r as (select (fx - 1) // 4 + 1 as xi, (fy - 1) // 4 + 1 as yi, count(*) / 16 as coverage from (select distinct fx, fy from fine) f group by 1, 2) select c.xi, c.yi, coalesce(coverage, 0.0) as coverage from li_cells c left join r using (xi, yi)", "edges", "up", "li_cells")
_walked = ("edges", "up", "burned", "segs", "steps", "walk", "li_cells")
_add("touches", lambda s, d: vector.boolmask(R.zones(s, d), R.LI, boundary="touches", kinds=("polygon",)).df, "select c.xi, c.yi, count(b.xi) > 0 as mask from li_cells c left join (select xi, yi from burned union select xi, yi from walk) b on b.xi = c.xi and b.yi = c.yi group by 1, 2", *_walked)
_add("inside", lambda s, d: vector.boolmask(R.zones(s, d), R.LI, boundary="inside", kinds=("polygon",)).df, "select c.xi, c.yi, count(b.xi) > 0 as mask from li_cells c left join (select geom_id, xi, yi from burned except select geom_id, xi, yi from walk) b on b.xi = c.xi and b.yi = c.yi group by 1, 2", *_walked)
_add("missed_geometries", lambda s, d: geometry.missed(R.zones(s, d), geometry.burn(R.zones(s, d), Grid((Dim("X", 20, 1.0, 1.0), Dim("Y", 11, 0.0, 1.0))), kinds=("polygon",))).select("geom_id"), "select cast(n_nationkey as bigint) as geom_id from nation where n_nationkey not in (select geom_id from burned where xi <= 20)", "edges", "up", "burned")
_add("sample_seeded", _on(day, lambda c: sample(c, 100, seed=1, skipmissing=True, replace=False, index=True)))
_add("sample_weighted", _on(day, lambda c: sample(c, 100, seed=1, weights=F.col("n"), skipmissing=True)))
_add("scan_scale_offset", _on(li, lambda c: values.scaled(c.df.withColumn("n", F.when(F.col("n") % 10 == 0, -9999).otherwise(F.col("n"))), "n", 0.5, 10.0, -9999)), "select xi, yi, price, case when n % 10 <> 0 then cast(n * 0.5 + 10.0 as double) end as n from li_grid", "li_grid")
_add("store_scale_offset", _on(li, lambda c: values.unscaled(c.df.withColumn("n", F.when(F.col("n") % 10 != 0, F.col("n") * 0.5 + 10.0)), "n", 0.5, 10.0, -9999)), "select xi, yi, price, cast(case when n % 10 <> 0 then n else -9999 end as int) as n from li_grid", "li_grid")



def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return {k: v.replace(") , ", "), ") for k, v in _oracles.items()}
