"""Golden results on small rasters, and laws that hold between operators."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridlake.cells import Cells, allocate, from_array, from_table, from_vector, grid_frame, stack
from gridlake.grid import At, Between, Contains, Dim, Grid, Near, Not, Touches
from gridlake.operators import aggregate as ag
from gridlake.operators import area, geometry, join, resample, select, setops, values, vector
from gridlake.operators.sample import sample
from tests.helpers import SQUARE, array, raster, square_grid

N = None


@pytest.fixture(scope="module")
def agg1(spark):
    rows = [[1, 2, 3, 4, 5, 6, -1], [7, 8, 9, 10, 11, 12, -1], [13, 14, 15, 16, 17, 18, -1]]
    return raster(spark, rows, Dim("X", 3, 30.0, 10.0), Dim("Y", 7, -10.0, 5.0))


def test_aggregate(spark, agg1):
    assert array(ag.aggregate(agg1, "sum", 3)) == [[72, 99]]
    assert array(ag.aggregate(agg1, "median", 3)) == [[8, 11]]
    for scale in ((3, 2), {"X": 3, "Y": 2}, {"X": ":", "Y": 2}):
        assert array(ag.aggregate(agg1, "sum", scale)) == [[45, 57, 69]]
    grid = ag.aggregate(agg1, "sum", (3, 2)).grid
    assert grid["Y"].step == 10.0 and grid["Y"].coord(1) == -7.5


def test_aggregate_locus(agg1):
    got = {x: array(ag.aggregate_locus(agg1, x, 3)) for x in ("start", "center", "end")}
    assert got == {"start": [[1, 4]], "center": [[8, 11]], "end": [[15, 18]]}
    assert array(ag.aggregate_locus(agg1, ("end", "start"), 3)) == [[13, 16]]
    assert array(ag.aggregate_locus(agg1, "center", (3, 2))) == [[8, 10, 12]]


def test_aggregate_missing(agg1):
    holes = agg1.of(agg1.df.filter("not (xi = 3 and yi = 5)"))
    assert array(ag.aggregate(holes, "sum", 3)) == [[72, N]]
    assert array(ag.aggregate(holes, "sum", 3, skipmissing=True)) == [[72, 82]]
    nulls = agg1.map(lambda v: F.when(v != 17, v))
    assert array(ag.aggregate(nulls, "sum", 3)) == [[72, N]]


def test_aggregate_first_last_use_cell_order(agg1):
    assert array(ag.aggregate(agg1, "first", 3)) == [[1, 4]]
    assert array(ag.aggregate(agg1, "last", 3)) == [[15, 18]]


def test_aggregate_errors(spark):
    c = from_array(spark, np.ones(3), [Dim("Z", 3, labels=("a", "b", "c"))])
    with pytest.raises(ValueError):
        ag.aggregate(c, "sum", 2)
    with pytest.raises(ValueError):
        ag.aggregate(c, "no such", {"Z": 2})


def test_axes():
    d = Dim("Y", 6, 100.0, -10.0, sampling="intervals", locus="start")
    assert d.extent() == (50.0, 110.0) and d.interval(1) == (100.0, 110.0)
    assert d.aggregate(2).interval(1) == (90.0, 110.0)
    assert d.disaggregate(2).interval(1) == (105.0, 110.0) and d.disaggregate(2).interval(12) == (50.0, 55.0)
    assert d.shifted("center").coord(1) == 105.0 and d.reverse().reverse() == d
    assert Contains(100.0).indices(d) == [1] and Contains(99.9).indices(d) == [2]
    s = Dim("X", 1000, 0.1, 0.1)
    assert s.slice(300, 400).coord(5) == s.coord(304)
    assert Grid.from_json(Grid((d, Dim("Band", 2, labels=("a", "b")))).to_json()) == Grid((d, Dim("Band", 2, labels=("a", "b"))))
    g = Grid.from_extent({"X": (-20.0, 0.0), "Y": (10.0, 30.0)}, res=0.5)
    assert (g["X"].n, g["Y"].n) == (40, 40) and g.extent() == {"X": (-20.0, 0.0), "Y": (10.0, 30.0)}
    with pytest.raises(ValueError):
        Grid.from_extent({"X": (0, 1)}, res=1, size=1)


def test_selectors():
    points, cells = Dim("Y", 11, -50.0, 10.0), Dim("X", 3, 0.5, 1.0, sampling="intervals")
    assert Between(-10, 10).indices(points) == [5, 6, 7]
    assert Between(0.5, 3).indices(cells) == [2, 3]
    assert Touches(0.5, 2.0).indices(cells) == [1, 2, 3]
    assert At(-20.0).indices(points) == [4] and Near(-24.0).indices(points) == [4] and Near(-25.0).indices(points) == [3]
    assert Not(At(-50.0)).indices(points) == list(range(2, 12))
    for bad in (At(3.0), At(70.0)):
        with pytest.raises(KeyError):
            bad.indices(points)
    projected = Dim("X", 3, 0.0, 1e5, sampling="intervals", locus="start", crs="EPSG:3857", mappedcrs="EPSG:4326")
    assert resample.mapped_bounds(projected)[0] == 0.0


def test_select_frames(spark, agg1):
    assert array(select.sel(agg1, X=2, Y=slice(2, 4))) == [8, 9, 10]
    assert array(select.sel(agg1, Y=[1, 7])) == [[1, -1], [7, -1], [13, -1]]
    assert select.sel(agg1, X=At(40.0)).grid.refdims == (("X", 40.0),)
    assert array(select.reverse(agg1, "X"))[0][:2] == [13, 14]


TRIM = [[N, N, N], [N, N, N], [N, 2.0, 0.5], [N, 1.0, N]]


def test_trim_crop_extend(spark):
    a = raster(spark, TRIM)
    t = select.trim(a)
    assert array(t) == [[2.0, 0.5], [1.0, N]]
    assert array(select.trim(a, pad=1)) == [[N, N, N], [N, 2.0, 0.5], [N, 1.0, N]]
    assert array(setops.extend(t, a.grid)) == TRIM
    assert array(select.crop(setops.extend(t, a.grid), t)) == array(t)
    empty = a.of(a.df.filter("false"))
    assert select.trim(empty).grid == a.grid
    with pytest.raises(ValueError):
        setops.extend(a, Grid((Dim("X", 2, 1.0, 1.0), Dim("Y", 2, 1.0, 1.0))))


GA = [[N, 7.0], [2.0, N]]


def test_masks(spark):
    a = raster(spark, GA)
    assert array(values.boolmask(a)) == [[False, True], [True, False]]
    assert array(values.boolmask(a, invert=True)) == [[True, False], [False, True]]
    assert array(values.missingmask(a)) == [[N, True], [True, N]]
    m = raster(spark, [[N, 1], [2, 3]])
    assert array(join.mask(m, a)) == [[N, 1], [2, N]]
    assert array(join.mask(m, a, invert=True)) == [[N, N], [N, 3]]
    assert array(values.replace_missing(a, -1.0)) == [[-1.0, 7.0], [2.0, -1.0]]
    assert [r.point for r in select.points(a).orderBy("xi", "yi").collect()] == [N, (1.0, 2.0), (2.0, 1.0), N]
    nan = raster(spark, [[1.0, float("nan")]], missingval=float("nan"))
    assert array(nan) == [[1.0, N]]


def test_classify(spark):
    c = raster(spark, [[1.0, 2.5], [3.0, 4.0]])
    assert array(values.classify(c, [((2, 3), 9.0), (lambda v: v > 3, 8.0)])) == [[1.0, 9.0], [3.0, 8.0]]
    assert array(values.classify(c, [(1, 2, 7.0), (2, 3, 6.0)], others=0.0)) == [[7.0, 6.0], [0.0, 0.0]]
    assert array(values.classify(raster(spark, GA), [(7, 1.0)], missing=-1.0)) == [[-1.0, 1.0], [2.0, -1.0]]
    assert array(values.classify(c, [((lambda v: v > 2, lambda v: v < 4), 5.0)])) == [[1.0, 5.0], [5.0, 4.0]]


def _regions(spark):
    a = raster(spark, [[0.1, 0.2], [0.3, 0.4]], Dim("X", 2, 2.0, 1.0), Dim("Y", 2, 5.0, 1.0))
    b = raster(spark, [[1.1, 1.2], [1.3, 1.4]], Dim("X", 2, 3.0, 1.0), Dim("Y", 2, 6.0, 1.0))
    return a, b


def test_mosaic(spark):
    a, b = _regions(spark)
    assert array(setops.mosaic("first", [a, b])) == [[0.1, 0.2, N], [0.3, 0.4, 1.2], [N, 1.3, 1.4]]
    assert array(setops.mosaic("last", [a, b]))[1][1] == 1.1
    assert array(setops.mosaic(lambda v: F.count_if(v > 0), [a, b])) == [[1, 1, N], [1, 2, 1], [N, 1, 1]]
    irregular = [Cells(r.df, Grid(tuple(Dim(d.name, d.n, coords=tuple(d.values())) for d in r.grid.dims)), r.layers) for r in (a, b)]
    assert array(setops.mosaic("first", irregular)) == [[0.1, 0.2, N], [0.3, 0.4, 1.2], [N, 1.3, 1.4]]


def test_mosaic_many_regions_as_rows(spark):
    df = spark.range(10_000).select(F.explode(F.expr("array(struct(1 as xi, 1 as yi), struct(2 as xi, 2 as yi))")).alias("c"), F.col("id").alias("r")).select("c.*", "r", F.lit(1).alias("v"))
    c = Cells(df, Grid((Dim("X", 2, 1.0, 1.0), Dim("Y", 2, 1.0, 1.0))), ("v",))
    assert array(setops.mosaic_by(c, "r", "sum")) == [[10_000, N], [N, 10_000]]


def test_slice_combine_cat_band(spark):
    a = from_vector(spark, list(range(24)), [Dim("X", 2), Dim("Y", 3), Dim("Ti", 4, 10.0, 10.0)])
    s, keys = setops.slice_dims(a, ["Ti"])
    assert values.same(setops.combine_series(s, keys, [a.grid["Ti"]]), a)
    one = select.sel(a, Ti=1)
    both = setops.cat([one, one], "Y")
    assert both.grid["Y"].n == 6 and array(both)[0] == [0, 2, 4, 0, 2, 4]
    assert array(setops.cat([one, one], ["X", "Y"], fill=-1))[0] == [0, 2, 4, -1, -1, -1]
    st2 = stack({"b": one.map(lambda v: v * 2), "a": one})
    assert array(select.sel(setops.layers_to_band(st2), Band=1))[1] == [2, 6, 10]
    thin = stack({"full": one, "row": ag.reduce_dims(one, "sum", ["X"])})
    assert array(thin, "row")[0] == array(thin, "row")[1] == [1, 5, 9]


def test_disaggregate_then_aggregate(spark, agg1):
    back = ag.aggregate(resample.disaggregate(agg1, (2, 3)), "mean", (2, 3))
    assert array(back) == array(agg1.map(lambda v: v.cast("double"))) and back.grid["X"].values() == agg1.grid["X"].values()


def test_fold_order_reducers(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0, 5), (2, 0.0, 0.0, 3), (3, 9.0, 9.0, 1)], "id long, x double, y double, v int")
    g = Grid((Dim("X", 3, 0.0, 1.0, sampling="intervals"), Dim("Y", 3, 0.0, 1.0, sampling="intervals")))
    p = geometry.from_points(pts)
    assert array(vector.rasterize("last", p, g, "v"))[0][0] == 3
    assert array(vector.rasterize("first", p, g, "v"))[0][0] == 5
    assert array(vector.rasterize("vcat", p, g, "v"))[0][0] == [5, 3]
    assert array(vector.rasterize("sum", p, g, F.col("v"), op=lambda a, b: a - b, init=100))[0][0] == 92
    assert array(vector.rasterize("count", p, g))[2][2] == 0


def test_polygon_counts(spark):
    g = square_grid()
    p = geometry.from_rows(spark, [(1, "polygon", SQUARE)])
    counts = {b: geometry.burn(p, g, boundary=b).count() for b in ("center", "touches", "inside")}
    assert counts == {"center": 400, "touches": 441, "inside": 361}
    assert geometry.burn(p, g, shape="line").count() == 80
    assert geometry.burn(p, square_grid("points"), boundary="touches").count() == 400
    open_ring = geometry.from_rows(spark, [(1, "polygon", [SQUARE[0][:-1]])])
    assert geometry.burn(open_ring, g).count() == 400
    flipped = Grid((g["X"].reverse(), g["Y"]))
    assert geometry.burn(p, flipped).agg(F.min("xi"), F.max("xi")).first() == (7, 26)
    with pytest.raises(ValueError):
        geometry.burn(p, g, boundary="near")


def test_line_walk(spark):
    g = Grid((Dim("X", 7, 0.5, 1.0, sampling="intervals"), Dim("Y", 7, 0.5, 1.0, sampling="intervals")))
    line = geometry.from_rows(spark, [(1, "line", [[(1.0, 4.5), (4.75, 0.75)]])])
    got = {(r.xi, r.yi) for r in geometry.burn(line, g).collect()}
    # rows are X: 1-based cells of the diagonal
    assert got == {(2, 5), (2, 4), (3, 4), (3, 3), (4, 3), (4, 2), (5, 2), (5, 1)}


def test_lines_that_leave_the_grid_are_clipped(spark):
    """On a window of a large grid lines take the same cells as on all of it."""
    wide = Grid((Dim("X", 400, -200.0, 1.0, sampling="intervals"), Dim("Y", 400, -200.0, 1.0, sampling="intervals")))
    window = Grid((Dim("X", 12, -6.0, 1.0, sampling="intervals"), Dim("Y", 9, 3.0, 1.0, sampling="intervals")))
    rnd = np.random.default_rng(3)
    ends = [(rnd.uniform(-150, 150, 2), rnd.uniform(-150, 150, 2)) for _ in range(150)] + [((-100, 5), (100, 5)), ((0, -90), (0, 90.5)), ((-90.5, -90.5), (90.5, 90.5)), ((90, -80), (-80, 90)), ((2.25, 5.5), (-150, 7)), ((-150, 7), (2.25, 5.5)), ((1, 4), (1, 4))]
    lines = geometry.from_rows(spark, [(k, "line", [[tuple(map(float, a)), tuple(map(float, b))]]) for k, (a, b) in enumerate(ends)])
    all_ = {(r.geom_id, r.xi - 194, r.yi - 203) for r in geometry.burn(lines, wide, kinds=("line",)).collect()}
    want = {(g, x, y) for g, x, y in all_ if 1 <= x <= 12 and 1 <= y <= 9}
    assert {(r.geom_id, r.xi, r.yi) for r in geometry.burn(lines, window, kinds=("line",)).collect()} == want and len(want) > 100
    grid = Grid((Dim("X", 10, 0.5, 1.0, sampling="intervals"), Dim("Y", 10, 0.5, 1.0, sampling="intervals")))
    far = geometry.from_rows(spark, [(k, "line", [[(0.5, 0.5), (end, 0.6)]]) for k, end in enumerate((1e6, 3e9, 1e15))])
    assert sorted(r["count"] for r in geometry.burn(far, grid, kinds=("line",)).groupBy("geom_id").count().collect()) == [10, 10, 10]


def test_boolmask_of_any_ids(spark):
    g = Grid((Dim("X", 3, 1.0, 1.0, sampling="intervals"), Dim("Y", 3, 1.0, 1.0, sampling="intervals")))
    square = lambda x, y: [[(x - 0.4, y - 0.4), (x + 0.4, y - 0.4), (x + 0.4, y + 0.4), (x - 0.4, y + 0.4)]]
    p = geometry.from_rows(spark, [(0, "polygon", square(1, 1)), (1, "polygon", square(2, 3)), (70, "polygon", square(3, 2)), (-5, "polygon", square(2, 2))])
    m = vector.boolmask(p, g, collapse=False)
    assert m.grid.dims[-1].labels == (-5, 0, 1, 70) and m.df.count() == 36
    want = {(2, 2, 1), (1, 1, 2), (2, 3, 3), (3, 2, 4)}
    assert {(r.xi, r.yi, r.geometry) for r in m.df.filter("mask").collect()} == want
    assert {(r.xi, r.yi, r.geometry) for r in vector.boolmask(p, g, collapse=False, dense=False).df.collect()} == want
    with pytest.raises(ValueError):
        vector.boolmask(p, g, invert=True, dense=False)


def test_interval_join_of_uneven_axes(spark):
    bounds = ((-3.0, -2.5), (-2.5, 0.0), (0.0, 0.001), (0.001, 50.0), (60.0, 61.0))
    dim = Dim("Y", 5, bounds=bounds, sampling="intervals")
    values = [-9.0, -3.0, -2.5, -0.1, 0.0, 0.0005, 0.001, 49.9, 50.0, 55.0, 60.5, 61.0, 1e9, None]
    got = {r.v: r.yi for r in join.interval_join(spark.createDataFrame([(v,) for v in values], "v double"), "v", dim).collect()}
    assert got == {v: next((k for k, (a, b) in enumerate(bounds, 1) if v is not None and a <= v < b), None) for v in values}


def test_draws_follow_the_weights(spark):
    g = Grid((Dim("X", 40, 1.0, 1.0), Dim("Y", 5, 1.0, 1.0)))
    c = Cells(grid_frame(spark, g).withColumn("w", F.when(F.col("xi") == 7, 100.0).when(F.col("xi") < 5, 0.0).otherwise(1.0)), g, ("w",))
    drawn = sample(c, 2000, seed=3, weights=F.col("w"))
    x = [r.geometry.x for r in drawn.collect()]
    assert len(x) == 2000 and min(x) >= 5 and 0.70 < x.count(7) / 2000 < 0.79  # 500 of 500 + 35 * 5


def test_rasterize_totals(spark):
    shift = lambda d: [[(x + d, y + d) for x, y in SQUARE[0]]]
    p = geometry.from_rows(spark, [(k + 1, "polygon", shift(10.0 * k)) for k in range(4)])
    g = Grid.from_extent({"X": (-20.0, 30.0), "Y": (10.0, 60.0)}, res=5.0)
    total = lambda c: sum(v or 0 for row in array(c) for v in row)
    assert total(vector.rasterize("count", p, g)) == 64
    assert [total(vector.rasterize(r, p, g, "geom_id")) for r in ("last", "first", "mean", "prod")] == [136, 124, 130, 180]
    assert total(vector.rasterize("count", p, g, boundary="touches")) >= 64
    assert total(vector.rasterize("sum", p, g, {"a": 3, "b": "geom_id"})) == 192


def test_rasterize_onto_extra_dim(spark):
    g = Grid((Dim("X", 2, 0.0, 1.0, sampling="intervals"), Dim("Y", 2, 0.0, 1.0, sampling="intervals"), Dim("Ti", 2)))
    c = allocate(spark, g, {"v": "long"}, 10)
    p = geometry.from_points(spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double"))
    assert array(vector.rasterize("sum", p, g, 5, onto=c)) == [[[15, 15], [10, 10]], [[10, 10], [10, 10]]]


def test_boolmask_uncollapsed(spark):
    p = geometry.from_rows(spark, [(1, "polygon", SQUARE), (2, "polygon", SQUARE)])
    g = Grid((Dim("X", 21, -20.0, 1.0, sampling="intervals"), Dim("Y", 21, 10.0, 1.0, sampling="intervals")))
    m = vector.boolmask(p, g, collapse=False, boundary="touches")
    assert [d.n for d in m.grid.dims] == [21, 21, 2] and m.df.filter("mask").count() == 882


def test_zonal(spark):
    g = square_grid("points")
    c = from_array(spark, np.outer(np.arange(1, 27), np.arange(1, 32)), g.dims)
    far = [[(100.0, 100.0), (101.0, 100.0), (101.0, 101.0)]]
    tiny = [[(-19.6, 10.2), (-19.4, 10.2), (-19.4, 10.4)]]
    p = geometry.from_rows(spark, [(1, "polygon", SQUARE), (2, "polygon", far), (3, "polygon", tiny)])
    got = {r.geom_id: r.value for r in vector.zonal("sum", c, p, emptyval=-1).collect()}
    assert got == {1: 90300, 2: N, 3: -1}
    assert vector.mask(c, p.filter("geom_id = 1")).df.agg(F.sum("value")).first()[0] == 90300
    assert vector.zonal_extent("count", c, {"X": (-20.0, -19.0), "Y": (0.0, 2.0)}).first()[0] == 6


def test_extract(spark):
    x, y = Dim("X", 2, 10.0, -1.0), Dim("Y", 2, 0.1, 0.1)
    c = raster(spark, [[3, N], [1, 2]], x, y)
    pts = spark.createDataFrame([(1, N, N), (2, 9.0, 0.1), (3, 9.0, 0.2), (4, 10.0, 0.3), (5, 10.0, 0.2)], "id long, x double, y double")
    p = geometry.from_points(pts)
    rows = {r.id: r.value for r in vector.extract(c, p).collect()}
    assert rows == {1: N, 2: 1, 3: 2, 4: N, 5: N}
    assert sorted(r.id for r in vector.extract(c, p, skipmissing=True).collect()) == [2, 3]
    g = Grid((Dim("X", 2, 10.0, -1.0, sampling="intervals"), Dim("Y", 2, 0.1, 0.1, sampling="intervals")))
    ci = Cells(c.df, g, c.layers)
    tri = geometry.from_rows(spark, [(1, "polygon", [[(8.0, 0.0), (11.0, 0.0), (11.0, 0.4), (8.0, 0.0)]])])
    got = sorted((r.geometry.x, round(r.geometry.y, 1), r.value) for r in vector.extract(ci, tri).collect())
    assert (9.0, 0.1, 1) in got and (10.0, 0.1, 3) in got
    line = geometry.from_rows(spark, [(1, "line", [[(8.0, 0.0), (12.0, 0.4)]])])
    got = {(r.geometry.x, round(r.geometry.y, 1)): r.value for r in vector.extract(ci, line).collect()}
    assert got == {(9.0, 0.1): 1, (9.0, 0.2): 2, (10.0, 0.2): N}
    flat = vector.extract(ci, line, flatten=False, geometry_column=False).first()
    assert [r.value for r in flat.rows] == [1, 2, N]


def test_coverage(spark):
    g = Grid((Dim("X", 4, 0.5, 1.0, sampling="intervals"), Dim("Y", 4, 0.5, 1.0, sampling="intervals")))
    box = lambda a, b, c, d: [[(a, b), (c, b), (c, d), (a, d), (a, b)]]
    one = geometry.from_rows(spark, [(1, "polygon", box(0.5, 0.5, 3.0, 3.0))])
    got = array(vector.coverage(one, g, "sum", 10))
    assert got[0][0] == 0.25 and got[0][1] == 0.5 and got[1][1] == 1.0 and got[3][3] == 0.0
    two = geometry.from_rows(spark, [(1, "polygon", box(0.5, 0.5, 3.0, 3.0)), (2, "polygon", box(0.5, 0.5, 3.0, 3.0))])
    assert array(vector.coverage(two, g, "union", 10)) == got
    assert array(vector.coverage(two, g, "sum", 10))[1][1] == 2.0
    flipped = Grid((g["X"].reverse(), g["Y"].reverse()))
    assert array(vector.coverage(one, flipped, "sum", 10))[3][3] == 0.25


def test_cell_area(spark):
    g = Grid((Dim("X", 100, 90.0, 0.1, sampling="intervals", locus="start", crs="EPSG:4326"), Dim("Y", 900, 0.0, 0.1, sampling="intervals", locus="start", crs="EPSG:4326")))
    total = area.spherical(spark, g).df.agg(F.sum("area")).first()[0]
    assert math.isclose(total, 510.1e12 / 72, rel_tol=0.01)
    m = Grid((Dim("X", 2, 0.0, 1e5, sampling="intervals", locus="start", crs="EPSG:3857"), Dim("Y", 2, 0.0, 1e5, sampling="intervals", locus="start", crs="EPSG:3857")))
    by_corners = area.spherical(spark, m).df.agg(F.sum("area")).first()[0]
    mapped = area.spherical(spark, m.with_crs(mappedcrs="EPSG:4326")).df.agg(F.sum("area")).first()[0]
    assert math.isclose(by_corners, mapped, rel_tol=1e-3)
    with pytest.raises(ValueError):
        area.planar(spark, square_grid("points"))


def test_reproject():
    y = Dim("Y", 3, -30.0, 30.0, crs="EPSG:4326")
    assert math.isclose(resample.reproject_dim(y, "EPSG:6933").coord(1), -3.658789324855012e6, rel_tol=1e-9)
    x = Dim("X", 2, 0.0, 180.0, crs="EPSG:4326")
    assert math.isclose(resample.reproject_dim(x, "EPSG:6933").coord(2), 1.7367530445161372e7, rel_tol=1e-9)
    back = resample.reproject_dim(resample.reproject_dim(y, "EPSG:6933"), "EPSG:4326")
    assert all(math.isclose(a, b, abs_tol=1e-6) for a, b in zip(back.values(), y.values(), strict=True))
    with pytest.raises(ValueError):
        resample.reproject_dim(y, "EPSG:32633")


def test_resample_methods(spark):
    c = raster(spark, [[1.0, 2.0], [3.0, 4.0]], Dim("X", 2, 0.5, 1.0, sampling="intervals"), Dim("Y", 2, 0.5, 1.0, sampling="intervals"))
    one = Grid((Dim("X", 1, 1.0, 2.0, sampling="intervals"), Dim("Y", 1, 1.0, 2.0, sampling="intervals")))
    got = {m: array(resample.resample(c, one, method=m))[0][0] for m in ("average", "sum", "min", "max", "med", "bilinear")}
    assert got == {"average": 2.5, "sum": 10.0, "min": 1.0, "max": 4.0, "med": 2.5, "bilinear": 2.5}
    assert values.same(resample.resample(c, c.grid), c)
    assert array(resample.resample(c, size=4))[0][:2] == [1.0, 1.0]
    for m in ("cubic", "cubicspline", "lanczos", "q1", "q3", "mode", "rms"):
        assert resample.resample(c, one, method=m).df.count() == 1
    with pytest.raises(ValueError):
        resample.resample(c, one, method="best")


def test_affine(spark):
    a = resample.Affine(10.0, 2.0, 0.5, 5.0, 0.25, 1.0)
    df = spark.range(1, 5).select(F.col("id").cast("int").alias("i"), F.lit(2).alias("j"))
    x, y = a.columns(F.col("i"), F.col("j"))
    got = resample.affine_select(df.withColumn("x", x).withColumn("y", y), a, 3, 3)
    assert [(r.i, r.xi, r.yi) for r in got.orderBy("i").collect()] == [(1, 1, 2), (2, 2, 2), (3, 3, 2), (4, N, N)]
    assert not a.aligned and a.bounds(1, 1) == {"X": (10.0, 12.5), "Y": (5.0, 6.25)}


def test_sample(spark):
    a = raster(spark, GA)
    got = sample(a, 2, seed=1, skipmissing=True, replace=False, index=True)
    assert sorted(r.value for r in got.collect()) == [2.0, 7.0]
    again = sample(a, 50, seed=1, weights=F.when(F.col("xi") == 1, 1.0).otherwise(0.0), skipmissing=True)
    assert [r.value for r in again.collect()] == [7.0] * 50
    assert {r.value for r in sample(a, 100, seed=2).collect()} == {N, 7.0, 2.0}


def test_table_round_trip(spark, agg1):
    g = Grid((Dim("X", 3, 30.0, 10.0), Dim("Y", 7, -10.0, 5.0)))
    assert values.same(from_table(agg1.coords(), g, ["value"]), agg1)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(-4, 44), st.integers(-4, 44)), min_size=3, max_size=7))
def test_polygon_rule_on_random_rings(spark, corners):
    ring = [(x / 4, y / 4) for x, y in corners]
    g = Grid((Dim("X", 10, 1.0, 1.0), Dim("Y", 10, 1.0, 1.0)))
    got = {(r.xi, r.yi) for r in geometry.burn(geometry.from_rows(spark, [(1, "polygon", [ring])]), g).collect()}
    want = set()
    closed = ring if ring[0] == ring[-1] else [*ring, ring[0]]
    for iy in range(1, 11):
        for ix in range(1, 11):
            n = 0
            for (x1, y1), (x2, y2) in zip(closed, closed[1:], strict=False):
                low, high = sorted(((y1, x1), (y2, x2)))
                if low[0] < iy <= high[0] and low[1] + (iy - low[0]) * ((x2 - x1) / (y2 - y1)) <= ix:
                    n += 1
            want |= {(ix, iy)} if n % 2 else set()
    assert got == want


@pytest.mark.parametrize("coords", [(1.0, 2.0, 10.0), (10.0, 2.0, 1.0)])
def test_points_on_irregular_axes(spark, coords):
    # Cells of the x axis reach to 0.5, 1.5, 6 and 14; the y axis has points.
    grid = Grid((Dim("X", 3, coords=coords, sampling="intervals"), Dim("Y", 2, coords=(5.0, 7.0))))
    at = {x: i for i, x in enumerate(coords, 1)}
    cells = Cells(spark.range(6).selectExpr("cast(id % 3 + 1 as int) xi", "cast(floor(id / 3) + 1 as int) yi", "id v"), grid, ("v",))
    geoms = geometry.from_rows(spark, [(k, "point", [[p]]) for k, p in enumerate([(5.9, 7.0), (6.0, 5.0), (6.0, 6.0), (20.0, 5.0), (1.0, 5.05)])])
    value = lambda x, row: at[x] - 1 + 3 * row
    got = {r.id: r.v for r in vector.extract(cells, geoms, geometry_column=False).collect()}
    assert got == {0: value(2.0, 1), 1: value(10.0, 0), 2: None, 3: None, 4: None}
    near = {r.id: r.v for r in vector.extract(cells, geoms, geometry_column=False, atol=0.1).collect()}
    assert near == {**got, 4: value(1.0, 0)}
    burned = {(r.geom_id, r.xi, r.yi) for r in geometry.burn(geoms, grid).collect()}
    assert burned == {(0, at[2.0], 2), (1, at[10.0], 1)}
    with pytest.raises(Exception, match="regular axes"):
        vector.extract(cells, geometry.from_rows(spark, [(1, "line", [[(1, 5), (2, 5)]])]), geometry_column=False).collect()


@pytest.mark.parametrize("dim", [Dim("X", 3, coords=(1.0, 2.0, 10.0)), Dim("X", 3, coords=(10.0, 2.0, 1.0)), Dim("X", 3, 5.0, -2.0), Dim("X", 1, coords=(4.0,))])
def test_nearest_join_takes_the_lower_index(spark, dim):
    values = [-9.0, 1.0, 1.5, 2.0, 4.0, 6.0, 6.1, 10.0, 99.0, None]
    x = dim.values()
    want = {v: min(range(1, dim.n + 1), key=lambda i: (abs(v - x[i - 1]), i)) if v is not None else None for v in values}
    df = spark.createDataFrame([(v, 0) for v in values], "v double, xi int")
    rows = join.nearest_join(df, "v", dim).collect()
    assert len(rows) == len(values) and {r.v: r.xi for r in rows} == want


def test_rotate_and_reorder(spark):
    a = np.arange(6.0).reshape(2, 3)
    c = raster(spark, a)
    for quarters in range(-1, 5):
        turned = select.rotate(c, quarters)
        assert np.array_equal(np.array(array(turned), float), np.rot90(a, quarters))
    assert [d.name for d in select.rotate(c).grid.dims] == ["Y", "X"]
    back = select.reorder(c, "reverse")
    assert np.array_equal(np.array(array(back), float), a[::-1, ::-1]) and select.reorder(back, "forward").grid.extent() == c.grid.extent()
    with pytest.raises(ValueError):
        select.reorder(c, {"X": "sideways"})


def test_mosaic_within_a_tolerance(spark):
    a = raster(spark, [[1.0], [2.0]])
    b = raster(spark, [[10.0], [20.0]], Dim("X", 2, 2.01, 1.0), Dim("Y", 1, 1.0, 1.0))
    with pytest.raises(ValueError):
        setops.mosaic("sum", [a, b])
    assert array(setops.mosaic("sum", [a, b], atol=0.02)) == [[1], [12], [20]]
    to = Grid((Dim("X", 3, coords=(1.0, 2.0, 3.0)), a.grid["Y"]))
    assert array(setops.mosaic("sum", [a, b], to=to, atol=0.02)) == [[1], [12], [20]]
    assert array(setops.mosaic("sum", [a, b], to=to)) == [[1], [2], [N]]


@pytest.mark.parametrize("by", [["g"], []])
def test_as_of_join_in_parts(spark, by):
    rng = np.random.default_rng(4)
    rows = lambda n: [(int(g) if g < 3 else None, float(k)) for g, k in zip(rng.integers(0, 4, n), rng.choice(5000, n, replace=False) / 10, strict=True)]
    left, right = rows(300), rows(60)
    a = spark.createDataFrame([(i, *r) for i, r in enumerate(left)] + [(300, 1, None)], "i int, g int, t double").select("i", *by, "t")
    b = spark.createDataFrame([(*r, j if j % 5 else None) for j, r in enumerate(right)], "g int, t double, v int").select(*by, "t", "v")
    splits = join.key_splits(b, "t", 8)
    assert len(splits) == 7
    got = {r.i: r.v for r in join.as_of_join(a, b, "t", by, "v", splits).collect()}
    want = {300: None}
    for i, (g, t) in enumerate(left):
        before = [(u, j) for j, (h, u) in enumerate(right) if (h == g or not by) and u <= t and j % 5]
        want[i] = max(before)[1] if before else None
    assert got == want == {r.i: r.v for r in join.as_of_join(a, b, "t", by, "v").collect()}
