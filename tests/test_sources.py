"""Files: round trips of every format, series, scale and offset, and the streaming rollup."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.cells import stack
from gridlake.grid import Dim, Grid
from gridlake.operators import values
from gridlake.sources import io
from gridlake.sources.formats import Grd, format_of
from gridlake.streaming.rollup import rollup
from tests.helpers import array, raster

N = None


@pytest.fixture(scope="module")
def rast(spark):
    x, y = (Dim(n, k, a, s, sampling="intervals", locus="start") for n, k, a, s in (("X", 2, 10.0, 1.0), ("Y", 3, 3.0, -1.0)))
    return raster(spark, [[3.0, N, 5.0], [1.0, 2.0, 6.0]], x, y)


@pytest.mark.parametrize("ext", [".grd", ".asc", ".tif", ".parquet"])
def test_round_trip(spark, rast, tmp_path, ext):
    path = str(tmp_path / f"r{ext}")
    io.write(rast, path)
    back = io.read(spark, path)
    assert back.grid.extent() == rast.grid.extent() and array(back) == array(rast)
    with pytest.raises(Exception):  # noqa: B017
        io.write(rast, path)
    io.write(rast, path, force=True)


def test_forward_axis_is_written_from_the_top(spark, rast, tmp_path):
    from gridlake.operators.select import reverse

    path = str(tmp_path / "f.grd")
    io.write(reverse(rast, "Y"), path)
    assert array(io.read(spark, path)) == array(rast)


def test_grd_raw_and_bands(spark, tmp_path):
    a = np.arange(12, dtype="<i2").reshape(2, 2, 3)
    (tmp_path / "b.gri").write_bytes(a.tobytes())
    (tmp_path / "b.grd").write_text("[georeference]\nnrows= 2\nncols= 3\nxmin= 0\nymin= 0\nxmax= 3\nymax= 2\nprojection=\n[data]\ndatatype= INT2S\nnodatavalue= 5\nbyteorder= little\nnbands= 2\n[description]\nlayername= red:green\n")
    c = io.read(spark, str(tmp_path / "b.grd"))
    assert [d.n for d in c.grid.dims] == [3, 2, 2] and c.layers == ("red",)
    assert array(c)[2][1][0] is N and array(c)[0][0] == [0, 6]
    assert c.df.filter("red is null").count() == 1 and dict(c.df.dtypes)["red"] == "smallint"
    assert io.read(spark, str(tmp_path / "b.grd"), raw=True).df.filter("red = 5").count() == 1


def test_zarr(spark, tmp_path):
    root = tmp_path / "z.zarr"
    a = np.arange(20.0).reshape(4, 5)
    for name, v, chunks in (("value", a, (2, 3)), ("x", np.arange(5.0), (5,)), ("y", np.arange(4.0)[::-1], (4,))):
        (root / name).mkdir(parents=True)
        (root / name / ".zarray").write_text(json.dumps({"shape": v.shape, "chunks": chunks, "dtype": "<f8", "compressor": None, "fill_value": -1.0, "order": "C", "filters": None, "zarr_format": 2}))
        for at in np.ndindex(*(-(-n // c) for n, c in zip(v.shape, chunks, strict=True))):
            part = np.full(chunks, -1.0)
            piece = v[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunks, strict=True))]
            part[tuple(slice(0, n) for n in piece.shape)] = piece
            (root / name / ".".join(map(str, at))).write_bytes(part.astype("<f8").tobytes())
    (root / ".zattrs").write_text("{}")
    c = io.read(spark, str(root))
    assert np.array_equal(np.array(array(c), float).T, a) and c.grid["Y"].order == "reverse"


def _classic(records):
    """A classic NetCDF file by hand: t (record axis or not), y, x, and packed values of type short."""
    import struct

    n = lambda v: struct.pack(">i", v)
    text = lambda s: n(len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    att = lambda k, kind, code, v: text(k) + n(kind) + n(1) + struct.pack(code, v) + b"\0" * (-struct.calcsize(code) % 4)
    y, x = np.array([20.0, 10.0, 0.0], ">f8").tobytes(), np.array([1.0, 2.0], ">f8").tobytes()
    values = np.arange(12, dtype=">i2").tobytes()
    dims = n(10) + n(3) + text("t") + n(0 if records else 2) + text("y") + n(3) + text("x") + n(2)
    packed = n(12) + n(3) + att("_FillValue", 3, ">h", 5) + att("scale_factor", 6, ">d", 0.5) + att("add_offset", 6, ">d", 100.0)

    def head(at):
        none = n(0) + n(0)
        return b"CDF\1" + n(2 if records else 0) + dims + none + n(11) + n(3) + text("y") + n(1) + n(1) + none + n(6) + n(24) + n(at) + text("x") + n(1) + n(2) + none + n(6) + n(16) + n(at + 24) + text("tos") + n(3) + n(0) + n(1) + n(2) + packed + n(3) + n(12) + n(at + 40)

    return head(len(head(0))) + y + x + values


@pytest.mark.parametrize("records", [True, False])
def test_classic_netcdf(spark, tmp_path, records):
    path = tmp_path / "a.nc"
    path.write_bytes(_classic(records))
    c = io.read(spark, str(path))
    assert c.layers == ("tos",) and [d.n for d in c.grid.dims] == [2, 3, 2] and c.grid["Y"].order == "reverse"
    assert c.grid.extent()["Y"] == (-5.0, 25.0)
    assert array(c)[0] == [[100.0, 103.0], [101.0, 104.0], [102.0, 105.0]] and array(c)[1][2] == [N, 105.5]
    assert io.read(spark, str(path), raw=True).df.filter("tos = 5").count() == 1


def test_series_and_stack(spark, rast, tmp_path):
    for k in (2, 1):
        io.write(rast.map(lambda v, k=k: v * k), str(tmp_path / f"s_{k}.grd"))
    s = io.read_series(spark, [str(tmp_path / f"s_{k}.grd") for k in (2, 1)], parse=int)
    assert s.grid["Ti"].coords == (1, 2) and array(s)[1][1] == [2.0, 4.0]
    both = io.read_stack(spark, {f"l{k}": str(tmp_path / f"s_{k}.grd") for k in (1, 2)})
    assert array(both, "l2")[0] == [6.0, N, 10.0]
    io.write(both, str(tmp_path / "t.grd"))
    assert array(io.read(spark, str(tmp_path / "t_l2.grd")))[0] == [6.0, N, 10.0]


def test_parquet_partitions_and_pushdown(spark, rast, tmp_path):
    path = str(tmp_path / "p.parquet")
    series = stack({"a": rast, "b": rast})
    io.write(series, path, tile=2)
    got = io.read(spark, path)
    assert got.grid == series.grid
    plan = got["a"].df.filter("xi = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(xi), EqualTo(xi,2)]" in plan and "ReadSchema: struct<xi:int,yi:int,a:double>" in plan


def test_unavailable():
    with pytest.raises(NotImplementedError):
        format_of("a.nc4")
    with pytest.raises(ValueError):
        format_of("a.what")
    assert format_of("x/y.grd") is Grd


def test_scale_offset(spark):
    df = spark.createDataFrame([(1, 10), (2, -9999), (3, 13)], "xi int, v int")
    got = values.scaled(df, "v", 0.5, 1.0, -9999)
    assert [r.v for r in got.orderBy("xi").collect()] == [6.0, N, 7.5]
    back = values.unscaled(got, "v", 0.5, 1.0, -9999)
    assert [r.v for r in back.orderBy("xi").collect()] == [10, -9999, 13]
    assert [r.v for r in values.unscaled(spark.createDataFrame([(1, 2.7)], "xi int, v double"), "v", coerce="trunc").collect()] == [2]
    with pytest.raises(Exception):  # noqa: B017
        values.unscaled(spark.createDataFrame([(1, 2.7)], "xi int, v double"), "v", coerce="convert").collect()


def test_streaming_rollup(spark, tmp_path):
    rows = spark.range(100).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 3).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(1).alias("v"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    g = Grid((Dim("X", 3, 0.0, 1.0, sampling="intervals"), Dim("Y", 1, 0.0, 1.0, sampling="intervals")))
    q = rollup(stream, g, "ts", F.col("x"), F.col("y"), "v", window="50 minutes").writeStream.format("memory").queryName("rolled").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("rolled").agg(F.sum("value"), F.count("*")).first() == (100, 6)


def _tiff(path, blocks, tags):
    """A big-endian TIFF by hand: blocks, then its directory."""
    import struct

    data, places = b"", []
    for b in blocks:
        places.append((8 + len(data), len(b)))
        data += b + b"\0" * (-len(b) % 8)
    start = 8 + len(data)
    named = {"offsets": ("I", [p for p, _ in places]), "sizes": ("I", [n for _, n in places])}
    tags = {tags[k] if k in named else k: named.get(k, v) for k, v in tags.items()}
    after, entries, extra = start + 2 + 12 * len(tags) + 4, b"", b""
    for tag in sorted(tags):
        form, v = tags[tag]
        raw = struct.pack(f">{len(v)}{form}", *v)
        if len(raw) > 4:
            raw, extra = struct.pack(">I", after + len(extra)), extra + raw
        entries += struct.pack(">HHI4s", tag, {"H": 3, "I": 4, "d": 12}[form], len(v), raw)
    path.write_bytes(b"MM" + struct.pack(">HI", 42, start) + data + struct.pack(">H", len(tags)) + entries + struct.pack(">I", 0) + extra)


PLACE = {33550: ("d", [1.0, 1.0, 0.0]), 33922: ("d", [0.0, 0.0, 0.0, 10.0, 5.0, 0.0])}


@pytest.mark.parametrize("compression", [1, 8, 50000])
def test_tiff_tiles_with_differences(spark, tmp_path, compression):
    import zlib

    import pyarrow as pa

    a = np.random.default_rng(1).integers(-3000, 3000, (21, 35)).astype(">i2")
    packed = {1: bytes, 8: zlib.compress, 50000: lambda b: pa.Codec("zstd").compress(b).to_pybytes()}[compression]
    blocks = []
    for j in range(0, 21, 16):
        for i in range(0, 35, 16):
            part = np.zeros((16, 16), ">i2")
            piece = a[j : j + 16, i : i + 16]
            part[: piece.shape[0], : piece.shape[1]] = piece
            blocks.append(packed(np.diff(part.astype(np.int64), axis=1, prepend=0).astype(">i2").tobytes()))
    tags = {256: ("I", [35]), 257: ("I", [21]), 258: ("H", [16]), 259: ("H", [compression]), 277: ("H", [1]), 317: ("H", [2]), 322: ("H", [16]), 323: ("H", [16]), 339: ("H", [2]), "offsets": 324, "sizes": 325}
    _tiff(tmp_path / "t.tif", blocks, {**tags, **PLACE, 34735: ("H", [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, 3857])})
    c = io.read(spark, str(tmp_path / "t.tif"))
    assert np.array_equal(np.array(array(c), int).T, a) and c.grid.crs == "EPSG:3857"
    assert c.grid.extent() == {"X": (10.0, 45.0), "Y": (-16.0, 5.0)}


def test_tiff_strips_with_byte_planes_and_mixed_bands(spark, tmp_path):
    import zlib

    a = np.random.default_rng(2).normal(size=(5, 7, 2)).astype(">f4")
    blocks = []
    for low in range(0, 5, 2):
        rows = a[low : low + 2]
        planes = np.frombuffer(rows.tobytes(), np.uint8).reshape(len(rows), 14, 4).transpose(0, 2, 1).reshape(len(rows), -1, 2)
        blocks.append(zlib.compress(np.diff(planes.astype(int), axis=1, prepend=0).astype(np.uint8).tobytes()))
    tags = {256: ("I", [7]), 257: ("I", [5]), 258: ("H", [32, 32]), 259: ("H", [8]), 277: ("H", [2]), 278: ("I", [2]), 284: ("H", [1]), 317: ("H", [3]), 339: ("H", [3, 3]), "offsets": 273, "sizes": 279}
    _tiff(tmp_path / "s.tif", blocks, {**tags, **PLACE, 34735: ("H", [1, 1, 0, 1, 1025, 0, 1, 2])})
    c = io.read(spark, str(tmp_path / "s.tif"))
    assert np.array_equal(np.array(array(c), np.float32).transpose(1, 0, 2), a)
    assert c.grid.extent()["X"] == (9.5, 16.5) and c.grid.extent()["Y"] == (0.5, 5.5)


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("bands", [1, 3])
def test_tiff_is_written_in_tiles(spark, tmp_path, monkeypatch, wide, bands):
    from gridlake.cells import Cells
    from gridlake.sources import tiff

    if wide:
        monkeypatch.setattr(tiff, "CLASSIC_BYTES", 0)
    dims = [Dim("X", 70, 10.0, 0.5, sampling="intervals", locus="start", crs="EPSG:4326"), Dim("Y", 40, 0.0, 0.25, sampling="intervals", locus="start", crs="EPSG:4326")]
    grid = Grid((*dims, *([Dim("Band", bands)] if bands > 1 else [])))
    df = spark.range(2800 * bands).selectExpr("cast(id % 70 + 1 as int) as xi", "cast(floor(id / 70) % 40 + 1 as int) as yi", "cast(floor(id / 2800) + 1 as int) as band", "id * 1.5D as v")
    cells = Cells(df.filter("xi > 20 and yi <> 7").select(*grid.columns, "v"), grid, ("v",))
    path = str(tmp_path / "w.tif")
    tiff.GeoTiff.write(cells, path, tile=16)
    back = io.read(spark, path)
    assert back.grid.crs == "EPSG:4326" and back.grid.extent() == grid.extent()
    key = grid.columns
    want = {tuple(r) for r in cells.df.withColumn("yi", F.expr("41 - yi")).select(*key, "v").collect()}
    assert {tuple(r) for r in back.df.filter("value is not null").select(*key, "value").collect()} == want
    assert back.df.count() == 2800 * bands  # tiles without cells are missing
