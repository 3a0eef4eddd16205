"""File formats: GRD (.grd and .gri), ASCII grid (.asc), GeoTIFF (.tif), Zarr 2 (.zarr), classic NetCDF (.nc)."""

from __future__ import annotations

import json
import os
import struct
import zlib

import numpy as np

from ..cells import Cells
from .files import Format, Header, dense_array, open_file, read_range, read_text
from .tiff import GeoTiff

# Names of types in GRD headers.
GRD_TYPES = {"LOG1S": "b1", "INT1S": "i1", "INT2S": "i2", "INT4S": "i4", "INT8S": "i8", "INT1U": "u1", "INT2U": "u2", "INT4U": "u4", "INT8U": "u8", "FLT4S": "f4", "FLT8S": "f8"}


def _stem(path: str) -> str:
    return path[: -len(".grd")] if path.endswith((".grd", ".gri")) else path


class Grd(Format):
    """A text header and raw values: bands, rows from the top, columns."""

    name, extensions = "gridlake_grd", (".grd", ".gri")

    @staticmethod
    def header(path: str) -> Header:
        said = {}
        for line in read_text(_stem(path) + ".grd").splitlines():
            if "=" in line and not line.startswith("["):
                key, value = line.split("=", 1)
                said[key.strip()] = value.strip()
        nx, ny = int(said["ncols"]), int(said["nrows"])
        x0, x1, y0, y1 = (float(said[k]) for k in ("xmin", "xmax", "ymin", "ymax"))
        step = (y1 - y0) / ny
        order = ">" if said.get("byteorder", "little") == "big" else "<"
        missing = said.get("nodatavalue", "")
        layer = said.get("layername", "value").split(":")[0] or "value"
        return Header(nx, ny, int(said.get("nbands", 1)), np.dtype(order + GRD_TYPES[said["datatype"]]), (x0, (x1 - x0) / nx), (y1 - step, -step), float(missing) if missing not in ("", "nothing", "NA") else None, layer, said.get("projection") or None)

    @staticmethod
    def rows(path: str, h: Header, band: int, low: int, high: int) -> np.ndarray:
        row = h.nx * h.kind.itemsize
        data = read_range(_stem(path) + ".gri", (band * h.ny + low) * row, (high - low) * row)
        return np.frombuffer(data, h.kind).reshape(-1, h.nx)

    @staticmethod
    def write(cells: Cells, path: str, layer: str | None = None, kind: str = "FLT8S", missing: float = -9999.0) -> None:
        layer = layer or cells.layers[0]
        x, y = cells.grid["X"], cells.grid["Y"]
        array = dense_array(cells, layer, np.dtype("<" + GRD_TYPES[kind]), missing)
        if y.step > 0:
            array = array[..., ::-1, :]
        if x.step < 0:
            array = array[..., ::-1]
        (x0, x1), (y0, y1) = x.extent(), y.extent()
        bands = cells.grid["Band"].n if "Band" in cells.grid else 1
        with open(_stem(path) + ".gri", "wb") as f:
            f.write(np.ascontiguousarray(array).tobytes())
        with open(_stem(path) + ".grd", "w") as f:
            f.write(f"[georeference]\nnrows= {y.n}\nncols= {x.n}\nxmin= {x0!r}\nymin= {y0!r}\nxmax= {x1!r}\nymax= {y1!r}\nprojection= {cells.grid.crs or ''}\n[data]\ndatatype= {kind}\nnodatavalue= {missing!r}\nbyteorder= little\nnbands= {bands}\n[description]\nlayername= {layer}\n")


class AsciiGrid(Format):
    """Six header lines, then rows from the top."""

    name, extensions = "gridlake_asc", (".asc",)

    @staticmethod
    def header(path: str) -> Header:
        said, skip = {}, 0
        for line in read_text(path).splitlines():
            word = line.split()
            if len(word) != 2 or not word[0][0].isalpha():
                break
            said[word[0].lower()], skip = word[1], skip + 1
        nx, ny, size = int(said["ncols"]), int(said["nrows"]), float(said["cellsize"])
        half = size / 2
        x0 = float(said["xllcorner"]) if "xllcorner" in said else float(said["xllcenter"]) - half
        y0 = float(said["yllcorner"]) if "yllcorner" in said else float(said["yllcenter"]) - half
        missing = said.get("nodata_value")
        return Header(nx, ny, 1, np.dtype("<f8"), (x0, size), (y0 + (ny - 1) * size, -size), float(missing) if missing is not None else None, more={"skip": skip})

    @staticmethod
    def rows(path: str, h: Header, band: int, low: int, high: int) -> np.ndarray:
        lines = read_text(path).splitlines()[h.more["skip"] + low : h.more["skip"] + high]
        return np.array([[float(v) for v in line.split()] for line in lines], np.float64).reshape(-1, h.nx)

    @staticmethod
    def write(cells: Cells, path: str, layer: str | None = None, missing: float = -9999.0) -> None:
        x, y = cells.grid["X"], cells.grid["Y"]
        if abs(abs(x.step) - abs(y.step)) > 1e-9 * abs(x.step):
            raise ValueError("an ASCII grid has square cells")
        array = dense_array(cells, layer or cells.layers[0], np.dtype("f8"), missing)
        array = array[::-1] if y.step > 0 else array
        array = array[:, ::-1] if x.step < 0 else array
        with open(path, "w") as f:
            f.write(f"ncols {x.n}\nnrows {y.n}\nxllcorner {x.extent()[0]!r}\nyllcorner {y.extent()[0]!r}\ncellsize {abs(x.step)!r}\nNODATA_value {missing!r}\n")
            f.writelines(" ".join(repr(float(v)) for v in row) + "\n" for row in array)


class Zarr(Format):
    """A group of two- or three-dimensional arrays (band, y, x) with x and y arrays; chunks plain or zlib."""

    name, extensions = "gridlake_zarr", (".zarr",)

    @staticmethod
    def _meta(path: str, name: str) -> dict:
        return json.loads(read_text(f"{path}/{name}/.zarray"))

    @staticmethod
    def _chunk(path: str, name: str, meta: dict, at: tuple[int, ...]) -> np.ndarray:
        try:
            with open_file(f"{path}/{name}/{meta.get('dimension_separator', '.').join(map(str, at))}") as f:
                data = f.read()
        except FileNotFoundError:
            return np.full(meta["chunks"], meta["fill_value"] if meta["fill_value"] is not None else 0, meta["dtype"])
        if meta["compressor"]:
            if meta["compressor"]["id"] not in ("zlib", "gzip"):
                raise ValueError(f"compressor {meta['compressor']['id']} needs a library that is not here")
            data = zlib.decompress(data, 47)
        return np.frombuffer(data, meta["dtype"]).reshape(meta["chunks"], order=meta["order"])

    @staticmethod
    def header(path: str) -> Header:
        group = json.loads(read_text(f"{path}/.zattrs"))
        layer = group.get("layer", "value")
        meta = Zarr._meta(path, layer)
        ny, nx = meta["shape"][-2:]

        def axis(name: str) -> tuple[float, float]:
            m = Zarr._meta(path, name)
            v = np.concatenate([Zarr._chunk(path, name, m, (k,)) for k in range(-(-m["shape"][0] // m["chunks"][0]))])[: m["shape"][0]]
            step = float(v[1] - v[0]) if len(v) > 1 else 1.0
            return float(v[0]) - abs(step) / 2, step  # centres on disk

        kind = np.dtype(meta["dtype"])
        fill = meta["fill_value"]
        return Header(nx, ny, meta["shape"][0] if len(meta["shape"]) == 3 else 1, kind, axis("x"), axis("y"), float("nan") if fill == "NaN" else fill, layer, group.get("crs"), {"meta": meta})

    @staticmethod
    def rows(path: str, h: Header, band: int, low: int, high: int) -> np.ndarray:
        meta = h.more["meta"]
        three = len(meta["shape"]) == 3
        cy, cx = meta["chunks"][-2:]
        out = np.empty((high - low, h.nx), h.kind)
        for j in range(low // cy, -(-high // cy)):
            for i in range(-(-h.nx // cx)):
                at = ((band // meta["chunks"][0],) if three else ()) + (j, i)
                chunk = Zarr._chunk(path, h.layer, meta, at)
                chunk = chunk[band % meta["chunks"][0]] if three else chunk
                a, b, x1 = max(low, j * cy), min(high, (j + 1) * cy), min(h.nx, (i + 1) * cx)
                out[a - low : b - low, i * cx : x1] = chunk[a - j * cy : b - j * cy, : x1 - i * cx]
        return out


# Type codes of the classic NetCDF format.
NC_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}


class NetCdf(Format):
    """Classic NetCDF (versions 1, 2 and 5). The first variable over a y and an x axis is the layer; axes before them
    run together as bands. _FillValue or missing_value, scale_factor and add_offset follow the CF conventions."""

    name, extensions = "gridlake_nc", (".nc",)

    @staticmethod
    def _contents(path: str) -> tuple[list, dict, dict, int]:
        with open_file(path) as f:
            magic = f.read(4)
            if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
                raise NotImplementedError(f"{path} is not classic NetCDF; HDF5-based files need a library that is not installed")
            wide = magic[3] == 5
            number = lambda: struct.unpack(">q" if wide else ">i", f.read(8 if wide else 4))[0]
            code = lambda: struct.unpack(">i", f.read(4))[0]

            def padded(n: int) -> bytes:
                return f.read(n + -n % 4)[:n]

            def attributes() -> dict:
                code()
                out = {}
                for _ in range(number()):
                    name = padded(number()).decode()
                    kind, n = NC_TYPES[code()], number()
                    data = padded(n * np.dtype(kind).itemsize)
                    out[name] = data.decode() if kind == "S1" else np.frombuffer(data, kind).tolist()
                return out

            records = number()
            code()
            dims = [(padded(number()).decode(), number()) for _ in range(number())]
            top = attributes()
            code()
            variables = {}
            for _ in range(number()):
                name = padded(number()).decode()
                ids = [number() for _ in range(number())]
                own, kind, _ = attributes(), NC_TYPES[code()], number()
                begin = struct.unpack(">i" if magic[3] == 1 else ">q", f.read(4 if magic[3] == 1 else 8))[0]
                variables[name] = {"dims": ids, "attributes": own, "kind": np.dtype(kind), "begin": begin}
        return dims, top, variables, records

    @staticmethod
    def _axis(path: str, dims: list, variables: dict, name: str) -> tuple[float, float]:
        n = dict(dims)[name]
        if name not in variables:
            return 0.5, 1.0
        v = variables[name]
        values = np.frombuffer(read_range(path, v["begin"], n * v["kind"].itemsize), v["kind"]).astype(float)
        step = float(values[-1] - values[0]) / (n - 1) if n > 1 else 1.0
        if n > 2 and not np.allclose(np.diff(values), step, rtol=1e-3):
            raise ValueError(f"{path}: axis {name} is not regular")
        return float(values[0]) - abs(step) / 2, step  # centres on disk

    @staticmethod
    def header(path: str) -> Header:
        dims, _, variables, records = NetCdf._contents(path)
        name = next(k for k, v in variables.items() if len(v["dims"]) >= 2 and v["kind"].kind != "S" and not k.endswith(("_bnds", "_bounds")))
        v = variables[name]
        shape = [dims[d][1] or records for d in v["dims"]]
        recorded = dims[v["dims"][0]][1] == 0
        per = int(np.prod(shape[1:])) * v["kind"].itemsize
        # Each record holds one slice of every variable over the record axis, padded to four bytes.
        sizes = [int(np.prod([dims[d][1] for d in u["dims"][1:]])) * u["kind"].itemsize for u in variables.values() if u["dims"] and dims[u["dims"][0]][1] == 0]
        stride = (sizes[0] if len(sizes) == 1 else sum(n + -n % 4 for n in sizes)) if recorded else per
        a = v["attributes"]
        missing = a.get("_FillValue", a.get("missing_value", [None]))[0]
        more = {"begin": v["begin"], "stride": stride, "inner": int(np.prod(shape[1:-2])) if len(shape) > 2 else 1, "scale": a.get("scale_factor", [1.0])[0], "offset": a.get("add_offset", [0.0])[0]}
        x, y = (NetCdf._axis(path, dims, variables, dims[v["dims"][k]][0]) for k in (-1, -2))
        return Header(shape[-1], shape[-2], int(np.prod(shape[:-2])), v["kind"], x, y, missing, name, more=more)

    @staticmethod
    def rows(path: str, h: Header, band: int, low: int, high: int) -> np.ndarray:
        row = h.nx * h.kind.itemsize
        outer, inner = divmod(band, h.more["inner"])
        start = h.more["begin"] + outer * h.more["stride"] + (inner * h.ny + low) * row
        return np.frombuffer(read_range(path, start, (high - low) * row), h.kind).reshape(-1, h.nx)


FORMATS: tuple[type[Format], ...] = (Grd, AsciiGrid, GeoTiff, Zarr, NetCdf)
UNAVAILABLE = {".nc4": "NetCDF 4", ".h5": "HDF5", ".grib": "GRIB", ".grb": "GRIB"}


def format_of(path: str) -> type[Format]:
    """The format of a file by its extension."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    for form in FORMATS:
        if ext in form.extensions:
            return form
    if ext in UNAVAILABLE:
        raise NotImplementedError(f"{UNAVAILABLE[ext]} needs a library that is not installed; convert to Parquet, GRD, GeoTIFF or Zarr")
    raise ValueError(f"no format for {path}")
