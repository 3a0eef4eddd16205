"""GeoTIFF (.tif): strips or tiles; plain, deflate or zstd; classic and BigTIFF; reference systems by EPSG code.

A strip is a block as wide as the raster, so both layouts are read the same way, block by block and by range. Writing
makes compressed tiles on the executors; the driver only appends their bytes to the file. A tile without cells takes no
space (offset and size 0).
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from ..cells import Cells
from .files import Format, Header, open_file

# Fixed values of the format: struct codes by field type, compressions, sample formats.
FIELDS = {1: "B", 2: "s", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}
PLAIN, DEFLATE, OLD_DEFLATE, ZSTD = 1, 8, 32946, 50000
SAMPLES = {1: "u", 2: "i", 3: "f"}
USER_DEFINED = 32767
GEOGRAPHIC = range(4001, 5000)
TILE = 256
CLASSIC_BYTES = 4_000_000_000


def _tags(path: str) -> tuple[str, dict]:
    """Byte order and tags of the first directory."""
    with open_file(path) as f:
        head = f.read_at(16, 0)
        end = {b"II": "<", b"MM": ">"}.get(head[:2], "")
        version = struct.unpack(end + "H", head[2:4])[0] if end else 0
        if version not in (42, 43):
            raise ValueError(f"{path} is no TIFF")
        wide = version == 43
        at = struct.unpack(end + ("Q" if wide else "I"), head[8:16] if wide else head[4:8])[0]
        count, entry, inline = ("Q", "HHQ8s", 8) if wide else ("H", "HHI4s", 4)
        n = struct.unpack(end + count, f.read_at(struct.calcsize(end + count), at))[0]
        at, size, tags = at + struct.calcsize(end + count), struct.calcsize(end + entry), {}
        for k in range(n):
            tag, kind, length, value = struct.unpack(end + entry, f.read_at(size, at + size * k))
            if kind not in FIELDS:
                continue
            bytes_ = length * struct.calcsize(end + FIELDS[kind])
            data = value[:bytes_] if bytes_ <= inline else f.read_at(bytes_, struct.unpack(end + ("Q" if wide else "I"), value)[0])
            tags[tag] = data if kind == 2 else np.frombuffer(data, end + FIELDS[kind].replace("B", "u1").replace("H", "u2").replace("I", "u4").replace("Q", "u8"))
    return end, tags


def _system(keys: np.ndarray | None) -> tuple[str | None, bool]:
    """The reference system's name, and whether places are of cell centres."""
    found = {int(keys[k]): int(keys[k + 3]) for k in range(4, len(keys), 4) if keys[k + 1] == 0} if keys is not None else {}
    code = found.get(3072, found.get(2048))
    return (f"EPSG:{code}" if code and code != USER_DEFINED else None), found.get(1025) == 2


def _plain_bytes(data: bytes, compression: int, size: int) -> bytes:
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    return pa.Codec("zstd").decompress(data, size).to_pybytes() if compression == ZSTD else data


def _unpredicted(block: bytes, predictor: int, shape: tuple[int, int, int], kind: np.dtype) -> np.ndarray:
    """A block's values: as they are (1), differences along a row (2), or differences of byte planes (3)."""
    if predictor == 3:
        rows, columns, samples = shape
        planes = np.cumsum(np.frombuffer(block, np.uint8).reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, -1)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(shape)
    values = np.frombuffer(block, kind).reshape(shape)
    if predictor == 2:
        whole = np.dtype(f"u{kind.itemsize}")
        return np.cumsum(values.view(whole.newbyteorder(kind.byteorder)), axis=1, dtype=whole).view(kind.newbyteorder("="))
    return values


class GeoTiff(Format):
    """One file, north up. Compressions that need a library that is not here raise."""

    name, extensions = "gridlake_tif", (".tif", ".tiff")

    @staticmethod
    def header(path: str) -> Header:
        end, tags = _tags(path)
        one = lambda tag, default: int(tags[tag][0]) if tag in tags else default
        nx, ny, bands, compression = one(256, 0), one(257, 0), one(277, 1), one(259, PLAIN)
        if compression not in (PLAIN, DEFLATE, OLD_DEFLATE, ZSTD):
            raise NotImplementedError(f"{path}: compression {compression} needs a library that is not installed")
        if 33550 not in tags or 33922 not in tags:
            raise ValueError(f"{path} has no scale and tie point")
        kind = np.dtype(end + SAMPLES[one(339, 1)] + str(one(258, 1) // 8))
        tiled = 322 in tags
        crs, centred = _system(tags.get(34735))
        (sx, sy), (i, j, _, x, y) = tags[33550][:2].tolist(), tags[33922][:5].tolist()
        half = 0.5 if centred else 0.0
        left, top = x - (i + half) * sx, y + (j + half) * sy
        more = {
            "offsets": tags[324 if tiled else 273], "sizes": tags[325 if tiled else 279], "compression": compression, "predictor": one(317, 1), "bands": bands,
            "columns": one(322, nx), "rows": one(323, ny) if tiled else min(ny, one(278, ny)), "tiled": tiled, "mixed": one(284, 1) == 1 and bands > 1,
        }
        text = tags[42113].split(b"\0")[0].strip() if 42113 in tags else b""
        return Header(nx, ny, bands, kind, (left, sx), (top - sy, -sy), float(text) if text else None, crs=crs, more=more)

    @staticmethod
    def rows(path: str, h: Header, band: int, low: int, high: int) -> np.ndarray:
        m = h.more
        bw, bh = m["columns"], m["rows"]
        across, down, samples = -(-h.nx // bw), -(-h.ny // bh), h.bands if m["mixed"] else 1
        out = np.empty((high - low, h.nx), h.kind.newbyteorder("="))
        with open_file(path) as f:
            for j in range(low // bh, -(-high // bh)):
                height = bh if m["tiled"] else min(bh, h.ny - j * bh)
                a, b = max(low, j * bh), min(high, (j + 1) * bh)
                for i in range(across):
                    at = i + across * (j + (0 if m["mixed"] else band * down))
                    left, right = i * bw, min(h.nx, (i + 1) * bw)
                    if not m["sizes"][at]:
                        out[a - low : b - low, left:right] = 0 if h.missing is None else h.missing
                        continue
                    shape, row = (height, bw, samples), bw * samples * h.kind.itemsize
                    if m["compression"] == PLAIN and m["predictor"] == 1:  # only the rows that are asked for
                        data, first = f.read_at((b - a) * row, int(m["offsets"][at]) + (a - j * bh) * row), a
                        shape = (b - a, bw, samples)
                    else:
                        data, first = _plain_bytes(f.read_at(int(m["sizes"][at]), int(m["offsets"][at])), m["compression"], height * row), j * bh
                    block = _unpredicted(data, m["predictor"], shape, h.kind)
                    out[a - low : b - low, left:right] = block[a - first : b - first, : right - left, band if m["mixed"] else 0]
        return out

    @staticmethod
    def write(cells: Cells, path: str, layer: str | None = None, missing: float = -9999.0, kind: str = "f8", tile: int = TILE) -> None:
        """Tiles of 256 by 256 cells, deflated. A task holds one tile at a time."""
        layer = layer or cells.layers[0]
        x, y = cells.grid["X"], cells.grid["Y"]
        bands = cells.grid["Band"].n if "Band" in cells.grid else 1
        across, down = -(-x.n // tile), -(-y.n // tile)
        column = F.col("xi") - 1 if x.step > 0 else x.n - F.col("xi")
        row = y.n - F.col("yi") if y.step > 0 else F.col("yi") - 1
        band = F.col(cells.grid["Band"].column) - 1 if bands > 1 else F.lit(0)
        at = cells[layer].sparse().df.select(column.alias("_c"), row.alias("_r"), band.cast("long").alias("_b"), F.col(layer).alias("_v"))
        number = (F.col("_b") * down + F.floor(F.col("_r") / tile)) * across + F.floor(F.col("_c") / tile)
        at = at.select(number.cast("long").alias("tile"), (F.col("_r") % tile).alias("r"), (F.col("_c") % tile).alias("c"), "_v")
        tiles = at.groupBy("tile").applyInPandas(_deflated(tile, np.dtype("<" + kind), missing), "tile long, data binary")
        kind_ = np.dtype("<" + kind)
        offsets, sizes = np.zeros((2, bands * across * down), np.uint64)
        tiles = at.groupBy("tile").applyInPandas(_deflated(tile, kind_, missing), "tile long, data binary")
        # Classic files hold 4 GB; what may become larger, with all tiles and not compressed, is BigTIFF.
        wide = len(offsets) * (tile * tile * kind_.itemsize + 16) > CLASSIC_BYTES
        with open(path, "wb") as f:
            f.write(bytes(16))
            for r in tiles.toLocalIterator():
                offsets[r.tile], sizes[r.tile] = f.tell(), len(r.data)
                f.write(r.data)
            f.write(bytes(-f.tell() % 8))
            start = f.tell()
            f.write(_directory(cells, bands, kind_, missing, tile, offsets, sizes, wide, start))
            f.seek(0)
            f.write(b"II" + (struct.pack("<HHHQ", 43, 8, 0, start) if wide else struct.pack("<HI", 42, start)))


def _deflated(tile: int, kind: np.dtype, missing: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A tile's cells as the deflated bytes of its square."""

    def block(cells: pd.DataFrame) -> pd.DataFrame:
        square = np.full((tile, tile), missing, kind)
        square[cells["r"].to_numpy(), cells["c"].to_numpy()] = cells["_v"].to_numpy()
        return pd.DataFrame({"tile": cells["tile"].iloc[:1], "data": [zlib.compress(square.tobytes())]})

    return block


def _directory(cells: Cells, bands: int, kind: np.dtype, missing: float, tile: int, offsets: np.ndarray, sizes: np.ndarray, wide: bool, start: int) -> bytes:
    """The directory that stands at a place of the file, with the values that do not fit in its entries after it."""
    x, y = cells.grid["X"], cells.grid["Y"]
    place = "u8" if wide else "u4"
    sample = next(code for code, letter in SAMPLES.items() if letter == kind.kind)
    found: dict[int, np.ndarray | bytes] = {
        256: np.array([x.n], "<u4"), 257: np.array([y.n], "<u4"), 258: np.full(bands, kind.itemsize * 8, "<u2"), 259: np.array([DEFLATE], "<u2"), 262: np.array([1], "<u2"),
        277: np.array([bands], "<u2"), 284: np.array([2 if bands > 1 else 1], "<u2"), 322: np.array([tile], "<u4"), 323: np.array([tile], "<u4"),
        324: offsets.astype("<" + place), 325: sizes.astype("<" + place), 339: np.full(bands, sample, "<u2"),
        33550: np.array([abs(x.step), abs(y.step), 0.0]), 33922: np.array([0.0, 0.0, 0.0, x.extent()[0], y.extent()[1], 0.0]), 42113: repr(missing).encode() + b"\0",
    }
    code = re.fullmatch(r"EPSG:(\d+)", cells.grid.crs or "")
    if code:
        geographic = int(code[1]) in GEOGRAPHIC
        keys = [1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, int(code[1])]
        found[34735] = np.array([1, 1, 0, 3, *keys], "<u2")
    codes = {"u2": 3, "u4": 4, "u8": 16, "f8": 12}
    inline, entry = (8, "<HHQ8s") if wide else (4, "<HHI4s")
    head = struct.pack("<Q" if wide else "<H", len(found))
    after = start + len(head) + len(found) * struct.calcsize(entry) + inline
    entries, extra = [], b""
    for tag in sorted(found):
        v = found[tag]
        data, kind_, n = (v, 2, len(v)) if isinstance(v, bytes) else (v.tobytes(), codes[v.dtype.str[1:]], len(v))
        if len(data) > inline:
            where = struct.pack("<Q" if wide else "<I", after + len(extra))
            extra += data + bytes(-len(data) % 8)
            data = where
        entries.append(struct.pack(entry, tag, kind_, n, data))
    return head + b"".join(entries) + bytes(inline) + extra
