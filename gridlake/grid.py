"""Axes and grids: small driver-side descriptors of a cell frame's index columns.

An axis maps integer indices 1..n to coordinates. A regular axis does so by a formula from its own origin, so slices
keep bit-identical coordinates: only ``first`` moves. Irregular axes list coordinates, explicit ones list bounds, and
categorical ones list labels.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, replace
from functools import cached_property
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

COLUMNS = {"X": "xi", "Y": "yi", "Z": "zi", "Ti": "ti", "Band": "band"}
LOCI = {"start": 0.0, "center": 0.5, "end": 1.0}


@dataclass(frozen=True)
class Dim:
    """One axis. Give start and step, or coords, or bounds, or labels, or none of them (bare indices)."""

    name: str
    n: int
    start: float | None = None
    step: float | None = None
    coords: tuple | None = None
    bounds: tuple | None = None
    labels: tuple | None = None
    sampling: str = "points"
    locus: str = "center"
    crs: str | None = None
    mappedcrs: str | None = None
    first: int = 1

    def __post_init__(self):
        if self.locus not in LOCI or self.sampling not in ("points", "intervals"):
            raise ValueError(f"axis {self.name}: locus {self.locus}, sampling {self.sampling}")
        for x in (self.coords, self.bounds, self.labels):
            if x is not None and len(x) != self.n:
                raise ValueError(f"axis {self.name} has {self.n} cells but {len(x)} values")

    @property
    def column(self) -> str:
        return COLUMNS.get(self.name, self.name.lower())

    @property
    def regular(self) -> bool:
        return self.start is not None

    @property
    def order(self) -> str:
        if self.regular:
            return "forward" if self.step > 0 else "reverse"
        x = self.coords
        if x is None or self.labels is not None:
            return "unordered" if self.labels is not None else "forward"
        pairs = list(zip(x, x[1:], strict=False))
        return "forward" if all(a < b for a, b in pairs) else "reverse" if all(a > b for a, b in pairs) else "unordered"

    def coord(self, i: int) -> Any:
        if self.regular:
            return self.start + (self.first + i - 2) * self.step
        for x in (self.labels, self.coords):
            if x is not None:
                return x[i - 1]
        if self.bounds is not None:
            return sum(self.bounds[i - 1]) / 2
        return self.first + i - 1

    def values(self) -> list:
        return [self.coord(i) for i in range(1, self.n + 1)]

    def interval(self, i: int) -> tuple:
        """Lower and upper bound of cell i. Irregular cells reach half-way to their neighbours."""
        if self.bounds is not None:
            return tuple(self.bounds[i - 1])
        if self.regular:
            low = self.coord(i) - LOCI[self.locus] * abs(self.step)
            return low, low + abs(self.step)
        return tuple(sorted(self._edges[i - 1 : i + 1]))

    @cached_property
    def _edges(self) -> list:
        """Edges of an irregular axis, computed once."""
        x = self.values()
        near = [(a + b) / 2 for a, b in zip(x, x[1:], strict=False)]
        return [x[0] - (near[0] - x[0]), *near, x[-1] + (x[-1] - near[-1])] if near else [x[0], x[0]]

    @property
    def origin(self) -> float:
        """The outer edge of cell 1 on a regular axis: its lower bound, or on a reversed axis its upper."""
        return self.interval(1)[0 if self.step > 0 else 1]

    def extent(self) -> tuple:
        """Least and greatest coordinate, cell edges included for intervals."""
        ends = [self.interval(i) if self.sampling == "intervals" or self.bounds else (self.coord(i),) for i in (1, self.n)]
        flat = [v for e in ends for v in e]
        return min(flat), max(flat)

    # Columns of a cell frame.

    def coord_column(self) -> Column:
        i = F.col(self.column)
        if self.regular:
            return F.lit(float(self.start)) + (i + F.lit(self.first - 2)) * F.lit(float(self.step))
        if self.coords is None and self.labels is None and self.bounds is None:
            return i + F.lit(self.first - 1)
        return F.element_at(F.array(*(F.lit(v) for v in self.values())), i.cast("int"))

    def bounds_columns(self) -> tuple[Column, Column]:
        if self.regular:
            low = F.lit(self.origin) + (F.col(self.column) - 1) * F.lit(float(self.step))
            return F.least(low, low + float(self.step)), F.greatest(low, low + float(self.step))
        table = [self.interval(i) for i in range(1, self.n + 1)]
        pick = lambda k: F.element_at(F.array(*(F.lit(b[k]) for b in table)), F.col(self.column).cast("int"))
        return pick(0), pick(1)

    def index_column(self, value: Column, atol: float = 0.0) -> Column:
        """The cell of a coordinate on a regular axis: containing cell of intervals, equal point of points; else null."""
        if not self.regular:
            raise ValueError(f"axis {self.name} is not regular; use a range join")
        if self.sampling == "intervals":
            up = (value - F.lit(self.origin)) / F.lit(float(self.step))
            i = F.floor(up) + 1 if self.step > 0 else F.ceil(up)  # cells are [low, high)
        else:
            i = F.round((value - F.lit(float(self.coord(1)))) / F.lit(float(self.step))) + 1
            at = F.lit(float(self.start)) + (i + F.lit(self.first - 2)) * F.lit(float(self.step))
            slack = max(atol, 8 * math.ulp(max(abs(self.coord(1)), abs(self.coord(self.n)), abs(self.step))))
            i = F.when(F.abs(at - value) <= F.lit(slack), i)
        return F.when((i >= 1) & (i <= self.n), i.cast("int"))

    # Changes of the axis.

    def slice(self, low: int, high: int) -> Dim:
        if not 1 <= low <= high <= self.n:
            raise IndexError(f"axis {self.name}: {low}..{high} is not in 1..{self.n}")
        cut = lambda x: None if x is None else tuple(x[low - 1 : high])
        return replace(self, n=high - low + 1, first=self.first + low - 1, coords=cut(self.coords), bounds=cut(self.bounds), labels=cut(self.labels))

    def reverse(self) -> Dim:
        if self.regular:
            return replace(self, start=self.coord(self.n), step=-self.step, first=1)
        back = lambda x: None if x is None else tuple(reversed(x))
        return replace(self, coords=back(self.coords), bounds=back(self.bounds), labels=back(self.labels))

    def offset(self, locus: str, scale: int) -> int:
        """Which cell of a block of ``scale`` holds its start, center or end."""
        if locus == "center":
            return math.ceil((scale - 1) / 2)
        return 0 if (locus == "start") == (self.order != "reverse") else scale - 1

    def aggregate(self, scale: int, locus: str | None = None) -> Dim:
        """The axis of blocks of ``scale`` cells; a remainder of cells is dropped, the extent of the rest is kept."""
        locus, scale = locus or self.locus, min(scale, self.n)
        n = self.n // scale
        if self.labels is not None or self.order == "unordered":
            return Dim(self.name, n)
        if self.regular and self.locus == "center":
            return replace(self, n=n, start=self.coord(1) + (scale - 1) / 2 * self.step, step=self.step * scale, first=1)
        k = self.offset(self.locus if self.regular else locus, scale)
        if self.regular:
            return replace(self, n=n, start=self.coord(1 + k), step=self.step * scale, first=1)
        pick = lambda x: None if x is None else tuple(x[k : n * scale : scale])
        bounds = None if self.bounds is None else tuple((self.bounds[j * scale][0], self.bounds[j * scale + scale - 1][1]) for j in range(n))
        return replace(self, n=n, coords=pick(self.coords), bounds=bounds)

    def disaggregate(self, scale: int) -> Dim:
        if scale == 1 or not self.regular:
            return self if scale == 1 else Dim(self.name, self.n * scale)
        step = self.step / scale
        if self.locus == "center":
            start = self.coord(1) - (scale - 1) / 2 * step
        else:  # the coordinate of cell 1 is that of its first or last part
            start = self.coord(1) - self.offset(self.locus, scale) * step
        return replace(self, n=self.n * scale, start=start, step=step, first=1)

    def shifted(self, locus: str) -> Dim:
        """The same intervals under another locus."""
        if not self.regular:
            raise ValueError(f"axis {self.name} is not regular")
        return replace(self, start=self.coord(1) + (LOCI[locus] - LOCI[self.locus]) * abs(self.step), first=1, locus=locus)


@dataclass(frozen=True)
class Grid:
    """The axes of a cell frame, X first, and positions along axes that were sliced away."""

    dims: tuple[Dim, ...]
    refdims: tuple[tuple[str, Any], ...] = ()

    def __getitem__(self, name: str) -> Dim:
        for d in self.dims:
            if d.name == name:
                return d
        raise KeyError(f"no axis {name}; there are {[d.name for d in self.dims]}")

    def __contains__(self, name: str) -> bool:
        return any(d.name == name for d in self.dims)

    @property
    def columns(self) -> list[str]:
        return [d.column for d in self.dims]

    @property
    def size(self) -> int:
        return math.prod(d.n for d in self.dims)

    @property
    def crs(self) -> str | None:
        return next((d.crs for name in ("Y", "X") if name in self for d in [self[name]] if d.crs), None)

    @property
    def mappedcrs(self) -> str | None:
        return next((d.mappedcrs for name in ("Y", "X") if name in self for d in [self[name]] if d.mappedcrs), None)

    def with_dim(self, dim: Dim) -> Grid:
        return replace(self, dims=tuple(dim if d.name == dim.name else d for d in self.dims))

    def without(self, name: str, position: Any = None) -> Grid:
        return Grid(tuple(d for d in self.dims if d.name != name), (*self.refdims, (name, position)))

    def with_crs(self, crs: str | None = None, mappedcrs: str | None = None) -> Grid:
        """Set the axes' coordinate reference systems; cells do not change."""
        new = lambda d: replace(d, crs=crs or d.crs, mappedcrs=mappedcrs or d.mappedcrs) if d.name in ("X", "Y") else d
        return replace(self, dims=tuple(new(d) for d in self.dims))

    def extent(self) -> dict[str, tuple]:
        return {d.name: d.extent() for d in self.dims if d.labels is None}

    def to_json(self) -> str:
        return json.dumps({"dims": [asdict(d) for d in self.dims], "refdims": self.refdims}, default=str)

    @classmethod
    def from_json(cls, text: str) -> Grid:
        tuples = lambda x: tuple(tuple(v) if isinstance(v, list) else v for v in x) if isinstance(x, list) else x
        found = json.loads(text)
        return cls(tuple(Dim(**{k: tuples(v) for k, v in d.items()}) for d in found["dims"]), tuples(found["refdims"]))

    @classmethod
    def from_extent(cls, extent: dict[str, tuple[float, float]], res: float | Sequence[float] | None = None, size: int | Sequence[int] | None = None, sampling: str = "intervals", locus: str = "start", crs: str | None = None) -> Grid:
        """A regular grid over an extent, by cell size or by number of cells (not both)."""
        if (res is None) == (size is None):
            raise ValueError("give either res or size")
        names = list(extent)
        each = lambda v: list(v) if isinstance(v, Sequence) else [v] * len(names)
        dims = []
        for k, name in enumerate(names):
            low, high = extent[name]
            if size is not None:
                n = each(size)[k]
                step = (high - low) / (n if sampling == "intervals" else max(n - 1, 1))
            else:
                step = each(res)[k]
                n = max(1, math.ceil((high - low) / step - 1e-9)) if sampling == "intervals" else math.floor((high - low) / step + 1e-9) + 1
            start = low + LOCI[locus] * step if sampling == "intervals" else low
            dims.append(Dim(name, n, start, step, sampling=sampling, locus=locus if sampling == "intervals" else "center", crs=crs))
        return cls(tuple(dims))

    def union(self, other: Grid, atol: float = 0.0) -> Grid:
        """The grid that covers both; regular axes must have one step and be aligned, up to atol."""
        return Grid(tuple(union_dim(a, other[a.name], atol) for a in self.dims), self.refdims)


def union_dim(a: Dim, b: Dim, atol: float = 0.0) -> Dim:
    if a.regular and b.regular:
        if not math.isclose(a.step, b.step, rel_tol=1e-9):
            raise ValueError(f"axis {a.name}: steps {a.step} and {b.step} differ")
        shift = (b.coord(1) - a.coord(1)) / a.step
        if abs(shift - round(shift)) > max(1e-6, atol / abs(a.step)):
            raise ValueError(f"axis {a.name}: the grids are not aligned")
        low, high = min(0, round(shift)), max(a.n, round(shift) + b.n)
        return replace(a, n=high - low, first=a.first + low)
    if a.labels is not None:
        labels = tuple(dict.fromkeys((*a.labels, *b.labels)))
        return replace(a, n=len(labels), labels=labels)
    if a.bounds is not None:
        bounds = tuple(sorted({*map(tuple, a.bounds), *map(tuple, b.bounds)}))
        return replace(a, n=len(bounds), bounds=bounds, coords=None)
    if a.coords is not None:
        if "unordered" in (a.order, b.order):
            raise ValueError(f"axis {a.name} is unordered")
        coords = tuple(sorted({*a.values(), *b.values()}, reverse=a.order == "reverse"))
        return replace(a, n=len(coords), coords=coords)
    return replace(a, n=max(a.n, b.n))


# Selectors (F1-F8). Each gives the indices that it takes on an axis.


class Selector:
    def indices(self, d: Dim) -> range | list[int]:
        raise NotImplementedError

    def mapped(self, f: Callable) -> Selector:
        """The same selector with its values passed through f."""
        return self


@dataclass(frozen=True)
class At(Selector):
    """The cell whose coordinate equals the value, within atol; an error if there is none."""

    value: Any
    atol: float = 0.0

    def indices(self, d: Dim) -> list[int]:
        if d.regular:
            i = round((self.value - d.coord(1)) / d.step) + 1
            slack = max(self.atol, 8 * math.ulp(max(abs(d.start), abs(self.value), abs(d.step))))
            if 1 <= i <= d.n and abs(d.coord(i) - self.value) <= slack:
                return [i]
        else:
            for i, v in enumerate(d.values(), 1):
                if v == self.value or (self.atol and abs(v - self.value) <= self.atol):
                    return [i]
        raise KeyError(f"axis {d.name} has no coordinate {self.value}")

    def mapped(self, f: Callable) -> At:
        return replace(self, value=f(self.value))


@dataclass(frozen=True)
class Near(Selector):
    """The cell with the nearest coordinate; of two as near, the one with the lower index."""

    value: Any

    def indices(self, d: Dim) -> list[int]:
        if d.regular:
            i = min(d.n, max(1, math.ceil((self.value - d.coord(1)) / d.step + 0.5)))
            return [i]
        return [min(range(1, d.n + 1), key=lambda i: (abs(d.coord(i) - self.value), i))]

    def mapped(self, f: Callable) -> Near:
        return Near(f(self.value))


@dataclass(frozen=True)
class Contains(Selector):
    """The cell whose interval [low, high) holds the value; an error if there is none."""

    value: Any

    def indices(self, d: Dim) -> list[int]:
        if d.regular:
            up = (self.value - d.origin) / d.step
            i = math.floor(up) + 1 if d.step > 0 else math.ceil(up)
            if 1 <= i <= d.n:
                return [i]
        else:
            for i in range(1, d.n + 1):
                low, high = d.interval(i)
                if low <= self.value < high:
                    return [i]
        raise KeyError(f"axis {d.name} has no cell with {self.value}")

    def mapped(self, f: Callable) -> Contains:
        return Contains(f(self.value))


@dataclass(frozen=True)
class Between(Selector):
    """Points from low to high, both included; of intervals, the cells that lie wholly inside."""

    low: Any
    high: Any

    def indices(self, d: Dim) -> list[int]:
        if d.sampling == "points" and d.bounds is None:
            return [i for i in range(1, d.n + 1) if self.low <= d.coord(i) <= self.high]
        return [i for i in range(1, d.n + 1) for lo, hi in [d.interval(i)] if lo >= self.low and hi <= self.high]

    def mapped(self, f: Callable) -> Between:
        return Between(*sorted((f(self.low), f(self.high))))


@dataclass(frozen=True)
class Touches(Selector):
    """Cells whose interval meets [low, high]; a shared edge counts."""

    low: Any
    high: Any

    def indices(self, d: Dim) -> list[int]:
        if d.sampling == "points" and d.bounds is None:
            return Between(self.low, self.high).indices(d)
        return [i for i in range(1, d.n + 1) for lo, hi in [d.interval(i)] if hi >= self.low and lo <= self.high]

    def mapped(self, f: Callable) -> Touches:
        return Touches(*sorted((f(self.low), f(self.high))))


@dataclass(frozen=True)
class Where(Selector):
    """Cells whose coordinate satisfies a predicate."""

    predicate: Callable[[Any], bool]

    def indices(self, d: Dim) -> list[int]:
        return [i for i in range(1, d.n + 1) if self.predicate(d.coord(i))]


@dataclass(frozen=True)
class Not(Selector):
    """All cells but those of another selector."""

    other: Any

    def indices(self, d: Dim) -> list[int]:
        gone = set(select_indices(d, self.other))
        return [i for i in range(1, d.n + 1) if i not in gone]


def select_indices(d: Dim, sel: Any) -> range | list[int]:
    """Indices for a selector, an int, a range or slice (both 1-based, ends included), or a list of these."""
    if isinstance(sel, Selector):
        return sel.indices(d)
    if isinstance(sel, bool):
        raise TypeError("a bool is no index")
    if isinstance(sel, int):
        if not 1 <= sel <= d.n:
            raise IndexError(f"axis {d.name}: {sel} is not in 1..{d.n}")
        return [sel]
    if isinstance(sel, slice):
        low, high = sel.start or 1, sel.stop or d.n
        d.slice(low, high)
        return range(low, high + 1)
    if isinstance(sel, range):
        return sel
    return [i for x in sel for i in select_indices(d, x)]
