"""Coordinate transforms in closed form, for systems whose axes are independent of each other.

EPSG:4326 (degrees), EPSG:3857 (spherical Mercator) and EPSG:6933 (cylindrical equal area on WGS 84, standard parallel
30 degrees). Each axis has a forward function from degrees and one back, for numbers and for columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from types import SimpleNamespace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS 84.
A = 6378137.0
FLAT = 1 / 298.257223563
E2 = FLAT * (2 - FLAT)
E = math.sqrt(E2)
_K0 = math.cos(math.radians(30)) / math.sqrt(1 - E2 * math.sin(math.radians(30)) ** 2)

_numbers = SimpleNamespace(sin=math.sin, log=math.log, tan=math.tan, atan=math.atan, exp=math.exp, asin=math.asin)
_columns = SimpleNamespace(sin=F.sin, log=F.ln, tan=F.tan, atan=F.atan, exp=F.exp, asin=F.asin)


def _math(v: Any) -> SimpleNamespace:
    return _columns if isinstance(v, Column) else _numbers


def _q(m: SimpleNamespace, sine: Any) -> Any:
    """The authalic function of a latitude's sine on the ellipsoid."""
    return (1 - E2) * (sine / (1 - E2 * sine * sine) - 1 / (2 * E) * m.log((1 - E * sine) / (1 + E * sine)))


_QP = _q(_numbers, 1.0)


def _cea_back(y: Any) -> Any:
    m = _math(y)
    beta = m.asin(2 * y * _K0 / (A * _QP))
    e4, e6 = E2 * E2, E2**3
    series = (E2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * m.sin(2 * beta) + (23 * e4 / 360 + 251 * e6 / 3780) * m.sin(4 * beta) + 761 * e6 / 45360 * m.sin(6 * beta)
    return (beta + series) * (180 / math.pi)


_RAD = math.pi / 180
FORWARD: dict[str, dict[str, Callable]] = {
    "EPSG:4326": {"X": lambda v: v, "Y": lambda v: v},
    "EPSG:3857": {"X": lambda v: v * (_RAD * A), "Y": lambda v: _math(v).log(_math(v).tan(v * (_RAD / 2) + math.pi / 4)) * A},
    "EPSG:6933": {"X": lambda v: v * (_RAD * A * _K0), "Y": lambda v: _q(_math(v), _math(v).sin(v * _RAD)) * (A / (2 * _K0))},
}
BACK: dict[str, dict[str, Callable]] = {
    "EPSG:4326": {"X": lambda v: v, "Y": lambda v: v},
    "EPSG:3857": {"X": lambda v: v * (1 / (_RAD * A)), "Y": lambda v: (_math(v).atan(_math(v).exp(v * (1 / A))) * 2 - math.pi / 2) * (180 / math.pi)},
    "EPSG:6933": {"X": lambda v: v * (1 / (_RAD * A * _K0)), "Y": _cea_back},
}
DEGREES = {"EPSG:4326"}


def axis_transform(axis: str, source: str, target: str) -> Callable:
    """The function that takes one axis's values from source to target."""
    for code in (source, target):
        if code not in FORWARD:
            raise ValueError(f"{code} has no axis-separable closed form here; there are {sorted(FORWARD)}")
    if axis not in ("X", "Y"):
        return lambda v: v
    return lambda v: FORWARD[target][axis](BACK[source][axis](v))
