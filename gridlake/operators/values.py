"""Value transforms (V1-V13): missing values, masks of presence, classes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cells import Cells


def replace_missing(cells: Cells, value: Any = None, kind: str | None = None) -> Cells:
    """V3: missing cells get a value (dense); without one they become null. kind: the promoted SQL type."""
    if value is None:
        mv = cells.missingval
        return cells if mv is None else cells.map(lambda v: F.when(~(F.isnan(v.cast("double")) if mv != mv else v == F.lit(mv)), v))
    return cells.dense().map(lambda v: F.coalesce(v.cast(kind) if kind else v, F.lit(value).cast(kind) if kind else F.lit(value)))


def boolmask(cells: Cells, invert: bool = False, alllayers: bool = True) -> Cells:
    """True where the first layer, or all layers, have a value; every cell has a row."""
    layers = cells.layers if alllayers else cells.layers[:1]
    present = reduce(lambda a, b: a & b, (F.col(x).isNotNull() for x in layers))
    return cells.of(cells.dense().df.withColumn("mask", ~present if invert else present), layers=["mask"])


def missingmask(cells: Cells, invert: bool = False, alllayers: bool = True) -> Cells:
    """V6: true or null."""
    return boolmask(cells, invert, alllayers).map(lambda v: F.when(v, True))


def _test(find: Any, lower: Callable[[Column, Any], Column], upper: Callable[[Column, Any], Column]) -> Callable[[Column], Column]:
    if callable(find):
        return find
    if isinstance(find, tuple):
        if all(callable(f) for f in find):
            return lambda v: reduce(lambda a, b: a & b, (f(v) for f in find))
        return lambda v: lower(v, find[0]) & upper(v, find[1])
    return lambda v: v == F.lit(find)


def classify(
    cells: Cells, pairs: Sequence[tuple[Any, Any]] | Sequence[Sequence[float]], lower: Callable = lambda v, x: v >= x, upper: Callable = lambda v, x: v < x, others: Any = None, missing: Any = None,
) -> Cells:
    """V1: the first pair whose test holds gives the value. A test is a number (numeric equality), a (low, high) tuple, a
    predicate, or a tuple of predicates; rows of two or three numbers are (find, value) or (low, high, value). Missing
    cells become ``missing``; cells that no pair fits become ``others``, or stay."""
    rules = [((r[0], r[1]), r[2]) if len(r) == 3 else (r[0], r[1]) for r in pairs]

    def one(v: Column) -> Column:
        out = F.when(v.isNull(), F.lit(missing))
        for find, value in rules:
            out = out.when(_test(find, lower, upper)(v), F.lit(value))
        return out.otherwise(v if others is None else F.lit(others))

    return cells.map(one)


def modify(cells: Cells, f: Callable, schema: str) -> Cells:
    """V9: pass the frame through mapInPandas; f must keep the cells."""
    return cells.of(cells.df.mapInPandas(f, schema))


def same(a: Cells, b: Cells) -> bool:
    """Equal sizes and equal cells."""
    if a.grid.size != b.grid.size or a.columns != b.columns:
        return False
    left, right = a.sparse().df, b.sparse().df
    return left.exceptAll(right).limit(1).count() == 0 and right.exceptAll(left).limit(1).count() == 0


def scaled(df: DataFrame, layer: str, scale: float = 1.0, offset: float = 0.0, missingval: Any = None, raw: bool = False) -> DataFrame:
    """Stored values to values, x * scale + offset, with the sentinel as null. raw leaves them as they are."""
    if raw:
        return df
    v = F.col(layer)
    present = v if missingval is None else F.when(~(F.isnan(v) if missingval != missingval else v == F.lit(missingval)), v)
    return df.withColumn(layer, present if scale == 1 and offset == 0 else present * F.lit(scale) + F.lit(offset))


def unscaled(df: DataFrame, layer: str, scale: float = 1.0, offset: float = 0.0, missingval: Any = None, kind: str = "int", coerce: str = "round") -> DataFrame:
    """Values to stored values. coerce: round, trunc, or convert, which fails on inexact values."""
    x = (F.col(layer) - F.lit(offset)) / F.lit(scale)
    if coerce == "convert":
        whole = F.when((x == F.floor(x)) | x.isNull(), x).otherwise(F.raise_error(F.lit(f"{layer}: inexact value")).cast("double"))
    else:
        whole = F.rint(x) if coerce == "round" else F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
    return df.withColumn(layer, F.coalesce(whole.cast(kind), F.lit(missingval).cast(kind)))
