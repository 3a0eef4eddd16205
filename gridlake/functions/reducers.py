"""Reducers by name: Column builders for grouped cells, with the rules for missing values and order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reducer:
    """build(value, order) gives the aggregate; empty is its result where nothing was reduced."""

    build: Callable[[Column, Column | None], Column]
    needs_order: bool = False
    empty: object = None


REDUCERS: dict[str, Reducer] = {
    "sum": Reducer(lambda v, o: F.sum(v)),
    "prod": Reducer(lambda v, o: F.product(v)),
    "mean": Reducer(lambda v, o: F.avg(v)),
    "min": Reducer(lambda v, o: F.min(v)),
    "max": Reducer(lambda v, o: F.max(v)),
    "median": Reducer(lambda v, o: F.median(v)),
    "mode": Reducer(lambda v, o: F.mode(v, True)),
    "std": Reducer(lambda v, o: F.stddev_samp(v)),
    "var": Reducer(lambda v, o: F.var_samp(v)),
    "count": Reducer(lambda v, o: F.count(v), empty=0),
    "length": Reducer(lambda v, o: F.count(v), empty=0),
    "any": Reducer(lambda v, o: F.bool_or(v)),
    "all": Reducer(lambda v, o: F.bool_and(v)),
    "first": Reducer(lambda v, o: F.min_by(v, F.when(v.isNotNull(), o)), needs_order=True),
    "last": Reducer(lambda v, o: F.max_by(v, F.when(v.isNotNull(), o)), needs_order=True),
    "q1": Reducer(lambda v, o: F.percentile(v, 0.25)),
    "q3": Reducer(lambda v, o: F.percentile(v, 0.75)),
    "rms": Reducer(lambda v, o: F.sqrt(F.avg(v * v))),
    "vcat": Reducer(lambda v, o: F.transform(F.array_sort(F.collect_list(F.when(v.isNotNull(), F.struct(o.alias("o"), v.alias("v"))))), lambda s: s["v"]), needs_order=True),
}


def reduce_column(reducer: str | Callable[[Column], Column], value: Column, order: Column | None = None) -> Column:
    """The aggregate of a named reducer, or of any function from a column to an aggregate (a grouped pandas UDF too)."""
    if callable(reducer):
        return reducer(value)
    if reducer not in REDUCERS:
        raise ValueError(f"no reducer {reducer}; there are {sorted(REDUCERS)}")
    r = REDUCERS[reducer]
    if r.needs_order and order is None:
        raise ValueError(f"{reducer} needs an order")
    return r.build(value, order)


def fold(value: Column, order: Column, op: Callable[[Column, Column], Column], init: Column) -> Column:
    """Fold values by any binary op in order; for ops that are not commutative. The values of a group come together."""
    pairs = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v")))))
    return F.aggregate(pairs, init, lambda a, s: op(a, s["v"]))
