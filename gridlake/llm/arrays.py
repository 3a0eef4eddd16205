"""Array expressions that Spark lacks, in linear time: local names, running folds, spans of matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 128  # a fold that appends copies what it has, so none appends more than this to one array


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(x: Column, step: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each entry of x the fold of those before it. Folds go by chunks, and over the chunks in the same way; step must
    be associative and zero its neutral value."""

    def fold(part: Column, begin: Column) -> Column:
        kind = F.slice(F.array(begin), 1, 0)
        more = lambda acc, v: F.struct(step(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(part, F.struct(begin.alias("at"), kind.alias("out")), more, lambda acc: acc["out"])

    def chunks(y: Column) -> Column:
        last = F.greatest(F.floor((F.size(y) - 1) / CHUNK), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(y, c * CHUNK + 1, CHUNK))

    def over(parts: Column, begins: Column) -> Column:
        return F.flatten(F.zip_with(parts, begins, fold))

    totals = lambda parts: F.transform(parts, lambda c: F.aggregate(c, zero, lambda a, v: step(a, v)))
    # Two levels of chunks: what is folded in one go at the top is the square of CHUNK times shorter than x.
    inner = lambda sums: let(chunks(sums), lambda p: let(totals(p), lambda t: over(p, fold(t, zero))))
    return let(x, lambda y: let(chunks(y), lambda p: let(totals(p), lambda t: over(p, inner(t)))))


def running_sums(x: Column) -> Column:
    """For each entry of an array of ints the sum of those before it."""
    return running(x, lambda a, b: a + b, F.lit(0))


def substrings(text: Column, spans: Column) -> Column:
    """text between start and end (code points) of each span. A substring is searched from its text's begin, so the text is
    cut into chunks first."""
    size = 4096
    first = lambda s: F.floor(s["start"] / size).cast("int")
    several = lambda s: (F.floor(s["end"] / size) - first(s) + 1).cast("int")
    part = lambda chunks: lambda s: F.substring(F.array_join(F.slice(chunks, first(s) + 1, several(s)), ""), s["start"] % size + 1, s["end"] - s["start"])
    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)), lambda chunks: F.transform(spans, part(chunks)))
