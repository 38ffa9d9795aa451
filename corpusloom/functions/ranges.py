"""Ranges of a key: cut points from quantiles, and the range of a row by binary search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def constants(values: list, kind: str) -> Column:
    """An array of ``kind`` as one literal, whatever its length; None stays null.

    The cast folds before the run; a lambda would not, and would parse every
    value anew for each row and step.
    """
    if not values:
        return F.array().cast(f"array<{kind}>")
    return F.split(F.lit("\x01".join("" if v is None else str(v) for v in values)), "\x01").try_cast(f"array<{kind}>")


def cut_points(rows: DataFrame, key: str, pieces: int) -> list:
    """At most ``pieces`` - 1 increasing values of the numeric ``key`` that cut its rows into like parts."""
    if pieces < 2:
        return []
    points = [i / pieces for i in range(1, pieces)]
    got = rows.agg(F.percentile_approx(key, points, max(10_000, 10 * pieces))).first()[0]
    return sorted(set(got or []))


def range_of(key: Column, cuts: list) -> Column:
    """How many of the sorted ``cuts`` are at most ``key``: as many steps as the count has binary digits."""
    if not cuts:
        return F.lit(0)
    table = constants(cuts, "double" if any(isinstance(c, float) for c in cuts) else "bigint")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))))
    below = lambda at, s: (at + s <= len(cuts)) & (F.get(table, at + s - 1) <= key)
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(below(at, s), at + s).otherwise(at))
