"""Joins of points with the intervals that hold them, and of intervals that overlap, by bins.

Bins are powers of two wide. An interval goes to the width that is no smaller than itself, where it
covers two bins at most; a point goes to one bin of each width in use. So rows grow with the
number of widths (at most 63, a few in practice) and never with the length of intervals, and each
pair meets in one bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bin(at: Column, level: Column) -> Column:
    return F.call_function("shiftright", at.cast("long"), level)


def _level(start: Column, end: Column) -> Column:
    """The least power of two that is as long as the interval, both ends included."""
    length = end.cast("long") - start.cast("long") + 1
    return F.when(length <= 1, 0).otherwise(F.length(F.bin(length - 1))).cast("int")


def binned(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """intervals with level and bin, in one or two rows each. Intervals without an end or that end before they start are left out."""
    level = _level(F.col(start), F.col(end))
    kept = intervals.where(F.col(start) <= F.col(end)).withColumn("_level", level)
    return kept.withColumn("_bin", F.explode(F.sequence(_bin(F.col(start), F.col("_level")), _bin(F.col(end), F.col("_level")))))


def levels(intervals: DataFrame, start: str, end: str) -> list[int]:
    """The widths in use: a few small numbers."""
    rows = intervals.where(F.col(start) <= F.col(end)).select(_level(F.col(start), F.col(end)).alias("level")).distinct().collect()
    return sorted(r["level"] for r in rows)


def holding(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, how: str = "inner") -> DataFrame:
    """points with the intervals of the same keys that hold them (start <= at <= end); `left` keeps points without one.

    Both ends are whole numbers (days, seasons). Columns of points come first, then those of
    intervals but the keys; other names must differ. Null points are in no interval.
    """
    used = levels(intervals, start, end)
    rest = [c for c in intervals.columns if c not in keys]
    own = points.select("*", F.explode(F.array(*(F.lit(x) for x in used)) if used else F.array().cast("array<int>")).alias("_level")).withColumn("_bin", _bin(F.col(at), F.col("_level")))
    side = binned(intervals, start, end)
    met = own.join(side, [*keys, "_level", "_bin"]).where(F.col(at).between(F.col(start), F.col(end))).select(*points.columns, *rest)
    if how == "inner":
        return met
    unmet = points.join(met.select(*keys, at).distinct(), [*keys, at], "left_anti")
    return met.unionByName(unmet, allowMissingColumns=True)


def latest_holding(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """As `holding` with all points, but of several intervals the one that starts last (ties: that ends first) counts. Points must be distinct."""
    rest = [c for c in intervals.columns if c not in keys]
    met = holding(points, intervals, keys, at, start, end)
    best = met.groupBy(*points.columns).agg(F.max_by(F.struct(*rest), F.struct(F.col(start), -F.col(end))).alias("_r")).select(*points.columns, *(F.col(f"_r.`{c}`").alias(c) for c in rest))
    return best.unionByName(points.join(best.select(*keys, at).distinct(), [*keys, at], "left_anti"), allowMissingColumns=True)


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Pairs of intervals of the same keys that share a point: keys, left and right as structs.

    The longer one's bins are looked up by the shorter one's: each goes to its own width and all
    wider ones in use, and a pair is taken only in the first bin that it shares, at the width of the longer.
    """
    used = sorted({*levels(left, start, end), *levels(right, start, end)})
    widths = F.array(*(F.lit(x) for x in used)) if used else F.array().cast("array<int>")

    def spread(df: DataFrame, name: str) -> DataFrame:
        own = df.where(F.col(start) <= F.col(end)).select(*keys, F.struct(*df.columns).alias(name), _level(F.col(start), F.col(end)).alias(f"_{name}"))
        at = own.select("*", F.explode(F.filter(widths, lambda x: x >= F.col(f"_{name}"))).alias("_level"))
        return at.withColumn("_bin", F.explode(F.sequence(_bin(F.col(f"{name}.{start}"), F.col("_level")), _bin(F.col(f"{name}.{end}"), F.col("_level")))))

    met = spread(left, "left").join(spread(right, "right"), [*keys, "_level", "_bin"])
    begin = F.greatest(F.col(f"left.{start}"), F.col(f"right.{start}"))
    once = (F.col("_level") == F.greatest("_left", "_right")) & (F.col("_bin") == _bin(begin, F.col("_level")))
    return met.where(once & (begin <= F.least(F.col(f"left.{end}"), F.col(f"right.{end}")))).select(*keys, "left", "right")
