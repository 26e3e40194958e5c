"""Ranks and running counts in groups of any size: no group, and no tie, has to fit into one task.

Rows are dealt to ranges of (group, order), each range counts its rows, and the counts of the
ranges before are added to the counts within. A range is sorted by itself, so a group with most of
the rows is sorted by as many tasks as it has ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.sources.sinks import few, kept_table


def running_sums(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column], n_ranges: int | None = None) -> DataFrame:
    """df with two columns for each of `sums`: the sum over its group's rows up to and with itself, in an order without ties, and the sum over the group (name_total)."""
    dealt = df.select("*", *(c.alias(f"_add_{name}") for name, c in sums.items()))
    by = [*(F.col(g) for g in group), *order]
    ranged = (dealt.repartitionByRange(n_ranges, *by) if n_ranges else dealt.repartitionByRange(*by)).withColumn("_range", F.spark_partition_id())
    kept = kept_table(ranged, "ranges")
    totals = kept.groupBy(*group, "_range").agg(*(F.sum(f"_add_{name}").alias(f"_sum_{name}") for name in sums))
    own = Window.partitionBy(*group)  # a row a group and range
    earlier = own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*group, "_range", *(x for n in sums for x in (F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}"), F.sum(f"_sum_{n}").over(own).alias(f"_all_{n}"))))
    within = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = kept.select("*", *(F.sum(f"_add_{name}").over(within).alias(f"_local_{name}") for name in sums))
    same = [F.col(f"l.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group] + [F.col("l._range") == F.col("b._range")]
    joined = local.alias("l").join(few(before).alias("b"), same)
    return joined.select(*(f"l.`{c}`" for c in df.columns), *(x for n in sums for x in ((F.col(f"l._local_{n}") + F.col(f"b._before_{n}")).cast("long").alias(n), F.col(f"b._all_{n}").cast("long").alias(f"{n}_total"))))


def row_numbers(df: DataFrame, group: list[str], order: list[Column], name: str = "nth", n_ranges: int | None = None) -> DataFrame:
    """row_number() over (group, order); the order has no ties."""
    return running_sums(df, group, order, {name: F.lit(1)}, n_ranges).drop(f"{name}_total")


def shared_ranks(df: DataFrame, group: list[str], value: str, n_ranges: int | None = None) -> DataFrame:
    """df with rank (1 for the largest value of its group, ties share one, with gaps) and published (rows of the group).

    Equal values are counted before they are ranked, so a value that a third of the rows have is
    one row. Rows without the value are left out.
    """
    rows = df.where(F.col(value).isNotNull())
    counts = rows.groupBy(*group, value).agg(F.count("*").alias("_own"))
    upto = running_sums(counts, group, [F.col(value).asc()], {"_upto": F.col("_own")}, n_ranges)
    table = upto.select(*group, F.col(value).alias("_value"), (F.col("_upto_total") - F.col("_upto") + 1).alias("rank"), F.col("_upto_total").alias("published"))
    keyed = rows.withColumn("_value", F.col(value))
    return keyed.join(few(table), [*group, "_value"]).select(*(f"`{c}`" for c in df.columns), "rank", "published")


def smaller_in(df: DataFrame, others: DataFrame, group: list[str], value: str, name: str, n_ranges: int | None = None) -> DataFrame:
    """df with the number of rows of `others` of the same group that have a smaller value."""
    mine = df.select(*group, value).distinct().withColumn("_n", F.lit(0).cast("long"))
    theirs = others.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_n"))
    values = mine.unionByName(theirs).groupBy(*group, value).agg(F.sum("_n").alias("_n"))
    counts = running_sums(values, group, [F.col(value).asc()], {"_upto": F.col("_n")}, n_ranges).select(*group, value, (F.col("_upto") - F.col("_n")).alias(name))
    return df.join(few(counts), [*group, value])


def tiles(df: DataFrame, group: list[str], order: list[Column], n: int, n_ranges: int | None = None) -> DataFrame:
    """df with tile (1 to n, as ntile gives it), place (from 1 within the tile) and n_in_tile."""
    numbered = running_sums(df, group, order, {"_nth": F.lit(1)}, n_ranges)
    short, longer = F.expr(f"_nth_total div {n}"), F.expr(f"_nth_total % {n}")
    at = F.col("_nth") - 1
    edge = longer * (short + 1)  # the first tiles have a row more
    tile = F.when(at < edge, F.floor(at / (short + 1))).otherwise(longer + F.floor((at - edge) / F.greatest(short, F.lit(1)))).cast("int")
    start = F.when(F.col("_tile") <= longer, F.col("_tile") * (short + 1)).otherwise(edge + (F.col("_tile") - longer) * short)
    size = (short + (F.col("_tile") < longer).cast("int")).cast("int")
    return numbered.withColumn("_tile", tile).select(*(f"`{c}`" for c in df.columns), (F.col("_tile") + 1).cast("int").alias("tile"), (at - start + 1).cast("int").alias("place"), size.alias("n_in_tile"))
