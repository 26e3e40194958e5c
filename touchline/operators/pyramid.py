"""Positions over the whole pyramid and the data of its charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def floors(table: DataFrame) -> DataFrame:
    """Clubs of each tier and season, and how many stand in it and above."""
    sizes = table.groupBy("season_end_year", "tier").agg(F.count("*").alias("n_clubs"))
    return sizes.withColumn("floor", F.sum("n_clubs").over(Window.partitionBy("season_end_year").orderBy("tier").rowsBetween(Window.unboundedPreceding, 0)))


def overall_positions(table: DataFrame) -> DataFrame:
    """overall_position: position plus the clubs of all higher tiers. One running sum, no join over pairs of tiers."""
    above = floors(table).select("season_end_year", "tier", (F.col("floor") - F.col("n_clubs")).alias("_above"))
    return table.join(above, ["season_end_year", "tier"]).withColumn("overall_position", F.col("position") + F.col("_above")).drop("_above")


def floor_lines(table: DataFrame) -> DataFrame:
    """For each season the boundaries between tiers (the last is left out) and the lowest position."""
    g = floors(table).groupBy("season_end_year").agg(F.array_sort(F.collect_list("floor")).alias("f"))
    return g.select("season_end_year", F.slice("f", 1, F.greatest(F.size("f") - 1, F.lit(0))).alias("floors"), F.array_max("f").alias("max_position"))


def segments(table: DataFrame) -> DataFrame:
    """Runs of a club in one tier without a gap; a run after a change of tier starts at the last point of the one before."""
    w = Window.partitionBy("club_id").orderBy("season_end_year")
    p = table.select("club_id", "season_end_year", "tier").withColumns({"py": F.lag("season_end_year").over(w), "pt": F.lag("tier").over(w)})
    gap = F.coalesce(F.col("py") != F.col("season_end_year") - 1, F.lit(True))
    p = p.withColumns({"_new": (gap | (F.col("pt") != F.col("tier"))).cast("int"), "_bridge": F.when(~gap & (F.col("pt") != F.col("tier")), F.col("py"))})
    p = p.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = p.groupBy("club_id", "_run").agg(F.first("tier").alias("tier"), F.min("season_end_year").alias("start"), F.max("season_end_year").alias("end"), F.max("_bridge").alias("bridged_from"), F.count("*").alias("n_points"))
    return g.withColumn("segment", F.col("_run")).drop("_run")


def ribbon(table: DataFrame, patterns: DataFrame) -> DataFrame:
    """One cell for each club with a pattern and each season there is: its tier or null, and whether a pattern covers it."""
    seasons = F.broadcast(table.select("season_end_year").distinct())  # as many rows as seasons
    clubs = patterns.select("club_id").distinct()
    marked = patterns.select("club_id", F.explode(F.sequence("first", "last")).alias("season_end_year")).distinct().withColumn("in_pattern", F.lit(1))
    cells = clubs.join(seasons, F.lit(True))
    tiers = table.select("club_id", "season_end_year", "tier")
    return cells.join(tiers, ["club_id", "season_end_year"], "left").join(marked, ["club_id", "season_end_year"], "left").withColumn("in_pattern", F.coalesce("in_pattern", F.lit(0)))


def matrix(table: DataFrame) -> DataFrame:
    """One cell per season and tier: the clubs in order of position."""
    g = table.groupBy("season_end_year", "tier").agg(F.array_sort(F.collect_list(F.struct("position", "club_id"))).alias("c"))
    return g.select("season_end_year", "tier", F.col("c.club_id").alias("clubs"))


def season_links(table: DataFrame) -> DataFrame:
    w = Window.orderBy("season_end_year")  # over the distinct seasons
    s = table.select("season_end_year").distinct()
    return s.withColumns({"previous": F.lag("season_end_year").over(w), "next": F.lead("season_end_year").over(w)})


def chart_payload(table: DataFrame) -> DataFrame:
    """Per club a JSON list of [season, overall position], oldest first."""
    g = overall_positions(table).groupBy("club_id").agg(F.array_sort(F.collect_list(F.struct("season_end_year", "overall_position"))).alias("p"))
    return g.select("club_id", F.to_json(F.transform("p", lambda x: F.array(x["season_end_year"].cast("long"), x["overall_position"].cast("long")))).alias("points"))


def map_payload(table: DataFrame) -> DataFrame:
    """Per club its tier by season as a JSON object."""
    g = table.groupBy("club_id").agg(F.array_sort(F.collect_list(F.struct(F.col("season_end_year").cast("string").alias("k"), F.col("tier").alias("v")))).alias("p"))
    return g.select("club_id", F.to_json(F.map_from_entries("p")).alias("tiers"))
