"""Patterns of promotions and relegations over consecutive seasons, and what became of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.plans.rules import PROMOTED, RELEGATED


def event_kind(tier: Column, status: Column) -> Column:
    return (
        F.when(status.isin(*PROMOTED) & (tier != 1), "promotion")
        .when(status.isin(*RELEGATED), "relegation")
        .when((status == "Stayed") | ((status == "Champions") & (tier == 1)), "stay")
        .otherwise("other")
    )


def events(table: DataFrame) -> DataFrame:
    return table.select("club_id", "season_end_year", "tier", event_kind(F.col("tier"), F.col("status")).alias("kind"))


def runs(table: DataFrame) -> DataFrame:
    """Maximal runs of two or more promotions or relegations in consecutive seasons, each reported once."""
    moves = events(table).where(F.col("kind").isin("promotion", "relegation"))
    island = F.col("season_end_year") - F.row_number().over(Window.partitionBy("club_id", "kind").orderBy("season_end_year"))
    g = moves.withColumn("_i", island).groupBy("club_id", "kind", "_i").agg(F.min("season_end_year").alias("first"), F.max("season_end_year").alias("last"), F.count("*").alias("n")).where("n >= 2")
    return g.select("club_id", F.concat("kind", F.when(F.col("n") == 2, "_back_to_back").otherwise("_three_plus")).alias("pattern"), "first", "last")


def triples(table: DataFrame) -> DataFrame:
    """Three consecutive seasons of a fixed shape; windows may overlap."""
    w = Window.partitionBy("club_id").orderBy("season_end_year")
    after = lambda c, k: F.lead(c, k).over(w)
    e = events(table).withColumns({"k2": after("kind", 1), "k3": after("kind", 2), "y2": after("season_end_year", 1), "y3": after("season_end_year", 2)})
    together = (F.col("y2") == F.col("season_end_year") + 1) & (F.col("y3") == F.col("season_end_year") + 2)
    shape = F.concat_ws("-", "kind", "k2", "k3")
    named = F.when(shape == "relegation-stay-relegation", "relegation_held").when(shape == "relegation-promotion-relegation", "relegation_sandwich").when(shape == "promotion-stay-promotion", "promotion_paused")
    return e.where(together).select("club_id", named.alias("pattern"), F.col("season_end_year").alias("first"), F.col("y3").alias("last")).where("pattern is not null")


def with_bounds(patterns: DataFrame, table: DataFrame) -> DataFrame:
    """Adds start_tier (the season before), floor_tier and peak_tier (over the pattern and the season after), now_tier (the latest season)."""
    history = table.select("club_id", "season_end_year", "tier").distinct()
    spread = patterns.select("club_id", "pattern", "first", "last", F.explode(F.sequence(F.col("first"), F.col("last") + 1)).alias("season_end_year"))
    tiers = spread.join(history, ["club_id", "season_end_year"]).groupBy("club_id", "pattern", "first", "last").agg(F.max("tier").alias("floor_tier"), F.min("tier").alias("peak_tier"))
    before = history.select("club_id", (F.col("season_end_year") + 1).alias("first"), F.col("tier").alias("start_tier"))
    latest = F.broadcast(history.agg(F.max("season_end_year").alias("latest")))  # one row
    now = history.join(latest, F.col("season_end_year") == F.col("latest")).select("club_id", F.col("tier").alias("now_tier"))
    keys = ["club_id", "pattern", "first", "last"]
    return patterns.join(tiers, keys, "left").join(before, ["club_id", "first"], "left").join(now, "club_id", "left").join(latest, F.lit(True))


def fall_outcome(start: Column, floor: Column, now: Column, settled: Column) -> Column:
    return (
        F.when(~settled, "unfolding").when(now.isNull(), "outside").when(now <= start, "recovered").when(now < floor, "climbing").when(now == floor, "stuck").otherwise("worse")
    )


def rise_outcome(peak: Column, now: Column, settled: Column) -> Column:
    return F.when(~settled, "unfolding").when(now.isNull(), "outside").when(peak.isNull() | (now <= peak), "held").when(now == peak + 1, "slipped").otherwise("fell_back")


def outcomes(table: DataFrame) -> DataFrame:
    """All patterns with their bounds and outcome."""
    found = with_bounds(runs(table).unionByName(triples(table)), table)
    settled = F.col("last") != F.col("latest")
    fall = fall_outcome(F.col("start_tier"), F.col("floor_tier"), F.col("now_tier"), settled)
    rise = rise_outcome(F.col("peak_tier"), F.col("now_tier"), settled)
    return found.withColumn("outcome", F.when(F.col("pattern").startswith("relegation"), fall).otherwise(rise)).drop("latest")


def stats(found: DataFrame) -> DataFrame:
    return found.groupBy("pattern", "outcome").agg(F.count("*").alias("records"), F.countDistinct("club_id").alias("clubs"))
