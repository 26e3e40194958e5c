"""Top-k tables and the hooks of the front page. Every order ends in a unique key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top(df: DataFrame, n: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(n)


def yo_yo_table(careers: DataFrame, n: int = 25) -> DataFrame:
    """Clubs with five season rows or more, by score, then by the number of rows."""
    return top(careers.where("n_rows >= 5"), n, F.desc("yo_yo_score"), F.desc("n_rows"), "club_id")


def level_table(careers: DataFrame, above: bool, n: int = 25) -> DataFrame:
    side = careers.where("level_gap < 0" if above else "level_gap > 0")
    return top(side, n, F.asc("level_gap") if above else F.desc("level_gap"), "club_id")


def fallen_giants(careers: DataFrame) -> DataFrame:
    """The lowest first, then those that left the top longest ago."""
    return careers.where("highest_tier = 1 and current_tier >= 3").orderBy(F.desc("current_tier"), "last_tier1_season", "club_id")


def risers(careers: DataFrame) -> DataFrame:
    """The highest first, then those that came from furthest down."""
    return careers.where("first_tier >= 4 and current_tier <= 2").orderBy("current_tier", F.desc("first_tier"), "club_id")


def records(table: DataFrame, kind: str, min_played: int = 30, n: int = 10) -> DataFrame:
    """Most or fewest points, best or worst difference, over tables that are complete."""
    key = ["season_end_year", "tier", "club_id"]
    order = {
        "most_points": (F.desc("points"), F.desc("gd")),
        "fewest_points": (F.asc("points"), F.asc("gd")),
        "best_difference": (F.desc("gd"), F.desc("points")),
        "worst_difference": (F.asc("gd"), F.asc("points")),
    }[kind]
    return top(eligible(table).where(F.col("played") >= min_played), n, *order, *key)


def eligible(table: DataFrame) -> DataFrame:
    """A table whose completeness is unknown counts as complete."""
    return table.where("coalesce(data_complete, 1) = 1") if "data_complete" in table.columns else table


def safe_thresholds(table: DataFrame, played, relegated: bool, n: int = 10) -> DataFrame:
    """The best who went down, or the worst who stayed, among clubs that played so many matches."""
    key = ["season_end_year", "tier", "club_id"]
    side = eligible(table).where(played).where(F.col("status") == ("Relegated" if relegated else "Stayed"))
    return top(side, n, *((F.desc("points"), F.asc("gd")) if relegated else (F.asc("points"), F.desc("gd"))), *key)


def first_hooks(hooks: list[DataFrame], n: int = 4) -> DataFrame:
    """hooks: in order of their recipes, each of at most one row (hook, club_id, value); the first n that have one."""
    out = None
    for i, h in enumerate(hooks):
        h = h.withColumn("priority", F.lit(i))
        out = h if out is None else out.unionByName(h)
    return out.orderBy("priority").limit(n)
