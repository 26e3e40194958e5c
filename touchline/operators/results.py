"""Head-to-head, form, club context and the choice of featured fixtures."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.standings import perspectives
from touchline.plans.rules import FOLLOWED_CLUBS, TIER_WEIGHT


def head_to_head(matches: DataFrame) -> DataFrame:
    """Per unordered pair that met: meetings, wins of each and draws."""
    a, b = F.least("home_id", "away_id"), F.greatest("home_id", "away_id")
    won = F.when(F.col("ftr") == "H", F.col("home_id")).when(F.col("ftr") == "A", F.col("away_id"))
    m = matches.select(a.alias("club_a"), b.alias("club_b"), won.alias("winner"))
    count = lambda c: F.count(F.when(c, 1))
    return m.groupBy("club_a", "club_b").agg(F.count("*").alias("total"), count(F.col("winner") == F.col("club_a")).alias("wins_a"), count(F.col("winner") == F.col("club_b")).alias("wins_b"), count(F.col("winner").isNull()).alias("draws"))


def recent_form(matches: DataFrame, ties: list[str], n: int = 5, salts: int = 32) -> DataFrame:
    """The last n dated results of each club's latest season, newest first, as a string such as WWDLW.

    Matches are read once: the last n by season and date are taken in `salts` parts of a club first,
    so that a club with very many matches is never ranked in one task, and Spark cuts each part
    before it is shuffled. Of these, the last n of the latest season are left.
    """
    own = perspectives(matches.where("match_date is not null and season_end_year is not null"), "season_end_year", "match_date", *ties).where("club_id is not null")
    last = own.withColumn("_salt", F.pmod(F.xxhash64(*ties), F.lit(salts)))
    newest = [F.desc("season_end_year"), F.desc("match_date"), *(F.desc(t) for t in ties)]
    part = last.withColumn("_n", F.row_number().over(Window.partitionBy("club_id", "_salt").orderBy(*newest))).where(F.col("_n") <= n)
    club = Window.partitionBy("club_id")  # n rows of each salt
    top = part.withColumns({"_n": F.row_number().over(club.orderBy(*newest)), "_latest": F.max("season_end_year").over(club)}).where(F.col("_n") <= n).where("season_end_year = _latest").drop("_latest")
    g = top.groupBy("club_id").agg(F.first("season_end_year").alias("season_end_year"), F.array_sort(F.collect_list(F.struct("_n", "result"))).alias("r"))
    return g.select("club_id", "season_end_year", F.concat_ws("", F.col("r.result")).alias("form"))


def last_seasons(table: DataFrame, n: int = 5) -> DataFrame:
    w = Window.partitionBy("club_id").orderBy(F.desc("season_end_year"))
    return table.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


def highest_since(table: DataFrame) -> DataFrame:
    """The last season before the latest in which the club was at its present tier or higher; null if there is none."""
    back = Window.partitionBy("club_id").orderBy(F.desc("season_end_year"))
    now = table.withColumns({"_tier": F.first("tier").over(back), "_last": F.first("season_end_year").over(back)})
    as_high = F.when((F.col("season_end_year") < F.col("_last")) & (F.col("tier") <= F.col("_tier")), F.col("season_end_year"))
    return now.groupBy("club_id").agg(F.max(as_high).alias("highest_since"))


def club_context(table: DataFrame, careers: DataFrame, form: DataFrame | None = None) -> DataFrame:
    """What a preview says of a club: career, latest status, position, points and matches, the last five seasons, form (club_id, form).

    Points and matches are null where the table has none.
    """
    of = lambda c: F.col(c) if c in table.columns else F.lit(None).cast("long")
    latest = last_seasons(table.withColumns({"points": of("points"), "played": of("played")}), 5)
    season = F.struct(*(c for c in ("season_end_year", "tier", "position", "points", "status")))
    recent = latest.groupBy("club_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("nth", season.alias("s")))), lambda x: x["s"]).alias("recent_seasons"),
        *(F.max(F.when(F.col("nth") == 1, F.col(c))).alias(f"last_{c}") for c in ("status", "position", "points", "played")),
    )
    known = careers.join(recent, "club_id", "left").join(highest_since(table), "club_id", "left")
    return known.withColumn("form", F.lit(None).cast("string")) if form is None else known.join(form.select("club_id", "form"), "club_id", "left")


def followed(env: str | None = None) -> list[str]:
    """Clubs that previews favour: the configured ones and those of a comma-separated list (by default FOLLOWED_CLUBS of the environment)."""
    given = os.environ.get("FOLLOWED_CLUBS", "") if env is None else env
    return sorted({*FOLLOWED_CLUBS, *(x.strip() for x in given.split(",") if x.strip())})


def fixture_window(fixtures: DataFrame, today: Column, days: int = 8) -> DataFrame:
    """Fixtures from today on for `days` days, the last one not included."""
    return fixtures.where((F.col("match_date") >= today) & (F.col("match_date") < F.date_add(today, days)))


def storyline_score(fixtures: DataFrame, context: DataFrame, followed: list[int] | None = None) -> DataFrame:
    """Adds score: tier weight, what each club's career adds, and what the pair adds. A club without context adds nothing."""
    cols = ("yo_yo_score", "level_gap", "kind", "highest_tier", "last_status", "last_position")
    side = lambda p: context.select(F.col("club_id").alias(f"{p}_id"), *(F.col(c).alias(f"{p}_{c}") for c in cols), F.lit(True).alias(f"{p}_known"))
    f = fixtures.join(side("home"), "home_id", "left").join(side("away"), "away_id", "left")
    weight = F.lit(1)
    for t, x in TIER_WEIGHT.items():
        weight = F.when(F.col("tier") == t, x).otherwise(weight)

    def club(p: str) -> Column:
        gap = F.col(f"{p}_level_gap")
        leveled = F.least(F.abs(gap), F.lit(3)) * 2 + F.when(gap < 0, 1).otherwise(0) + F.when(F.col(f"{p}_kind") == "yo-yo", 1).otherwise(0)
        giant = F.when((F.col(f"{p}_highest_tier") == 1) & (F.col("tier") >= 3), 4).otherwise(0)
        moved = F.when(F.col(f"{p}_last_status") != "Stayed", 1).otherwise(0)
        return F.when(F.col(f"{p}_known"), F.col(f"{p}_yo_yo_score") + F.when(gap.isNotNull(), leveled).otherwise(giant) + moved).otherwise(0.0)

    h, a = F.col("home_last_position"), F.col("away_last_position")
    pair = F.when(F.abs(h - a) <= 3, 3).otherwise(0) + F.when((h <= 3) & (a <= 3), 3).otherwise(0)
    both = F.coalesce(F.col("home_known") & F.col("away_known"), F.lit(False))
    liked = F.lit(False) if not followed else F.col("home_id").isin(followed) | F.col("away_id").isin(followed)
    score = weight.cast("double") + club("home") + club("away") + F.when(both, pair + F.when(liked, 100).otherwise(0)).otherwise(0)
    return f.select(*fixtures.columns, F.bround(score.cast("decimal(20,6)"), 4).cast("double").alias("score"))


def featured(scored: DataFrame, seq: str = "seq", n: int = 6) -> DataFrame:
    """The n fixtures with the highest scores (ties in the order of the input) are marked with their rank; the others have none."""
    top = scored.orderBy(F.desc("score"), seq).limit(n).withColumn("featured", F.row_number().over(Window.orderBy(F.desc("score"), seq))).select(seq, "featured")  # n rows
    return scored.join(F.broadcast(top), seq, "left")
