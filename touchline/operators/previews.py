"""The wording of fixture previews, from the context of the two clubs and their meetings. The sentences are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.text import labelled, ordinal, plural
from touchline.plans.rules import OUTSIDE, TIER_NAMES


def the(name: Column) -> Column:
    """`the Championship`, but bare `League One`."""
    return F.when(name.startswith("League"), name).otherwise(F.concat(F.lit("the "), name))


def _tier(t: Column) -> Column:
    return F.coalesce(labelled(t, TIER_NAMES), F.concat(F.lit("Tier "), t.cast("string")))


def _cat(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def level_sentence(name: Column) -> Column:
    """What kind of club this is and how far it is from that now; null where its level is unknown or outside."""
    c = F.col
    here, second = the(_tier(c("natural_tier"))), c("second_tier")
    a, b = F.least("natural_tier", "second_tier"), F.greatest("natural_tier", "second_tier")
    kind = (
        F.when(c("kind") == "ever-present", _cat(name, " have never played outside ", here))
        .when(c("kind") == "established", _cat(name, " belong in ", here, " — ", F.bround((c("share") * 100).cast("decimal(20,8)"), 0).cast("int"), "% of their ", c("seasons"), " recorded seasons"))
        .when((c("kind") == "yo-yo") & second.isNotNull(), _cat(name, " live between ", the(_tier(a)), " and ", the(_tier(b))))
        .when(c("kind") == "broad", _cat(name, "'s record runs the length of the pyramid, but its centre of gravity is ", here))
        .otherwise(_cat(name, " are, on the balance of their record, a ", _tier(c("natural_tier")), " club"))
    )
    gap, since, streak = c("level_gap"), c("highest_since"), F.coalesce("current_tier_streak", F.lit(0))
    above = _cat(plural(F.abs(gap), "division"), " above that")
    now = (
        F.when(gap > 0, _cat("; they are ", plural(gap, "division"), " below that now"))
        .when((gap < 0) & (streak >= 3), _cat("; they are ", streak, " seasons into a spell ", above))
        .when((gap < 0) & (c("last_season_in_db") - since >= 2), _cat("; this season is their highest since ", since))
        .when((gap < 0) & since.isNotNull(), _cat("; they are ", above, " this season"))
        .when(gap < 0, "; this season is the highest in their record")
        .otherwise("")
    )
    known = c("natural_tier").isNotNull() & (c("kind") != "insufficient") & (c("natural_tier") != OUTSIDE)
    return F.when(known, F.concat(kind, now))


def history_sentence(name: Column) -> Column:
    """The level, or else fallen giant, yo-yo club, long stay or range; then where the club stands now."""
    c = F.col
    top = c("seasons_in_tier1")
    span = F.when(c("highest_tier") != c("lowest_tier"), _cat("between tiers ", c("highest_tier"), " and ", c("lowest_tier"))).otherwise(_cat("entirely at tier ", c("highest_tier")))
    past = F.coalesce(
        level_sentence(name),
        F.when((c("highest_tier") == 1) & (c("current_tier") >= 3), _cat(name, " are a fallen giant — ", top, " top-flight season", F.when(top == 1, "").otherwise("s"), ", the last in ", c("last_tier1_season"), ", now ", c("current_tier") - 1, " divisions below"))
        .when(c("yo_yo_score") >= 0.25, _cat(name, " are a classic yo-yo club — ", plural(c("total_promotions"), "promotion"), " and ", plural(c("total_relegations"), "relegation"), " since ", c("first_season_in_db")))
        .when(c("current_tier_streak") >= 10, _cat(name, " are furniture at this level — ", c("current_tier_streak"), " consecutive seasons and counting"))
        .otherwise(_cat(name, " have spent their ", c("last_season_in_db") - c("first_season_in_db") + 1, " recorded seasons ", span)),
    )
    form = F.coalesce(F.concat(F.lit(", form "), F.nullif(c("form"), F.lit(""))), F.lit(""))
    now = F.when(c("last_position").isNotNull(), _cat("; they sit ", ordinal(c("last_position")), " with ", c("last_points"), " points from ", c("last_played"), " games", form)).otherwise("")
    return F.concat(past, now, F.lit("."))


def histories(context: DataFrame) -> DataFrame:
    """club_id, name, history of every club in `club_context` that has a name."""
    return context.select("club_id", "name", history_sentence(F.col("name")).alias("history"))


def narratives(fixtures: DataFrame, told: DataFrame, meetings: DataFrame, names: DataFrame) -> DataFrame:
    """Adds narrative to fixtures (seq, match_date, division_name, home_id, away_id).

    told: rows of `histories`; meetings: rows of `head_to_head`; names: club_id and name of every
    club. A club without context adds no sentence, and meetings are told only where both have one.
    """
    side = lambda p, df, *cols: df.select(F.col("club_id").alias(f"{p}_id"), *(F.col(c).alias(f"{p}_{c}") for c in cols))
    f = fixtures
    for p in ("home", "away"):
        f = f.join(side(p, names, "name"), f"{p}_id", "left").join(side(p, told, "history"), f"{p}_id", "left")
    pair = meetings.withColumnsRenamed({"club_a": "_a", "club_b": "_b"})
    f = f.withColumns({"_a": F.least("home_id", "away_id"), "_b": F.greatest("home_id", "away_id")}).join(pair, ["_a", "_b"], "left")
    won = lambda p: F.when(F.col(f"{p}_id") == F.col("_a"), F.col("wins_a")).otherwise(F.col("wins_b"))
    shown = lambda p: F.coalesce(f"{p}_name", F.col(f"{p}_id").cast("string"))
    opening = _cat(shown("home"), " host ", shown("away"), " in ", the(F.col("division_name")), " on ", F.date_format("match_date", "EEEE dd MMMM"), ".")
    met = _cat("They have met ", F.col("total"), " times in league play since 1993: ", shown("home"), " ", won("home"), " wins, ", shown("away"), " ", won("away"), ", ", F.col("draws"), " drawn.")
    both = F.col("total").isNotNull() & F.col("home_history").isNotNull() & F.col("away_history").isNotNull()
    return f.select(*fixtures.columns, F.concat_ws(" ", opening, "home_history", "away_history", F.when(both, met)).alias("narrative"))
