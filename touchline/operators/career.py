"""From season tables to careers: rollup, streak, natural level, trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.plans.rules import OUTSIDE, OUTSIDE_NAME, OUTSIDE_VAGUE, PROMOTED, RELEGATED, TIER_NAMES

MIN_WINDOW, MIN_RECORDED, RECENT, PRIOR, MIN_PRIOR = 8, 4, 5, 10, 3


def rollup(table: DataFrame) -> DataFrame:
    """One row per club: tiers, seasons, moves and the yo-yo score (half to even). Seasons are counted in sets, as several distinct counts would multiply the rows."""
    up = F.count(F.when(F.col("status").isin(*PROMOTED) & (F.col("tier") > 1), 1))
    down = F.count(F.when(F.col("status").isin(*RELEGATED), 1))
    top = F.when(F.col("tier") == 1, F.col("season_end_year"))
    sums = table.groupBy("club_id").agg(
        F.max_by("tier", "season_end_year").alias("current_tier"),
        F.min_by("tier", "season_end_year").alias("first_tier"),
        F.min("tier").alias("highest_tier"),
        F.max("tier").alias("lowest_tier"),
        F.size(F.collect_set(top)).cast("long").alias("seasons_in_tier1"),
        F.max(top).alias("last_tier1_season"),
        F.min("season_end_year").alias("first_season_in_db"),
        F.max("season_end_year").alias("last_season_in_db"),
        F.size(F.collect_set("season_end_year")).cast("long").alias("n_seasons"),
        F.count("*").alias("n_rows"),
        up.alias("total_promotions"),
        down.alias("total_relegations"),
    )
    return sums.withColumn("yo_yo_score", F.bround(((F.col("total_promotions") + F.col("total_relegations")) / F.col("n_seasons")).cast("decimal(20,10)"), 2).cast("double"))


def streak(table: DataFrame) -> DataFrame:
    """Seasons in a row, up to the latest, in the tier of the latest; a gap or a change ends it."""
    one = table.select("club_id", "season_end_year", "tier").distinct()
    back = Window.partitionBy("club_id").orderBy(F.desc("season_end_year"))
    ranked = one.withColumns({"_n": F.row_number().over(back), "_last": F.first("season_end_year").over(back), "_tier": F.first("tier").over(back)})
    run = ranked.withColumn("_broken", F.max(F.when((F.col("tier") != F.col("_tier")) | (F.col("season_end_year") != F.col("_last") - F.col("_n") + 1), 1).otherwise(0)).over(back))
    return run.groupBy("club_id").agg(F.count(F.when(F.col("_broken") == 0, 1)).alias("current_tier_streak"))


def gap_filled(table: DataFrame) -> DataFrame:
    """Every season from a club's first to its last: its tier, or OUTSIDE. A row fills the seasons up to the club's next one, so nothing is joined."""
    one = table.where("season_end_year is not null").select("club_id", "season_end_year", F.when(F.col("club_id").isNotNull(), F.col("tier")).alias("tier")).distinct()
    season, then = F.col("season_end_year"), F.lead("season_end_year").over(Window.partitionBy("club_id").orderBy("season_end_year"))
    until = one.withColumns({"_own": season, "_until": F.greatest(season, then - 1)})  # the last season, and the same season in another tier, fill themselves only
    filled = until.withColumn("season_end_year", F.explode(F.sequence(season, F.col("_until"))))
    return filled.select("club_id", "season_end_year", F.coalesce(F.when(season == F.col("_own"), F.col("tier")), F.lit(OUTSIDE)).alias("tier"))


def bucket_name(bucket: Column, vague: Column) -> Column:
    out = F.when(vague, OUTSIDE_VAGUE).otherwise(OUTSIDE_NAME)
    for t, name in TIER_NAMES.items():
        out = F.when(bucket == t, name).otherwise(out)
    return out


# The wording of labels here is a fixed value, as pages must show it.
def natural_level(table: DataFrame) -> DataFrame:
    """One row per club: distribution of its window, median tier, kind, label, trend and coverage note."""
    w = gap_filled(table).withColumn("_n", F.row_number().over(Window.partitionBy("club_id").orderBy(F.desc("season_end_year"))))
    median = lambda c: F.percentile_disc(0.5, c)
    low = lambda cond: F.expr(f"percentile_disc(0.5) within group (order by case when {cond} then tier end)")
    counts = {f"n{t}": F.count(F.when(F.col("tier") == t, 1)) for t in range(1, 7)}
    g = w.groupBy("club_id").agg(
        F.count("*").alias("seasons"),
        F.count(F.when(F.col("tier") != OUTSIDE, 1)).alias("recorded"),
        F.expr("percentile_disc(0.5) within group (order by tier)").cast("int").alias("median"),
        low(f"_n <= {RECENT}").cast("int").alias("recent"),
        low(f"_n > {RECENT} and _n <= {RECENT + PRIOR}").cast("int").alias("prior"),
        F.count(F.when((F.col("_n") > RECENT) & (F.col("_n") <= RECENT + PRIOR), 1)).alias("n_prior"),
        F.max((F.col("tier") == OUTSIDE) & (F.col("season_end_year") < 2006)).alias("early_gap"),
        *(c.alias(n) for n, c in counts.items()),
    )
    n_of = lambda t: F.coalesce(*(F.when(t == i, F.col(f"n{i}")) for i in range(1, 7)), F.lit(0))  # noqa: E731  # element_at takes a null index for -1 where counts cannot be null
    enough = (F.col("seasons") >= MIN_WINDOW) & (F.col("recorded") >= MIN_RECORDED)
    own = n_of(F.col("median"))
    below, above = n_of(F.col("median") - 1), n_of(F.col("median") + 1)
    often = [F.when(F.col(f"n{t}") >= 2, t) for t in range(1, 7)]
    spread = F.coalesce(F.greatest(*often) - F.least(*often) + 1, F.lit(1))
    g = g.withColumns({"own": own, "adjacent": F.when(F.greatest(below, above) > 0, F.when(below >= above, F.col("median") - 1).otherwise(F.col("median") + 1)), "n_adjacent": F.greatest(below, above), "spread": spread})
    kind = (
        F.when(~enough, "insufficient")
        .when(F.col("own") == F.col("seasons"), "ever-present")
        .when((F.col("own") * 5 < F.col("seasons") * 3) & F.col("adjacent").isNotNull() & ((F.col("own") + F.col("n_adjacent")) * 4 >= F.col("seasons") * 3), "yo-yo")
        .when(F.col("own") * 5 >= F.col("seasons") * 3, "established")
        .when(F.col("spread") >= 4, "broad")
        .otherwise("mixed")
    )
    g = g.withColumn("kind", kind)
    second = F.when(F.col("kind") == "yo-yo", F.col("adjacent"))
    name = lambda t: bucket_name(t, F.col("early_gap"))
    m = F.col("median")
    label = (
        F.when(F.col("kind") == "insufficient", "Insufficient record")
        .when(m == OUTSIDE, F.concat(F.lit("Mostly "), name(m)))
        .when(F.col("kind") == "ever-present", F.concat(name(m), F.lit(" ever-present")))
        .when(F.col("kind") == "established", F.concat(F.lit("Established "), name(m)))
        .when(F.col("kind") == "yo-yo", F.concat(name(F.least(m, second)), F.lit(" / "), name(F.greatest(m, second)), F.lit(" yo-yo club")))
        .when(F.col("kind") == "broad", F.concat(name(m), F.lit(" club (whole-pyramid range)")))
        .otherwise(F.concat(name(m), F.lit(" club")))
    )
    trend = F.when(enough & (F.col("n_prior") >= MIN_PRIOR), F.when(F.col("recent") < F.col("prior"), "rising").when(F.col("recent") > F.col("prior"), "falling").otherwise("level"))
    share = F.bround((F.col("own") / F.col("seasons")).cast("decimal(20,10)"), 3).cast("double")
    spread_out = F.to_json(F.create_map(*(x for t in range(1, 7) for x in (F.lit("outside" if t == 6 else str(t)), F.col(f"n{t}")))))
    return g.select(
        "club_id",
        "seasons",
        "recorded",
        F.when(enough, m).alias("natural_tier"),
        F.when(enough, second).alias("second_tier"),
        "kind",
        label.alias("label"),
        F.when(enough, share).alias("share"),
        F.when(enough, F.col("recent")).alias("recent_tier"),
        trend.alias("trend"),
        F.when(F.col("early_gap"), "pre2006-gap").alias("coverage_note"),
        spread_out.alias("tier_distribution"),
        *counts,
    )


def level_gap(current: Column, natural: Column, active: Column) -> Column:
    """How far below its level a club is; null if it is not active or its level is outside."""
    return F.when(active & natural.isNotNull() & (natural != OUTSIDE), current - natural)


def with_gap(careers: DataFrame, latest: Column) -> DataFrame:
    """Adds level_gap: clubs whose last season is the latest of all are active."""
    return careers.withColumn("level_gap", level_gap(F.col("current_tier"), F.col("natural_tier"), F.col("last_season_in_db") == latest))


def trajectory(table: DataFrame, latest: int | None = None) -> DataFrame:
    """The career table: rollup, streak, natural level and gap of every club. latest: the latest season, if table has only some of the clubs."""
    known = table.where(F.col("club_id").isNotNull()).repartition("club_id")  # all that follows is by club, and stays where it is
    joined = rollup(known).join(streak(known), "club_id").join(natural_level(known).drop(*(f"n{t}" for t in range(1, 7))), "club_id")
    if latest is not None:
        return with_gap(joined, F.lit(latest))
    last = table.where(F.col("club_id").isNotNull()).agg(F.max("season_end_year").alias("_latest"))  # from rows as they lie
    return with_gap(joined.join(F.broadcast(last), F.lit(True)), F.col("_latest")).drop("_latest")  # one row


def level_panel(levels: DataFrame) -> DataFrame:
    """The share of each tier in a club's window, in percent to two places (half to even); empty tiers are left out."""
    parts = F.array(*(F.struct(F.lit(t).alias("bucket"), F.col(f"n{t}").alias("n")) for t in range(1, 7)))
    percent = F.bround((F.col("p.n") * 100 / F.col("seasons")).cast("decimal(20,8)"), 2).cast("double")
    return levels.select("club_id", "seasons", F.explode(parts).alias("p")).where("p.n > 0").select("club_id", "p.bucket", "p.n", percent.alias("percent"))


def level_lines(levels: DataFrame) -> DataFrame:
    """The sentences of the level panel: window, trend and gap. levels: rows of `trajectory` whose level is known."""
    n = F.abs("level_gap")
    recent = bucket_name(F.col("recent_tier"), F.col("coverage_note").isNotNull())
    window = F.when(F.col("recorded") < F.col("seasons"), F.concat(F.col("seasons").cast("string"), F.lit(" seasons, "), F.col("recorded").cast("string"), F.lit(" of them inside the top five tiers"))).otherwise(F.concat(F.col("seasons").cast("string"), F.lit(" recorded seasons")))
    trend = F.when(F.col("trend") == "rising", F.concat(F.lit("Rising — the last five seasons average out at "), recent, F.lit("."))).when(F.col("trend") == "falling", F.concat(F.lit("Falling — the last five seasons average out at "), recent, F.lit("."))).when(F.col("trend") == "level", "Holding steady against the previous decade.")
    gap = F.when(F.col("level_gap") != 0, F.concat(F.lit("Currently "), n.cast("string"), F.lit(" division"), F.when(n > 1, "s").otherwise(""), F.when(F.col("level_gap") > 0, " below").otherwise(" above"), F.lit(" that level.")))
    return levels.where("natural_tier is not null").select("club_id", "label", window.alias("window_note"), trend.alias("trend_line"), gap.alias("gap_line"))
