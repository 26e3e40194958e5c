"""From matches to judged season tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.plans.rules import IN_PROGRESS

SEASON = ["season_end_year", "tier"]


def valid_results(matches: DataFrame) -> DataFrame:
    return matches.where(F.col("ftr").isin("H", "D", "A"))


def first_of_each(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key: the first in a total order, so that the choice does not depend on the plan."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def own_division(matches: DataFrame, expected: Column, file_col: str = "file") -> DataFrame:
    """Matches of files whose division codes are all the expected one; files without codes pass."""
    wrong = matches.where(F.nullif(F.trim("div"), F.lit("")) != expected).select(file_col).distinct()
    return matches.join(wrong, file_col, "left_anti")


def foreign_codes(matches: DataFrame, expected: Column, file_col: str = "file") -> DataFrame:
    """Per file the division codes that are not the expected one (the column `expected` is one value a file)."""
    codes = matches.groupBy(file_col).agg(F.array_sort(F.array_compact(F.collect_set(F.nullif(F.trim("div"), F.lit(""))))).alias("codes"), F.first(expected).alias("_expected"))
    return codes.select(file_col, F.array_except("codes", F.array("_expected")).alias("foreign"))


def perspectives(matches: DataFrame, *keep: str) -> DataFrame:
    """Two rows for each match: each club's view with goals and result."""
    side = lambda own, other, gf, ga, won: F.struct(F.col(own).alias("club_id"), F.col(other).alias("opponent_id"), F.col(gf).alias("gf"), F.col(ga).alias("ga"), F.when(F.col("ftr") == "D", "D").when(F.col("ftr") == won, "W").otherwise("L").alias("result"))
    both = F.explode(F.array(side("home_id", "away_id", "fthg", "ftag", "H"), side("away_id", "home_id", "ftag", "fthg", "A")))
    return matches.select(*keep, both.alias("s")).select(*keep, "s.*")


def standings(matches: DataFrame) -> DataFrame:
    """The league tables: wins and draws from the result, not from goals; ranked by points, difference, goals, club."""
    one = lambda r: F.count(F.when(F.col("result") == r, 1))
    sums = perspectives(valid_results(matches), *SEASON).groupBy(*SEASON, "club_id").agg(one("W").alias("won"), one("D").alias("drawn"), one("L").alias("lost"), F.sum("gf").alias("gf"), F.sum("ga").alias("ga"))
    full = sums.withColumns({"played": F.expr("won + drawn + lost"), "gd": F.expr("gf - ga"), "points": F.expr("3 * won + drawn")})
    return rank_standings(full)


def rank_standings(table: DataFrame) -> DataFrame:
    order = Window.partitionBy(*SEASON).orderBy(F.desc("points"), F.desc("gd"), F.desc("gf"), "club_id")
    return table.withColumn("position", F.row_number().over(order))


def completeness(table: DataFrame, matches: DataFrame, expected: Column | None = None) -> DataFrame:
    """data_complete by season and tier: 1 from n(n-1) matches on, else 0; null without matches."""
    clubs = table.groupBy(*SEASON).agg(F.countDistinct("club_id").alias("n_clubs"))
    found = matches.groupBy(*SEASON).agg(F.count("*").alias("n_matches"))
    want = F.expr("n_clubs * (n_clubs - 1)") if expected is None else expected
    counted = clubs.join(found, SEASON, "left").withColumn("n_expected", want)
    return counted.withColumn("data_complete", F.when(F.col("n_matches").isNull(), None).when(F.col("n_matches") >= F.col("n_expected"), 1).otherwise(0))


def coverage_note(counted: DataFrame) -> DataFrame:
    short = (F.col("data_complete") == 0) & (F.col("n_matches") > 0) & (F.col("n_matches") < F.col("n_expected"))
    return counted.withColumn("note", F.when(short, F.concat(F.col("n_matches").cast("string"), F.lit(" of "), F.col("n_expected").cast("string"), F.lit(" matches"))))


def season_complete(n_matches: Column, expected: Column, season: Column, current: int) -> Column:
    return (season < current) | (n_matches >= expected * 0.95)


def plausible(counted: DataFrame, rules: DataFrame) -> DataFrame:
    """Seasons without more clubs than their rule has; seasons without a rule pass."""
    ruled = rules_for(counted, rules, "total_clubs")
    return ruled.where("total_clubs is null or n_clubs <= total_clubs").drop("total_clubs")


def rules_for(seasons: DataFrame, rules: DataFrame, *columns: str) -> DataFrame:
    """The rule of each season and tier: of those whose range holds the season, the one that starts last."""
    keys = seasons.select(*SEASON).distinct()
    r = F.broadcast(rules.withColumnRenamed("tier", "_tier"))  # a literal table of fewer than 30 rows
    hit = keys.join(r, (F.col("tier") == F.col("_tier")) & F.col("season_end_year").between(F.col("from_year"), F.col("to_year")))
    best = hit.groupBy(*SEASON).agg(F.max_by(F.struct(*columns), "from_year").alias("_r"))
    return seasons.join(best, SEASON, "left").select(*seasons.columns, *(F.col(f"_r.{c}").alias(c) for c in columns))


def with_division_name(seasons: DataFrame, divisions: DataFrame) -> DataFrame:
    d = F.broadcast(divisions.withColumnRenamed("tier", "_tier"))  # a literal table of nine rows
    on = (F.col("tier") == F.col("_tier")) & (F.col("season_end_year") >= F.col("from_year")) & (F.col("season_end_year") < F.col("until_year"))
    return seasons.join(d, on, "left").select(*seasons.columns, F.coalesce("division_name", F.concat(F.lit("Tier "), F.col("tier").cast("string"))).alias("division_name"))


RANGES = ("up_lo", "up_hi", "playoff_lo", "playoff_hi", "po_down_lo", "po_down_hi", "down_lo", "down_hi")


def status_of(position: Column, complete: Column, has_rule: Column) -> Column:
    """The outcome of a position under the ranges in scope."""
    within = lambda r: F.coalesce(position.between(F.col(f"{r}_lo"), F.col(f"{r}_hi")), F.lit(False))
    return (
        F.when(~complete, IN_PROGRESS)
        .when(~has_rule, "Stayed")
        .when(position == 1, "Champions")
        .when(within("up"), "Promoted")
        .when(within("playoff"), "Play-off Promoted")
        .when(within("down"), "Relegated")
        .when(within("po_down"), "Play-off Relegated")
        .otherwise("Stayed")
    )


def assign_status(table: DataFrame, rules: DataFrame, complete: Column | None = None) -> DataFrame:
    """Adds status; `rules` is the rule table, or ranges by season and tier."""
    done = F.lit(True) if complete is None else complete
    if "from_year" in rules.columns:
        ruled = rules_for(table, rules, "total_clubs", *RANGES).withColumn("_rule", F.col("total_clubs").isNotNull()).drop("total_clubs")
    else:
        ruled = table.join(rules.withColumn("_rule", F.lit(True)), SEASON, "left").withColumn("_rule", F.coalesce("_rule", F.lit(False)))
    return ruled.withColumn("status", status_of(F.col("position"), done, F.col("_rule"))).drop("_rule", *RANGES)


def deduction_totals(deductions: DataFrame) -> DataFrame:
    """Points of applied sanctions by club and season; several sanctions add up."""
    return deductions.where("applied = 1").groupBy("club_id", "season_end_year").agg(F.sum("points").alias("points_deducted"))


def apply_deductions(table: DataFrame, deductions: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Points anew from wins and draws less deductions, positions and statuses anew where a club was docked. Applying twice changes nothing."""
    docked = table.drop("points_deducted").join(deduction_totals(deductions), ["club_id", "season_end_year"], "left")
    seasons = docked.where("points_deducted is not null").select(*SEASON).distinct().withColumn("_docked", F.lit(True))
    marked = docked.join(seasons, SEASON, "left")
    points = F.expr("3 * won + drawn") - F.coalesce("points_deducted", F.lit(0))
    new = marked.withColumn("points", F.when(F.col("_docked"), points).otherwise(F.col("points"))).withColumn("points_deducted", F.coalesce("points_deducted", F.lit(0)))
    ranked = new.withColumnRenamed("position", "_was")
    ranked = rank_standings(ranked).withColumn("position", F.when(F.col("_docked"), F.col("position")).otherwise(F.col("_was"))).drop("_was")
    if rules is not None:
        judged = assign_status(ranked.withColumnRenamed("status", "_was"), rules, F.col("_was") != IN_PROGRESS)
        ranked = judged.withColumn("status", F.when(F.col("_docked"), F.col("status")).otherwise(F.col("_was"))).drop("_was")
    return ranked.drop("_docked")


def with_next(table: DataFrame) -> DataFrame:
    """Adds next_tier and next_status of the season right after, null where the club has none."""
    w = Window.partitionBy("club_id").orderBy("season_end_year")
    follows = F.lead("season_end_year").over(w) == F.col("season_end_year") + 1
    return table.withColumns({"next_tier": F.when(follows, F.lead("tier").over(w)), "next_status": F.when(follows, F.lead("status").over(w))})


def reconcile(table: DataFrame) -> DataFrame:
    """Corrects statuses by where the club played next. Champions are never changed, nor seasons in progress."""
    known = F.col("next_tier").isNotNull() & (F.col("status") != IN_PROGRESS) & (F.col("next_status") != IN_PROGRESS)
    up, down = F.col("next_tier") < F.col("tier"), F.col("next_tier") > F.col("tier")
    s = F.col("status")
    new = (
        F.when(~F.coalesce(known, F.lit(False)), s)
        .when(s.isin("Promoted", "Play-off Promoted") & ~up, "Stayed")
        .when(s.isin("Relegated", "Play-off Relegated") & ~down, "Stayed")
        .when((s == "Stayed") & up, "Promoted")
        .when((s == "Stayed") & down, "Relegated")
        .otherwise(s)
    )
    return with_next(table).withColumn("status", new).drop("next_tier", "next_status")


def known_winners(table: DataFrame, winners: DataFrame) -> DataFrame:
    """Where the next season of the tier is not settled yet, only the known winner stays Play-off Promoted."""
    settled = table.where(F.col("status") != IN_PROGRESS).select((F.col("season_end_year") - 1).alias("season_end_year"), "tier").distinct()
    w = F.broadcast(winners.join(settled, SEASON, "left_anti").withColumnRenamed("club_id", "_winner"))  # one row a tier
    joined = table.join(w, SEASON, "left")
    lost = F.col("_winner").isNotNull() & (F.col("status") == "Play-off Promoted") & (F.col("club_id") != F.col("_winner"))
    return joined.withColumn("status", F.when(lost, "Stayed").otherwise(F.col("status"))).drop("_winner")


def seasons_in_progress(table: DataFrame) -> DataFrame:
    return table.where(F.col("status") == IN_PROGRESS).select("season_end_year").distinct()
