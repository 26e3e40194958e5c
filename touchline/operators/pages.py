"""Rows of the pages about clubs: names, seasons, cards, movement in groups, filters of the map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.text import labelled, season_label
from touchline.operators.career import bucket_name
from touchline.plans.rules import PATTERN_LABELS, TIER_NAMES


def directory(careers: DataFrame, clubs: DataFrame) -> DataFrame:
    """Careers with the names and grounds of the club dimension; a club that is not in it has no page."""
    return careers.join(clubs, "club_id")


def display_names(rows: DataFrame, clubs: DataFrame, careers: DataFrame, key: str = "club_id") -> DataFrame:
    """Adds name (the id where the club has none) and linked (whether the club has a career, and so a page)."""
    names = clubs.select(F.col("club_id").alias(key), F.col("canonical_name").alias("_name"))
    pages = careers.select(F.col("club_id").alias(key), F.lit(True).alias("_page")).distinct()
    joined = rows.join(names, key, "left").join(pages, key, "left")
    return joined.withColumns({"name": F.coalesce("_name", F.col(key).cast("string")), "linked": F.coalesce("_page", F.lit(False))}).drop("_name", "_page")


def season_by_season(table: DataFrame) -> DataFrame:
    """A club's seasons, newest first, with their labels and their place in that order."""
    back = Window.partitionBy("club_id").orderBy(F.desc("season_end_year"))
    return table.withColumns({"nth": F.row_number().over(back), "season": season_label(F.col("season_end_year")), "slug": season_label(F.col("season_end_year"), "-")})


def stat_cards(careers: DataFrame) -> DataFrame:
    """club_id, n, label, value: the cards of a club's page in order. Natural level and top-flight seasons are left out where there are none."""
    text = lambda c: c.cast("string")
    card = lambda label, value: F.struct((F.lit(label) if isinstance(label, str) else label).alias("label"), value.alias("value"))
    c = F.col
    cards = F.array(
        F.when(c("natural_tier").isNotNull(), card("Natural level", bucket_name(c("natural_tier"), c("coverage_note").isNotNull()))),
        card("Current level", F.concat(F.lit("Tier "), text(c("current_tier")))),
        card("Seasons at this level", text(c("current_tier_streak"))),
        F.when(c("seasons_in_tier1") > 0, card(F.concat(F.lit("Top-flight seasons (last "), text(c("last_tier1_season")), F.lit(")")), text(c("seasons_in_tier1")))),
        card("Tier range", F.concat(text(c("highest_tier")), F.lit("–"), text(c("lowest_tier")))),
        card("Promotions", text(c("total_promotions"))),
        card("Relegations", text(c("total_relegations"))),
        card("Yo-yo score", text(c("yo_yo_score"))),
    )
    return careers.select("club_id", F.posexplode(F.array_compact(cards)).alias("n", "c")).select("club_id", "n", "c.label", "c.value")


def movement_path(first: Column, last: Column, start: Column, end: Column) -> Column:
    """`2003/04 → 2004/05 — Championship to League Two`."""
    tier = lambda t: F.coalesce(labelled(t, TIER_NAMES), F.lit("?"))
    years = F.array_join(F.transform(F.sequence(first, last), lambda y: season_label(y)), " → ")
    return F.concat(years, F.lit(" — "), tier(start), F.lit(" to "), tier(end))


def movement_sections(found: DataFrame, table: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of the two pages on movement: groups in their order, the newest pattern first within each.

    found: patterns with bounds and outcome; table: seasons, for the tier in which a pattern begins;
    groups: the literal table of pages and groups.
    """
    falls = F.col("pattern").startswith("relegation")
    began = table.select("club_id", F.col("season_end_year").alias("first"), F.col("tier").alias("_began")).distinct()
    rows = found.join(began, ["club_id", "first"], "left").withColumns({"page": F.when(falls, "the-drop").otherwise("the-rise"), "pattern_label": labelled(F.col("pattern"), PATTERN_LABELS)})
    rows = rows.withColumn("path", movement_path(F.col("first"), F.col("last"), F.col("_began"), F.when(falls, F.col("floor_tier")).otherwise(F.col("peak_tier"))))
    placed = rows.join(F.broadcast(groups), ["page", "outcome"])  # a literal table of eleven rows
    return placed.drop("_began").orderBy("page", "place", F.desc("last"), "club_id", "pattern")


def movement_page_stats(found: DataFrame) -> DataFrame:
    """Per page: patterns, clubs, how many came back (or held), how many did not."""
    falls = F.col("pattern").startswith("relegation")
    good, bad = F.col("outcome").isin("recovered", "held"), F.when(falls, F.col("outcome").isin("stuck", "outside")).otherwise(F.col("outcome").isin("slipped", "fell_back", "outside"))
    return found.groupBy(F.when(falls, "the-drop").otherwise("the-rise").alias("page")).agg(F.count("*").alias("records"), F.countDistinct("club_id").alias("clubs"), F.count(F.when(good, 1)).alias("good"), F.count(F.when(bad, 1)).alias("bad"))


def case_study(careers: DataFrame, club_id) -> DataFrame:
    """The career of one club as a case study shows it; no row for an unknown club."""
    return careers.where(F.col("club_id") == F.lit(club_id)).select("club_id", F.col("label").alias("natural_level_label"), "yo_yo_score", "total_promotions", "total_relegations")


def map_rows(careers: DataFrame, clubs: DataFrame, table: DataFrame) -> DataFrame:
    """Clubs with a place on the map: name, ground, and the tier of each season as a map."""
    tiers = table.groupBy("club_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("season_end_year").cast("string"), "tier")))).alias("tiers"))
    return clubs.where("latitude is not null").join(careers, "club_id").join(tiers, "club_id")


def on_map(flagged: DataFrame, table: DataFrame, season: int, tiers: list[int], flag: str | None = None) -> DataFrame:
    """What the map's filters leave: clubs that have the flag and play in one of the tiers in the selected season."""
    there = table.where((F.col("season_end_year") == season) & F.col("tier").isin(tiers)).select("club_id", "tier")
    return (flagged if flag is None else flagged.where(F.col(flag))).join(there, "club_id")


def teams_by_tier(careers: DataFrame) -> DataFrame:
    """Clubs grouped by the name of their tier, in order of their ids."""
    g = careers.groupBy(F.col("current_tier").alias("tier")).agg(F.array_sort(F.collect_list("club_id")).alias("clubs"))
    return g.select("tier", F.coalesce(labelled(F.col("tier"), TIER_NAMES), F.lit("Other")).alias("label"), "clubs")
