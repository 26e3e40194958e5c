"""Club stories: facts to themes, dated events, rivalries. Facts are one struct column per club."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from touchline.functions.text import first_year, labelled, plural, season_label, season_of_year, thousands
from touchline.plans.rules import ORIGIN_LABELS, OWNERSHIP_LABELS, STADIUM_OWNERSHIP_LABELS

FACTS = """struct<founded:int,origin_type:string,origin_note:string,nickname:string,ownership_model:string,owner:string,owner_since:int,multi_club_group:string,
administration:array<struct<year:int,points_deducted:int,note:string>>,points_deductions:array<struct<season_end_year:int,points:int,reason:string>>,
drops:array<struct<season:int,note:string>>,rises:array<struct<season:int,note:string>>,
rivalries:array<struct<opponent:string,name:string,note:string>>,stadium:string,stadium_opened:int,capacity:int,stadium_ownership:string,pitch_type:string,
previous_grounds:array<struct<name:string,years:string>>,exile:array<struct<venue:string,seasons:string,distance_miles:int>>,
ground_grading_denial:array<struct<season_end_year:int,note:string>>,phoenix_of:string,predecessor_folded:int,themes:array<string>,theme_notes:map<string,string>>"""


def facts_of(front_matter: Column) -> Column:
    """The facts struct of a story's YAML front matter; malformed text, or one that is no mapping, gives a struct of nulls."""

    def to_json(fronts: pd.Series) -> pd.Series:
        import yaml  # needed on executors only where stories are read

        def read(text: str | None) -> str:
            try:
                facts = yaml.safe_load(text or "")
            except yaml.YAMLError:
                facts = None
            facts = facts if isinstance(facts, dict) else {}
            if isinstance(facts.get("themes"), str):
                facts["themes"] = [facts["themes"]]
            return json.dumps(facts, default=str)

        texts = {t: read(t) for t in set(fronts)}  # equal texts of a batch once
        return fronts.map(lambda t: texts[t])

    return F.from_json(F.pandas_udf(to_json, StringType())(front_matter), FACTS)


def read_facts(stories: DataFrame) -> DataFrame:
    """stories with facts and themes of their front_matter, each read once. Rows are dealt to all tasks before, as YAML takes long and a scan may be one task."""
    tasks = int(stories.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stories.repartition(tasks, "club_id", F.xxhash64("front_matter"))
    return dealt.withColumn("facts", facts_of(F.col("front_matter"))).withColumn("themes", theme_list())


def with_facts(stories: DataFrame) -> DataFrame:
    """stories of `read_stories` with facts, themes and has_prose: what a club's file says."""
    return read_facts(stories).withColumn("has_prose", (F.size("sections") > 0) | (F.col("extra") != ""))


def _some(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) > 0


def theme_list() -> Column:
    """The themes of the column facts: from facts and from the manual list, sorted, each once."""
    f = lambda n: F.col(f"facts.{n}")
    derived = F.array_compact(
        F.array(
            F.when(F.nullif(f("phoenix_of"), F.lit("")).isNotNull(), "phoenix"),
            F.when(f("ownership_model") == "fan_trust", "fan-owned"),
            F.when(_some(f("administration")), "administration"),
            F.when(_some(f("points_deductions")), "points-deductions"),
            F.when(_some(f("exile")), "exiled"),
            F.when(_some(f("ground_grading_denial")), "ground-grading"),
        )
    )
    manual = F.filter(F.transform(F.coalesce(f("themes"), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_sort(F.array_distinct(F.concat(derived, manual)))


def themes(facts: DataFrame) -> DataFrame:
    """club_id and its themes."""
    return facts.select("club_id", theme_list().alias("themes"))


# Labels and texts of events are fixed values, as pages must show them.
def theme_events(facts: DataFrame) -> DataFrame:
    """club_id, theme, season_end_year, label, text: why a club is on a theme; calendar years move to the season that they end in."""

    def of(theme: str, items: str | None, year, calendar: bool, label: str, text, cond=None) -> DataFrame:
        rows = facts if items is None else facts.select("club_id", "facts", F.explode(f"facts.{items}").alias("e"))
        rows = rows if cond is None else rows.where(cond)
        season = season_of_year(year, F.lit(calendar))
        return rows.select("club_id", F.lit(theme).alias("theme"), season.cast("int").alias("season_end_year"), F.lit(label).alias("label"), text.alias("text")).where("season_end_year is not null")

    year_of = lambda c: F.when(c.between(1800, 2100), c)
    e, f = lambda n: F.col(f"e.{n}"), lambda n: F.col(f"facts.{n}")
    given = lambda c, before, after="": F.coalesce(F.when(F.nullif(c.cast("string"), F.lit("")).isNotNull(), F.concat(F.lit(before), c.cast("string"), F.lit(after))), F.lit(""))
    points = F.coalesce(F.when(e("points_deducted") != 0, F.concat(F.lit(", and was docked "), plural(e("points_deducted"), "point"))), F.lit(""))
    old = F.nullif(f("phoenix_of"), F.lit(""))
    parts = [
        of("administration", "administration", year_of(e("year")), True, "Administration", F.concat(F.lit("Entered administration in "), e("year").cast("string"), points, F.lit("."), given(e("note"), " ", "."))),
        of("points-deductions", "points_deductions", year_of(e("season_end_year")), False, "Points deduction", F.concat(F.lit("Docked "), plural(e("points"), "point"), F.lit(" in "), season_label(e("season_end_year")), F.lit("."), given(e("reason"), " ", ".")), F.col("e.points") != 0),
        of("exiled", "exile", first_year(e("seasons")), True, "Exile begins", F.concat(F.lit("Played home games at "), e("venue"), given(e("seasons"), ", "), given(F.nullif(e("distance_miles"), F.lit(0)), " — about ", " miles from home"), F.lit(".")), F.col("e.venue") != ""),
        of("ground-grading", "ground_grading_denial", year_of(e("season_end_year")), False, "Ground grading", F.concat(F.coalesce(F.nullif(e("note"), F.lit("")), F.lit("Promotion denied on ground grading")), F.lit("."))),
        of("phoenix", None, year_of(f("predecessor_folded")), True, "Predecessor folded", F.concat(old, F.lit(" ceased to exist in "), f("predecessor_folded").cast("string"), F.lit(".")), old.isNotNull()),
        of("phoenix", None, year_of(f("founded")), True, "Club founded", F.concat(F.lit("Founded in "), f("founded").cast("string"), given(old, ", succeeding "), F.lit("."))),
        of("fan-owned", None, year_of(f("owner_since")), True, "Fans take control", F.concat(F.coalesce(F.nullif(f("owner"), F.lit("")), F.lit("The supporters' trust")), F.lit(" took control in "), f("owner_since").cast("string"), F.lit("."))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def theme_narratives(facts: DataFrame) -> DataFrame:
    """Per club and theme: the note of the author, or the texts of the events in order."""
    told = theme_events(facts).groupBy("club_id", "theme").agg(F.array_sort(F.collect_list(F.struct("season_end_year", "text"))).alias("t"))
    on = themes(facts).select("club_id", F.explode("themes").alias("theme"))
    notes = facts.select("club_id", F.explode("facts.theme_notes").alias("theme", "note")).where("trim(note) != ''")
    joined = on.join(told, ["club_id", "theme"], "left").join(notes, ["club_id", "theme"], "left")
    return joined.select("club_id", "theme", F.coalesce(F.trim("note"), F.concat_ws(" ", F.col("t.text")), F.lit("")).alias("narrative"))


def boom_and_bust(events: DataFrame) -> DataFrame:
    """Administrations and deductions in order of time."""
    return events.where(F.col("theme").isin("administration", "points-deductions"))


def rivalries(entries: DataFrame, clubs: DataFrame) -> DataFrame:
    """One row per unordered pair of known clubs: the entry with the longest note; among equals the first (column seq)."""
    known = clubs.select(F.col("club_id").alias("opponent"))
    a, b = F.least("club_id", "opponent"), F.greatest("club_id", "opponent")
    pairs = entries.join(known, "opponent", "left_semi").withColumns({"club_a": a, "club_b": b})
    order = Window.partitionBy("club_a", "club_b").orderBy(F.desc(F.length(F.coalesce("note", F.lit("")))), "seq")
    return pairs.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def points_lost(facts: DataFrame) -> DataFrame:
    """The points of all recorded deductions in one row (those named by administrations alone are not among them)."""
    lost = F.explode(F.transform("facts.points_deductions", lambda e: F.coalesce(e["points"], F.lit(0))))
    return facts.select(lost.alias("points")).agg(F.coalesce(F.sum("points"), F.lit(0)).alias("points"))


def boom_and_bust_stats(events: DataFrame, facts: DataFrame) -> DataFrame:
    """One row: clubs, events, points and span of the administrations and deductions."""
    b = boom_and_bust(events).agg(F.countDistinct("club_id").alias("clubs"), F.count("*").alias("events"), F.min("season_end_year").alias("lo"), F.max("season_end_year").alias("hi"))
    span = F.concat((F.col("lo") - 1).cast("string"), F.lit("–"), F.col("hi").cast("string"))
    return b.join(points_lost(facts)).select("clubs", "events", "points", span.alias("span"))  # two rows of one


# The labels of the panel are fixed values.
def facts_panel(facts: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Label and value of every fact in the order of the panel; blanks are dropped, lists have a row for each entry.

    names: club_id and name, for the opponents of rivalries; an opponent without a name is shown by its id.
    """
    f = lambda n: F.col(f"facts.{n}")
    text = lambda c: F.nullif(c.cast("string"), F.lit(""))
    none = F.lit(None).cast("string")
    entry = lambda label, value, opponent=none: F.struct(F.lit(label).alias("label"), value.cast("string").alias("value"), opponent.alias("opponent"))
    add = lambda c, before, after="": F.coalesce(F.concat(F.lit(before), text(c), F.lit(after)), F.lit(""))
    many = lambda label, items, value, opponent=lambda e: none: F.transform(F.coalesce(f(items), F.array()), lambda e: entry(label, value(e), opponent(e)))
    nonzero = lambda c: F.nullif(c, F.lit(0))
    season = lambda c: season_label(nonzero(c))
    founded, origin = nonzero(f("founded")), labelled(f("origin_type"), ORIGIN_LABELS)
    dated = lambda e: F.concat(F.coalesce(F.concat(season(e["season"]), F.lit(" · ")), F.lit("")), text(e["note"]))
    rows = F.concat(
        F.array(
            entry("Nickname", f("nickname")),
            entry("Founded", F.concat(founded.cast("string"), add(origin, " · "))),
            entry("Origin", F.when(founded.isNull(), origin)),
            entry("Formed as", f("origin_note")),
            entry("Owner", F.concat(text(f("owner")), add(nonzero(f("owner_since")), " (since ", ")"))),
            entry("Ownership model", labelled(f("ownership_model"), OWNERSHIP_LABELS)),
            entry("Multi-club group", f("multi_club_group")),
            entry("Stadium", F.concat(text(f("stadium")), add(nonzero(f("stadium_opened")), " (opened ", ")"))),
            entry("Ground ownership", labelled(f("stadium_ownership"), STADIUM_OWNERSHIP_LABELS)),
            entry("Capacity", thousands(nonzero(f("capacity")))),
            entry("Pitch", F.when(f("pitch_type") == "artificial_3g", "Artificial 3G")),
        ),
        many("Former ground", "previous_grounds", lambda e: F.concat(text(e["name"]), add(e["years"], " (", ")"))),
        many("Played home games at", "exile", lambda e: F.concat(text(e["venue"]), add(e["seasons"], " · "), add(nonzero(e["distance_miles"]), " · ~", " miles away"))),
        many("Administration", "administration", lambda e: F.concat(nonzero(e["year"]).cast("string"), add(nonzero(e["points_deducted"]), " · −", " points"))),
        many("Points deduction", "points_deductions", lambda e: F.concat(F.lit("−"), nonzero(e["points"]).cast("string"), F.lit(" points"), add(season(e["season_end_year"]), " in "), add(e["reason"], " · "))),
        many("Ground grading", "ground_grading_denial", lambda e: F.concat(F.coalesce(F.concat(season(e["season_end_year"]), F.lit(" · ")), F.lit("")), F.coalesce(text(e["note"]), F.lit("Promotion denied on ground grading")))),
        F.array(entry("Successor to", F.concat(text(f("phoenix_of")), add(nonzero(f("predecessor_folded")), " (folded ", ")")))),
        many("Featured on The drop", "drops", dated),
        many("Featured on The rise", "rises", dated),
        many("Rivalry", "rivalries", lambda e: F.when(text(e["opponent"]).isNotNull(), F.concat(add(e["name"], " (", ")"), add(e["note"], " · "))), lambda e: text(e["opponent"])),
    )
    shown = F.filter(rows, lambda r: r["value"].isNotNull() & ((r["value"] != "") | r["opponent"].isNotNull()))
    listed = facts.select("club_id", F.posexplode(shown).alias("n", "r")).select("club_id", "n", "r.*")
    if names is not None:
        listed = listed.join(names.select(F.col("club_id").cast("string").alias("opponent"), F.col("name").alias("_name")), "opponent", "left")
    opponent = F.coalesce("_name", "opponent") if names is not None else F.col("opponent")
    return listed.select("club_id", "n", "label", F.coalesce(F.concat(F.lit("vs "), opponent, F.col("value")), F.col("value")).alias("value"))


def on_chart(events: DataFrame, positions: DataFrame) -> DataFrame:
    """Events of themes with the club's overall position that season; those without one are not on the chart."""
    p = positions.select("club_id", "season_end_year", "overall_position")
    return events.join(p, ["club_id", "season_end_year"], "left").withColumn("on_chart", F.col("overall_position").isNotNull())


def with_notes(patterns: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patterns with the first note on their club and last season, notes that fit no pattern). notes: club_id, last, note, seq."""
    first = notes.groupBy("club_id", "last").agg(F.min_by("note", "seq").alias("note"))
    return patterns.join(first, ["club_id", "last"]), notes.join(patterns.select("club_id", "last").distinct(), ["club_id", "last"], "left_anti")
