"""Club accounts: validation, ranks among published figures, ratios and metric points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.text import json_strings, labelled, money, ordinal, season_label, wage_ratio
from touchline.operators.pyramid import overall_positions
from touchline.operators.ranking import shared_ranks, smaller_in
from touchline.plans.rules import CONSOLIDATION_LEVELS, DISCLOSURES, FLAG_LABELS, STAFF_COSTS_DEFINITIONS

MONEY = ("turnover", "staff_costs", "profit_before_tax", "net_debt", "revenue_matchday", "revenue_broadcast", "revenue_commercial")


def with_errors(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Adds errors: the messages of all checks that hold for the row."""
    found = F.array_compact(F.array(*(F.when(c, F.lit(m)) for m, c in checks.items())))
    return rows.withColumn("errors", found)


def finance_errors(rows: DataFrame, clubs: DataFrame | None = None) -> DataFrame:
    """Validates accounts: keys, disclosure, no money where it is not full, a definition for staff costs, flags as a JSON array."""
    money = [c for c in MONEY if c in rows.columns]
    none = F.lit(False)
    checks = {
        "missing key": F.col("club_id").isNull() | F.col("season_end_year").isNull(),
        "bad disclosure": ~F.coalesce(F.col("disclosure").isin(*DISCLOSURES), none),
        "money without full disclosure": (F.col("disclosure") != "full") & F.coalesce(*money).isNotNull(),
    }
    if "staff_costs_definition" in rows.columns:
        checks["staff costs without definition"] = F.col("staff_costs").isNotNull() & F.nullif(F.trim("staff_costs_definition"), F.lit("")).isNull()
        checks["bad staff costs definition"] = ~F.nullif(F.trim("staff_costs_definition"), F.lit("")).isin(*STAFF_COSTS_DEFINITIONS)
    if "consolidation_level" in rows.columns:
        checks["bad consolidation level"] = ~F.nullif(F.trim("consolidation_level"), F.lit("")).isin(*CONSOLIDATION_LEVELS)
    if "flags" in rows.columns:
        checks["flags are no JSON array"] = F.col("flags").isNotNull() & (F.trim("flags") != "") & (F.from_json("flags", "array<string>").isNull() | ~F.trim("flags").startswith("["))
    if clubs is not None:
        known = clubs.select("club_id").distinct().withColumn("_known", F.lit(True))
        rows = rows.join(known, "club_id", "left")
        checks["unknown club"] = F.col("club_id").isNotNull() & F.col("_known").isNull()
    return with_errors(rows, checks).drop("_known")


def deduction_errors(rows: DataFrame, clubs: DataFrame) -> DataFrame:
    known = clubs.select("club_id").distinct().withColumn("_known", F.lit(True))
    checks = {
        "unknown club": F.col("_known").isNull(),
        "missing season or points": F.col("season_end_year").isNull() | F.col("points").isNull(),
        "points not positive": F.col("points") <= 0,
        "applied is no flag": ~F.coalesce(F.col("applied").isin(0, 1), F.lit(False)),
        "no source": F.nullif(F.trim("source_url"), F.lit("")).isNull(),
    }
    return with_errors(rows.join(known, "club_id", "left"), checks).drop("_known")


def placed(accounts: DataFrame, table: DataFrame) -> DataFrame:
    """Accounts of clubs that played in a tier that season."""
    return accounts.join(table.select("club_id", "season_end_year", "tier", "position"), ["club_id", "season_end_year"])


def ranks(accounts: DataFrame, table: DataFrame, field: str) -> DataFrame:
    """Rank of a published figure within its season and tier, ties shared, with the number of published figures. No task holds a season."""
    p = placed(accounts, table).where(F.col("disclosure") == "full").select("club_id", "season_end_year", "tier", F.col(field).alias("value"))
    return shared_ranks(p, ["season_end_year", "tier"], "value")


def disclosure_counts(accounts: DataFrame, table: DataFrame) -> DataFrame:
    """Per season: clubs in the tiers, and how many disclosed or withheld their accounts."""
    j = table.where("tier <= 5").join(accounts.select("club_id", "season_end_year", "disclosure"), ["club_id", "season_end_year"], "left")
    return j.groupBy("season_end_year").agg(
        F.count("*").alias("in_season"), F.count(F.when(F.col("disclosure") == "full", 1)).alias("disclosed"), F.count(F.when(F.col("disclosure").isin(*[d for d in DISCLOSURES if d != "full"]), 1)).alias("withheld")
    )


def with_ratio(accounts: DataFrame) -> DataFrame:
    return accounts.withColumn("wage_ratio", wage_ratio(F.col("staff_costs"), F.col("turnover")))


def metric_points(accounts: DataFrame, table: DataFrame, field: str) -> DataFrame:
    """A published figure against the overall position of its season."""
    p = overall_positions(table).select("club_id", "season_end_year", "tier", "overall_position")
    a = with_ratio(accounts).where((F.col("disclosure") == "full") & F.col(field).isNotNull())
    return a.join(p, ["club_id", "season_end_year"]).select("club_id", "season_end_year", "tier", "overall_position", F.col(field).alias("value"))


def landing_season(points: DataFrame, table: DataFrame, newest: int = 6) -> DataFrame:
    """The newest of the last seasons that has a point."""
    last = table.select("season_end_year").distinct().orderBy(F.desc("season_end_year")).limit(newest)
    return points.join(F.broadcast(last), "season_end_year", "left_semi").agg(F.max("season_end_year").alias("season_end_year"))


def beaten_above(accounts: DataFrame, table: DataFrame) -> DataFrame:
    """For each club outside tier 1, the clubs of the tier above that spent less on staff.

    Counts of values are added up in ranges: no pairs are made, and no task holds a season.
    """
    p = placed(accounts, table).where("staff_costs is not null").select("club_id", "season_end_year", "tier", "staff_costs")
    above = p.select("season_end_year", (F.col("tier") + 1).alias("tier"), "staff_costs")
    return smaller_in(p.where("tier > 1"), above, ["season_end_year", "tier"], "staff_costs", "beaten").select("club_id", "season_end_year", "tier", "staff_costs", "beaten")


def y_axis(points: DataFrame, scale: str) -> DataFrame:
    """Bounds of the value axis: log (of positive values, in powers of ten), signed (with zero) or linear (not below zero)."""
    v = F.col("value").cast("double")
    v = F.when(v > 0, F.log10(v)) if scale == "log" else v
    b = points.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    if scale == "signed":
        lo, hi = F.least(lo, F.lit(0.0)), F.greatest(hi, F.lit(0.0))
    span = hi - lo
    pad = F.greatest(F.lit(0.05), span * 0.08) if scale == "log" else F.greatest(F.lit(1.0), span * 0.08) if scale == "signed" else F.greatest(F.lit(1.0), F.bround(span * 0.08, 0))
    return b.select((F.greatest(F.lit(0.0), lo - pad) if scale == "linear" else lo - pad).alias("lo"), (hi + pad).alias("hi"))


def breakdown(*parts: tuple[str, Column]) -> Column:
    """`matchday £2.1m · broadcast £5.0m`, of the parts that are known; null where none is."""
    known = F.array_compact(F.array(*(F.when(c.isNotNull(), F.concat(F.lit(f"{name} "), money(c))) for name, c in parts)))
    return F.when(F.size(known) > 0, F.array_join(known, " · "))


def account_notes(accounts: DataFrame) -> DataFrame:
    """Per account what has to be read with it: disclosure_note, period_note, flag_notes (the known flags in order of their keys)."""
    months = F.col("period_months")
    flags = F.array_sort(F.array_distinct(F.filter(json_strings(F.col("flags")), lambda f: f.isin(*FLAG_LABELS))))
    full = F.col("disclosure") == "full"
    return accounts.withColumns({
        "disclosure_note": labelled(F.col("disclosure"), {k: v for k, v in DISCLOSURES.items() if v}),
        "period_note": F.when(full & months.isNotNull() & ~months.isin(0, 12), F.concat(months.cast("string"), F.lit("-month period"))),
        "flag_notes": F.transform(flags, lambda f: labelled(f, FLAG_LABELS)),
    })


def rank_titles(ranked: DataFrame, noun: str) -> DataFrame:
    """ranked: club_id, season_end_year, rank, published, division_name. Adds short (`2nd of 20`) and title, as pages show ranks."""
    place = F.when(F.col("rank") == 1, "Highest").otherwise(F.concat(ordinal(F.col("rank")), F.lit(" highest")))
    title = F.concat(place, F.lit(f" {noun} of the "), F.col("published").cast("string"), F.lit(" clubs with published figures in "), F.col("division_name"), F.lit(", "), season_label(F.col("season_end_year")))
    return ranked.withColumns({"short": F.concat(ordinal(F.col("rank")), F.lit(" of "), F.col("published").cast("string")), "title": title})
