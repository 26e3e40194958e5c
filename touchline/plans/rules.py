"""Fixed values of the league model, and small tables made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Promotion and relegation by (tier, first season, last season): clubs, automatic
# promotion, play-off promotion, play-off relegation, automatic relegation, each a range of positions.
RULES = [
    (1, 1994, 1994, 22, None, None, None, (20, 22)),
    (1, 1995, 1995, 22, None, None, None, (19, 22)),
    (1, 1996, 2099, 20, None, None, None, (18, 20)),
    (2, 1994, 1994, 24, (2, 2), (3, 6), None, (22, 24)),
    (2, 1995, 1995, 24, None, (2, 5), None, (21, 24)),
    (2, 1996, 2099, 24, (2, 2), (3, 6), None, (22, 24)),
    (3, 1994, 1994, 24, (2, 2), (3, 6), None, (21, 24)),
    (3, 1995, 1995, 24, None, (2, 5), None, (20, 24)),
    (3, 1996, 2099, 24, (2, 2), (3, 6), None, (21, 24)),
    (3, 2020, 2020, 23, (2, 2), (3, 6), None, (21, 23)),
    (4, 1994, 1994, 22, (2, 3), (4, 7), None, None),
    (4, 1995, 1995, 22, (2, 2), (3, 6), None, None),
    (4, 1996, 1996, 24, (2, 3), (4, 7), None, None),
    (4, 1997, 2002, 24, (2, 3), (4, 7), None, (24, 24)),
    (4, 2003, 2099, 24, (2, 3), (4, 7), None, (23, 24)),
    (4, 2020, 2020, 24, (2, 3), (4, 7), None, (24, 24)),
    (5, 2006, 2006, 22, None, (2, 5), None, (20, 22)),
    (5, 2007, 2017, 24, None, (2, 5), None, (21, 24)),
    (5, 2018, 2099, 24, None, (2, 7), None, (21, 24)),
    (5, 2020, 2020, 24, None, (2, 7), None, (22, 24)),
    (5, 2021, 2021, 23, None, (2, 7), None, None),
    (5, 2022, 2022, 23, None, (2, 7), None, (21, 23)),
]
# Names of divisions by tier, from a season up to, but not including, another.
DIVISIONS = [
    (1, 1994, 9999, "Premier League"),
    (2, 1994, 2004, "First Division"),
    (2, 2004, 9999, "Championship"),
    (3, 1994, 2004, "Second Division"),
    (3, 2004, 9999, "League One"),
    (4, 1994, 2004, "Third Division"),
    (4, 2004, 9999, "League Two"),
    (5, 2006, 2016, "Conference Premier"),
    (5, 2016, 9999, "National League"),
]
# Division codes of the results files, play-off winners, season overrides of names.
CODES = {"E0": 1, "E1": 2, "E2": 3, "E3": 4, "EC": 5}
PLAYOFF_WINNERS = [(2, 2026, "hull-city-fc"), (3, 2026, "bolton-wanderers-fc"), (4, 2026, "notts-county-fc"), (5, 2026, "rochdale-fc")]
SEASON_OVERRIDES = [("wimbledon", 2004, "mk-dons-fc"), ("wimbledon", 2005, "mk-dons-fc")]
# Tiers by name, and what stands for seasons outside them.
TIER_NAMES = {1: "Premier League", 2: "Championship", 3: "League One", 4: "League Two", 5: "National League"}
OUTSIDE, OUTSIDE_NAME, OUTSIDE_VAGUE = 6, "non-league", "outside the recorded divisions"
# Statuses, how they are shown (slug, direction, label), and what counts as a move.
STATUS_SHOWN = {
    "Champions": ("champions", "up", "Champions"),
    "Promoted": ("promoted", "up", "Promoted"),
    "Play-off Promoted": ("play-off-promoted", "up", "Play-offs ↑"),
    "Stayed": ("stayed", "", ""),
    "Play-off Relegated": ("play-off-relegated", "down", "Play-offs ↓"),
    "Relegated": ("relegated", "down", "Relegated"),
    "In progress": ("in-progress", "", ""),
}
PROMOTED, RELEGATED, IN_PROGRESS = ("Champions", "Promoted", "Play-off Promoted"), ("Relegated", "Play-off Relegated"), "In progress"
# Fixture weights by tier, metrics of the scatter pages (source, field, axis, format, benchmark).
TIER_WEIGHT = {1: 5, 2: 4, 3: 3, 4: 2, 5: 2}
METRICS = [
    ("capacity", "Stadium capacity", "facts", "capacity", "linear", "count", None),
    ("revenue", "Revenue", "finances", "turnover", "log", "money", None),
    ("wages", "Wage bill", "finances", "staff_costs", "log", "money", None),
    ("wage-ratio", "Wages ÷ revenue", "finances", "wage_ratio", "linear", "percent", 70.0),
    ("profit", "Profit / loss", "finances", "profit_before_tax", "signed", "money", None),
    ("net-debt", "Net debt", "finances", "net_debt", "signed", "money", None),
]
# Sections of a story with forgiving spellings, and themes.
SECTIONS = ("origins", "trajectory", "ownership & finance", "infrastructure & environment")
SECTION_ALIASES = {
    "origin": "origins",
    "ownership and finance": "ownership & finance",
    "ownership": "ownership & finance",
    "finance": "ownership & finance",
    "infrastructure and environment": "infrastructure & environment",
    "infrastructure": "infrastructure & environment",
}
THEMES = ("phoenix", "fan-owned", "administration", "points-deductions", "exiled", "ground-grading")

# Disclosure of accounts with the note that stands for missing figures, and the other enums of accounts.
DISCLOSURES = {
    "full": None,
    "small_company": "Filed under the small-company regime — no profit and loss account disclosed.",
    "not_filed": "Accounts overdue and not filed.",
    "dissolved": "Entity dissolved.",
}
STAFF_COSTS_DEFINITIONS, CONSOLIDATION_LEVELS = ("excl_amortisation", "incl_amortisation"), ("club", "group")
# Flags of accounts and how pages explain them.
FLAG_LABELS = {
    "non_12_month_period": "One period isn't 12 months long, so it isn't like-for-like with the others.",
    "figure_disputed": "Outlets reported materially different values for at least one figure.",
    "profit_label_uncertain": "Sources didn't agree whether a profit figure is before or after tax.",
    "staff_costs_basis_uncertain": "A wage figure is reported without confirming whether it includes amortisation of transfer fees.",
    "staff_costs_disputed_omitted": "A wage bill is left blank because sources couldn't be reconciled.",
    "profit_figure_omitted": "A profit figure is left blank because sources disagreed on which measure applies.",
    "profit_includes_one_off_related_party_gain": "A result is flattered by a one-off sale within the owner's group.",
    "profit_includes_one_off_exceptional_gain": "A result is flattered by a one-off item outside normal trading.",
    "loss_includes_one_off_exceptional_charge": "A result is worsened by a one-off item outside normal trading.",
    "turnover_may_include_transfer_fees": "A turnover figure may include transfer income rather than trading revenue alone.",
    "disclosed_via_statement_not_filed_accounts": "Figures come from the club's own statement; the filing itself omitted the profit and loss account.",
}
# Labels of the facts panel.
OWNERSHIP_LABELS = {
    "fan_trust": "Fan / supporters' trust",
    "family": "Family / local dynasty",
    "benefactor": "Benefactor-funded",
    "consortium": "Consortium",
    "foreign_investment": "Foreign investment",
    "multi_club": "Multi-club group",
    "celebrity_media": "Celebrity / media ownership",
    "plc": "Public limited company",
}
STADIUM_OWNERSHIP_LABELS = {"club": "Owned by the club", "council": "Council-owned", "third_party": "Owned by a third party", "disputed": "Ownership disputed"}
ORIGIN_LABELS = {
    "works": "Works team",
    "church": "Church team",
    "pub": "Pub team",
    "school": "School / old boys",
    "youth": "Youth / street team",
    "civic": "Civic founding",
    "phoenix": "Phoenix club",
    "other": "Other",
}
# Patterns of movement by page, and the groups of their outcomes in order (outcome, heading, note).
PATTERN_LABELS = {
    "relegation_back_to_back": "Back-to-back",
    "relegation_three_plus": "Three in a row",
    "relegation_held": "Held, then down again",
    "relegation_sandwich": "Straight back down",
    "promotion_back_to_back": "Back-to-back",
    "promotion_three_plus": "Three in a row",
    "promotion_paused": "Paused, then up again",
}
FALL_GROUPS = [
    ("recovered", "All the way back", "Back at the division they fell from, or higher."),
    ("climbing", "Still climbing", "Above the level they fell to, but not yet back where they started."),
    ("stuck", "Still down there", "Still at the division the fall took them to."),
    ("worse", "Fell further", "Lower now than the division the fall itself took them to."),
    ("outside", "Out of the pyramid", "No longer in Tiers 1-5 at all."),
    ("unfolding", "Still unfolding", "The fall only just finished — the season that would show a recovery has not been played yet."),
]
RISE_GROUPS = [
    ("held", "Held the new level", "Still at the division the climb took them to, or higher."),
    ("slipped", "Slipped one division", "One division below the level they reached."),
    ("fell_back", "Fell back further", "More than one division below the level they reached."),
    ("outside", "Out of the pyramid", "No longer in Tiers 1-5 at all."),
    ("unfolding", "Still unfolding", "The climb only just finished — the season at the new level has not been played yet."),
]
# Clubs that previews favour, besides those of the environment.
FOLLOWED_CLUBS: tuple[str, ...] = ()
# Events of the timeline (year, title, text).
TIMELINE = [
    (1995, "The Premier League shrinks", "Four clubs relegated in 1994/95 as the top flight cuts from 22 to 20; the Third Division expands to 24 to rebalance the pyramid."),
    (1996, "Stevenage denied, Torquay reprieved", "Conference champions Stevenage Borough are refused promotion on ground grading, so nobody goes down from the Football League."),
    (2002, "Two-up two-down with the Conference", "From 2002/03 two clubs are exchanged between the Football League and the Conference each season — and the Conference gains play-offs."),
    (2003, "Wimbledon leave SW19", "Wimbledon FC relocate 60 miles to Milton Keynes mid-crisis; within a year they are rebranded MK Dons. Fan-founded AFC Wimbledon start seven tiers down and climb back."),
    (2010, "Chester City expelled mid-season", "Chester City are wound up in March 2010 and their Conference record is expunged, leaving the division a club short."),
    (2011, "Rushden & Diamonds fold", "Expelled from the Conference and liquidated within weeks."),
    (2019, "Bury expelled from the Football League", "The first Football League expulsion since 1992. League One plays the season with 23 clubs and only three go down."),
    (2020, "COVID stops the game", "Leagues One and Two and the National League end early on points-per-game; Macclesfield Town are relegated by points deduction, then wound up entirely months later."),
    (2021, "The season with no relegation", "With the leagues below voided, nobody is relegated from the 23-club National League."),
    (2022, "Wrexham go global", "Hollywood ownership turns a National League ever-present into the world's most-watched lower-league club — promotion follows in 2023."),
]


def rules(spark: SparkSession) -> DataFrame:
    """The rule table: fewer than 30 rows, so joins broadcast it."""
    pair = lambda r: r or (None, None)
    rows = [(t, a, z, n, *pair(up), *pair(po), *pair(pr), *pair(down)) for t, a, z, n, up, po, pr, down in RULES]
    return spark.createDataFrame(rows, "tier int, from_year int, to_year int, total_clubs int, up_lo int, up_hi int, playoff_lo int, playoff_hi int, po_down_lo int, po_down_hi int, down_lo int, down_hi int")


def divisions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DIVISIONS, "tier int, from_year int, until_year int, division_name string")


def metrics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(METRICS, "metric string, label string, source string, field string, scale string, format string, benchmark double")


def timeline(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TIMELINE, "year int, title string, text string")


def movement_groups(spark: SparkSession) -> DataFrame:
    """page, place, outcome, heading, note of the groups of the pages on falls and climbs: eleven rows."""
    pages = (("the-drop", FALL_GROUPS), ("the-rise", RISE_GROUPS))
    return spark.createDataFrame([(page, i, *g) for page, groups in pages for i, g in enumerate(groups)], "page string, place int, outcome string, heading string, note string")
