from pyspark.sql import functions as F

from touchline.operators import standings as S
from touchline.plans import rules as RU

MATCH = "season_end_year int, tier int, home_id string, away_id string, fthg int, ftag int, ftr string"
TABLE = "club_id string, season_end_year int, tier int, position int, status string"


def matches(spark, rows):
    return spark.createDataFrame([(2024, 1, *r) for r in rows], MATCH)


def by_club(df):
    return {r.club_id: r for r in df.collect()}


def test_three_matches(spark):
    t = by_club(S.standings(matches(spark, [("A", "B", 2, 0, "H"), ("B", "C", 1, 0, "H"), ("A", "C", 1, 1, "D")])))
    assert (t["A"].points, t["A"].position) == (4, 1) and t["B"].points == 3 and t["C"].points == 1


def test_goal_difference_breaks_ties(spark):
    t = by_club(S.standings(matches(spark, [("A", "C", 3, 0, "H"), ("B", "C", 1, 0, "H")])))
    assert t["A"].position == 1


def test_result_counts_not_goals(spark):
    t = by_club(S.standings(matches(spark, [("A", "B", 2, 1, "H"), ("B", "A", 2, 2, "D"), ("A", "B", None, None, "A"), ("A", "B", 9, 0, "x")])))
    a = t["A"]
    assert (a.won, a.drawn, a.lost, a.gf, a.ga, a.played) == (1, 1, 1, 4, 3, 3)


def test_tables_balance(spark):
    rows = [(h, a, (i * 7 + j) % 4, (i + j * 3) % 3) for i, h in enumerate("ABCDE") for j, a in enumerate("ABCDE") if h != a]
    t = S.standings(matches(spark, [(*r, "H" if r[2] > r[3] else "A" if r[2] < r[3] else "D") for r in rows])).agg(F.sum("won") - F.sum("lost"), F.sum("gd"), F.sum("gf") - F.sum("ga"), F.max("position")).first()
    assert tuple(t) == (0, 0, 0, 5)


def positions(spark, tier, season, n):
    df = spark.createDataFrame([(f"c{p}", season, tier, p, None) for p in range(1, n + 1)], TABLE).drop("status")
    return {r.position: r.status for r in S.assign_status(df, RU.rules(spark)).collect()}


def test_rules_by_era(spark):
    pl = positions(spark, 1, 1995, 22)
    assert pl[1] == "Champions" and pl[18] == "Stayed" and pl[19] == pl[22] == "Relegated"
    assert positions(spark, 1, 2024, 20)[17] == "Stayed" and positions(spark, 1, 2024, 20)[18] == "Relegated"
    two = positions(spark, 2, 1995, 24)
    assert two[2] == two[5] == "Play-off Promoted" and two[6] == "Stayed"
    assert positions(spark, 3, 2020, 23)[21] == "Relegated" and positions(spark, 3, 2020, 23)[20] == "Stayed"
    assert positions(spark, 5, 2021, 23)[23] == "Stayed"
    assert positions(spark, 5, 2000, 22)[22] == "Stayed"  # no rule


def test_in_progress(spark):
    df = spark.createDataFrame([("a", 2024, 1, 1, None)], TABLE).drop("status")
    assert S.assign_status(df, RU.rules(spark), F.lit(False)).first().status == "In progress"


def test_reconcile(spark):
    rows = [
        ("a", 2025, 5, 8, "Stayed"), ("a", 2026, 4, 3, "Stayed"),
        ("b", 2025, 3, 3, "Promoted"), ("b", 2026, 3, 4, "Stayed"),
        ("c", 2025, 2, 1, "Champions"), ("c", 2026, 2, 5, "Stayed"),
        ("d", 2025, 2, 22, "Relegated"), ("d", 2026, 2, 9, "Stayed"),
        ("e", 2025, 2, 9, "Stayed"), ("e", 2026, 3, 9, "In progress"),
        ("f", 2023, 2, 9, "Stayed"), ("f", 2025, 3, 9, "Stayed"),
    ]
    got = {(r.club_id, r.season_end_year): r.status for r in S.reconcile(spark.createDataFrame(rows, TABLE)).collect()}
    assert got["a", 2025] == "Promoted" and got["b", 2025] == "Stayed" and got["c", 2025] == "Champions"
    assert got["d", 2025] == "Stayed" and got["e", 2025] == "Stayed" and got["f", 2023] == "Stayed"


def test_known_winner_alone_stays_promoted(spark):
    rows = [(c, 2099, 3, p, "Play-off Promoted") for p, c in enumerate("wxyz", 3)] + [("q", 2098, 3, 4, "Play-off Promoted")]
    winners = spark.createDataFrame([(3, 2099, "x"), (3, 2098, "none")], "tier int, season_end_year int, club_id string")
    got = {r.club_id: r.status for r in S.known_winners(spark.createDataFrame(rows, TABLE), winners).collect()}
    assert got == {"w": "Stayed", "x": "Play-off Promoted", "y": "Stayed", "z": "Stayed", "q": "Play-off Promoted"}


def test_deductions_are_idempotent(spark):
    t = S.standings(matches(spark, [("A", "B", 2, 0, "H"), ("B", "C", 1, 0, "H"), ("A", "C", 1, 1, "D")]))
    d = spark.createDataFrame([("A", 2024, 2, 1), ("A", 2024, 1, 1), ("B", 2024, 50, 0)], "club_id string, season_end_year int, points int, applied int")
    once = S.apply_deductions(t, d)
    twice = S.apply_deductions(once, d)
    view = lambda df: {r.club_id: (r.points, r.position, r.points_deducted) for r in df.collect()}
    assert view(once) == view(twice) == {"A": (1, 2, 3), "B": (3, 1, 0), "C": (1, 3, 0)}


def test_completeness_and_note(spark):
    m = matches(spark, [("A", "B", 1, 0, "H")])
    c = S.coverage_note(S.completeness(S.standings(m), m)).first()
    assert c.data_complete == 0 and c.note == "1 of 2 matches"
    both = matches(spark, [("A", "B", 1, 0, "H"), ("B", "A", 1, 0, "H")])
    assert S.completeness(S.standings(both), both).first().data_complete == 1
    assert S.completeness(S.standings(m), m.where("false")).first().data_complete is None


def test_division_names(spark):
    s = spark.createDataFrame([(2003, 2), (2004, 2), (2005, 5), (2016, 5), (2000, 9)], "season_end_year int, tier int")
    got = {(r.season_end_year, r.tier): r.division_name for r in S.with_division_name(s, RU.divisions(spark)).collect()}
    assert got == {(2003, 2): "First Division", (2004, 2): "Championship", (2005, 5): "Tier 5", (2016, 5): "National League", (2000, 9): "Tier 9"}


def test_plausible(spark):
    s = spark.createDataFrame([(2000, 1, 20), (2000, 1, 21), (2000, 9, 99)], "season_end_year int, tier int, n_clubs int")
    assert sorted(r.n_clubs for r in S.plausible(s, RU.rules(spark)).collect()) == [20, 99]
