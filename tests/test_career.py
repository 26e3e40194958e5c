from touchline.operators import career as C
from touchline.operators import movement as M
from touchline.operators import pyramid as P

TABLE = "club_id string, season_end_year int, tier int, position int, status string"


def history(spark, tiers, start=2000, status="Stayed"):
    """tiers: one tier a season, None for a gap."""
    return spark.createDataFrame([("a", start + i, t, 1, status) for i, t in enumerate(tiers) if t], TABLE)


def level(spark, tiers, start=2000):
    return C.natural_level(history(spark, tiers, start)).first()


def test_kinds(spark):
    assert level(spark, [1] * 20).kind == "ever-present"
    assert level(spark, [2] * 16 + [3] * 4).kind == "established"
    yo = level(spark, [1] * 12 + [2] * 11)
    assert (yo.kind, yo.natural_tier, yo.second_tier, yo.label) == ("yo-yo", 1, 2, "Premier League / Championship yo-yo club")
    assert level(spark, [3] * 8 + [2] * 6 + [4] * 6).kind in ("mixed", "yo-yo")
    assert level(spark, [1, 2, 2, 2, 2, 2, 2, 3, 3, 3, 3, 3, 3, 3, 4, 4, 4, 4, 4, 5, 5, 5, 5] + [1]).kind == "broad"
    assert level(spark, [1] * 5).label == "Insufficient record"


def test_no_tier_beside_the_outermost_counts(spark):
    """There is no tier above the first, nor one below outside: seasons outside are no neighbours of these."""
    n = level(spark, [1] * 5 + [None] * 4 + [5, 1])
    assert (n.natural_tier, n.n6, n.second_tier, n.kind, n.label) == (1, 4, None, "broad", "Premier League club (whole-pyramid range)")
    out = level(spark, [1] + [None] * 8 + [2, 3, 4, 4, 2])
    assert (out.natural_tier, out.n6, out.second_tier, out.kind) == (6, 8, None, "broad")


def test_gap_filled_window(spark):
    tiers = [5] * 6 + [None] * 3 + [5] * 2 + [None] * 4 + [5] * 6
    n = level(spark, tiers, 2006)
    assert (n.seasons, n.recorded, n.n6, n.coverage_note) == (21, 14, 7, None)
    assert level(spark, [4, None, None, 4, 4, 4, 4, 4, 4], 2000).coverage_note == "pre2006-gap"


def test_trend(spark):
    assert level(spark, [4] * 15 + [2] * 5).trend == "rising"
    assert level(spark, [2] * 15 + [4] * 5).trend == "falling"
    assert level(spark, [3] * 20).trend == "level"
    assert level(spark, [3] * 5).trend is None


def test_streak(spark):
    assert C.streak(history(spark, [2, 2, 2, 1, 2, 2])).first().current_tier_streak == 2
    assert C.streak(history(spark, [5, 5, None, 5, 5])).first().current_tier_streak == 2
    assert C.streak(history(spark, [1, 1, 1])).first().current_tier_streak == 3


def test_titles_are_no_promotions(spark):
    r = C.rollup(history(spark, [1, 1, 1], status="Champions")).first()
    assert (r.total_promotions, r.yo_yo_score, r.seasons_in_tier1) == (0, 0.0, 3)
    assert C.rollup(history(spark, [2] * 7 + [3], status="Stayed").union(history(spark, [2], 2010, "Promoted"))).first().yo_yo_score == 0.11


def test_half_to_even(spark):
    t = history(spark, [2] * 7).union(history(spark, [2], 2010, "Promoted"))
    assert C.rollup(t).first().yo_yo_score == 0.12  # 1/8


def moves(spark, kinds, start=2000):
    status = {"r": "Relegated", "p": "Promoted", "s": "Stayed"}
    return spark.createDataFrame([("a", start + i, 3, 1, status[k]) for i, k in enumerate(kinds) if k != "."], TABLE)


def found(df):
    return sorted((r.pattern, r.first, r.last) for r in df.collect())


def test_runs(spark):
    assert found(M.runs(moves(spark, "srrs"))) == [("relegation_back_to_back", 2001, 2002)]
    assert found(M.runs(moves(spark, "pppp"))) == [("promotion_three_plus", 2000, 2003)]
    assert found(M.runs(moves(spark, "r.r"))) == []


def test_triples(spark):
    assert found(M.triples(moves(spark, "rsr"))) == [("relegation_held", 2000, 2002)]
    assert found(M.triples(moves(spark, "rprpr"))) == [("relegation_sandwich", 2000, 2002), ("relegation_sandwich", 2002, 2004)]
    assert found(M.triples(moves(spark, "psp"))) == [("promotion_paused", 2000, 2002)]
    assert found(M.triples(moves(spark, "rs.r"))) == []


def test_outcomes(spark):
    rows = [("a", 2000, 1, "Relegated"), ("a", 2001, 2, "Relegated"), ("a", 2002, 3, "Stayed"), ("a", 2003, 2, "Stayed"), ("b", 2002, 4, "Promoted"), ("b", 2003, 3, "Promoted"), ("c", 2003, 1, "Stayed")]
    t = spark.createDataFrame([(c, y, t, 1, s) for c, y, t, s in rows], TABLE)
    got = {r.club_id: (r.pattern, r.start_tier, r.floor_tier, r.now_tier, r.outcome) for r in M.outcomes(t).collect()}
    assert got["a"] == ("relegation_back_to_back", None, 3, 2, "climbing")
    assert got["b"][4] == "unfolding"


def test_floors_and_positions(spark):
    rows = [(f"x{t}{i}", 2023, t, i) for t, n in ((1, 2), (2, 3)) for i in range(1, n + 1)] + [(f"x{t}{i}", 2024, t, i) for t, n in ((1, 2), (2, 3), (3, 2)) for i in range(1, n + 1)]
    t = spark.createDataFrame(rows, "club_id string, season_end_year int, tier int, position int")
    assert {r.season_end_year: (r.floors, r.max_position) for r in P.floor_lines(t).collect()} == {2023: ([2], 5), 2024: ([2, 5], 7)}
    assert P.overall_positions(t).where("club_id = 'x32' and season_end_year = 2024").first().overall_position == 7


def test_segments(spark):
    got = sorted((r.segment, r.tier, r.start, r.end, r.bridged_from) for r in P.segments(history(spark, [1, 1, 2, None, 2])).collect())
    assert got == [(1, 1, 2000, 2001, None), (2, 2, 2002, 2002, 2001), (3, 2, 2004, 2004, None)]
