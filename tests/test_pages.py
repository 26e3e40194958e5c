"""Names with marks, front matter, seeding, panels and previews on small rows."""

import pytest
from pyspark.sql import functions as F

from touchline.functions import text as T
from touchline.operators import insights as I
from touchline.operators import pages as PG
from touchline.operators import results as R
from touchline.operators import stories as ST
from touchline.sources import files as SRC
from touchline.sources import seeds as SD


def test_name_keys_are_decomposed(spark):
    names = {"Bodø": "bod", "Łódź": "odz", "Plzeň": "plzen", "Beşiktaş": "besiktas", "ＡＦＣ": "afc", "King’s Lynn": "kingslynn", "Ångström FC": "angstromfc", "ﬁne": "fine", "": "", "Ⅷ": "viii"}
    df = spark.createDataFrame([(n,) for n in [*names, None]], "n string")
    got = {r.n: r.k for r in df.select("n", T.name_key(F.col("n")).alias("k")).collect()}
    assert got == names | {None: None}


def story(spark, folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")


def test_stories_give_facts(spark, tmp_path):
    story(spark, tmp_path, "a-fc.md", "---\nfounded: 1899\nthemes: exiled\nadministration:\n  - year: 2010\n    points_deducted: 9\nexile:\n  - venue: Elsewhere\n    seasons: 2013\n---\nIntro.\n\n## Origins\n\nBegan.\n")
    story(spark, tmp_path, "b-fc.md", "---\nfounded: [oops\n---\n")
    story(spark, tmp_path, "c-fc.md", "---\n- a list\n---\nProse.\n")
    rows = {r.club_id: r for r in ST.with_facts(SRC.read_stories(spark, str(tmp_path))).collect()}
    a = rows["a-fc"]
    assert a.facts.founded == 1899 and a.facts.administration[0].points_deducted == 9 and a.facts.exile[0].seasons == "2013"
    assert a.themes == ["administration", "exiled"] and a.has_prose and a.sections == {"origins": "Began."}
    assert rows["b-fc"].facts.founded is None and not rows["b-fc"].has_prose and rows["b-fc"].themes == []
    assert rows["c-fc"].facts.founded is None and rows["c-fc"].has_prose
    assert {r.theme: r.prose for r in SRC.read_theme(spark, str(tmp_path)).collect()}["c-fc"] == "Prose."


def test_panel_of_story(spark):
    facts = spark.sql("""select 'a' as club_id, named_struct('nickname', 'Reds', 'founded', 1899, 'origin_type', 'church') as f""")
    full = facts.select("club_id", F.from_json(F.to_json("f"), ST.FACTS).alias("facts"))
    rivals = spark.sql("""select 'b' as club_id, '{"rivalries":[{"opponent":"a","name":"Derby","note":"Old"},{"opponent":"zz"}],"capacity":12345,"drops":[{"season":2010,"note":"Fell"},{"season":2011}]}' as t""").select("club_id", F.from_json("t", ST.FACTS).alias("facts"))
    names = spark.createDataFrame([("a", "Alpha")], "club_id string, name string")
    got = {(r.club_id, r.n): (r.label, r.value) for r in ST.facts_panel(full.unionByName(rivals), names).collect()}
    assert got == {("a", 0): ("Nickname", "Reds"), ("a", 1): ("Founded", "1899 · Church team"), ("b", 0): ("Capacity", "12,345"), ("b", 1): ("Featured on The drop", "2009/10 · Fell"), ("b", 2): ("Rivalry", "vs Alpha (Derby) · Old"), ("b", 3): ("Rivalry", "vs zz")}


def test_seeding(spark):
    rows = spark.createDataFrame([("a", "A", 1), ("b", "B", 2), ("a", "A2", 3), (None, "x", 4)], "club_id string, canonical_name string, seq int").withColumns({c: F.lit(None).cast("string") for c in ("name_variants", "lineage_parent_id", "current_tier")})
    clubs, stale = SD.seed_clubs(rows, spark.createDataFrame([("a",), ("old",)], "club_id string"), "seq")
    assert {r.club_id: r.canonical_name for r in clubs.collect()} == {"a": "A2", "b": "B"} and [r.club_id for r in stale.collect()] == ["old"]
    table = spark.createDataFrame([("a", 1), ("old", 2), (None, 3)], "club_id string, n int")
    assert sorted(((r.club_id or ""), r.n) for r in SD.detach(table, stale).collect()) == [("", 2), ("", 3), ("a", 1)]
    with pytest.raises(ValueError, match="clubs: missing columns current_tier"):
        SD.seed_clubs(rows.drop("current_tier"))
    accounts = spark.createDataFrame([("a", 2020, "full", 1), ("a", 2020, "full", 2), ("q", 2020, "full", 3), ("a", None, "full", 4)], "club_id string, season_end_year int, disclosure string, turnover long")
    kept, skipped = SD.seed_finances(accounts.withColumn("seq", F.col("turnover")), clubs, "seq")
    assert [(r.club_id, r.turnover) for r in kept.collect()] == [("a", 2)] and skipped.count() == 2


def test_form_of_clubs_with_many_matches(spark):
    rows = [(2000 + (d > 3), f"2001-01-{1 + d % 28:02d}", 1, 2, "HDA"[d % 3], d) for d in range(70)]
    m = spark.createDataFrame(rows, "season_end_year int, day string, home_id long, away_id long, ftr string, seq int").selectExpr("season_end_year", "1 as tier", "to_date(day) as match_date", "home_id", "away_id", "0 as fthg", "0 as ftag", "ftr", "seq")
    newest = sorted((r for r in rows if r[0] == 2001), key=lambda r: (r[1], r[5]), reverse=True)[:5]
    want = "".join({"H": "W", "D": "D", "A": "L"}[r[4]] for r in newest)
    assert {r.club_id: r.form for r in R.recent_form(m, ["seq"]).collect()}[1] == want


def test_orders_and_names(spark):
    c = spark.createDataFrame([(1, 1, 3, 2000), (2, 1, 4, 2005), (3, 1, 4, 2001), (4, 2, 4, None)], "club_id long, highest_tier int, current_tier int, last_tier1_season int")
    assert [r.club_id for r in I.fallen_giants(c).collect()] == [3, 2, 1]
    assert R.followed(" b ,a,, b") == ["a", "b"]
    clubs = spark.createDataFrame([(1, "One")], "club_id long, canonical_name string")
    got = {r.club_id: (r.name, r.linked) for r in PG.display_names(c.select("club_id"), clubs, c.where("club_id < 3")).collect()}
    assert got == {1: ("One", True), 2: ("2", True), 3: ("3", False), 4: ("4", False)}
