import datetime

from pyspark.sql import functions as F

from touchline.functions import text as T
from touchline.operators import stories as ST
from touchline.operators.finance import deduction_errors, finance_errors


def values(spark, rows, f, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_seasons(spark):
    years = list(range(1994, 2040))
    codes = values(spark, years, T.season_code, "int")
    assert codes[:7] == ["9394", "9495", "9596", "9697", "9798", "9899", "9900"]
    assert values(spark, codes, T.season_of_code) == years
    assert values(spark, [2024, 2000], T.season_label, "int") == ["2023/24", "1999/00"]


def test_dates(spark):
    d = datetime.date
    assert values(spark, ["14/08/93", "14/08/1993", "01/02/24", "nonsense", None, "31/02/2020"], T.match_date) == [d(1993, 8, 14), d(1993, 8, 14), d(2024, 2, 1), None, None, None]


def test_names_resolve(spark):
    names = ["King's Lynn", "King’s Lynn", "﻿Kings  Lynn", "K​ings Lynn", "KÍNGS-LYNN"]
    assert set(values(spark, names, T.name_key)) == {"kingslynn"}
    assert values(spark, ["Brighton & Hove"], T.search_key) == ["brighton   hove"]


def test_money_and_ordinals(spark):
    assert values(spark, [661_000_000, 8_850_000, 450_000, 7, -2_500_000], T.money, "long") == ["£661.0m", "£8.8m", "£450k", "£7", "−£2.5m"]
    assert values(spark, [1, 2, 3, 4, 11, 12, 13, 21, 111, 112], T.ordinal, "int") == ["1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st", "111th", "112th"]


def test_years(spark):
    assert values(spark, ["1997–1999", "from 1985", "none", None, "42"], T.first_year) == [1997, 1985, None, None, None]


def test_tolerant_ints(spark):
    assert values(spark, [" 1,234 ", "5.9", "", "x", None], T.tolerant_int) == [1234, 5, None, None, None]


def test_json(spark):
    assert values(spark, ['["a","b"]', "[", None, "x"], T.json_strings) == [["a", "b"], [], [], []]


def test_haversine(spark):
    df = spark.sql("select 51.5074D a, -0.1278D b, 53.4808D c, -2.2426D d")
    assert abs(df.select(T.haversine_miles(*(F.col(c) for c in "abcd")).alias("m")).first().m - 162.9) < 0.5


def facts(spark, **own):
    rows = [("a", own)]
    return spark.createDataFrame(rows, f"club_id string, facts {ST.FACTS}")


def test_themes_and_events(spark):
    f = facts(spark, phoenix_of="Old", founded=2005, predecessor_folded=2004, administration=[{"year": 2013, "points_deducted": 10, "note": None}], exile=[{"venue": "Sixfields", "seasons": "2013–2014", "distance_miles": 34}], themes=[" extra ", ""])
    assert ST.themes(f).first().themes == ["administration", "exiled", "extra", "phoenix"]
    got = sorted((r.season_end_year, r.text) for r in ST.theme_events(f).collect())
    assert got == [
        (2005, "Old ceased to exist in 2004."),
        (2006, "Founded in 2005, succeeding Old."),
        (2014, "Entered administration in 2013, and was docked 10 points."),
        (2014, "Played home games at Sixfields, 2013–2014 — about 34 miles from home."),
    ]
    told = {r.theme: r.narrative for r in ST.theme_narratives(f).collect()}
    assert told["phoenix"] == "Old ceased to exist in 2004. Founded in 2005, succeeding Old." and told["extra"] == ""


def test_narrative_override(spark):
    f = facts(spark, phoenix_of="Old", theme_notes={"phoenix": " Own words. "})
    assert ST.theme_narratives(f).first().narrative == "Own words."


def test_rivalries(spark):
    e = spark.createDataFrame([(1, "a", "b", "x"), (2, "b", "a", "longer"), (3, "a", "b", "longer"), (4, "a", "zzz", "y")], "seq int, club_id string, opponent string, note string")
    got = ST.rivalries(e, spark.createDataFrame([("a",), ("b",)], "club_id string")).collect()
    assert [(r.club_a, r.club_b, r.seq) for r in got] == [("a", "b", 2)]


def test_finance_errors(spark):
    rows = [("a", 2024, "full", 5, 3, "excl_amortisation", "[]"), ("a", 2024, "small_company", 5, None, None, None), ("a", None, "full", None, None, None, None), ("a", 2024, "odd", None, None, None, "{}"), ("z", 2024, "full", 5, 3, "", "["), ("a", 2025, "dissolved", None, None, "wages", None)]
    df = spark.createDataFrame(rows, "club_id string, season_end_year int, disclosure string, turnover long, staff_costs long, staff_costs_definition string, flags string")
    got = finance_errors(df, spark.createDataFrame([("a",)], "club_id string")).collect()
    assert sorted(tuple(r.errors) for r in got) == [(), ("bad disclosure", "flags are no JSON array"), ("bad staff costs definition",), ("missing key",), ("money without full disclosure",), ("staff costs without definition", "flags are no JSON array", "unknown club")]


def test_deduction_errors(spark):
    rows = [("a", 2024, 10, 1, "u"), ("a", 2024, -5, 1, "u"), ("z", 2024, 1, 1, "u"), ("a", 2024, 1, 1, " "), ("a", None, 1, 2, "u")]
    df = spark.createDataFrame(rows, "club_id string, season_end_year int, points int, applied int, source_url string")
    got = deduction_errors(df, spark.createDataFrame([("a",)], "club_id string")).collect()
    assert sorted(tuple(r.errors) for r in got) == [(), ("missing season or points", "applied is no flag"), ("no source",), ("points not positive",), ("unknown club",)]
