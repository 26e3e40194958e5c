from touchline.operators.results import featured, fixture_window, head_to_head, storyline_score
from touchline.sources import files as SRC
from touchline.sources.sinks import payload, read_seasons, replace_seasons
from touchline.streaming.refresh import refresh_seasons


def test_ragged_matches(spark, tmp_path):
    (tmp_path / "9394_E0.csv").write_bytes("﻿Date,HomeTeam,AwayTeam,HG,AG,FTR\n14/08/93,A,B,2,0,H,extra,cells\n15/08/93,\"B, Town\",C,1,1,D\n16/08/93,C,A\n,,,,,\n14/08/93,A,B,2,0,H\n".encode())
    (tmp_path / "2627_E0.csv").write_text("Div,Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR\nEC,01/09/26,X,Y,1,0,H\n")
    (tmp_path / "2425_E1.csv").write_bytes("Div,HomeTeam,AwayTeam,FTHG,FTAG,FTR,Date\nE1,Caf\xe9,Z,1,0,H,01/09/24\n".encode("latin-1"))
    (tmp_path / "notes.csv").write_text("HomeTeam,AwayTeam\nA,B\n")
    (tmp_path / "9495_E0.csv").write_text("x")
    got = sorted((r.season_end_year, r.tier, r.home_name, r.away_name, r.fthg, str(r.match_date)) for r in SRC.read_matches(spark, str(tmp_path)).collect())
    assert got == [(1994, 1, "A", "B", 2, "1993-08-14"), (1994, 1, "B, Town", "C", 1, "1993-08-15"), (2025, 2, "Café", "Z", 1, "2024-09-01")]


def test_fixtures(spark, tmp_path):
    (tmp_path / "fixtures.csv").write_text("﻿Div,Date,HomeTeam,AwayTeam\nE0,15/08/2026,A,B\nE0,25/08/2026,C,D\nSP1,15/08/2026,E,F\nEC,12/08/2026,G,H\n")
    import datetime

    from pyspark.sql import functions as F

    f = fixture_window(SRC.read_fixtures(spark, str(tmp_path)), F.lit(datetime.date(2026, 8, 10)))
    assert [(r.tier, r.home_name) for r in f.orderBy("tier").collect()] == [(1, "A"), (5, "G")]


def test_clubs_and_names(spark, tmp_path):
    path = tmp_path / "clubs.csv"
    path.write_text('club_id,canonical_name,name_variants,lineage_parent_id,current_tier,color_primary,color_secondary,stadium_name,latitude,longitude\na-fc,Alpha,"[""Alpha"",""Alpha FC""]",,1,,,,51.5,\nb-fc,Wimbledon,"[""ALPHA f.c.""]",a-fc,x,,,,,-1\n')
    clubs = SRC.read_clubs(spark, str(path))
    assert [(r.club_id, r.current_tier, r.latitude) for r in clubs.orderBy("club_id").collect()] == [("a-fc", 1, 51.5), ("b-fc", None, None)]
    raw = spark.createDataFrame([("Wimbledon", 2003, 2), ("Wimbledon", 2004, 2), ("alpha fc", 2003, 1), ("Nobody", 2003, 1)], "name string, season_end_year int, tier int")
    special = spark.createDataFrame([("wimbledon", 2004, "mk-dons-fc")], "name_key string, season_end_year int, club_id string")
    done = SRC.resolve(raw, SRC.name_table(clubs), special, "name", "club_id")
    assert {(r.name, r.season_end_year): r.club_id for r in done.collect()} == {("Wimbledon", 2003): "b-fc", ("Wimbledon", 2004): "mk-dons-fc", ("alpha fc", 2003): "a-fc", ("Nobody", 2003): None}
    assert SRC.unresolved(done).first().places == "2003/E0"
    assert [r.club_id for r in SRC.stale_keys(clubs, clubs.where("club_id = 'a-fc'"), ["club_id"]).collect()] == ["b-fc"]


def test_stories(spark, tmp_path):
    (tmp_path / "a-fc.md").write_text("---\nfounded: 1900\n---\nIntro.\n\n## Origin\n\nBorn.\n\n## Ownership and Finance\nRich.\n\n## Odd one\nKept.\n\n## Trajectory\n\n")
    (tmp_path / "b-fc.md").write_text("Only prose.")
    got = {r.club_id: r for r in SRC.read_stories(spark, str(tmp_path)).collect()}
    assert got["a-fc"].front_matter == "founded: 1900" and got["a-fc"].sections == {"origins": "Born.", "ownership & finance": "Rich."}
    assert got["a-fc"].extra == "Intro.\n\n## Odd one\n\nKept."
    assert got["b-fc"].sections == {} and got["b-fc"].extra == "Only prose."


def test_replaced_seasons(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda rows: spark.createDataFrame(rows, "season_end_year int, tier int, club_id string")
    replace_seasons(frame([(2023, 1, "a"), (2024, 1, "a")]), path)
    for _ in range(2):
        replace_seasons(frame([(2024, 1, "b"), (2024, 1, "c")]), path)
    assert sorted((r.season_end_year, r.club_id) for r in read_seasons(spark, path).collect()) == [(2023, "a"), (2024, "b"), (2024, "c")]
    assert payload(frame([(2024, 1, "x")])).first().payload == '{"season_end_year":2024,"tier":1,"club_id":"x"}'


def test_stream_refreshes_seasons(spark, tmp_path):
    schema = "season_end_year int, tier int, home_id string, away_id string, fthg int, ftag int, ftr string"
    arriving, matches, tables = (str(tmp_path / x) for x in ("in", "matches", "tables"))
    for home, away in (("a", "b"), ("b", "a")):
        spark.createDataFrame([(2024, 1, home, away, 1, 0, "H")], schema).write.mode("append").parquet(arriving)
        refresh_seasons(spark, arriving, matches, tables, str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted((r.club_id, r.points, r.played) for r in spark.read.parquet(tables).collect()) == [("a", 3, 2), ("b", 3, 2)]


def test_head_to_head_and_score(spark):
    m = spark.createDataFrame([("g", "s", "H"), ("s", "g", "D")], "home_id string, away_id string, ftr string")
    r = head_to_head(m).first()
    assert (r.total, r.wins_a, r.wins_b, r.draws) == (2, 1, 0, 1)
    ctx = spark.createDataFrame([("g", 0.5, -2, "yo-yo", 1, "Relegated", 2), ("s", 0.0, None, "insufficient", 1, None, 3)], "club_id string, yo_yo_score double, level_gap int, kind string, highest_tier int, last_status string, last_position int")
    f = spark.createDataFrame([(1, 3, "g", "s"), (2, 1, "x", "y")], "seq int, tier int, home_id string, away_id string")
    got = {r.seq: r for r in featured(storyline_score(f, ctx), n=1).collect()}
    # 3 for the tier; 0.5 + 4 + 1 + 1 + 1 for one club; 4 for a fallen giant; 3 + 3 for the pair
    assert got[1].score == 20.5 and got[1].featured == 1 and got[2].score == 5.0 and got[2].featured is None
