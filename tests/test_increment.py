"""Careers refreshed after random changes equal careers computed from all seasons."""

import random

from pyspark.sql import functions as F
from touchline.operators import increment as IN
from touchline.operators.career import trajectory
from touchline.operators.standings import reconcile
from touchline.sources.store import Store

SCHEMA = "club_id string, season_end_year int, tier int, position int, n_clubs int, status string"
STATUSES = ["Champions", "Promoted", "Play-off Promoted", "Stayed", "Relegated", "In progress"]


def league(rng, clubs=30, seasons=range(2000, 2012)):
    rows = []
    for year in seasons:
        out = [c for c in range(clubs) if rng.random() < 0.85]
        rng.shuffle(out)
        for i, c in enumerate(out):
            rows.append((f"c{c}" if rng.random() < 0.97 else None, year, i % 3 + 1, i // 3 + 1, 10, rng.choice(STATUSES)))
    return rows


def same(a, b):
    view = lambda df: sorted(str(sorted(r.asDict().items(), key=str)) for r in df.collect())
    assert view(a) == view(b)


def test_refresh_equals_all_anew(spark, tmp_path):
    rng = random.Random(11)
    rows = league(rng)
    store = Store(spark, str(tmp_path / "s"))
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    IN.publish_careers(store, frame(rows))
    for step in range(3):
        year, tier = rng.choice(range(2000, 2012)), rng.choice((1, 2, 3))
        division = [r for r in rows if (r[1], r[2]) == (year, tier)]
        if step == 0:
            new = [(f"new{i}" if i == 0 else r[0], *r[1:5], rng.choice(STATUSES)) for i, r in enumerate(division)]
        elif step == 1:
            new = division[:-3]
        else:
            new = division + [("c1", year, tier, 99, 10, "Stayed")]
        untouched = [r for r in rows if r[1] == 2005 and r[2] != tier]
        rows = [r for r in rows if (r[1], r[2]) != (year, tier)] + new
        counts = {r.what: r.n for r in IN.refresh_careers(store, frame(new + [r for r in untouched if (r[1], r[2]) != (year, tier)])).collect()}
        assert counts["divisions"] == 1 and counts["clubs"] <= 15 and counts["seasons of clubs"] < len(rows)
        settled = reconcile(frame(rows))
        columns = store.read("settled").columns
        same(store.read("judged").select(SCHEMA.replace(" string", "").replace(" int", "").split(", ")), frame(rows))
        same(store.read("settled").where("club_id is not null").select(columns), settled.where("club_id is not null").select(columns))
        same(store.read("careers").drop("part"), trajectory(settled.where("club_id is not null")))
    before = store.versions()
    assert {r.n for r in IN.refresh_careers(store, frame([r for r in rows if r[1] == 2003])).where("what = 'divisions'").collect()} == {0} and store.versions() == before


def test_a_club_that_goes_loses_its_career(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    IN.publish_careers(store, frame([("a", 2020, 1, 1, 2, "Champions"), ("b", 2020, 1, 2, 2, "Relegated"), ("a", 2021, 1, 1, 1, "Champions")]))
    IN.refresh_careers(store, frame([("a", 2020, 1, 1, 1, "Champions")]))
    assert [r.club_id for r in store.read("careers").collect()] == ["a"] and store.read("settled").where(F.col("club_id") == "b").isEmpty()
