"""Splittable files and their ledger, grids, ranges, grams and bins against plain versions."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F
from touchline.operators import grounds as G
from touchline.operators import intervals as IV
from touchline.operators import ranking as RK
from touchline.operators import search as SE
from touchline.operators import standings as S
from touchline.plans import rules as RU
from touchline.plans import surface as SF
from touchline.sources import files as SRC
from touchline.sources import ledger as LE
from touchline.sources import store as ST

HEAD = "Div,Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR\n"


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    """Rows of one file, in three widths, are the same whether it is read in one piece or in many."""
    lines = [f"E0,{1 + i % 28:02d}/09/93,H{i % 20},\"A, {i % 19}\",{i % 5},{i % 3},{'HDA'[i % 3]}" + (",wide,wider" if i % 7 == 0 else "") for i in range(6000)]
    lines[5000] = "E0,02/09/93,H\xe9,A,1,0,H"  # one line is Latin-1, so the file is
    lines[3000] = "E0,02/09/93"
    (tmp_path / "9394_E0.csv").write_bytes((HEAD + "\r\n".join(lines) + "\r\n").encode("latin-1"))

    def read():
        raw = SRC.read_ragged_csv(spark, str(tmp_path))
        rows = [(r.c["HomeTeam"], r.c["AwayTeam"], r.c["FTHG"], len(r.c)) for r in raw.orderBy("place").select(F.col("cells").alias("c")).collect()]
        return raw.rdd.getNumPartitions(), rows, sorted((r.home_name, r.away_name, r.match_date, r.fthg) for r in SRC.read_matches(spark, str(tmp_path)).collect())

    whole = read()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
        parts = SRC._lines(spark, str(tmp_path), "*.csv").rdd.getNumPartitions()
        cut = read()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert parts >= 10 and cut[1:] == whole[1:] and len(whole[1]) == 6000
    assert whole[1][0] == ("H0", "A, 0", "0", 7) and whole[1][5000][0] == "Hé" and whole[1][3000] == (None, None, None, 7)


def test_encodings_by_file(spark, tmp_path):
    (tmp_path / "9394_E0.csv").write_bytes((HEAD + "E0,01/09/93,Café,B,1,0,H\n").encode())
    (tmp_path / "9394_E1.csv").write_bytes((HEAD + "E1,01/09/93,Café,B,1,0,H\n").encode("latin-1"))
    (tmp_path / "9394_E2.csv").write_bytes(b"")
    (tmp_path / "9394_E3.csv").write_bytes(HEAD.encode())
    assert {r.home_name for r in SRC.read_matches(spark, str(tmp_path)).collect()} == {"Café"}
    folder = tmp_path / "9495_E0.csv"
    folder.mkdir()
    (folder / "part-0.csv").write_text(HEAD + "E0,01/09/94,A,B,1,0,H\n")
    (folder / "part-1.csv").write_text("AwayTeam,HomeTeam,Date,HG,AG,FTR\nA,B,02/09/94,0,0,D\n")
    assert sorted((r.home_name, r.fthg) for r in SRC.read_matches(spark, str(folder)).collect()) == [("A", 1), ("B", 0)]


def _put(folder, name, *rows):
    (folder / name).write_text(HEAD + "".join(f"E{name[6]},{d},{h},{a},{x},{y},{r}\n" for d, h, a, x, y, r in rows))


def test_only_changed_files_are_read(spark, tmp_path):
    folder, store = tmp_path / "raw", ST.Store(spark, str(tmp_path / "store"))
    folder.mkdir()
    _put(folder, "9394_E0.csv", ("01/09/93", "A", "B", 1, 0, "H"))
    _put(folder, "9495_E0.csv", ("01/09/94", "A", "B", 2, 0, "H"))
    _put(folder, "9596_E0.csv", ("01/09/95", "A", "B", 3, 0, "H"))
    derive = {"standings": lambda m: S.standings(m.select("season_end_year", "tier", F.col("home_name").alias("home_id"), F.col("away_name").alias("away_id"), "fthg", "ftag", "ftr"))}

    def refresh():
        seen = LE.refresh_files(store, str(folder), 1996, derive)
        return {os.path.basename(r.path): (r.why, r.fresh) for r in seen.collect()}

    goals = lambda: {r.season_end_year: r.g for r in store.read("matches").groupBy("season_end_year").agg(F.sum("fthg").alias("g")).collect()}
    assert refresh() == {f: ("new", True) for f in ("9394_E0.csv", "9495_E0.csv", "9596_E0.csv")} and store.versions() == [1]
    assert refresh() == {"9394_E0.csv": (None, False), "9495_E0.csv": (None, False), "9596_E0.csv": ("live", False)} and store.versions() == [1]
    parts = store.manifest()["tables"]["standings"]["parts"]
    _put(folder, "9394_E0.csv", ("01/09/93", "A", "B", 1, 0, "H"), ("02/09/93", "B", "A", 4, 0, "H"))
    os.utime(folder / "9495_E0.csv", (1, 1))  # the time changed, the content did not
    assert refresh() == {"9394_E0.csv": ("changed", True), "9495_E0.csv": ("changed", False), "9596_E0.csv": ("live", False)} and store.versions() == [1, 2]
    now = store.manifest()["tables"]["standings"]["parts"]
    assert {p for p in now if now[p] != parts[p]} == {"season_end_year=1994/tier=1"} and goals() == {1994: 5, 1995: 2, 1996: 3}
    _put(folder, "9596_E0.csv", ("01/09/95", "A", "B", 9, 0, "H"))
    os.remove(folder / "9495_E0.csv")
    (folder / "9697_E0.csv").write_text("<html>not a table</html>")
    assert refresh()["9596_E0.csv"] == ("changed", True) and goals() == {1994: 5, 1995: 2, 1996: 9}  # what a file held stays when it is gone
    assert {os.path.basename(r.path) for r in store.read("files").collect()} == {"9394_E0.csv", "9596_E0.csv", "9697_E0.csv"}


def _miles(a, b):
    (la, lo), (lb, lp) = a, b
    h = math.sin(math.radians(lb - la) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(lb)) * math.sin(math.radians(lp - lo) / 2) ** 2
    return 3958.8 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_grounds(spark, k):
    """Dense towns, lone places, shared places, both sides of the date line, the poles."""
    rng = random.Random(4)
    spots = {i: (51 + rng.gauss(0, 0.01), -0.1 + rng.gauss(0, 0.01)) for i in range(150)}
    spots |= {200 + i: (rng.uniform(-88, 88), rng.uniform(-180, 180)) for i in range(60)}
    spots |= {300 + i: (10.0, 179.99 if i % 2 else -179.99) for i in range(6)} | {400: (90.0, 0.0), 401: (-90.0, 10.0), 402: (89.9, 179.0), 403: (89.9, -1.0)} | {500 + i: (52.5, 1.5) for i in range(30)}
    df = spark.createDataFrame([(i, *p) for i, p in spots.items()] + [(900, None, 1.0), (901, 2.0, None)], "id long, lat double, lon double")
    got = {}
    for r in G.nearest_grounds(df, k).collect():
        got.setdefault(r.id, {})[r.nth] = (r.other, r.miles)
    assert set(got) == set(spots) and all(set(n) == set(range(1, k + 1)) for n in got.values())
    for i, p in spots.items():
        near_by = sorted((_miles(p, q), j) for j, q in spots.items() if j != i)[: k + 1]
        want = near_by[:k]
        near = [(round(m, 7), o) for o, m in (got[i][n] for n in range(1, k + 1))]
        assert [m for m, _ in near] == pytest.approx([m for m, _ in want], abs=1e-5), i
        if all(b[0] - a[0] > 1e-4 for a, b in zip(near_by, near_by[1:], strict=False)):
            assert [o for _, o in near] == [o for _, o in want]
    assert [got[500][n][0] for n in range(1, k + 1)] == [501, 502, 503][:k]
    assert G.nearest_grounds(df.limit(0), k).count() == 0 and G.nearest_grounds(df.where("id = 1"), k).count() == 0


def test_no_pairs_of_all_grounds(spark):
    df = spark.range(500).select("id", (F.col("id") % 25 / 10.0 + 50).alias("lat"), (F.col("id") / 25 / 10.0).alias("lon"))
    plan = G.nearest_grounds(df)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("n_ranges", [None, 7])
def test_ranks_in_ranges(spark, n_ranges):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, None]), i, rng.choice([7, 7, 7, rng.randint(0, 50), None])) for i in range(1500)]
    df = spark.createDataFrame(rows, "g int, id long, value long")
    df.createOrReplaceTempView("ranked_rows")
    want = {(r.id): (r.rk, r.n, r.rn, r.t) for r in spark.sql("select id, rank() over (partition by g order by value desc) as rk, count(value) over (partition by g) as n, row_number() over (partition by g order by value desc nulls last, id) as rn, ntile(4) over (partition by g order by value desc nulls last, id) as t from ranked_rows").collect()}
    got = RK.shared_ranks(df.where("g is not null"), ["g"], "value", n_ranges).collect()
    assert all((r["rank"], r.published) == want[r.id][:2] for r in got) and len(got) == sum(g is not None and v is not None for g, _, v in rows)
    order = [F.col("value").desc_nulls_last(), F.col("id").asc()]
    assert {r.id: r.nth for r in RK.row_numbers(df, ["g"], order, n_ranges=n_ranges).collect()} == {i: w[2] for i, w in want.items()}
    tiles = RK.tiles(df.where("g is not null"), ["g"], order, 4, n_ranges).collect()
    assert all(r.tile == want[r.id][3] for r in tiles)
    inside = {}
    for r in tiles:
        inside.setdefault((r.g, r.tile), []).append((r.place, r.n_in_tile))
    assert all(sorted(p for p, _ in v) == list(range(1, len(v) + 1)) and {n for _, n in v} == {len(v)} for v in inside.values())
    others = df.where("id % 2 = 0")
    less = RK.smaller_in(df.where("g is not null and value is not null"), others, ["g"], "value", "less", n_ranges).collect()
    plain = [(g, v) for g, i, v in rows if i % 2 == 0 and v is not None]
    assert all(r.less == sum(g == r.g and v < r.value for g, v in plain) for r in less) and less
    assert RK.row_numbers(df.where("false"), ["g"], order).count() == 0


def test_a_group_is_ranked_by_many_tasks(spark):
    df = spark.range(20_000).select(F.lit(1).alias("g"), "id")
    numbered = RK.row_numbers(df, ["g"], [F.col("id").asc()], n_ranges=8)
    assert numbered.where("nth != id + 1").isEmpty()
    parts = numbered.select(F.spark_partition_id().alias("p"), "id").groupBy("p").count().collect()
    assert max(r["count"] for r in parts) < 20_000


def test_names_by_grams(spark):
    rng = random.Random(6)
    names = [(i, "".join(rng.choice("abc d") for _ in range(rng.randint(0, 9)))) for i in range(300)] + [(900, None), (901, "a" * 5000)]
    terms = ["", "a", "ab", "abc", "abca", "zzz", "d a", "aaaa", None, "a", "c d"] + [k[1:5] for _, k in names[:30]]
    index = SE.name_index(spark.createDataFrame(names, "id long, key string"))
    got = {}
    for r in SE.search_names(index, spark.createDataFrame([(t,) for t in terms], "term string")).collect():
        got.setdefault(r.term, {})[r.nth] = (r.key, r.id)
    for t in {t for t in terms if t}:
        want = sorted((k, i) for i, k in names if k is not None and t in k)[:8]
        assert [got.get(t, {}).get(n) for n in range(1, len(want) + 1)] == want and len(got.get(t, {})) == len(want), t


def test_interval_joins(spark):
    rng = random.Random(7)
    spans = [(rng.choice("xy"), i, a, a + rng.choice([0, 1, 5, 40, 3000, -2])) for i, a in enumerate(rng.randint(-500, 500) for _ in range(200))] + [("x", 300, None, 5), ("y", 301, 1, None), ("x", 302, -(2**40), 2**40)]
    points = sorted({(rng.choice("xyz"), rng.randint(-520, 600)) for _ in range(300)}) + [("x", None)]
    iv = spark.createDataFrame(spans, "k string, n long, start long, end long")
    pt = spark.createDataFrame(points, "k string, at long")
    inside = lambda s, k, at: s[0] == k and None not in (s[2], s[3], at) and s[2] <= at <= s[3]
    want = {(k, at, s[1]) for k, at in points for s in spans if inside(s, k, at)}
    met = IV.holding(pt, iv, ["k"], "at", "start", "end")
    assert {(r.k, r["at"], r.n) for r in met.collect()} == want and met.count() == len(want)
    left = IV.holding(pt, iv, ["k"], "at", "start", "end", "left").collect()
    assert {(r.k, r["at"]) for r in left if r.n is None} == {p for p in points if not any(inside(s, *p) for s in spans)}
    late = {(r.k, r["at"]): r.n for r in IV.latest_holding(pt, iv, ["k"], "at", "start", "end").collect()}
    for p in points:
        best = max(((s[2], -s[3], s[1]) for s in spans if inside(s, *p)), default=None)
        tied = {s[1] for s in spans if inside(s, *p) and best and (s[2], -s[3]) == best[:2]}
        assert late[p] in tied if best else late[p] is None
    assert IV.binned(iv, "start", "end").count() <= 2 * len(spans)
    meets = lambda a, b: a[0] == b[0] and None not in (*a, *b) and a[2] <= a[3] and b[2] <= b[3] and max(a[2], b[2]) <= min(a[3], b[3])
    pairs = IV.overlapping(iv.where("n < 100 or n = 302"), iv, ["k"], "start", "end").select("left.n", "right.n").collect()
    assert sorted(map(tuple, pairs)) == sorted((a[1], b[1]) for a in spans if a[1] < 100 or a[1] == 302 for b in spans if meets(a, b))


def test_rules_of_a_file(spark, tmp_path):
    path = tmp_path / "rules.csv"
    path.write_text("tier,from_year,to_year,total_clubs,up_lo,up_hi,down_lo,down_hi\n1,1994,1999,22,,,20,22\n1,2000,2099,20,,,18,20\n1,2004,2004,20,,,17,20\n2,1994,2099,24,2,2,22,24\n")
    rules = SF.checked_rules(SF.read_rules(spark, str(path)))
    flat = sorted((r.tier, r.from_year, r.to_year, r.down_lo) for r in SF.rule_intervals(rules).collect())
    assert flat == [(1, 1994, 1999, 20), (1, 2000, 2003, 18), (1, 2004, 2004, 17), (1, 2005, 2099, 18), (2, 1994, 2099, 22)]
    path.write_text("tier,from_year,to_year,total_clubs,up_lo,up_hi,playoff_lo,playoff_hi,down_lo,down_hi\n1,1994,1993,22,,,,,20,22\n2,1994,1999,24,2,2,2,5,,\n2,2001,2099,24,2,2,3,5,22,25\n3,1994,2000,24,1,x,,,,\n3,1994,2099,24,,,,,,\n4,,2000,24,,,,,,\n")
    bad = {(r.tier, r.from_year): set(r.errors) for r in SF.rule_errors(SF.read_rules(spark, str(path))).collect()}
    assert bad[(1, 1994)] == {"ends before it starts"} and bad[(2, 1994)] == {"ranges overlap"} and bad[(2, 2001)] == {"a range is outside the table", "years without a rule before it"}
    assert "another rule starts at once" in bad[(3, 1994)] and "not a number" in bad[(4, None)]
    with pytest.raises(ValueError, match="tier 1 1994-1993"):
        SF.checked_rules(SF.read_rules(spark, str(path)))
    path.write_text("tier,from_year\n1,2\n")
    with pytest.raises(ValueError, match="missing columns to_year, total_clubs"):
        SF.read_rules(spark, str(path))
    grid = spark.range(1990, 2031).select(F.col("id").cast("int").alias("season_end_year"), F.explode(F.array(*(F.lit(t) for t in range(1, 7)))).alias("tier"))
    want = {(r.season_end_year, r.tier): r.total_clubs for r in S.rules_for(grid, RU.rules(spark), "total_clubs").collect()}
    got = IV.holding(grid, SF.rule_intervals(RU.rules(spark)).select("tier", "from_year", "to_year", "total_clubs"), ["tier"], "season_end_year", "from_year", "to_year", "left")
    assert {(r.season_end_year, r.tier): r.total_clubs for r in got.collect()} == want and not SF.rule_errors(RU.rules(spark)).collect()


def test_sql_over_a_published_state(spark, tmp_path):
    store = ST.Store(spark, str(tmp_path / "s"))
    rows = [("a", 2023, 1, "Premier League", 3, 60, "Stayed", "A"), ("a", 2024, 2, "Championship", 1, 90, "Champions", "A"), (None, 2024, 1, "Premier League", 20, 9, "Relegated", "B?")]
    standings = spark.createDataFrame(rows, "club_id string, season_end_year int, tier int, division_name string, position int, points int, status string, club_name string")
    trajectory = spark.createDataFrame([("a", "Alpha", 0.5, 1, 0), ("b", "Beta", 0.7, 2, 1)], "club_id string, canonical_name string, yo_yo_score double, total_promotions int, total_relegations int")
    store.publish({"standings": standings, "club_trajectory": trajectory}, {"club_trajectory": []}, ["club_trajectory"])
    SF.register_functions(spark)
    assert SF.register_store(store) == 1
    ask = lambda q: [tuple(r) for r in spark.sql(q).collect()]
    assert ask("SELECT canonical_name, yo_yo_score, total_promotions, total_relegations FROM club_trajectory ORDER BY yo_yo_score DESC LIMIT 10")[0] == ("Beta", 0.7, 2, 1)
    assert ask("SELECT DISTINCT club_name, season_end_year, tier FROM standings WHERE club_id IS NULL ORDER BY season_end_year, tier") == [("B?", 2024, 1)]
    assert ask("SELECT season_end_year, tier, division_name, position, points, status FROM standings WHERE club_id = 'a' ORDER BY season_end_year")[1] == (2024, 2, "Championship", 1, 90, "Champions")
    assert ask("SELECT season_label(season_end_year), season_code(season_end_year), ordinal(position) FROM standings WHERE club_id IS NULL") == [("2023/24", "2324", "20th")]
    assert ask("SELECT ordinal(111), ordinal(22), season_code(2000), wage_ratio(50, 200), wage_ratio(1, 0), round(haversine_miles(51.5, 0, 53.5, -2), 3)") == [("111th", "22nd", "9900", 25.0, None, pytest.approx(162.0, abs=2))]
    store.publish({"standings": standings.withColumn("points", F.lit(0))})
    assert ask("SELECT sum(points) FROM standings") == [(159,)]  # the views stay with the state that they were made for


def test_careers_of_large_inputs_are_the_same(spark, monkeypatch):
    """The tiers of the adapter by a window and by ranges."""
    from touchline.plans import adapters as A

    view = lambda: sorted(map(tuple, A.career(spark, "/root/testdata/sf0.001").collect()))
    small = view()
    monkeypatch.setattr(A, "large", lambda df: True)
    assert view() == small and len(small) > 20
