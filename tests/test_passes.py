"""How often, and in how many pieces, inputs are read and written: figures that have to grow no faster than the input."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from touchline.operators import career as C
from touchline.operators import increment as IN
from touchline.operators import results as R
from touchline.operators import stories as ST
from touchline.plans import adapters as A
from touchline.plans import queries as Q
from touchline.sources import store as STO

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_line_items_are_shuffled_by_order_alone(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = _plan(A.matches(spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(l_orderkey" in plan and "hashpartitioning(l_suppkey" not in plan and "hashpartitioning(s_nationkey" not in plan


def test_league_tables_are_made_once(spark):
    assert not any("lineitem" in f for f in Q._judged_league(spark, SF).inputFiles())


def _tables_read(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_careers_are_published_and_refreshed_from_tables_made_once(spark, monkeypatch):
    given = []
    monkeypatch.setattr(IN, "publish_careers", lambda store, t: given.append(t))
    monkeypatch.setattr(IN, "refresh_careers", lambda store, t: given.append(t))
    with pytest.raises(KeyError):  # nothing was published
        Q.career_refresh(spark, SF)
    assert len(given) == 2 and not any("lineitem" in f for t in given for f in t.inputFiles())


def test_rules_by_size_are_not_joined(spark):
    assert _tables_read(Q.judged(spark, SF)) == _tables_read(A.career(spark, SF)) == 2


CAREERS = [("a", 2000, 1), ("a", 2003, 2), ("a", 2003, 3), ("a", 2005, None), ("b", 2001, 4), ("b", 2001, 4), (None, 2000, 1), (None, 2002, 2), ("c", None, 1)]


def test_careers_join_no_seasons_and_multiply_no_rows(spark):
    t = spark.createDataFrame([(*r, "Stayed") for r in CAREERS], "club_id string, season_end_year int, tier int, status string")
    filled = C.gap_filled(t)
    assert "Join" not in _plan(filled) and "Expand" not in _plan(C.rollup(t))
    assert [_plan(p).count("Exchange hashpartitioning") for p in (C.trajectory(t, 2005), C.trajectory(t))] == [3, 3]  # a shuffle by club for each of rollup, streak and level
    assert sorted(map(str, filled.collect())) == sorted(
        str(r) for r in spark.createDataFrame([("a", 2000, 1), ("a", 2001, 6), ("a", 2002, 6), ("a", 2003, 2), ("a", 2003, 3), ("a", 2004, 6), ("a", 2005, 6), ("b", 2001, 4), (None, 2000, 6), (None, 2001, 6), (None, 2002, 6)], filled.schema).collect()
    )
    assert {r.club_id: (r.n_seasons, r.seasons_in_tier1) for r in C.rollup(t.where("season_end_year is not null")).collect()} == {"a": (3, 1), "b": (1, 0), None: (2, 1)}


def test_a_refresh_does_not_read_the_manifest_for_each_partition(spark, tmp_path, monkeypatch):
    rows = lambda status: spark.createDataFrame([(f"c{c}", 2000 + y, c % 4 + 1, c // 4 + 1, 3, status) for c in range(12) for y in range(4)], "club_id string, season_end_year int, tier int, position int, n_clubs int, status string")
    store, read, calls = STO.Store(spark, str(tmp_path)), STO.Store.manifest, []
    IN.publish_careers(store, rows("Stayed"))
    monkeypatch.setattr(STO.Store, "manifest", lambda *a: calls.append(a) or read(*a))
    IN.refresh_careers(store, rows("Champions"))
    assert {r.status for r in store.read("settled").collect()} == {"Champions"} and len(calls) < 10  # sixteen divisions and up to twelve parts were replaced


def test_form_reads_matches_once(spark):
    rows = [(2000 + i % 2, f"2001-01-{1 + i:02d}", "a", "b", 1, 0, "HDA"[i % 3], i) for i in range(12)] + [(2002, None, "a", "b", 1, 0, "H", 50), (2001, "2001-02-01", "c", "a", 0, 0, "D", 51)]
    m = spark.createDataFrame(rows, "season_end_year int, match_date string, home_id string, away_id string, fthg int, ftag int, ftr string, n int").withColumn("match_date", F.to_date("match_date"))
    form = R.recent_form(m, ["n"])
    assert {r.club_id: (r.season_end_year, r.form) for r in form.collect()} == {"a": (2001, "DLWDL"), "b": (2001, "".join({"H": "L", "D": "D", "A": "W"}["HDA"[i % 3]] for i in (11, 9, 7, 5, 3))), "c": (2001, "D")}
    assert _plan(R.recent_form(m, ["n"])).count("Scan ExistingRDD") == 1


def test_front_matter_is_read_once_by_all_tasks(spark):
    f = spark.createDataFrame([(i, f"founded: {1800 + i}") for i in range(40)], "club_id long, front_matter string").coalesce(1)
    read = ST.read_facts(f)
    assert _plan(read.select("facts.founded", "themes")).count("ArrowEvalPython [") == 1
    assert len({r.p for r in read.select(F.spark_partition_id().alias("p"), "facts").collect()}) > 1


def test_a_partition_is_not_written_by_every_task(spark, tmp_path):
    store = STO.Store(spark, str(tmp_path))
    store.publish({"t": spark.range(0, 400, 1, 20).select((F.col("id") % 5).cast("int").alias("season_end_year"), F.lit(1).alias("tier"), "id")})
    files = [f for _, _, names in os.walk(tmp_path / "data") for f in names if f.endswith(".parquet")]
    assert len(files) == 5 and store.read("t").count() == 400


def test_few_ngrams_are_dealt_at_once(monkeypatch):
    from touchline.llm import ngram_join as J

    seen, deal = [], J._deal
    monkeypatch.setattr(J, "_DEALT", 100)
    monkeypatch.setattr(J, "_deal", lambda columns, *a: seen.append(len(columns[0])) or deal(columns, *a))
    docs = pd.DataFrame({"node": range(50), "n": 30, "d": 30, "keys": [np.arange(i, i + 30, dtype=np.uint64).tobytes() for i in range(50)], "part": range(50), "cells": [bytes(16)] * 50})
    list(J._dealer(8, 32)(iter([docs])))
    assert sum(seen) == 1500 and max(seen) <= 130
