"""Careers kept up to date: only clubs that a change can reach are computed again.

A club's settled status depends on its own season and its next one, and its career on its own
settled seasons. So a change to some divisions (season and tier) reaches the clubs that stand, or
stood, in them, and nobody else; of the settled tables it reaches the divisions in which these
clubs play in the changed seasons and the ones before. Whether a club is active depends on the
latest season of all: where a change moves that, the gaps of all careers are set anew from the
stored careers, without their seasons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators.career import trajectory, with_gap
from touchline.operators.standings import SEASON, reconcile
from touchline.sources.sinks import few, kept_table
from touchline.sources.store import Store

#: Careers are stored in so many parts, by a hash of the club; a change writes the parts of its clubs.
PARTS = 64
PART = ["part"]


def _part() -> Column:
    return F.pmod(F.xxhash64("club_id"), F.lit(PARTS)).cast("int").alias("part")


def publish_careers(store: Store, judged: DataFrame) -> int:
    """Publishes all season tables with statuses by position (judged), with settled ones, and all careers; the number of the state."""
    rows = kept_table(judged, "judged")
    settled = kept_table(reconcile(rows), "settled-all")
    careers = trajectory(settled)
    whole = ["judged", "settled", "careers"]
    return store.publish({"judged": rows, "settled": settled, "careers": careers.select("*", _part())}, {"careers": PART}, whole)


def changed_divisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Seasons and tiers of `new` whose rows are not those of `old`, and those that both have are compared row by row."""
    given = new.select(*SEASON).distinct()
    before = old.join(few(given), SEASON, "left_semi").select(*new.columns)
    return before.exceptAll(new).unionByName(new.exceptAll(before)).select(*SEASON).distinct()


def refresh_careers(store: Store, judged: DataFrame) -> DataFrame:
    """Publishes new rows of some divisions with all that follows from them, in one step; (what, n) says how much was done.

    judged has the whole rows of the divisions that it holds; divisions that are the same as stored
    count as unchanged. Clubs that are left without a season lose their career.
    """
    spark, begun = store.spark, store.manifest()
    state = begun["number"]
    read = lambda name: store.read(name, state)
    old, rows = read("judged"), kept_table(judged, "judged-new")
    changed = few(kept_table(changed_divisions(old, rows), "changed"))
    new = rows.join(changed, SEASON, "left_semi")
    was = old.join(changed, SEASON, "left_semi")
    clubs = few(kept_table(was.select("club_id").union(new.select("club_id")).where("club_id is not null").distinct(), "clubs-changed"))
    history = old.join(changed, SEASON, "left_anti").join(clubs, "club_id", "left_semi").unionByName(new.where("club_id is not null"))
    settled = kept_table(reconcile(history), "settled-new")

    seasons = changed.select("season_end_year").union(changed.select((F.col("season_end_year") - 1).alias("season_end_year"))).distinct()
    reached = few(kept_table(settled.join(few(seasons), "season_end_year", "left_semi").select(*SEASON).union(changed.select(*SEASON)).distinct(), "reached"))
    stay = read("settled").join(reached, SEASON, "left_semi").join(clubs, "club_id", "left_anti")
    nameless = new.where("club_id is null")
    kept_out = stay.where("club_id is not null").unionByName(stay.where("club_id is null").join(changed, SEASON, "left_anti"))
    division = kept_out.unionByName(settled.join(reached, SEASON, "left_semi")).unionByName(nameless.select(*settled.columns))

    latest = lambda df: df.where("club_id is not null").agg(F.max("season_end_year")).first()[0]
    before, after = latest(old), latest(old.join(changed, SEASON, "left_anti").select("club_id", "season_end_year").unionByName(new.select("club_id", "season_end_year")))
    stored = read("careers")
    parts = few((stored if after != before else clubs.select(_part())).select("part").distinct().union(clubs.select(_part())).distinct())
    others = stored.join(parts, PART, "left_semi").join(clubs, "club_id", "left_anti")
    careers = with_gap(others, F.lit(after)).unionByName(trajectory(settled, after).select("*", _part()))
    done = {"divisions": changed, "clubs": clubs, "seasons of clubs": settled, "divisions written": reached}
    counts = spark.createDataFrame([(what, df.count()) for what, df in done.items()], "what string, n long")
    if changed.isEmpty():
        return counts
    gone = lambda name, by, df: [p for p in _paths(by, df) if p in begun["tables"][name]["parts"]]
    store.publish({"judged": new, "settled": division, "careers": careers}, {"careers": PART}, gone={"settled": gone("settled", SEASON, reached), "careers": gone("careers", PART, parts)}, on=state)
    return counts


def _paths(by: list[str], keys: DataFrame) -> list[str]:
    """Names of partitions: a row a season and tier, or a part."""
    return ["/".join(f"{k}={r[k]}" for k in by) for r in keys.select(*by).collect()]
