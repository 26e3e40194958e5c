"""Seeding: checks of required columns, rows to keep and to skip, stale rows and references to them, and merges into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.finance import deduction_errors, finance_errors
from touchline.sources.sinks import few, kept_table
from touchline.sources.store import Store

#: Columns that each seed must have (fixed values).
REQUIRED = {
    "clubs": ("club_id", "canonical_name", "name_variants", "lineage_parent_id", "current_tier"),
    "finances": ("club_id", "season_end_year", "disclosure"),
    "deductions": ("club_id", "season_end_year", "tier", "points", "applied"),
}


def require(rows: DataFrame, seed: str) -> DataFrame:
    """rows, if they have all columns that the seed needs; else an error that names the missing ones."""
    if missing := sorted(set(REQUIRED[seed]) - set(rows.columns)):
        raise ValueError(f"{seed}: missing columns {', '.join(missing)}")
    return rows


def latest_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key in the order of the seed, as later rows replace earlier ones."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def seed_clubs(rows: DataFrame, stored: DataFrame | None = None, order: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(the club table after seeding, ids that the seed no longer has). The seed is the truth: its last row of an id stays."""
    given = require(rows, "clubs").where("club_id is not null")
    clubs = given if order is None else latest_of_each(given, ["club_id"], order).drop(order)
    return clubs, None if stored is None else stored.select("club_id").join(clubs.select("club_id"), "club_id", "left_anti")


def detach(table: DataFrame, stale: DataFrame) -> DataFrame:
    """Rows of clubs that are gone stay, without a club."""
    gone = stale.select("club_id", F.lit(True).alias("_gone")).distinct()
    return table.join(gone, "club_id", "left").withColumn("club_id", F.when(F.col("_gone").isNull(), F.col("club_id"))).select(*table.columns)


def seed_finances(rows: DataFrame, clubs: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(accounts to keep, accounts to skip with their errors). Of two valid rows with one key the last stays."""
    checked = finance_errors(require(rows, "finances"), clubs)
    good = checked.where("size(errors) = 0").drop("errors")
    return good if order is None else latest_of_each(good, ["club_id", "season_end_year"], order).drop(order), checked.where("size(errors) > 0")


def seed_deductions(rows: DataFrame, clubs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sanctions to keep, sanctions to skip with their errors); the stored table is replaced as a whole."""
    checked = deduction_errors(require(rows, "deductions"), clubs)
    return checked.where("size(errors) = 0").drop("errors"), checked.where("size(errors) > 0")


#: What a merge says of a row (fixed order).
CHANGES = ("inserted", "changed", "unchanged", "removed")


def merge_snapshot(stored: DataFrame, given: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of either table with `change`, by one full outer join on the keys (null keys are equal).

    Removed rows have their stored values, all others the given ones; columns that only one of the
    tables has are null in the other. Keys must be unique in each table. Neither side is broadcast
    unless Spark finds it small, so a table may be of any size.
    """
    types = dict(stored.dtypes) | dict(given.dtypes)
    rest = [c for c in types if c not in keys]
    side = lambda df, name: df.select(*(F.col(f"`{k}`").alias(f"_{name}_{k}") for k in keys), F.struct(*((F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(types[c]).alias(c) for c in [*keys, *rest])).alias(name))
    same = [F.col(f"_old_{k}").eqNullSafe(F.col(f"_new_{k}")) for k in keys]
    both = side(stored, "old").join(side(given, "new"), same, "full")
    change = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("changed")
    row = F.when(F.col("new").isNull(), F.col("old")).otherwise(F.col("new"))
    return both.select(change.alias("change"), row.alias("row")).select(*(F.col(f"row.`{c}`").alias(c) for c in [*keys, *rest]), "change")


def _counted(rows: DataFrame) -> DataFrame:
    """Rows that may repeat as one row each with their number."""
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n_rows"))


def seed(store: Store, clubs: DataFrame, finances: DataFrame | None = None, deductions: DataFrame | None = None, order: str | None = None, references: tuple[str, ...] = ("standings",)) -> tuple[int, DataFrame]:
    """Brings the stored clubs, accounts and sanctions to what the seeds say, in one publication; (number of the state, table, change, n).

    The seeds are the truth: rows that they no longer have go, their last row of a key stays, and
    accounts and sanctions are checked against the clubs given now. Rows of `references` that name
    a club that is gone lose it; only their partitions that hold such a row are written again.
    Tables without a change are not written, and if there is none at all nothing is published.
    """
    state = store.manifest()
    spark, known = store.spark, state["tables"]
    old = lambda name, like: store.read(name, state["number"]) if name in known else spark.createDataFrame([], like.schema)
    snapshots = {"clubs": (seed_clubs(clubs, order=order)[0], ["club_id"])}
    if finances is not None:
        snapshots["finances"] = (seed_finances(finances, snapshots["clubs"][0], order)[0], ["club_id", "season_end_year"])
    if deductions is not None:
        kept = _counted(seed_deductions(deductions, snapshots["clubs"][0])[0])
        snapshots["deductions"] = (kept, [c for c in kept.columns if c != "n_rows"])
    merged = {name: kept_table(merge_snapshot(old(name, df), df, keys), f"seed-{name}") for name, (df, keys) in snapshots.items()}
    counts = None
    for name, rows in merged.items():
        own = rows.groupBy("change").agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "change", "n")
        counts = own if counts is None else counts.unionByName(own)
    changed = {r["table"] for r in counts.where("change != 'unchanged'").select("table").distinct().collect()}  # a row a table
    publish = {name: rows.where("change != 'removed'").drop("change") for name, rows in merged.items() if name in changed}
    stale = few(merged["clubs"].where("change = 'removed'").select("club_id"))
    for name in (t for t in references if t in known and "clubs" in changed):
        table, keys = store.read(name, state["number"]), known[name]["keys"]
        hit = few(table.join(stale, "club_id", "left_semi").select(*keys).distinct())
        publish[name] = detach(table.join(hit, keys, "left_semi"), stale)
    if not publish:
        return state["number"], counts
    whole = [name for name in publish if name in snapshots]
    return store.publish(publish, {name: [] for name in whole}, whole, on=state["number"]), counts
