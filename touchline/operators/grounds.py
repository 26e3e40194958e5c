"""Nearest grounds by a grid: cells double in size until the nearest ones are certain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.text import EARTH_MILES, haversine_miles
from touchline.sources.sinks import few, kept_table

#: Cells have a side of 360 degrees / 2^level.
FINEST = 24


def _cell(degrees: Column, level: int) -> Column:
    return F.floor(degrees / (360.0 / 2**level)).cast("long")


def _certain_miles(lat: Column, level: int) -> Column:
    """All points outside the 3 x 3 cells around a point are farther than this; null where these are the whole world."""
    side = 360.0 / 2**level
    if level <= 1:
        return F.lit(None).cast("double")
    narrow = F.cos(F.radians(lat)) * F.cos(F.radians(F.least(F.abs(lat) + side, F.lit(90.0))))
    east = F.lit(2 * EARTH_MILES) * F.asin(F.sqrt(F.greatest(narrow, F.lit(0.0))) * F.sin(F.radians(F.lit(side / 2))))
    return F.least(east, F.radians(F.lit(side)) * EARTH_MILES) * (1 - 1e-9)


def start_level(places: DataFrame) -> int:
    """The coarsest level at which cells hold some four places on average; the finest if there is none. One pass."""
    counts = places.agg(F.count("*"), *(F.approx_count_distinct(F.struct(_cell(F.col("lat"), k), _cell(F.col("lon"), k))) for k in range(1, FINEST + 1))).first()
    return next((k for k in range(1, FINEST + 1) if counts[k] * 4 >= counts[0]), FINEST)


def nearest_grounds(grounds: DataFrame, k: int = 3) -> DataFrame:
    """id, other, nth, miles: the k nearest other grounds of each ground (id, lat, lon), ties by id.

    Grounds without an id or a place are left out; repeated rows give repeated results. Grounds at
    one place are one place with its first k + 1 ids, so a place that many share makes no pairs
    among them. Each round joins the places that are open with those in the 3 x 3 cells around; a
    place is done when its k-th neighbour is nearer than anything outside can be, else it goes on
    with cells twice as wide. Near the poles, where cells are narrow, that takes more rounds.
    """
    lon = F.col("lon").cast("double")
    round_globe = F.when((lon >= -180) & (lon < 180), lon).otherwise(F.pmod(lon + 180, F.lit(360.0)) - 180)
    placed = grounds.where("lat is not null and lon is not null and id is not null").select("id", F.col("lat").cast("double").alias("lat"), round_globe.alias("lon"))
    first = F.row_number().over(Window.partitionBy("lat", "lon").orderBy("id"))
    few_ids = placed.distinct().withColumn("nth", first).where(F.col("nth") <= k + 1)  # limited before the shuffle
    places = kept_table(few_ids.groupBy("lat", "lon").agg(F.collect_list("id").alias("ids")), "grounds")
    level = start_level(places)
    todo, found = places.select("lat", "lon"), None
    best = Window.partitionBy("lat", "lon").orderBy("miles", "other")
    while True:
        wrap = lambda x: F.pmod(x, F.lit(2**level))  # noqa: B023, E731
        near = lambda c: F.array(*(c + i for i in (-1, 0, 1)))
        here = places.select(F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), "ids", _cell(F.col("lat"), level).alias("y"), wrap(_cell(F.col("lon"), level)).alias("x"))
        asked = todo.select("lat", "lon", F.explode(near(_cell(F.col("lat"), level))).alias("y"), F.array_distinct(F.transform(near(_cell(F.col("lon"), level)), wrap)).alias("xs")).select("lat", "lon", "y", F.explode("xs").alias("x"))
        hits = few(asked).join(here, ["y", "x"]).select("lat", "lon", haversine_miles(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")).alias("miles"), F.explode("ids").alias("other"))
        top = hits.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
        last = top.groupBy("lat", "lon").agg(F.count("*").alias("n"), F.max("miles").alias("far"), F.sort_array(F.collect_list(F.struct("miles", "other"))).alias("near"))
        sure = _certain_miles(F.col("lat"), level)
        done = sure.isNull() | ((F.col("n") > k) & (F.col("far") < sure))
        judged = kept_table(last.select("lat", "lon", "near", done.alias("done")), "grounds-near")
        some = judged.where("done").select("lat", "lon", "near")
        found = some if found is None else found.unionByName(some)
        todo = judged.where("not done").select("lat", "lon")
        if level <= 1 or todo.isEmpty():
            break
        level -= 1
    pairs = placed.join(found, ["lat", "lon"]).select("id", F.slice(F.filter("near", lambda x: x["other"] != F.col("id")), 1, k).alias("near"))
    return pairs.select("id", F.posexplode("near").alias("at", "near")).select("id", F.col("near.other").alias("other"), (F.col("at") + 1).alias("nth"), F.col("near.miles").alias("miles"))
