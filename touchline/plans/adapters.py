"""The driver's tables as a league: suppliers as clubs with careers, nations as clubs with matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.operators.ranking import tiles
from touchline.sources.sinks import FEW_NUMBERS, few, large


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quarter_season(date: Column) -> Column:
    """A quarter is a season: 1995 Q1 is 1994."""
    return (F.year(date) - 1995) * 4 + F.quarter(date) + 1993


def cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("long")


def career(spark: SparkSession, sf_dir: str) -> DataFrame:
    """club_id, season_end_year, tier, position, n_clubs of every club-season, with gaps."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("club_id"), quarter_season(F.col("l_shipdate")).alias("season_end_year"), cents(F.col("l_extendedprice")).alias("cents"))
    q = li.groupBy("club_id", "season_end_year").agg(F.sum("cents").alias("rev"))
    season = q.groupBy("season_end_year").agg(F.expr("sum(rev) div count(*)").alias("mean"))
    c = F.col("club_id")
    swing = F.when(c % 4 == 0, 0).when(c % 4 == 1, 4).when(c % 4 == 2, 10).otherwise(30)
    strength = (F.col("rev") - F.col("mean")) * swing + F.col("mean") * ((c * 37) % 10)
    active = F.col("rev") * 10 >= F.col("mean") * 7  # a club with less has no season then
    seen = q.join(season, "season_end_year").where(active).select("club_id", "season_end_year", strength.alias("strength"))
    order = [F.desc("strength"), F.asc("club_id")]
    if large(li):  # a season is cut into ranges; the windows below give the same
        tiled = tiles(seen, ["season_end_year"], order, 5)
        return tiled.select("club_id", "season_end_year", "tile", F.col("place").alias("position"), F.col("n_in_tile").alias("n_clubs")).withColumnRenamed("tile", "tier")
    by = lambda *keys: Window.partitionBy(*keys).orderBy(*order)
    tiered = seen.withColumn("tier", F.ntile(5).over(by("season_end_year")))
    return tiered.select(
        "club_id", "season_end_year", "tier", F.row_number().over(by("season_end_year", "tier")).alias("position"), F.count("*").over(Window.partitionBy("season_end_year", "tier")).cast("int").alias("n_clubs")
    )


def relative_ranges() -> dict[str, Column]:
    """The ranges of a rule by the size of the division that a row tells in n_clubs: second goes up, third and fourth play off, the last two go down."""
    n, none = F.col("n_clubs"), F.lit(None).cast("int")
    return {"up_lo": F.lit(2), "up_hi": F.lit(2), "playoff_lo": F.lit(3), "playoff_hi": F.lit(4), "po_down_lo": none, "po_down_hi": none, "down_lo": n - 1, "down_hi": n}


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items between a customer's and a supplier's nation of one region, as matches."""
    goals = {"fthg": F.col("l_quantity").cast("int") % 5, "ftag": ((F.col("l_linenumber") + F.col("l_partkey")) % 4).cast("int"), "shipped": F.to_date("l_shipdate")}
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *(c.alias(n) for n, c in goals.items()))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("season_end_year"), F.to_date("o_orderdate").alias("match_date"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    home = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("c_nationkey").alias("home_id"), F.col("n_regionkey").alias("home_region"))  # nations are 25 rows
    away = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("s_nationkey").alias("away_id"), F.col("n_regionkey").alias("away_region"))
    hosted = orders.join(home, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey")  # orders meet customers before line items, which are shuffled once
    visits = li.join(few(away, FEW_NUMBERS), F.col("l_suppkey") == F.col("s_suppkey"))
    joined = visits.join(hosted, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("home_region") == F.col("away_region")) & (F.col("home_id") != F.col("away_id")))
    return joined.select(
        "season_end_year",
        (F.col("home_region") + 1).alias("tier"),
        "match_date",
        "home_id",
        "away_id",
        "fthg",
        "ftag",
        F.when(F.col("fthg") > F.col("ftag"), "H").when(F.col("fthg") < F.col("ftag"), "A").otherwise("D").alias("ftr"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "shipped",
    )


def finances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts of suppliers: turnover and staff costs in cents, disclosure by a mask, a signed result."""
    price = cents(F.col("l_extendedprice"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("club_id"), quarter_season(F.col("l_shipdate")).alias("season_end_year"), price.alias("price"), "l_discount", F.col("l_extendedprice").alias("full"))
    staff = F.round(F.col("full") * 100 * (1 - F.col("l_discount")) * (F.lit(0.4) + (F.col("club_id") % 7) * F.lit(0.125))).cast("long")
    sums = li.groupBy("club_id", "season_end_year").agg(F.sum("price").alias("turnover"), F.sum(staff).alias("staff_costs"))
    key = (F.col("club_id") * 5 + F.col("season_end_year") * 3) % 7
    full = key < 5
    signed = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("club_id"), cents(F.col("s_acctbal")).alias("balance"))
    return sums.join(signed, "club_id").select(
        "club_id",
        "season_end_year",
        F.when(full, "full").when(key == 5, "small_company").otherwise("not_filed").alias("disclosure"),
        F.when(full, F.col("turnover")).alias("turnover"),
        F.when(full & (key != 4), F.col("staff_costs")).alias("staff_costs"),
        F.when(full, F.col("balance") * (F.col("season_end_year") % 5 - 2)).alias("profit_before_tax"),
    )
