"""Keeps season tables up to date from a stream of match files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from touchline.operators.standings import SEASON, standings
from touchline.sources.sinks import replace_seasons
from touchline.sources.store import Store


def refresh_seasons(spark: SparkSession, arriving: str, matches: str, tables: str, checkpoint: str) -> StreamingQuery:
    """Every batch of arriving matches is kept by its number, so a repeated batch replaces itself; then the
    tables of the seasons in it, and only these, are computed again from all matches."""
    schema = spark.read.parquet(arriving).schema

    def take(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{matches}/batch={number}")
        seasons = batch.select(*SEASON).distinct()
        replace_seasons(standings(spark.read.parquet(matches).join(seasons, SEASON, "left_semi")), tables)

    return spark.readStream.schema(schema).parquet(arriving).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish_seasons(store: Store, arriving: str, matches: str, checkpoint: str) -> StreamingQuery:
    """As `refresh_seasons`, but the tables of all seasons of a batch are published together: readers of the store see a batch whole or not at all."""
    spark = store.spark
    schema = spark.read.parquet(arriving).schema

    def take(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{matches}/batch={number}")
        seasons = batch.select(*SEASON).distinct()
        store.publish({"standings": standings(spark.read.parquet(matches).join(seasons, SEASON, "left_semi"))})

    return spark.readStream.schema(schema).parquet(arriving).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
