"""Which match files have to be read: a ledger of files in the store, by path, size, time and content.

A file of a past season that the ledger knows is not read again while its size and time stay. Files
of the season in progress are read every time, as they gain results. Where the content turns out to
be the same, its season is left alone; else the matches of its season and tier, and only these, are
read again and published together with the tables derived from them and with the ledger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.text import season_of_code
from touchline.operators.standings import SEASON
from touchline.sources.files import FILE_NAME, _lines, file_of, read_matches
from touchline.sources.sinks import kept_table
from touchline.sources.store import Store

LEDGER = "path string, size long, modified timestamp, season_end_year int, tier int, digest decimal(38,0)"


def listed(spark: SparkSession, folder: str, glob: str = "*.csv") -> DataFrame:
    """path, size, modified, season_end_year, tier of the match files in a folder, from the listing alone: no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    name = file_of(F.col("path"))
    code, tier = F.regexp_extract(name, FILE_NAME, 1), F.regexp_extract(name, FILE_NAME, 2)
    return files.where(code != "").select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), season_of_code(code).cast("int").alias("season_end_year"), (tier.cast("int") + 1).alias("tier"))


def to_read(files: DataFrame, ledger: DataFrame, live_season: int) -> DataFrame:
    """The files with `why`: new, changed (size or time), live, or null where the ledger is enough."""
    known = ledger.select("path", F.col("size").alias("_size"), F.col("modified").alias("_modified"), F.col("digest").alias("known_digest"))
    why = F.when(F.col("_size").isNull(), "new").when((F.col("_size") != F.col("size")) | ~F.col("_modified").eqNullSafe(F.col("modified")), "changed").when(F.col("season_end_year") >= live_season, "live")
    return files.join(known, "path", "left").select(*files.columns, "known_digest", why.alias("why"))


def digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, digest: the sum of the hashes of a file's lines, so that many tasks share a large file."""
    return _lines(spark, paths, "*").groupBy("path").agg(F.sum(F.xxhash64("value").cast("decimal(38,0)")).cast("decimal(38,0)").alias("digest"))


def refresh_files(store: Store, folder: str, live_season: int, derive: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Brings `matches`, the tables derived from them and `files` of the store up to date with a folder; path, why and fresh of each file.

    fresh: its content was new, so its season and tier were published. `derive` makes tables by
    season and tier from the matches of whole seasons. Files that are gone leave the ledger; what
    they held stays published. A file without a valid match replaces nothing.
    """
    spark, state = store.spark, store.manifest()
    ledger = store.read("files", state["number"]) if "files" in state["tables"] else spark.createDataFrame([], LEDGER)
    files = kept_table(to_read(listed(spark, folder), ledger, live_season), "files")
    read = [r["path"] for r in files.where("why is not null").select("path").collect()]  # names of files, not rows of them
    seen = digests(spark, read) if read else spark.createDataFrame([], "path string, digest decimal(38,0)")
    digest = F.coalesce("digest", F.when(F.col("why").isNull(), F.col("known_digest")), F.lit(0).cast("decimal(38,0)"))
    judged = kept_table(files.join(seen, "path", "left").withColumn("digest", digest).withColumn("fresh", F.col("why").isNotNull() & ~F.col("digest").eqNullSafe(F.col("known_digest"))), "files-judged")
    seasons = judged.where("fresh").select(*SEASON).distinct()
    paths = [r["path"] for r in judged.join(seasons, SEASON, "left_semi").select("path").collect()]
    now = judged.select("path", "size", "modified", "season_end_year", "tier", "digest")
    if now.exceptAll(ledger).isEmpty() and ledger.exceptAll(now).isEmpty():
        return judged.select("path", "why", "fresh")
    tables = {"files": now}
    if paths:
        matches = kept_table(read_matches(spark, paths).drop("place"), "file-matches")
        tables |= {"matches": matches} | {name: make(matches) for name, make in (derive or {}).items()}
    store.publish(tables, {"files": []}, ["files"], on=state["number"])
    return judged.select("path", "why", "fresh")
