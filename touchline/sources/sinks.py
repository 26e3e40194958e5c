"""Writers: idempotent replacement of seasons, JSON payloads, intermediate tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_seasons(df: DataFrame, path: str) -> None:
    """Replaces exactly the (season, tier) partitions that df holds; writing the same rows again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season_end_year", "tier").parquet(path)


def read_seasons(spark: SparkSession, path: str) -> DataFrame:
    """Files of different ages: columns that a file lacks are null."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def payload(df: DataFrame) -> DataFrame:
    """One JSON object per row, as the pages' scripts read it."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("payload"))


def write_payload(df: DataFrame, path: str) -> None:
    payload(df).write.mode("overwrite").text(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one if all of Spark runs in one process, as in tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="touchline-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """df, written once into the shared folder and read again, for tables that a plan uses many times."""
    path = f"{shared_folder(df.sparkSession)}/touchline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a dimension of clubs that are broadcast at most; and of one of a few numbers (some 50 MB).
FEW_ROWS, FEW_NUMBERS = 50_000, 1_000_000


def few(df: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """A narrow dimension, marked for broadcast if it has `most` rows at most; beyond, Spark joins in another way."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Bytes, by Spark's estimate of a scan, from which ranks are made in ranges.
LARGE = 256 << 20


def large(df: DataFrame) -> bool:
    """Whether a scan is estimated to give LARGE bytes or more; no job is run for it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= LARGE
