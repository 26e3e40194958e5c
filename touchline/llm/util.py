"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space that separates words: space, and tab to carriage return.
WORD_GAP = r"[\x20\x09-\x0D]+"


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """Array of the runs of characters that are no white space."""
    return F.array_remove(F.split(text, WORD_GAP), "")


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def nested(df: DataFrame, name: str = "row") -> DataFrame:
    """df as one struct column, so that no column of it can clash with those that an operator adds."""
    return df.select(F.struct(*(df[f"`{c}`"] for c in df.columns)).alias(name))


def unnested(columns: list[str], name: str = "row") -> list[Column]:
    """The columns of `nested` again."""
    return [F.col(f"{name}.`{c}`").alias(c) for c in columns]


def shared_dir(spark: SparkSession) -> str:
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


#: While a table is written: shuffle files go when the query ends, and batches for Python are bounded in bytes, not rows alone.
_WHILE_STORING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table into the shared folder and read again: its lineage ends there, and its shuffle files go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/touchline/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in _WHILE_STORING}
    try:
        for k, v in _WHILE_STORING.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables that `stored` gave and that nothing reads any more."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a few numbers that are broadcast, or taken by one task, at most: some 50 MB. Beyond, Spark shuffles.
FEW_ROWS = 300_000


def few_rows(table: DataFrame) -> DataFrame:
    """A stored table of a few numbers a row, marked for broadcast where it has FEW_ROWS rows at most; beyond, joins shuffle."""
    return F.broadcast(table) if table.count() <= FEW_ROWS else table


def gathered(table: DataFrame, n: int | None = None) -> DataFrame:
    """A table of a few numbers a row in one partition where it has FEW_ROWS rows at most, so that grouping and joining them needs no shuffle; n: its rows, if known."""
    return table.coalesce(1) if (table.count() if n is None else n) <= FEW_ROWS else table


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (u, v), rows of stored tables: the smallest node that edges reach.

    Alternating large-star and small-star steps; each step is written to the shared folder, so
    lineage stays short. A node with many edges is one side of a join that adaptive execution splits.
    Steps never add edges, so few edges stay in one partition (`gathered`).
    """
    n = edges.count()
    current = stored(gathered(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), n).distinct(), "edges")
    both_ways = lambda df: df.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
    state = None if n and not current.isEmpty() else ()
    while state != ():
        both = both_ways(gathered(current, n))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least.select("u", F.col("m").alias("v")))
        last, current = current, stored(gathered(small, n).distinct(), "edges")
        now = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        state = () if now == state else now
        forget(last)
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(current.select("v", "v").distinct())
