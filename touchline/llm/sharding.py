"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `vnodes` points of a ring of `cells` cells. A row hashes to a cell and belongs
to the shard of the next point clockwise. A shard takes its own rows up to its capacity; what
overflows continues clockwise to the next shard that has room. With capacities that add up to
the number of rows, counts differ by one at most, whatever the hash does.

All rows of a cell meet the same shards in the same order, so the walk needs only the number of
rows in each cell: a table of `cells` counts, fixed by a parameter and not by the data. The walk
yields segments (cell, first rank, shard, first slot); a row finds its segment by its rank in the
cell. Ranking is the only shuffle of rows, and it carries no text.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.util import nested, unnested

_SEGMENTS = "cell int, segments array<struct<last: long, shift: long, shard: int>>"


def ring(shards: int, vnodes: int, cells: int) -> list[tuple[int, int]]:
    """(cell, shard) of every point, clockwise. A point depends on its shard and number alone."""
    at = lambda s, v: int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big") % cells
    return sorted((at(s, v), s) for s in range(shards) for v in range(vnodes))


def capacities(total: int, demand: list[int], slack: float | None) -> list[int]:
    """Rows that each shard takes at most. slack None: counts at most one apart, the spare rows where demand is highest."""
    n = len(demand)
    if slack is not None:
        return [int(-(-total * (1 + slack) // n))] * n
    spare = set(sorted(range(n), key=lambda s: (-demand[s], s))[: total % n])
    return [total // n + (s in spare) for s in range(n)]


def walk(counts: dict[int, int], shards: int, vnodes: int, cells: int, slack: float | None) -> dict[int, list[tuple[int, int]]]:
    """For every cell, how many rows go to which shard, in the order of their rank."""
    points = ring(shards, vnodes, cells)
    owner: dict[int, int] = {}
    p = 0
    for c in range(cells):
        while p < len(points) and points[p][0] < c:
            p += 1
        owner[c] = p % len(points)
    demand = [0] * shards
    for c, n in counts.items():
        demand[points[owner[c]][1]] += n
    room = capacities(sum(counts.values()), demand, slack)
    placed: dict[int, list[tuple[int, int]]] = defaultdict(list)
    waiting: dict[int, list[list[int]]] = defaultdict(list)
    for c in sorted(counts):
        s = points[owner[c]][1]
        if took := min(room[s], counts[c]):
            room[s] -= took
            placed[c].append((s, took))
        if counts[c] > took:
            waiting[owner[c]].append([c, counts[c] - took])
    carried: list[list[int]] = []
    for lap in range(2 * len(points)):  # overflow continues clockwise; everything has found room after a lap
        p = lap % len(points)
        s = points[p][1]
        while carried and room[s]:
            c, n = carried[0]
            took = min(room[s], n)
            room[s] -= took
            placed[c].append((s, took))
            if took == n:
                carried.pop(0)
            else:
                carried[0][1] -= took
        carried += waiting.pop(p, [])
        if not carried and not waiting:
            break
    return placed


def shard_rows(df: DataFrame, keys: list[str], shards: int, vnodes: int = 128, cells: int = 1 << 14, slack: float | None = None) -> DataFrame:
    """Adds shard (int) and slot (long, gapless from 0 in each shard) to every row.

    The ring key is the hash of `keys`; nulls are allowed and hash like a value. Rows that agree
    in all keys are interchangeable and lie in one cell. slack None balances counts to within one;
    slack 0.1 lets a shard take 10 % over the mean and moves fewer rows when shards are added.
    An empty table gives an empty table; columns named shard and slot are replaced.
    Pass keys that differ between rows, and no wide columns, as all columns are shuffled.
    """
    spark = df.sparkSession
    rest = df.drop("shard", "slot")
    own = [F.col(f"row.`{k}`") for k in keys]
    hashed = nested(rest).withColumn("h", F.xxhash64(*own)).withColumn("cell", F.pmod("h", F.lit(cells)).cast("int"))
    counts = {r["cell"]: r["count"] for r in hashed.groupBy("cell").count().collect()}  # at most `cells` rows
    filled: dict[int, int] = defaultdict(int)
    table = []
    placed = walk(counts, shards, vnodes, cells, slack)
    for c in sorted(placed):
        rank, segments = 0, []
        for s, n in placed[c]:
            segments.append((rank + n, filled[s] - rank, s))
            rank += n
            filled[s] += n
        table.append((c, segments))
    ranked = hashed.withColumn("rank", (F.row_number().over(Window.partitionBy("cell").orderBy("h", *own)) - 1).cast("long"))
    segments = spark.createDataFrame(table, _SEGMENTS)  # bounded by cells + points
    found = ranked.join(F.broadcast(segments), "cell").withColumn("segment", F.filter("segments", lambda s: F.col("rank") < s["last"])[0])
    return found.select(*unnested(rest.columns), F.col("segment.shard").alias("shard"), (F.col("rank") + F.col("segment.shift")).alias("slot"))
