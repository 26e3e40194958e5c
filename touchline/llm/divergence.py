"""Divergence of sources: how the terms of one source of a language differ from those of the others.

Terms are dealt to shards by a hash of language and term, and DuckDB does the work inside a shard
in vectorised SQL: first it counts the terms of each batch of texts, then it adds the counts of a
shard and keeps the terms of enough documents, and in a second pass it makes partial sums for all
pairs of sources and the best terms of the shard. Spark merges sums and rankings.

A pair's sum over all V terms needs only the terms that both sources have, and for each source
the number of its terms with every count: with f11, f10, f01, f00 for a term in both, in the first,
in the second, in none, it is the sum of f11 - f10 - f01 + f00 over the terms of both, plus the
sums of f10 and f01 over the terms of either, plus (V - terms of the first - terms of the second) * f00.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.util import UPPER, forget, stored

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS, TOP_TERMS, ONE = 10, 10, 1_000_000_000
#: Bytes of text for one shard, whose counts of terms are far smaller, and shards of a small input.
SHARD_BYTES, LEAST_SHARDS = 16 << 20, 64
#: Bytes of text that are counted at once, and whose counts a task holds before it hands them on; rows of a batch.
SLICE_BYTES, HELD_BYTES, MAX_ROWS = 2 << 20, 64 << 20, 1 << 16


def _duck():
    import duckdb

    return duckdb.connect(config={"threads": 1, "temp_directory": "", "preserve_insertion_order": False})


def _slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about so many bytes of text; a longer text is a run of its own."""
    end = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)) // size
    edges = [0, *(np.nonzero(np.diff(end))[0] + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def _count_batches(n_shards: int):
    read = f"""
        WITH d AS (SELECT lang, source, row_number() OVER () AS doc, text FROM batch),
        t AS (SELECT lang, source, doc, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '{TERM}')) AS term FROM d),
        p AS (SELECT lang, source, doc, term, count(*) AS n FROM t GROUP BY ALL)
        INSERT INTO counted SELECT lang, source, term, sum(n)::BIGINT, count(*) FROM p GROUP BY ALL
    """
    dealt = f"SELECT (hash(lang, term) % {n_shards})::INTEGER AS shard, lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM counted GROUP BY ALL"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duck()
        con.execute("CREATE TABLE counted (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
        held = 0
        for batch in (x for b in batches for x in _slices(b, SLICE_BYTES)):
            con.register("batch", pa.Table.from_batches([batch]))
            con.execute(read)
            con.unregister("batch")
            held += pc.sum(pc.binary_length(batch.column("text"))).as_py()
            if held >= HELD_BYTES:
                yield from con.sql(dealt).to_arrow_table().to_batches(MAX_ROWS)
                con.execute("TRUNCATE counted")
                held = 0
        yield from con.sql(dealt).to_arrow_table().to_batches(MAX_ROWS)
        con.close()

    return count


def _add_counts(min_docs: int):
    sql = f"""
        WITH s AS (SELECT shard, lang, source, term, sum(n)::BIGINT AS n, sum(docs) AS docs FROM counted GROUP BY ALL),
        k AS (SELECT lang, term, min(source) AS first FROM s GROUP BY ALL HAVING sum(docs) >= {min_docs})
        SELECT shard, lang, source, term, n, (source = first)::BIGINT AS new FROM s JOIN k USING (lang, term)
    """

    def add(counted: pa.Table) -> pa.Table:
        con = _duck()
        con.register("counted", counted)
        out = con.sql(sql).to_arrow_table()
        con.close()
        return out

    return add


_F = "((p - q) * (p - q)) // (p + q)"
PARTIAL = "part string, lang string, source string, item string, value long"


def _shard_sums(top_terms: int):
    share = lambda n, tot: f"(1 + ({ONE} * ({n} + 2)::HUGEINT) // {tot})::BIGINT"
    f = lambda p, q: _F.replace("p", f"({p})").replace("q", f"({q})")
    sql = f"""
        WITH e AS (SELECT k.lang, k.source, term, k.n, {share("k.n", "tot")} AS p, none FROM kept k JOIN groups USING (lang, source)),
        shared AS (SELECT a.lang, a.source, b.source AS item, sum({f("a.p", "b.p")} - {f("a.p", "b.none")} - {f("a.none", "b.p")} + {f("a.none", "b.none")}) AS value
                 FROM e a JOIN e b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL),
        h AS (SELECT lang, source, p, count(*) AS m FROM e GROUP BY ALL),
        one AS (SELECT h.lang, least(h.source, g.source) AS source, greatest(h.source, g.source) AS item, sum(m * ({f("h.p", "g.none")})) AS value
                FROM h JOIN groups g ON h.lang = g.lang AND h.source <> g.source GROUP BY ALL),
        l AS (SELECT lang, term, {share("sum(n)", "any_value(lang_tot)")} AS q FROM kept JOIN (SELECT DISTINCT lang, lang_tot FROM groups) USING (lang) GROUP BY lang, term),
        t AS (SELECT lang, source, term AS item, {f("p", "l.q")} AS value FROM e JOIN l USING (lang, term) WHERE p > l.q
              QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {top_terms})
        SELECT 'pair' AS part, lang, source, item, sum(value)::BIGINT AS value FROM (FROM shared UNION ALL FROM one) GROUP BY ALL
        UNION ALL SELECT 'term', lang, source, item, value::BIGINT FROM t
    """

    def sums(kept: pa.Table, groups: pa.Table) -> pa.Table:
        con = _duck()
        con.register("kept", kept)
        con.register("groups", groups)
        out = con.sql(sql).to_arrow_table()
        con.close()
        return out

    return sums


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, source, part, item, value, rank: for every source of a language its divergence from each other one, and its most typical terms.

    Null text, lang and source are ''. A row is a document: repeated rows count again. Terms are
    lower-cased in A-Z only; a language keeps those of min_docs of its documents or more. A source
    without terms has its pairs; in a language without kept terms all pairs are 0. Equal values are
    ranked by item, byte by byte. Other columns are ignored; an empty table gives no rows.

    Shards grow in number with the text, not in size. One term of a shard has at most one row a
    source and batch, so a hot language or term does not meet in one task. Pairs of sources are rows
    of the result; within a shard they are made for the sources that share a term, and summed there.
    """
    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    size = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = max(LEAST_SHARDS, -(-size // shard_bytes))
    counted = stored(read.mapInArrow(_count_batches(n_shards), "shard int, lang string, source string, term string, n long, docs long"), "divergence-counts")
    kept = stored(counted.groupBy("shard").applyInArrow(_add_counts(min_docs), "shard int, lang string, source string, term string, n long, new long"), "divergence-kept")
    forget(counted)

    terms = kept.groupBy("lang").agg(F.sum("new").alias("v"), F.sum("n").alias("lang_n"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n"), F.count("*").alias("own_terms"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    sums = read.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(terms, "lang", "left").select("lang", "source", *(zero(c) for c in ("own_n", "own_terms", "v", "lang_n")))
    groups = stored(sums.withColumns({"tot": F.col("own_n") + 2 * F.col("v"), "lang_tot": F.col("lang_n") + 2 * F.col("v")}).withColumn("none", F.when(F.col("tot") > 0, F.expr(f"1 + (2 * {ONE}L) div tot"))), "divergence-groups")

    everywhere = groups.where("v > 0").select(F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"), "lang", "source", "tot", "none", "lang_tot")
    partial = stored(kept.groupBy("shard").cogroup(everywhere.groupBy("shard")).applyInArrow(_shard_sums(top_terms), PARTIAL), "divergence-sums")

    a, b = (groups.select("lang", F.col("source").alias(s), F.col("none").alias(f"{s}_none"), F.col("own_terms").alias(f"{s}_terms"), "v") for s in ("source", "item"))
    pair = a.join(b.drop("v"), "lang").where("source < item")
    absent = F.expr("(v - source_terms - item_terms) * ((source_none - item_none) * (source_none - item_none) div (source_none + item_none))")
    summed = partial.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    value = F.coalesce((F.coalesce("value", F.lit(0)) + absent.cast("decimal(38,0)")).cast("long"), F.lit(0).cast("long"))
    half = pair.join(summed, ["lang", "source", "item"], "left").select("lang", "source", "item", value.alias("value"))
    pairs = half.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("s"), "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")
    best = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.unionByName(partial.where("part = 'term'").select(*pairs.columns)).withColumn("rank", F.row_number().over(best))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top_terms))
