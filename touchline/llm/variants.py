"""Spelling variants: words that differ by one code point, grouped under the form that is most frequent.

The vocabulary is cut, in its order, into shards of bounded size. Each shard is a compact trie
(sorted edges, a few bytes a node), and the tries are broadcast a few at a time. The words go
through every trie in blocks: the Levenshtein automaton of distance one of each word is intersected
with the trie depth-first, all words of a block at once. A trie that has no word near a block is
left after its first letters. Each shard reports the number of neighbours and the best form of a
word; both are reduced over the shards, and chains of forms are followed by doubling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.util import ascii_lower, forget, stored

RUN = r"[A-Za-z\x{C0}-\x{FF}]+"
#: One in so many runs loses a code point.
DELETE_ONE_IN = 97
MIN_LENGTH, MIN_COUNT = 5, 3
#: Words of one trie, about, tries that are broadcast at once (some 100 MB at most), words of one block of queries.
SHARD_WORDS, SHARDS_AT_ONCE, BLOCK_WORDS = 1 << 17, 8, 1 << 15


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): runs of letters in lower case (A-Z only), some with a code point deleted by the rule, of MIN_LENGTH or more, MIN_COUNT times or more.

    A null text has no runs; a null doc_id stands as '' in the rule.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), 0)).alias("run"))
    low = runs.select("id", F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(ascii_lower(F.col("run"))).alias("w"))
    hashed = low.select("w", F.crc32(F.concat("id", F.lit(":"), "w")).alias("h"))
    at = (F.col("h") % F.length("w")).cast("int")
    cut = F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.length("w")))
    word = F.when(F.col("h") % DELETE_ONE_IN == 0, cut).otherwise(F.col("w"))
    return hashed.select(word.alias("word")).where(F.length("word") >= MIN_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


def sharded(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(shard, word, n): ranges of words of about shard_words, made of several smaller ranges each, so that uneven ones matter little."""
    n = words.count()
    parts = stored(words.repartitionByRange(max(1, -(-4 * n // shard_words)), "word").withColumn("part", F.spark_partition_id()), "variants-parts")
    sizes = parts.groupBy("part").count().orderBy("part").collect()  # a row a shard
    before = np.cumsum([0, *(r["count"] for r in sizes)])
    shard_of = [x for r, at in zip(sizes, before, strict=False) for x in (F.lit(r["part"]), F.lit(int(at) // shard_words))]
    return parts.select((F.create_map(*shard_of)[F.col("part")] if shard_of else F.lit(0)).alias("shard"), "word", "n")


TRIE = "shard int, letters binary, ends binary, words binary, counts binary"


def build_trie(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Trie of sorted words, in breadth-first order: edge e, from a node `key // 256` by a letter `key % 256`, leads to node e + 1. (keys, word that ends at each node or -1)."""
    width = max(map(len, words), default=0)
    grid = np.frombuffer(b"".join(w.ljust(width + 1, b"\0") for w in words), np.uint8).reshape(len(words), width + 1)
    node, keys, count, ends = np.zeros(len(words), np.int64), [], 1, {}
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends_at, ends_word = [], []
    for depth in range(width + 1):
        done = np.nonzero(lengths == depth)[0]
        ends_at.append(node[done])
        ends_word.append(done)
        alive = np.nonzero(lengths > depth)[0]
        if not len(alive):
            break
        key, inverse = np.unique(node[alive] * 256 + grid[alive, depth], return_inverse=True)
        node[alive] = count + inverse
        keys.append(key)
        count += len(key)
    ends = np.full(count, -1, np.int32)
    ends[np.concatenate(ends_at)] = np.concatenate(ends_word)
    return np.concatenate([*keys, np.empty(0, np.int64)]), ends


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("word")
    words = [w.encode("latin-1") for w in rows["word"]]
    keys, ends = build_trie(words)
    return pd.DataFrame([(rows["shard"].iloc[0], keys.tobytes(), ends.tobytes(), b"\n".join(words), rows["n"].to_numpy(np.int64).tobytes())], columns=["shard", "letters", "ends", "words", "counts"])


def near_words(queries: list[bytes], keys: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (query, word of the trie) that differ by exactly one inserted, deleted or replaced byte.

    States are (query, node, place, edits), kept on a stack in groups of equal edits: states with
    an edit only walk on exactly, those without branch. The last group goes first, so groups stay few.
    """
    width = max(map(len, queries), default=0)
    grid = np.frombuffer(b"".join(w.ljust(width + 2, b"\0") for w in queries), np.uint8).reshape(len(queries), width + 2)
    length = np.fromiter(map(len, queries), np.int64, len(queries))
    n_nodes = len(ends)
    first = np.searchsorted(keys, np.arange(n_nodes + 1, dtype=np.int64) * 256)
    letter = (keys % 256).astype(np.uint8)
    mask = np.zeros(n_nodes, np.uint32)  # the letters below a node, by their last five bits
    np.bitwise_or.at(mask, keys // 256, np.uint32(1) << (letter & 31).astype(np.uint32))

    def may_go_on(q, node, at):
        over = at >= length[q]
        bit = np.uint32(1) << (grid[q, at] & 31).astype(np.uint32)
        return np.where(over, ends[node] >= 0, (mask[node] & bit) != 0)

    def step(q, node, at):
        """The states one letter further, where the trie has that letter."""
        key = node * 256 + grid[q, at]
        e = np.searchsorted(keys, key)
        ok = keys[np.minimum(e, len(keys) - 1)] == key
        return q[ok], e[ok] + 1, at[ok] + 1

    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    start = np.arange(len(queries), dtype=np.int64)
    stack = [(False, start, np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64))] if len(keys) else []
    while stack:
        edited, q, node, at = stack.pop()
        if edited:
            over = at >= length[q]
            hit = over & (ends[node] >= 0)
            found.append((q[hit], ends[node[hit]].astype(np.int64)))
            q, node, at = step(q[~over], node[~over], at[~over])
            if len(q):
                stack.append((True, q, node, at))
            continue
        n_below = first[node + 1] - first[node]
        which = np.repeat(np.arange(len(q)), n_below)
        e = np.arange(len(which)) - np.repeat(np.cumsum(n_below) - n_below, n_below) + first[node[which]]
        bq, bat, child = q[which], at[which], e + 1
        inserted = may_go_on(bq, child, bat)
        replaced = (bat < length[bq]) & (letter[e] != grid[bq, bat])
        replaced[replaced] = may_go_on(bq[replaced], child[replaced], bat[replaced] + 1)
        inside = at < length[q]
        dq, dnode, dat = q[inside], node[inside], at[inside] + 1
        deleted = may_go_on(dq, dnode, dat)
        q, node, at = step(dq, dnode, dat - 1)
        if len(q):
            stack.append((False, q, node, at))
        edits = [(bq[inserted], child[inserted], bat[inserted]), (bq[replaced], child[replaced], bat[replaced] + 1), (dq[deleted], dnode[deleted], dat[deleted])]
        stack.append((True, *(np.concatenate(x) for x in zip(*edits, strict=True))))
    pairs = np.unique(np.concatenate([q for q, _ in found]) * n_nodes + np.concatenate([w for _, w in found]))
    return pairs // n_nodes, pairs % n_nodes


NEAR = "word string, n_near long, form string, form_n long"


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block of words and each shard: the words that have neighbours there, how many, and the best of them."""
    for b in batches:
        for row in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
            asked, there, n = row["queries"].split(b"\n"), row["words"].split(b"\n"), np.frombuffer(row["counts"], np.int64)
            q, w = near_words(asked, np.frombuffer(row["letters"], np.int64), np.frombuffer(row["ends"], np.int32))
            order = np.lexsort((w, -n[w], q))  # words are numbered in their order
            q, w = q[order], w[order]
            head, n_near = np.unique(q, return_index=True, return_counts=True)[1:] if len(q) else (q, q)
            text = lambda xs, at: pa.array([xs[i].decode("latin-1") for i in at], pa.string())
            yield pa.RecordBatch.from_arrays([text(asked, q[head]), pa.array(n_near, pa.int64()), text(there, w[head]), pa.array(n[w[head]], pa.int64())], ["word", "n_near", "form", "form_n"])


def _blocks(block_words: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for words in b.column(0).to_pylist():
                own = words.split(b"\n")
                for i in range(0, len(own), block_words):
                    yield pa.RecordBatch.from_arrays([pa.array([b"\n".join(own[i : i + block_words])], pa.binary())], ["queries"])

    return cut


def neighbours(words: DataFrame, shard_words: int = SHARD_WORDS, at_once: int = SHARDS_AT_ONCE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, n_near, form, form_n) of every word with a neighbour: how many it has, and the one of largest n (ties: the smallest)."""
    tries = stored(sharded(words, shard_words).groupBy("shard").applyInPandas(_build, TRIE), "variants-tries")
    shards = sorted(r["shard"] for r in tries.select("shard").collect())
    blocks = stored(tries.select("words").mapInArrow(_blocks(block_words), "queries binary"), "variants-blocks")
    found, n_blocks = words.sparkSession.createDataFrame([], NEAR), blocks.count()
    for i in range(0, len(shards), at_once):
        some = shards[i : i + at_once]
        asked = blocks.withColumn("shard", F.explode(F.array(*(F.lit(s) for s in some)))).repartition(max(1, n_blocks * len(some)), "queries", "shard")  # a block and a trie are seconds of work, and few bytes
        met = asked.join(F.broadcast(tries.where(F.col("shard").isin(some))), "shard").select("queries", "letters", "ends", "words", "counts")
        found = found.unionByName(stored(met.mapInArrow(_search, NEAR), "variants-near"))
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form) without cycles: the last word that forms lead to. Each round doubles the length of the way."""
    way = stored(forms.select("word", F.col("form").alias("root")), "variants-way")
    while True:
        on = way.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = way.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        last, way = way, stored(longer, "variants-way")
        forget(last)
        if way.where("moved").isEmpty():
            return way.select("word", "root")
        way = way.select("word", "root")


def group_variants(docs: DataFrame, shard_words: int = SHARD_WORDS, at_once: int = SHARDS_AT_ONCE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    The form of a word is its most frequent neighbour, if it is twice as frequent as the word or
    more; else form and form_n are null. root is where forms lead in the end, the word itself if
    it has none. Repeated rows of `docs` count again; null and empty texts have no words; other
    columns are ignored; an empty table gives no rows.
    """
    words = stored(count_words(docs), "variants-words")
    near = neighbours(words, shard_words, at_once, block_words)
    is_form = F.col("form_n") >= F.col("n") * 2
    formed = stored(
        words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n")), "variants-forms"
    )
    joined = formed.join(roots(formed.where("form is not null")), "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
