"""Best-fit packing with Martello-Toth dominance reduction.

Documents are tokenised and cut into pieces of at most `capacity` tokens; pieces are packed into
as few sequences of that capacity as possible. What decides the packing is only how many pieces
there are of each length, so the plan is made on that histogram (at most `capacity` counts):

1. Reduction. Longest pieces first, a set of one to three pieces is fixed as a full sequence when
   it dominates every other feasible set with its longest piece, that is, whatever else could
   stand there fits into the places that the set fills. The instance shrinks, its optimum stays.
2. Best fit, by decreasing length, for the remainder: a piece goes where it leaves the least room.

Both act on runs of equal pieces and equal sequences at once. The plan is a list of segments
(length, rank, ...) whose number is bounded by the capacity; a piece finds its place by its rank
among the pieces of its length, which Spark computes in salted windows.
"""

from __future__ import annotations

import json
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.util import stored

CAPACITY, END_ID = 4096, 1
#: Words whose ids a task remembers at once.
CACHED_WORDS = 500_000
#: Pieces of one length that a task ranks; lengths with more are split.
RANKED_AT_ONCE = 1 << 20
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds(dict):
    """Ids of a word as little-endian bytes, for tokenizers that drop white space and lower-case letters.

    Blanks and line ends separate words of such a tokenizer, so a text's ids are those of its
    words in turn. A run of letters is one unit of it and can go to the model at once; whatever
    else a word holds goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (told["normalizer"] or {}).get("normalizers", [])], [x["type"] for x in (told["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if steps != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]):
            raise ValueError(f"{path} is no tokenizer whose words can be told by white space")
        self.model = self.tokenizer.model.tokenize
        self.as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str

    def __missing__(self, word: str) -> bytes:
        if len(self) > CACHED_WORDS:
            self.clear()
        plain = word and max(word) < "\u0100"  # characters that NFC leaves alone, and whose lower case is one character
        if plain and word.isalpha():
            low = word.lower()
            ids = [t.id for t in self.model(low if word.isascii() else self.as_bytes(low)[0][0])]
        elif plain and word[-1] in ".," and word[:-1].isalpha():
            return self.setdefault(word, self[word[:-1]] + self[word[-1]])
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return self.setdefault(word, array("I", ids).tobytes())

    def of_text(self, text: str) -> bytes:
        return b"".join([self[w] for w in text.replace("\n", " ").split(" ")])


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and ids (binary, little-endian) if asked for."""
    columns = _PIECES.replace(", ", ",").split(",")
    names = [c.split(" ")[0] for c in columns] + ["ids"] * with_ids
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = WordIds(tokenizer_path)
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"].array, b["text"].array, strict=True):
                ids = (ids_of.of_text(text) if text else b"") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own), *([own] if with_ids else [])))
            out = pd.DataFrame(rows, columns=names)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(cut, _PIECES + ", ids binary" * with_ids)


class Plan:
    """Where the pieces of each length go. segments: (length, rank, count, sequence, per sequence, offset)."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        self.left = {n: k for n, k in histogram.items() if k > 0}
        self.lengths = sorted(self.left)
        self.rank: dict[int, int] = defaultdict(int)
        self.sequences = self.fixed = 0
        self.segments: list[tuple[int, int, int, int, int, int]] = []
        self.reduce()
        self.fixed = self.sequences
        self.best_fit()

    def take(self, length: int, count: int, sequence: int, per_sequence: int, offset: int) -> None:
        self.segments.append((length, self.rank[length], count, sequence, per_sequence, offset))
        self.rank[length] += count
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]
            self.lengths.remove(length)

    def smallest(self, count: int, without: int) -> list[int]:
        """The lengths of the `count` smallest pieces, one piece of length `without` aside."""
        found: list[int] = []
        for n in self.lengths:
            found += [n] * min(self.left[n] - (n == without), count - len(found))
            if len(found) == count:
                break
        return found

    def largest_up_to(self, most: int, used: list[int]) -> int:
        """The largest length up to `most` of which pieces are left beside those used, or 0."""
        i = bisect_right(self.lengths, most) - 1
        while i >= 0 and self.left[n := self.lengths[i]] <= used.count(n):
            i -= 1
        return self.lengths[i] if i >= 0 else 0

    def dominating(self, j: int) -> list[int] | None:
        """A set of at most three pieces that holds one of length j and dominates all sets that do; None if none is found."""
        rest = self.capacity - j
        k = self.largest_up_to(rest, [j])
        if not k:
            return [j]
        small = self.smallest(3, j)
        if k == rest or len(small) < 2 or small[0] + small[1] > rest:
            return [j, k]  # all else beside j is one piece of at most k, or fits into k together
        if len(small) == 3 and sum(small) <= rest:
            return None
        b = self.largest_up_to(rest - k, [j, k])
        if not b:
            return None
        # at most two more pieces fit; {j, k, b} dominates unless both of some pair are over b
        over, i = [], bisect_right(self.lengths, b)
        while i < len(self.lengths) and len(over) < 2:
            n = self.lengths[i]
            over += [n] * min(2 - len(over), self.left[n] - (n == j))
            i += 1
        return [j, k, b] if len(over) < 2 or sum(over) > rest else None

    def reduce(self) -> None:
        changed = True
        while changed:
            changed = False
            for j in reversed(list(self.lengths)):
                while j in self.left and (found := self.dominating(j)):
                    times = min(self.left[n] // found.count(n) for n in set(found))
                    offset = 0
                    for n in sorted(set(found), reverse=True):
                        self.take(n, times * found.count(n), self.sequences, found.count(n), offset)
                        offset += n * found.count(n)
                    self.sequences += times
                    changed = True

    def best_fit(self) -> None:
        room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: runs of sequences
        sizes: list[int] = []

        def add(size: int, first: int, count: int) -> None:
            if count and size:
                if size not in room:
                    insort(sizes, size)
                room[size].append((first, count))

        for n in reversed(list(self.lengths)):
            while n in self.left:
                i = bisect_left(sizes, n)
                if i == len(sizes):
                    fit = self.capacity // n
                    add(self.capacity, self.sequences, new := -(-self.left[n] // fit))
                    self.sequences += new
                    continue
                size = sizes[i]
                first, count = room[size].pop()
                if not room[size]:
                    del room[size], sizes[i]
                fit, left = size // n, self.left[n]
                full = min(count, left // fit)
                if full:
                    self.take(n, full * fit, first, fit, self.capacity - size)
                    add(size - fit * n, first, full)
                if full < count and full * fit < left:
                    some = left - full * fit if full == left // fit else 0
                    if some:
                        self.take(n, some, first + full, some, self.capacity - size)
                        add(size - some * n, first + full, 1)
                        full += 1
                add(size, first + full, count - full)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Null and empty texts are documents of the end id alone. Repeated rows are documents of their
    own; null doc_ids stay. Other columns are ignored. An empty table gives no rows.

    Pieces are written to the shared folder, so texts are tokenised once. Ranks use windows over
    (length, salt), with so many salts that about RANKED_AT_ONCE pieces share one; what is broadcast
    has a row for each length, and one more for each RANKED_AT_ONCE pieces.
    """
    spark = docs.sparkSession
    order = ["doc_id", "piece", "ids_crc32"]
    pieces = stored(pieces_of(docs, tokenizer_path, capacity, end_id, with_ids), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = Plan(histogram, capacity)
    salts = spark.createDataFrame([(n, -(-k // RANKED_AT_ONCE)) for n, k in histogram.items()], "length long, salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64(*order), F.col("salts")))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = salted.join(F.broadcast(before), ["length", "salt"]).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order)) - 1)

    table = np.array(sorted(plan.segments), np.int64).reshape(-1, 6)
    keys = (table[:, 0] << 44) + table[:, 1]  # up to 2**44 pieces of a length
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            length, rank = b["length"].to_numpy(np.int64), b["rank"].to_numpy(np.int64)
            s = table[np.searchsorted(keys, (length << 44) + rank, "right") - 1]
            nth = rank - s[:, 1]
            out = b.assign(sequence_id=s[:, 3] + nth // s[:, 4], offset=s[:, 5] + nth % s[:, 4] * length)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out[names]

    kept = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank", *["ids"] * with_ids)
    return kept.mapInPandas(place, _PIECES + ", sequence_id long, offset long" + ", ids binary" * with_ids) if histogram else spark.createDataFrame([], _PIECES + ", sequence_id long, offset long" + ", ids binary" * with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences (input with ids): sequence_id, doc_ids, ids as little-endian bytes. A sequence is at most `capacity` tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.col("p.doc_id").alias("doc_ids"), F.aggregate("p", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
