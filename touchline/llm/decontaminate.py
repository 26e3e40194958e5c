"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max WAND.

The index holds the test items. Every passage of every training document is a query: windows of
twice the longest item, moved by the longest item, so each occurrence of an item lies whole in
one window. Scores are BM25 over the distinct words of a window, as a part of the item's score
against itself; every item with `threshold` or more is retrieved, then verified on word shingles
of the item, of its question and of its answer. Questions are indexed by themselves as well, so a
passage with the question and no answer is retrieved however long the answer is.

Block-max WAND: the words of an item, heaviest first, that carry `essential` of its own score are its
essential postings. An item can only reach the threshold where its essential postings give what the
others cannot (its bound). Each word of a window has a cursor on its postings. With cursors in the
order of items, the pivot is the first item at which the greatest impacts of the words so far reach
the least bound; all items before it are skipped. If the greatest impacts in the pivot's block of
items stay under the block's bound, cursors skip to the end of the block. Else cursors move up to the
pivot, and an item that all its cursors stand on is scored. Nothing above the threshold is missed.
"""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.util import few_rows, fresh, stored

THRESHOLD, ESSENTIAL = 0.6, 0.7
SHINGLE, OVERLAP = 5, 0.8
#: Items in an index; more items are taken in several passes over the documents. Items in a block of postings.
MAX_ITEMS, BLOCK_ITEMS = 20_000, 16
K1, B = 1.2, 0.75
#: More than rounding can change a sum of impacts, which are parts of one.
MARGIN = 1e-9
_WORD = re.compile(r"\w+")
HITS = "doc_id long, text_hash long, item_id long, score double, first_word long, question_overlap double, answer_overlap double"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.casefold())


def question_and_answer(text: str) -> tuple[str, str]:
    """The answer is the last line with a word, or else the last sentence, or else the last third of the words."""
    for parts in ([x for x in text.split("\n") if _WORD.search(x)], [x for x in re.split(r"(?<=[.!?])\s+", text) if _WORD.search(x)]):
        if len(parts) > 1:
            return " ".join(parts[:-1]), parts[-1]
    w = text.split()
    cut = max(1, 2 * len(w) // 3)
    return " ".join(w[:cut]), " ".join(w[cut:])


def shingles(w: list[str], n: int = SHINGLE) -> set[tuple[str, ...]]:
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


class Statistics(NamedTuple):
    """Of all items: those with a word, their words together, the words of the longest, and how many items have each word."""

    n: int
    words: int
    longest: int
    df: dict[str, int]


class Postings:
    """Inverted index of texts, given as counts of their words, under the statistics of all items."""

    def __init__(self, tfs: list[Counter], stats: Statistics, threshold: float, essential: float):
        self.threshold = threshold
        n, df, mean = stats.n, stats.df, stats.words / max(stats.n, 1)
        idf = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for tf in tfs for t in tf}
        self.impact: dict[str, dict[int, float]] = defaultdict(dict)
        self.essential: dict[str, list[int]] = defaultdict(list)
        self.bound: list[float] = []
        for i, tf in enumerate(tfs):
            size = sum(tf.values())
            own = {t: idf[t] * k * (K1 + 1) / (k + K1 * (1 - B + B * size / mean)) for t, k in tf.items()}
            total, carried = sum(own.values()), 0.0
            for t, x in sorted(own.items(), key=lambda y: (-y[1], y[0])):
                self.impact[t][i] = x / total
                if carried < essential:
                    self.essential[t].append(i)
                    carried += x / total
            self.bound.append(threshold - (1 - carried) - 1e-9)
        #: word -> greatest impact; word -> greatest impact in each block of texts that has it
        self.most = {t: max(self.impact[t][i] for i in own) for t, own in self.essential.items()}
        self.blocks: dict[str, dict[int, float]] = {}
        for t, own in self.essential.items():
            most = self.blocks[t] = {}
            for i in own:
                most[i // BLOCK_ITEMS] = max(most.get(i // BLOCK_ITEMS, 0.0), self.impact[t][i])
        self.block_bound = [min(self.bound[b : b + BLOCK_ITEMS]) for b in range(0, len(self.bound), BLOCK_ITEMS)]
        self.least = min(self.bound, default=math.inf)

    def score(self, i: int, window: set[str]) -> float:
        return math.fsum(self.impact[t].get(i, 0.0) for t in window if t in self.impact)

    def retrieve(self, window: set[str], hits: list[str]) -> list[tuple[int, float]]:
        """All texts that score the threshold or more, by block-max WAND; hits: those words of the window that have essential postings.

        Bounds are compared with plain sums and a margin, so that rounding skips nothing; scores are exact sums.
        """
        most, least, blocks, impact = self.most, self.least - MARGIN, self.blocks, self.impact
        if sum(map(most.__getitem__, hits)) < least:
            return []
        cursors = sorted((self.essential[t][0], t, 0) for t in hits)
        found = []
        while cursors:
            total, n, pivot = 0.0, 0, -1
            for i, t, _ in cursors:
                if total >= least and i > pivot:
                    break
                total += most[t]
                n, pivot = n + 1, i
            if total < least:
                break
            block, ahead, these = pivot // BLOCK_ITEMS, cursors[n:], cursors[:n]
            in_block = 0.0
            for _, t, _ in these:
                in_block += blocks[t].get(block, 0.0)
            if in_block < self.block_bound[block] - MARGIN:
                to = min((block + 1) * BLOCK_ITEMS, ahead[0][0] if ahead else math.inf)
            elif cursors[0][0] == pivot:
                at_pivot = 0.0
                for _, t, _ in these:
                    at_pivot += impact[t][pivot]
                if at_pivot >= self.bound[pivot] - MARGIN and (score := self.score(pivot, window)) >= self.threshold:
                    found.append((pivot, score))
                to = pivot + 1
            else:
                to = pivot
            for i, t, k in these:
                own = self.essential[t]
                k = k if i >= to else bisect_left(own, to, k)
                if k < len(own):
                    ahead.append((own[k], t, k))
            ahead.sort()
            cursors = ahead
        return found


class Index(Postings):
    """Inverted index of items, (item_id, text), and one of their questions of SHINGLE words or more.

    stats: of all items, where these are a part of them.
    """

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, essential: float = ESSENTIAL, stats: Statistics | None = None):
        self.ids, self.parts, tfs = [], [], []
        #: The item of each question, and the words of it.
        self.asks: list[int] = []
        asked: list[Counter] = []
        for item_id, text in items:
            if w := words_of(text or ""):
                q, a = (words_of(x) for x in question_and_answer(text))
                if len(q) >= SHINGLE:
                    self.asks.append(len(self.ids))
                    asked.append(Counter(q))
                self.ids.append(item_id)
                whole, question = shingles(w), shingles(q)
                self.parts.append((whole, question, set(a), len(q) >= SHINGLE, {len(x) for s in (whole, question) for x in s}))
                tfs.append(Counter(w))
        if stats is None:
            sizes = [sum(t.values()) for t in tfs]
            stats = Statistics(len(tfs), sum(sizes), max(sizes, default=1), Counter(t for tf in tfs for t in tf))
        self.stride = stats.longest
        super().__init__(tfs, stats, threshold, essential)
        self.questions = Postings(asked, stats, threshold, essential)
        self.words = frozenset(self.essential) | frozenset(self.questions.essential)

    def candidates(self, window: set[str], hits: set[str]) -> list[int]:
        """Items that are retrieved whole or by their question."""
        whole = self.retrieve(window, [t for t in hits if t in self.essential])
        return sorted({i for i, _ in whole} | {self.asks[j] for j, _ in self.questions.retrieve(window, [t for t in hits if t in self.questions.essential])})

    def matches(self, text: str) -> list[tuple[int, float, int, float, float]]:
        """(item_id, score, first word of the passage, question overlap, answer overlap) of all verified items, the best passage of each."""
        w, words, stride = words_of(text), self.words, self.stride
        blocks = [{x for x in w[i : i + stride] if x in words} for i in range(0, len(w), stride)]
        seen = {k: own | after for k, (own, after) in enumerate(zip(blocks, [*blocks[1:], set()], strict=True)) if own or after} if blocks else {}
        best: dict[int, tuple] = {}
        for k, hits in seen.items():
            first = k * self.stride
            passage = w[first : first + 2 * self.stride]
            window, made = set(passage), {}
            for i in self.candidates(window, hits):
                whole, question, answer, alone, sizes = self.parts[i]
                made |= {n: shingles(passage, n) for n in sizes if n not in made}  # once a window
                own = set().union(*(made[n] for n in sizes)) if len(sizes) > 1 else made[min(sizes)]
                covered = len(whole & own) / len(whole)
                q = len(question & own) / len(question) if question else 1.0
                a = len(answer & window) / len(answer) if answer else 1.0
                if covered >= OVERLAP or (alone and q >= OVERLAP):
                    best[i] = max(best.get(i, (-1.0,)), (covered, self.score(i, window), -first, q, a))
        return [(self.ids[i], score, -first, q, a) for i, (_, score, first, q, a) in sorted(best.items())]


def _counted(items: DataFrame) -> DataFrame:
    """word, n: how many items have each word; the null word holds the number of items with a word, of their words, and the longest (n, words, longest)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            read = [w for w in (words_of(x or "") for x in b["text"]) if w]
            df = Counter(t for w in read for t in set(w))
            sizes = [len(w) for w in read]
            rows = [(None, len(read), sum(sizes), max(sizes, default=1)), *((t, k, 0, 0) for t, k in df.items())]
            yield pd.DataFrame(rows, columns=["word", "n", "words", "longest"])

    counted = items.select("text").mapInPandas(count, "word string, n long, words long, longest long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.max("longest").alias("longest"))


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, max_items: int = MAX_ITEMS) -> DataFrame:
    """One row per document and test item found in it: doc_id, text_hash, item_id, score, first_word, overlaps.

    An item is found where a passage has OVERLAP of its shingles, or of those of its question. A
    question of under SHINGLE words is no evidence by itself.
    `items` has item_id and text. Null and empty texts hold nothing, on either side; null ids stay;
    repeated rows give repeated results. Other columns are ignored; an empty table gives no rows.
    The items are indexed in blocks of about max_items, each of which passes over all documents;
    documents are neither shuffled nor collected. Statistics are those of all items, so the number
    of passes changes no score and no window.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    passes = max(1, -(-items.count() // max_items))
    found, counted = None, stored(_counted(items), "items") if passes > 1 else None
    for k in range(passes):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text")
        read = [(r[0], r[1]) for r in own.collect()]
        stats = None
        if counted is not None:
            used = spark.createDataFrame([(t,) for t in {t for _, text in read for t in words_of(text or "")}], "word string")
            of_all = counted.where("word is null").first()
            stats = Statistics(of_all["n"], of_all["words"], of_all["longest"], dict(counted.join(used, "word").select("word", "n").collect()))
        sent = spark.sparkContext.broadcast(cloudpickle.dumps(Index(read, threshold, stats=stats)))  # with its classes, which executors may lack

        def search(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            index = pickle.loads(sent.value)
            for b in batches:
                rows = [(d, h, *m) for d, h, text in zip(b["doc_id"], b["text_hash"], b["text"], strict=True) for m in index.matches(text)]
                out = pd.DataFrame(rows, columns=["doc_id", "text_hash", "item_id", "score", "first_word", "question_overlap", "answer_overlap"])
                yield out.astype({"item_id": "Int64"})

        hits = keyed.mapInPandas(search, HITS.replace("doc_id long", "doc_id string", 1)).withColumn("doc_id", F.col("doc_id").cast("long"))
        found = hits if found is None else found.union(hits)
    return found


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no test item, columns as in the input.

    Null and empty texts hold none and stay; rows that repeat an id and a text stay or go together,
    also where the id is null. No name of a column clashes with those used here; an empty table on
    either side drops nothing.
    """
    own_id, own_hash = fresh(docs, "leaked_id"), fresh(docs, "leaked_hash")
    leaked = stored(find_leaks(docs, items).select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)).distinct(), "leaked")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(own_hash))
    return docs.join(few_rows(leaked), same, "left_anti")
