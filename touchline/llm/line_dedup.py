"""Line dedup by pairwise alignment.

Documents that share rare line hashes or runs of lines are aligned with patience diff, and the
common blocks that line up are deleted from the later document. What crosses these is aligned
again, until nothing lines up any more, so no common block of MIN_WORDS is left in a pair.

What is aligned are runs. A run is the least number of lines from a line on, or up to a line, that have MIN_WORDS together:
every block of MIN_WORDS or more consists of such runs. Every line and every run points to the
document that has it first, so one that n documents hold makes n - 1 candidates, not n * n, and no
block is missed because parts of it stand in other documents before. A line of less than MIN_WORDS
that over RARE texts hold is no evidence by itself; runs are, whatever their number. So short
boilerplate lines start no alignment. Copies of a whole text need no alignment: they count as one
text, and all but the first lose all their lines.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from touchline.llm.util import nested, stored

#: Texts that may hold a line of under MIN_WORDS for it to be rare; words that an aligned block must have to be deleted.
RARE, MIN_WORDS = 100, 20
#: Lines whose runs are computed at once; base of the hash of a run.
LINES_AT_ONCE, BASE = 1 << 17, 0x9E3779B97F4A7C15
_WORD = r"[^\x20\x09-\x0D]+"


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, given by rising first number, whose second numbers rise."""
    ends: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, j) in enumerate(pairs):
        k = bisect_left(ends, j)
        back.append(at[k - 1] if k else -1)
        ends[k : k + 1] = [j]
        at[k : k + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places of equal elements in order: common ends first, then elements unique in both, then between these."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: j for j, x in enumerate(b[b0:b1], b0) if in_b[x] == 1}
        anchors = increasing([(i, place[x]) for i, x in enumerate(a[a0:a1], a0) if in_a[x] == 1 and x in place])
        if anchors:
            found += anchors
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(found)


def runs(lines: np.ndarray, words: np.ndarray, text: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First line, last line and hash of the shortest runs of min_words or more from each line on and up to each line.

    lines: hashes (uint64) of the lines of texts, one after the other; text: the number of the text of each. Runs stay in a text.
    """
    n, at = len(lines), np.arange(len(lines))
    total = np.concatenate(([0], np.cumsum(words, dtype=np.int64)))
    last = np.searchsorted(total, total[:-1] + min_words) - 1
    first = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    on = at[last < n]
    on = on[text[last[on]] == text[on]]
    up = at[first >= 0]
    up = up[text[first[up]] == text[up]]
    start, end = np.concatenate((on, first[up])), np.concatenate((last[on], up))
    power = lambda base: np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(lines * power(BASE)[:n], dtype=np.uint64)))
    return start, end, (sums[end + 1] - sums[start]) * power(pow(BASE, -1, 1 << 64))[start]


def _run_table(lines: list[int], words: list[int], min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last lines and hashes of the runs of one text, in the order of the text."""
    start, end, key = runs(np.array(lines, np.int64).view(np.uint64), np.array(words, np.int64), np.zeros(len(lines), np.int8), min_words)
    order = np.lexsort((end, start))
    return start[order], end[order], key[order]


def aligned_runs(later: list[int], earlier: list[int]) -> set[int]:
    """The runs of `later` that come to lie on runs of `earlier`.

    The runs of both texts are aligned in their order, each where it stands first; then those that
    are left are aligned again, until none lines up. So blocks that crossed others come to lie in an
    alignment of their own. A run that is aligned is so wherever it stands in the later text.
    """
    found: set[int] = set()
    mine, other = list(dict.fromkeys(later)), list(dict.fromkeys(earlier))
    both = set(mine) & set(other)
    mine, other = [x for x in mine if x in both], [x for x in other if x in both]
    while pairs := patience(mine, other):
        on = {mine[i] for i, _ in pairs}
        found |= on
        mine, other = [x for x in mine if x not in on], [x for x in other if x not in on]
    return found


def common_lines(later: list[int], earlier: list[int], words: list[int], min_words: int) -> list[int]:
    """Line numbers of `later` in aligned common blocks of lines with min_words or more. 0 stands for a line without words."""
    own = [i for i, x in enumerate(later) if x]
    mine, other = [later[i] for i in own], [x for x in earlier if x]
    size = dict(zip(mine, (words[i] for i in own), strict=True))
    start, end, key = _run_table(mine, [words[i] for i in own], min_words)
    aligned = aligned_runs(key.tolist(), _run_table(other, [size.get(x, 1) for x in other], min_words)[2].tolist())
    edges = np.zeros(len(own) + 1, np.int64)
    on = np.fromiter((k in aligned for k in key.tolist()), bool, len(key))
    np.add.at(edges, start[on], 1)
    np.add.at(edges, end[on] + 1, -1)
    return [own[i] for i in np.flatnonzero(np.cumsum(edges)[:-1]).tolist()]


def _lines(docs: DataFrame) -> DataFrame:
    """id, sub (hash of the text), the hash of each line (0 without a word) and its number of words."""
    text = F.coalesce("text", F.lit(""))
    split = docs.select(F.col("doc_id").alias("id"), F.xxhash64(text).alias("sub"), F.split(text, "\n", -1).alias("lines"))
    count = lambda x: F.regexp_count(x, F.lit(_WORD))
    return split.select("id", "sub", F.transform("lines", lambda x: F.when(x.rlike(_WORD), F.xxhash64(F.trim(x))).otherwise(F.lit(0).cast("long"))).alias("hashes"), F.transform("lines", count).alias("words"))


def _evidence(texts: DataFrame, min_words: int) -> DataFrame:
    """sub, id, key, always: for each text the hashes of its lines of under min_words, and those of its runs (always), each once."""
    schema = StructType([texts.schema["sub"], texts.schema["id"], StructField("key", LongType()), StructField("always", BooleanType())])

    def of_rows(rows: pa.RecordBatch) -> pa.RecordBatch:
        flat = lambda c: rows.column(c).flatten().to_numpy(zero_copy_only=False)
        lines, words = flat("hashes").view(np.uint64), flat("words")
        text = np.repeat(np.arange(rows.num_rows), pc.list_value_length(rows.column("hashes")).to_numpy(zero_copy_only=False))
        lines, words, text = lines[lines != 0], words[lines != 0], text[lines != 0]
        start, _, key = runs(lines, words, text, min_words)
        short = words < min_words
        key, row = np.concatenate((key, lines[short])), np.concatenate((text[start], text[short]))
        always = np.arange(len(key)) < len(start)
        order = np.lexsort((always, key, row))
        key, row, always = key[order], row[order], always[order]
        once = np.ones(len(key), bool)
        once[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1]) | (always[1:] != always[:-1])
        at = pa.array(row[once])
        return pa.RecordBatch.from_arrays([rows.column("sub").take(at), rows.column("id").take(at), pa.array(key[once].view(np.int64)), pa.array(always[once])], names=schema.names)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = np.cumsum(pc.list_value_length(b.column("hashes")).to_numpy(zero_copy_only=False)) // LINES_AT_ONCE
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
            for i, j in zip(edges, edges[1:], strict=False):
                if i < j:
                    yield of_rows(b.slice(i, j - i))

    return texts.select("sub", "id", "hashes", "words").mapInArrow(of_batches, schema)


def doomed_lines(docs: DataFrame, rare: int = RARE, min_words: int = MIN_WORDS) -> DataFrame:
    """(sub, first, keep): for texts that lose lines or have copies, the first document and whether each line stays there."""
    lines = stored(_lines(docs), "lines")
    texts = stored(lines.groupBy("sub").agg(F.min(F.struct("id", "hashes", "words")).alias("m"), F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("rows"), F.count("id").alias("ids")).select("sub", F.col("m.id").alias("id"), F.col("m.hashes").alias("hashes"), F.col("m.words").alias("words"), (F.coalesce(F.col("low") < F.col("high"), F.lit(False)) | ((F.col("ids") > 0) & (F.col("ids") < F.col("rows")))).alias("copied")), "texts")
    keys = _evidence(texts, min_words)
    shared = keys.groupBy("key", "always").agg(F.count("*").alias("n"), F.min(F.struct("id", "sub")).alias("holder")).where((F.col("n") > 1) & (F.col("always") | (F.col("n") <= rare)))
    first = stored(shared, "first")  # a table of its own, so that adaptive execution can split a hot key in the join
    pairs = keys.join(first, ["key", "always"]).where(F.col("sub") != F.col("holder.sub")).select(F.col("sub").alias("later"), F.col("holder.sub").alias("earlier")).distinct()
    of_earlier = texts.select(F.col("sub").alias("earlier"), F.col("hashes").alias("before"))
    of_later = texts.select(F.col("sub").alias("later"), "hashes", "words")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(sub, common_lines(own.tolist(), before.tolist(), words.tolist(), min_words)) for sub, own, before, words in zip(b["later"], b["hashes"], b["before"], b["words"], strict=True)]
            yield pd.DataFrame([r for r in rows if r[1]], columns=["sub", "lines"])

    aligned = pairs.join(of_earlier, "earlier").join(of_later, "later").select("later", "hashes", "before", "words").mapInPandas(align, "sub long, lines array<int>")
    lost = aligned.groupBy("sub").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines"))
    marked = texts.join(lost, "sub", "left").where(F.col("lines").isNotNull() | F.col("copied"))

    def to_flags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for n, lines in zip(b["n"], b["lines"], strict=True):
                flags = [True] * n
                for i in [] if lines is None else lines:
                    flags[i] = False
                keep.append(flags)
            yield b.assign(keep=keep)[["sub", "first", "keep"]]

    flags = marked.select("sub", F.col("id").cast("string").alias("first"), F.size("hashes").alias("n"), "lines").mapInPandas(to_flags, "sub long, first string, keep array<boolean>")
    return flags.withColumn("first", F.col("first").cast("long"))


def dedup_lines(docs: DataFrame, rare: int = RARE, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with `text` less its aligned common blocks, and n_lines and n_removed (long).

    Order is by doc_id, null first, then by the hash of the text. A copy of a whole text that has
    min_words words or more loses all lines; a shorter text is left alone. A row that repeats
    doc_id and text is the same document as its twin and gets the same result. Lines without a
    word are never compared; they go when no line with words is left. Null text stays null with no
    lines. Columns named n_lines or n_removed are replaced; an empty table gives an empty table.
    """
    rest = docs.drop("n_lines", "n_removed")
    row = lambda c: F.col(f"row.`{c}`")
    text = F.coalesce(row("text"), F.lit(""))
    joined = nested(rest).withColumn("sub", F.xxhash64(text)).join(doomed_lines(docs, rare, min_words), "sub", "left").withColumn("lines", F.split(text, "\n", -1))
    copy = F.col("keep").isNotNull() & ~row("doc_id").eqNullSafe(F.col("first")) & (F.regexp_count(text, F.lit(_WORD)) >= min_words)
    left = F.filter("lines", lambda x, i: F.get("keep", i))
    left = F.when(copy, F.array().cast("array<string>")).when(F.col("keep").isNull(), F.col("lines")).otherwise(left)
    worded = lambda c: F.size(F.filter(c, lambda x: x.rlike(_WORD))).cast("long")
    done = joined.withColumn("left", left)
    kept = F.when(F.col("keep").isNull(), row("text")).when(F.exists("left", lambda x: x.rlike(_WORD)), F.array_join("left", "\n")).otherwise(F.when(row("text").isNotNull(), F.lit("")))
    return done.select(*(kept.alias("text") if c == "text" else row(c).alias(c) for c in rest.columns), worded("lines").alias("n_lines"), (worded("lines") - worded("left")).alias("n_removed"))
