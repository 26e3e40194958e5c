"""Quality rules with cross-document line frequency.

Lines are normalised and hashed, and the distinct texts that hold a line are counted per host.
Lines over the limit are boilerplate of the host: they are removed from every text but the one
that has them first, and a document that is left with too few of its words is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.util import WORD_GAP, let, nested, stored, words

#: A line that stands in more distinct texts of its host than this is removed.
MAX_TEXTS = 100
#: A document is rejected when less than this part of its words is left.
MIN_LEFT = 0.5
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
SYMBOLS = "[#*$%&|<>]"
_WORD = r"[^\x20\x09-\x0D]+"


def normal_line(line: Column) -> Column:
    """Lower case, digit runs as 0, white space runs as one space: what counts as the same line."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), WORD_GAP, " "))


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(_WORD))


def repeated_words(w: Column) -> Column:
    """Words that stand in a 3-word window found twice or more, the first time included.

    Each window becomes one long: high bits of its hash, and its place in as many low bits as the
    text needs. Sorted, equal windows are neighbours, so the work is n log n and stays in the row.
    Windows whose cut hashes are equal are compared by their words.
    """
    right = lambda x, bits: F.call_function("shiftright", x, bits)
    cut = lambda x, bits: F.call_function("shiftleft", right(x, bits), bits)

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, j: F.least(F.lit(3).cast("long"), F.coalesce(F.get(places, j + 1) - p, F.lit(3).cast("long"))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda n, x: n + x)

    def found_twice(s: Column, bits: Column) -> Column:
        same = lambda v, j: F.coalesce(right(F.get(s, j), bits) == right(v, bits), F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda v, j: same(v, j - 1) | same(v, j + 1)), lambda v: v - cut(v, bits)))

    def same_words(w: Column, places: Column) -> Column:
        at = lambda p, k: F.get(w, p.cast("int") + k)
        read = F.sort_array(F.transform(places, lambda p: F.struct(F.concat_ws(" ", at(p, 0), at(p, 1), at(p, 2)).alias("gram"), p.alias("place"))))
        same = lambda s, v, j: F.coalesce(F.get(s, j)["gram"] == v["gram"], F.lit(False))
        return let(read, lambda s: F.sort_array(F.transform(F.filter(s, lambda v, j: same(s, v, j - 1) | same(s, v, j + 1)), lambda v: v["place"])))

    def of(w: Column) -> Column:
        bits = F.length(F.bin(F.size(w)))
        codes = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, F.size(w) - 2)
        packed = lambda b: F.sort_array(F.transform(codes, lambda h, i: cut(h, b) + i.cast("long")))
        return let(bits, lambda b: let(packed(b), lambda s: let(found_twice(s, b), lambda p: let(same_words(w, p), covered))))

    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(let(w, of))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda n, x: n + x)


def measures(docs: DataFrame, host_col: str) -> DataFrame:
    """One row per document: its counts, the hashes of its normalised lines and their numbers of words."""
    text = F.coalesce("text", F.lit(""))
    read = docs.select("doc_id", F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), text.alias("text"))
    split = read.select("doc_id", "host", "text", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"), lines_with_words(F.col("text")).alias("lines"))
    return split.select(
        "doc_id",
        "host",
        "text_hash",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        F.transform("lines", lambda x: F.xxhash64(normal_line(x))).alias("line_hashes"),
        F.transform("lines", lambda x: F.size(words(x))).alias("line_words"),
    )


def frequent_lines(measured: DataFrame, max_texts: int) -> DataFrame:
    """(host, text_hash, removed): for each text, the hashes of its lines that are over the limit in its host."""
    lines = measured.select("host", "text_hash", "doc_id", F.explode(F.array_distinct("line_hashes")).alias("line")).groupBy("host", "line", "text_hash").agg(F.min("doc_id").alias("first"))
    over = lines.groupBy("host", "line").agg(F.count("*").alias("n_texts"), F.min(F.struct("first", "text_hash")).alias("holder")).where(F.col("n_texts") > max_texts)
    return lines.join(over, ["host", "line"]).where(F.col("text_hash") != F.col("holder.text_hash")).groupBy("host", "text_hash").agg(F.collect_list("line").alias("removed"))


def judge(docs: DataFrame, host_col: str = "source", max_texts: int = MAX_TEXTS, min_left: float = MIN_LEFT) -> DataFrame:
    """One row per document: doc_id, text_hash, host, counts, left_words, removed, base_failed, kept.

    `docs` has doc_id, text and the host column; other columns are ignored. Null text is empty, a
    null host is the host ''. Copies of a text count once towards the limit and share its verdict;
    repeated rows stay rows of their own. Of the texts that hold a frequent line, the one with the
    smallest doc_id (null first, ties by hash) keeps it, so a group of near copies never vanishes
    whole. An empty table gives no rows.

    Texts are read once and never shuffled; only line hashes are. Counting combines per text
    before it counts per line, so neither a hot host nor a hot line meets in one task.
    """
    measured = stored(measures(docs, host_col), "quality")
    joined = measured.join(frequent_lines(measured, max_texts), ["host", "text_hash"], "left")
    pairs = F.arrays_zip("line_hashes", "line_words")
    lost = F.when(F.col("removed").isNull(), F.lit(0).cast("long")).otherwise(_sum(F.transform(F.filter(pairs, lambda p: F.array_contains("removed", p["line_hashes"])), lambda p: p["line_words"].cast("long"))))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT)
    return joined.select(
        "doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("n_words") - lost).alias("left_words"), "removed", failed.alias("base_failed")
    ).withColumn("kept", ~F.col("base_failed") & (F.col("left_words") >= F.col("n_words") * F.lit(min_left)))


def strip_lines(text: Column, removed: Column) -> Column:
    """text without the lines whose normalised hash is in `removed` (null: nothing is removed)."""
    left = F.filter(F.split(text, "\n", -1), lambda x: ~(x.rlike(_WORD) & F.array_contains(removed, F.xxhash64(normal_line(x)))))
    return F.when(removed.isNull(), text).otherwise(F.array_join(left, "\n"))


def keep_good(docs: DataFrame, host_col: str = "source", max_texts: int = MAX_TEXTS, min_left: float = MIN_LEFT) -> DataFrame:
    """The documents that `judge` keeps, with the columns of the input, without their frequent lines.

    Null and short texts are rejected, so no null text is left. Rows that repeat id, text and host
    stay or go together, also where the id or the host is null. No name of a column clashes with
    those used here; an empty table gives an empty table.
    """
    verdicts = judge(docs, host_col, max_texts, min_left).where("kept").select("doc_id", "text_hash", "host", "removed").groupBy("doc_id", "text_hash", "host").agg(F.first("removed").alias("removed"))
    row = lambda c: F.col(f"row.`{c}`")
    keyed = nested(docs).withColumns({"hash": F.xxhash64(F.coalesce(row("text"), F.lit(""))), "own": F.coalesce(row(host_col).cast("string"), F.lit(""))})
    kept = keyed.join(verdicts, row("doc_id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")) & (F.col("own") == F.col("host")))
    return kept.select(*(strip_lines(row("text"), F.col("removed")).alias("text") if c == "text" else row(c).alias(c) for c in docs.columns))
