"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary labelled texts.

The models are over letters: order four, so that a stem counts in all its endings. Each order is
discounted and interpolated with the next lower one, whose counts are the numbers of different
letters before it (continuation counts), per class; at the bottom both classes share one
distribution over letters, so what neither class knows speaks for none of them.

A text's evidence is the difference of its two log-likelihoods over its length, where LENGTH_PRIOR
letters without evidence are added so that short texts need more. A logistic curve of two
coefficients turns it into a score; it is fitted on labelled rows that the counts do not contain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.util import few_rows, fresh, nested, stored

ORDER, DISCOUNT, LENGTH_PRIOR = 4, 0.75, 500
#: crc32(doc_id) mod 5: 0 is held out, 4 fits the curve, the others are counted.
FOLDS, HELD_OUT, CURVE = 5, 0, 4
#: At most so many labelled rows fit the two coefficients of the curve, those of smallest hash.
CURVE_ROWS = 20_000
#: Entries of the model that are broadcast at most (24 bytes each); beyond, letters are joined with it.
MODEL_ROWS = 2_000_000
#: Letters that are counted or looked up at once, in one text or many.
CHUNK = 1 << 20
GAP = r"[\W\d_]+"


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS


def letters(text: str | None) -> np.ndarray:
    """Code points of the text's words in lower case, a space before, between and after; letters beyond 16 bits are one letter."""
    import re

    words = re.sub(GAP, " ", (text or "").lower()).strip()
    if not words:
        return np.empty(0, np.uint64)
    return np.minimum(np.frombuffer(f" {words} ".encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF).astype(np.uint64)


def chunks(texts: Iterator[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grams, numbers of their texts): a gram is four letters in 16 bits each, the last lowest; texts start after three spaces."""
    pad = np.full(ORDER - 1, 32, np.uint64)
    held, owners, size = [], [], 0
    for i, t in enumerate(texts):
        x = np.concatenate([pad, letters(t)])
        grams = sum(x[k : len(x) - ORDER + 1 + k] << np.uint64(16 * (ORDER - 1 - k)) for k in range(ORDER))
        for at in range(0, len(grams), CHUNK):
            held.append(grams[at : at + CHUNK])
            owners.append(np.full(len(held[-1]), i))
            size += len(held[-1])
            if size >= CHUNK:
                yield np.concatenate(held), np.concatenate(owners)
                held, owners, size = [], [], 0
    if held:
        yield np.concatenate(held), np.concatenate(owners)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for toxic in (0, 1):
            for grams, _ in chunks(b["text"][b["toxic"] == toxic]):
                gram, n = np.unique(grams, return_counts=True)
                yield pd.DataFrame({"gram": gram.astype(np.int64), "n0": n * (1 - toxic), "n1": n * toxic})


def count_grams(labelled: DataFrame) -> DataFrame:
    """(gram, n0, n1): how often ordinary and toxic texts have each four letters; labelled has text and toxic."""
    counted = labelled.select("text", "toxic").mapInPandas(_count, "gram long, n0 long, n1 long")
    return counted.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def fit(grams: DataFrame) -> DataFrame:
    """The model of count_grams as rows (k, key, lp0, lp1, next0, next1).

    lp: log probability of the last of k letters after the others, where the key was seen. next:
    log weight of the next lower order after these k letters, 0 where they never preceded a letter.
    k = 0 has one row: the probability of a letter that was never seen.
    """
    low = lambda c, k: F.col(c).bitwiseAND((1 << (16 * k)) - 1) if k < 4 else F.col(c)
    before = lambda c: F.call_function("shiftrightunsigned", F.col(c), F.lit(16))
    tables = {ORDER: grams}
    for k in range(ORDER - 1, 0, -1):
        seen = lambda n: F.sum((F.col(n) > 0).cast("long")).alias(n)
        tables[k] = stored(tables[k + 1].groupBy(low("gram", k).alias("gram")).agg(seen("n0"), seen("n1")), "toxicity-grams")

    total, size = tables[1].agg(F.sum(F.col("n0") + F.col("n1")), F.count("*")).first()
    unseen = 1.0 / ((total or 0) + size + 1)
    probable = tables[1].select("gram", *(((F.col("n0") + F.col("n1") + 1) * F.lit(unseen)).alias(f"p{c}") for c in (0, 1)))
    out, contexts = [(1, probable)], []
    for k in range(2, ORDER + 1):
        sums = [x for c in (0, 1) for x in (F.sum(f"n{c}").alias(f"s{c}"), F.sum((F.col(f"n{c}") > 0).cast("long")).alias(f"t{c}"))]
        weight = lambda c: F.when(F.col(f"s{c}") > 0, DISCOUNT * F.col(f"t{c}") / F.col(f"s{c}")).otherwise(1.0).alias(f"w{c}")
        context = tables[k].groupBy(before("gram").alias("context")).agg(*sums).select("context", "s0", "s1", weight(0), weight(1))
        lower = out[-1][1].select(F.col("gram").alias("lower"), F.col("p0").alias("q0"), F.col("p1").alias("q1"))
        keyed = tables[k].select("gram", before("gram").alias("context"), low("gram", k - 1).alias("lower"), "n0", "n1")
        p = lambda c: (F.when(F.col(f"s{c}") > 0, F.greatest(F.col(f"n{c}") - DISCOUNT, F.lit(0.0)) / F.col(f"s{c}")).otherwise(0.0) + F.col(f"w{c}") * F.col(f"q{c}")).alias(f"p{c}")
        out.append((k, stored(keyed.join(context, "context").join(lower, "lower").select("gram", p(0), p(1)), "toxicity-probable")))
        contexts.append((k - 1, context.select(F.col("context").alias("gram"), "w0", "w1")))
    spark, none = grams.sparkSession, F.lit(None).cast("double")
    model = spark.createDataFrame([(0, 0, float(np.log(unseen)), float(np.log(unseen)), None, None)], "k int, key long, lp0 double, lp1 double, next0 double, next1 double")
    for k, p in out:
        model = model.unionByName(p.select(F.lit(k).alias("k"), F.col("gram").alias("key"), F.log("p0").alias("lp0"), F.log("p1").alias("lp1"), none.alias("next0"), none.alias("next1")))
    for k, w in contexts:
        model = model.unionByName(w.select(F.lit(k).alias("k"), F.col("gram").alias("key"), none.alias("lp0"), none.alias("lp1"), F.log("w0").alias("next0"), F.log("w1").alias("next1")))
    return stored(model, "toxicity-model")


def arrays(rows: pd.DataFrame) -> tuple:
    """The rows of `fit` for `Model`: plain arrays, which a broadcast can hold without this package."""

    def table(k, a, b):
        own = rows[(rows["k"] == k) & rows[a].notna()]
        keys = own["key"].to_numpy(np.int64).astype(np.uint64)
        order = np.argsort(keys)
        return keys[order], own[[a, b]].to_numpy(float)[order]

    return rows[rows["k"] == 0][["lp0", "lp1"]].to_numpy(float)[0], {k: table(k, "lp0", "lp1") for k in range(1, ORDER + 1)}, {k: table(k, "next0", "next1") for k in range(1, ORDER)}


class Model:
    """Looks up many grams at once in sorted arrays."""

    def __init__(self, unseen: np.ndarray, known: dict, lower: dict):
        self.unseen, self.known, self.lower = unseen, known, lower

    def log_probabilities(self, grams: np.ndarray) -> np.ndarray:
        """(ordinary, toxic) log probability of the last letter of each gram: the longest that is known, after the weights of those that are not."""
        out, todo = np.zeros((len(grams), 2)), np.arange(len(grams))

        def find(table, key):
            keys, values = table
            at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            hit = keys[at] == key if len(keys) else np.zeros(len(key), bool)
            return hit, values[at[hit]]

        for k in range(ORDER, 0, -1):
            hit, lp = find(self.known[k], grams[todo] & np.uint64((1 << (16 * k)) - 1))
            out[todo[hit]] += lp
            todo = todo[~hit]
            if k > 1 and len(todo):
                hit, weight = find(self.lower[k - 1], (grams[todo] >> np.uint64(16)) & np.uint64((1 << (16 * (k - 1))) - 1))
                out[todo[hit]] += weight
        out[todo] += self.unseen
        return out


def _add_up(texts: pd.Series, model: Model) -> np.ndarray:
    """For each text its number of letters and its two log-likelihoods."""
    out = np.zeros((len(texts), 3))
    for grams, owner in chunks(texts):
        lp = model.log_probabilities(grams)
        out += np.stack([np.bincount(owner, x, len(texts)) for x in (None, lp[:, 0], lp[:, 1])], 1)
    return out


def _likelihoods(broadcast):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(*broadcast.value)
        for b in batches:
            sums = _add_up(b["text"].reset_index(drop=True), model)
            yield pd.DataFrame({"doc_id": b["doc_id"], "text_hash": b["text_hash"], "n_letters": sums[:, 0].astype(np.int64), "ordinary": sums[:, 1], "toxic": sums[:, 2]})

    return read


def _own_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for grams, owner in chunks(b["text"]):
            order = np.lexsort((grams, owner))
            g, o = grams[order], owner[order]
            head = np.nonzero(np.r_[True, (g[1:] != g[:-1]) | (o[1:] != o[:-1])])[0]
            yield pd.DataFrame({"doc_id": b["doc_id"].iloc[o[head]].array, "text_hash": b["text_hash"].iloc[o[head]].array, "gram": g[head].astype(np.int64), "n": np.diff(np.r_[head, len(g)])})


def _joined_likelihoods(docs: DataFrame, model: DataFrame, schema: str) -> DataFrame:
    """As `_likelihoods`, for a model of any size: each different gram is looked up once by joins, and joined with the grams of the texts."""
    own = stored(docs.dropDuplicates(["doc_id", "text_hash"]).mapInPandas(_own_grams, f"doc_id {schema}, text_hash long, gram long, n long"), "toxicity-own")
    looked = own.select("gram").distinct().withColumns({"lp0": F.lit(None).cast("double"), "lp1": F.lit(None).cast("double"), "w0": F.lit(0.0), "w1": F.lit(0.0)})
    low = lambda c, k: c.bitwiseAND((1 << (16 * k)) - 1) if k < 4 else c
    for k in range(ORDER, 0, -1):
        known = model.where((F.col("k") == k) & F.col("lp0").isNotNull()).select(F.col("key").alias("known"), F.col("lp0").alias("a0"), F.col("lp1").alias("a1"))
        looked = looked.join(known, low(F.col("gram"), k) == F.col("known"), "left")
        looked = looked.select("gram", *(F.coalesce(f"lp{c}", F.col(f"a{c}") + F.col(f"w{c}")).alias(f"lp{c}") for c in (0, 1)), "w0", "w1")
        if k > 1:
            lower = model.where((F.col("k") == k - 1) & F.col("next0").isNotNull()).select(F.col("key").alias("known"), F.col("next0").alias("a0"), F.col("next1").alias("a1"))
            looked = looked.join(lower, low(F.call_function("shiftrightunsigned", F.col("gram"), F.lit(16)), k - 1) == F.col("known"), "left")
            looked = looked.select("gram", "lp0", "lp1", *(F.when(F.col(f"lp{c}").isNull(), F.col(f"w{c}") + F.coalesce(f"a{c}", F.lit(0.0))).otherwise(0.0).alias(f"w{c}") for c in (0, 1)))
    none = model.where("k = 0").select(F.col("lp0").alias("u0"), F.col("lp1").alias("u1")).first()
    found = looked.select("gram", *(F.coalesce(f"lp{c}", F.col(f"w{c}") + F.lit(none[c])).alias(f"lp{c}") for c in (0, 1)))
    sums = own.join(found, "gram").groupBy("doc_id", "text_hash").agg(F.sum("n").alias("n_letters"), F.sum(F.col("n") * F.col("lp0")).alias("ordinary"), F.sum(F.col("n") * F.col("lp1")).alias("toxic"))
    other = sums.select(F.col("doc_id").alias("other"), F.col("text_hash").alias("other_hash"), "n_letters", "ordinary", "toxic")
    joined = docs.join(other, F.col("doc_id").eqNullSafe(F.col("other")) & (F.col("text_hash") == F.col("other_hash")), "left")
    return joined.select("doc_id", "text_hash", F.coalesce("n_letters", F.lit(0).cast("long")).alias("n_letters"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("ordinary", "toxic")))


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, by Newton's method with a small ridge; without both classes, a steep curve through 0."""
    if not len(y) or y.min() == y.max():
        return 100.0, 0.0
    scale = float(np.abs(x).max()) or 1.0
    rows, w = np.stack([x / scale, np.ones(len(x))], 1), np.zeros(2)
    ridge = np.diag([1e-3, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        step = np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + ridge, rows.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return (float(w[0] / scale), float(w[1])) if w[0] > 0 else (100.0, 0.0)


def _labelled(docs: DataFrame, labels: DataFrame, folds: Column) -> DataFrame:
    """docs of these folds that have a label, with toxic 0 or 1; a doc_id with several labels is toxic if one says so."""
    one = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    used = stored(one.where(folds), "toxicity-labels")
    return docs.join(few_rows(used), "doc_id")


def score_texts(docs: DataFrame, labels: DataFrame, curve_rows: int = CURVE_ROWS, model_rows: int = MODEL_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, n_letters, ordinary, toxic (mean log-likelihoods of a letter).

    docs has doc_id and text, labels has doc_id and toxic. Null and empty texts have no evidence
    and the score of that; a null doc_id is held out, as is every id whose crc32 is divisible by
    five: their labels are never read. Repeated rows of docs get equal scores; repeated labels
    count as one, toxic if one of them is; null labels are none. An empty table gives no rows.
    """
    pid = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    counted = _labelled(read, labels, ~fold(F.col("doc_id")).isin(HELD_OUT, CURVE)).select("text", "toxic")
    model = fit(stored(count_grams(counted), "toxicity-counts"))
    if model.count() <= model_rows:
        broadcast = docs.sparkSession.sparkContext.broadcast(arrays(model.toPandas()))
        likely = stored(read.mapInPandas(_likelihoods(broadcast), f"doc_id {pid}, text_hash long, n_letters long, ordinary double, toxic double"), "toxicity")
    else:
        likely = stored(_joined_likelihoods(read, model, pid), "toxicity")
    evidence = (F.col("toxic") - F.col("ordinary")) / (F.col("n_letters") + LENGTH_PRIOR)
    known = _labelled(likely.select("doc_id", "text_hash", evidence.alias("x")), labels, fold(F.col("doc_id")) == CURVE)
    some = known.select("x", F.col("toxic").alias("y"), F.xxhash64("doc_id", "text_hash").alias("h")).orderBy("h").limit(curve_rows).toPandas()
    slope, start = fit_curve(some["x"].to_numpy(float), some["y"].to_numpy(float))
    score = 1 / (1 + F.exp(-(evidence * slope + start)))
    mean = lambda c: F.when(F.col("n_letters") > 0, F.col(c) / F.col("n_letters")).otherwise(0.0)
    scored = likely.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), score.alias("score"), "n_letters", mean("ordinary").alias("ordinary"), mean("toxic").alias("toxic"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_letters", "ordinary", "toxic")


def drop_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs whose score is under `least`, with their columns."""
    own = fresh(docs, "row")
    rows = nested(docs, own)
    low = score_texts(docs, labels).where(F.col("score") < least).select("doc_id").distinct()
    return rows.join(low, F.col(f"{own}.doc_id").eqNullSafe(F.col("doc_id")), "left_semi").select(*(F.col(f"{own}.`{c}`").alias(c) for c in docs.columns))
