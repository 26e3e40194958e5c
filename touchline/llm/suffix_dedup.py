"""Removal of strings of WIDTH bytes that also start earlier, by longest-previous-factor (LPF) arrays.

In the suffix order of the corpus, let the previous and the next smaller position of a suffix be the
nearest suffixes in that order which start earlier in the corpus. The longer of the two common
prefixes is its longest previous factor. A byte goes if a suffix within WIDTH - 1 bytes before it, or
at it, has LPF >= WIDTH; the first copy has no earlier one and stays.

No task can order all suffixes, so the order is built in parts that do not need each other. The
WIDTH-byte windows that share their least GRAM-byte hash (their anchor) form a run; a run's bytes are
a region. Windows that match have the same anchor, so each part holds the suffixes of some anchors:
their bytes are sorted, common prefixes are counted byte by byte, and the smaller positions give LPF
(`previous_factors`). LPF is exact in a part wherever it is WIDTH or more.

Two things keep the parts small:

* Equal regions need no order: all windows of the later ones have LPF >= WIDTH. They are found by
  a 64-bit hash of the region next to 32 bits of its anchor's and its length. Only regions whose
  anchor also occurs in other regions can hold windows that match in part, and only these are sent.
* An anchor with over FEW_REGIONS regions in one batch of texts, or with more than ORDERED_AT_ONCE windows in the different
  regions of all batches, is hot. Its windows are not sent as bytes to one part but dealt by a 64-bit
  name of their WIDTH bytes, and ordered by name and position. So no part holds more of one anchor.

1. Texts -> runs, about one in 35 bytes. Equal regions in a batch are settled there, so a string
   that a third of all documents hold leaves a batch once.
2. Runs by anchor: the first of each region stays, later ones are settled, and regions that share
   an anchor are asked for. Hot anchors are dealt by region instead, with a note to their own bucket.
3. Regions that are asked for, by anchor: suffix order and LPF. Windows of hot anchors by name.
4. Settled runs and windows by document, joined with its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.bytehash import Spans, mix, pack, starts_of, unpack, windows_of
from touchline.llm.util import stored

WIDTH, GRAM = 100, 32
#: Bytes of text hashed at once; longer texts are cut into overlapping blocks.
BLOCK = 1 << 19
#: An anchor with more regions in a batch is dealt by region. Smaller positions are found in so many rounds at most, or with a stack.
FEW_REGIONS, JUMPS = 64, 32
_LEAST = -(1 << 63)  # stands for a null doc_id
#: Suffixes ordered at once (anchors are kept whole), bytes of text a bucket of step 2 stands for, and windows a bucket of step 3 takes, about.
ORDERED_AT_ONCE, BUCKET_BYTES, BUCKET_WINDOWS = 1 << 16, 40 << 20, 1 << 19
_RUN, _NOTE, _SETTLED, _REGION = 0, 1, 2, 3
_ROWS = "bucket int, kind int, payload binary"
#: asked: the windows of the run are in question; hot: they go by name; else by anchor, as bytes.
_FOUND = "id long, sub long, asked boolean, hot boolean, anchor int, run long"
_DOCS = ("<i8", "<i8")


class Batch:
    """The documents of a batch in corpus order."""

    def __init__(self, b: pd.DataFrame):
        self.ids, self.subs = b["id"].to_numpy(np.int64), b["sub"].to_numpy(np.int64)
        order = np.lexsort((self.subs, self.ids))
        self.rank = np.empty(len(b), np.int64)
        self.rank[order] = np.cumsum(starts_of(self.ids[order], self.subs[order])) - 1

    def table(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own, at = np.unique(doc, return_inverse=True)
        return self.ids[own], self.subs[own], at.astype("<i4")


def _all_runs(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """Anchor hash, region hash, number of the text, first window and number of windows of all runs; texts are hashed in blocks."""
    parts: list[tuple[np.ndarray, ...]] = []

    def flush(group: list[tuple[int, int, bytes]]) -> None:
        if not group:
            return
        data = np.frombuffer(b"".join(t for _, _, t in group), np.uint8)
        ends = np.cumsum([len(t) for _, _, t in group])
        begins = ends - [len(t) for _, _, t in group]
        grams = windows_of(data, GRAM)
        least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        span, width = 1, WIDTH - GRAM + 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        inside = np.zeros(len(data) + 1, np.int32)  # windows that cross no end of a text
        np.add.at(inside, begins, 1)
        np.add.at(inside, ends - (WIDTH - 1), -1)
        at = np.flatnonzero(np.cumsum(inside[: len(anchor)]) > 0)
        owner = np.searchsorted(ends, at, "right")
        new = np.flatnonzero(starts_of(anchor[at], owner))
        count = np.diff(np.append(new, len(at)))
        first, owner = at[new], owner[new]
        doc, shift = np.array([g[0] for g in group]), np.array([g[1] for g in group])
        parts.append((grams[anchor[first]], Spans(data).of(first, first + count + (WIDTH - 1)), doc[owner], first - begins[owner] + shift[owner], count))

    group: list[tuple[int, int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        raw = text.encode() if text else b""
        for a in range(0, max(1, len(raw) - (WIDTH - 1)), BLOCK):
            block = raw[a : a + BLOCK + WIDTH - 1]
            if len(block) >= WIDTH:
                group.append((i, a, block))
                size += len(block)
            if size >= BLOCK:
                flush(group)
                group, size = [], 0
    flush(group)
    if not parts:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _dealt(kind: int, bucket: np.ndarray, arrays: list[np.ndarray], batch: Batch, doc: np.ndarray | None) -> list[tuple[int, int, bytes]]:
    """Rows of one payload for each bucket."""
    order = np.argsort(bucket, kind="stable")
    cut = np.append(np.flatnonzero(starts_of(bucket[order])), len(order))
    out = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        at = order[a:b]
        out.append((int(bucket[at[0]]), kind, pack(*(x[at] for x in arrays), *(batch.table(doc[at]) if doc is not None else ()))))
    return out


def _low(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(0xFFFFFFFF)).astype("<u4")


def _to_buckets(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix(h) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _settled(batch: Batch, doc: np.ndarray, first: np.ndarray, count: np.ndarray, buckets: int) -> list[tuple[int, int, bytes]]:
    if not len(doc):
        return []
    return _dealt(_SETTLED, np.full(len(doc), int(abs(int(batch.ids[0]) * 31 + int(batch.subs[0]))) % buckets), [first.astype("<i8"), count.astype("u1")], batch, doc)


def _runs(buckets: int):
    """Step 1, over batches of texts."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            batch = Batch(b)
            anchor, region, doc, first, count = _all_runs(b["text"].tolist())
            order = np.lexsort((first, batch.rank[doc], count, region, anchor))
            anchor, region, doc, first, count = (x[order] for x in (anchor, region, doc, first, count))
            new = starts_of(anchor, region, count)
            head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            later = (batch.rank[doc] != batch.rank[doc[head]]) | (first != first[head])
            out = _settled(batch, doc[later], first[later], count[later], buckets)
            anchor, region, doc, first, count = (x[new] for x in (anchor, region, doc, first, count))
            begin = np.flatnonzero(starts_of(anchor)) if len(anchor) else np.empty(0, np.int64)
            many = np.repeat(np.diff(np.append(begin, len(anchor))), np.diff(np.append(begin, len(anchor)))) > FEW_REGIONS
            bucket = np.where(many, _to_buckets(region, buckets), _to_buckets(anchor, buckets))
            out += _dealt(_RUN, bucket, [_low(anchor), region, first.astype("<i8"), count.astype("u1"), many.astype("u1")], batch, doc) if len(doc) else []
            noted = np.unique(anchor[many])
            out += _dealt(_NOTE, _to_buckets(noted, buckets), [_low(noted)], batch, None) if len(noted) else []
            yield pd.DataFrame(out, columns=["bucket", "kind", "payload"])

    return of


def _decoded(blobs, *kinds: str) -> list[np.ndarray]:
    """Columns of payloads, the ids and subs of their documents last."""
    parts = []
    for blob in blobs:
        *columns, ids, subs, at = unpack(blob, *kinds, *_DOCS, "<i4")
        parts.append((*columns, ids[at], subs[at]))
    if not parts:
        return [np.empty(0, k) for k in (*kinds, *_DOCS)]
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _found(ids: np.ndarray, subs: np.ndarray, first: np.ndarray, count: np.ndarray, hot: np.ndarray | None = None, anchor: np.ndarray | None = None) -> pd.DataFrame:
    """Settled runs; with hot and anchor, runs that are asked for."""
    n, asked = len(ids), hot is not None
    return pd.DataFrame({"id": ids, "sub": subs, "asked": np.full(n, asked), "hot": hot if asked else np.zeros(n, bool), "anchor": anchor.view("<i4") if asked else np.zeros(n, np.int32), "run": first.astype(np.int64) << 8 | count.astype(np.int64)})


def _windows(ids: np.ndarray, subs: np.ndarray, first: np.ndarray) -> pd.DataFrame:
    """Settled windows, each once, as runs of at most 200."""
    order = np.lexsort((first, subs, ids))
    ids, subs, first = ids[order], subs[order], first[order]
    if not len(ids):
        return _found(ids, subs, first, first)
    new = starts_of(ids, subs)
    new[1:] |= first[1:] != first[:-1] + 1
    since = np.arange(len(ids)) - np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
    begin = np.flatnonzero(since % 200 == 0)
    return _found(ids[begin], subs[begin], first[begin], np.diff(np.append(begin, len(ids))))


def _forwarded(g: pd.DataFrame) -> pd.DataFrame:
    first, count, ids, subs = _decoded(g["payload"][g["kind"] == _SETTLED], "<i8", "u1")
    return _found(ids, subs, first, count)


def _by_anchor(g: pd.DataFrame) -> pd.DataFrame:
    """Step 2, over a bucket: runs that are settled, and runs whose windows are asked for."""
    anchor, region, first, count, many, ids, subs = _decoded(g["payload"][g["kind"] == _RUN], "<u4", "<u8", "<i8", "u1", "u1")
    noted = [unpack(x, "<u4")[0] for x in g["payload"][g["kind"] == _NOTE]]
    order = np.lexsort((first, subs, ids, count, region, anchor))
    anchor, region, first, count, many, ids, subs = (x[order] for x in (anchor, region, first, count, many, ids, subs))
    new = starts_of(anchor, region, count)
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    later = (ids != ids[head]) | (subs != subs[head]) | (first != first[head])
    hot = np.isin(anchor, np.concatenate(noted)) | (many > 0) if noted else many > 0
    asked = new & hot
    if len(new):
        group = np.cumsum(starts_of(anchor)) - 1
        asked |= new & (np.bincount(group, new) > 1)[group]
        hot |= (np.bincount(group, new * count.astype(np.int64)) > ORDERED_AT_ONCE)[group]  # more windows than are ordered at once
    return pd.concat([_forwarded(g), _found(ids[later], subs[later], first[later], count[later]), _found(ids[asked], subs[asked], first[asked], count[asked], hot[asked], anchor[asked])])


def _asked(buckets: int):
    """Step 3, over batches of texts with the runs that are asked for: regions by anchor, names of windows of hot anchors."""

    def regions(batch: Batch, parts: list[tuple]) -> list[tuple[int, int, bytes]]:
        data, doc, first, count, anchor = (np.concatenate(x) for x in zip(*parts, strict=True))
        size = count + (WIDTH - 1)
        begin = np.cumsum(size) - size
        bucket = _to_buckets(anchor.astype(np.uint64), buckets)
        order = np.argsort(bucket, kind="stable")
        cut = np.append(np.flatnonzero(starts_of(bucket[order])), len(order))
        out = []
        for a, z in zip(cut[:-1], cut[1:], strict=True):
            at = order[a:z]
            own = np.repeat(begin[at] - np.cumsum(size[at]) + size[at], size[at]) + np.arange(size[at].sum())
            out.append((int(bucket[at[0]]), _REGION, pack(anchor[at], first[at], count[at].astype("u1"), data[own], *batch.table(doc[at]))))
        return out

    def names(batch: Batch, parts: list[tuple]) -> list[tuple[int, int, bytes]]:
        name, doc, first = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((first, batch.rank[doc], name))
        name, doc, first = name[order], doc[order], first[order]
        new = starts_of(name)
        head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        later = (batch.rank[doc] != batch.rank[doc[head]]) | (first != first[head])
        out = _settled(batch, doc[later], first[later], np.ones(later.sum()), buckets)
        return out + _dealt(_RUN, _to_buckets(name[new], buckets), [name[new], first[new].astype("<i8")], batch, doc[new])

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            batch, cold, hot = Batch(b), [], []
            for i, (text, runs, anchors, hots) in enumerate(zip(b["text"], b["runs"], b["anchors"], b["hots"], strict=True)):
                data = np.frombuffer((text or "").encode(), np.uint8)
                runs, at = np.unique(np.asarray(runs, np.int64), return_index=True)
                anchor, is_hot = np.asarray(anchors, np.int32)[at].view("<u4"), np.asarray(hots, bool)[at]
                first, count = runs >> 8, runs & 255
                f, c = first[~is_hot], count[~is_hot]
                size = c + (WIDTH - 1)
                if len(f):
                    cold.append((data[np.repeat(f - np.cumsum(size) + size, size) + np.arange(size.sum())], np.full(len(f), i), f, c, anchor[~is_hot]))
                f, c = first[is_hot], count[is_hot]
                at = np.repeat(f - np.cumsum(c) + c, c) + np.arange(c.sum())
                for a in range(0, len(data) if len(f) else 0, BLOCK):
                    own = at[(at >= a) & (at < a + BLOCK)]
                    if len(own):
                        hot.append((Spans(data[a : a + BLOCK + WIDTH - 1]).of(own - a, own - a + WIDTH), np.full(len(own), i), own))
            rows = (regions(batch, cold) if cold else []) + (names(batch, hot) if hot else [])
            if rows:
                yield pd.DataFrame(rows, columns=["bucket", "kind", "payload"])

    return of


def smaller_before(position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each place of an order, the common prefix with the nearest place before it that has a smaller position (0 if none).

    common[i] is the common prefix of places i - 1 and i. All places jump at once: where the place
    before is not smaller, what lies before that one is looked at next. Orders that need more than
    JUMPS such rounds, as those that rise and then fall, are walked once with a stack instead.
    """
    before, shared = np.arange(len(position)) - 1, common.copy()
    at = np.flatnonzero((before >= 0) & (position[before] > position))
    for _ in range(JUMPS):
        if not len(at):
            return np.where(before >= 0, shared, 0)
        over = before[at]
        shared[at], before[at] = np.minimum(shared[at], shared[over]), before[over]
        at = at[(before[at] >= 0)]
        at = at[position[before[at]] > position[at]]
    out, stack = [], []  # (position, common prefix of its place with the one below it in the stack), positions rise
    for own, with_last in zip(position.tolist(), common.tolist(), strict=True):
        while stack and stack[-1][0] > own:
            with_last = min(with_last, stack.pop()[1])
        out.append(with_last if stack else 0)
        stack.append((own, with_last))
    return np.array(out, np.int64)


def previous_factors(windows: np.ndarray, position: np.ndarray) -> np.ndarray:
    """LPF, counted up to the width, of suffixes given by their first bytes (one row each) and distinct positions."""
    order = np.argsort(position, kind="stable")
    order = order[np.argsort(np.ascontiguousarray(windows[order]).view(f"S{windows.shape[1]}").ravel(), kind="stable")]
    common = np.zeros(len(order), np.int64)
    differ = windows[order[1:]] != windows[order[:-1]]
    common[1:] = np.where(differ.any(1), differ.argmax(1), windows.shape[1])
    place = position[order]
    before = smaller_before(place, common)
    after = smaller_before(place[::-1], np.append(0, common[:0:-1]))[::-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(before, after)
    return out


def _by_suffix(blobs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents and first bytes of the windows of regions that have LPF >= WIDTH."""
    parts = []
    for blob in blobs:
        anchor, first, count, data, ids, subs, at = unpack(blob, "<u4", "<i8", "u1", "u1", *_DOCS, "<i4")
        parts.append((anchor, first, count.astype(np.int64), data, ids[at], subs[at]))
    empty = np.empty(0, np.int64)
    if not parts:
        return empty, empty, empty
    anchor, first, count, data, ids, subs = (np.concatenate(x) for x in zip(*parts, strict=True))
    size = count + (WIDTH - 1)
    begin = np.cumsum(size) - size
    order = np.lexsort((first, subs, ids, anchor))
    anchor, first, count, ids, subs, begin = (x[order] for x in (anchor, first, count, ids, subs, begin))
    once = starts_of(anchor, ids, subs, first)  # rows that repeat an id and a text are one document
    anchor, first, count, ids, subs, begin = (x[once] for x in (anchor, first, count, ids, subs, begin))
    every = np.lib.stride_tricks.sliding_window_view(data, WIDTH)
    heads = np.flatnonzero(starts_of(anchor))
    done = np.append(np.cumsum(count)[heads - 1] * (heads > 0), count.sum())
    out, a = [], 0
    while a < len(heads):
        z = max(a + 1, int(np.searchsorted(done, done[a] + ORDERED_AT_ONCE, "right")) - 1)
        own = slice(heads[a], heads[z] if z < len(heads) else len(anchor))
        c = count[own]
        step = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        w_ids, w_subs, w_first = np.repeat(ids[own], c), np.repeat(subs[own], c), np.repeat(first[own], c) + step
        position = np.empty(len(step), np.int64)
        position[np.lexsort((w_first, w_subs, w_ids))] = np.arange(len(step))
        later = previous_factors(every[np.repeat(begin[own], c) + step], position) >= WIDTH
        out.append((w_ids[later], w_subs[later], w_first[later]))
        a = z
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def has_earlier(name: np.ndarray, ids: np.ndarray, subs: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by name (hash), then position, and for each suffix in it whether LPF >= WIDTH, barring hash collisions.

    Within a name positions rise, so the previous smaller position is the suffix before; where
    that has another name, no suffix of the same name is earlier, and the next smaller one has
    another name too.
    """
    order = np.lexsort((first, subs, ids, name))
    name, ids, subs, first = name[order], ids[order], subs[order], first[order]
    same = ~starts_of(name)
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(name))))
    return order, same & ((ids != ids[head]) | (subs != subs[head]) | (first != first[head]))


def _by_order(g: pd.DataFrame) -> pd.DataFrame:
    """Step 3, over a bucket."""
    name, first, ids, subs = _decoded(g["payload"][g["kind"] == _RUN], "<u8", "<i8")
    order, later = has_earlier(name, ids, subs, first)
    at = order[later]
    return pd.concat([_forwarded(g), _windows(ids[at], subs[at], first[at]), _windows(*_by_suffix(g["payload"][g["kind"] == _REGION]))])


def spans_of(runs, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal byte runs that the settled windows cover."""
    runs = np.sort(np.asarray(runs, np.int64))
    start, end = runs >> 8, (runs >> 8) + (runs & 255) + WIDTH - 1
    if not len(runs):
        return start, end
    reach = np.maximum.accumulate(end)
    new = np.append(True, start[1:] > reach[:-1])
    return start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]


def removed_spans(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """id, sub, text and `runs` of every row of docs: null, or windows (start << 8 | count) that also start earlier."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("id"), F.xxhash64(text).alias("sub"), text.alias("text"))
    least = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = buckets or max(least, (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES)
    found = stored(keyed.mapInPandas(_runs(n), _ROWS).groupBy("bucket").applyInPandas(_by_anchor, _FOUND), "runs")
    per_doc = lambda df, *also: df.groupBy("id", "sub").agg(F.collect_list("run").alias("runs"), *also)
    asked = keyed.join(per_doc(found.where("asked"), F.collect_list("anchor").alias("anchors"), F.collect_list("hot").alias("hots")), ["id", "sub"])
    m = buckets or max(least, (found.where("asked").agg(F.sum(F.expr("run & 255"))).first()[0] or 0) // BUCKET_WINDOWS)
    ordered = asked.mapInPandas(_asked(m), _ROWS).groupBy("bucket").applyInPandas(_by_order, _FOUND)
    settled = per_doc(found.where("not asked").unionByName(ordered).select("id", "sub", "run"))
    return keyed.join(settled, ["id", "sub"], "left")


def remove_repeats(docs: DataFrame, buckets: int | None = None, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and starts, ends, kept bytes if asked for).

    Null text is empty. Order is by doc_id (null first), then by the hash of the text, so rows
    that share a doc_id but not a text are documents of their own; a row that repeats both is the
    same document and gets the same result. Other columns are ignored; an empty table gives no
    rows. `buckets` (by default four a shuffle partition) sets the size of the tasks, not results.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, text, runs in zip(b["id"], b["text"], b["runs"], strict=True):
                raw = text.encode()
                start, end = spans_of([] if runs is None else runs, len(raw))
                kept = b"".join(raw[a:z] for a, z in zip([0, *end], [*start, len(raw)], strict=True)) if len(start) else raw
                rows.append((doc_id, len(raw), len(raw) - len(kept), len(start), hashlib.sha256(kept).hexdigest(), *((start.tolist(), end.tolist(), kept) if with_text else ())))
            yield pd.DataFrame(rows, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["starts", "ends", "kept"] * with_text])

    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", starts array<long>, ends array<long>, kept binary" * with_text
    out = removed_spans(docs, buckets).mapInPandas(cut, schema)
    return out.withColumn("id", F.when(F.col("id") != _LEAST, F.col("id"))).withColumnRenamed("id", "doc_id")
