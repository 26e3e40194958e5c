"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Every text becomes the set of its word n-grams (hashed to 64 bits). Two texts link when their
sets' Jaccard similarity reaches a threshold, that is, when their symmetric difference is at
most `slack(n_x, n_y)`. Texts with equal sets are one node.

* Order: n-grams are sorted rare first. Rarity is counted over all texts in 2**18 hash ranges, and
  any order that all texts share makes the filters exact; n-grams far more frequent than others
  come last.
* Prefix filter: two sets that link share an n-gram among their first ones. Nodes are joined on
  these, with the length filter, and the positional filter on what can still follow.
* Suffix filter: within a group, 128 parities of each set; before sets are fetched, parity sketches (a bit for each n-gram or so, the parity of the
  n-grams that hash there) bound the symmetric difference from below: their own is no larger.
  Before sets are merged, the sizes of their parts between fixed pivots do so once more.
* Each pair is verified once.

Groups. Of the texts that share a prefix n-gram no pairs are made at first: each is verified against
the hub of its length class, so a group of m makes m rows, and the links found give components.
Only pairs of different components are of interest then, and a group that is one component is
done. In the rest, an n-gram that at most `few` (64) nodes have in the part of the prefix that the
smaller of two sets needs (its index prefix) makes these nodes' pairs; one with more nodes is
verified against its hubs once more, and sets are replaced by their differences from the hub: x and
y link only if these share most of their n-grams, so the same prefix join runs again on the
differences, whose n-grams are rare where the group's are not. (A node that does not link with its
hub c cannot link with one whose difference shares nothing with its own: |D_y| - n_y/r is least for
c itself.) Levels repeat until no group is open. Each level takes the hubs at least out of a group,
and among differences `few` is larger and grows fourfold from level to level, so levels end. Nothing is capped, and no group is expanded
into all pairs while hubs still divide it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.bytehash import Spans, mix, pack, starts_of, unpack
from touchline.llm.util import components, few_rows, forget, fresh, gathered, stored

N, PERCENT = 5, 80
#: An n-gram that more nodes have in their index prefix goes by hubs; and the same among differences, where most that share one are close.
FEW, FEW_DIFFERENCES = 64, 128
#: In one batch: an n-gram with more nodes is sent as a summary, its rows go another way.
FEW_IN_BATCH = 32
#: Bytes of rows that a task of the group step takes, about.
BUCKET_BYTES = 16 << 20
RANGE_BITS = 18
_LEAST = -(1 << 63)
_BLOCK = 1 << 19
#: N-grams that are dealt to buckets at once, about.
_DEALT = 1 << 18
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_PIVOTS = np.arange(1, 16, dtype=np.uint64) << np.uint64(60)
_ROWS = "bucket int, kind int, payload binary"
_ROW, _SUMMARY, _HOT = 0, 1, 2
_KINDS = ("<u8", "<i8", "<i4", "<i4", "<i4", "<i8", "<u8", "<u8")  # n-gram, node, set size, difference size, place, component so far, parities of the set in 128 cells
_OUT = "kind int, key long, x long, y long, n int"
_CHECKED = "x long, y long, linked boolean, n int, d int, keys binary"
#: Pairs to verify; a member and its hub; and both apart, for n-grams whose rows are in several buckets.
_PAIR, _OF_HUB, _HUB, _MEMBER = 0, 1, 2, 3
#: What a level does: sets by hubs alone, sets, differences from hubs.
_HUBS, _SETS, _DIFFERENCES = 0, 1, 2


def gram_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """The sorted set of hashed n-grams of each text; the whole sequence if it has fewer words."""
    sets: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        group, size = [], 0
        while at + len(group) < len(texts) and (not group or size < _BLOCK):
            group.append((texts[at + len(group)] or "").encode() + b"\n")
            size += len(group[-1])
        data = _LOWER[np.frombuffer(b"".join(group), np.uint8)]
        gap = _GAP[data]
        start = np.flatnonzero(~gap & np.append(True, gap[:-1]))
        end = np.flatnonzero(gap & np.append(False, ~gap[:-1]))
        word = mix(Spans(data).of(start, end))
        cut = np.searchsorted(start, np.cumsum([len(g) for g in group]))
        h = np.zeros(max(0, len(word) - n + 1), np.uint64)
        for i in range(n):
            h = h * _A + word[i : i + len(h)]
        h = mix(h)
        for a, b in zip(np.append(0, cut[:-1]), cut, strict=True):
            if b - a >= n:
                sets.append(np.unique(h[a : b - n + 1]))
            elif b > a:
                short = np.array([b - a], np.uint64)
                for i in range(a, b):
                    short = short * _B + word[i : i + 1]
                sets.append(mix(short))
            else:
                sets.append(np.empty(0, np.uint64))
        at += len(group)
    return sets


def slack(nx: np.ndarray, ny: np.ndarray, percent: int) -> np.ndarray:
    """The largest symmetric difference at which sets of these sizes link."""
    return (nx + ny) * (100 - percent) // (100 + percent)


def set_key(s: np.ndarray) -> tuple[int, int]:
    return int(mix(s).sum(dtype=np.uint64).astype(np.int64)), int(mix(s ^ _B).sum(dtype=np.uint64).astype(np.int64))


def suffix_bound(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound of the symmetric difference, from the sizes of the parts between pivots."""
    parts = [np.diff(np.concatenate([[0], np.searchsorted(s, _PIVOTS), [len(s)]])) for s in (x, y)]
    return int(np.abs(parts[0] - parts[1]).sum())


def sketch(s: np.ndarray) -> bytes:
    """Parities of the n-grams of a set in a power of two of cells, at least as many as there are n-grams."""
    cells = 1 << max(6, int(len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def parities(s: np.ndarray) -> bytes:
    """The sketch of a set in 128 cells, whatever its size: 16 bytes."""
    return np.packbits((np.bincount((s & np.uint64(127)).astype(np.int64), minlength=128) & 1).astype(np.uint8), bitorder="little").tobytes()


def sketch_bound(x: bytes, y: bytes) -> int:
    """A lower bound of the symmetric difference: n-grams in both sets cancel, any other changes one cell."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) < len(b):
        a, b = b, a
    a = np.bitwise_xor.reduce(a.reshape(-1, len(b)), axis=0)  # the parities of fewer cells
    return int(np.bitwise_count(a ^ b).sum())


def _may_link(percent: int):
    """Over candidate pairs with their sizes and sketches: those that the sketches leave."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            room = slack(b["n_x"].to_numpy(np.int64), b["n_y"].to_numpy(np.int64), percent)
            bound = np.array([sketch_bound(x, y) for x, y in zip(b["sketch_x"], b["sketch_y"], strict=True)], np.int64)
            yield b.loc[bound <= room, ["x", "y", "hub"]]

    return of


def gram_counts(docs: DataFrame, n: int) -> np.ndarray:
    """In how many sets the n-grams of each hash range are: a table of 2**RANGE_BITS counts, whatever the input."""
    size, chunk = 1 << RANGE_BITS, 1 << (RANGE_BITS - 6)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.int64)
        for b in batches:
            grams = np.concatenate([np.empty(0, np.uint64), *gram_sets(b["text"].tolist(), n)])
            total += np.bincount((grams >> np.uint64(64 - RANGE_BITS)).astype(np.int64), minlength=size)
        yield pd.DataFrame({"chunk": range(64), "counts": [total[i * chunk : (i + 1) * chunk].tobytes() for i in range(64)]})

    def add(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": g["chunk"][:1], "counts": [np.sum([np.frombuffer(x, np.int64) for x in g["counts"]], axis=0).tobytes()]})

    rows = stored(docs.select("text").mapInPandas(count, "chunk int, counts binary").groupBy("chunk").applyInPandas(add, "chunk int, counts binary"), "counts").collect()
    return np.concatenate([np.frombuffer(r["counts"], np.int64) for r in sorted(rows)]) if rows else np.zeros(size, np.int64)


def _rare_first(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return grams[np.lexsort((grams, counts[(grams >> np.uint64(64 - RANGE_BITS)).astype(np.int64)]))]


def _rare_difference(grams: np.ndarray, hub: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Differences from a hub, those first that few others of its group share: what is rare and not in the
    hub, then what is common and missing; then what only the hub has, and what all but the hub have."""
    of = lambda s: counts[(s >> np.uint64(64 - RANGE_BITS)).astype(np.int64)]
    n, in_hub = of(grams), np.isin(grams, hub, True)
    common = n > (counts.mean() + np.median(of(hub))) / 2
    shared = np.where(in_hub, np.where(common, 1, 2), np.where(common, 3, 0))
    return grams[np.lexsort((grams, np.where(in_hub, -n, n), shared))]


def _to_buckets(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix(h) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _deal(columns: list[np.ndarray], buckets: int, most: float) -> list[tuple[int, int, bytes]]:
    """Rows by the bucket of their n-gram. An n-gram with over `most` rows in this batch goes as a summary, its rows to any bucket."""
    order = np.argsort(columns[0], kind="stable")
    columns = [c[order] for c in columns]
    key, node = columns[0], columns[1]
    begin = np.flatnonzero(starts_of(key))
    size = np.diff(np.append(begin, len(key)))
    hot = np.repeat(size > most, size)
    summary = _summary(*(c[hot] for c in columns))
    out = []
    for kind, own, bucket in (
        (_ROW, [c[~hot] for c in columns], _to_buckets(key[~hot], buckets)),
        (_HOT, [c[hot] for c in columns], _to_buckets(key[hot] ^ node[hot].astype(np.uint64), buckets)),
        (_SUMMARY, summary, _to_buckets(summary[0], buckets)),
    ):
        at = np.argsort(bucket, kind="stable")
        cut = np.append(np.flatnonzero(starts_of(bucket[at])), len(at))
        out += [(int(bucket[at[a]]), kind, pack(*(c[at[a:b]] for c in own))) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return out


def _class(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Length class: sets that link are in the same or in neighbouring ones."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(100 / percent) + 1e-9).astype(np.int64)


def _summary(key: np.ndarray, node: np.ndarray, n: np.ndarray, d: np.ndarray, place: np.ndarray, part: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """Of each n-gram and set size the first node, with the least and with the greatest component: what any choice of hubs needs to know."""
    order = np.lexsort((node, n, key))
    key, node, n, d, place, part, low, high = (c[order] for c in (key, node, n, d, place, part, low, high))
    new = np.flatnonzero(starts_of(key, n))
    if not len(new):
        return [key, node, n, d, place, part, low, high]
    lo, hi, place = np.minimum.reduceat(part, new), np.maximum.reduceat(part, new), np.minimum.reduceat(place, new)
    more = np.flatnonzero(lo < hi)
    both = np.append(new, new[more])
    return [key[both], node[both], n[both], d[both], np.append(place, place[more]), np.append(lo, hi[more]), low[both], high[both]]


def _index_prefix(n: np.ndarray, d: np.ndarray, percent: int, differences: bool) -> np.ndarray:
    """How many first n-grams of the smaller one of two sets (or differences) that link hold one that both share."""
    if differences:
        return np.minimum(d, slack(n, n * 100 // percent, percent) // 2 + 1)
    return n - -(-2 * percent * n // (100 + percent)) + 1


def _groups(percent: int, few: int, stage: int):
    """Over a bucket: pairs, and members with their hubs."""

    def frame(kind: int, key, x, y, n) -> pd.DataFrame:
        size = len(x)
        return pd.DataFrame({"kind": np.full(size, kind), "key": np.broadcast_to(key, size), "x": x, "y": np.broadcast_to(y, size), "n": np.broadcast_to(n, size)})

    def once(kind: int, x: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        order = np.lexsort((y, x))
        new = starts_of(x[order], y[order])
        return frame(kind, 0, x[order][new], y[order][new], 0)

    def decoded(g: pd.DataFrame, kind: int) -> list[np.ndarray]:
        rows = [unpack(b, *_KINDS) for b in g["payload"][g["kind"] == kind]]
        return [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.empty(0, k) for k in _KINDS]

    def of(g: pd.DataFrame) -> pd.DataFrame:
        rows, summed, hot = (decoded(g, kind) for kind in (_ROW, _SUMMARY, _HOT))
        out = [frame(_MEMBER, hot[0].astype(np.int64), hot[1], 0, hot[2])]
        spread = np.arange(len(rows[0]) + len(summed[0])) >= len(rows[0])
        key, node, n, d, place, part, low, high = (np.concatenate(c) for c in zip(rows, summed, strict=True))
        order = np.lexsort((node, n, key))
        key, node, n, d, place, part, low, high, spread = (c[order] for c in (key, node, n, d, place, part, low, high, spread))
        if not len(key):
            return out[0]
        n, d, place = n.astype(np.int64), d.astype(np.int64), place.astype(np.int64)
        index = (place < _index_prefix(n, d, percent, stage == _DIFFERENCES)) | spread
        begin = np.flatnonzero(starts_of(key))
        size = np.diff(np.append(begin, len(key)))
        n_index = np.add.reduceat(index.astype(np.int64), begin)
        is_open = (np.maximum.reduceat(part, begin) > np.minimum.reduceat(part, begin)) & (n_index > 0)  # else one component
        is_spread = np.maximum.reduceat(spread, begin)
        is_large = is_open & (is_spread | (n_index > few) | (stage == _HUBS))
        # few nodes in the index: each of them with all others
        chosen = np.flatnonzero(np.repeat(is_open & ~is_large, size))
        rank = np.cumsum(index) - np.repeat(np.cumsum(n_index) - n_index, size)  # from 1, of the index rows of a group
        at = np.flatnonzero(index)
        xs, ys = [], []
        for k in range(int(n_index[is_open & ~is_large].max(initial=0))):
            kth = np.full(len(begin), -1)
            own = at[rank[at] == k + 1]
            kth[np.searchsorted(begin, own, "right") - 1] = own
            a, b = np.repeat(kth, size)[chosen], chosen
            b, a = b[a >= 0], a[a >= 0]
            room = slack(n[a], n[b], percent)
            need = -(-(d[a] + d[b] - room) // 2)
            fits = (np.abs(n[b] - n[a]) <= room) & (np.minimum(d[a] - place[a], d[b] - place[b]) >= need) & (part[a] != part[b])
            fits &= (d[a] <= d[b]) & ((d[a] < d[b]) | (a < b) | ~index[b])
            fits &= np.bitwise_count(low[a] ^ low[b]).astype(np.int64) + np.bitwise_count(high[a] ^ high[b]) <= room
            xs.append(np.minimum(node[a], node[b])[fits])
            ys.append(np.maximum(node[a], node[b])[fits])
        if xs:
            out.append(once(_PAIR, np.concatenate(xs), np.concatenate(ys)))
        # the others: members with the hubs of their length class and of the one below
        big = np.repeat(is_large, size)
        key, node, n, d, place, low, high, index, spread, whole = (c[big] for c in (key, node, n, d, place, low, high, index, spread, ~np.repeat(is_spread, size)))
        if len(key):
            cls = _class(n, percent)
            new = starts_of(key, cls)
            first, run = np.flatnonzero(new), np.cumsum(new) - 1
            below = np.maximum(run - 1, 0)
            near = (run > 0) & (key[first[below]] == key) & (cls[first[below]] == cls - 1)
            a = np.concatenate((np.flatnonzero(whole), np.flatnonzero(whole & near)))
            b = np.concatenate((first[run[whole]], first[below[whole & near]]))
            fits = node[a] != node[b]
            if stage == _HUBS:  # only links count here, so a pair has to pass the filters
                room = slack(n[a], n[b], percent)
                fits &= (np.abs(n[b] - n[a]) <= room) & (np.minimum(d[a] - place[a], d[b] - place[b]) >= -(-(d[a] + d[b] - room) // 2))
                fits &= (index[a] & (d[a] <= d[b])) | (index[b] & (d[b] <= d[a]))
                fits &= np.bitwise_count(low[a] ^ low[b]).astype(np.int64) + np.bitwise_count(high[a] ^ high[b]) <= room
            out.append(once(_PAIR if stage == _HUBS else _OF_HUB, node[a[fits]], node[b[fits]]))
            out.append(frame(_MEMBER, key[~whole & ~spread].astype(np.int64), node[~whole & ~spread], 0, n[~whole & ~spread]))
            out.append(frame(_HUB, key[new & ~whole].astype(np.int64), node[new & ~whole], 0, cls[new & ~whole]))
        return pd.concat(out, ignore_index=True)

    return of


def _verify(percent: int, counts: np.ndarray):
    """Over candidate pairs with their sets: whether they link, and the first differences of members from their hub."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for x, y, hub, sx, sy in zip(b["x"], b["y"], b["hub"], b["set_x"], b["set_y"], strict=True):
                sx, sy = np.frombuffer(sx, np.uint64), np.frombuffer(sy, np.uint64)
                room = int(slack(len(sx), len(sy), percent))
                if not hub:
                    if suffix_bound(sx, sy) <= room and len(sx) + len(sy) - 2 * len(np.intersect1d(sx, sy, True)) <= room:
                        rows.append((x, y, True, 0, 0, None))
                    continue
                other = np.setxor1d(sx, sy, True)
                d, n = len(other), len(sx)
                widest = int(slack(n, n * 100 // percent, percent))
                first = _rare_difference(other, sy, counts)[: d - max(1, d - widest) + 1]
                rows.append((x, y, d <= room, n, d, mix(first ^ mix(np.array([y], np.int64).view(np.uint64))).tobytes()))
            yield pd.DataFrame(rows, columns=["x", "y", "linked", "n", "d", "keys"])

    return of


def _dealer(buckets: int, most: float):
    """Over nodes with their first n-grams: rows for the buckets."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            upto = np.cumsum(b["keys"].str.len().to_numpy(np.int64) // 8)
            for _, own in b.groupby(upto // _DEALT):  # a batch has some 60 bytes a row and n-gram, several times over
                grams = [np.frombuffer(k, np.uint64) for k in own["keys"]]
                size = np.array([len(g) for g in grams], np.int64)
                if not size.sum():
                    continue
                place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                cells = np.frombuffer(b"".join(own["cells"]), "<u8").reshape(-1, 2)
                columns = [np.concatenate(grams), *(np.repeat(own[c].to_numpy(np.int64), size) for c in ("node", "n", "d")), place, np.repeat(own["part"].to_numpy(np.int64), size), *(np.repeat(cells[:, i], size) for i in (0, 1))]
                yield pd.DataFrame(_deal([c.astype(k) for c, k in zip(columns, _KINDS, strict=True)], buckets, most), columns=["bucket", "kind", "payload"])

    return of


def _bucket_count(rows: DataFrame) -> int:
    """Buckets for the group step: a megabyte of rows each, no more than shuffle partitions while that suffices, and BUCKET_BYTES at most."""
    size = (rows.agg(F.sum(F.length("keys"))).first()[0] or 0) * 36 // 8  # 8 of the 36 bytes of a row
    return max(8, min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), size >> 20), -(-size // BUCKET_BYTES))


def _some_tasks(df: DataFrame, n: int, each: int = 500) -> DataFrame:
    """df of n rows in as many partitions as its rows ask for, where Spark would make more: Python starts in each."""
    tasks = max(8, n // each)
    return df.coalesce(tasks) if tasks < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def link_texts(docs: DataFrame, n: int = N, percent: int = PERCENT, few: int = FEW, buckets: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id that links reach).

    Words are runs of characters other than white space, A-Z lower-cased; a text with fewer than n
    words is one n-gram, one without words or null has none and links with nothing. Rows that
    share a doc_id are one document of several versions and so linked with each other; null sorts
    before all ids and is a document too. A text of any length is one set, held whole by a task.
    Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    counts = gram_counts(keyed, n)

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, s in zip(b["id"], gram_sets(b["text"].tolist(), n), strict=True):
                size = len(s)
                first = _rare_first(s, counts)[: size - -(-size * percent // 100) + 1] if size * (100 - percent) >= percent else s[:0]  # smaller sets link with none but equals
                rows.append((i, size, *set_key(s), first.tobytes(), sketch(s) if len(first) else b"", parities(s)))
            yield pd.DataFrame(rows, columns=["id", "n", "a", "b", "prefix", "sketch", "cells"])

    def make_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, s.tobytes()) for i, a, z, s in zip(b["id"], b["a"], b["b"], gram_sets(b["text"].tolist(), n), strict=True) if set_key(s) == (a, z)]
            yield pd.DataFrame(rows, columns=["node", "grams"])

    seen = stored(keyed.mapInPandas(prefixes, "id long, n int, a long, b long, prefix binary, sketch binary, cells binary"), "prefixes")
    nodes = stored(seen.where("n > 0").groupBy("a", "b", "n").agg(F.min(F.struct("id", "prefix", "sketch", "cells")).alias("m")).select("a", "b", "n", F.col("m.id").alias("node"), F.col("m.prefix").alias("prefix"), F.col("m.sketch").alias("sketch"), F.col("m.cells").alias("cells")), "nodes")

    ends = lambda df: df.select(F.col("x").alias("node")).union(df.select("y")).distinct()
    of_node = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    length_class = F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) / F.lit(float(np.log(100 / percent))) + F.lit(1e-9)).cast("int")

    def sketched(pairs: DataFrame) -> DataFrame:
        joined = few_rows(pairs).join(of_node("x"), "x").join(of_node("y"), "y")
        return _some_tasks(joined, pairs.count(), 5000).mapInPandas(_may_link(percent), "x long, y long, hub boolean")

    def sets_of(pairs: DataFrame) -> DataFrame:
        used = stored(ends(gathered(pairs.select("x", "y"))).join(nodes.select("node", "a", "b"), "node").withColumnRenamed("node", "id"), "used")
        return stored(keyed.join(few_rows(used), "id").mapInPandas(make_sets, "node long, grams binary"), "sets")

    whole = nodes.where("length(prefix) > 0").select("node", "n", F.col("n").alias("d"), F.col("prefix").alias("keys"), "cells")
    rows = whole.withColumn("part", F.col("node"))
    known, done, sets, level = None, None, None, 0
    while True:
        stage = min(level, _DIFFERENCES)
        now = few if stage < _DIFFERENCES else max(few, FEW_DIFFERENCES) << 2 * (level - _DIFFERENCES)
        own = buckets or _bucket_count(rows)
        dealt = rows.mapInPandas(_dealer(own, max(FEW_IN_BATCH, now)), _ROWS)
        grouped = stored(dealt.groupBy("bucket").applyInPandas(_groups(percent, now, stage), _OUT), "groups")
        n_grouped = grouped.count()
        members = grouped.where(f"kind = {_MEMBER}").select("key", F.col("x").alias("member"), length_class.alias("own"))
        hubs = grouped.where(f"kind = {_HUB}").select("key", F.col("x").alias("hub_node"), F.col("n").alias("class"))
        apart = members.join(hubs, "key").where("(own = class or own = class + 1) and member != hub_node").select(F.col("member").alias("x"), F.col("hub_node").alias("y"))
        of_hub = grouped.where(f"kind = {_OF_HUB}").select("x", "y").union(apart).withColumn("hub", F.lit(stage != _HUBS))
        pairs = grouped.where(f"kind = {_PAIR}").select("x", "y", F.lit(False).alias("hub"))
        if stage == _HUBS:
            tried = stored(gathered(pairs.union(of_hub), n_grouped).distinct(), "tried")
            pairs = stored(sketched(tried), "pairs")
        else:
            tried = stored(gathered(pairs, n_grouped).distinct().join(gathered(done), ["x", "y"], "left_anti"), "tried")
            pairs = stored(sketched(tried).union(gathered(of_hub, n_grouped).distinct()), "pairs")
        before = sets
        if stage == _DIFFERENCES:  # these levels concern members of large groups alone
            sets = stored(sets.join(ends(pairs), "node"), "sets")
        else:
            sets = sets_of(pairs)
        of_x, of_y = (sets.select(F.col("node").alias(c), F.col("grams").alias(f"set_{c}")) for c in "xy")
        fetched = few_rows(pairs).join(of_y, "y").join(of_x, "x").select("x", "y", "hub", "set_x", "set_y")
        checked = stored(_some_tasks(fetched, pairs.count()).mapInPandas(_verify(percent, counts), _CHECKED), "checked")
        links = checked.where("linked and keys is null" if stage == _SETS else "linked").select(F.col("x").alias("u"), F.col("y").alias("v"))  # hubs of sets were known before
        if known is None or not links.isEmpty():
            known = components(links if known is None else links.union(known.where("node != component")))
        last = rows
        if stage == _HUBS:  # the same prefixes once more, with components
            done = pairs.select("x", "y")
            rows = whole.join(few_rows(known), "node", "left").select("node", "n", "d", "keys", "cells", F.coalesce("component", "node").alias("part"))
        else:
            done = done.union(pairs.where("not hub").select("x", "y"))
            differ = checked.where("keys is not null").join(known, F.col("x") == F.col("node"), "left").withColumn("part", F.coalesce("component", "x"))
            several = differ.groupBy("y").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo != hi").select("y")
            open_rows = differ.select("x", "y", "n", "d", "part", "keys").join(several, "y").select(F.col("x").alias("node"), "n", "d", "keys", "part")
            rows = stored(open_rows.join(nodes.select("node", "cells"), "node"), "rows")
        forget(grouped, checked, *([] if before is None else [before]), *([last] if level > 1 else []))
        level += 1
        if rows.isEmpty():
            break
    forget(sets)

    placed = seen.select("id", "n", "a", "b").join(nodes.select("a", "b", "n", "node"), ["a", "b", "n"], "left").select("id", "n", F.coalesce("node", "id").alias("node"))
    repeated = stored(seen.where("n > 0").groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id"), "repeated")
    if not repeated.isEmpty():
        versions = placed.where("n > 0").join(repeated, "id").groupBy("id").agg(F.collect_set("node").alias("nodes")).where("size(nodes) > 1").select(F.explode("nodes").alias("u"), F.array_min("nodes").alias("v"))
        known = components(known.select(F.col("node").alias("u"), F.col("component").alias("v")).union(stored(versions, "versions")))
    joined = placed.join(known, "node", "left")
    real = lambda c: F.when(c != _LEAST, c)
    return joined.select(real(F.col("id")).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), real(F.coalesce("component", "node")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """The documents that are the smallest of their component, columns as in the input.

    Null and empty texts link with nothing and stay, rows that repeat an id and a text stay or go
    together, and so do all versions of an id; a null id is the smallest of all. No name of a
    column clashes with those used here; an empty table gives an empty table.
    """
    gone = fresh(docs, "gone")
    linked = stored(link_texts(docs, n, percent).where("not doc_id <=> component_id").select(F.col("doc_id").alias(gone)).distinct(), "gone")
    return docs.join(few_rows(linked), docs["doc_id"].eqNullSafe(F.col(gone)), "left_anti")
