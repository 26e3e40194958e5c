"""N-gram join, suffix dedup and line dedup against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from brute import jaccard_components, repeated_bytes, shared_lines
from touchline.llm import line_dedup, ngram_join, suffix_dedup

VOCABULARY = [f"{a}{b}{c}" for a in ("Th", "on", "éa", "st") for b in ("er", "in", "o") for c in ("", "d", "ly", "ing", "ß")]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(["q", "RR", rng.choice(VOCABULARY), f"x{rng.randrange(99)}"])
    return " ".join(w)


def corpus(seed, n=160, hot=60):
    """Copies, near copies in a hot group, shared passages, short, empty and null texts."""
    rng = random.Random(seed)
    base = [prose(rng, rng.choice([4, 9, 12, 40, 150, 400])) for _ in range(12)]
    passage, template = prose(rng, 60), prose(rng, 130)
    texts = [None, "", " \n ", "a", "A", "a b", "a b c", "a B  c\n", "x" * 99, "y" * 300]
    for _ in range(hot):
        texts.append(edited(rng, template, rng.randint(0, 7)))
    while len(texts) < n:
        t = rng.choice(base)
        kind = rng.random()
        texts.append(t if kind < 0.2 else edited(rng, t, rng.randint(1, 4)) if kind < 0.6 else f"{prose(rng, 20)}\n{passage}\n{prose(rng, rng.randint(1, 80))}" if kind < 0.8 else prose(rng, rng.randint(1, 200)))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.fixture
def small_groups(monkeypatch):
    """Makes groups count as large, so that hubs, differences and summaries are used."""
    monkeypatch.setattr(ngram_join, "FEW_IN_BATCH", 6)
    monkeypatch.setattr(suffix_dedup, "FEW_REGIONS", 2)
    monkeypatch.setattr(suffix_dedup, "ORDERED_AT_ONCE", 90)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)


SCHEMA = "doc_id long, text string, n int, id string, sub string, key string, x int"


def frame(spark, docs, partitions=5):
    return spark.createDataFrame([(d, t, 1, "c", "c", "c", 2) for d, t in docs], SCHEMA).repartition(partitions)


@pytest.mark.parametrize(("n", "percent", "few", "seed"), [(3, 90, 3, 1), (3, 90, 64, 2), (5, 80, 4, 3), (1, 60, 5, 4)])
def test_join_equals_all_pairs(spark, small_groups, n, percent, few, seed):
    docs = corpus(seed)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "23")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_texts(frame(spark, docs), n, percent, few, buckets=7).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == jaccard_components(dict(docs), n, percent)


@pytest.mark.parametrize("batches", [1, 5])
def test_rows_of_a_group_grow_with_its_size(batches):
    """Nodes that share ten prefix n-grams: rows by hubs, then none where all are linked, then few where they are apart."""

    def rows(m, stage, part, few=ngram_join.FEW):
        rng = np.random.default_rng(m)
        grams = rng.integers(0, 1 << 63, 10).astype("<u8")
        payloads = []
        for own in np.array_split(np.arange(m), batches):
            node = np.repeat(own, 10)
            place = np.tile(np.arange(10), len(own)).astype("<i4")
            of = lambda v, kind: np.full(len(node), v, kind)
            columns = [grams[place], node.astype("<i8"), of(100, "<i4"), of(100 if stage < ngram_join._DIFFERENCES else 20, "<i4"), place, part(node).astype("<i8"), of(0, "<u8"), of(0, "<u8")]
            payloads += ngram_join._deal(columns, 1, ngram_join.FEW_IN_BATCH)
        out = ngram_join._groups(80, few, stage)(pd.DataFrame(payloads, columns=["bucket", "kind", "payload"]))
        return len(out)

    for stage in (ngram_join._HUBS, ngram_join._SETS, ngram_join._DIFFERENCES):
        sizes = {m: rows(m, stage, lambda node: node % 3) for m in (12, 60, 300, 3000)}
        assert all(n <= 33 * m for m, n in sizes.items()), sizes  # pairs of up to 64 nodes apart, hubs or members of each of the ten n-grams
        assert rows(3, stage, lambda node: node) > 0
    assert all(ngram_join._groups(80, 8, ngram_join._SETS) is not None and rows(m, ngram_join._SETS, lambda node: node * 0) <= 10 * m for m in (12, 60))
    assert rows(30, ngram_join._SETS, lambda node: node * 0) == 0


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(1)
    for n in (1, 2, 63, 64, 65, 500, 3000):
        x = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        for kept, added in ((n, 0), (n, 1), (n - n // 10, 5), (n // 2, 2 * n), (0, n)):
            y = np.unique(np.append(x[:kept], rng.integers(0, 1 << 64, added, np.uint64)))
            bound, difference = ngram_join.sketch_bound(ngram_join.sketch(x), ngram_join.sketch(y)), len(np.setxor1d(x, y))
            assert bound <= difference
            assert bound == difference or difference > 1
            if kept == 0 and n >= 500:
                assert bound > ngram_join.slack(np.array(n), np.array(n), 80)  # unrelated sets of one size go


def test_texts_that_share_all_and_never_link_make_no_pairs(spark, monkeypatch):
    """Random texts over seven words: every level with its own bounds. Rows go with nodes and their n-grams, not with pairs of nodes."""
    rng, m, kinds = random.Random(5), 240, []
    kept = ngram_join.stored

    def counted(df, name):
        out = kept(df, name)
        if name == "groups":
            kinds.append({r.kind: r["count"] for r in out.groupBy("kind").count().collect()})
        return out

    monkeypatch.setattr(ngram_join, "stored", counted)
    docs = [(i, " ".join(rng.choice("abcdefg") for _ in range(300))) for i in range(m)]
    grams = max(len(g) for g in ngram_join.gram_sets([t for _, t in docs], 3))
    got = ngram_join.link_texts(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), 3, 90)
    assert got.where("doc_id != component_id").isEmpty() and len(kinds) >= 3
    assert all(k.get(ngram_join._PAIR, 0) <= 0.01 * m * m / 2 and sum(k.values()) <= 2 * m * grams for k in kinds), kinds


@pytest.mark.parametrize("seed", [5, 6])
def test_suffix_dedup_equals_brute_force(spark, small_groups, seed):
    docs = corpus(seed)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "23")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(frame(spark, docs), buckets=7).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == repeated_bytes(docs)


@pytest.mark.parametrize("letters", [2, 4, 256])
def test_previous_factors(letters):
    """Against every pair of suffixes."""
    rng = np.random.default_rng(letters)
    data = rng.integers(0, letters, 400).astype(np.uint8)
    data[250:330] = data[40:120]
    windows = np.lib.stride_tricks.sliding_window_view(data, 30)
    position = rng.permutation(len(windows))
    common = lambda x, y: next((i for i in range(30) if x[i] != y[i]), 30)
    want = [max((common(x, y) for y, q in zip(windows, position) if q < p), default=0) for x, p in zip(windows, position)]
    assert suffix_dedup.previous_factors(windows, position).tolist() == want


@pytest.mark.parametrize("few", [0, 4])
def test_suffix_dedup_by_names_and_by_bytes(spark, monkeypatch, few):
    """With no cold anchor all windows go by name, with few hot ones by their bytes: the results are the same."""
    monkeypatch.setattr(suffix_dedup, "FEW_REGIONS", few)
    docs = corpus(9, 90, 30)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(frame(spark, docs), buckets=3).collect()}
    assert got == repeated_bytes(docs)


def test_an_anchor_of_every_batch_is_spread(monkeypatch):
    """One region of an anchor in each batch: beyond what is ordered at once, its windows are dealt by name."""
    rng = random.Random(12)
    common = "".join(rng.choice("abcdefgh") for _ in range(96))
    texts = ["".join(rng.choice("ijklmnop") for _ in range(80)) + common + "".join(rng.choice("ijklmnop") for _ in range(80)) for _ in range(300)]

    def hot_share():
        rows = pd.concat(x for i, t in enumerate(texts) for x in suffix_dedup._runs(3)(iter([pd.DataFrame({"id": [i], "sub": [0], "text": [t]})])))
        found = pd.concat(suffix_dedup._by_anchor(g) for _, g in rows.groupby("bucket"))
        asked = found[found["asked"]]
        return len(asked), asked["hot"].mean(), asked[~asked["hot"]].groupby("anchor")["run"].agg(lambda r: int((r & 255).sum())).max()

    n, share, _ = hot_share()
    assert n >= 300 and share == 0  # few enough to be ordered at once
    monkeypatch.setattr(suffix_dedup, "ORDERED_AT_ONCE", 3000)
    n, share, largest = hot_share()
    assert n >= 300 and share > 0.5 and not largest > 3000


@pytest.mark.parametrize("n", [1, 2, 50, 400])
def test_smaller_positions_of_all_shapes(n):
    rng = np.random.default_rng(n)
    rising_falling = np.concatenate([np.arange(0, n, 2), np.arange(1, n, 2)[::-1]])
    for position in (rng.permutation(n), rising_falling, np.arange(n), np.arange(n)[::-1].copy()):
        common = rng.integers(0, 100, n)
        common[0] = 0
        want = []
        for i in range(n):
            j, shared = i - 1, common[i]
            while j >= 0 and position[j] > position[i]:
                shared, j = min(shared, common[j]), j - 1
            want.append(shared if j >= 0 else 0)
        assert suffix_dedup.smaller_before(position, common).tolist() == want


def test_suffix_dedup_of_sample(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == repeated_bytes(sorted(docs))


def test_suffix_dedup_gives_texts(spark):
    text = "a passage " * 3 + "".join(map(str, range(120)))
    rows = suffix_dedup.remove_repeats(frame(spark, [(1, text), (2, "head " + text)], 1), with_text=True).orderBy("doc_id").collect()
    assert bytes(rows[0].kept) == text.encode() and bytes(rows[1].kept) == b"head "
    assert (rows[1].starts, rows[1].ends) == ([5], [5 + len(text)])


def test_repeated_rows_and_null_ids(spark):
    long = prose(random.Random(7), 60)
    docs = [(None, long), (3, long), (3, long), (3, "other " + long), (None, None), (4, None)]
    rows = suffix_dedup.remove_repeats(frame(spark, docs)).collect()
    assert len(rows) == 6
    assert sorted((r.doc_id is None, r.doc_id, r.n_removed > 0) for r in rows if r.doc_id is not None)[:1] == [(False, 3, True)]
    assert [r.n_removed for r in rows if r.doc_id is None] == [0, 0]
    linked = ngram_join.link_texts(frame(spark, docs), 3, 90).collect()
    assert len(linked) == 6 and {r.component_id for r in linked if r.n_shingles} == {None}
    assert {(r.doc_id, r.component_id) for r in linked if not r.n_shingles} == {(None, None), (4, 4)}


def test_very_long_texts(spark):
    """Texts of some megabytes: two near copies that share all lines but one, with a test item at the end of the first."""
    from touchline.llm import decontaminate, sharding

    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(5000)])[rng.integers(0, 5000, 400_000)]
    lines = [" ".join(words[i : i + 25]) for i in range(0, len(words), 25)]
    item = "what is the name of the river that crosses this town\nthe long river of the north"
    docs = [(1, "\n".join([*lines, item])), (2, "\n".join([*lines[:8000], "a line of its own", *lines[8000:]])), (3, "short"), (4, None)]
    df = frame(spark, docs, 2)
    linked = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_texts(df).collect()}
    assert linked[2][1] == 1 and linked[1][0] > 390_000 and linked[3] == (1, 3) and linked[4] == (0, 4)
    deduped = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert deduped[1].n_removed == 0 and deduped[2].n_removed == 16_000 and deduped[2].text == "a line of its own"
    leaks = decontaminate.find_leaks(df, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in leaks] == [(1, 7)]
    assert sharding.shard_rows(df, ["doc_id", "text"], 3).count() == 4


def test_empty_tables(spark):
    empty = frame(spark, []).coalesce(1)
    assert ngram_join.link_texts(empty, 3, 90).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0


def test_keep_one_keeps_columns(spark):
    long = prose(random.Random(8), 60)
    kept = ngram_join.keep_one(frame(spark, [(1, long), (2, long), (3, edited(random.Random(9), long, 1)), (4, "b"), (5, None)]))
    assert kept.columns == ["doc_id", "text", "n", "id", "sub", "key", "x"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5]


def lines(rng, n, words=8):
    return [prose(rng, words) for _ in range(n)]


def moved_lines(later, earlier, words, min_words):
    """Places in `later` of lines in runs that `earlier` has as well, by sets of runs: no alignment."""
    own = [i for i, x in enumerate(later) if x]
    mine, other = [later[i] for i in own], [x for x in earlier if x]
    blocks = lambda lines, size: {(i, j): tuple(lines[i:j]) for i in range(len(lines)) for j in range(i + 1, len(lines) + 1) if sum(size.get(x, 1) for x in lines[i:j]) >= min_words}
    size = dict(zip(mine, (words[i] for i in own), strict=True))
    known = set(blocks(other, size).values())
    return sorted({own[k] for (i, j), b in blocks(mine, size).items() if b in known for k in range(i, j)})


def random_pair(rng):
    size = {k: rng.choice([3, 8, 12, 25]) for k in range(1, 9)} | {0: 0}
    earlier = [rng.randrange(9) for _ in range(rng.randint(0, 14))]
    later = [rng.randrange(9) for _ in range(rng.randint(0, 14))]
    if rng.random() < 0.5 and len(earlier) > 4:
        i, j = sorted(rng.sample(range(len(earlier)), 2))
        later = later[:3] + earlier[j:] + later[3:6] + earlier[i:j] + later[6:] + earlier[i:j]
    return later, earlier, [size[x] for x in later]


def test_alignment_finds_all_common_blocks(monkeypatch):
    rng = random.Random(14)
    pairs = [random_pair(rng) for _ in range(1500)]
    want = [moved_lines(*p, 20) for p in pairs]
    assert [line_dedup.common_lines(*p, 20) for p in pairs] == want and sum(map(bool, want)) > 500
    reverse = list(range(1, 400))
    assert line_dedup.common_lines(reverse[::-1], reverse, [25] * 399, 20) == list(range(399))
    monkeypatch.setattr(line_dedup, "patience", lambda a, b: [])
    assert not any(line_dedup.common_lines(*p, 20) for p in pairs)  # nothing goes that was not aligned


def test_patience():
    assert line_dedup.patience(list("abcxdef"), list("abcydef")) == [(0, 0), (1, 1), (2, 2), (4, 4), (5, 5), (6, 6)]
    assert line_dedup.patience(list("qabz"), list("abq")) == [(1, 0), (2, 1)]
    assert line_dedup.patience([], list("ab")) == []
    assert [p for p in line_dedup.patience(list("xxaxx"), list("yaxy"))] == [(2, 1), (3, 2)]


def test_line_dedup(spark):
    rng = random.Random(11)
    shared, own = lines(rng, 4), [lines(rng, 3) for _ in range(6)]
    short = "All rights reserved."
    docs = [
        (10, "\n".join([*own[0], *shared, short])),
        (11, "\n".join([*own[1], "", *shared[:3], own[2][0], short])),
        (12, "\n".join([*own[0], *shared, short])),  # a copy
        (13, "\n".join([*own[3], short])),
        (14, shared[0] + "\n" + own[4][0]),  # one shared line of eight words
        (15, None),
        (16, ""),
        (9, "\n".join(own[5])),
    ]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, docs)).collect()}
    assert {d: r.n_removed for d, r in got.items()} == {9: 0, 10: 0, 11: 3, 12: 8, 13: 0, 14: 0, 15: 0, 16: 0}
    assert got[11].text == "\n".join([*own[1], "", own[2][0], short])
    assert got[12].text == "" and got[15].text is None and got[10].text == dict(docs)[10]
    assert got[11].n_lines == 8 and got[11].x == 2


@pytest.mark.parametrize("rare", [1, 100])
def test_line_dedup_of_large_group(spark, rare):
    """Near copies whose lines are all frequent are found through pairs of lines."""
    rng = random.Random(12)
    template = lines(rng, 6, 12)
    docs = [(d, "\n".join([*template[:3], f"line of {d} alone", *template[3:]])) for d in range(40)]
    got = line_dedup.dedup_lines(frame(spark, docs), rare=rare).collect()
    assert sorted(r.n_removed for r in got) == [0] + [6] * 39


def test_line_dedup_of_frequent_long_line(spark):
    """A passage of one line goes from all texts but one, however many hold it and whatever stands beside it."""
    rng = random.Random(14)
    passage = prose(rng, 60)
    docs = [(d, f"{d} begins {prose(rng, 9)}\n{passage}\n{d} ends {prose(rng, 9)}") for d in range(150)]
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(frame(spark, docs)).collect()}
    assert got == {d: int(d > 0) for d in range(150)}


def test_common_lines_that_repeat_or_cross():
    w = {1: 30, 2: 25, 3: 8, 4: 9, 5: 7, 6: 3, 7: 3}
    common = lambda later, earlier: line_dedup.common_lines(later, earlier, [w[x] for x in later], 20)
    assert common([1, 6, 1], [7, 1, 6]) == [0, 1, 2]
    assert common([1, 6, 1], [7, 1, 7]) == [0, 2]
    assert common([7, 1, 7], [1, 6, 1]) == [1]
    assert common([2, 6, 1], [1, 7, 2]) == [0, 2]
    assert common([3, 4, 5, 6, 3, 4, 5], [7, 3, 4, 5, 7]) == [0, 1, 2, 4, 5, 6]
    assert common([3, 4, 6, 5], [3, 4, 5]) == []


def test_line_dedup_of_passage_in_parts(spark):
    """The first holders of the lines and pairs of lines of a passage are not the document that has all of it."""
    rng = random.Random(15)
    p, own = lines(rng, 3), lines(rng, 9)
    docs = list(enumerate(["\n".join(x) for x in ([p[0], p[1], own[0]], [own[1], p[1], p[2]], [own[2], *p, own[3]], [own[4], *p, own[5]])]))
    assert {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(frame(spark, docs)).collect()} == {0: 0, 1: 0, 2: 0, 3: 3}


@pytest.mark.parametrize(("seed", "rare", "at_once"), [(16, 100, 1 << 17), (17, 2, 5)])
def test_line_dedup_equals_brute_force(spark, monkeypatch, seed, rare, at_once):
    monkeypatch.setattr(line_dedup, "LINES_AT_ONCE", at_once)
    rng = random.Random(seed)
    pool = ["", " ", *lines(rng, 9, 24), *(prose(rng, rng.randint(1, 12)) for _ in range(25))]
    docs = [(d, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))) for d in range(250)]
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(frame(spark, docs), rare=rare).collect()}
    assert got == shared_lines(docs)


def test_no_line_is_lost_from_the_corpus(spark):
    rng = random.Random(13)
    pool = lines(rng, 30, 21)
    docs = [(d, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6)))) for d in range(80)]
    got = line_dedup.dedup_lines(frame(spark, docs)).collect()
    before = {x for _, t in docs for x in t.split("\n")}
    assert {x for r in got for x in r.text.split("\n") if x} == before
    assert sum(r.n_removed for r in got) > 50
