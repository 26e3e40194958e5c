"""Decontamination, packing and the pipeline."""

import random
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from brute import dedup_text, jaccard_components
from pyspark.sql import functions as F
from test_dedup import edited, prose
from test_rules import plain_quality
from touchline.llm import decontaminate, packing, queries, sharding, url_filter

DOCS = "doc_id long, text string, item_id long, score string"


def items(rng, n):
    return [(i, f"{prose(rng, rng.randint(12, 40))}.\n{prose(rng, rng.randint(5, 20))}.") for i in range(n)]


def test_leaks_are_found_and_clean_texts_left(spark):
    rng = random.Random(21)
    bench = items(rng, 40)
    docs, leaked = [], {}
    for d in range(120):
        text = prose(rng, rng.randint(0, 300))
        if d % 3 == 0:
            i, t = rng.choice(bench)
            t = t.upper() if d % 2 else t.replace(" ", "  ")
            cut = rng.randint(0, len(text))
            text, leaked[d] = f"{text[:cut]} {t}\n{text[cut:]}", i
        docs.append((d, text))
    docs += [(500, None), (501, ""), (None, bench[0][1]), (502, bench[1][1]), (502, bench[1][1]), (503, " ".join(bench[2][1].split()[:6]))]
    df = spark.createDataFrame([(d, t, 1, "s") for d, t in docs], DOCS).repartition(3)
    bench_df = spark.createDataFrame([*bench, (900, None), (901, "")], "item_id long, text string")
    want = {(d, i) for d, i in leaked.items()} | {(None, 0), (502, 1)}
    for max_items in (1000, 15):
        rows = decontaminate.find_leaks(df, bench_df, max_items=max_items).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == want
        assert len(rows) == len(want) + 1 and all(r.score > 0.8 for r in rows)
    left = decontaminate.drop_leaks(df, bench_df)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted({d for d, _ in docs if d is not None} - set(leaked) - {502})
    assert decontaminate.find_leaks(df.where("false"), bench_df).count() == 0 == decontaminate.find_leaks(df, bench_df.where("false")).count()


def test_near_copies_of_items(spark):
    rng = random.Random(22)
    bench = items(rng, 10)
    w = bench[3][1].split(" ")
    w[len(w) // 2] = "changed"
    df = spark.createDataFrame([(1, prose(rng, 100) + " " + " ".join(w) + " " + prose(rng, 100))], "doc_id long, text string")
    got = decontaminate.find_leaks(df, spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert [r.item_id for r in got] == [3]


def test_questions_without_answers_are_found(spark):
    rng = random.Random(24)
    bench = [(i, f"{prose(rng, 24)}.\n{prose(rng, n)}.") for i, n in enumerate((5, 12, 30, 90))] + [(4, prose(rng, 30)), (5, f"Which one?\n{prose(rng, 30)}")]
    questions = [decontaminate.question_and_answer(t)[0] for _, t in bench]
    docs = [(i, f"{prose(rng, 80)} {q} {prose(rng, 80)}") for i, q in enumerate(questions)]
    rows = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(i, i) for i in range(5)]  # a question of two words is none by itself
    assert all(r.question_overlap == 1 for r in rows)


def test_passes_change_no_result(spark):
    """Items of all lengths, half copied: what is found, where and with what score is the same in one pass and in many."""
    rng = random.Random(25)
    bench = [(i, f"{prose(rng, rng.randint(6, 20))}.\n{prose(rng, rng.randint(3, 20))}.") for i in range(60)] + [(60, prose(rng, 150)), (61, None)]
    docs = []
    for d in range(150):
        w = rng.choice(bench[:61])[1].split()
        cut = max(1, int(len(w) * rng.uniform(0.4, 1)))
        docs.append((d, f"{prose(rng, rng.randint(0, 90))} {edited(rng, ' '.join(w[:cut]), rng.randint(0, 1))} {prose(rng, rng.randint(0, 90))}"))
    df, bench_df = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    one, many = ({(r.doc_id, r.item_id): (round(r.score, 9), r.first_word, r.question_overlap, r.answer_overlap) for r in decontaminate.find_leaks(df, bench_df, max_items=n).collect()} for n in (1000, 9))
    assert len(one) > 60 and one == many


def test_skipping_misses_nothing():
    """Block-max skipping retrieves what scoring every item does."""
    rng = random.Random(23)
    bench = [(i, prose(rng, rng.randint(3, 30))) for i in range(100)]
    index = decontaminate.Index(bench, threshold=0.45)
    for _ in range(300):
        i, t = rng.choice(bench)
        w = t.split() if rng.random() < 0.7 else prose(rng, 40).split()
        window = set(decontaminate.words_of(" ".join(rng.sample(w, max(1, int(len(w) * rng.random()))) + prose(rng, 20).split())))
        full = {i: s for i in range(len(index.ids)) if (s := sum(index.impact[t].get(i, 0.0) for t in window if t in index.impact)) >= 0.45}
        got = dict(index.retrieve(window, {t for t in window if t in index.essential}))
        assert got.keys() == full.keys()


def plain_leaks(docs, bench):
    """(doc_id, item_id) of every item of which a passage holds 0.8 of the shingles, or of its question's: all passages against all items."""
    words = lambda t: decontaminate.words_of(t or "")
    stride = max((len(words(t)) for _, t in bench), default=1)
    parts = [(i, decontaminate.shingles(words(t)), decontaminate.shingles(words(decontaminate.question_and_answer(t)[0]))) for i, t in bench if words(t)]
    found = set()
    for d, t in docs:
        w = words(t)
        for a in range(0, max(1, len(w)), stride):
            passage = w[a : a + 2 * stride]
            for i, whole, question in parts:
                held = lambda s: sum(any(tuple(passage[k : k + len(x)]) == x for k in range(len(passage))) for x in s) / len(s)
                if held(whole) >= 0.8 or (question and min(map(len, question)) >= 5 and held(question) >= 0.8):
                    found.add((d, i))
    return found


def test_leaks_equal_all_passages_against_all_items(spark):
    rng = random.Random(26)
    bench = [(i, f"{prose(rng, rng.randint(4, 14))}.\n{prose(rng, rng.randint(2, 8))}.") for i in range(25)]
    docs = []
    for d in range(60):
        w = rng.choice(bench)[1].split()
        docs.append((d, f"{prose(rng, rng.randint(0, 40))} {edited(rng, ' '.join(w[: max(1, int(len(w) * rng.uniform(0.5, 1)))]), rng.randint(0, 1))} {prose(rng, rng.randint(0, 40))}"))
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    want = plain_leaks(docs, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) > 15


def test_index_loads_without_the_package():
    """What is sent to executors can be read in a folder that has no copy of the library."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    sent = cloudpickle.dumps(decontaminate.Index([(7, "one two three four five six seven.\nEight nine.")]))
    code = "import pickle, sys; i = pickle.loads(sys.stdin.buffer.read()); print([m[0] for m in i.matches('zero one two three four five six seven eight nine ten')], 'touchline' in sys.modules)"
    out = subprocess.run([sys.executable, "-I", "-c", code], input=sent, capture_output=True, cwd="/")
    assert out.stdout.decode().split() == ["[7]", "False"], out.stderr.decode()[-500:]


@pytest.mark.parametrize("capacity", [10, 37, 4096])
def test_plans_are_valid(capacity):
    rng = np.random.default_rng(capacity)
    for case in range(60):
        lengths = rng.integers(1, capacity + 1 if case % 2 else max(2, capacity // 3), int(rng.integers(1, 80)))
        histogram = {int(n): int((lengths == n).sum()) for n in set(lengths.tolist())}
        plan = packing.Plan(dict(histogram), capacity)
        placed, seen = defaultdict(list), defaultdict(int)
        for n, rank, count, first, per, offset in plan.segments:
            assert rank == seen[n]
            seen[n] += count
            for k in range(count):
                placed[first + k // per].append((offset + k % per * n, n))
        assert dict(seen) == histogram and set(placed) == set(range(plan.sequences))
        for own in placed.values():
            at = 0
            for offset, n in sorted(own):
                assert offset == at
                at += n
            assert at <= capacity
        assert plan.sequences <= 2 * -(-int(lengths.sum()) // capacity)


def best(lengths, capacity):
    """The least number of sequences, by trying everything."""
    lengths = sorted(lengths, reverse=True)
    least = len(lengths)

    def go(i, rooms):
        nonlocal least
        if len(rooms) >= least:
            return
        if i == len(lengths):
            least = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[i] and rooms[k] not in rooms[:k]:
                go(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - lengths[i]])

    go(0, [])
    return least


def test_reduction_keeps_the_optimum():
    rng = np.random.default_rng(5)
    for _ in range(150):
        lengths = rng.integers(2, 20, int(rng.integers(2, 10))).tolist()
        plan = packing.Plan({n: lengths.count(n) for n in set(lengths)}, 20)
        rest = lengths[:]
        for n, _, count, first, *_ in plan.segments:
            if first < plan.fixed:
                for _ in range(count):
                    rest.remove(n)
        assert plan.fixed + best(rest, 20) == best(lengths, 20), lengths


def test_packing_equals_tokenizer(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs += [(1000, None), (1001, ""), (1002, "Σas ΣΑΣ İ, Straße. don't é́ <|endoftext|>x 12,5 \x85\x1ca\tb "), (1003, "word, " * 9000), (None, "x"), (1004, "twin"), (1004, "twin")]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, piece int, length int").repartition(3)
    rows = packing.pack(df, path, with_ids=True).collect()
    want = defaultdict(int)
    for d, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for p, at in enumerate(range(0, len(ids), 4096)):
            own = ids[at : at + 4096]
            want[d, p, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    got = defaultdict(int)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32
    assert got == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 4096
    total = sum(r.length for r in rows)
    assert len(sequences) <= -(-total // 4096) + 2
    whole = packing.sequences(packing.pack(df, path, with_ids=True))
    assert sum(len(r.ids) for r in whole.collect()) == 4 * total
    assert packing.pack(df.where("false"), path).count() == 0


def test_pipeline(spark):
    rng = random.Random(31)
    bench = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{bench}/benchmark.parquet").orderBy("item_id").first().text
    clean = [prose(rng, 120) for _ in range(6)]
    passage = prose(rng, 60)
    rows = [
        (1, clean[0]), (2, clean[0]), (3, edited(rng, clean[0], 2)), (4, clean[1]), (5, f"{clean[2]}\n{passage}"), (6, f"{passage}\n{clean[3]}"),
        (7, f"{clean[4]} {item} {clean[5]}"), (8, "too short"), (9, "a b c " * 60), (10, None),
    ]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), 7) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, extra int")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, bench)
        kept[name] = {r.doc_id: r.text if "text" in docs.columns else None for r in docs.collect()}
        if name != "best_fit_packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra"]
    assert set(kept["quality_rules"]) == {1, 2, 3, 4, 5, 6, 7}
    assert set(kept["line_dedup"]) == {1, 3, 4, 5, 6, 7} and kept["line_dedup"][6] == clean[3] and kept["line_dedup"][5] == rows[4][1]
    assert set(kept["near_duplicates"]) == {1, 4, 5, 6, 7}
    assert set(kept["decontamination"]) == {1, 4, 5, 6}
    assert set(kept["best_fit_packing"]) == {1, 4, 5, 6}


def test_pipeline_equals_plain(spark, tmp_path):
    """All stages on a small corpus against plain versions of their operators, one after the other."""
    from tokenizers import Tokenizer

    rng = random.Random(33)
    bench = [(i, f"{prose(rng, 30)}.\n{prose(rng, 12)}.") for i in range(8)]
    passages, base = [prose(rng, 55) for _ in range(4)], [prose(rng, 140) for _ in range(6)]
    rows = []
    for d in range(90):
        kind = d % 6
        text = (
            rng.choice(base) if kind == 0
            else edited(rng, rng.choice(base), rng.randint(1, 4)) if kind == 1
            else f"{prose(rng, 70)}\n{rng.choice(passages)}\n{prose(rng, 40)}" if kind == 2
            else f"{prose(rng, 60)} {rng.choice(bench)[1]} {prose(rng, 20)}" if kind == 3
            else rng.choice([None, "", "too short", "a b c " * 40, "\n\n"]) if kind == 4
            else prose(rng, rng.randint(30, 200))
        )
        rows.append((d, text))
    frame = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    judged = plain_quality([(d, t, "s") for d, t in rows], 100)
    docs = [(d, t) for d, t in rows if judged[d][-1]]
    left = dedup_text(docs)
    docs = [(d, left[d]) for d, _ in docs if left[d] != ""]
    linked = jaccard_components(dict(docs), 5, 80)
    docs = [(d, t) for d, t in docs if linked[d][1] == d]
    leaked = {d for d, _ in plain_leaks(docs, bench)}
    docs = [(d, t) for d, t in docs if d not in leaked]
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want = {(d, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for d, t in docs for ids in [[*tokenizer.encode(t, add_special_tokens=False).ids, 1]]}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in got} == want and 25 < len(want) < 60
    total = defaultdict(int)
    for r in got:
        total[r.sequence_id] += r.length
    assert max(total.values()) <= 4096 and len(total) <= -(-sum(total.values()) // 4096) + 1


#: Names that operators use for their own columns.
CLASHING = ("_id", "_hash", "_gone", "_keep", "_url", "gone", "leaked_id", "leaked_hash", "row", "sub", "first", "keep", "lines", "left", "hash", "own", "host", "removed", "cell", "rank", "segment", "segments", "h", "x", "node", "part", "n", "id")


def test_stages_with_clashing_names_nulls_and_repeats(spark):
    rng = random.Random(32)
    texts = [prose(rng, 120) for _ in range(3)]
    rows = [(1, texts[0]), (1, texts[0]), (None, texts[1]), (None, texts[1]), (3, texts[2]), (4, None), (5, ""), (6, " ".join(edited(rng, texts[2], 1).split())), (7, f"{texts[0]}\n{prose(rng, 90)}")]
    docs = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, source string")
    docs = docs.withColumns({c: F.lit(c) for c in CLASHING})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == columns, name
        assert all(r[c] == c for r in docs.collect() for c in CLASHING), name
    assert sorted((r.doc_id or 0, r.text) for r in docs.collect())[:2] == [(0, texts[1])] * 2
    assert {r.doc_id for r in docs.collect()} == {None, 1, 3, 7}
    sharded = sharding.shard_rows(docs, ["doc_id", "text"], 3)
    assert sharded.columns == [*columns, "shard", "slot"] and sharded.count() == docs.count()
    urls = url_filter.filter_urls(docs.withColumn("url", F.lit("http://a.com/en/1")).drop("host"), queries.URL_RULES)
    assert set(urls.columns) == {*columns, "url", "host", "path", "rule", "tier", "verdict"} and {r.verdict for r in urls.collect()} == {"block"}


def test_pipeline_of_empty_table(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").where("false").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
