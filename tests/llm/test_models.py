"""Spelling variants, toxicity and divergence of sources against plain versions and SQL."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from touchline.llm import divergence, queries, toxicity, variants

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, word string, n long, shard int"


def docs_of(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], DOCS).repartition(parts)


def equals_sql(spark, df, sql, rows):
    """df against its SQL over the same documents."""
    import duckdb
    import pyarrow as pa

    con = duckdb.connect()
    columns = dict(zip(("doc_id", "text", "lang", "source"), zip(*rows, strict=True), strict=True)) if rows else {c: [] for c in ("doc_id", "text", "lang", "source")}
    types = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string()}
    con.register("documents", pa.table({c: pa.array(v, types[c]) for c, v in columns.items()}))
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()
    got = [tuple(r) for r in df.select(*cols).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    return got


# Spelling variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    import re

    count = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate({i: i + 32 for i in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            count[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    out = {}
    for w, n in words.items():
        close = sorted((-m, v) for v, m in words.items() if v != w and near(w, v))
        form = close[0][1] if close and -close[0][0] >= 2 * n else None
        out[w] = [form, None, n, len(close), words[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row[1] = root
    return {(w, *r) for w, r in out.items()}


def spelled(seed=1, n=150):
    rng = random.Random(seed)
    base = ["colour", "Colours", "honour", "théâtre", "aaaaa", "banana", "ÀÿÀÿÀ", "straße"]
    letters = "abcé"

    def word():
        w = rng.choice(base)
        for _ in range(rng.choice((0, 0, 1, 1, 2))):
            i = rng.randrange(len(w))
            w = rng.choice((w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]))
        return w

    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 60))), "en", "s") for i in range(n)]
    return rows + [(None, "banana banana banana", None, None), (5, None, "en", "s"), (6, "", "en", "s"), (7, "colour " * 20000, "en", "s"), (7, "colour " * 20000, "en", "s")]


@pytest.mark.parametrize("shard_words, at_once, block_words", [(variants.SHARD_WORDS, 8, 1 << 15), (40, 2, 16)])
def test_variants(spark, shard_words, at_once, block_words):
    rows = spelled()
    got = variants.group_variants(docs_of(spark, rows), shard_words, at_once, block_words)
    seen = {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert seen == plain_variants(rows) and len(seen) > 100 and any(r[1] and r[2] != r[1] for r in seen)
    assert variants.group_variants(docs_of(spark, rows).where("false")).count() == 0


def test_variants_equal_their_sql(spark):
    equals_sql(spark, variants.group_variants(docs_of(spark, spelled(2, 60))), queries.OP11_SQL, spelled(2, 60))


def test_shards_are_bounded(spark):
    words = spark.range(10_000).select(F.concat(F.lit("word"), F.bin("id")).alias("word"), F.lit(3).cast("long").alias("n"))
    sizes = [r["count"] for r in variants.sharded(words, 1000).groupBy("shard").count().collect()]
    assert sum(sizes) == 10_000 and max(sizes) <= 2000 and len(sizes) >= 5


def test_automata_meet_tries():
    rng = random.Random(3)
    words = sorted({bytes(rng.choice(b"ab\xe9") for _ in range(rng.randint(1, 6))) for _ in range(500)})
    asked = words[::3] + [b"zzzzz", b"a" * 300]
    keys, ends = variants.build_trie(words)
    q, w = variants.near_words(asked, keys, ends)
    assert set(zip(q.tolist(), w.tolist(), strict=True)) == {(i, j) for i, a in enumerate(asked) for j, b in enumerate(words) if a != b and near(a, b)}
    none = variants.near_words(asked, *variants.build_trie([]))
    assert len(none[0]) == 0


# Toxicity


def toxic_rows(n=400, seed=5):
    rng = random.Random(seed)
    plain = [a + b for a in ("lor", "ips", "dol", "sit", "am", "con") for b in ("em", "um", "or", "et", "ne")]
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        words = [rng.choice(plain) for _ in range(rng.randint(30, 120))]
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), "vexgrub" + rng.choice(("a", "um", "en", "ort")))
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, int(bad)))
    odd = [(None, "lorem", "en", "s"), (n, None, "en", "s"), (n + 1, "", "en", "s"), (n + 2, "1 2 !", "en", "s"), (n + 3, "lorem ipsum " * 30000, "en", "s"), (3, rows[3][1], "en", "s"), (n + 4, "\U00020000\U00020001 lorem", "en", "s")]
    return rows + odd, labels + [(0, None), (None, 1), (3, 0), (3, 0)]


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_rows()
    docs, marks = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score_texts(docs, marks).collect()
    assert len(got) == len(rows)
    truth = {d: y for d, y in labels if y is not None and d is not None}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None) and len(held) > 50
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by_id = defaultdict(set)
    for r in got:
        by_id[r.doc_id].add(r.score)
    assert all(len(s) == 1 for s in by_id.values()) and by_id[None] and len({*by_id[400], *by_id[401], *by_id[402]}) == 1
    hidden = spark.createDataFrame([(d, y if d is None or zlib.crc32(str(d).encode()) % 5 else 1 - (y or 0)) for d, y in labels], "doc_id long, toxic int")
    assert sorted((str(r.doc_id), r.score) for r in toxicity.score_texts(docs, hidden).collect()) == sorted((str(r.doc_id), r.score) for r in got)
    joined = toxicity.score_texts(docs, marks, model_rows=0).collect()
    close = lambda a, b: all(x[0] == y[0] and math.isclose(x[1], y[1], abs_tol=1e-9) for x, y in zip(a, b, strict=True))
    assert close(sorted((str(r.doc_id), r.score) for r in joined), sorted((str(r.doc_id), r.score) for r in got))
    assert toxicity.score_texts(docs.where("false"), marks).count() == 0
    assert {r.predicted for r in toxicity.score_texts(docs, marks.where("false")).collect()} <= {0, 1}
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(r.score < 0.5 for r in got)


def plain_kneser_ney(texts, grams):
    """[log P] of the last letter of each gram under (ordinary, toxic) texts, by the recursion itself."""
    counts = [Counter(), Counter()]
    for text, c in texts:
        x = "   " + "".join(map(chr, toxicity.letters(text)))
        counts[c].update(x[i : i + 4] for i in range(len(x) - 3))
    tables = {4: counts}
    for k in (3, 2, 1):
        tables[k] = [Counter(g[1:] for g in t if t[g] > 0) for t in tables[k + 1]]
    size, total = len(set(tables[1][0]) | set(tables[1][1])), sum(tables[1][0].values()) + sum(tables[1][1].values())

    def p(g, c):
        if len(g) == 1:
            return (tables[1][0][g] + tables[1][1][g] + 1) / (total + size + 1)
        t = tables[len(g)][c]
        own = {x: n for x, n in t.items() if x[:-1] == g[:-1]}
        if not own:
            return p(g[1:], c)
        s = sum(own.values())
        return max(own.get(g, 0) - 0.75, 0) / s + 0.75 * len(own) / s * p(g[1:], c)

    return [[math.log(p(g, c)) for c in (0, 1)] for g in grams]


def test_model_equals_the_recursion(spark):
    rng = random.Random(7)
    texts = [("".join(rng.choice("abc é") for _ in range(rng.randint(0, 40))), int(i % 3 == 0)) for i in range(40)]
    model = toxicity.fit(toxicity.count_grams(spark.createDataFrame(texts, "text string, toxic int")))
    grams = ["".join(rng.choice("abcxé ") for _ in range(4)) for _ in range(300)]
    keys = np.array([sum(ord(ch) << (16 * (3 - i)) for i, ch in enumerate(g)) for g in grams], np.uint64)
    got = toxicity.Model(*toxicity.arrays(model.toPandas())).log_probabilities(keys)
    assert np.allclose(got, plain_kneser_ney(texts, grams))


# Divergence


def audited(n=400, seed=9):
    rng = random.Random(seed)
    vocabulary = {lang: [f"{lang}{chr(97 + i // 26)}{chr(97 + i % 26)}é" for i in range(80)] for lang in ("en", "de", "fr")}
    rows = []
    for i in range(n):
        lang = rng.choice(("en", "en", "de", None, "fr"))
        source = rng.choice(("s0", "s0", "s1", "s2", "ß", None))
        words = vocabulary[lang or "en"]
        lean = len(source or "") * 11
        rows.append((i, " ".join(rng.choice(words[lean % 40 :] if rng.random() < 0.6 else words) + rng.choice(("", ",", "1", ".")) for _ in range(rng.randint(0, 40))).upper(), lang, source))
    return rows + [(n, None, "en", "silent"), (n + 1, "", "xx", "a"), (n + 2, "once", "xx", "b"), (3, rows[3][1], rows[3][2], rows[3][3]), (None, "enaaé " * 5000, "en", "s1")]


@pytest.mark.parametrize("shard_bytes", [divergence.SHARD_BYTES, 5000])
def test_divergence_equals_its_sql(spark, shard_bytes):
    rows = audited()
    got = equals_sql(spark, divergence.audit(docs_of(spark, rows), shard_bytes=shard_bytes), queries.OP13_SQL, rows)
    assert len(got) > 100
    assert divergence.audit(docs_of(spark, rows).where("false")).count() == 0


def test_queries_on_given_tables(spark):
    registered = queries.QUERIES
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert registered["op12_toxicity"](spark, SF).count() == n
    assert registered["op13_source_divergence"](spark, SF).where("part = 'pair'").count() > 0
    assert registered["op11_spelling_variants"](spark, SF).where("form is not null").count() > 0
