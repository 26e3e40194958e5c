"""Plain versions of the operators, row by row and pair by pair, for tests."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def gram_set(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def jaccard_components(docs, n, percent):
    """{doc_id: (set size, component)} of {doc_id: text}."""
    sets = {d: gram_set(t, n) for d, t in docs.items()}
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    shared = Counter()
    for own in holders.values():
        for i, x in enumerate(own):
            for y in own[:i]:
                shared[x, y] += 1
    for (x, y), k in shared.items():
        if 100 * k >= percent * (len(sets[x]) + len(sets[y]) - k):
            a, b = sorted((find(x), find(y)))
            root[b] = a
    return {d: (len(sets[d]), find(d)) for d in docs}


def repeated_bytes(docs, width=100):
    """{doc_id: (n_bytes, n_removed, n_spans, kept_sha256)} of [(doc_id, text)] in order."""
    seen, out = set(), {}
    for d, text in docs:
        raw, spans = (text or "").encode(), []
        for i in range(len(raw) - width + 1):
            piece = raw[i : i + width]
            if piece not in seen:
                seen.add(piece)
            elif spans and i <= spans[-1][1]:
                spans[-1][1] = i + width
            else:
                spans.append([i, i + width])
        kept = b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(raw)]))
        out[d] = (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
    return out


def shared_lines(docs, min_words=20):
    """{doc_id: n_removed} of [(doc_id, text)] in order: lines in blocks of min_words that an earlier text has, or all of a copy."""
    seen, texts, out = set(), set(), {}
    for d, text in docs:
        own = [(x, len(WORD.findall(x))) for x in text.split("\n") if WORD.search(x)]
        blocks = {(i, j) for i in range(len(own)) for j in range(i + 1, len(own) + 1) if sum(n for _, n in own[i:j]) >= min_words}
        if text in texts:
            out[d] = len(own) if blocks else 0
        else:
            out[d] = len({k for i, j in blocks if tuple(own[i:j]) in seen for k in range(i, j)})
        texts.add(text)
        seen |= {tuple(own[i:j]) for i, j in blocks}
    return out


def secret_row(text):
    """(n_assign, n_access, n_hex, base_sha256) by the plain patterns."""
    text = text or ""
    kw = "(" + "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY])"
    rules = [("assign", kw + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16)]
    found = [(m.start(), k, m.end(), name) for k, (name, rx, g, least) in enumerate(rules) for m in re.finditer(rx, text) if len(m[g]) >= least]
    spans = ",".join(f"{name}:{s}:{e}" for s, _, e, name in sorted(found))
    return (*(sum(f[3] == name for f in found) for name, *_ in rules), hashlib.sha256(spans.encode()).hexdigest(), spans)


def crc(text):
    return zlib.crc32((text or "").encode())


def dedup_text(docs, min_words=20):
    """{doc_id: text less the lines that `shared_lines` counts} of [(doc_id, text)] in order; "" where no word is left."""
    seen, texts, out = set(), set(), {}
    for d, text in docs:
        lines = (text or "").split("\n")
        own = [(i, x, len(WORD.findall(x))) for i, x in enumerate(lines) if WORD.search(x)]
        blocks = {(i, j) for i in range(len(own)) for j in range(i + 1, len(own) + 1) if sum(n for *_, n in own[i:j]) >= min_words}
        keys = {b: tuple((x, n) for _, x, n in own[b[0] : b[1]]) for b in blocks}
        gone = {own[k][0] for (i, j), key in keys.items() if key in seen for k in range(i, j)}
        if text in texts and blocks:
            gone = set(range(len(lines)))
        left = [x for i, x in enumerate(lines) if i not in gone]
        out[d] = text if not gone else "\n".join(left) if any(WORD.search(x) for x in left) else ""
        texts.add(text)
        seen |= set(keys.values())
    return out


def ring_shards(rows, shards, vnodes, cells, ring):
    """[(shard, slot)] of rows, given by their cells in the order within them: every row looks for room by itself, clockwise."""
    total, counts = len(rows), Counter(rows)
    owner = {c: next((p for p, (at, _) in enumerate(ring) if at >= c), 0) for c in counts}
    demand = Counter(ring[owner[c]][1] for c in rows)
    spare = set(sorted(range(shards), key=lambda s: (-demand[s], s))[: total % shards])
    room = {s: total // shards + (s in spare) for s in range(shards)}
    place, late = [None] * total, defaultdict(list)
    order = sorted(range(total), key=lambda i: rows[i])
    for i in order:
        s = ring[owner[rows[i]]][1]
        if room[s]:
            room[s] -= 1
            place[i] = s
        else:
            late[owner[rows[i]]].append(i)
    queue = []
    for lap in range(2 * len(ring)):
        p = lap % len(ring)
        while queue and room[ring[p][1]]:
            room[ring[p][1]] -= 1
            place[queue.pop(0)] = ring[p][1]
        queue += late.pop(p, [])
    return place
