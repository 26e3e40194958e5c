"""Secret scans over an incremental blob ledger.

Every text is a version of the file at its path (here: its doc_id). Versions are
content-addressed by SHA-256. The ledger holds, for every blob and rule version, that it was
scanned and what was found; a scan runs only the (blob, rule version) pairs that the ledger
lacks, once per blob however many paths share it, and findings join back to all paths.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.util import stored

_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_either = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)

#: Kinds in the order in which ties are listed. kind: (pattern, group whose length counts, least length, strings of which one must occur)
BASE_KINDS = {
    "assign": ("(" + "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, _KEYWORDS),
    "access": ("AKIA[A-Z0-9]+", 0, 18, ("akia",)),
    "hex": ("[0-9a-f]+", 0, 16, ()),
}
#: What the method adds: key blocks, signed tokens, and tokens with the prefixes that services publish.
MORE_KINDS = {
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, ("private key-----",)),
    "jwt": (r"\beyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30, ("eyj",)),
    "prefixed": (r"\b(?:gh[pousr]_|glpat-|xox[abpr]-|sk_live_|npm_)[A-Za-z0-9_-]+", 0, 20, ("gh", "glpat-", "xox", "sk_live_", "npm_")),
}
KINDS = BASE_KINDS | MORE_KINDS
#: Names the patterns themselves, so an edited one is a new version.
RULE_VERSION = hashlib.sha256(repr(KINDS).encode()).hexdigest()[:16]

LEDGER = "blob string, rule_version string, spans string, base_spans string, n_assign long, n_access long, n_hex long"


def find_spans(text: str, kinds: dict = KINDS) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all findings, by start, then kind as listed. Offsets are code points, ends exclusive."""
    low = text.lower()
    found = []
    for order, (kind, (pattern, group, least, needs)) in enumerate(kinds.items()):
        if needs and not any(w in low for w in needs):
            continue
        # runs of one class are found whole, so the least length may go into the pattern
        quick = "[0-9a-f]{16,}" if kind == "hex" else pattern
        for m in re.finditer(quick, text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), order, m.end(), kind))
    return [(s, e, k) for s, _, e, k in sorted(found)]


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for blob, text in zip(b["blob"], b["text"], strict=True):
            spans = find_spans(text)
            base = [x for x in spans if x[2] in BASE_KINDS]
            join = lambda xs: ",".join(f"{k}:{s}:{e}" for s, e, k in xs)
            rows.append((blob, RULE_VERSION, join(spans), join(base), *(sum(k == kind for _, _, k in base) for kind in BASE_KINDS)))
        yield pd.DataFrame(rows, columns=["blob", "rule_version", "spans", "base_spans", "n_assign", "n_access", "n_hex"])


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Ledger rows for the blobs of `docs` that `ledger` lacks under RULE_VERSION; append them to it.

    A blob is scanned once: copies are combined before the shuffle.
    """
    blobs = docs.select(blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rule_version") == RULE_VERSION).select("blob"), "blob", "left_anti")
    return blobs.dropDuplicates(["blob"]).mapInPandas(_scan, LEDGER)


def scan(docs: DataFrame, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings of every row of docs, new ledger rows).

    Findings: doc_id, blob, n_assign, n_access, n_hex, base_spans, spans. Null text is the empty
    blob, repeated rows and copies get equal findings, null doc_ids stay. Other columns are
    ignored. An empty table gives empty results. A ledger that holds a blob twice under a rule
    version, as two scans that append at once leave it, counts as holding it once. The new ledger rows are written to the shared
    folder, so that the scan runs once although both results are used.
    """
    new = stored(scan_unseen(docs, ledger), "ledger")
    known = new if ledger is None else ledger.where(F.col("rule_version") == RULE_VERSION).select(new.columns).dropDuplicates(["blob"]).unionByName(new)
    hits = known.where("spans != ''").select("blob", "spans", "base_spans", "n_assign", "n_access", "n_hex")
    paths = docs.select("doc_id", blob_of(F.col("text")).alias("blob")).join(hits, "blob", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_assign", "n_access", "n_hex")} | {c: F.coalesce(c, F.lit("")) for c in ("spans", "base_spans")}
    return paths.withColumns(zero).select("doc_id", "blob", "n_assign", "n_access", "n_hex", "base_spans", "spans"), new


