"""Fingerprints against a plain recomputation of every row."""

import hashlib
import re
from collections import Counter

import xxhash

from offramp.llm import fingerprints as fp
from offramp.llm.fingerprints import fingerprints
from tests.llm.conftest import SCHEMA


def signed(n):
    return n - (1 << 64) if n >> 63 else n


def text_hash(text):
    return xxhash.xxh64_intdigest(text.encode(), seed=42)


def term_set(text):
    words = re.split(r"[\x00-/:-@\[-`{-\x7f]+", text.lower())
    hashes = {signed(text_hash(w)) for w in words if w}
    return {h for h in hashes if h % 8192 < fp.SAMPLED}


def subset(h):
    place = h % 8192
    if place < 512:
        return place // 32
    return 16 + (place - 512) // 8 if place < 576 else 24 + (place - 576) // 2


def fingerprint(text, band):
    terms = sorted(term_set(text) & band)
    if not terms:
        return "~" + format(text_hash(text), "016x")
    out = []
    for k in range(32):
        some = [t for t in terms if subset(t) == k]
        value = 42
        for t in some:
            value = xxhash.xxh64_intdigest((t % (1 << 64)).to_bytes(8, "little"), seed=value)
        out.append(format(value, "016x")[8:] if some else "")
    return ":".join(out)


def likeness(a, b):
    if a == b:
        return 1.0
    if "~" in a[0] + b[0]:
        return 0.0
    held = [x == y for x, y in zip(a.split(":"), b.split(":")) if x or y]
    return sum(held) / len(held)


def expected(rows):
    rows = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, signed(text_hash(r[1]))))
    df = Counter(h for _, t in rows for h in term_set(t))
    band = {h for h, n in df.items() if 2 <= n <= max(2, 0.05 * len(rows))}
    out = []
    for i, (key, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        own, other = fingerprint(text, band), fingerprint(edited, band)
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, other,
                    round(likeness(own, other), 9), round(likeness(own, fingerprint(following, band)), 9)))
    return sorted(out, key=repr)


def result(df):
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in df.collect()), key=repr)


def test_documents_match(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    wanted = expected(rows)
    assert result(fingerprints(docs)) == wanted
    monkeypatch.setattr(fp, "RUN_ROWS", 7)  # many runs, each with a neighbour
    assert result(fingerprints(docs.repartition(5))) == wanted
    near = [r[5] for r in wanted]
    assert sum(near) / len(near) > 5 * sum(r[6] for r in wanted) / len(near)


def test_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(fp, "RUN_ROWS", 2)
    rows = [(5, None), (1, ""), (9, "É" * 9), (3, "a b c d e f g"), (3, "a b c d e f g"), (3, "other"), (None, "x y z"), (None, "z"),
            (7, "lorem ipsum " * 50_000), (8, "lorem ipsum " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as id", "2 as run", "3 as terms", "4 as `row`")
    assert result(fingerprints(docs)) == expected(rows)
    for some in ([(1, "alone here")], [(None, "alone here")]):
        assert result(fingerprints(spark.createDataFrame(some, "doc_id bigint, text string"))) == expected(some)
    assert fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
