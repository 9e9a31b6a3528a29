"""Near-duplicate groups against a brute force over all pairs."""

import re
from collections import defaultdict

import numpy as np
import pytest

from offramp.llm import minhash
from offramp.llm.common import shingle_set
from offramp.llm.minhash import drop_near_duplicates, near_duplicates, super_minhash
from tests.llm.conftest import SCHEMA


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def groups(rows):
    """Smallest id reachable per row; pairs are found through shared shingles."""
    sets = [shingles(t) for _, t in rows]
    index = defaultdict(list)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    counts = defaultdict(int)
    for i, s in enumerate(sets):
        for g in s:
            for j in index[g]:
                counts[j, i] += 1
            index[g].append(i)
    for (i, j), n in counts.items():
        if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
            parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return [(key, len(sets[i]), least.get(find(i))) for i, (key, _) in enumerate(rows)]


def expected(rows):
    return sorted(((k, n, c, k == c) for k, n, c in groups(rows)), key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=repr)


def test_documents_match_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = result(near_duplicates(docs))
    assert found == expected(rows)
    assert any(not kept for *_, kept in found)


@pytest.mark.parametrize("hub", [4, 512])
def test_chains_hubs_and_copies_match_brute_force(spark, monkeypatch, hub):
    monkeypatch.setattr(minhash, "HUB", hub)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    base = [str(w) for w in rng.choice(words, 120)]
    rows, key = [], 0
    for group in range(6):
        text = [str(w) for w in rng.choice(words, 120)] if group else list(base)
        for _ in range(25):  # a chain of drifting copies: neighbours are linked, ends are not
            text = list(text)
            for at in rng.integers(0, len(text), 2):
                text[at] = str(rng.choice(words))
            rows.append((key := key + 1, " ".join(text)))
    rows += [((key := key + 1), " ".join(base)) for _ in range(10)]
    for _ in range(60):  # star: many copies near the base, far from each other
        text = list(base)
        for at in rng.integers(0, len(text), 3):
            text[at] = str(rng.choice(words))
        rows.append((key := key + 1, " ".join(text)))
    for _ in range(30):  # strays: too far from the base, some of them near each other
        text = list(base)
        for at in rng.integers(0, len(text), 9):
            text[at] = str(rng.choice(words))
        for _ in range(int(rng.integers(1, 4))):
            text = list(text)
            text[int(rng.integers(0, len(text)))] = str(rng.choice(words))
            rows.append((key := key + 1, " ".join(text)))
    rows += [((key := key + 1), " ".join(base[:n])) for n in range(40, 120, 4)]  # shorter and shorter
    docs = spark.createDataFrame([(k, t) for k, t in rows], "doc_id bigint, text string").repartition(5)
    assert result(near_duplicates(docs)) == expected(rows)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE\ttwo"), (6, "one two three"),
            (7, "É x y z a b"), (8, "é x y z a b"), (9, "a b c d e"), (9, "a b c d e"), (None, "a b c d e"), (None, "lonely words here now ok")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as n", "2 as v", "3 as bucket", "4 as component")
    found = result(near_duplicates(docs))
    assert found == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False),
                            (6, 1, 6, True), (7, 2, 7, True), (8, 2, 8, True), (9, 1, 9, True), (9, 1, 9, True),
                            (None, 1, 9, False), (None, 1, None, True)], key=repr)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 2, 3, 4, 6, 7, 8, 9, None], key=repr)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(docs).count() == 0
    assert drop_near_duplicates(docs).count() == 0


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(5)
    shared = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    a = np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, 50).astype(np.uint64)]))
    b = np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, 50).astype(np.uint64)]))
    both = super_minhash([a, b, a[:1]], 256)
    assert abs((both[0] == both[1]).mean() - 0.75) < 0.12
    assert (both < np.uint64(257) << np.uint64(32)).all()
    alone = super_minhash([a], 256)
    assert (alone[0] == both[0]).all()


def plain_signature(values, slots):
    """The published loop, one element and one slot at a time."""
    from offramp.llm.common import mix64
    best = [None] * slots
    for value in values:
        order = list(range(slots))
        for level in range(slots):
            draw = int(mix64(np.array([value], np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))[0])
            at = level + ((draw & 0xFFFFFFFF) * (slots - level) >> 32)
            order[level], order[at] = order[at], order[level]
            rank = (level << 32) | draw >> 32
            if best[order[level]] is None or rank < best[order[level]]:
                best[order[level]] = rank
    return best


@pytest.mark.parametrize("n", [1, 2, 7, 60])
def test_early_stop_changes_nothing(n):
    values = np.unique(np.arange(n, dtype=np.uint64) * np.uint64(7919) + np.uint64(13))
    assert super_minhash([values], 24)[0].tolist() == plain_signature(values, 24)


def test_long_text_in_chunks():
    text = ("word " * 300_000 + "é" * 2_000_000 + " end\n" + "Other  Text " * 10).encode()
    assert len(shingle_set(text, 5)) == len(shingles(text.decode()))


def varied(rng, words, base, n, low, high):
    """Copies of a text, each with its own words replaced, left out or put in."""
    for _ in range(n):
        text = list(base)
        for at in sorted(rng.choice(len(base), int(rng.integers(low, high)), replace=False), reverse=True):
            change = int(rng.integers(0, 3))
            text[at:at + (change < 2)] = [str(rng.choice(words))] * (change != 1)
        yield " ".join(text)


@pytest.mark.parametrize("with_base", [False, True])
def test_copies_with_edits_of_their_own(spark, monkeypatch, with_base):
    """Around the threshold to a base that may be missing: some linked, most of them not."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(60)]  # edits are alike now and then
    base = [str(w) for w in rng.choice(words, 130)]
    rows = list(enumerate([" ".join(base)] * with_base + list(varied(rng, words, base, 250, 1, 9))))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    wanted = expected(rows)
    assert 20 < sum(kept for *_, kept in wanted) < 250
    assert result(near_duplicates(docs)) == wanted


def test_unlinked_copies_meet_few_others(spark, monkeypatch):
    """No round, table or pair for each member of a group of copies that are not linked."""
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(5_000)]
    base = [str(w) for w in rng.choice(words, 400)]
    rows = []
    for key in range(400):
        text = list(base)
        for at in rng.choice(400, 12, replace=False):
            text[at] = str(rng.choice(words))
        rows.append((key, " ".join(text)))
    tables, written = {}, minhash.stored

    def counted(df, name):
        tables[name] = written(df, name)
        return tables[name]

    monkeypatch.setattr(minhash, "stored", counted)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert result(near_duplicates(docs)) == expected(rows)
    assert len(tables) <= 15
    assert tables["candidates"].count() < 400
