"""Spelling variants against every edit of every word."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from offramp.llm.queries import op11_spelling
from offramp.llm.spelling import count_words, near_pairs, signature, spelling_query, spelling_variants
from tests.llm.conftest import SCHEMA

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def plain_words(rows, slip=31, least=7, often=2):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if slip and h % slip == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1:]
            if len(word) >= least:
                counts[word] += 1
    return {w: n for w, n in counts.items() if n >= often}


def plain_near(words):
    """One deletion of both words equal at the same place, or one a deletion of the other."""
    holes, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i] + "\0" + w[i + 1:]].add(w)
            if (shorter := w[:i] + w[i + 1:]) in words:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    return near


def plain(words, ratio=10):
    near, form = plain_near(words), {}
    for w, n in words.items():
        best = min(near[w], key=lambda o: (-words[o], o), default=None)
        if best is not None and words[best] >= ratio * n:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return sorted(out, key=repr)


def result(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_whole_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = result(op11_spelling(spark, small))
    assert got == plain(plain_words(rows)) and any(r[1] for r in got) and any(r[4] > 1 for r in got)


def test_edge_cases(spark):
    rows = [(1, "Abcdefg abcdefg ABCDEFG"), (2, None), (3, ""), (4, "abcdefgh " * 40), (4, "abcdefgh " * 40),
            (None, "Éabcdef éabcdef Éabcdef abcdefé abcdefé"), (5, "a" * 50_000 + " " + "a" * 49_999), (6, "b" * 50_000),
            (7, "a" * 50_000 + " " + "a" * 49_999), (8, "short words no"), (9, "÷×abcdefgh1abcdefgx ÷×abcdefgh2abcdefgx"),
            (10, "aaaaaaa aaaaaaa aaaaaaaa aaaaaaaa baaaaaa baaaaaa")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' as word", "1 as n", "2 as key")
    assert result(spelling_query(docs)) == plain(plain_words(rows))
    assert sorted(map(tuple, count_words(docs, min_count=1, min_length=4).collect())) == sorted(
        plain_words(rows, None, 4, 1).items())
    assert result(spelling_query(spark.createDataFrame([], SCHEMA))) == []


def variants(rng, n, letters, sizes):
    words = set()
    while len(words) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.choice(sizes)))
        words.add(w)
        for _ in range(rng.randint(0, 4)):
            i, how = rng.randrange(len(w)), rng.randrange(3)
            v = w[:i] + (rng.choice(letters) if how else "") + w[i + (how != 1):]
            if len(v) >= min(sizes):
                words.add(v)
                w = rng.choice([w, v])
    return words


@pytest.mark.parametrize("letters, sizes, frequent", [("ab", [7, 8, 9], 2), ("abcdé𝒳", [7, 10, 14], 5),
                                                      ("abcdefghij", [5, 6, 30], 50), ("ab", [4, 5], 1)])
def test_all_pairs_are_found(spark, letters, sizes, frequent):
    rng = random.Random(len(letters) + len(sizes))
    words = variants(rng, 250 if letters == "ab" and max(sizes) > 5 else 40 if letters == "ab" else 900, letters, sizes)
    df = spark.createDataFrame([(w, rng.randint(1, 10_000)) for w in sorted(words)], "word string, n bigint")
    near = plain_near(words)
    pairs = near_pairs(df, min(sizes), frequent).collect()
    assert len(pairs) == len({frozenset((p.a, p.b)) for p in pairs})
    assert {frozenset((p.a, p.b)) for p in pairs} == {frozenset((w, o)) for w in near for o in near[w]} and pairs


def test_long_ways_to_the_root(spark):
    words = {"abcdefg" + "x" * i: 2 * 10 ** i for i in range(12)} | {"unrelated": 5, "abcdefh": 20}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    got = {r.word: r for r in spelling_variants(df).collect()}
    assert got["abcdefg"].root == "abcdefg" + "x" * 11 and got["unrelated"].root == "unrelated"
    # two near words of the largest count: the first in code-point order
    ties = spark.createDataFrame([("mistakf", 1), ("mistake", 30), ("mistakg", 30)], "word string, n bigint")
    assert {r.word: r.form for r in spelling_variants(ties).collect()}["mistakf"] == "mistake"


def test_signatures_survive_any_edit():
    words = pa.array(["abcdefg", "mentemente", "aaaaaaaaaaaa", "éçabcdefgh"])
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    _, word, start, length = signature(words, *none, longest=6)
    for w, text in enumerate(words.to_pylist()):
        spans = [(s, s + n) for k, s, n in zip(word, start, length) if k == w]
        assert all(any(not a <= i < b for a, b in spans) for i in range(1, len(text) + 1))
