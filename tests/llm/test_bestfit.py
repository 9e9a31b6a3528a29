"""Best-fit packing: an exact round trip of every id, cuts only where they must be, few sequences."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from offramp.llm.bestfit import pack_best_fit, plan_sequences, sweep
from offramp.llm.queries import op13_best_fit, tokenizer_path
from offramp.llm.tokens import batch_encoder
from tests.llm.conftest import SCHEMA


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(tokenizer_path())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def wanted(key, ids, size=2048):
    return [(key, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
            for n, at in enumerate(range(0, len(ids), size)) for part in [ids[at:at + size]]]


def check(pieces, rows, plain, size=2048):
    """Every piece as it should be, sequences gapless from 0 and within their size; their number."""
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces) == Counter(
        piece for key, text in rows for piece in wanted(key, plain(text), size))
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences)


def best_fit_decreasing(lengths, size):
    gaps, opened = Counter(), 0
    for length in sorted(lengths, reverse=True):
        free = min((g for g, n in gaps.items() if n and g >= length), default=None)
        if free is None:
            opened, free = opened + 1, size
        else:
            gaps[free] -= 1
        gaps[free - length] += 1
    return opened


def test_whole_table(spark, small, plain):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    pieces = op13_best_fit(spark, small).collect()
    used = check(pieces, rows, plain)
    assert used <= best_fit_decreasing([p.length for p in pieces], 2048) + 1
    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(7)
    assert check(pack_best_fit(docs, tokenizer_path(), size=300).collect(), rows, plain, 300) > used


def test_edge_cases(spark, plain):
    long = "The quick brown fox 12345, " * 20_000
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, long), (5, "same"), (5, "same"), (None, "x"), (None, "y"),
            (6, "<|endoftext|> é"), (7, "word " * 2047), (8, "word " * 2048)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr(
        "*", "'z' as unit", "1 as place", "2 as start", "3 as length", "4 as rank")
    check(pack_best_fit(docs, tokenizer_path()).collect(), rows, plain)


def test_empty_table(spark):
    assert pack_best_fit(spark.createDataFrame([], SCHEMA), tokenizer_path()).count() == 0


def test_hot_length(spark, plain):
    rows = [(i, "one two three") for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert check(pack_best_fit(docs, tokenizer_path()).collect(), rows, plain) == -(-20_000 // 512)


def test_plans_place_every_piece_once_and_use_few_sequences():
    rng = random.Random(3)
    for turn in range(60):
        size = rng.choice([64, 2048])
        top = rng.choice([3, size // 3, size])
        lengths = [rng.randint(1, top) for _ in range(rng.randint(1, 400))]
        counts = Counter(lengths)
        plan, opened = plan_sequences(counts, size)
        held, places = defaultdict(list), defaultdict(list)
        for length, rank, n, first, offset in plan:
            places[length] += range(rank, rank + n)
            for sequence in range(first, first + n):
                held[sequence].append((offset, length))
        assert {k: sorted(v) for k, v in places.items()} == {k: list(range(n)) for k, n in counts.items()}
        for parts in held.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= size
        assert set(held) == set(range(opened))
        assert opened <= best_fit_decreasing(lengths, size) * 1.02 + 1


def test_a_sweep_takes_the_smallest_gap_and_lower_ranks_first():
    placed = sweep({5: (0, 3), 2: (7, 1)}, {6: [(10, 2)], 5: [(3, 1)], 2: [(0, 1)], 9: [(20, 1)]})
    assert placed == [(5, 0, 1, 3, 5), (5, 1, 2, 10, 6), (2, 7, 1, 0, 2)]


def test_batches_are_tokenized_as_whole_texts():
    rng, encode = random.Random(6), batch_encoder(tokenizer_path())
    alphabet = list("aAbÀÞÿ×÷µªºΣσςİıḰ \n\t\r\x0b\x0c\x1c\x85 　'smt059.,!#<|>^`_\"\\[]‍가ßﬁ") + [
        "<|endoftext|>", "'s", " ", " ́", "word" * 20]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(8000)] + [None]
    got = [ids[a:b].tolist() for _, ids, bounds in encode(pa.array(texts)) for a, b in zip(bounds, bounds[1:])]
    assert got == [encode.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
