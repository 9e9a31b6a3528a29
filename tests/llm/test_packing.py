"""Packing: an exact round trip of every id, full windows, balanced steps."""

import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from offramp.llm import tokens
from offramp.llm.packing import balanced_steps, pack_documents, plan_unit
from offramp.llm.queries import tokenizer_path
from offramp.llm.tokens import BatchEncoder, batch_encoder
from tests.llm.conftest import SCHEMA


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(tokenizer_path())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def check(pieces, ids_of_rows, window=4096):
    """Every id of every row in exactly one piece; sequences gapless; little padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for key, id_lists in ids_of_rows.items():
        wanted = sorted((start_crc for ids in id_lists for start_crc in [len(ids)]))
        assert sum(p.length for p in by_doc[key]) == sum(wanted)
        if len(id_lists) == 1:
            at = 0
            for p in sorted(by_doc[key], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(id_lists[0]) and p.length > 0
                part = np.array(id_lists[0][at:at + p.length], "<u4")
                assert p.ids_crc32 == zlib.crc32(part.tobytes())
                at += p.length
            assert at == len(id_lists[0])
    assert set(by_doc) == set(ids_of_rows)
    loose = 0
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        loose += at & (at - 1) != 0
    return loose, len(by_sequence)


def test_documents_round_trip(spark, small, plain):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: [plain(r.text)] for r in docs.select("doc_id", "text").collect()}
    loose, _ = check(pack_documents(docs, tokenizer_path()).collect(), rows)
    assert loose <= 1
    pieces = pack_documents(docs, tokenizer_path(), unit_chars=50_000).collect()
    loose, _ = check(pieces, rows)
    assert loose <= len({p.sequence_id >> 32 for p in pieces})
    again = pack_documents(docs.repartition(3), tokenizer_path(), unit_chars=50_000).collect()
    assert sorted(again) == sorted(pieces)


def test_edge_cases(spark, plain):
    long = "The quick brown fox 12345, " * 20_000
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, long), (5, "same"), (5, "same"), (None, "x"), (None, "y"), (6, "<|endoftext|> é")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'z' as key", "1 as unit", "2 as start")
    ids = defaultdict(list)
    for key, text in rows:
        ids[key].append(plain(text))
    pieces = pack_documents(docs, tokenizer_path()).collect()
    loose, _ = check(pieces, ids)
    assert loose <= 1
    assert [p.length for p in pieces if p.doc_id in (1, 2, 3)] == [1, 1, 1]
    assert sum(p.doc_id == 5 for p in pieces) == 2


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], SCHEMA), tokenizer_path()).count() == 0


def test_plans_place_every_token_once():
    rng = random.Random(4)
    for _ in range(100):
        lengths = [rng.choice([rng.randint(1, 4095), rng.randint(1, 300)]) for _ in range(rng.randint(0, 200))]
        windows, got = plan_unit(lengths), defaultdict(list)
        for _, parts in windows:
            for doc, start, length in parts:
                got[doc].append((start, length))
        for doc, n in enumerate(lengths):
            at = 0
            for start, length in sorted(got[doc]):
                assert start == at
                at += length
            assert at == n
        assert sum(sum(p[2] for p in parts) != size for size, parts in windows) <= 1


def test_steps_are_balanced():
    rng = random.Random(5)
    sizes = [rng.choice([512, 1024, 2048, 4096]) for _ in range(500)]
    held = defaultdict(int)
    for size, step in zip(sizes, balanced_steps(sizes, 65_536)):
        held[step] += size
    assert max(held.values()) - min(held.values()) <= 4096


def test_words_are_tokenized_as_whole_texts():
    rng, encode = random.Random(7), batch_encoder(tokenizer_path())
    alphabet = list("aAbΣσςİıḰ \n\t\r\x0b\x0c\x1c\x85 　'smt059.,!#<|>‍가ßﬁ") + ["<|endoftext|>", "'s", " ", " ́"]
    for _ in range(5000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        whole = encode.tokenizer.encode(text, add_special_tokens=False).ids
        ((_, ids, bounds),) = encode(pa.array([text]))
        assert ids.tolist() == whole and bounds.tolist() == [0, len(whole)]


def test_encoder_works_in_bounded_memory():
    """A worker outlives its stage, so what the encoder took stands beside the work of all later ones."""
    rng = random.Random(8)
    texts = pa.array([" ".join(f"{rng.getrandbits(40):x}".translate(str.maketrans("0123456789", "ghijklmnop")) for _ in range(200))
                      for _ in range(3000)])
    encode = BatchEncoder(tokenizer_path())
    tracemalloc.start()
    try:
        n = sum(len(bounds) - 1 for _, _, bounds in encode(texts))
        left, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert n == len(texts)
    assert peak < 150 << 20 and left < 80 << 20


def test_encoder_starts_anew_without_a_change_of_ids(monkeypatch):
    rng, encode = random.Random(9), BatchEncoder(tokenizer_path())
    for name, value in {"BLOCK_BYTES": 200, "REMEMBERED": 20, "MERGE_CELLS": 100}.items():
        monkeypatch.setattr(tokens, name, value)
    texts = ["".join(rng.choice("abcdefgst 'é.,4 ") for _ in range(rng.randint(0, 90))) for _ in range(200)] + ["y" * 60 + " a"]
    found = [ids[bounds[i]:bounds[i + 1]].tolist() for _, ids, bounds in encode(pa.array(texts)) for i in range(len(bounds) - 1)]
    assert found == [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
