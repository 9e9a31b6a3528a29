import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from offramp.operators import sequences as S

EOS = 1


def _blocks(docs, width):
    stream = [t for _, ids in sorted(docs.items()) for t in list(ids or []) + [EOS]]
    return {i: stream[i * width:(i + 1) * width] for i in range(len(stream) // width)}


def _packed(spark, docs, width, splits=None):
    df = spark.createDataFrame(list(docs.items()), "doc_id long, input_ids array<int>").repartition(4)
    rows = S.pack_sequences(df, "doc_id", width, EOS, splits=splits).collect()
    return {r["seq_id"]: r["input_ids"] for r in rows}


@pytest.mark.parametrize("width", [1, 2, 4, 7, 1000])
@pytest.mark.parametrize("splits", [None, [], [3, 50, 51, 900]])
def test_pack(spark, width, splits):
    docs = {2: list(range(10, 24)), 3: [], 50: [5, 6, 7], 51: None, 77: [9], 1000: list(range(30, 37)), -4: [8] * 9}
    assert _packed(spark, docs, width, splits) == _blocks(docs, width)


def test_pack_many(spark):
    rng = random.Random(3)
    docs = {rng.randrange(10**9): [rng.randrange(9) for _ in range(rng.choice([0, 1, 5, 40, 900]))] for _ in range(300)}
    assert _packed(spark, docs, 64) == _blocks(docs, 64)


def test_pack_where_one_row_holds_most_tokens(spark):
    docs = {i: [i] for i in range(50)} | {25: list(range(20_000))}
    assert _packed(spark, docs, 128) == _blocks(docs, 128)


def test_pack_exact_multiple_and_nothing(spark):
    assert _packed(spark, {1: [2, 3, 4]}, 4) == {0: [2, 3, 4, EOS]}
    assert _packed(spark, {1: [2]}, 4) == {}


def test_vocab_and_encoding(spark):
    df = spark.createDataFrame([(1, "b a b"), (2, "c  a\nb <eos>"), (3, ""), (4, None)], "doc_id long, text string")
    vocab = S.fit_vocab(df, size=5)
    assert sorted((r["token_id"], r["token"], r["n"]) for r in vocab.collect()) == [
        (0, "<unk>", 0), (1, "<eos>", 0), (2, "<pad>", 0), (3, "b", 3), (4, "a", 2)]
    want = {1: [3, 4, 3], 2: [0, 4, 3, 1], 3: [], 4: None}
    for bound in (S.MAX_LOCAL_VOCAB, 0):
        rows = S.encode_tokens(df, vocab, max_local_vocab=bound).collect()
        assert {r["doc_id"]: r["input_ids"] for r in rows} == want
    with pytest.raises(ValueError):
        S.fit_vocab(df, size=2)


def _ids(spark, *rows):
    return spark.createDataFrame([(i, list(r)) for i, r in enumerate(rows)], "doc_id long, input_ids array<int>")


def test_truncate_pad_label_position(spark):
    df = _ids(spark, [5, 6, 7, 8, 9], [5], [])
    df = S.truncate_sequences(df, 4)
    df = S.position_ids(df, past=10)
    df = S.causal_labels(S.pad_and_mask(df, 4, 2))
    rows = {r["doc_id"]: r for r in df.collect()}
    assert rows[0]["input_ids"] == [5, 6, 7, 8] and rows[0]["attention_mask"] == [1] * 4
    assert rows[1]["input_ids"] == [5, 2, 2, 2] and rows[1]["attention_mask"] == [1, 0, 0, 0]
    assert rows[1]["labels"] == [5, -100, -100, -100] and rows[1]["targets"] == [-100] * 4
    assert rows[0]["targets"] == [6, 7, 8, -100]
    assert rows[2]["labels"] == [-100] * 4
    assert (rows[0]["position_ids"], rows[1]["position_ids"], rows[2]["position_ids"]) == ([10, 11, 12, 13], [10], [])


def test_padding_a_longer_row_fails(spark):
    with pytest.raises(PySparkException):
        S.pad_and_mask(_ids(spark, [1, 2, 3]), 2, 0).collect()


def test_batch_plan(spark):
    keys = [i * 17 - 5 for i in range(100)]
    df = spark.createDataFrame([(k,) for k in keys], "doc_id long").repartition(5)
    plan = S.batch_plan(df, "doc_id", per_device=3, accum=2, world=4, splits=[100, 400])
    rows = sorted(plan.collect(), key=lambda r: r["doc_id"])
    for i, row in enumerate(rows):
        assert (row["index"], row["step"], row["micro_step"], row["rank"], row["slot"]) == (
            i, i // 24, i // 12 % 2, i // 3 % 4, i % 3)
    assert S.cap_steps(plan, 2).count() == 48
    with pytest.raises(ValueError):
        S.batch_plan(df, "doc_id", 0, 1)


def test_token_budget(spark):
    df = S.pad_and_mask(_ids(spark, [1, 2, 3], [1], [1, 2], [1], [1]), 4, 0)
    row = S.token_budget(df, per_device=1, accum=1, world=2, max_steps=1).first()
    assert row.asDict() == {"sequences": 5, "token_slots": 20, "tokens": 8, "padding_share": 0.6,
                            "steps_available": 2, "steps_used": 1}
    empty = S.token_budget(df.where(F.lit(False)), 1, 1, 2).first()
    assert (empty["sequences"], empty["tokens"], empty["steps_available"]) == (0, 0, 0)


def test_words_are_looked_up_in_slices(spark, monkeypatch):
    """The same ids whether the words of a batch are looked up at once or some at a time."""
    from offramp.functions import kernels
    rows = [(i, None if i == 4 else " ".join(f"w{j % 9}" for j in range(i * 5 % 23))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    vocab = S.fit_vocab(df, size=8)
    whole = S.encode_tokens(df, vocab).orderBy("doc_id").collect()
    monkeypatch.setattr(kernels, "_CHUNK", 3)
    assert S.encode_tokens(df, vocab).orderBy("doc_id").collect() == whole
