"""Pseudo-likelihood scores against a word-by-word recomputation, gradients, and what training learns."""

import numpy as np
import pyarrow as pa
import pytest

from offramp.llm import lm_score as lm
from offramp.llm.common import mix64
from tests.llm.conftest import SCHEMA


def plain_score(text, net, classes):
    units = lm.units_of((text or "").encode()).tolist()
    total = 0.0
    for i, unit in enumerate(units):
        x = []
        for d in (-2, -1, 1, 2):
            inside = 0 <= i + d < len(units)
            row = int(mix64(np.array([units[i + d]], np.uint64))[0]) % lm.CONTEXTS if inside else lm.CONTEXTS
            x += net.embed[row].tolist()
        h = np.tanh(np.array(x) @ net.w1 + net.b1)
        z = h @ net.w2 + net.b2
        total += z[classes.of[unit]] - np.log(np.exp(z).sum()) + classes.log_share[unit]
    return len(units), total


def test_scores_match_word_by_word(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    net, classes = model = lm.fit_pseudo_lm(docs)
    rows = docs.select("doc_id", "text").limit(40).collect()
    said = {r.doc_id: r for r in lm.score_documents(docs, model).collect()}
    assert len(said) == docs.count()
    for row in rows:
        n, total = plain_score(row.text, net, classes)
        assert said[row.doc_id].n_words == n
        assert said[row.doc_id].log_prob == pytest.approx(total, rel=1e-4, abs=1e-3)
    monkeypatch.setattr(lm, "_CHUNK", 5)
    text = rows[0].text.encode()
    assert lm.document_score(text, net, classes)[1] == pytest.approx(plain_score(rows[0].text, net, classes)[1], rel=1e-4)


def test_classes_share_out_all_words():
    counts = np.random.default_rng(2).integers(0, 50, lm.UNITS).astype(float)
    classes = lm.word_classes(counts)
    for c in range(lm.CLASSES):
        assert np.exp(classes.log_share[classes.of == c]).sum() == pytest.approx(1)


def test_training_learns_from_both_sides(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(200)]

    def text(n, chain=True):  # the middle word of every five follows from its neighbours on both sides
        out = []
        for _ in range(n):
            a = int(rng.integers(0, 100))
            out += [words[a], words[a] if chain else words[int(rng.integers(0, 100))]]
        return " ".join(out)

    docs = spark.createDataFrame([(i, text(400)) for i in range(60)], "doc_id bigint, text string").repartition(2)
    net, classes = lm.fit_pseudo_lm(docs, stride=1, rounds=3)
    start = lm.new_network()
    good, odd = text(400).encode(), text(400, chain=False).encode()
    assert lm.document_score(good, net, classes)[1] > lm.document_score(good, start, classes)[1] * 0.95
    assert lm.document_score(good, net, classes)[1] > lm.document_score(odd, net, classes)[1] + 50


def test_steps_learn_a_batch_by_heart():
    rng = np.random.default_rng(4)
    net = lm.new_network()
    squares = [np.full_like(a, 1e-3) for a in net.arrays()]
    contexts, classes = rng.integers(0, lm.CONTEXTS, (256, 4)), rng.integers(0, lm.CLASSES, 256)
    loss = lambda: -net.log_probabilities(contexts)[np.arange(256), classes].mean()
    before = loss()
    for _ in range(200):
        lm.train(net, contexts, classes, squares)
    assert loss() < 0.6 * before


def test_every_window_is_trained_on(spark):
    start, lengths = lm.new_network(), (1, 2, 3, 40, 101)
    for n in lengths:
        text = " ".join(f"word{n}x{i}" for i in range(n))
        net, _ = lm.fit_pseudo_lm(spark.createDataFrame([(1, text)], "doc_id bigint, text string"))
        units = lm.units_of(text.encode())
        used = np.unique(lm.contexts_of(units, np.arange(n)))
        assert (net.embed[used] != start.embed[used]).any(axis=1).all()
    classes, taken = lm.word_classes(np.zeros(lm.UNITS)), 0
    texts = [" ".join(f"w{i}" for i in range(n)).encode() for n in lengths]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    for turn in range(lm.STRIDE):
        taken += next(lm._trained(start, classes, lm.STRIDE, turn)([batch])).column(0)[0].as_py()
    assert taken == sum(lengths)
    with pytest.raises(ValueError):
        lm.fit_pseudo_lm(spark.createDataFrame([], SCHEMA), rounds=2, stride=3)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "one"), (3, "a b a b a b"), (3, "a b a b a b"), (4, "long text " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as key", "2 as score", "3 as n_words")
    out = lm.lm_query(docs).collect()
    assert len(out) == len(rows)
    assert {(r.n_words, r.log_prob, r.score) for r in out if r.doc_id in (1, 2)} == {(0, 0.0, None)}
    assert all(r.score < 0 for r in out if r.n_words)
    assert len({r.score for r in out if r.doc_id == 3}) == 1
    assert lm.lm_query(spark.createDataFrame([], SCHEMA)).count() == 0
