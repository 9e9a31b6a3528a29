"""A quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation estimates how
each votes on good and on bad documents, without a single true label, from the number of
documents per vote pattern (a table of at most 3^labellers rows); the posterior of a pattern is the soft label
of its documents. A linear scorer on hashed words (in a fine and a coarse hash) and coarse measurements is trained on
the soft labels of a bounded sample and scores every document.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from offramp.functions.hashing import digest_number, seeded_digest
from offramp.llm.common import fresh, mix64, word_hashes
from offramp.llm.quality_rules import repeated_words

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Labellers: (name, condition for "bad", condition for "good") over the measurements; else no vote.
LABELLERS = (
    ("length", "n_words < 20", "n_words >= 60"),
    ("symbols", "10 * n_symbols > 2 * n_words", "100 * n_symbols <= 2 * n_words AND n_words > 0"),
    ("repeats", "100 * n_repeat_words > 15 * n_words", "100 * n_repeat_words <= 3 * n_words AND n_words >= 10"),
    ("word_length", "word_chars < 3 * n_words OR word_chars > 10 * n_words", "word_chars BETWEEN 4 * n_words AND 8 * n_words AND n_words > 0"),
    ("lines", "100 * n_dup_lines > 30 * n_lines", "n_dup_lines = 0 AND n_lines >= 2"),
    ("sentences", "100 * n_ends < 3 * n_words", "100 * n_ends BETWEEN 4 * n_words AND 40 * n_words"),
    ("letters", "100 * n_letters < 85 * word_chars", "100 * n_letters >= 93 * word_chars AND n_words > 0"),
)
BUCKETS = 1 << 16
#: The most documents that the scorer is trained on.
SAMPLE_DOCS = 12_000
THRESHOLD = 0.5
_ABSTAIN, _BAD, _GOOD = 0, 1, 2


#: Bits of a byte: white space between words, mark or sign of a symbol, end of a sentence, first byte of a
#: letter (A-Z, a-z or beyond ASCII), first byte of a character.
_SPACE, _SYMBOL, _END, _LETTER, _CHAR = 1, 2, 4, 8, 16
_KIND = np.full(256, _CHAR, np.uint8)
_KIND[0x80:0xC0] = 0
for _bytes, _bit in ((b"\t\n\x0b\x0c\r ", _SPACE), (b"#*$%&|<>", _SYMBOL), (b".!?", _END),
                     (bytes([*range(65, 91), *range(97, 123), *range(0xC0, 256)]), _LETTER)):
    _KIND[list(_bytes)] |= _bit
#: Beyond white space, a sentence may end before one of these that ends the text.
_LAST = ("\u0085".encode(), "\u2028".encode(), "\u2029".encode())
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_ends", "n_letters")


def measured(data: bytes) -> tuple[int, ...]:
    """The measurements of ``quality_rules.measure`` of a UTF-8 text, sentence ends and letters."""
    if not data:
        return (0,) * len(MEASURES)
    kind = _KIND[np.frombuffer(data, np.uint8)]
    space = (kind & _SPACE).view(bool)
    # a word starts, and a sentence may end, where white space lies on one side only
    edge = space[1:] != space[:-1]
    n_words = (int(np.count_nonzero(edge)) + 2 - int(space[0]) - int(space[-1])) // 2
    ends = int(np.count_nonzero(((kind[:-1] & _END) != 0) & space[1:]))
    if kind[-1] & _END or any(data.endswith(x) and data[-len(x) - 1:-len(x)] in (b".", b"!", b"?") for x in _LAST):
        ends += 1
    chars = int(np.count_nonzero(kind & _CHAR)) - int(np.count_nonzero(space))
    lines = [line for line in data.split(b"\n") if line.strip(b"\t\x0b\x0c\r ")]
    return (n_words, chars, int(np.count_nonzero(kind & _SYMBOL)), len(lines), len(lines) - len(set(lines)),
            repeated_words(data), ends, int(np.count_nonzero(kind & _LETTER)))


@F.arrow_udf(StructType([StructField(m, LongType()) for m in MEASURES]))
def _measured(texts: pa.Array) -> pa.Array:
    rows = [measured(t or b"") for t in pc.cast(texts, pa.large_binary()).to_pylist()]
    columns = np.array(rows, np.int64).reshape(-1, len(MEASURES)).T
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=list(MEASURES))


def measures(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` and the measurements of their text, all 0 for null or empty text. They are taken in one
    pass over the bytes: as expressions, they cost several times as much as all else here."""
    struct = fresh(rows, base="_measured")
    return rows.withColumn(struct, _measured(F.col(text))).select(*rows.columns, f"{struct}.*")


def vote_pattern() -> Column:
    """All votes as one number in base 3."""
    total = F.lit(0)
    for i, (_, bad, good) in enumerate(LABELLERS):
        vote = F.when(F.expr(bad), _BAD).when(F.expr(good), _GOOD).otherwise(_ABSTAIN)
        total = total + vote * (3 ** i)
    return total.cast("int")


def votes_of(patterns: np.ndarray) -> np.ndarray:
    return np.array([(patterns // 3 ** i) % 3 for i in range(len(LABELLERS))]).T


@dataclass
class LabelModel:
    good: float  # share of good documents
    votes: np.ndarray  # labeller x (bad, good) x (no vote, bad, good): probabilities

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        votes = votes_of(patterns)
        log = np.log(np.array([1 - self.good, self.good]))[None, :].repeat(len(patterns), 0)
        for i in range(votes.shape[1]):
            log += np.log(self.votes[i][:, votes[:, i]]).T
        log -= log.max(axis=1, keepdims=True)
        p = np.exp(log)
        return p[:, 1] / p.sum(axis=1)


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """EM over vote patterns and their document counts, started from the majority of the votes."""
    votes = votes_of(patterns)
    good, bad = (votes == _GOOD).sum(axis=1), (votes == _BAD).sum(axis=1)
    p = (good + 0.5) / (good + 3 * bad + 1.0)
    model = None
    for _ in range(rounds):
        weight = np.stack([counts * (1 - p), counts * p])
        table = np.array([[[(weight[y] * (votes[:, i] == v)).sum() + 1.0 for v in range(3)] for y in (0, 1)]
                          for i in range(votes.shape[1])])
        share = (weight[1].sum() + 1) / (counts.sum() + 2)
        model = LabelModel(float(share), table / table.sum(axis=2, keepdims=True))
        new = model.posterior(patterns)
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return model


def _bins() -> list[Column]:
    """Coarse measurements, as numbers from 0 to 31."""
    def share(a: str, b: str, scale: int) -> Column:
        return F.least(F.coalesce(F.floor(F.col(a) * scale / F.nullif(F.col(b), F.lit(0))), F.lit(0)), F.lit(31)).cast("int")

    return [F.least(F.floor(F.log2(F.col("n_words") + 1)), F.lit(31)).cast("int"), share("n_symbols", "n_words", 20),
            share("n_repeat_words", "n_words", 20), share("word_chars", "n_words", 2), share("n_dup_lines", "n_lines", 10),
            share("n_ends", "n_words", 50), share("n_letters", "word_chars", 25)]


def features(data: bytes, bins: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: the whole text's words in a fine and a coarse hash (unit length together), and
    one slot per coarse measurement."""
    words = word_hashes(data.lower())
    slots = np.concatenate([words, mix64(words & np.uint64(0xFFF)) ^ np.uint64(1)]) & np.uint64(BUCKETS - 1)
    at, counts = np.unique(slots.astype(np.uint16), return_counts=True)  # slots are 16 bits, which sort fast
    at = at.astype(np.int64)
    values = np.log1p(counts).astype(np.float32)
    values /= max(float(np.sqrt(values @ values)), 1e-6)
    coarse = BUCKETS + np.arange(len(bins)) * 32 + np.asarray(bins)
    return np.concatenate([at, coarse]), np.concatenate([values, np.ones(len(bins), np.float32)])


def train_scorer(rows: list[tuple[float, np.ndarray, np.ndarray]], epochs: int = 3, rate: float = 0.1, l2: float = 1e-5,
                 seed: int = 4) -> np.ndarray:
    """Logistic regression on soft labels by AdaGrad; the last weight is the bias."""
    size = BUCKETS + len(LABELLERS) * 32 + 1
    w, squares = np.zeros(size), np.full(size, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            label, at, values = rows[i]
            at, values = np.append(at, size - 1), np.append(values, 1.0)
            g = (1 / (1 + np.exp(-np.clip(w[at] @ values, -30, 30))) - label) * values + l2 * w[at]
            squares[at] += g * g
            w[at] -= rate * g / np.sqrt(squares[at])
    return w.astype(np.float32)


def _score(weights: np.ndarray, data: bytes, bins: list[int]) -> float:
    at, values = features(data, bins)
    return float(1 / (1 + np.exp(-np.clip(float(weights[at] @ values + weights[-1]), -30, 30))))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, bins = pc.cast(batch.column(2), pa.large_binary()).to_pylist(), batch.column(1).to_pylist()
        found = [features(t or b"", b) for t, b in zip(texts, bins)]
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([at.astype("<u4").tobytes() for at, _ in found], pa.binary()),
            pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())], names=["pattern", "at", "values"])


def _scored(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, bins = pc.cast(batch.column(3), pa.large_binary()).to_pylist(), batch.column(2).to_pylist()
            scores = [_score(weights, t or b"", b) for t, b in zip(texts, bins)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())],
                                             names=["key", "pattern", "score"])

    return run


def fit_quality_model(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS,
                      seed: int = 4) -> tuple[LabelModel, np.ndarray]:
    """The label model (from all documents) and the scorer's weights (from a sample by key digest).

    No label and no other column is read. An empty table gives a model that scores everything 0.5.
    """
    voted = measures(docs.select(docs[text].alias("text"))).groupBy(vote_pattern().alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    rows = voted.collect()  # at most 3^7 patterns
    patterns, counts = np.array([r["pattern"] for r in rows], np.int64), np.array([r["n"] for r in rows], float)
    if not len(rows):
        return LabelModel(0.5, np.full((len(LABELLERS), 2, 3), 1 / 3)), np.zeros(BUCKETS + len(LABELLERS) * 32 + 1, np.float32)
    model = fit_label_model(patterns, counts)
    share = min(1.0, sample_docs / counts.sum())
    draw = digest_number(seeded_digest(seed, F.coalesce(docs[key].cast("string"), F.lit("")))) / F.lit(float(1 << 32))
    some = measures(docs.where(draw < share).select(docs[text].alias("text")))
    sample = some.select(vote_pattern().alias("pattern"), F.array(*_bins()).alias("bins"), "text").mapInArrow(
        _sampled, "pattern int, at binary, values binary").collect()
    sample.sort(key=lambda r: (r["pattern"], bytes(r["at"]), bytes(r["values"])))
    soft = dict(zip(patterns.tolist(), model.posterior(patterns)))
    weights = train_scorer([(soft[r["pattern"]], np.frombuffer(r["at"], "<u4").astype(np.int64), np.frombuffer(r["values"], "<f4"))
                            for r in sample])
    return model, weights


def score_quality(docs: DataFrame, model: tuple[LabelModel, np.ndarray], key: str = "doc_id", text: str = "text",
                  threshold: float = THRESHOLD) -> DataFrame:
    """``key, weak_label, score, kept`` per row: the labellers' posterior, the scorer's probability of
    good, and whether it reaches the threshold.

    Null text counts as empty, and gets the score of an empty text. Null or repeated keys and repeated
    rows are scored one by one. No shuffle.
    """
    labels, weights = model
    patterns = np.arange(3 ** len(LABELLERS))
    posterior = F.split(F.lit(",".join(f"{p:.6f}" for p in labels.posterior(patterns))), ",").cast("array<double>")
    given = measures(docs.select(docs[key].alias("key"), docs[text].alias("text"))).select("key", vote_pattern().alias("pattern"), F.array(*_bins()).alias("bins"), "text")
    kind = docs.schema[key].dataType.simpleString()
    out = given.mapInArrow(_scored(weights), f"key {kind}, pattern int, score double")
    return out.select(F.col("key").alias(key), F.get(posterior, F.col("pattern")).alias("weak_label"), "score",
                      (F.col("score") >= threshold).alias("kept"))


def quality_model_query(docs: DataFrame) -> DataFrame:
    return score_quality(docs, fit_quality_model(docs))
