"""Masked pseudo-likelihood scores of documents.

Every word is predicted from the two words on either side of it: a small network reads their
embeddings and gives probabilities of word classes, and a class gives its words by their share of
it in the corpus. The sum of the conditional log-probabilities of all words scores a document.

Words are hashed into a fixed number of units. Unit counts, from which classes and within-class
shares follow, are summed over all documents. The network is trained on every window of every document:
in a round each task runs stochastic gradient steps, in numpy, over that round's windows of its own part, and
the tasks' parameters are averaged by their numbers of windows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offramp.llm.common import mix64, word_hashes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNITS, CONTEXTS, CLASSES = 1 << 16, 1 << 12, 64
SIDE, WIDTH, HIDDEN = 2, 16, 32
#: A round takes every STRIDE-th window of a document, the next round the ones after them: all of
#: them are taken once in STRIDE rounds.
STRIDE, ROUNDS = 2, 2
_BATCH, _CHUNK = 1 << 10, 1 << 13
_MERGERS = 8


@dataclass
class WordClasses:
    of: np.ndarray  # class of a unit
    log_share: np.ndarray  # log-probability of a unit in its class


@dataclass
class Network:
    embed: np.ndarray  # contexts + 1 (outside the document) x width
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.w1, self.b1, self.w2, self.b2]

    def log_probabilities(self, contexts: np.ndarray) -> np.ndarray:
        """Log-probabilities of the classes (windows x classes) from context ids (windows x 2 sides)."""
        x = self.embed[contexts].reshape(len(contexts), -1)
        z = np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def new_network(seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    embed = (rng.standard_normal((CONTEXTS + 1, WIDTH)) * 0.3).astype(np.float32)
    return Network(embed, draw(2 * SIDE * WIDTH, HIDDEN), np.zeros(HIDDEN, np.float32),
                   draw(HIDDEN, CLASSES) * np.float32(0.1), np.zeros(CLASSES, np.float32))


def word_classes(counts: np.ndarray) -> WordClasses:
    """Units by falling count, cut into classes of about equal square-root mass."""
    order = np.argsort(-counts, kind="stable")
    mass = np.cumsum(np.sqrt(counts[order] + 1.0))
    of = np.empty(UNITS, np.int64)
    of[order] = np.minimum((mass - mass[0]) / mass[-1] * CLASSES, CLASSES - 1).astype(np.int64)
    total = np.bincount(of, weights=counts + 1.0, minlength=CLASSES)
    return WordClasses(of, np.log((counts + 1.0) / total[of]))


def units_of(data: bytes) -> np.ndarray:
    return (word_hashes(data.lower()) & np.uint64(UNITS - 1)).astype(np.int64)


def contexts_of(units: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Context ids around the given places; places outside the document have an id of their own."""
    ids = np.concatenate([np.full(SIDE, CONTEXTS), mix64(units.astype(np.uint64)).astype(np.int64) & (CONTEXTS - 1), np.full(SIDE, CONTEXTS)])
    return np.stack([ids[at + SIDE + d] for d in range(-SIDE, SIDE + 1) if d], axis=1)


def train(net: Network, contexts: np.ndarray, classes: np.ndarray, squares: list[np.ndarray], rate: float = 0.05) -> None:
    """One AdaGrad step over a batch of windows, in place."""
    n = len(classes)
    x = net.embed[contexts].reshape(n, -1)
    h = np.tanh(x @ net.w1 + net.b1)
    z = h @ net.w2 + net.b2
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    z[np.arange(n), classes] -= 1
    z /= n
    dh = (z @ net.w2.T) * (1 - h * h)
    dx = (dh @ net.w1.T).reshape(-1, WIDTH)
    order = np.argsort(contexts.ravel().astype(np.int16), kind="stable")  # a radix sort
    ids = contexts.ravel()[order]
    starts = np.flatnonzero(np.diff(ids, prepend=-1))
    rows, by_row = ids[starts], np.add.reduceat(dx[order], starts, axis=0)
    for k, g in ((1, x.T @ dh), (2, dh.sum(axis=0)), (3, h.T @ z), (4, z.sum(axis=0))):
        squares[k] += g * g
        own = net.arrays()[k]
        own -= rate * g / np.sqrt(squares[k])
    squares[0][rows] += by_row * by_row
    net.embed[rows] -= rate * by_row / np.sqrt(squares[0][rows])


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[bytes]:
    for batch in batches:
        for text in pc.cast(batch.column(column), pa.large_binary()):
            yield text.as_py() or b""


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(UNITS, np.int64)
    for data in _texts(batches, 0):
        units = units_of(data)
        np.add.at(total, units, 1)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["unit", "n"])


def _trained(net: Network, classes: WordClasses, stride: int, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(*(a.copy() for a in net.arrays()))
        squares = [np.full_like(a, 1e-3) for a in own.arrays()]
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = windows = 0
        for data in _texts(batches, 0):
            units = units_of(data)
            at = np.arange((int(units[0]) + turn) % stride if len(units) else 0, len(units), stride)
            if not len(at):
                continue
            held.append((contexts_of(units, at), classes.of[units[at]]))
            waiting += len(at)
            while waiting >= _BATCH:
                c, y = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                whole = len(y) // _BATCH * _BATCH
                for i in range(0, whole, _BATCH):
                    train(own, c[i:i + _BATCH], y[i:i + _BATCH], squares)
                held, waiting, windows = [(c[whole:], y[whole:])], len(y) - whole, windows + whole
        if waiting:
            train(own, np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), squares)
            windows += waiting
        flat = np.concatenate([a.ravel() for a in own.arrays()]).astype("<f8") * windows
        yield pa.RecordBatch.from_arrays([pa.array([windows], pa.int64()), pa.array([int(flat[0] * 1e6) % _MERGERS], pa.int32()),
                                          pa.array([flat.astype("<f4").tobytes()], pa.binary())], names=["windows", "merger", "parameters"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    windows, total = 0, None
    for batch in batches:
        for n, raw in zip(batch.column(0), batch.column(2)):
            flat = np.frombuffer(raw.as_py(), "<f4").astype("<f8")
            total = flat if total is None else total + flat
            windows += n.as_py()
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([windows], pa.int64()), pa.array([total.tobytes()], pa.binary())],
                                         names=["windows", "parameters"])


def fit_pseudo_lm(docs: DataFrame, text: str = "text", rounds: int = ROUNDS, stride: int = STRIDE, seed: int = 7) -> tuple[Network, WordClasses]:
    """Unit counts over all texts, then ``rounds`` of training over all texts, in which every window is
    taken at least once. The driver gets one row per unit and, from each round, the sums of a fixed
    number of tasks."""
    if not 1 <= stride <= rounds:
        raise ValueError("with a stride from 1 to the number of rounds every window is taken")
    texts = docs.select(docs[text].alias("text"))
    counts = np.zeros(UNITS)
    for row in texts.mapInArrow(_counted, "unit int, n bigint").groupBy("unit").agg(F.sum("n").alias("n")).collect():
        counts[row["unit"]] = row["n"]
    classes, net = word_classes(counts), new_network(seed)
    schema = "windows bigint, merger int, parameters binary"
    for turn in range(rounds):
        parts = texts.mapInArrow(_trained(net, classes, stride, turn), schema).repartition(_MERGERS, "merger")
        sums = parts.mapInArrow(_summed, "windows bigint, parameters binary").collect()
        windows = sum(r["windows"] for r in sums)
        if not windows:
            break
        flat = sum(np.frombuffer(r["parameters"], "<f8") for r in sums) / windows
        shapes, at, arrays = [a.shape for a in net.arrays()], 0, []
        for shape in shapes:
            size = int(np.prod(shape))
            arrays.append(flat[at:at + size].reshape(shape).astype(np.float32))
            at += size
        net = Network(*arrays)
    return net, classes


def document_score(data: bytes, net: Network, classes: WordClasses) -> tuple[int, float]:
    """Number of words and sum of their conditional log-probabilities, over the whole text."""
    units = units_of(data)
    total = 0.0
    for start in range(0, len(units), _CHUNK):
        at = np.arange(start, min(len(units), start + _CHUNK))
        log = net.log_probabilities(contexts_of(units[max(0, start - SIDE):start + _CHUNK + SIDE], at - max(0, start - SIDE)))
        some = units[at]
        total += float(log[np.arange(len(at)), classes.of[some]].sum(dtype=np.float64) + classes.log_share[some].sum())
    return len(units), total


def _scored(net: Network, classes: WordClasses):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [document_score(t or b"", net, classes) for t in pc.cast(batch.column(1), pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([n for n, _ in said], pa.int64()), pa.array([s for _, s in said], pa.float64()),
                pa.array([s / n if n else None for n, s in said], pa.float64())], names=["key", "n_words", "log_prob", "score"])

    return run


def score_documents(docs: DataFrame, model: tuple[Network, WordClasses], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_words, log_prob, score`` per row; ``score`` is the mean per word, null without words.

    Null text is empty. Null or repeated keys and repeated rows are scored one by one. No shuffle.
    """
    kind = docs.schema[key].dataType.simpleString()
    given = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    out = given.mapInArrow(_scored(*model), f"key {kind}, n_words bigint, log_prob double, score double")
    return out.withColumnRenamed("key", key)


def lm_query(docs: DataFrame) -> DataFrame:
    return score_documents(docs, fit_pseudo_lm(docs))
