"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams of the lower-cased letters (every run of anything else is one space) are
hashed into a fixed number of buckets. Document frequencies come from all training documents, by a
Spark aggregation; the weights are fitted on a bounded sample of them by follow-the-regularised-
leader with L1 and L2 penalties, which leaves most weights exactly zero; a temperature fitted on a
part of the sample that the weights have not seen makes the scores probabilities.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offramp.functions.hashing import digest_number, seeded_digest
from offramp.llm.common import mix64

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: The most documents that weights and temperature are fitted on, over all languages.
SAMPLE_DOCS = 6_000
UNKNOWN = "und"
_CHUNK = 1 << 20
_TABLES: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Per code point whether it is a letter."""
    if "letters" not in _TABLES:
        _TABLES["letters"] = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _TABLES["letters"]


def gram_counts(text: str) -> np.ndarray | None:
    """Counts of the hashed n-grams of the whole text; None if it has no letter."""
    counts = np.zeros(BUCKETS, np.int64)
    carry, seen = np.array([32], np.uint64), False
    for at in range(0, len(text), _CHUNK):
        codes = np.frombuffer(text[at:at + _CHUNK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[codes]
        seen = seen or bool(letter.any())
        codes = np.concatenate([carry, np.where(letter, codes, 32).astype(np.uint64)])
        space = codes == 32
        keep = np.ones(len(codes), bool)
        keep[1:] = ~(space[1:] & space[:-1])
        keep[:len(carry)] = True
        codes = codes[keep]
        new = len(carry)
        for n in ORDERS:
            # grams that end in this chunk; those inside the carried characters were counted before
            start = max(0, new - n + 1)
            length = len(codes) - n + 1 - start
            if length < 1:
                continue
            key = np.full(length, n, np.uint64)
            for j in range(n):
                key = key * np.uint64(0x110001) + codes[start + j:start + j + length]
            counts += np.bincount((mix64(key) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        carry = codes[-(max(ORDERS) - 1):]
    return counts if seen else None


def vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and unit-length TF-IDF values."""
    at = np.flatnonzero(counts)
    values = (np.log1p(counts[at]) * idf[at]).astype(np.float32)
    return at, values / max(float(np.sqrt(values @ values)), 1e-12)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # languages x buckets
    bias: np.ndarray
    temperature: float

    def logits(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        return self.weights[:, at] @ values + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = gram_counts(text) if text else None
        if counts is None or not self.languages:
            return UNKNOWN, 0.0
        scores = softmax(self.logits(*vector(counts, self.idf)) / self.temperature)
        best = int(np.argmax(scores))
        return self.languages[best], float(min(1.0, scores[best]))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, epochs: int = 3, alpha: float = 0.5,
               beta: float = 1.0, l1: float = 0.002, l2: float = 0.01, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by FTRL-proximal with elastic net; ``rows``: class, indices, values."""
    z, n = np.zeros((classes, BUCKETS + 1)), np.zeros((classes, BUCKETS + 1))

    def weights(at):
        zs = z[:, at]
        return -np.sign(zs) * np.maximum(np.abs(zs) - l1, 0) / ((beta + np.sqrt(n[:, at])) / alpha + l2)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            label, at, values = rows[i]
            at, values = np.append(at, BUCKETS), np.append(values, 1.0)
            w = weights(at)
            error = softmax(w @ values)
            error[label] -= 1
            g = error[:, None] * values
            old = n[:, at]
            z[:, at] += g - (np.sqrt(old + g * g) - np.sqrt(old)) / alpha * w
            n[:, at] = old + g * g
    w = weights(np.arange(BUCKETS + 1))
    return w[:, :BUCKETS].astype(np.float32), w[:, BUCKETS].astype(np.float32)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""
    def loss(t):
        return -np.log(softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-12).mean()

    if not len(labels):
        return 1.0
    low, high, ratio = np.log(0.02), np.log(20.0), (5 ** 0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text in batch.column(0):
            counts = gram_counts(text.as_py())
            if counts is not None:
                total += counts > 0
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "df"])


def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], []]
        for lang, text in zip(batch.column(0), batch.column(1)):
            counts = gram_counts(text.as_py())
            if counts is not None:
                at = np.flatnonzero(counts)
                out[0].append(lang.as_py())
                out[1].append(at.astype("<u2").tobytes())
                out[2].append(counts[at].astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.binary()),
                                          pa.array(out[2], pa.binary())], names=["lang", "at", "counts"])


def fit_language_model(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
                       sample_docs: int = SAMPLE_DOCS, seed: int = 5) -> Model:
    """A model from the labelled rows of ``docs`` (null text, label or key: not used).

    Document frequencies count every row. Weights and temperature are fitted on at most about
    ``sample_docs`` rows, drawn by a digest of the key, as many of each language where it has them;
    a fifth of them is for the temperature only. Without a labelled row the model knows no language.
    """
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"), docs[lang].alias("lang")).dropna()
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages, idf = sorted(sizes), np.zeros(BUCKETS, np.float32)
    n = sum(sizes.values())
    df = rows.select("text").mapInArrow(_document_frequencies, "bucket int, df bigint").groupBy("bucket").agg(F.sum("df").alias("df"))
    for row in df.collect():  # at most one row per bucket
        idf[row["bucket"]] = np.log((1 + n) / (1 + row["df"])) + 1
    draw = digest_number(seeded_digest(seed, "key")) / F.lit(float(1 << 32))
    share = F.lit(0.0)
    for name in languages:
        share = F.when(F.col("lang") == name, min(1.0, sample_docs / len(languages) / sizes[name])).otherwise(share)
    sample = rows.where(draw < share).select("lang", "text").mapInArrow(
        _sample_counts, "lang string, at binary, counts binary").collect()
    number = {name: i for i, name in enumerate(languages)}
    seen = []
    for row in sorted(sample, key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["counts"]))):
        counts = np.zeros(BUCKETS, np.float32)
        counts[np.frombuffer(row["at"], "<u2")] = np.frombuffer(row["counts"], "<f4")
        seen.append((number[row["lang"]], *vector(counts, idf)))
    train = [r for i, r in enumerate(seen) if i % 5] or seen
    weights, bias = train_ftrl(train, max(1, len(languages)))
    model = Model(languages, idf, weights, bias, 1.0)
    rest = seen[::5]
    if rest and len(languages) > 1:
        model.temperature = fit_temperature(np.array([model.logits(at, v) for _, at, v in rest]), np.array([c for c, _, _ in rest]))
    return model


def predict_languages(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text",
                      keep: dict[str, Column] | None = None) -> DataFrame:
    """``key, lang_pred, score`` (and the columns ``keep``) per row, from the whole text only.

    ``und`` with score 0 for null text or text without a letter, or if the model knows no language.
    No shuffle; rows with null or repeated keys are judged one by one.
    """
    keep = keep or {}
    given = docs.select(docs[key].alias("_key"), *[c.alias(f"_keep_{n}") for n, c in keep.items()], docs[text].alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [model.predict(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())],
                names=[*batch.schema.names[:-1], "lang_pred", "score"])

    out = given.mapInArrow(run, f"{schema}, lang_pred string, score double")
    return out.select(F.col("_key").alias(key), *[F.col(f"_keep_{n}").alias(n) for n in keep], "lang_pred", "score")


def held_out(key: Column) -> Column:
    """The fold that is never learned from (a null key belongs to no fold and is not learned from either)."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def language_query(docs: DataFrame) -> DataFrame:
    """The contract's rows: learn from the other folds, predict every document."""
    model = fit_language_model(docs.where(~held_out(docs["doc_id"])))
    return predict_languages(docs, model, keep={"held_out": held_out(docs["doc_id"])})
