"""Shared folder, stored tables and byte-level text kernels of the operators in this package."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions travel to the tasks by value: executors need numpy and pyarrow, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: White space between words, as a regular expression class body and as bytes.
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 20
#: Bits of a sieve for each key, and the most 64-bit words that it has (a row of two numbers each).
_SIEVE_BITS, _SIEVE_WORDS = 16, 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``, else
    the checkpoint folder set on the context. Without either the caller has to set one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = chosen.get() if chosen.isDefined() else None
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back.

    It cuts the lineage, and a lost executor loses nothing of it.
    """
    path = f"{shared_folder(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(*frames: DataFrame, base: str) -> str:
    """A column name based on ``base`` that none of the frames has (in any case)."""
    taken = {c.lower() for f in frames for c in f.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def sieved(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose ``key`` may be among those of ``wanted``, a stored table with that column.

    None that is there is missed; of the others one in 16 stays, more beyond two million keys. An exact
    inner join then shuffles these only (Spark moves a semi join below the sieve). The bits are built by Spark and broadcast, 16 MB at most, so they meet the
    rows where they are.
    """
    words = max(1, min(wanted.count() * _SIEVE_BITS // 64, _SIEVE_WORDS))
    word, bits = (fresh(rows, base=b) for b in ("_word", "_bits"))

    def place(column: Column) -> tuple[Column, Column]:
        h = F.xxhash64(F.lit("sieve"), column)
        return F.pmod(F.shiftright(h, 6), F.lit(words)), h.bitwiseAND(F.lit(63)).cast("int")

    at, bit = place(F.col(key))
    sieve = wanted.where(F.col(key).isNotNull()).groupBy(at.alias(word)).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias(bits))
    met = rows.withColumn(word, at).join(F.broadcast(sieve), word)
    return met.where(F.col(key).isNotNull() & (F.getbit(bits, bit) == 1)).select(*rows.columns)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base modulo 2^64, and of its inverse."""
    base = 0xD6E8FEB86659FD93
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        steps = np.full(n, b, np.uint64)
        steps[:1] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _chunks(data: bytes) -> Iterator[bytes]:
    """The text in pieces of about 1 MB that end at white space (a longer word stays whole)."""
    start = 0
    while start < len(data):
        end = min(len(data), start + _CHUNK)
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield data[start:end]
        start = end


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every word of a UTF-8 text, in order; equal words have equal hashes.

    All words of a chunk are hashed at once: prefix sums of byte values times powers of a base
    give each word's polynomial, shifted back to position 0 and mixed with its length.
    """
    parts = []
    for chunk in _chunks(data):
        raw = np.frombuffer(chunk, np.uint8)
        space = _IS_SPACE[raw]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        if not len(starts):
            continue
        if "pow" not in _POWERS or len(_POWERS["pow"][0]) < len(raw):
            _POWERS["pow"] = _powers(max(len(raw), 1 << 16))
        power, inverse = _POWERS["pow"]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * power[:len(raw)], dtype=np.uint64)])
        own = (sums[ends] - sums[starts]) * inverse[starts]
        parts.append(mix64(own + (ends - starts).astype(np.uint64) * _GOLDEN))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every window of ``size`` consecutive words, in order."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total += words[j:j + n] * mix64(np.full(1, 2 * j + 3, np.uint64) * _GOLDEN)[0]
    return mix64(total)


def shingle_set(data: bytes, size: int) -> np.ndarray:
    """The sorted set of distinct ``size``-word shingle hashes of a text lower-cased in A-Z; with
    fewer words the whole sequence is the one shingle; empty without words."""
    words = word_hashes(data.lower())
    if 0 < len(words) < size:
        return window_hashes(words, len(words)) ^ np.uint64(len(words))
    return np.unique(window_hashes(words, size))


def shared_count(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int(np.count_nonzero(a[at] == b))
