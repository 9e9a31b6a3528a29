"""A split-block Bloom filter of 64-bit keys: built by Spark, tested row by row in Arrow batches.

A key sets one bit in each of the eight 32-bit words of one block, so a test touches 32 bytes. The
filter never misses a key it holds; of other keys it passes a few in a hundred thousand at 32 bits a key.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The test travels to the tasks by value: executors need numpy and pyarrow, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS = 8
BITS_PER_KEY = 32
# A small set of keys gets this, a larger one no more than that, and passes more keys that it does not hold.
MIN_BYTES, MAX_BYTES = 1 << 20, 64 << 20
# An odd multiplier for each word.
_SALTS = [pow(0x9E3779B1, i + 1, 1 << 32) for i in range(WORDS)]
_LOW = (1 << 31) - 1
# Parts whose runs are hashed at a time (a longer row stays whole).
_PARTS = 1 << 18


def build_filter(keys: DataFrame, column: str, count: int, max_bytes: int = MAX_BYTES) -> np.ndarray:
    """The filter's blocks, sized for ``count`` keys. Bits are set by a bitwise-or aggregation, so a row
    per block, 36 bytes, is all that reaches the driver."""
    blocks = max(1, min(max(count * BITS_PER_KEY // 8, MIN_BYTES), max_bytes) // (4 * WORDS))
    key = F.col(column)
    low = key.bitwiseAND(F.lit(_LOW))
    block = (F.shiftrightunsigned(key, 31) % F.lit(blocks)).cast("int")
    one = F.lit(1).cast("int")
    masks = [F.bit_or(F.call_function("shiftleft", one, (F.shiftright(low * F.lit(salt), 27) % 32).cast("int"))).alias(f"w{i}")
             for i, salt in enumerate(_SALTS)]
    rows = keys.where(key.isNotNull()).groupBy(block.alias("block")).agg(*masks).toArrow()
    out = np.zeros((blocks, WORDS), np.uint32)
    if rows.num_rows:
        out[rows["block"].to_numpy()] = np.stack([rows[f"w{i}"].to_numpy() for i in range(WORDS)], 1).view(np.uint32)
    return out


def held_by(blocks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The places of the keys that the filter passes."""
    keys = keys.view(np.uint64)
    block = ((keys >> np.uint64(31)) % np.uint64(len(blocks))).astype(np.int64)
    low = keys & np.uint64(_LOW)
    at = np.arange(len(keys))
    for i, salt in enumerate(_SALTS):
        bit = ((low[at] * np.uint64(salt)) >> np.uint64(27)) & np.uint64(31)
        at = at[(blocks[block[at], i] >> bit.astype(np.uint32)) & np.uint32(1) == 1]
    return at


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


# The primes of the public 64-bit xxHash.
_P1, _P2, _P3, _P4, _P5 = (np.full(1, p, np.uint64) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def run_hashes(parts: np.ndarray, length: int, kind: int) -> np.ndarray:
    """``F.xxhash64(kind, part, part, ...)`` of every run of ``length`` parts (64-bit whole numbers)."""
    n = len(parts) - length + 1
    if n < 1:
        return np.zeros(0, np.int64)
    # the hash of a 32-bit number, then of one 64-bit number after the other, each seeded by the last
    seed = np.full(1, 42, np.uint64) + _P5 + np.uint64(4)
    seed = seed ^ (np.full(1, kind & 0xFFFFFFFF, np.uint64) * _P1)
    seed = np.repeat(_mixed(_rotated(seed, 23) * _P2 + _P3), n)
    rounds = _rotated(parts.view(np.uint64) * _P2, 31) * _P1
    for j in range(length):
        seed = _mixed(_rotated((seed + _P5 + np.uint64(8)) ^ rounds[j:j + n], 27) * _P1 + _P4)
    return seed.view(np.int64)


def passing_runs(blocks: np.ndarray, kinds: list[list[int]], parts: Column) -> Column:
    """For one or more lists of part hashes in a row (``ARRAY<ARRAY<BIGINT>>``): the runs of parts whose
    hash the filter passes, as ``(at, key)``. ``kinds`` holds, for each list, the kinds of runs sought in
    it: a kind is the length of its runs, up to its sign, and takes part in their hash."""

    @F.arrow_udf("array<struct<at:int,key:bigint>>")
    def test(rows: pa.Array) -> pa.Array:
        # rows are taken some at a time: the hashes take many times the bytes of the parts
        sizes = np.zeros(len(rows), np.int64)
        for number in range(len(kinds)):
            sizes += pc.fill_null(pc.list_value_length(pc.list_element(rows, number)), 0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // _PARTS, prepend=0)).tolist()
        starts = sorted({0, *cuts})
        return pa.concat_arrays([tested(rows.slice(a, b - a)) for a, b in zip(starts, [*starts[1:], len(rows)])])

    def tested(rows: pa.Array) -> pa.Array:
        n, found = len(rows), []
        for number, wanted in enumerate(kinds):
            lists = pc.list_element(rows, number)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, values = np.cumsum(sizes), lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(n), sizes)
            room = ends[row] - np.arange(len(row))
            for kind in wanted:
                keys = run_hashes(values, abs(kind), kind)
                at = held_by(blocks, keys)
                at = at[room[at] >= abs(kind)]
                found.append((row[at], at - (ends - sizes)[row[at]], keys[at]))
        row, at, keys = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(row, kind="stable")
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(
            [pa.array(at[order].astype(np.int32)), pa.array(keys[order])], names=["at", "key"]))

    # so marked, it is not run once more for a filter on its result
    return test.asNondeterministic()(parts)
