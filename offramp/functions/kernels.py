"""Arrow kernels: columnar functions for what array expressions do slowly.

Each one is a scalar Arrow UDF. It sees one Arrow batch, keeps no state and never looks at
another row, so Spark keeps full control of partitioning, and a projection that does not use
the result drops the call.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

# Kernels travel to the tasks by value: executors need numpy and pyarrow, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SUMMARY = StructType([StructField("lse", DoubleType()), StructField("top", DoubleType()),
                       StructField("token", IntegerType())])

# Values handled at a time inside a batch (16 MB of doubles).
_CHUNK = 2 << 20


def token_encoder(tokens: list[str], ids: list[int], unk: int) -> Callable:
    """``ARRAY<STRING>`` -> ``ARRAY<INT>``: id of every word, ``unk`` for unknown words."""
    known = pa.array(tokens, pa.string())
    known_ids = pa.array(ids, pa.int32())

    @F.arrow_udf(ArrayType(IntegerType()))
    def encode(batch: pa.Array) -> pa.Array:
        flat = batch.flatten()
        value_set = known.cast(flat.type)
        found = pa.concat_arrays([pa.array([], pa.int32())] + [
            pc.fill_null(pc.take(known_ids, pc.index_in(flat.slice(at, _CHUNK), value_set=value_set)), pa.scalar(unk, pa.int32()))
            for at in range(0, len(flat), _CHUNK)])
        sizes = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, found, mask=batch.is_null())

    return encode


def _rows(batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    sizes = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False)
    flat = batch.flatten().to_numpy(zero_copy_only=False)
    return flat, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _blocks(offsets: np.ndarray):
    """Runs of consecutive rows of equal size, cut to at most ``_CHUNK`` values."""
    sizes = np.diff(offsets)
    n, start = len(sizes), 0
    while start < n:
        limit = start + max(1, _CHUNK // max(1, int(sizes[start])))
        stop = start + 1
        while stop < min(n, limit) and sizes[stop] == sizes[start]:
            stop += 1
        yield start, stop, int(sizes[start])
        start = stop


@F.arrow_udf(_SUMMARY)
def logit_summary(logits: pa.Array) -> pa.Array:
    """Log-sum-exp, largest logit and its index (lowest on a tie) of each vector."""
    flat, offsets = _rows(logits)
    n = len(logits)
    lse, top, token = np.full(n, np.nan), np.full(n, np.nan), np.zeros(n, np.int32)
    for a, b, width in _blocks(offsets):
        if width:
            x = flat[offsets[a]:offsets[b]].reshape(b - a, width).astype(np.float64)
            token[a:b] = x.argmax(axis=1)
            m = x.max(axis=1)
            top[a:b] = m
            lse[a:b] = m + np.log(np.exp(x - m[:, None]).sum(axis=1))
    empty = np.diff(offsets) == 0
    return pa.StructArray.from_arrays(
        [pa.array(lse, mask=empty), pa.array(top, mask=empty), pa.array(token, mask=empty)],
        names=["lse", "top", "token"])


@F.arrow_udf(DoubleType())
def kl_kernel(teacher: pa.Array, student: pa.Array) -> pa.Array:
    """KL(teacher || student) of each pair of logit vectors; null where one of them is."""
    both = pc.and_(teacher.is_valid(), student.is_valid())
    at = np.flatnonzero(both.to_numpy(zero_copy_only=False))
    t_flat, t_off = _rows(teacher.filter(both))
    s_flat, s_off = _rows(student.filter(both))
    if not np.array_equal(t_off, s_off):
        raise ValueError("teacher and student logits differ in size")
    out, empty = np.full(len(teacher), np.nan), np.ones(len(teacher), bool)
    empty[at] = np.diff(t_off) == 0
    for a, b, width in _blocks(t_off):
        if width:
            t = t_flat[t_off[a]:t_off[b]].reshape(b - a, width).astype(np.float64)
            s = s_flat[s_off[a]:s_off[b]].reshape(b - a, width).astype(np.float64)
            t -= t.max(axis=1, keepdims=True)
            s -= s.max(axis=1, keepdims=True)
            t -= np.log(np.exp(t).sum(axis=1, keepdims=True))
            s -= np.log(np.exp(s).sum(axis=1, keepdims=True))
            p = np.exp(t)
            with np.errstate(invalid="ignore"):
                out[at[a:b]] = np.where(p == 0, 0.0, p * (t - s)).sum(axis=1)
    return pa.array(out, mask=empty)
