"""Losses and decisions for heads of large vocabularies, without ever holding the logits.

A hidden state of 4,096 values becomes a logit vector of 32,000 or more. Here a head is stored once
as vocabulary blocks in the folder that driver and executors share, and tasks read the blocks from
there. The hidden states are scanned once, however many blocks there are: a task multiplies a
bounded number of rows with one block after the other and keeps, per row, an online softmax (largest
logit and scaled sum), the best tokens so far, the target's logit and the divergence so far.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DoubleType, IntegerType, StructField, StructType)

from offramp.functions.columns import doubles
from offramp.session import scratch_path

# The scorer travels to the tasks by value: executors need numpy and pyarrow, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bytes of head weights in a block.
BLOCK_BYTES = 64 << 20
# Bytes of head blocks a task keeps; a head beyond that is read again for every group of rows.
KEPT_BYTES = 256 << 20
# Bytes of hidden states that go through the blocks together.
ROWS_BYTES = 64 << 20
# Values of one product held at a time inside a task (32 MB of doubles).
PRODUCT_VALUES = 4 << 20
IGNORED = -100

IDS = ("seq_id", "pos", "exit_layer")
VECTORS = ("h", "h_teacher")


@dataclass(frozen=True)
class StoredHeads:
    """Heads stored by ``store_heads``: for each exit (None: one head for all) its blocks in token
    order as ``(file, bytes of weights)``, and each exit's norm weights file, if there are any."""

    blocks: dict[int | None, list[tuple[str, int]]]
    norms: str | None
    same_tokens: bool


def store_heads(heads: DataFrame, tied: bool = False, block_bytes: int = BLOCK_BYTES,
                norm_weights: DataFrame | None = None) -> StoredHeads:
    """Write head rows ``(exit_layer, token_id, w)``, or ``(token_id, w)`` when ``tied``, as blocks of at
    most ``block_bytes`` (one token at least) to the shared folder, for any number of scorings.

    Every block is one file. The driver sees names and sizes of the blocks only.
    ``norm_weights`` are optional rows ``(exit_layer, weight)``.
    """
    spark = heads.sparkSession
    head = F.lit(-1) if tied else F.col("exit_layer")
    rows = heads.select(head.cast("int").alias("head"), F.col("token_id").cast("int").alias("token_id"), "w")
    width = rows.agg(F.max(F.size("w"))).first()[0]
    if width is None:
        raise ValueError("no head rows")
    block = F.floor(F.col("token_id") / F.lit(max(1, block_bytes // (8 * width)))).cast("int")
    path = scratch_path(spark, "heads")
    rows.withColumn("block", block).repartition("head", "block").write.partitionBy("head", "block").parquet(path)
    found = (spark.read.parquet(path)
             .groupBy("head", "block", F.input_file_name().alias("file"))
             .agg(F.sum(8 * F.size("w").cast("bigint")).alias("bytes"),
                  F.sum(F.xxhash64("token_id") % (1 << 30)).alias("tokens")).orderBy("head", "block").collect())
    blocks: dict[int | None, list[tuple[str, int]]] = {}
    tokens: dict[int, list] = {}
    for r in found:
        blocks.setdefault(None if tied else r["head"], []).append((r["file"], r["bytes"]))
        tokens.setdefault(r["head"], []).append((r["block"], r["tokens"]))
    norms = None
    if norm_weights is not None:
        norms = scratch_path(spark, "norms")
        checked = norm_weights.groupBy("exit_layer").agg(
            F.when(F.count(F.lit(1)) == 1, F.first(doubles("weight"))).otherwise(F.raise_error(F.lit(
                "more than one norm weight for an exit")).cast("array<double>")).alias("weight"))
        checked.repartition(1).write.parquet(norms)
        norms = spark.read.parquet(norms).inputFiles()[0]
    return StoredHeads(blocks, norms, all(t == next(iter(tokens.values())) for t in tokens.values()))


def exit_head_stats(hidden: DataFrame, heads: DataFrame | StoredHeads, target: str | None = None,
                    eps: float = 1e-6, block_bytes: int = BLOCK_BYTES, tied: bool = False,
                    teacher_layer: int | None = None, norm_weights: DataFrame | None = None, k: int = 1,
                    teacher: DataFrame | None = None, virtual_tokens: int = 0) -> DataFrame:
    """Replace ``h`` by what losses and decisions need from the logits.

    ``lse`` is the log-sum-exp, ``top`` the largest logit, ``token`` its id (lowest on a tie) and
    ``target_logit`` the logit of the ``target`` column's token (null when there is none or it is ignored; a
    token the head does not have raises). With ``k`` above 1, ``best`` holds the k best ``(token, logit)``.
    With ``teacher_layer``, ``kl`` is KL(teacher || exit) of the row, null for the teacher itself and
    where a position has no teacher; the teacher's states are rows of that layer, or of a separate
    ``teacher`` table whose positions are counted after the first ``virtual_tokens`` of ``hidden``. Hidden
    states, not logits, are exchanged to put each exit beside its teacher.

    ``heads`` are the rows that ``store_heads`` takes, or heads it has stored. ``hidden`` is read once and
    its rows stay where they are. A vector with NaN gives NaN, as dense logits do. Rows of exits
    without a head (or, with norm weights, without those) are dropped.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    stored = heads if isinstance(heads, StoredHeads) else store_heads(heads, tied, block_bytes, norm_weights)
    if teacher_layer is not None:
        if not stored.same_tokens:
            raise ValueError("a divergence needs heads over the same tokens")
        hidden = _beside_teacher(hidden, teacher_layer, teacher, virtual_tokens)
    return hidden.mapInArrow(_block_scorer(stored, target, eps, teacher_layer, k),
                             _stats_schema(hidden, teacher_layer, k))


def _beside_teacher(hidden: DataFrame, teacher_layer: int, teacher: DataFrame | None,
                    virtual_tokens: int) -> DataFrame:
    if teacher is not None:
        states = teacher.where(F.col("exit_layer") == teacher_layer).select(
            "seq_id", F.col("pos").alias("teacher_pos"), F.col("h").alias("h_teacher"))
        shifted = F.col("pos") - virtual_tokens == F.col("teacher_pos")
        return (hidden.join(states.withColumnRenamed("seq_id", "teacher_seq"),
                            (F.col("seq_id") == F.col("teacher_seq")) & shifted, "left")
                .drop("teacher_seq", "teacher_pos"))
    position = Window.partitionBy("seq_id", "pos")
    own = F.first(F.when(F.col("exit_layer") == teacher_layer, F.col("h")), ignorenulls=True)
    return hidden.withColumn("h_teacher", own.over(position))


def _stats_schema(hidden: DataFrame, teacher_layer: int | None, k: int) -> StructType:
    kept = [f for f in hidden.schema.fields if f.name not in VECTORS]
    added = [StructField("lse", DoubleType()), StructField("top", DoubleType()),
             StructField("token", IntegerType()), StructField("target_logit", DoubleType())]
    if k > 1:
        added.append(StructField("best", ArrayType(StructType([
            StructField("token", IntegerType()), StructField("logit", DoubleType())]))))
    if teacher_layer is not None:
        added.append(StructField("kl", DoubleType()))
    return StructType(kept + added)


def _read(uri: str, columns: list[str]) -> pa.Table:
    """A file of the shared folder, by whatever file system its name tells."""
    from urllib.parse import unquote, urlparse

    import pyarrow.fs as fs
    import pyarrow.parquet as pq
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        system, path = fs.LocalFileSystem(), unquote(parts.path)
    else:
        system, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return pq.read_table(path, filesystem=system, columns=columns, partitioning=None)


def _dense(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1).astype(np.float64)


class _Blocks:
    """Reads blocks ``(token ids, weights with a column per token)``; keeps them if all of them fit."""

    def __init__(self, stored: StoredHeads, kept_bytes: int):
        self.blocks = stored.blocks
        self.keep = sum(size for b in stored.blocks.values() for _, size in b) <= kept_bytes
        self.held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, head: int | None, number: int) -> tuple[np.ndarray, np.ndarray]:
        file = self.blocks[head][number][0]
        if file in self.held:
            return self.held[file]
        table = _read(file, ["token_id", "w"])
        ids = table["token_id"].to_numpy().astype(np.int32)
        order = np.argsort(ids, kind="stable")
        block = ids[order], _dense(table["w"])[order].T
        if self.keep:
            self.held[file] = block
        return block


class _Softmax:
    """Online log-sum-exp of rows whose logits come block by block."""

    def __init__(self, n: int):
        self.top, self.total = np.full(n, -np.inf), np.zeros(n)

    def add(self, rows: slice, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Returns the exponentials of ``z`` over the new largest logit, and the factor for older sums."""
        top = np.maximum(self.top[rows], z.max(axis=1))
        with np.errstate(invalid="ignore"):
            older, new = np.exp(self.top[rows] - top), np.exp(z - top[:, None])
        self.total[rows] = self.total[rows] * older + new.sum(axis=1)
        self.top[rows] = top
        return new, older

    def lse(self) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.top + np.log(self.total)


def _best_of(values: np.ndarray, tokens: np.ndarray, z: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best logits of those held and of a block; the lower token first on a tie, NaN first of all."""
    k, row = values.shape[1], np.arange(len(z))
    z = z.copy() if k > 1 else z
    new, new_ids = np.full(values.shape, -np.inf), np.full(values.shape, -1, np.int32)
    for place in range(min(k, z.shape[1])):
        at = z.argmax(axis=1)
        new[:, place], new_ids[:, place] = z[row, at], ids[at]
        if k > 1:
            z[row, at] = -np.inf
    both, both_ids = np.hstack([values, new]), np.hstack([tokens, new_ids])
    empty = both_ids < 0
    key = np.where(empty, np.inf, np.where(np.isnan(both), -np.inf, -both))
    order = np.lexsort((empty, key), axis=1)[:, :k]
    return np.take_along_axis(both, order, 1), np.take_along_axis(both_ids, order, 1)


def _block_scorer(stored: StoredHeads | None, target: str | None, eps: float, teacher_layer: int | None, k: int = 1,
                  rows_bytes: int = ROWS_BYTES, kept_bytes: int = KEPT_BYTES):
    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += sum(batch.column(c).nbytes for c in VECTORS if c in batch.schema.names)
            if size >= rows_bytes:
                yield held
                held, size = [], 0
        if held:
            yield held

    def normed(vectors: pa.Array, weight: np.ndarray | None) -> np.ndarray:
        x = _dense(vectors)
        x = x / np.sqrt((x * x).mean(axis=1, keepdims=True) + eps)
        return x if weight is None else x * weight

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(stored, kept_bytes)
        tied = None in stored.blocks
        norms = None
        if stored.norms:
            table = _read(stored.norms, ["exit_layer", "weight"])
            norms = {e: np.array(w, np.float64) for e, w in zip(*(table[c].to_pylist() for c in ("exit_layer", "weight")))}
        for held in grouped(batches):
            table = pa.Table.from_batches(held).combine_chunks()
            exits = table["exit_layer"].to_numpy()
            known = [e for e in np.unique(exits).tolist() if (tied or e in stored.blocks) and (norms is None or e in norms)]
            for exit_layer in known:
                rows = table.take(pa.array(np.flatnonzero(exits == exit_layer)))
                yield from scored(rows, exit_layer, None if tied else exit_layer, blocks, norms).to_batches()

    def scored(rows: pa.Table, exit_layer: int, head: int | None, blocks: _Blocks, norms) -> pa.Table:
        n = rows.num_rows
        x = normed(rows["h"], norms and norms[exit_layer])
        pairs = None
        if teacher_layer is not None and exit_layer != teacher_layer and (norms is None or teacher_layer in norms):
            pairs = np.flatnonzero(rows["h_teacher"].is_valid().to_numpy())
            t_all = normed(rows["h_teacher"].take(pa.array(pairs)), norms and norms[teacher_layer])
            teacher, cross = _Softmax(len(pairs)), np.zeros(len(pairs))
            teacher_head = None if head is None else teacher_layer
        softmax, at = _Softmax(n), np.full(n, np.nan)
        values, tokens = np.full((n, k), -np.inf), np.full((n, k), -1, np.int32)
        wanted = np.full(n, IGNORED, np.int64)
        if target:
            given = rows[target]
            wanted = given.fill_null(IGNORED).to_numpy().astype(np.int64)
        missing = wanted != IGNORED
        for number in range(len(blocks.blocks[head])):
            ids, w = blocks.of(head, number)
            step = max(1, PRODUCT_VALUES // len(ids))
            place = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
            hit = missing & (ids[place] == wanted)
            missing &= ~hit
            for first in range(0, n, step):
                some = slice(first, first + step)
                z = x[some] @ w
                softmax.add(some, z)
                values[some], tokens[some] = _best_of(values[some], tokens[some], z, ids)
                mine = np.flatnonzero(hit[some])
                at[first + mine] = z[mine, place[some][mine]]
                if pairs is not None:
                    low, high = np.searchsorted(pairs, [first, first + step])
                    t = t_all[low:high] @ blocks.of(teacher_head, number)[1]
                    share, older = teacher.add(slice(low, high), t)
                    apart = np.where(share == 0, 0.0, share * (t - z[pairs[low:high] - first]))
                    cross[low:high] = cross[low:high] * older + apart.sum(axis=1)
        if missing.any():
            raise ValueError(f"target outside the vocabulary: {wanted[missing][0]}")
        lse = softmax.lse()
        added = {"lse": pa.array(lse), "top": pa.array(values[:, 0]), "token": pa.array(tokens[:, 0]),
                 "target_logit": pa.array(at, mask=wanted == IGNORED)}
        if k > 1:
            real = tokens >= 0
            best = pa.StructArray.from_arrays([pa.array(tokens[real]), pa.array(values[real])], names=["token", "logit"])
            added["best"] = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(real.sum(axis=1))]).astype(np.int32), best)
        if teacher_layer is not None:
            kl, unpaired = np.zeros(n), np.ones(n, bool)
            if pairs is not None:
                kl[pairs] = cross / teacher.total - teacher.lse() + lse[pairs]
                unpaired[pairs] = False
            added["kl"] = pa.array(kl, mask=unpaired)
        kept = {name: rows[name] for name in rows.schema.names if name not in VECTORS}
        return pa.table(kept | added)

    return score
