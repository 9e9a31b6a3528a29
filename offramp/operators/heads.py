"""Hidden states of exits to logits, and the row filters that keep the scoring small.

Hidden states are rows ``(seq_id, pos, exit_layer, h)``, logits rows ``(seq_id, pos, exit_layer,
logits)`` with one dense vector per row: softmax, cross-entropy and prediction then
need no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offramp.functions.columns import doubles, let
from offramp.functions.vectors import dot, rms_norm

# Values (tokens x dimensions) of one exit's head that may travel as one broadcast row.
MAX_HEAD_VALUES = 4_000_000


def pack_heads(heads: DataFrame, max_values: int = MAX_HEAD_VALUES, tied: bool = False) -> DataFrame:
    """Gather head rows ``(exit_layer, token_id, w)`` into one matrix per exit, ordered by token.

    A head has a fixed size (vocabulary x dimensions) that does not grow with the scored
    data. The bound is still enforced while the matrix is built, so what is broadcast
    afterwards is known to be small.
    """
    grouped = heads.groupBy() if tied else heads.groupBy("exit_layer")
    size = F.sum(F.size("w").cast("bigint"))
    matrix = F.transform(F.array_sort(F.collect_list(F.struct("token_id", doubles("w").alias("w")))),
                         lambda e: e["w"])
    checked = F.when(size <= max_values, matrix).otherwise(F.raise_error(F.lit(
        "head too large to broadcast as a row: use exit_head_stats")).cast("array<array<double>>"))
    return grouped.agg(checked.alias("_head"))


def exit_head_logits(hidden: DataFrame, heads: DataFrame, tied: bool = False, eps: float = 1e-6,
                     norm_weights: DataFrame | None = None,
                     max_values: int = MAX_HEAD_VALUES) -> DataFrame:
    """Replace ``h`` by ``logits``: RMS norm, then the linear head of the row's exit.

    ``tied`` uses one head for all exits (rows ``(token_id, w)``), taken in as a scalar subquery;
    otherwise each exit's own head is joined on ``exit_layer``. ``norm_weights`` are
    optional rows ``(exit_layer, weight)``. Rows of exits without a head are dropped.
    """
    if norm_weights is not None:
        packed = norm_weights.groupBy("exit_layer").agg(
            F.when(F.count(F.lit(1)) == 1, F.first(doubles("weight"))).otherwise(F.raise_error(F.lit(
                "more than one norm weight for an exit")).cast("array<double>")).alias("_weight"))
        hidden = hidden.join(F.broadcast(packed), "exit_layer")
        normed = rms_norm("h", F.col("_weight"), eps)
    else:
        normed = rms_norm("h", None, eps)

    packed_heads = pack_heads(heads, max_values, tied)
    if tied:
        scored = hidden.withColumn("_head", packed_heads.scalar())
    else:
        scored = hidden.join(F.broadcast(packed_heads), "exit_layer")
    logits = let(normed, lambda x: F.transform("_head", lambda w: dot(w, x)))
    return scored.withColumn("logits", logits).drop("h", "_head", "_weight")


def prune_depth(hidden: DataFrame, exits: Sequence[int], full: bool,
                full_layer: int | None = None) -> DataFrame:
    """Drop layers below which nothing is asked for: all beyond the deepest requested exit.

    With ``full`` the full model is asked for, so every layer is kept. The filter is on a plain
    column and reaches the scan.
    """
    if full:
        return hidden
    if not exits:
        raise ValueError("no exit requested and the full model is off: nothing to compute")
    return hidden.where(F.col("exit_layer") <= max(exits))


def keep_last_logits(df: DataFrame, n: int, full_layer: int | None = None,
                     length: str = "seq_len") -> DataFrame:
    """Keep the last ``n`` positions of each sequence; 0 keeps all.

    With ``full_layer`` only that layer's rows are cut and the exits keep theirs. ``length`` is
    the sequence-length column; without one it is counted per sequence on its narrow columns.
    """
    if n < 0:
        raise ValueError("n must not be negative")
    if n == 0:
        return df
    counted = length not in df.columns
    if counted:
        lengths = df.groupBy("seq_id").agg((F.max("pos") + 1).alias(length))
        df = df.join(lengths, "seq_id")
    keep = F.col("pos") >= F.col(length) - n
    if full_layer is not None:
        keep = keep | (F.col("exit_layer") != full_layer)
    df = df.where(keep)
    return df.drop(length) if counted else df


def drop_virtual_tokens(df: DataFrame, v: int) -> DataFrame:
    """Drop the first ``v`` positions (learned prompt tokens) and count positions from 0 again."""
    if v < 0:
        raise ValueError("v must not be negative")
    return df.where(F.col("pos") >= v).withColumn("pos", F.col("pos") - v)
