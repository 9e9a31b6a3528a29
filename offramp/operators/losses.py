"""Cross-entropy and divergence per exit, their means, and the distillation loss."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offramp.functions.kernels import kl_kernel, logit_summary
from offramp.functions.vectors import at, kl_divergence, logsumexp
from offramp.operators.sequences import IGNORE_LABEL

# Vocabulary size from which the Arrow kernels are used.
KERNEL_VOCAB = 1_000


def attach_targets(df: DataFrame, labels: DataFrame, shift: bool = True, label: str = "label",
                   target: str = "target") -> DataFrame:
    """Give each ``(seq_id, pos)`` row its target; null where there is none or it is ignored.

    With ``shift`` the target is the label of the next position. Shifting the label table's
    position makes that an equal join without a window. Attach targets to hidden states, before
    they become logits: the rows in the shuffle are then an order of magnitude smaller.
    """
    pos = F.col("pos") - 1 if shift else F.col("pos")
    wanted = (labels.where(F.col(label) != IGNORE_LABEL)
              .select("seq_id", pos.cast("bigint").alias("_pos"), F.col(label).cast("int").alias(target)))
    joined = df.withColumn("_pos", F.col("pos").cast("bigint")).join(wanted, ["seq_id", "_pos"], "left")
    return joined.drop("_pos")


def cross_entropy(target: Column | str, logits: str = "logits", vocab_size: int | None = None) -> Column:
    """``logsumexp(logits) - logits[target]``; null when the target is null or ignored.

    A target outside the vocabulary fails instead of being averaged away.
    """
    target = F.col(target) if isinstance(target, str) else target
    lse = logit_summary(logits)["lse"] if (vocab_size or 0) >= KERNEL_VOCAB else logsumexp(logits)
    inside = (target >= 0) & (target < F.size(logits))
    value = F.when(inside, lse - at(logits, target)).otherwise(
        F.raise_error(F.lit("target outside the vocabulary")).cast("double"))
    return F.when(target.isNotNull() & (target != IGNORE_LABEL), value)


def exit_ce_loss(logits: DataFrame, labels: DataFrame | None = None, shift: bool = True,
                 by: Sequence[str] = ("batch_id",), target: str = "target",
                 vocab_size: int | None = None) -> DataFrame:
    """Mean cross-entropy per exit over the positions that have a target.

    Without ``labels`` the target is read from the rows and nothing wide is shuffled: each
    row becomes one number, and the mean is combined before its exchange.
    """
    if labels is not None:
        logits = attach_targets(logits, labels, shift, target=target)
    rows = logits.select(*by, "exit_layer", cross_entropy(target, vocab_size=vocab_size).alias("_ce"))
    return rows.groupBy(*by, "exit_layer").agg(F.avg("_ce").alias("ce_loss"),
                                               F.count("_ce").alias("ce_positions"))


def _pair_with_teacher(logits: DataFrame, teacher_layer: int, teacher: DataFrame | None,
                       virtual_tokens: int) -> DataFrame:
    """Put the teacher's logits of a position beside each row, null where there are none.

    Within one table this is a window over the few rows of a position: one scan and one exchange
    for all exits, and whatever produced the logits runs once. Two tables are joined: on tables
    bucketed by ``seq_id`` alike (``write_bucketed``) without an exchange, also with shifted positions, if
    the session allows joins to use a part of their keys (``spark.sql.requireAllClusterKeysForCoPartition`` off).
    """
    is_teacher = F.col("exit_layer") == teacher_layer
    if teacher is None:
        if virtual_tokens:
            raise ValueError("only a separate teacher has other positions")
        position = Window.partitionBy("seq_id", "pos")
        return logits.withColumn("_teacher", F.first(
            F.when(is_teacher, F.col("logits")), ignorenulls=True).over(position))
    if virtual_tokens < 0:
        raise ValueError("virtual_tokens must not be negative")
    beside = teacher.where(is_teacher).select(
        F.col("seq_id").alias("_seq"), F.col("pos").alias("_pos"), F.col("logits").alias("_teacher"))
    same = (F.col("seq_id") == F.col("_seq")) & (F.col("pos") - virtual_tokens == F.col("_pos"))
    return logits.join(beside, same, "left").drop("_seq", "_pos")


def _kl(vocab_size: int | None) -> Column:
    if (vocab_size or 0) >= KERNEL_VOCAB:
        return kl_kernel("_teacher", "logits")
    return kl_divergence("_teacher", "logits")


def _per_sequence(rows: DataFrame, by: Sequence[str], extra: list[Column]) -> DataFrame:
    """Sums per sequence of rows with ``_kl`` and ``_paired`` (the position has a teacher)."""
    return rows.groupBy(*by, "exit_layer", "seq_id").agg(
        F.sum("_kl").alias("_kl"), F.count("_kl").alias("_kl_n"), F.max("_paired").alias("_paired"), *extra)


def _reduced_kl(per_sequence: DataFrame, by: Sequence[str], reduction: str, extra: list[Column]) -> DataFrame:
    sequences = F.count_if("_paired")
    if reduction == "batchmean":
        kl = F.when(sequences > 0, F.coalesce(F.sum("_kl"), F.lit(0.0)) / sequences)
    elif reduction == "token_mean":
        kl = F.when(F.sum("_kl_n") > 0, F.sum("_kl") / F.sum("_kl_n"))
    else:
        raise ValueError(f"unknown reduction {reduction!r}")
    return per_sequence.groupBy(*by, "exit_layer").agg(kl.alias("kl_loss"), *extra)


def exit_kl_loss(logits: DataFrame, teacher_layer: int, by: Sequence[str] = ("batch_id",),
                 reduction: str = "batchmean", mask: str | None = None,
                 vocab_size: int | None = None, teacher: DataFrame | None = None,
                 virtual_tokens: int = 0) -> DataFrame:
    """KL(teacher || exit) per exit.

    ``batchmean`` sums over positions and vocabulary and divides by the number of sequences;
    ``token_mean`` divides by the positions. Positions where ``mask`` is 0 add
    nothing; without it all count. The teacher is the ``teacher_layer`` of the same rows, or of a
    separate ``teacher`` table (a run with adapters off, or another model), whose positions are counted
    after the first ``virtual_tokens`` (learned prompt tokens) of ``logits``. Positions
    without a teacher do not count.

    One exchange on ``(seq_id, pos)`` serves all exits. Sums go through one row per
    sequence first, so the count of sequences needs no distinct.
    """
    paired = _pair_with_teacher(logits, teacher_layer, teacher, virtual_tokens).where(
        (F.col("exit_layer") != teacher_layer) & F.col("_teacher").isNotNull())
    value = _kl(vocab_size)
    if mask is not None:
        value = F.when(F.col(mask) == 1, value)
    rows = paired.select(*by, "exit_layer", "seq_id", value.alias("_kl"), F.lit(True).alias("_paired"))
    return _reduced_kl(_per_sequence(rows, by, []), by, reduction, [])


def exit_losses(logits: DataFrame, teacher_layer: int, by: Sequence[str] = ("batch_id",),
                target: str = "target", reduction: str = "batchmean", mask: str | None = None,
                vocab_size: int | None = None, teacher: DataFrame | None = None,
                virtual_tokens: int = 0) -> DataFrame:
    """CE and KL of every exit from one pairing with the teacher; KL is null for the teacher itself.

    The CE is over all positions with a target, whether or not they have a teacher. Use it where
    both losses are wanted: the logits are read and exchanged once. ``teacher`` as for ``exit_kl_loss``.
    """
    paired = _pair_with_teacher(logits, teacher_layer, teacher, virtual_tokens)
    is_paired = (F.col("exit_layer") != teacher_layer) & F.col("_teacher").isNotNull()
    value = F.when(is_paired & (F.col(mask) == 1) if mask is not None else is_paired, _kl(vocab_size))
    rows = paired.select(*by, "exit_layer", "seq_id", value.alias("_kl"), is_paired.alias("_paired"),
                         cross_entropy(target, vocab_size=vocab_size).alias("_ce"))
    return _reduced_losses(rows, by, reduction)


def exit_losses_from_stats(stats: DataFrame, teacher_layer: int, by: Sequence[str] = ("batch_id",),
                           reduction: str = "batchmean", mask: str | None = None) -> DataFrame:
    """``exit_losses`` from the rows of ``exit_head_stats``, whose ``kl`` is null where there is no teacher.
    Without a ``kl`` column the divergences are null."""
    kl = F.col("kl") if "kl" in stats.columns else F.lit(None).cast("double")
    paired = (F.col("exit_layer") != teacher_layer) & kl.isNotNull()
    value = F.when(paired & (F.col(mask) == 1) if mask is not None else paired, kl)
    rows = stats.select(*by, "exit_layer", "seq_id", value.alias("_kl"), paired.alias("_paired"),
                        (F.col("lse") - F.col("target_logit")).alias("_ce"))
    return _reduced_losses(rows, by, reduction)


def _reduced_losses(rows: DataFrame, by: Sequence[str], reduction: str) -> DataFrame:
    per_sequence = _per_sequence(rows, by, [F.sum("_ce").alias("_ce"), F.count("_ce").alias("_ce_n")])
    ce = F.when(F.sum("_ce_n") > 0, F.sum("_ce") / F.sum("_ce_n")).alias("ce_loss")
    return _reduced_kl(per_sequence, by, reduction, [ce]).select(*by, "exit_layer", "ce_loss", "kl_loss")


def mean_over_exits(losses: DataFrame, full_layer: int, by: Sequence[str] = ("batch_id",),
                    include_full: bool = True) -> DataFrame:
    """Plain means over exits: ``ce_mean`` with the full model unless told otherwise, ``kl_mean``
    over the exits only."""
    is_exit = F.col("exit_layer") != full_layer
    ce = F.col("ce_loss") if include_full else F.when(is_exit, F.col("ce_loss"))
    aggs = []
    if "ce_loss" in losses.columns:
        aggs.append(F.avg(ce).alias("ce_mean"))
    if "kl_loss" in losses.columns:
        aggs.append(F.avg(F.when(is_exit, F.col("kl_loss"))).alias("kl_mean"))
    return losses.groupBy(*by).agg(*aggs)


def distill_loss(logits: DataFrame, teacher_layer: int, kl_weight: float = 0.1, ce_weight: float = 1.0,
                 by: Sequence[str] = ("batch_id",), target: str = "target",
                 vocab_size: int | None = None, teacher: DataFrame | None = None,
                 virtual_tokens: int = 0) -> DataFrame:
    """``kl_weight * kl_mean + ce_weight * ce_mean`` per group.

    With a KL weight of zero or less the divergence is 0 and its exchange is not planned at all;
    the CE is the same at any weight. ``teacher`` as for ``exit_kl_loss``.
    """
    if kl_weight > 0:
        losses = exit_losses(logits, teacher_layer, by, target, vocab_size=vocab_size, teacher=teacher,
                             virtual_tokens=virtual_tokens)
        means = mean_over_exits(losses, teacher_layer, by)
    else:
        losses = exit_ce_loss(logits, by=by, target=target, vocab_size=vocab_size)
        means = mean_over_exits(losses, teacher_layer, by).withColumn("kl_mean", F.lit(0.0))
    kl_part = F.coalesce("kl_mean", F.lit(0.0)) * kl_weight if kl_weight > 0 else F.lit(0.0)
    ce_part = F.col("ce_mean") * ce_weight if ce_weight != 0 else F.lit(0.0)
    return means.select(*by, "ce_mean", "kl_mean", (kl_part + ce_part).alias("loss"))
