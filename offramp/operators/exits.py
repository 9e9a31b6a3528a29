"""Predictions per exit, exit policies and their statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offramp.functions.columns import let
from offramp.functions.kernels import logit_summary
from offramp.functions.vectors import argmax, logsumexp, top_k
from offramp.operators.losses import KERNEL_VOCAB


def as_layers(exits: int | Sequence[int] | None) -> list[int]:
    """One layer or several, as a list."""
    if exits is None:
        return []
    return [exits] if isinstance(exits, int) else list(exits)


def validate_exit_layers(requested: int | Sequence[int], built: Sequence[int] | None) -> list[int]:
    """The requested layers as a list; fails when one of them is not a built exit."""
    layers = as_layers(requested)
    if layers and built is None:
        raise ValueError(f"exits {layers} are requested but no built exits are given")
    missing = [layer for layer in layers if layer not in set(built or ())]
    if missing:
        raise ValueError(f"exits {missing} are requested but only {sorted(built)} are built")
    return layers


def invalid_exits(requested: DataFrame, built: DataFrame, column: str = "exit_layer") -> DataFrame:
    """Requested layers that are not built, as a table (empty when all is well)."""
    return requested.select(column).distinct().join(
        built.select(column).distinct(), column, "left_anti")


def exit_prediction(logits: DataFrame, k: int = 1, vocab_size: int | None = None) -> DataFrame:
    """Replace ``logits`` by ``token`` and ``confidence`` (the largest probability).

    The lowest token id wins a tie. With ``k`` above 1, ``top`` holds the k best
    ``(token, confidence)`` pairs as well.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if (vocab_size or 0) >= KERNEL_VOCAB:
        summary = logit_summary("logits")
        found = F.struct(summary["token"].alias("token"),
                         F.exp(summary["top"] - summary["lse"]).alias("confidence"),
                         summary["lse"].alias("lse"))
    else:
        found = let(logsumexp("logits"), lambda z: F.struct(
            argmax("logits").alias("token"),
            F.exp(F.array_max("logits").cast("double") - z).alias("confidence"), z.alias("lse")))
    df = logits.withColumn("_p", found)
    if k > 1:
        df = df.withColumn("top", F.transform(top_k("logits", k), lambda e: F.struct(
            e["token"].alias("token"), F.exp(e["logit"] - F.col("_p.lse")).alias("confidence"))))
    return (df.withColumn("token", F.col("_p.token")).withColumn("confidence", F.col("_p.confidence"))
            .drop("_p", "logits"))


def predictions_from_stats(stats: DataFrame) -> DataFrame:
    """``exit_prediction`` from the rows of ``exit_head_stats``: adds ``confidence`` to ``token``, and ``top``
    holds the best ``(token, confidence)`` pairs where there are ``best`` logits."""
    found = stats.withColumn("confidence", F.exp(F.col("top") - F.col("lse")))
    if "best" not in stats.columns:
        return found
    return found.withColumn("top", F.transform("best", lambda e: F.struct(
        e["token"].alias("token"), F.exp(e["logit"] - F.col("lse")).alias("confidence")))).drop("best")


def fixed_exit(df: DataFrame, exits: int | Sequence[int], built: Sequence[int] | None,
               full: bool = False, full_layer: int | None = None) -> DataFrame:
    """Rows of the configured exits, and of the full model when ``full``."""
    layers = validate_exit_layers(exits, built)
    if full:
        if full_layer is None:
            raise ValueError("full output needs the full layer's number")
        layers = layers + [full_layer]
    if not layers:
        raise ValueError("no exit requested and the full model is off")
    return df.where(F.col("exit_layer").isin(layers))


def _choice(threshold: float, full_layer: int, carried: Sequence[str]) -> Column:
    """Aggregate: the shallowest row above the threshold, or the full model's."""
    eligible = (F.col("confidence") > threshold) | (F.col("exit_layer") == full_layer)
    row = F.struct("exit_layer", "token", "confidence", *carried)
    return F.min_by(F.when(eligible, row), F.when(eligible, F.col("exit_layer")))


def early_exit_policy(preds: DataFrame, threshold: float, full_layer: int,
                      carried: Sequence[str] = ()) -> DataFrame:
    """Each position's shallowest exit with confidence above the threshold, else the full model.

    Returns ``(seq_id, pos, chosen_exit, token, confidence)`` and the ``carried`` columns. One
    aggregation; a position gathers at most one row per exit, and these shrink to one before
    the shuffle where they share a task.
    """
    chosen = preds.groupBy("seq_id", "pos").agg(_choice(threshold, full_layer, carried).alias("c"))
    return chosen.where(F.col("c").isNotNull()).select(
        "seq_id", "pos", F.col("c.exit_layer").alias("chosen_exit"), "c.token", "c.confidence",
        *[F.col(f"c.{name}").alias(name) for name in carried])


def _statistics(decisions: DataFrame, full_layers: int, by: Sequence[str], label: str | None) -> DataFrame:
    right = (F.col("token") == F.col(label)).cast("double") if label else F.lit(None).cast("double")
    grouped = decisions.groupBy(*by, "chosen_exit").agg(
        F.count(F.lit(1)).alias("positions"), F.avg(right).alias("accuracy"))
    return _shares(grouped, full_layers, by, label)


def _shares(grouped: DataFrame, full_layers: int, by: Sequence[str], label: str | None) -> DataFrame:
    """Shares, mean layers and saved compute from ``(*by, chosen_exit, positions, accuracy)``."""
    # One row per exit is left: the window below never holds more than the exits of a model.
    total = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    mean_layers = (F.sum(F.col("chosen_exit") * F.col("positions")).over(total)
                   / F.sum("positions").over(total))
    out = grouped.select(
        *by, "chosen_exit", "positions",
        (F.col("positions") / F.sum("positions").over(total)).alias("share"), "accuracy",
        mean_layers.alias("mean_layers"), (1.0 - mean_layers / full_layers).alias("compute_saved"))
    return out if label else out.drop("accuracy")


def exit_stats(decisions: DataFrame, full_layers: int, label: str | None = "label") -> DataFrame:
    """Per chosen exit: positions, share, accuracy; and the mean layers used and compute saved."""
    return _statistics(decisions, full_layers, (), label)


def threshold_sweep(preds: DataFrame, thresholds: Sequence[float], full_layer: int,
                    label: str | None = "label") -> DataFrame:
    """``exit_stats`` for several thresholds from one pass and one shuffle of the predictions.

    All thresholds are decided in the same aggregation; a row per threshold exists only
    afterwards, on the way into the small statistics.
    """
    carried = [label] if label else []
    aggs = [F.struct(F.lit(float(t)).alias("threshold"),
                     _choice(t, full_layer, carried).alias("c")) for t in thresholds]
    if not aggs:
        raise ValueError("no threshold given")
    decided = preds.groupBy("seq_id", "pos").agg(F.array(*aggs).alias("all"))
    rows = decided.select(F.explode("all").alias("d")).where(F.col("d.c").isNotNull()).select(
        "d.threshold", F.col("d.c.exit_layer").alias("chosen_exit"), F.col("d.c.token").alias("token"),
        *[F.col(f"d.c.{name}").alias(name) for name in carried])
    return _statistics(rows, full_layer, ("threshold",), label)


def exit_curve(preds: DataFrame, thresholds: Sequence[float], full_layer: int,
               label: str | None = "label") -> DataFrame:
    """``threshold_sweep`` for any number of thresholds.

    Going down the exits of a position, an exit is chosen for the thresholds from the largest
    confidence before it up to its own: one interval an exit. Where intervals begin and end is added up
    per exit and threshold (a difference array, combined before its exchange), and running sums over
    that small table give every threshold. The rows exchanged are the predictions, however many thresholds.
    """
    points = sorted({float(t) for t in thresholds})
    if not points:
        raise ValueError("no threshold given")
    # One literal, cut when the plan is built.
    bounds = F.split(F.lit(",".join(map(repr, points))), ",").cast("array<double>")
    steps = F.lit([1 << i for i in reversed(range(len(points).bit_length()))]).cast("array<int>")

    def below(value: Column) -> Column:
        """How many thresholds are smaller, by binary search."""
        return let(F.struct(bounds.alias("t"), value.alias("v")), lambda s: F.aggregate(
            steps, F.lit(0), lambda low, step: F.when(F.get(s["t"], low + step - 1) < s["v"], low + step).otherwise(low)))

    position = Window.partitionBy("seq_id", "pos").orderBy("exit_layer")
    before = F.max("confidence").over(position.rowsBetween(Window.unboundedPreceding, -1))
    right = (F.col("token") == F.col(label)).cast("bigint") if label else F.lit(None).cast("bigint")
    last = F.col("exit_layer") == full_layer
    reached = preds.where(F.col("exit_layer") <= full_layer).select("exit_layer", "confidence", last.alias("last"),
                                                                  before.alias("before"), right.alias("right"))
    intervals = reached.select(
        "exit_layer", "right", F.when(F.col("before").isNull(), 0).otherwise(below(F.col("before"))).alias("low"),
        F.when(F.col("last"), len(points)).when(F.col("confidence").isNull(), 0)
        .otherwise(below(F.col("confidence"))).alias("high")).where(F.col("low") < F.col("high"))

    def edge(at: str, sign: int) -> Column:
        return F.struct(F.col(at).alias("at"), F.lit(sign).cast("bigint").alias("n"),
                        (F.coalesce("right", F.lit(0)) * sign).alias("right"),
                        (F.col("right").isNotNull().cast("bigint") * sign).alias("known"))

    edges = intervals.select(F.col("exit_layer").alias("chosen_exit"),
                             F.explode(F.array(edge("low", 1), edge("high", -1))).alias("e")).select("chosen_exit", "e.*")
    changes = edges.groupBy("chosen_exit", "at").agg(*[F.sum(c).alias(c) for c in ("n", "right", "known")])
    # At most a row per exit and threshold from here on.
    along = Window.partitionBy("chosen_exit").orderBy("at")
    level = {c: F.sum(c).over(along.rowsBetween(Window.unboundedPreceding, 0)) for c in ("n", "right", "known")}
    until = F.coalesce(F.lead("at").over(along), F.lit(len(points)))
    runs = changes.select("chosen_exit", "at", until.alias("until"), *[v.alias(c) for c, v in level.items()])
    filled = runs.where((F.col("n") > 0) & (F.col("until") > F.col("at"))).select(
        F.explode(F.sequence("at", F.col("until") - 1)).alias("at"), "chosen_exit", F.col("n").alias("positions"),
        F.when(F.col("known") > 0, F.col("right") / F.col("known")).alias("accuracy"))
    grouped = filled.select(F.get(bounds, F.col("at")).alias("threshold"), "chosen_exit", "positions", "accuracy")
    return _shares(grouped, full_layer, ("threshold",), label)
