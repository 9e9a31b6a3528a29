"""Metric rows: naming, widening, averaging over steps; table summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offramp.functions.columns import int_div


def dataset_summary(df: DataFrame, by: str | Sequence[str]) -> DataFrame:
    """Rows per group and their share of all rows (counted apart, without reading a column)."""
    by = [by] if isinstance(by, str) else list(by)
    grouped = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return grouped.select(*by, "rows", (F.col("rows") / total).alias("share"))


def loss_metrics(losses: DataFrame, step: str = "batch_id", run_id: str = "run") -> DataFrame:
    """Loss rows per exit to metric rows ``(run_id, step, metric, exit_layer, value)``."""
    pairs = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(name).alias("value"))
                      for name in ("ce_loss", "kl_loss") if name in losses.columns])
    return (losses.select(F.lit(run_id).alias("run_id"), F.col(step).alias("step"), "exit_layer",
                          F.explode(pairs).alias("m"))
            .where(F.col("m.value").isNotNull())
            .select("run_id", "step", F.col("m.metric").alias("metric"), "exit_layer",
                    F.col("m.value").alias("value")))


def metric_name() -> Column:
    """``metric_layer``, or the metric alone when it belongs to no layer."""
    return F.when(F.col("exit_layer").isNull(), F.col("metric")).otherwise(
        F.concat_ws("_", "metric", F.col("exit_layer").cast("string")))


def metric_log(df: DataFrame, names: Sequence[str], by: Sequence[str] = ("run_id", "step")) -> DataFrame:
    """Metric rows to one row per run and step with a column per name, e.g. ``ce_loss_16``.

    The names are given, so no pass over the data looks for them.
    """
    return (df.withColumn("_name", metric_name()).groupBy(*by)
            .pivot("_name", list(names)).agg(F.avg("value")))


def metric_columns(exits: Sequence[int], full_layer: int | None = None) -> list[str]:
    """The names one step logs: CE of every exit and of the full model, KL of every exit."""
    layers = list(exits) + ([full_layer] if full_layer is not None else [])
    return [f"ce_loss_{n}" for n in layers] + [f"kl_loss_{n}" for n in exits]


def window_of(step: str = "step", every: int = 10) -> Column:
    if every < 1:
        raise ValueError("every must be at least 1")
    return int_div(F.col(step), every)


def log_window(df: DataFrame, every: int = 10) -> DataFrame:
    """Mean of each run's metrics over every ``every`` steps, each exit under its own name
    (``ce_loss_16``)."""
    return (df.groupBy("run_id", window_of("step", every).alias("window"), metric_name().alias("metric"))
            .agg(F.avg("value").alias("value"), F.count("value").alias("n")))
