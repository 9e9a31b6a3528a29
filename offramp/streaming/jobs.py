"""Corpus preparation and metric averages on arriving files."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from offramp.operators.chat import BOS, apply_chat_template, build_messages, insert_empty_system
from offramp.operators.decontaminate import Benchmark, benchmark_hits, decontaminate, without_hits
from offramp.operators.metrics import log_window, metric_name

# The state function travels to the tasks by value: executors need pandas, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# The column in which prepared rows of a stream carry their hits on a large benchmark.
HITS = "_benchmark_hits"


def prepare_stream(examples: DataFrame, benchmark: Benchmark | None = None, bos: str = BOS,
                   system: bool = False, key: str = "doc_id") -> DataFrame:
    """Messages, template and decontamination of streamed ``(key, prompt, text)`` rows.

    Every step works on its own row, so the stream keeps no state. A small benchmark decides the
    row. Of a large one the row gets its hits on the Bloom filter of the anchors, which ``run_prepare``
    confirms by joining each micro-batch with the items.
    """
    df = build_messages(examples) if "messages" not in examples.columns else examples
    df = apply_chat_template(insert_empty_system(df, system), bos)
    if benchmark is None:
        return df
    if benchmark.is_local:
        return decontaminate(df, benchmark, "text", key)
    return df.withColumn(HITS, benchmark_hits("text", benchmark))


def run_prepare(prepared: DataFrame, path: str, checkpoint: str, benchmark: Benchmark | None = None) -> StreamingQuery:
    """Process all files present, then stop. Started again on the same checkpoint, only new
    files are read and no row is written twice: each micro-batch has its own folder, replaced when it
    is repeated. ``read_prepared`` reads them.

    ``benchmark`` is the one ``prepare_stream`` was given; it is needed if it is a large one.
    """
    confirm = HITS in prepared.columns
    if confirm and benchmark is None:
        raise ValueError("the rows carry hits on a large benchmark: give it to run_prepare too")

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = without_hits(batch, HITS, benchmark) if confirm else batch
        kept.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")

    return (prepared.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_prepared(spark: SparkSession, path: str) -> DataFrame:
    """All rows written by ``run_prepare``."""
    return spark.read.parquet(path).drop("batch_id")


def window_means(metrics: DataFrame, every: int = 10) -> DataFrame:
    """Running ``log_window`` of a metric stream: a mean per run, window and name. The state has a
    row for each of them and is kept, as a late step may come at any time: steps / ``every`` rows a name."""
    return log_window(metrics, every)


def run_window_means(means: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the windows each micro-batch changed, one folder per micro-batch.

    A micro-batch that is repeated after a failure replaces its own folder.
    """
    def write(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")

    return (means.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_window_means(spark: SparkSession, path: str) -> DataFrame:
    """The latest state of every window written by ``run_window_means``."""
    latest = F.max_by(F.struct("value", "n"), "batch_id")
    return (spark.read.parquet(path).groupBy("run_id", "window", "metric").agg(latest.alias("s"))
            .select("run_id", "window", "metric", "s.value", "s.n"))


def _ending(every: int, late_steps: int):
    """Adds the rows of one run's metric to its open windows; returns those that ended.

    The state holds the largest step and ``{window: (sum, n)}`` of the open windows only.
    """
    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        high, held = state.get if state.exists else (None, "{}")
        windows = {int(w): tuple(v) for w, v in json.loads(held).items()}
        for rows in frames:
            if rows.empty:
                continue
            high = int(rows["step"].max()) if high is None else max(high, int(rows["step"].max()))
            for window, values in rows.groupby(rows["step"] // every)["value"]:
                total, n = windows.get(int(window), (0.0, 0))
                windows[int(window)] = (total + float(values.to_numpy().sum()), n + len(values))
        ended = sorted(w for w in windows if high is not None and w < (high - late_steps) // every)
        state.update((high, json.dumps({w: v for w, v in windows.items() if w not in set(ended)})))
        if ended:
            yield pd.DataFrame({"run_id": key[0], "window": ended, "metric": key[1],
                                "value": [windows[w][0] / windows[w][1] for w in ended],
                                "n": [windows[w][1] for w in ended]})

    return update


def ended_windows(metrics: DataFrame, every: int = 10, late_steps: int = 0) -> DataFrame:
    """``log_window`` of a metric stream, each window returned when it has ended.

    Steps rise in each run by itself, so a stream's one watermark would not do: for every run and
    metric name, a window has ended when a step ``late_steps`` or more behind it has come. It is returned
    once and its state goes, so the state is bounded by the windows that ``late_steps`` spans, and one.
    Rows that come even later are returned as a row of their own; ``read_ended_windows`` adds them up. The
    last window of a run stays open. Rows without a step or value take no part.
    """
    rows = metrics.where(F.col("step").isNotNull() & F.col("value").isNotNull()).select(
        "run_id", metric_name().alias("metric"), F.col("step").cast("bigint").alias("step"), F.col("value").cast("double").alias("value"))
    return rows.groupBy("run_id", "metric").applyInPandasWithState(
        _ending(every, late_steps), "run_id string, window bigint, metric string, value double, n bigint",
        "high bigint, windows string", "append", GroupStateTimeout.NoTimeout)


def run_ended_windows(windows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the windows that ended, one folder per micro-batch, replaced when it is repeated."""
    def write(ended: DataFrame, batch_id: int) -> None:
        ended.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")

    return (windows.writeStream.outputMode("append").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_ended_windows(spark: SparkSession, path: str) -> DataFrame:
    """All windows written by ``run_ended_windows``, late rows added up."""
    return (spark.read.parquet(path).groupBy("run_id", "window", "metric")
            .agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("value"), F.sum("n").alias("n")))
