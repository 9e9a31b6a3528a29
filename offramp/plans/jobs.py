"""The three jobs a user runs: prepare a corpus, evaluate a step, decide exits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offramp.operators.chat import BOS, apply_chat_template, build_messages, insert_empty_system
from offramp.operators.decontaminate import Benchmark, decontaminate, load_benchmark
from offramp.operators.exits import (early_exit_policy, exit_prediction, fixed_exit,
                                     predictions_from_stats, validate_exit_layers)
from offramp.operators.head_blocks import StoredHeads, exit_head_stats
from offramp.operators.heads import exit_head_logits, prune_depth
from offramp.operators.losses import exit_ce_loss, exit_losses, exit_losses_from_stats
from offramp.operators.metrics import loss_metrics, metric_columns, metric_log
from offramp.sources.tables import fingerprint, mix_datasets, prepare_or_load


@dataclass(frozen=True)
class CorpusSettings:
    """Settings of a prepared corpus; together they name the stored set."""

    mixer: Mapping[str, float] = field(default_factory=dict)
    split: str = "train"
    seed: int = 42
    bos: str = BOS
    empty_system: bool = False
    decontaminate: bool = False
    ngram: int = 8


@dataclass(frozen=True)
class DistillSettings:
    """Settings of exits and losses.

    ``vocab_size`` is the length of the logit vectors, where it is known: from about a thousand tokens
    on they are reduced by kernels. ``virtual_tokens`` are learned prompt tokens in front of the
    exits' positions, which a separate teacher does not have.
    """

    output_exit_layers: int | Sequence[int] | None = None
    exit_layer_indices: Sequence[int] | None = None
    full_layer: int = 32
    output_full_model: bool = True
    tie_exit_lm_head: bool = False
    kl_weight: float = 0.1
    ce_weight: float = 1.0
    vocab_size: int | None = None
    virtual_tokens: int = 0


def template_corpus(df: DataFrame, settings: CorpusSettings,
                    benchmark: DataFrame | Benchmark | None = None, key: str = "doc_id") -> DataFrame:
    """``(key, prompt, text)`` or ``(key, messages)`` rows to templated, decontaminated text."""
    if "messages" not in df.columns:
        df = build_messages(df)
    df = apply_chat_template(insert_empty_system(df, settings.empty_system), settings.bos)
    if settings.decontaminate:
        if benchmark is None:
            raise ValueError("decontamination is on but no benchmark is given")
        df = decontaminate(df, benchmark, "text", key, settings.ngram)
    return df


def prepare_corpus(spark: SparkSession, sources: Mapping[str, DataFrame], path: str,
                   settings: CorpusSettings, benchmark: DataFrame | None = None,
                   key: str = "doc_id", num_shards: int = 64) -> DataFrame:
    """Mix, template, decontaminate and store; or load what was stored before.

    Each source with a fraction above zero has a set of its own, named after what it was made from:
    its settings, its rows and the benchmark's. When one source, or its fraction, changes, only that one is
    prepared again; a changed benchmark prepares all of them. ``num_shards`` are shared out over the sources;
    a source with more bytes gets more, as in ``prepare_or_load``.
    """
    fractions = dict(settings.mixer) or {name: 1.0 for name in sources}
    unknown = sorted(set(fractions) - set(sources))
    if unknown:
        raise ValueError(f"no such sources: {unknown}")
    wanted = [name for name, f in fractions.items() if f != 0.0] or list(fractions)[:1]
    loaded: list[Benchmark] = []

    def mixed_rows(name: str) -> DataFrame:
        mixed = mix_datasets({name: (sources[name], fractions[name])}, settings.seed, key)
        if "split" in mixed.columns:
            mixed = mixed.where(F.col("split") == settings.split).drop("split")
        return mixed

    def build(name: str) -> DataFrame:
        mixed = mixed_rows(name)
        if settings.decontaminate and benchmark is not None and not loaded:
            loaded.append(load_benchmark(benchmark, "text", settings.ngram))
        return template_corpus(mixed, settings, loaded[0] if loaded else None, key)

    shards = max(1, num_shards // len(wanted))
    common = {k: v for k, v in asdict(settings).items() if k != "mixer"} | {"key": key, "shards": shards}
    parts = []
    for name in wanted:
        inputs = {"source": sources[name]}
        if settings.decontaminate and benchmark is not None:
            inputs["benchmark"] = benchmark
        parts.append(prepare_or_load(spark, f"{path.rstrip('/')}/{fingerprint({'source': name})}", partial(build, name),
                                     common | {"source": name, "fraction": fractions[name]}, key, shards, inputs, [mixed_rows(name)]))
    return reduce(DataFrame.unionByName, parts)


def _scored_layers(hidden: DataFrame, settings: DistillSettings) -> DataFrame:
    exits = validate_exit_layers(settings.output_exit_layers or [], settings.exit_layer_indices)
    kept = prune_depth(hidden, exits, settings.output_full_model)
    return fixed_exit(kept, exits, settings.exit_layer_indices, settings.output_full_model, settings.full_layer)


def score_exits(hidden: DataFrame, heads: DataFrame, settings: DistillSettings,
                norm_weights: DataFrame | None = None) -> DataFrame:
    """Logits of the requested exits (and of the full model when it is asked for), for heads that
    may travel as rows. Use ``score_exit_stats`` for the vocabulary of a real model."""
    return exit_head_logits(_scored_layers(hidden, settings), heads, settings.tie_exit_lm_head,
                            norm_weights=norm_weights)


def score_exit_stats(hidden: DataFrame, heads: DataFrame | StoredHeads, settings: DistillSettings,
                     target: str | None = "target", norm_weights: DataFrame | None = None,
                     teacher: DataFrame | None = None, k: int = 1) -> DataFrame:
    """What ``evaluate_step`` and ``decide_exits`` need of the logits, for a vocabulary of any size.

    ``teacher`` are the hidden states of a separate teacher's full layer. The divergence is left out
    where its weight is zero or less, or there is no teacher.
    """
    if teacher is not None and settings.output_full_model:
        raise ValueError("a separate teacher needs output_full_model=False")
    with_kl = settings.kl_weight > 0 and (settings.output_full_model or teacher is not None)
    return exit_head_stats(_scored_layers(hidden, settings), heads, target, tied=settings.tie_exit_lm_head,
                           teacher_layer=settings.full_layer if with_kl else None, norm_weights=norm_weights, k=k,
                           teacher=teacher, virtual_tokens=settings.virtual_tokens if teacher is not None else 0)


def _step_losses(scored: DataFrame, settings: DistillSettings, batch: str, teacher: DataFrame | None) -> DataFrame:
    full, by, none = settings.full_layer, (batch,), F.lit(None).cast("double").alias("kl_loss")
    if "logits" not in scored.columns:
        return exit_losses_from_stats(scored, full, by)
    if settings.kl_weight <= 0:
        return exit_ce_loss(scored, by=by, vocab_size=settings.vocab_size).select(batch, "exit_layer", "ce_loss", none)
    return exit_losses(scored, full, by, vocab_size=settings.vocab_size, teacher=teacher,
                       virtual_tokens=settings.virtual_tokens if teacher is not None else 0)


def evaluate_step(scored: DataFrame, settings: DistillSettings, batch: str = "batch_id",
                  teacher: DataFrame | None = None) -> DataFrame:
    """One row per batch: the step's loss, its two means and every named metric.

    ``scored`` are logits (``score_exits``) or their statistics (``score_exit_stats``). The teacher is
    the full model among them. With ``output_full_model`` off it is ``teacher``: the scored full layer of a
    separate pass (adapters off, or another model), whose own CE is logged but is no part of the
    loss. With a KL weight of zero or less no divergence is planned and no teacher is needed.
    """
    full, with_kl = settings.full_layer, settings.kl_weight > 0
    exits = validate_exit_layers(settings.output_exit_layers or [], settings.exit_layer_indices)
    if teacher is not None and settings.output_full_model:
        raise ValueError("a separate teacher needs output_full_model=False")
    if with_kl and teacher is None and not settings.output_full_model:
        raise ValueError("a divergence needs the full model or a separate teacher")
    losses = _step_losses(scored, settings, batch, teacher)
    if teacher is not None and {"target", "target_logit"} & set(teacher.columns):
        alone = teacher.where(F.col("exit_layer") == full)
        losses = losses.unionByName(_step_losses(alone, replace(settings, kl_weight=0.0), batch, None))
    names = metric_columns(exits, full if settings.output_full_model or teacher is not None else None)
    if not with_kl:
        names = [n for n in names if n.startswith("ce_")]
    wide = metric_log(loss_metrics(losses, batch), names, ("step",)).withColumnRenamed("step", batch)
    counted = [n for n in names if settings.output_full_model or n != f"ce_loss_{full}"]

    def mean(prefix: str) -> Column:
        """Mean over the exits that have a value: the row holds them all already."""
        values = F.array_compact(F.array(*[name for name in counted if name.startswith(prefix)]))
        total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
        return F.when(F.size(values) > 0, total / F.size(values))

    return (wide.withColumn("ce_mean", mean("ce_")).withColumn("kl_mean", mean("kl_") if with_kl else F.lit(0.0))
            .withColumn("loss", F.coalesce("kl_mean", F.lit(0.0)) * max(settings.kl_weight, 0.0)
                        + F.col("ce_mean") * settings.ce_weight))


def decide_exits(scored: DataFrame, settings: DistillSettings, threshold: float | None = None,
                 carried: Sequence[str] = ()) -> DataFrame:
    """Predictions at the configured exits, or at the first confident one with a threshold, from
    logits or their statistics."""
    preds = (exit_prediction(scored, vocab_size=settings.vocab_size) if "logits" in scored.columns
             else predictions_from_stats(scored))
    if threshold is not None:
        return early_exit_policy(preds, threshold, settings.full_layer, carried)
    return fixed_exit(preds, settings.output_exit_layers or [], settings.exit_layer_indices,
                      settings.output_full_model, settings.full_layer)
