"""Inputs of the operators, derived by Spark from the given tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offramp.functions.columns import int_div
from offramp.functions.vectors import rms_norm
from offramp.operators.heads import exit_head_logits
from offramp.operators.sequences import IGNORE_LABEL
from offramp.session import spread_small

# Exits of the derived hidden states: exit k sees the first k of 64 dimensions, 64 is the full model.
LAYERS = (16, 32, 48, 64)
EXITS = LAYERS[:-1]
FULL_LAYER = LAYERS[-1]
POSITIONS = 8
SEQUENCES_PER_BATCH = 8
IGNORE_EVERY = 11
# A head of 2,000 tokens: 500 classes of vectors, each in four rotations.
TOKEN_CLASSES = 500
ROTATIONS = 4
ROTATED_BY = 4
# Learned prompt tokens in front of the student's positions, and where the teacher has no row.
VIRTUAL_TOKENS = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def examples(documents: DataFrame) -> DataFrame:
    """Documents with a prompt: ``(doc_id, prompt, text)``."""
    prompt = F.concat(F.lit("Write a text in "), "lang", F.lit(" for "), "source")
    return documents.select("doc_id", prompt.alias("prompt"), "text")


def asked_examples(documents: DataFrame) -> DataFrame:
    """Documents with a prompt from one template: ``(doc_id, prompt, text)``."""
    prompt = F.concat(F.lit("Question q"), "doc_id", F.lit(" has its answer in the archive of "), "lang", F.col("doc_id") % 9)
    return documents.select("doc_id", prompt.alias("prompt"), "text")


def large_benchmark(bench: DataFrame, documents: DataFrame) -> DataFrame:
    """The benchmark and five questions for each document, all of the same template: ``(text)``."""
    number = F.explode(F.sequence(F.lit(1), F.lit(5))).alias("j")
    asked = documents.select("doc_id", "lang", number).select(
        F.concat(F.lit("q"), F.col("doc_id") * 7, F.lit(" has its answer in the archive of "), "lang", "j").alias("text"))
    return bench.select("text").unionByName(asked)


def exit_hidden(embeddings: DataFrame) -> DataFrame:
    """Hidden states of every exit, eight vectors to a sequence, eight sequences to a batch."""
    states = F.array(*[F.struct(F.lit(k).alias("exit_layer"),
                                F.slice("embedding", 1, k).alias("h")) for k in LAYERS])
    seq_id = int_div(F.col("vec_id"), POSITIONS)
    return (embeddings.select(
                seq_id.alias("seq_id"), (F.col("vec_id") % POSITIONS).cast("int").alias("pos"),
                int_div(seq_id, SEQUENCES_PER_BATCH).alias("batch_id"),
                F.col("label"), F.explode(states).alias("s"))
            .select("seq_id", "pos", "batch_id", "label", "s.exit_layer", "s.h"))


def exit_heads(hidden: DataFrame) -> DataFrame:
    """A head per exit: for each label the mean of its normalised hidden states.

    The dimensions are exploded into an average that is combined before the shuffle: what is
    exchanged is one row per task, exit, label and dimension, however many vectors there are.
    """
    entries = hidden.select("exit_layer", F.col("label").alias("token_id"),
                            F.posexplode(rms_norm("h")).alias("i", "v"))
    means = entries.groupBy("exit_layer", "token_id", "i").agg(F.avg("v").alias("v"))
    weights = F.array_sort(F.collect_list(F.struct("i", "v")))
    return means.groupBy("exit_layer", "token_id").agg(
        F.transform(weights, lambda e: e["v"]).alias("w"))


def vocabulary_heads(embeddings: DataFrame) -> DataFrame:
    """Heads of 2,000 tokens per exit: the mean normalised hidden state of each class of vectors
    (``vec_id`` modulo 500), and its rotations by 4, 8 and 12 dimensions."""
    hidden = exit_hidden(embeddings).withColumn("label", token_class())
    turned = F.array(*[F.concat(F.slice("w", ROTATED_BY * j + 1, 64), F.slice("w", 1, ROTATED_BY * j))
                       for j in range(ROTATIONS)])
    return exit_heads(hidden).select("exit_layer", "token_id", F.posexplode(turned).alias("j", "w")).select(
        "exit_layer", (F.col("token_id") * ROTATIONS + F.col("j")).cast("int").alias("token_id"), "w")


def token_class() -> Column:
    return ((F.col("seq_id") * POSITIONS + F.col("pos")) % TOKEN_CLASSES).cast("int")


def norm_weights(embeddings: DataFrame) -> DataFrame:
    """A norm weight per exit: eight times the mean size of each dimension."""
    entries = embeddings.select(F.posexplode("embedding").alias("i", "v"))
    means = entries.groupBy("i").agg(F.avg(F.abs(F.col("v").cast("double")) * 8.0).alias("v"))
    whole = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("w"))
    return whole.select(F.explode(F.array(*[F.struct(F.lit(k).alias("exit_layer"), F.slice("w", 1, k).alias("weight"))
                                            for k in LAYERS])).alias("n")).select("n.*")


def with_virtual_tokens(hidden: DataFrame) -> DataFrame:
    """Two positions without a target in front of each sequence (its own first states again)."""
    later = hidden.withColumn("pos", F.col("pos") + VIRTUAL_TOKENS)
    return later.unionByName(hidden.where(F.col("pos") < VIRTUAL_TOKENS).withColumn(
        "target", F.lit(None).cast("int")))


def partial_teacher(hidden: DataFrame) -> DataFrame:
    """The full layer, without position 3 of every fifth sequence."""
    return hidden.where((F.col("exit_layer") == FULL_LAYER) & ~((F.col("seq_id") % 5 == 0) & (F.col("pos") == 3)))


def token_labels(embeddings: DataFrame) -> DataFrame:
    """``(seq_id, pos, label)`` with every eleventh label ignored."""
    return embeddings.select(
        int_div(F.col("vec_id"), POSITIONS).alias("seq_id"),
        (F.col("vec_id") % POSITIONS).cast("int").alias("pos"),
        F.when(F.col("vec_id") % IGNORE_EVERY == 0, F.lit(IGNORE_LABEL))
        .otherwise(F.col("label")).alias("label"))


def exit_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logits of every exit; ``target`` is the row's own label."""
    embeddings = table(spark, sf_dir, "embeddings")
    heads = exit_heads(exit_hidden(embeddings))
    hidden = exit_hidden(spread_small(embeddings, "vec_id"))
    return exit_head_logits(hidden, heads).withColumn("target", F.col("label"))


def event_metrics(events: DataFrame) -> DataFrame:
    """Events as metric rows, one step per event."""
    return events.select(F.lit("events").alias("run_id"), F.col("event_id").alias("step"),
                         F.col("event_type").alias("metric"),
                         F.lit(None).cast("int").alias("exit_layer"), "value")
