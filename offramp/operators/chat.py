"""Prompts and conversations to templated text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offramp.functions.columns import fresh_name, int_div
from offramp.functions.text import py_trim
from offramp.session import scratch_path

MESSAGE = "struct<role:string,content:string>"

# The header style of the chat template.
BOS = "<|begin_of_text|>"
HEADER_START = "<|start_header_id|>"
HEADER_END = "<|end_header_id|>\n\n"
TURN_END = "<|eot_id|>"


def message(role: Column | str, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), content.alias("content"))


def build_messages(df: DataFrame, prompt: str = "prompt", text: str = "text") -> DataFrame:
    """Replace a prompt and its text by a user and an assistant message."""
    messages = F.array(message("user", F.col(prompt)), message("assistant", F.col(text)))
    return df.withColumn("messages", messages).drop(prompt, text)


def collect_turns(df: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role",
                  content: str = "text", max_messages: int = 1024) -> DataFrame:
    """One row per conversation with its messages in order.

    ``order`` is a whole number that rises through a conversation; it may start anywhere and have
    gaps. A conversation whose numbers span more than ``max_messages`` is returned as several rows,
    numbered by ``part`` from its first message on, so no group is larger than that however long a
    conversation gets, and the parts of one conversation are built by different tasks. ``is_first``
    and ``is_last`` come from the conversation's smallest and largest number.

    The bounds of the long conversations are found first, from the numbers alone, and stored; they meet
    the messages as a broadcast while Spark finds them small. Messages are exchanged once.
    """
    if max_messages < 1:
        raise ValueError("max_messages must be at least 1")
    spark, low, high, name = df.sparkSession, fresh_name(df, "low"), fresh_name(df, "high"), fresh_name(df, "conv")
    span = df.groupBy(F.col(conv).alias(name)).agg(F.min(order).alias(low), F.max(order).alias(high))
    path = scratch_path(spark, "long-conversations")
    span.where(F.col(high) - F.col(low) >= max_messages).write.parquet(path)
    rows = df.join(spark.read.schema(span.schema).parquet(path), F.col(conv).eqNullSafe(F.col(name)), "left")
    entry = F.struct(F.col(order).alias("position"), F.col(role).alias("role"), F.col(content).alias("content"))
    part = F.coalesce(int_div(F.col(order) - F.col(low), max_messages), F.lit(0).cast("bigint"))

    def holds(bound: str) -> Column:
        """A conversation without bounds is in one part."""
        return F.col(bound).isNull() | F.exists("entries", lambda e: e["position"] == F.col(bound))

    return (rows.groupBy(conv, part.alias("part"))
            .agg(F.array_sort(F.collect_list(entry)).alias("entries"), F.first(low).alias(low), F.first(high).alias(high))
            .select(conv, "part", holds(low).alias("is_first"), holds(high).alias("is_last"),
                    F.transform("entries", lambda e: F.struct(
                        e["role"].alias("role"), e["content"].alias("content"))).alias("messages")))


def insert_empty_system(df: DataFrame, enabled: bool = True, messages: str = "messages") -> DataFrame:
    """Put an empty system message first unless a system message stands there already.

    An empty message list gets one too. Later parts of a long conversation are left alone.
    """
    if not enabled:
        return df
    empty = F.array(message("system", F.lit("")))
    needed = F.coalesce(F.get(F.col(messages), F.lit(0))["role"] != "system", F.lit(True))
    if "is_first" in df.columns:
        needed = needed & F.col("is_first")
    return df.withColumn(messages, F.when(needed, F.concat(empty, F.col(messages)))
                         .otherwise(F.col(messages)))


def render_message(role: Column, content: Column) -> Column:
    """One message; a null role or content is rendered as empty, so no message is lost."""
    empty = F.lit("")
    return F.concat(F.lit(HEADER_START), F.coalesce(role, empty), F.lit(HEADER_END),
                    F.coalesce(py_trim(content), empty), F.lit(TURN_END))


def apply_chat_template(df: DataFrame, bos: str = BOS, style: str = "header",
                        add_generation_prompt: bool = False, messages: str = "messages",
                        text: str = "text") -> DataFrame:
    """Replace the message list by its templated text.

    The begin-of-sequence mark comes before the first message only. With
    ``add_generation_prompt`` the text ends with the open header of an assistant message.
    For a conversation in parts, the texts of its parts in order are the text of the whole.
    """
    if style != "header":
        raise ValueError(f"unknown template style {style!r}")
    body = F.array_join(F.transform(
        F.col(messages), lambda m: render_message(m["role"], m["content"])), "")
    start: Column = F.when(F.size(messages) > 0, F.lit(bos)).otherwise(F.lit(""))
    end: Column = F.lit(HEADER_START + "assistant" + HEADER_END if add_generation_prompt else "")
    if "is_first" in df.columns:
        start = F.when(F.col("is_first"), start).otherwise(F.lit(""))
    if "is_last" in df.columns:
        end = F.when(F.col("is_last"), end).otherwise(F.lit(""))
    return df.withColumn(text, F.concat(start, body, end)).drop(messages)
