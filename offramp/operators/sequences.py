"""Texts to fixed-length token sequences, masks, labels, positions and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offramp.functions.columns import as_column, int_div, let
from offramp.functions.kernels import token_encoder
from offramp.functions.text import words
from offramp.operators.ordering import prefix_sum, row_index, weighted_splits
from offramp.session import scratch_path

# Fixed value: the label that losses leave out.
IGNORE_LABEL = -100

# Tokens that a task of packing sorts, on average (4 bytes each).
TOKENS_PER_BUCKET = 16_000_000

# A vocabulary up to this size is sent to the tasks as a value; a larger one is joined.
MAX_LOCAL_VOCAB = 1_000_000


def fit_vocab(df: DataFrame, text: str = "text", size: int = 32_000,
              specials: tuple[str, ...] = ("<unk>", "<eos>", "<pad>")) -> DataFrame:
    """``(token, token_id, n)``: reserved tokens first, then words by falling count.

    ``size`` counts the reserved tokens. Counts are combined before the shuffle, so a very
    frequent word sends one row per task; the final order is a top-k, and only its
    ``size`` rows are numbered.
    """
    if size < len(specials):
        raise ValueError("size is smaller than the number of reserved tokens")
    counts = (df.select(F.explode(words(text)).alias("token"))
              .where(~F.col("token").isin(list(specials)))
              .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    top = counts.orderBy(F.desc("n"), "token").limit(size - len(specials))
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "token"))
    fitted = top.select("token", (rank + len(specials) - 1).cast("int").alias("token_id"), "n")
    reserved = df.sparkSession.createDataFrame(
        [(t, i, 0) for i, t in enumerate(specials)], "token string, token_id int, n bigint")
    return reserved.unionByName(fitted)


def _low_int(x: Column) -> Column:
    """The lower half of a BIGINT, with its sign."""
    return F.shiftright(F.shiftleft(x, 32), 32).cast("int")


def encode_tokens(df: DataFrame, vocab: DataFrame, unk: int = 0, text: str = "text",
                  key: str = "doc_id", out: str = "input_ids",
                  max_local_vocab: int = MAX_LOCAL_VOCAB, salts: int = 32) -> DataFrame:
    """Add the token ids of a text as ``ARRAY<INT>``.

    The vocabulary is fetched first, up to the bound. Within it, each row is encoded where it
    is, one hash lookup per word over Arrow batches and no shuffle. Beyond it, the words
    of each distinct text are joined with the vocabulary, gathered again by the text's number and
    brought back to the rows by its digest. So both ways give every row the ids of its own text, whatever
    its ``key`` (null, repeated), and null for a null text. Texts get their numbers in a stored table, so that
    a word travels with 8 bytes of its text; a found word is its place and id in 8 more. The join is salted by
    the number, so that the most frequent word is spread over ``salts`` tasks, and adaptive execution can
    split these again.
    """
    rows = vocab.select("token", "token_id").limit(max_local_vocab + 1).collect()
    if len(rows) <= max_local_vocab:
        encode = token_encoder([r["token"] for r in rows], [r["token_id"] for r in rows], unk)
        return df.withColumn(out, encode(words(text)))
    digest = F.unhex(F.sha2(F.col(text), 256))
    texts = df.where(F.col(text).isNotNull()).groupBy(digest.alias("_digest")).agg(F.first(text).alias("_text"))
    path = scratch_path(df.sparkSession, "texts")
    texts.withColumn("_number", F.monotonically_increasing_id()).write.parquet(path)
    texts = df.sparkSession.read.parquet(path)
    exploded = texts.select("_number", F.posexplode(words("_text")).alias("pos", "token")).withColumn(
        "_salt", F.pmod(F.hash("_number"), F.lit(salts)))
    copies = vocab.select("token", "token_id", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    low = F.lit(0xFFFFFFFF).cast("bigint")
    place = F.shiftleft(F.col("pos").cast("bigint"), 32).bitwiseOR(
        F.coalesce("token_id", F.lit(unk)).cast("bigint").bitwiseAND(low))
    # the words go to their text's task before they are collected: a list of one word would be larger than the word
    ids = (exploded.join(copies, ["token", "_salt"], "left").select("_number", place.alias("_place"))
           .repartition("_number").groupBy("_number").agg(F.array_sort(F.collect_list("_place")).alias("_ids"))
           .select("_number", F.transform("_ids", lambda e: _low_int(e)).alias(out))
           .join(texts.select("_number", "_digest"), "_number").drop("_number"))
    return (df.withColumn("_digest", digest).join(ids, "_digest", "left").drop("_digest")
            .withColumn(out, F.coalesce(F.col(out), F.when(F.col(text).isNotNull(),
                                                           F.array().cast("array<int>")))))


def pack_sequences(df: DataFrame, key: str, max_len: int, eos: int, ids: str = "input_ids",
                   length: Column | None = None, splits: list | None = None) -> DataFrame:
    """Join all rows in key order, each followed by ``eos``, and cut into blocks of ``max_len``.

    Returns ``(seq_id, input_ids)``; the last block is dropped unless it is full. ``key`` is unique.
    The keys and token counts are stored once, as a narrow table; cut points of about equal
    tokens and the totals come from it, and the ids are read once. The start of each row comes from
    ``prefix_sum``, so no task sees the whole stream or sorts more than a bucket's tokens; a row is
    cut into the pieces it gives to each block before they are exploded, so a very long row
    is neither copied per piece nor kept together. ``length`` may give the token count of a row
    when it is known more cheaply than by building the ids.
    """
    if max_len < 1:
        raise ValueError("max_len must be at least 1")
    count = F.coalesce(length if length is not None else F.size(ids), F.lit(0)).cast("bigint") + 1
    path = scratch_path(df.sparkSession, "lengths")
    df.select(key, count.alias("n")).write.parquet(path)
    lengths = df.sparkSession.read.parquet(path)
    if splits is None:
        splits = weighted_splits(lengths, key, F.col("n"), TOKENS_PER_BUCKET)
    placed = prefix_sum(df.select(key, F.col(ids).alias("_ids"), count.alias("_n")),
                        key, F.col("_n"), "_start", splits, weights=lengths)
    tokens = F.concat(F.coalesce("_ids", F.array().cast("array<int>")),
                      F.array(F.lit(eos).cast("int")))
    width = F.lit(max_len).cast("bigint")
    start, end = F.col("_start"), F.col("_start") + F.col("_n")
    first, last = int_div(start, width), int_div(end - 1, width)

    def piece(block: Column, all_tokens: Column) -> Column:
        low = F.greatest(block * width, start)
        high = F.least((block + 1) * width, end)
        return F.struct(block.alias("seq_id"), low.alias("at"),
                        F.slice(all_tokens, (low - start + 1).cast("int"),
                                (high - low).cast("int")).alias("tokens"))

    pieces = let(tokens, lambda t: F.transform(F.sequence(first, last), lambda b: piece(b, t)))
    return (placed.select(F.explode(pieces).alias("p")).select("p.*")
            .groupBy("seq_id")
            .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "tokens"))),
                                       lambda e: e["tokens"])).alias("input_ids"))
            .where(F.size("input_ids") == max_len))


def truncate_sequences(df: DataFrame, max_len: int, ids: str = "input_ids") -> DataFrame:
    """The first ``max_len`` tokens of each row (the mode without packing)."""
    return df.withColumn(ids, F.slice(ids, 1, max_len))


def pad_and_mask(df: DataFrame, max_len: int, pad_id: int, ids: str = "input_ids",
                 mask: str = "attention_mask") -> DataFrame:
    """Pad on the right to ``max_len``; the mask is 1 for tokens and 0 for padding."""
    size = F.size(ids)
    missing = F.when(size <= max_len, max_len - size).otherwise(
        F.raise_error(F.lit("sequence longer than max_len: truncate it first")).cast("int"))
    return (df.withColumn(mask, F.concat(F.array_repeat(F.lit(1), size),
                                         F.array_repeat(F.lit(0), missing)))
            .withColumn(ids, F.concat(F.col(ids), F.array_repeat(F.lit(pad_id).cast("int"), missing))))


def causal_labels(df: DataFrame, shift: bool = True, ids: str = "input_ids",
                  mask: str = "attention_mask", labels: str = "labels",
                  targets: str = "targets") -> DataFrame:
    """Add labels (the ids, ``IGNORE_LABEL`` on padding) and, with ``shift``, targets.

    The target of a position is the label of the next one; the last position has none and gets
    ``IGNORE_LABEL``.
    """
    ignore = F.lit(IGNORE_LABEL).cast("int")
    if mask in df.columns:
        label = F.zip_with(ids, mask, lambda x, m: F.when(m == 1, x).otherwise(ignore))
    else:
        label = F.col(ids)
    df = df.withColumn(labels, label)
    if shift:
        size = F.size(labels)
        df = df.withColumn(targets, F.when(size > 0, F.concat(
            F.slice(labels, F.lit(2), F.greatest(size - 1, F.lit(0))), F.array(ignore))
        ).otherwise(F.col(labels)))
    return df


def position_ids(df: DataFrame, past: Column | int = 0, ids: str = "input_ids",
                 name: str = "position_ids") -> DataFrame:
    """Add positions 0..n-1, moved on by the number of tokens already seen."""
    past = F.lit(past) if isinstance(past, int) else past
    size = F.size(ids)
    return df.withColumn(name, F.when(size > 0, F.sequence(
        past.cast("int"), (past + size - 1).cast("int"))).otherwise(F.array().cast("array<int>")))


def batch_plan(df: DataFrame, key: str, per_device: int, accum: int, world: int = 8,
               splits: list | None = None) -> DataFrame:
    """``(key, index, step, micro_step, rank, slot)`` of each sequence, in key order.

    Only the key takes part; join the plan back to the sequences where they are needed.
    """
    if min(per_device, accum, world) < 1:
        raise ValueError("per_device, accum and world must be at least 1")
    i = F.col("index")
    return (row_index(df.select(key), key, "index", splits)
            .select(key, i,
                    int_div(i, world * per_device * accum).alias("step"),
                    (int_div(i, world * per_device) % accum).alias("micro_step"),
                    (int_div(i, per_device) % world).alias("rank"),
                    (i % per_device).cast("bigint").alias("slot")))


def cap_steps(plan: DataFrame, max_steps: int) -> DataFrame:
    """Keep the first ``max_steps`` steps of a batch plan, by filter."""
    return plan.where(F.col("step") < max_steps)


def token_budget(df: DataFrame, per_device: int, accum: int, world: int = 8,
                 max_steps: int | None = None, ids: str = "input_ids",
                 mask: str | None = "attention_mask", size: Column | None = None,
                 real: Column | None = None, sequences: Column | None = None) -> DataFrame:
    """Sequences, token slots, real tokens, padding share, and full steps available and used.

    ``size`` and ``real`` (token slots and real tokens of a row) may be given directly when the
    arrays need not be built for counting, and ``sequences`` when a row stands for several.
    """
    size = (F.size(ids) if size is None else size).cast("bigint")
    if real is None:
        real = F.aggregate(as_column(mask), F.lit(0), lambda a, m: a + m) if mask else size
    step = per_device * accum * world
    n = F.count(F.lit(1)) if sequences is None else F.coalesce(F.sum(sequences.cast("bigint")), F.lit(0))
    slots = F.coalesce(F.sum(size), F.lit(0))
    tokens = F.coalesce(F.sum(real.cast("bigint")), F.lit(0))
    available = int_div(n, step)
    used = F.least(available, F.lit(max_steps).cast("bigint")) if max_steps is not None else available
    return df.agg(
        n.alias("sequences"), slots.alias("token_slots"), tokens.alias("tokens"),
        F.when(slots > 0, 1.0 - tokens / slots).otherwise(F.lit(0.0)).alias("padding_share"),
        available.alias("steps_available"), used.alias("steps_used"))
