"""Removing examples that contain a benchmark passage.

An example is removed when its normalised text contains a normalised benchmark text, exactly and
anywhere, also starting or ending inside a word.

Testing every text against every item costs their product. Instead each item is known by one
*anchor* that any text containing it must also have:

* three words or more: the inner words (all but the first and the last) are whole words of such a
  text, so a run of up to ``ngram`` of them is one of its word shingles;
* one or two words: its first characters, up to ``ngram``, are one of its character shingles.

Only items whose anchor occurs in a text are compared with it. Of the possible anchors of
an item the one shared by the fewest items is taken, so that common openings do not bring
many items to many texts. Where even that one is shared by many items (templates that differ in
a word at an end), an item gets a second anchor: the part of the text at a known distance from the
first, its first and last word. A text then meets only the items that agree in both.

A small benchmark is a literal of the plan. Of a larger one, tasks get a Bloom filter of the anchors: rows
without an anchor, nearly all, are settled where they are, and only the others' texts travel.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offramp.functions.bloom import build_filter, passing_runs
from offramp.functions.columns import fresh_name, let
from offramp.functions.text import normalize_text, normalized_words
from offramp.session import scratch_path

# The row-local plan holds the benchmark as a literal of the plan: bounds of that literal.
MAX_LOCAL_ITEMS = 4_096
MAX_LOCAL_BYTES = 8 << 20
# An anchor shared by more items than this is told apart by a second one.
MANY_ITEMS = 16


def _shingles(hashes: Column, length: int, kind: int) -> Column:
    """Hash of every run of ``length`` part hashes (none when there are fewer)."""
    count = F.greatest(F.size(hashes) - (length - 1), F.lit(0))
    return F.transform(F.slice(hashes, F.lit(1), count), lambda _, i: F.xxhash64(
        F.lit(kind), F.slice(hashes, i + 1, F.lit(length))))


def text_shingles(words: Column, kinds: list[int]) -> Column:
    """Hashes of a text, given by its normalised words, for the shingle kinds the benchmark uses.

    A positive kind is a number of words, a negative one a number of characters. Each part
    is hashed once, and a shingle is the hash of its part hashes.
    """
    def of(parts: Column, wanted: list[int]) -> Column:
        return let(F.transform(parts, lambda p: F.xxhash64(p)),
                   lambda h: F.concat(*[_shingles(h, abs(k), k) for k in wanted]))

    by_word = [k for k in kinds if k > 0]
    by_char = [k for k in kinds if k < 0]
    found = []
    if by_word:
        found.append(of(words, by_word))
    if by_char:
        found.append(of(F.split(F.array_join(words, " "), ""), by_char))
    return F.concat(*found) if found else F.array().cast("array<bigint>")


def benchmark_anchors(bench: DataFrame, text: str = "text", ngram: int = 8) -> DataFrame:
    """``(item, kind, anchor, at, sharing)`` of every distinct non-empty benchmark text: the place of the
    anchor in the item (in words or characters) and the number of items it occurs in."""
    if ngram < 1:
        raise ValueError("ngram must be at least 1")
    items = (bench.select(normalize_text(text).alias("item")).where(F.col("item") != "").distinct()
             .withColumn("w", F.split("item", " ")))
    inner = F.size("w") - 2
    kind = F.when(inner >= 1, F.least(inner, F.lit(ngram))).otherwise(
        -F.least(F.length("item"), F.lit(ngram))).cast("int")
    kinds = items.withColumn("kind", kind)
    parts = (F.when(F.col("kind") > 0, F.slice("w", F.lit(2), F.greatest(inner, F.lit(0))))
             .otherwise(F.slice(F.split("item", ""), F.lit(1), F.abs("kind"))))
    length = F.abs("kind")
    # The hashes _shingles takes of the same parts.
    runs = let(F.transform(parts, lambda p: F.xxhash64(p)), lambda h: F.transform(
        F.sequence(F.lit(1), F.size(h) - length + 1),
        lambda i: F.xxhash64(F.col("kind"), F.slice(h, i, length))))
    options = kinds.select("item", "kind", F.posexplode(runs).alias("at", "anchor"))
    # Counted with partial aggregation: a phrase that very many items share stays one row a task.
    sharing = options.groupBy("kind", "anchor").agg(F.count(F.lit(1)).alias("sharing"))
    rated = options.join(sharing, ["kind", "anchor"])
    return (rated.groupBy("item")
            .agg(F.min(F.struct("sharing", "at", "kind", "anchor")).alias("best"))
            .select("item", "best.kind", "best.anchor",
                    # inner words are counted from the second word on
                    (F.col("best.at") + F.when(F.col("best.kind") > 0, 1).otherwise(0)).alias("at"), "best.sharing"))


@dataclass
class Benchmark:
    """Anchors of a benchmark; the items themselves when they are few enough to be a literal, else
    a Bloom filter of the anchors."""

    anchors: DataFrame
    kinds: list[int]
    items: list[tuple[str, int]] | None
    count: int
    bloom: np.ndarray | None = None

    @property
    def is_local(self) -> bool:
        return self.items is not None


def load_benchmark(bench: DataFrame, text: str = "text", ngram: int = 8,
                   max_local_items: int = MAX_LOCAL_ITEMS,
                   max_local_bytes: int = MAX_LOCAL_BYTES) -> Benchmark:
    """Measure the benchmark and derive its anchors.

    Only a benchmark within both bounds comes to the driver. Of a larger one the shingle kinds do (at most
    two per ``ngram``) and the Bloom filter (4 bytes an anchor, 1 to 64 MB); its anchors are stored once.
    """
    anchors = benchmark_anchors(bench, text, ngram)
    size = bench.agg(F.count(F.lit(1)).alias("n"),
                     F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")).first()
    if size["n"] <= max_local_items and size["bytes"] <= max_local_bytes:
        rows = anchors.collect()
        return Benchmark(anchors, sorted({r["kind"] for r in rows}),
                         [(r["item"], r["anchor"]) for r in rows], size["n"])
    path = scratch_path(bench.sparkSession, "anchors")
    anchors.write.parquet(path)
    anchors = bench.sparkSession.read.parquet(path)
    kinds = sorted(r["kind"] for r in anchors.select("kind").distinct().collect())
    return Benchmark(anchors, kinds, None, size["n"], build_filter(anchors, "anchor", size["n"]))


def contains_benchmark(text: Column | str, benchmark: Benchmark) -> Column:
    """Row-local test against a benchmark held as a literal; works on streams too."""
    if not benchmark.is_local:
        raise ValueError("the benchmark is too large for the row-local test: use flag_contaminated")
    if not benchmark.items:
        return F.lit(False)
    items = sorted(benchmark.items)
    # Each list is one literal cut at plan time; a normalised item has no line break.
    texts = F.split(F.lit("\n".join(item for item, _ in items)), "\n")
    anchors = F.split(F.lit(",".join(str(anchor) for _, anchor in items)), ",").cast("array<bigint>")

    def compare(words: Column) -> Column:
        def holds_item(hits: Column) -> Column:
            return let(F.array_join(words, " "), lambda norm: F.size(F.filter(
                texts, lambda item, i: F.array_contains(hits, F.get(anchors, i))
                & F.contains(norm, item))) > 0)

        # Only a text that has an anchor is put together again and compared.
        return let(F.array_intersect(text_shingles(words, benchmark.kinds), anchors),
                   lambda hits: F.when(F.size(hits) > 0, holds_item(hits)).otherwise(F.lit(False)))

    return F.coalesce(let(normalized_words(text), compare), F.lit(False))


def benchmark_hits(text: Column | str, benchmark: Benchmark) -> Column:
    """Row-local: the ``(at, key)`` of the shingles of a text that may be anchors, by the Bloom filter."""
    kinds = [[k for k in benchmark.kinds if k > 0], [k for k in benchmark.kinds if k < 0]]
    if not benchmark.kinds:
        return F.array().cast("array<struct<at:int,key:bigint>>")
    parts = [normalized_words(text), F.split(normalize_text(text), "")]
    wanted = [(p, k) for p, k in zip(parts, kinds) if k]
    return passing_runs(benchmark.bloom, [k for _, k in wanted], F.array(*[
        F.coalesce(F.transform(p, lambda x: F.xxhash64(x)), F.array().cast("array<bigint>")) for p, _ in wanted]))


def candidate_pairs(suspects: DataFrame, benchmark: Benchmark) -> DataFrame:
    """``(digest, item)`` pairs of suspect texts ``(digest, norm, hits)`` and the items to compare them
    with: those whose anchors the text has, both anchors where many items share the first."""
    shared = F.col("sharing") > MANY_ITEMS
    hits = suspects.select("digest", F.explode("hits").alias("hit")).select(
        "digest", F.col("hit.at").alias("found_at"), F.col("hit.key").alias("anchor"))
    plain = hits.join(benchmark.anchors.where(~shared).select("anchor", "item"), "anchor").select("digest", "item")

    # first and last word of an item with three words or more, all of a shorter one
    words = F.split("item", " ")
    by_word = F.col("kind") > 0
    first, last = F.get(words, F.lit(0)), F.element_at(words, -1)
    whole = F.length("item")
    templates = benchmark.anchors.where(shared).select(
        "anchor", "item", by_word.alias("by_word"), F.col("at").cast("int").alias("before"),
        F.when(by_word, F.length(first)).otherwise(whole).alias("first_length"),
        F.when(by_word, F.size(words) - 1 - F.col("at")).otherwise(0).cast("int").alias("after"),
        F.when(by_word, F.length(last)).otherwise(0).alias("last_length"),
        F.when(by_word, F.xxhash64(first, last)).otherwise(F.xxhash64("item")).alias("second"))
    shape = ["anchor", "by_word", "before", "first_length", "after", "last_length"]
    # The shapes of an anchor's items are few; only texts that have a shared anchor are read again.
    sought = hits.join(templates.select(*shape).distinct(), "anchor").join(
        suspects.select("digest", "norm", F.split("norm", " ").alias("words")), "digest")
    head = F.get("words", F.col("found_at") - F.col("before"))
    tail = F.get("words", F.col("found_at") + F.col("after"))
    second = F.when(F.col("by_word"), F.xxhash64(F.right(head, F.col("first_length")), F.left(tail, F.col("last_length")))
                    ).otherwise(F.xxhash64(F.substring("norm", F.col("found_at") + 1, F.col("first_length"))))
    outside = F.col("by_word") & (head.isNull() | tail.isNull())
    told_apart = (sought.where(~outside).select("digest", *shape, second.alias("second"))
                  .join(templates, [*shape, "second"]).select("digest", "item"))
    return plain.unionByName(told_apart).distinct()


def contaminated_digests(df: DataFrame, text: str, hits: Column | str, benchmark: Benchmark) -> DataFrame:
    """Digests of the texts that hold an item, stored. Only texts with hits leave their task."""
    spark = df.sparkSession
    suspects = (df.select(F.col(text).alias("text"), (F.col(hits) if isinstance(hits, str) else hits).alias("hits"))
                .where(F.size("hits") > 0)
                .select(_digest("text").alias("digest"), normalize_text("text").alias("norm"), "hits")
                .dropDuplicates(["digest"]))
    path = scratch_path(spark, "suspects")
    suspects.write.parquet(path)
    suspects = spark.read.schema(suspects.schema).parquet(path)
    held = (candidate_pairs(suspects, benchmark).join(suspects.select("digest", "norm"), "digest")
            .where(F.contains("norm", "item")).select("digest").distinct())
    path = scratch_path(spark, "contaminated")
    held.write.parquet(path)
    return spark.read.schema(held.schema).parquet(path)


def _digest(text: Column | str) -> Column:
    return F.sha2(F.col(text) if isinstance(text, str) else text, 256)


def flag_contaminated(df: DataFrame, bench: DataFrame | Benchmark, text: str = "text",
                      key: str = "doc_id", ngram: int = 8, name: str = "contaminated",
                      **bounds: int) -> DataFrame:
    """Add a boolean column telling whether a row contains a benchmark text.

    A benchmark within the bounds is tested in the row, without any shuffle. For a larger one the
    texts are read twice: rows whose shingles pass the Bloom filter are compared with the items they
    may hold, one pair at a time, then the digests of the texts that hold one meet the rows (as a
    broadcast while Spark finds them small: they are a stored table). Both ways flag every row by its own
    text, whatever its ``key`` (null, repeated).
    """
    benchmark = bench if isinstance(bench, Benchmark) else load_benchmark(bench, "text", ngram, **bounds)
    if benchmark.is_local:
        return df.withColumn(name, contains_benchmark(text, benchmark))
    held = contaminated_digests(df, text, benchmark_hits(text, benchmark), benchmark)
    digest, hit = fresh_name(df, "digest"), fresh_name(df, "held")
    held = held.select(F.col("digest").alias(digest), F.lit(True).alias(hit))
    return (df.withColumn(digest, _digest(text)).join(held, digest, "left")
            .withColumn(name, F.coalesce(hit, F.lit(False))).drop(hit, digest))


def decontaminate(df: DataFrame, bench: DataFrame | Benchmark, text: str = "text", key: str = "doc_id",
                  ngram: int = 8, **bounds: int) -> DataFrame:
    """Drop the rows whose normalised text contains a normalised benchmark text."""
    benchmark = bench if isinstance(bench, Benchmark) else load_benchmark(bench, "text", ngram, **bounds)
    if benchmark.is_local:
        return df.where(~contains_benchmark(text, benchmark))
    if df.isStreaming:
        raise ValueError("a stream meets a large benchmark in its micro-batches: use prepare_stream and run_prepare")
    name = fresh_name(df, "contaminated")
    return flag_contaminated(df, benchmark, text, key, ngram, name).where(~F.col(name)).drop(name)


def without_hits(batch: DataFrame, hits: str, benchmark: Benchmark, text: str = "text") -> DataFrame:
    """The rows of a batch that hold no item, given each row's ``benchmark_hits`` column, which goes."""
    held = contaminated_digests(batch, text, hits, benchmark)
    digest = fresh_name(batch, "digest")
    return (batch.withColumn(digest, _digest(text))
            .join(held.select(F.col("digest").alias(digest)), digest, "left_anti").drop(digest, hits))


def decontamination_report(flagged: DataFrame, name: str = "contaminated") -> DataFrame:
    """Rows before, removed and kept, and the removed percentage, in one pass over the flag."""
    removed = F.coalesce(F.sum(F.col(name).cast("bigint")), F.lit(0))
    rows = F.count(F.lit(1))
    return flagged.agg(
        rows.alias("rows_before"), removed.alias("removed"), (rows - removed).alias("kept"),
        F.when(rows > 0, removed / rows * 100.0).otherwise(F.lit(0.0)).alias("removed_percent"))
