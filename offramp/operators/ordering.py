"""Global order without a global sort: prefix sums, row numbers, samples and shuffles.

A window over all rows runs in one task. Here the keys are cut into buckets that follow the
order, each bucket is summed up, and only the small table of bucket totals sees a global window.
The cut points are taken from the keys themselves, so buckets are even whatever the keys look
like, and they are plain numbers by the time the plan is built, so a recomputed task puts
every row into the same bucket again.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offramp.functions.columns import as_column, let
from offramp.functions.hashing import digest_number, seeded_digest

# The summaries travel to the tasks by value: executors need numpy and pyarrow, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS_PER_BUCKET = 1_000_000
# The bound on everything that grows with the bucket count: the totals table that is
# broadcast, and the list of cut points.
MAX_BUCKETS = 65_536
KEYS_PER_BUCKET = 20


def _points(step: int):
    """A weighted summary of a task's keys: ``(key, n)`` says that key stands for ``n`` steps of weight.

    Along the keys of each batch in order, a point is set at every multiple of ``step``, from a start that
    depends on the task. Summaries of several tasks merge by adding up; a key repeated any number of
    times is one row.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = (TaskContext.get().partitionId() * 0x9E3779B1) % step
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            key, weight = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            order = np.argsort(key, kind="stable")
            passed = np.concatenate([[0], (carried + np.cumsum(weight[order])) // step])
            hits = np.diff(passed)
            carried = int(carried + weight.sum()) % step
            set_ = hits > 0
            keys, which = np.unique(np.concatenate([keys, key[order][set_]]), return_inverse=True)
            counts = np.bincount(which, np.concatenate([counts, hits[set_]]), len(keys)).astype(np.int64)
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])

    return run


def weighted_splits(df: DataFrame, key: str, weight: Column, weight_per_bucket: int,
                    max_buckets: int = MAX_BUCKETS) -> list[int]:
    """Cut points that put about ``weight_per_bucket`` between neighbours.

    Keys are whole numbers (null keys take no part), weights whole numbers of zero or more. The weights are
    summed, then each task sums up its keys as a row for every twentieth part of a bucket; these
    rows, at most ``KEYS_PER_BUCKET`` to a bucket and one a key and task, are added up and cut evenly.
    The choice only steers how even the buckets are; every row is placed by its own key. At least one
    bucket per shuffle partition is made, so that the work spreads.
    """
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.coalesce(weight, F.lit(0)).cast("bigint").alias("n"))
    rows = rows.where(F.col("key").isNotNull())
    found = rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(max_buckets, max(1, math.ceil(found["total"] / weight_per_bucket), min(parts, found["rows"])))
    if buckets <= 1 or not found["total"]:
        return []
    step = max(1, found["total"] // (KEYS_PER_BUCKET * buckets))
    points = rows.mapInArrow(_points(step), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    keys, counts = points["key"].to_numpy(), points["n"].to_numpy()
    order = np.argsort(keys)
    before = np.cumsum(counts[order]) - counts[order]
    wanted = counts.sum() * np.arange(1, buckets) / buckets
    at = np.searchsorted(before, wanted, "right") - 1
    # the last key that begins at or before the wanted weight ends its bucket, unless it begins one there
    return sorted({int(k) for k in keys[order][np.minimum(at + (before[at] < wanted), len(keys) - 1)]})


def key_splits(df: DataFrame, key: str, rows_per_bucket: int = ROWS_PER_BUCKET,
               max_buckets: int = MAX_BUCKETS) -> list[int]:
    """Cut points that put about ``rows_per_bucket`` rows between neighbours."""
    return weighted_splits(df, key, F.lit(1), rows_per_bucket, max_buckets)


def bucket_of(key: Column | str, splits: list) -> Column:
    """How many cut points are at or below the key, by binary search over the literal list."""
    if not splits:
        return F.lit(0)
    key = as_column(key).cast("bigint")
    steps = [1 << i for i in reversed(range(len(splits).bit_length()))]
    # One literal, cut when the plan is built: an expression per cut point would make the plan slow.
    points = F.split(F.lit(",".join(map(str, splits))), ",").cast("array<bigint>")

    def search(bounds: Column) -> Column:
        return F.aggregate(
            F.lit(steps).cast("array<int>"), F.lit(0),
            lambda low, step: F.when(F.get(bounds, low + step - 1) <= key, low + step).otherwise(low))

    return let(points, search)


def prefix_sum(df: DataFrame, key: str, weight: Column, name: str, splits: list[int] | None = None,
               bucket: Column | None = None, weights: DataFrame | None = None) -> DataFrame:
    """Add the sum of ``weight`` over all rows with a smaller key, as BIGINT column ``name``.

    Keys must be unique. ``splits`` come from ``key_splits`` or ``weighted_splits`` (computed here if
    not given); a ``bucket`` expression that never falls as the key rises may be given instead. The bucket
    totals are summed from ``weights``, a table ``(key, n)`` of the same keys and weights, if
    there is one: wide rows are then read once.
    """
    if bucket is None:
        bucket = bucket_of(key, key_splits(df, key) if splits is None else splits)
    rows = df.withColumn("_bucket", bucket).withColumn("_weight", weight.cast("bigint"))
    summed = rows if weights is None else weights.withColumns({"_bucket": bucket, "_weight": F.col("n")})
    totals = summed.groupBy("_bucket").agg(F.sum("_weight").alias("_total"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # At most MAX_BUCKETS rows: one row per bucket.
    offsets = totals.select("_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_local", F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
    # Every bucket has a total; a left join only saves the null test an inner one would add.
    return (local.join(F.broadcast(offsets), "_bucket", "left")
            .withColumn(name, F.col("_local") + F.col("_offset"))
            .drop("_bucket", "_weight", "_local", "_offset"))


def row_index(df: DataFrame, key: str, name: str = "index", splits: list | None = None) -> DataFrame:
    """Add the 0-based position of each row in key order."""
    return prefix_sum(df, key, F.lit(1), name, splits)


def preview_sample(df: DataFrame, key: str, k: int = 3, seed: int = 42) -> DataFrame:
    """``k`` seeded random rows. A top-k per partition, not a sort of the table."""
    return df.orderBy(seeded_digest(seed, key), key).limit(k)


def seeded_shuffle(df: DataFrame, seed: int, key: str, partitions: int | None = None) -> DataFrame:
    """The rows in a repeatable random order: range-partitioned and sorted by the digest."""
    digest = seeded_digest(seed, key)
    ordered = df.withColumn("_digest", digest)
    ordered = (ordered.repartitionByRange(partitions, "_digest", key) if partitions
               else ordered.repartitionByRange("_digest", key))
    return ordered.sortWithinPartitions("_digest", key).drop("_digest")


def shuffle_rank(df: DataFrame, seed: int, key: str, name: str = "rank",
                 hex_digits: int = 4) -> DataFrame:
    """Add each row's 0-based position in the seeded random order.

    The first hex digits of a digest are uniform and follow its order: they are the buckets
    (16^digits of them), and no job is needed to find cut points.
    """
    if not 1 <= hex_digits <= 4:
        raise ValueError("hex_digits must be 1 to 4: the bucket table is broadcast")
    ranked = prefix_sum(df.withColumn("_digest", seeded_digest(seed, key)), "_digest", F.lit(1), name,
                        bucket=digest_number(F.col("_digest"), hex_digits))
    return ranked.drop("_digest")
