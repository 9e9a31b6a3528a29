import bisect
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from offramp.operators import ordering


@pytest.mark.parametrize("splits", [[], [5], [1, 2, 3], [-4, 0, 7, 7 + 2**40], list(range(0, 300, 7))])
def test_bucket_is_bisect(spark, splits):
    keys = sorted({-10, -4, -1, 0, 1, 2, 3, 4, 5, 6, 7, 8, 2**40 + 7, 2**40, 299, 2**62} | set(splits))
    df = spark.createDataFrame([(k,) for k in keys], "k long").withColumn("b", ordering.bucket_of("k", splits))
    assert {r["k"]: r["b"] for r in df.collect()} == {k: bisect.bisect_right(splits, k) for k in keys}


def _keys(shape):
    if shape == "gaps":
        return [i * i * 1000 - 50 for i in range(500)]
    if shape == "clustered":  # most keys in a narrow range, a few far away
        return list(range(400)) + [10**12 + 7 * i for i in range(20)]
    return [3]


@pytest.mark.parametrize("shape", ["gaps", "clustered", "one"])
@pytest.mark.parametrize("rows_per_bucket", [7, 60, 10**6])
def test_prefix_sum(spark, shape, rows_per_bucket):
    keys = _keys(shape)
    weights = {k: (k % 11) * (1000 if i % 50 == 0 else 1) for i, k in enumerate(keys)}
    df = spark.createDataFrame(list(weights.items()), "k long, w long").repartition(6)
    splits = ordering.key_splits(df, "k", rows_per_bucket)
    rows = ordering.prefix_sum(df, "k", F.col("w"), "before", splits).collect()
    assert len(rows) == len(keys)
    total = 0
    for row in sorted(rows, key=lambda r: r["k"]):
        assert row["before"] == total
        total += row["w"]


def test_splits_are_even_for_clustered_keys(spark):
    df = spark.createDataFrame([(k,) for k in _keys("clustered")], "k long")
    splits = ordering.key_splits(df, "k", 20)
    sizes = df.groupBy(ordering.bucket_of("k", splits)).count().agg(F.max("count")).first()[0]
    assert sizes <= 60 and len(splits) >= 15


@pytest.mark.parametrize("partitions", [1, 16])
def test_buckets_of_skewed_weights_are_even(spark, partitions):
    """A few rows weigh as much as thousands of others: buckets are even by weight."""
    rng = np.random.default_rng(1)
    weights = np.minimum(rng.lognormal(3, 2, 40_000).astype(int) + 1, 20_000)
    weights[:4000] = 1
    df = spark.createDataFrame(list(enumerate(weights.tolist())), "k long, w long").repartition(partitions)
    per_bucket = int(weights.sum()) // 60
    splits = ordering.weighted_splits(df, "k", F.col("w"), per_bucket)
    sums = [r[1] for r in df.groupBy(ordering.bucket_of("k", splits)).agg(F.sum("w")).collect()]
    assert 50 <= len(sums) <= 61 and max(sums) <= 2 * sum(sums) / len(sums)
    # by rows, the same cuts would be uneven
    by_rows = ordering.key_splits(df, "k", 40_000 // 60)
    assert max(r[1] for r in df.groupBy(ordering.bucket_of("k", by_rows)).agg(F.sum("w")).collect()) > max(sums)


def test_a_repeated_key_is_one_row(spark):
    df = spark.range(200_000).select(F.when(F.col("id") < 150_000, 7).otherwise(F.col("id")).alias("k")).repartition(4)
    points = df.select("k", F.lit(1).cast("bigint").alias("n")).mapInArrow(ordering._points(100), "key bigint, n bigint")
    rows = points.collect()
    assert sum(r["key"] == 7 for r in rows) == 4 and abs(sum(r["n"] for r in rows) - 2_000) <= 4
    splits = ordering.key_splits(df, "k", 10_000)
    assert 5 <= len(splits) <= 20 and len(set(splits)) == len(splits)
    assert ordering.weighted_splits(df, "k", F.lit(0), 10) == []


def test_bucket_count_is_bounded(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    assert len(ordering.key_splits(df, "k", 1, max_buckets=16)) <= 15


def test_empty_input(spark):
    df = spark.createDataFrame([], "k long")
    assert ordering.row_index(df, "k").count() == 0


def _digest(k):
    return hashlib.md5(f"42:{k}".encode()).hexdigest()


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_shuffle_rank(spark, digits):
    df = spark.range(700).withColumnRenamed("id", "k").repartition(3)
    ranks = {r["k"]: r["rank"] for r in ordering.shuffle_rank(df, 42, "k", hex_digits=digits).collect()}
    assert [k for k, _ in sorted(ranks.items(), key=lambda e: e[1])] == sorted(range(700), key=_digest)
    assert sorted(ranks.values()) == list(range(700))


def test_seeded_shuffle_order_does_not_depend_on_partitions(spark):
    df = spark.range(200).withColumnRenamed("id", "k")
    for parts in (1, 3, 7):
        got = [r["k"] for r in ordering.seeded_shuffle(df.repartition(parts), 42, "k", 4).collect()]
        assert got == sorted(range(200), key=_digest)


def test_preview(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    want = sorted(range(100), key=_digest)[:3]
    assert [r["k"] for r in ordering.preview_sample(df, "k").collect()] == want
    assert [r["k"] for r in ordering.preview_sample(df.repartition(9), "k").collect()] == want
