"""Hard negatives against a plain search through all rows."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from offramp.llm.hard_negatives import _summarised, _Vectors, mine_hard_negatives, pairs_within
from offramp.llm.queries import op12_hard_negatives
from tests.llm.conftest import SCHEMA

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain(rows, is_anchor, positives=5, negatives=3, low=50, high=95, scale=256):
    rows = {(i, label, tuple(math.floor(scale * x) for x in v)) for i, v, label in rows
            if i is not None and label is not None and v is not None
            and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a in rows:
        if not is_anchor(a[0]):
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], r[2])), r[0], r[1]) for r in rows if r != a)
        for score, positive, _ in [s for s in scored if s[2] == a[1]][:positives]:
            fits = [s for s in scored if s[2] != a[1] and low * -score <= 100 * -s[0] <= high * -score]
            out += [(a[0], positive, n, s[1], -score, -s[0]) for n, s in enumerate(fits[:negatives], 1)]
    return sorted(out)


def result(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def test_whole_table(spark, small):
    rows = [(r.vec_id, [float(x) for x in r.embedding], (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label)
            for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert result(op12_hard_negatives(spark, small)) == plain(rows, lambda i: i % 50 == 0)


def test_edge_cases(spark):
    rng = random.Random(1)
    rows = [(i, [rng.randint(-3, 3) / 4 for _ in range(5)], rng.randint(0, 2)) for i in range(120)]
    rows += rows[:10]                                           # repeated rows
    rows += [(i, [0.5, -0.25, 0.75, 1.0, 0.0], 1) for i in range(200, 230)]   # ties
    rows += [(3, [0.25] * 5, 2), (300, [float("nan")] * 5, 1), (301, [1.0, None], 1), (302, None, 1),
             (303, [1.0] * 5, None), (None, [1.0] * 5, 1), (304, [], 0), (305, [1.0] * 20, 1),
             (306, [float("inf")], 1), (320, [-2.0] * 5, 7), (310, [0.5], 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").selectExpr(
        "*", "1 as id", "2 as row", "'x' as anchor", "0 as score")
    got = result(mine_hard_negatives(df, "vec_id % 10 = 0"))
    padded = [(i, None if v is None else v + [0.0] * (20 - len(v)), n) for i, v, n in rows]
    assert got == plain(padded, lambda i: i % 10 == 0) and got
    got = result(mine_hard_negatives(df, "vec_id % 3 = 0", positives=2, negatives=7, low=20, high=100, scale=3))
    assert got == plain(padded, lambda i: i % 3 == 0, 2, 7, 20, 100, 3) and got


def test_empty_and_unusable(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert mine_hard_negatives(empty, "vec_id % 50 = 0").count() == 0
    large = spark.createDataFrame([(1, [1e30, 1e30], 1)], empty.schema)
    with pytest.raises(ValueError):
        mine_hard_negatives(large, "true")
    wide = [(i, [float((i % 5 + 1) * 2 ** 20), float(i)], i % 2) for i in range(20)]
    got = result(mine_hard_negatives(spark.createDataFrame(wide, empty.schema), "true"))
    assert got == plain(wide, lambda i: True)


@pytest.mark.parametrize("smooth", [False, True])
def test_bounds_leave_no_pair_out(smooth):
    rng = np.random.default_rng(2)
    shape = (300, 32)
    x = rng.normal(0, 100, shape) if not smooth else np.repeat(rng.normal(0, 100, (300, 2)), 16, 1) + rng.normal(0, 5, shape)
    x = np.floor(x).astype(np.int64)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(300)), pa.array([0] * 300), pa.array([True] * 300), pa.array(x.tolist())],
        names=["id", "label", "anchor", "v"])
    vectors = _Vectors(pa.Table.from_batches(_summarised(32, "<i2")(iter([batch]))), 32, "<i2", np.float64)
    scores, allowed = x @ x.T, rng.random((300, 300)) < 0.9
    low, high = np.sort(scores, 1)[:, [-6, -2]].T
    i, j, s = pairs_within(vectors, vectors, low, high, allowed)
    wanted = allowed & (scores >= low[:, None]) & (scores <= high[:, None])
    assert sorted(zip(i, j)) == sorted(zip(*np.nonzero(wanted))) and (scores[i, j] == s).all()
    if smooth:  # most pairs are settled by the summaries
        qm, qd = vectors.levels[0]
        assert ((qm @ qm.T + qd @ qd.T) < low[:, None]).mean() > 0.8


def test_other_schema_is_left_alone(spark):
    assert SCHEMA and mine_hard_negatives(
        spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 1), (3, [0.9], 2)], "vec_id int, embedding array<float>, label long"),
        "vec_id = 1").collect()[0][:4] == (1, 2, 1, 3)
