import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from offramp.functions.vectors import rms_norm
from offramp.operators import exits as E
from offramp.operators import head_blocks as B
from offramp.operators import heads as H
from offramp.operators import losses as L


def _data(spark, tokens=23, dim=6, exits=(4, 8), rows=40):
    rng = np.random.default_rng(7)
    w = {e: rng.normal(size=(tokens, dim)) for e in exits}
    h = {(i // 5, i % 5, e): rng.normal(size=dim).astype(np.float32) for i in range(rows) for e in exits}
    hidden = spark.createDataFrame([(*k, int(k[0] + k[1]) % tokens, [float(x) for x in v]) for k, v in h.items()],
                                   "seq_id long, pos int, exit_layer int, target int, h array<float>").repartition(3)
    heads = spark.createDataFrame([(e, t, [float(x) for x in w[e][t]]) for e in exits for t in range(tokens)],
                                  "exit_layer int, token_id int, w array<double>").repartition(4)
    z = {k: (v / np.sqrt((v.astype(float) ** 2).mean() + 1e-6)) @ w[k[2]].T for k, v in h.items()}
    return hidden, heads, z


def test_logits(spark):
    hidden, heads, z = _data(spark)
    rows = H.exit_head_logits(hidden, heads).collect()
    assert len(rows) == len(z) and "h" not in rows[0]
    for r in rows:
        assert np.allclose(r["logits"], z[r["seq_id"], r["pos"], r["exit_layer"]])


def test_tied_head(spark):
    hidden, heads, _ = _data(spark)
    one = heads.where("exit_layer = 8").drop("exit_layer")
    tied = H.exit_head_logits(hidden, one, tied=True)
    own = H.exit_head_logits(hidden.where("exit_layer = 8"), heads)
    a = {(r["seq_id"], r["pos"]): r["logits"] for r in tied.where("exit_layer = 8").collect()}
    b = {(r["seq_id"], r["pos"]): r["logits"] for r in own.collect()}
    assert a == b and tied.count() == 80


def test_norm_weights(spark):
    hidden, heads, _ = _data(spark)
    weights = spark.createDataFrame([(4, [2.0] * 6), (8, [1.0] * 6)], "exit_layer int, weight array<double>")
    plain = {(r["seq_id"], r["pos"], r["exit_layer"]): r["logits"] for r in H.exit_head_logits(hidden, heads).collect()}
    for r in H.exit_head_logits(hidden, heads, norm_weights=weights).collect():
        factor = 2.0 if r["exit_layer"] == 4 else 1.0
        assert np.allclose(r["logits"], factor * np.array(plain[r["seq_id"], r["pos"], r["exit_layer"]]))


def test_a_large_head_is_not_broadcast(spark):
    hidden, heads, _ = _data(spark)
    with pytest.raises(PySparkException, match="exit_head_stats"):
        H.exit_head_logits(hidden, heads, max_values=100).collect()


@pytest.mark.parametrize("block_bytes", [1, 5 * 6 * 8 * 2, 1 << 20])
def test_block_stats(spark, block_bytes):
    hidden, heads, z = _data(spark)
    rows = B.exit_head_stats(hidden, heads, "target", block_bytes=block_bytes).collect()
    assert len(rows) == len(z)
    for r in rows:
        x = z[r["seq_id"], r["pos"], r["exit_layer"]]
        assert r["lse"] == pytest.approx(np.log(np.exp(x).sum()))
        assert r["top"] == pytest.approx(x.max()) and r["token"] == x.argmax()
        assert r["target_logit"] == pytest.approx(x[r["target"]])


@pytest.mark.parametrize("block_bytes", [1, 5 * 6 * 8, 1 << 20])
@pytest.mark.parametrize("tied", [False, True])
def test_block_stats_equal_dense_logits(spark, block_bytes, tied):
    """Norm weights, the best k, NaN and missing teachers: as from the logits themselves."""
    hidden, heads, _ = _data(spark)
    broken = F.when((F.col("seq_id") == 2) & (F.col("pos") == 1) & (F.col("exit_layer") == 4),
                    F.transform("h", lambda x, i: F.when(i == 0, F.lit(float("nan"))).otherwise(x))).otherwise(F.col("h"))
    hidden = hidden.withColumn("h", broken).where("not (seq_id = 3 and exit_layer = 8)").withColumn("batch_id", F.col("seq_id") % 3)
    norms = spark.createDataFrame([(4, [1.0, 2.0, 0.5, 1.0, 3.0, 1.0]), (8, [0.5] * 6)], "exit_layer int, weight array<double>")
    if tied:
        heads = heads.where("exit_layer = 8").drop("exit_layer")
    logits = H.exit_head_logits(hidden, heads, tied, norm_weights=norms)
    stats = B.exit_head_stats(hidden, heads, "target", block_bytes=block_bytes, tied=tied, teacher_layer=8, norm_weights=norms, k=3)
    key = lambda r: (r["seq_id"], r["pos"], r["exit_layer"])
    want = {key(r): r for r in E.exit_prediction(logits, k=3).collect()}
    got = {key(r): r for r in E.predictions_from_stats(stats).collect()}
    assert got.keys() == want.keys()
    for at, r in want.items():
        if at == (2, 1, 4):
            assert np.isnan(got[at]["lse"]) and np.isnan(got[at]["kl"]) and np.isnan(got[at]["confidence"])
            continue
        assert got[at]["token"] == r["token"] and got[at]["confidence"] == pytest.approx(r["confidence"])
        assert [e["token"] for e in got[at]["top"]] == [e["token"] for e in r["top"]]
        assert [e["confidence"] for e in got[at]["top"]] == pytest.approx([e["confidence"] for e in r["top"]])
        assert (got[at]["kl"] is None) == (at[2] == 8 or at[0] == 3)
    whole = {(r["batch_id"], r["exit_layer"]): r for r in L.exit_losses_from_stats(stats, 8).collect()}
    for r in L.exit_losses(logits, 8).collect():
        for name in ("ce_loss", "kl_loss"):
            other = whole[r["batch_id"], r["exit_layer"]][name]
            assert (other is None) == (r[name] is None)
            assert r[name] is None or other == pytest.approx(r[name], nan_ok=True)


def test_a_target_outside_the_vocabulary_raises(spark):
    hidden, heads, _ = _data(spark)
    unknown = hidden.withColumn("target", F.when(F.col("seq_id") == 1, 99).otherwise(F.col("target")))
    with pytest.raises(PySparkException, match="target outside the vocabulary"):
        B.exit_head_stats(unknown, heads, "target").collect()
    with pytest.raises(PySparkException, match="target outside the vocabulary"):
        L.exit_ce_loss(H.exit_head_logits(unknown, heads), by=()).collect()


def test_hidden_states_are_scanned_once(spark, tmp_path):
    hidden, heads, z = _data(spark)
    hidden.write.parquet(f"{tmp_path}/hidden")
    stored = B.store_heads(heads, block_bytes=1)
    assert len(stored.blocks[4]) == 23
    stats = B.exit_head_stats(spark.read.parquet(f"{tmp_path}/hidden"), stored, "target")
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Join" not in plan
    assert stats.count() == len(z)


def test_block_stats_without_target(spark):
    hidden, heads, _ = _data(spark)
    ignored = hidden.withColumn("target", F.when(F.col("pos") > 0, F.lit(-100)))
    rows = B.exit_head_stats(ignored, heads, "target").collect()
    assert all(r["target_logit"] is None for r in rows)


def test_rms_norm(spark):
    x = [3.0, -4.0]
    row = spark.createDataFrame([(x,)], "h array<float>").select(
        rms_norm("h").alias("a"), rms_norm("h", F.array(F.lit(2.0), F.lit(0.5))).alias("b")).first()
    r = np.array(x) / np.sqrt(12.5 + 1e-6)
    assert np.allclose(row["a"], r) and np.allclose(row["b"], r * [2, 0.5])


def test_row_filters(spark):
    df = spark.createDataFrame([(s, p, e) for s, n in ((0, 5), (1, 2)) for p in range(n) for e in (4, 8, 32)],
                               "seq_id long, pos int, exit_layer int")
    assert {r[0] for r in H.prune_depth(df, [4, 8], False).select("exit_layer").collect()} == {4, 8}
    assert H.prune_depth(df, [4], True).count() == 21
    with pytest.raises(ValueError):
        H.prune_depth(df, [], False)
    last = H.keep_last_logits(df, 2, full_layer=32)
    assert sorted(map(tuple, last.where("exit_layer = 32").select("seq_id", "pos").collect())) == [
        (0, 3), (0, 4), (1, 0), (1, 1)]
    assert last.where("exit_layer < 32").count() == 14
    assert H.keep_last_logits(df, 0).count() == 21
    given = H.keep_last_logits(df.withColumn("seq_len", F.lit(5)), 1)
    assert given.count() == 3 and "Join" not in given._jdf.queryExecution().optimizedPlan().toString()
    rest = H.drop_virtual_tokens(df, 2)
    assert sorted({tuple(r) for r in rest.select("seq_id", "pos").collect()}) == [(0, 0), (0, 1), (0, 2)]


@pytest.mark.parametrize("block_bytes", [5 * 6 * 8, 1 << 20])
def test_tied_block_stats(spark, block_bytes):
    hidden, heads, _ = _data(spark)
    one = heads.where("exit_layer = 8").drop("exit_layer")
    logits = H.exit_head_logits(hidden, one, tied=True).collect()
    want = {(r["seq_id"], r["pos"], r["exit_layer"]): np.array(r["logits"]) for r in logits}
    rows = B.exit_head_stats(hidden, one, "target", block_bytes=block_bytes, tied=True).collect()
    assert len(rows) == len(want)
    for r in rows:
        x = want[r["seq_id"], r["pos"], r["exit_layer"]]
        assert r["token"] == x.argmax() and r["lse"] == pytest.approx(np.log(np.exp(x).sum()))
        assert r["target_logit"] == pytest.approx(x[r["target"]])


def test_heads_of_different_width(spark):
    """Each exit may have its own number of dimensions and tokens."""
    hidden = spark.createDataFrame([(0, 0, 4, [1.0, 2.0]), (0, 0, 8, [1.0, 2.0, 3.0]), (0, 0, 9, [1.0])],
                                   "seq_id long, pos int, exit_layer int, h array<float>")
    heads = spark.createDataFrame([(4, 0, [1.0, 0.0]), (4, 2, [0.0, 1.0]), (8, 1, [1.0, 1.0, 1.0])],
                                  "exit_layer int, token_id int, w array<double>")
    for block_bytes in (1, 1 << 20):
        got = {r["exit_layer"]: r["token"] for r in B.exit_head_stats(hidden, heads, block_bytes=block_bytes).collect()}
        assert got == {4: 2, 8: 1}


@pytest.mark.parametrize("tied", [False, True])
@pytest.mark.parametrize("block_bytes", [1, 5 * 6 * 8 * 2, 1 << 20])
def test_block_divergence(spark, block_bytes, tied):
    hidden, heads, _ = _data(spark)
    hidden = hidden.withColumn("batch_id", F.col("seq_id") % 2)
    if tied:
        heads = heads.where("exit_layer = 8").drop("exit_layer")
    stats = B.exit_head_stats(hidden, heads, "target", block_bytes=block_bytes, tied=tied, teacher_layer=8)
    got = {(r["batch_id"], r["exit_layer"]): r for r in L.exit_losses_from_stats(stats, 8).collect()}
    want = L.exit_losses(H.exit_head_logits(hidden, heads, tied), 8).collect()
    assert len(got) == len(want) == 4
    for r in want:
        other = got[r["batch_id"], r["exit_layer"]]
        assert other["ce_loss"] == pytest.approx(r["ce_loss"])
        assert (other["kl_loss"] is None) == (r["exit_layer"] == 8)
        assert r["kl_loss"] is None or other["kl_loss"] == pytest.approx(r["kl_loss"])
    assert not [c for c in stats.columns if c.startswith("_") or c.startswith("h")]


def test_divergence_needs_the_same_tokens(spark):
    hidden, heads, _ = _data(spark)
    fewer = heads.where("exit_layer = 8 or token_id > 0")
    with pytest.raises(ValueError, match="same tokens"):
        B.exit_head_stats(hidden, fewer, teacher_layer=8)
