"""Where the teacher comes from: the full model of the same rows, another table, or nowhere."""

from dataclasses import replace

import numpy as np
import pytest

from offramp.operators import losses as L
from offramp.plans import jobs

V = 2
SETTINGS = jobs.DistillSettings(output_exit_layers=(4, 8), exit_layer_indices=(4, 8), full_layer=16, kl_weight=0.3,
                                ce_weight=0.7)
ADAPTER = replace(SETTINGS, output_full_model=False, virtual_tokens=V)
SCHEMA = "batch_id long, seq_id long, pos int, exit_layer int, target int, logits array<double>"


@pytest.fixture(scope="module")
def logits():
    rng = np.random.default_rng(5)
    student = {(s, p, e): rng.normal(size=6) for s in range(4) for p in range(5 + V) for e in (4, 8)}
    teacher = {(s, p): rng.normal(size=6) for s in range(4) for p in range(5) if (s, p) != (1, 2) and s != 3}
    return student, teacher


def _target(s, p):
    return None if p < 0 or p == 4 else (s + p) % 6


def _frames(spark, logits):
    student, teacher = logits
    a = [(s % 2, s, p, e, _target(s, p - V), z.tolist()) for (s, p, e), z in student.items()]
    b = [(s % 2, s, p, 16, _target(s, p), z.tolist()) for (s, p), z in teacher.items()]
    return spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)


def _log_p(z):
    return z - z.max() - np.log(np.exp(z - z.max()).sum())


def _expected(logits):
    student, teacher = logits
    out = {}
    for batch in (0, 1):
        row = out[batch] = {}
        for e in (4, 8):
            ce = [-_log_p(z)[_target(s, p - V)] for (s, p, x), z in student.items()
                  if x == e and s % 2 == batch and _target(s, p - V) is not None]
            kl, held = 0.0, set()
            for (s, p, x), z in student.items():
                if x == e and s % 2 == batch and (s, p - V) in teacher:
                    t = _log_p(teacher[s, p - V])
                    kl += (np.exp(t) * (t - _log_p(z))).sum()
                    held.add(s)
            row[f"ce_loss_{e}"], row[f"kl_loss_{e}"] = np.mean(ce), kl / len(held)
        row["ce_loss_16"] = np.mean([-_log_p(z)[_target(s, p)] for (s, p), z in teacher.items()
                                     if s % 2 == batch and _target(s, p) is not None])
        row["ce_mean"] = (row["ce_loss_4"] + row["ce_loss_8"]) / 2
        row["kl_mean"] = (row["kl_loss_4"] + row["kl_loss_8"]) / 2
        row["loss"] = 0.3 * row["kl_mean"] + 0.7 * row["ce_mean"]
    return out


def test_a_teacher_of_its_own(spark, logits):
    student, teacher = _frames(spark, logits)
    want = _expected(logits)
    step = jobs.evaluate_step(student, ADAPTER, teacher=teacher).collect()
    assert len(step) == 2
    for r in step:
        assert set(r.asDict()) == {"batch_id", *want[0]}
        assert {k: r[k] for k in want[0]} == pytest.approx(want[r["batch_id"]])


def test_the_same_from_hidden_states(spark, logits):
    """With an identity head, hidden states of unit mean square are their own logits."""
    student, teacher = (f.withColumnRenamed("logits", "h") for f in _frames(spark, logits))
    heads = spark.createDataFrame([(e, t, [float(i == t) for i in range(6)]) for e in (4, 8, 16) for t in range(6)],
                                  "exit_layer int, token_id int, w array<double>")
    dense = jobs.evaluate_step(jobs.score_exits(student, heads, ADAPTER), ADAPTER,
                               teacher=jobs.score_exits(teacher, heads, replace(SETTINGS, output_exit_layers=None)))
    blocks = jobs.evaluate_step(jobs.score_exit_stats(student, heads, ADAPTER, teacher=teacher), ADAPTER,
                                teacher=jobs.score_exit_stats(teacher, heads, replace(SETTINGS, output_exit_layers=None, kl_weight=0.0)))
    want = {r["batch_id"]: r.asDict() for r in dense.collect()}
    for r in blocks.collect():
        assert r.asDict() == pytest.approx(want[r["batch_id"]])


def test_ce_is_the_same_at_any_weight(spark, logits):
    student, teacher = _frames(spark, logits)
    both = student.unionByName(teacher)
    means = [{r["batch_id"]: r["ce_mean"] for r in L.distill_loss(both, 16, weight).collect()} for weight in (0.0, 0.5)]
    assert means[0] == pytest.approx(means[1])
    apart = {r["batch_id"]: r["ce_mean"] for r in L.distill_loss(student, 16, 0.5, teacher=teacher, virtual_tokens=V).collect()}
    alone = {r["batch_id"]: r["ce_mean"] for r in L.distill_loss(student, 16, 0.0).collect()}
    assert apart == pytest.approx(alone)


def test_no_weight_needs_no_teacher(spark, logits):
    student, _ = _frames(spark, logits)
    step = jobs.evaluate_step(student, replace(ADAPTER, kl_weight=0.0)).collect()
    want = _expected(logits)
    for r in step:
        assert r["kl_mean"] == 0.0 and "kl_loss_4" not in r and r["loss"] == pytest.approx(0.7 * want[r["batch_id"]]["ce_mean"])


def test_settings_that_do_not_fit(spark, logits):
    student, teacher = _frames(spark, logits)
    with pytest.raises(ValueError, match="separate teacher"):
        jobs.evaluate_step(student, SETTINGS, teacher=teacher)
    with pytest.raises(ValueError, match="full model or a separate teacher"):
        jobs.evaluate_step(student, ADAPTER)
    with pytest.raises(ValueError, match="other positions"):
        L.exit_kl_loss(student, 16, virtual_tokens=1)
    with pytest.raises(ValueError, match="negative"):
        L.exit_kl_loss(student, 16, teacher=teacher, virtual_tokens=-1)


def test_kernels_and_expressions_agree(spark, logits):
    student, teacher = _frames(spark, logits)
    both = student.unionByName(teacher)
    for vocab in (None, 1_000_000):
        rows = {(r["batch_id"], r["exit_layer"]): (r["ce_loss"], r["kl_loss"]) for r in L.exit_losses(both, 16, vocab_size=vocab).collect()}
        preds = sorted((r["seq_id"], r["pos"], r["exit_layer"], r["token"], round(r["confidence"], 9))
                       for r in jobs.decide_exits(both, replace(SETTINGS, vocab_size=vocab)).collect())
        if vocab is None:
            first = rows, preds
    assert preds == first[1] and rows.keys() == first[0].keys()
    for k in rows:
        assert rows[k][0] == pytest.approx(first[0][k][0])
        assert rows[k][1] is first[0][k][1] is None or rows[k][1] == pytest.approx(first[0][k][1])
