"""What the physical plans must look like."""

import re
import time

import pytest
from pyspark.sql import functions as F

from offramp.plans.catalog import QUERIES
from offramp.operators import losses as L
from offramp.operators.exits import early_exit_policy, exit_prediction
from offramp.operators.ordering import bucket_of
from offramp.operators.heads import exit_head_logits
from offramp.plans.inputs import (EXITS, FULL_LAYER, exit_heads, exit_hidden, exit_logits, partial_teacher, table,
                                  with_virtual_tokens)
from offramp.session import is_small, scratch_path
from offramp.sources.tables import write_bucketed


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream_")))
def test_no_product_joins_and_no_single_task_windows(spark, small, name):
    plan = plan_of(QUERIES[name](spark, small))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # One partition may hold bucket totals, a vocabulary, exits of a model or a global count.
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = " ".join(lines[i + 1:i + 3])
            assert re.search(r"HashAggregate|TakeOrdered", below), below


@pytest.mark.parametrize("name,columns", [
    ("scan_project", {"doc_id", "lang", "n_chars"}), ("shuffle_rank", {"doc_id"}),
    ("batch_plan", {"doc_id"}), ("vocab", {"doc_id", "text"}), ("token_budget", {"text"}),
    ("metric_window", {"vec_id", "embedding", "label"}), ("decontaminate", {"doc_id", "text", "lang", "n_chars"}),
])
def test_scans_read_only_what_is_needed(spark, small, name, columns):
    plan = plan_of(QUERIES[name](spark, small))
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan):
        assert {c.split(":")[0] for c in schema.split(",")} <= columns | {"item_id"}


def test_filters_reach_the_scan(spark, small):
    plan = plan_of(QUERIES["mix_sources"](spark, small))
    assert "EqualTo(lang,en)" in plan and "EqualTo(lang,es)" not in plan
    assert "In(lang, [" in plan_of(QUERIES["mix_by_column"](spark, small))


def test_row_local_work_has_no_exchange(spark, small):
    for name in ("messages", "trim_text", "split", "rms_norm"):
        assert "Exchange" not in plan_of(QUERIES[name](spark, small))


def test_a_cheap_count_does_not_run_the_encoder(spark, small):
    """Bucket totals of packing come from the word count: the Arrow encoder runs once."""
    assert plan_of(QUERIES["pack"](spark, small)).count("ArrowEvalPython") == 1


def test_only_few_files_are_small(spark, small):
    assert is_small(spark.read.parquet(f"{small}/documents.parquet"))
    assert not is_small(spark.range(10**12))


def test_many_cut_points_are_one_literal(spark):
    points = list(range(0, 650_000, 10))
    start = time.time()
    placed = spark.range(0, 650_000, 9_973).select("id", bucket_of("id", points).alias("b")).collect()
    assert time.time() - start < 20
    assert all(r["b"] == min(r["id"] // 10 + 1, len(points)) for r in placed)


def test_bucketed_logits_need_no_exchange(spark, small):
    logits = exit_logits(spark, small)
    write_bucketed(logits, "bucketed_logits", scratch_path(spark, "t-bucketed"), "seq_id", 8)
    try:
        stored = spark.table("bucketed_logits")
        plan = plan_of(L.exit_kl_loss(stored, FULL_LAYER, by=()))
        assert "Exchange hashpartitioning(seq_id" not in plan and "Window" in plan
        decided = early_exit_policy(exit_prediction(stored), 0.3, FULL_LAYER)
        assert "Exchange" not in plan_of(decided)
        a = {r["exit_layer"]: r["kl_loss"] for r in L.exit_kl_loss(stored, FULL_LAYER, by=()).collect()}
        b = {r["exit_layer"]: r["kl_loss"] for r in L.exit_kl_loss(logits, FULL_LAYER, by=()).collect()}
        assert a.keys() == set(EXITS) and all(a[k] == pytest.approx(b[k]) for k in a)
    finally:
        spark.sql("DROP TABLE bucketed_logits")


def test_a_bucketed_teacher_joins_without_exchange(spark, small):
    """Student and teacher in two tables, the student's positions two further on."""
    embeddings = table(spark, small, "embeddings")
    heads, hidden = exit_heads(exit_hidden(embeddings)), exit_hidden(embeddings).withColumn("target", F.col("label"))
    student = exit_head_logits(with_virtual_tokens(hidden).where(F.col("exit_layer") != FULL_LAYER), heads)
    teacher = exit_head_logits(partial_teacher(hidden), heads)
    write_bucketed(student, "t_student", scratch_path(spark, "t-student"), "seq_id", 8, ("pos",))
    write_bucketed(teacher, "t_teacher", scratch_path(spark, "t-teacher"), "seq_id", 8, ("pos",))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        loss = L.exit_losses(spark.table("t_student"), FULL_LAYER, by=(), teacher=spark.table("t_teacher"), virtual_tokens=2)
        plan = plan_of(loss)
        assert "SortMergeJoin" in plan and "Exchange hashpartitioning(seq_id" not in plan
        assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(exit_layer" in plan
        got = {r["exit_layer"]: r for r in loss.collect()}
        want = {r["exit_layer"]: r for r in L.exit_losses(student, FULL_LAYER, by=(), teacher=teacher, virtual_tokens=2).collect()}
        assert got.keys() == want.keys() == set(EXITS)
        for k in EXITS:
            assert got[k]["kl_loss"] == pytest.approx(want[k]["kl_loss"]) and got[k]["ce_loss"] == pytest.approx(want[k]["ce_loss"])
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
        spark.sql("DROP TABLE t_student")
        spark.sql("DROP TABLE t_teacher")


def test_no_weight_plans_no_divergence(spark, small):
    plan = plan_of(QUERIES["evaluate_step_no_kl"](spark, small))
    assert "Window" not in plan and "hashpartitioning(seq_id" not in plan
