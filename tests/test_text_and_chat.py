from pyspark.sql import functions as F

from offramp.functions.text import normalize_text, py_trim, word_count, words
from offramp.operators.chat import (BOS, apply_chat_template, build_messages, collect_turns,
                                    insert_empty_system)

import pytest

SPACES = " \t\n\r\f\x0b"


def _one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn("t").alias("x")).first()["x"]


@pytest.mark.parametrize("text", ["", " ", "a", SPACES + "a b" + SPACES, "\x0b\n", "a\n", "\ta", None])
def test_trim_is_python_strip(spark, text):
    assert _one(spark, text, py_trim) == (None if text is None else text.strip(SPACES))


@pytest.mark.parametrize("text", ["", "  ", "A", " A\t\tB\n\nc ", "É  Ö"])
def test_normalize_and_words(spark, text):
    assert _one(spark, text, normalize_text) == " ".join(text.lower().split())
    assert _one(spark, text, words) == text.split()
    assert _one(spark, text, word_count) == len(text.split())


def _rendered(messages, prompt=False):
    out = BOS if messages else ""
    for role, content in messages:
        out += f"<|start_header_id|>{role}<|end_header_id|>\n\n{content.strip(SPACES)}<|eot_id|>"
    return out + ("<|start_header_id|>assistant<|end_header_id|>\n\n" if prompt else "")


CONVERSATIONS = {
    1: [("user", "\n hi\x0b"), ("assistant", "")],
    2: [("system", "be brief"), ("user", "x"), ("assistant", "y"), ("user", "z ")],
    3: [("user", f"m{i}") for i in range(11)],
    4: [("assistant", "only")],
}


def _turns(spark):
    rows = [(c, i, r, t) for c, ms in CONVERSATIONS.items() for i, (r, t) in enumerate(ms)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)


@pytest.mark.parametrize("max_messages", [1, 2, 3, 4, 1024])
@pytest.mark.parametrize("prompt", [False, True])
@pytest.mark.parametrize("system", [False, True])
def test_parts_add_up_to_the_whole(spark, max_messages, prompt, system):
    turns = insert_empty_system(collect_turns(_turns(spark), max_messages=max_messages), system)
    rows = apply_chat_template(turns, add_generation_prompt=prompt).collect()
    for conv, messages in CONVERSATIONS.items():
        parts = sorted((r for r in rows if r["conv_id"] == conv), key=lambda r: r["part"])
        if system and messages[0][0] != "system":
            messages = [("system", "")] + messages
        assert "".join(p["text"] for p in parts) == _rendered(messages, prompt)
        assert [p["is_first"] for p in parts] == [True] + [False] * (len(parts) - 1)
        assert [p["is_last"] for p in parts] == [False] * (len(parts) - 1) + [True]


def test_no_group_exceeds_the_bound(spark):
    turns = collect_turns(_turns(spark), max_messages=3)
    assert turns.agg(F.max(F.size("messages"))).first()[0] == 3


def test_a_long_conversation_spreads_and_short_ones_are_exchanged_once(spark, tmp_path):
    long = spark.range(200_000).selectExpr("7L AS conv_id", "id AS turn", "'user' AS role", "concat('m', id) AS text")
    short = spark.range(3_000).selectExpr("id div 3 + 100 AS conv_id", "id % 3 AS turn", "'user' AS role", "concat('s', id) AS text")
    long.unionByName(short).write.parquet(f"{tmp_path}/turns")
    turns = collect_turns(spark.read.parquet(f"{tmp_path}/turns"))
    plan = turns._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("parts"), F.sum(F.size("messages")).alias("n"),
                                        F.max(F.size("messages")).alias("most"),
                                        F.sum(F.col("is_first").cast("int")).alias("first"),
                                        F.sum(F.col("is_last").cast("int")).alias("last")).collect()
    assert all(r["first"] == r["last"] == 1 for r in sizes) and len(sizes) == 1_001
    assert {(r["parts"], r["n"]) for r in sizes} == {(1, 3), (196, 200_000)} and max(r["most"] for r in sizes) == 1024
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert turns.where("conv_id = 7").select(F.spark_partition_id().alias("p")).distinct().count() >= 6
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_build_messages_drops_inputs(spark):
    df = build_messages(spark.createDataFrame([(1, "p", "t")], "doc_id long, prompt string, text string"))
    assert df.columns == ["doc_id", "messages"]
    assert [tuple(m) for m in df.first()["messages"]] == [("user", "p"), ("assistant", "t")]


def test_system_message_of_an_empty_list(spark):
    df = spark.sql("select array_remove(array(named_struct('role','a','content','b')), "
                   "named_struct('role','a','content','b')) as messages")
    assert [tuple(m) for m in insert_empty_system(df).first()["messages"]] == [("system", "")]
    assert apply_chat_template(df).first()["text"] == ""


def test_unknown_style_is_refused(spark):
    with pytest.raises(ValueError):
        apply_chat_template(collect_turns(_turns(spark)), style="other")
