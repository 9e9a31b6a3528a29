"""A size switch must not change an answer: both ways on null keys, repeated keys and null texts."""

from pyspark.sql import functions as F

from offramp.operators.chat import apply_chat_template, collect_turns
from offramp.operators.decontaminate import flag_contaminated
from offramp.operators.metrics import log_window
from offramp.operators.sequences import encode_tokens, fit_vocab

ITEM = "the quick brown fox jumps over the lazy dog and then runs far away"
ROWS = [(1, f"before {ITEM} after"), (1, "other words"), (None, f"x {ITEM} y"), (None, None), (None, "some more words"),
        (2, ""), (3, "x"), (3, "x"), (4, ITEM.upper()), (5, ITEM.replace("fox", "cat"))]


def _rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_encoding(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    vocab = fit_vocab(df, size=12)
    local = _rows(encode_tokens(df, vocab), "doc_id", "text", "input_ids")
    assert local == _rows(encode_tokens(df, vocab, max_local_vocab=1), "doc_id", "text", "input_ids")
    assert len(local) == len(ROWS)


def test_joined_words_travel_by_number(spark):
    """A word of the join carries its text's number, not its digest, and ids keep their sign."""
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    encoded = encode_tokens(df, fit_vocab(df, size=12), -1, max_local_vocab=1)
    plan = encoded._jdf.queryExecution().optimizedPlan().toString()
    assert not any("_digest" in line for line in plan.splitlines() if "posexplode" in line or "collect_list" in line)
    assert _rows(encoded, "doc_id", "text", "input_ids") == _rows(encode_tokens(df, fit_vocab(df, size=12), -1), "doc_id", "text", "input_ids")


def test_contamination(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, ITEM), (2, "fully different benchmark item of ten words or so here")], "item_id bigint, text string")
    local = _rows(flag_contaminated(df, bench), "doc_id", "text", "contaminated")
    assert local == _rows(flag_contaminated(df, bench, max_local_items=0), "doc_id", "text", "contaminated")
    assert sum(r[2] for r in local) == 3


def test_many_items_share_their_anchor(spark):
    """Templated items: one phrase, 5,000 endings. Each text is held against items one pair at a time."""
    bench = spark.range(5_000).select("id", F.concat(F.lit("w1 w2 w3 w4 w5 w6 w7 w8 w9 end"), "id").alias("text"))
    df = spark.range(20).select(F.col("id").alias("doc_id"), F.concat(F.lit("a w1 w2 w3 w4 w5 w6 w7 w8 w9 end"), F.col("id") * 400, F.lit(" z")).alias("text"))
    flags = {r["doc_id"]: r["contaminated"] for r in flag_contaminated(df, bench, max_local_items=0).collect()}
    assert all(flags.values())


def test_turns_with_gaps_and_any_start(spark):
    rows = [(1, t, "user", f"m{t}") for t in (0, 1, 2, 4, 5)] + [(2, t, "user", f"n{t}") for t in (7, 8, 11)] + [(3, 0, "user", None)]
    turns = collect_turns(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string"), max_messages=3)
    marks = sorted((r["conv_id"], r["part"], r["is_first"], r["is_last"]) for r in turns.collect())
    assert marks == [(1, 0, True, False), (1, 1, False, True), (2, 0, True, False), (2, 1, False, True), (3, 0, True, True)]
    assert "user" in [r["text"] for r in apply_chat_template(turns).collect() if r["conv_id"] == 3][0]


def test_metrics_of_runs_and_exits_stay_apart(spark):
    rows = [("a", 1, "ce_loss", 16, 1.0), ("a", 2, "ce_loss", 32, 3.0), ("b", 3, "ce_loss", 16, 8.0)]
    df = spark.createDataFrame(rows, "run_id string, step bigint, metric string, exit_layer int, value double")
    assert _rows(log_window(df), "run_id", "metric", "value") == [("a", "ce_loss_16", 1.0), ("a", "ce_loss_32", 3.0), ("b", "ce_loss_16", 8.0)]
