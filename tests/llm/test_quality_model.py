"""The quality classifier: label model on known accuracies, agreement with held-back labels."""

import numpy as np
from pyspark.sql import functions as F

from offramp.llm.quality_model import LABELLERS, fit_label_model, measures, quality_model_query, votes_of
from offramp.llm.quality_rules import measure
from tests.llm.conftest import SCHEMA


def auc(scores, labels):
    order = np.argsort(np.argsort(scores)) + 1
    n = labels.sum()
    return (order[labels].sum() - n * (n + 1) / 2) / (n * (len(labels) - n))


def test_agrees_with_labels_it_never_saw(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    labels = spark.read.parquet(f"{medium}/labels.parquet")
    rows = quality_model_query(docs).join(labels, "doc_id").collect()
    good = np.array([r.quality == 1 for r in rows])
    scores = np.array([r.score for r in rows])
    kept = np.array([r.kept for r in rows])
    assert auc(scores, good) > 0.93
    assert kept[good].mean() > 0.95
    assert kept[~good].mean() < 0.25


def test_em_recovers_accuracies():
    rng = np.random.default_rng(1)
    n, k = 40_000, len(LABELLERS)
    truth = rng.random(n) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.7, 0.9, 0.75])[:k]
    votes = np.zeros((n, k), int)
    for i in range(k):
        ok = rng.random(n) < right[i]
        votes[:, i] = np.where(rng.random(n) < 0.8, np.where(ok == truth, 2, 1), 0)
    patterns, counts = np.unique((votes * 3 ** np.arange(k)).sum(axis=1), return_counts=True)
    assert (votes_of(patterns) < 3).all()
    model = fit_label_model(patterns, counts.astype(float))
    assert abs(model.good - 0.8) < 0.02
    for i in range(k):
        assert abs(model.votes[i, 1, 2] / model.votes[i, 1, 1:].sum() - right[i]) < 0.03


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "word " * 100), (3, "a fine text. " * 5), (3, "a fine text. " * 5), (4, "# " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as n_words", "2 as key", "3 as score", "4 as pattern")
    out = quality_model_query(docs).collect()
    assert len(out) == len(rows)
    assert all(0 <= r.score <= 1 and 0 <= r.weak_label <= 1 and r.kept == (r.score >= 0.5) for r in out)
    assert len({(r.score, r.weak_label) for r in out if r.doc_id == 3}) == 1
    assert len({r.score for r in out if r.doc_id in (1, 2)}) == 1
    assert quality_model_query(spark.createDataFrame([], SCHEMA)).count() == 0


def test_measurements_agree_with_their_expressions(spark):
    texts = [None, "", " ", "a", " a ", "one. two! three?", "end.\n", "end.\r\n", "end.\r", "end.\u0085", "end! ", "end? ", "end ",
             " ", ".\u0085x.", "?", "..", ". .", "a\nb\na\n \na", "x\r\nx\r\n\n", "#*$%&|<>", "\x00\x01@[`{\x7f", "naïve café straße", "слово 漢字 😀 é",
             "a b c", "\x0b\x0c\x1c\x1d", "one two three four five " * 3, "\u0085", "z\u0085\n", " .", ".\t"]
    rng = np.random.default_rng(5)
    pool = list("aZé漢😀 .!?#<\n\t\r\x0b\x00\u0085  ")
    texts += ["".join(rng.choice(pool, size=int(n))) for n in rng.integers(1, 60, 400)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    text = F.coalesce("text", F.lit(""))
    expected = docs.select("text", *measure(text), F.regexp_count(text, F.lit(r"[.!?][\x20\x09-\x0D]|[.!?]$")).cast("bigint").alias("n_ends"),
                           F.length(F.regexp_replace(text, r"[\x00-@\[-`{-\x7f]+", "")).cast("bigint").alias("n_letters"))
    assert measures(docs).columns == expected.columns
    assert measures(docs).collect() == expected.collect()


def test_texts_are_measured_in_one_pass(spark):
    docs = spark.createDataFrame([(1, "a fine text. " * 5)], "doc_id bigint, text string")
    plan = measures(docs)._jdf.queryExecution().toString().lower()
    assert "regexp" not in plan and "translate" not in plan and plan.split("== physical plan ==")[1].count("arrowevalpython") == 1
