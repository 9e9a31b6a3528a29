"""Language identification: held-out accuracy, calibration and exact counts."""

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from offramp.llm import language_id as li
from offramp.llm.language_id import fit_language_model, gram_counts, language_query, predict_languages
from offramp.llm.common import mix64
from tests.llm.conftest import SCHEMA


def test_held_out_accuracy_and_calibration(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    rows = language_query(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.lang_pred != "und"]
    right = np.array([r.lang_pred == r.lang for r in held])
    score = np.array([r.score for r in held])
    assert right.mean() > 0.97
    assert abs(score.mean() - right.mean()) < 0.05
    assert ((0 <= score) & (score <= 1)).all()


def plain_counts(text):
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    run = " " + letters
    while "  " in run:
        run = run.replace("  ", " ")
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(run) - n + 1):
            if i + n == 1:
                continue  # the leading space alone
            key = n
            for c in run[i:i + n]:
                key = (key * 0x110001 + ord(c)) % (1 << 64)
            out[int(mix64(np.array([key], np.uint64))[0]) % li.BUCKETS] += 1
    return out


def test_counts_match_and_do_not_depend_on_chunks(monkeypatch):
    for text in ("Hello,  World 12 x", "É", "  a", "Straße  und\nmehr. \U0001f600 end", "a1b2c3"):
        counts = gram_counts(text)
        assert {int(i): int(counts[i]) for i in np.flatnonzero(counts)} == dict(plain_counts(text))
    text = "Ein langer Text, 12  mit  Zahlen. " * 50
    whole = gram_counts(text)
    for size in (1, 2, 3, 7, 100):
        monkeypatch.setattr(li, "_CHUNK", size)
        assert (gram_counts(text) == whole).all()


def test_weights_are_sparse_and_label_free(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = fit_language_model(docs)
    assert (model.weights == 0).mean() > 0.5
    odd = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("yy")})
    a = predict_languages(docs, model).orderBy("doc_id").collect()
    assert a == predict_languages(odd, model).orderBy("doc_id").collect()


def test_edge_cases(spark):
    rows = [(i, f"the cat sat on the mat and {i} dogs ran", "en") for i in range(60)]
    rows += [(i + 60, f"der Hund und die Katze sind nicht {i} mal da", "de") for i in range(60)]
    rows += [(900, None, "en"), (901, "", "en"), (902, "123 !!", "de"), (903, "the dog", None), (None, "the dogs and cats", "de"),
             (5, "the cat", "en"), (5, "the cat", "en"), (904, "the cat and the dog " * 100_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "1 as key", "2 as score", "'q' as lang_pred")
    out = language_query(docs).collect()
    said = {r.doc_id: (r.lang_pred, r.score) for r in out}
    assert len(out) == len(rows)
    assert said[900] == said[901] == said[902] == ("und", 0.0)
    assert said[903][0] == said[904][0] == said[None][0] == "en"
    assert language_query(spark.createDataFrame([], SCHEMA)).count() == 0
    unlabelled = spark.createDataFrame([(1, "some words", None)], "doc_id bigint, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language_query(unlabelled).collect()] == [("und", 0.0)]
