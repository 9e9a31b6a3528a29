"""The rule ledger against a plain recomputation, policies and ablations by counting."""

import re

from offramp.llm.quality_rules import (MEASURES, POLICIES, RULES, ablations, apply_policy, keep_documents, policy_mask,
                                       quality_query, rule_ledger)
from tests.llm.conftest import SCHEMA

WORD = r"[^\x20\x09-\x0D]+"


def measured(text):
    text = text or ""
    words = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    windows, repeated = {}, set()
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i:i + 5]), []).append(i)
    for places in windows.values():
        if len(places) > 1:
            repeated |= {i + k for i in places for k in range(5)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated)}


def failed(text):
    m = measured(text)
    return {r.name for r in RULES if eval(r.fails, {}, m)}


def verdict(text, policy="v2"):
    return not failed(text) & set(POLICIES[policy])


ROWS = [(1, None), (2, ""), (3, "a b c d e f g h i j"), (4, "one two three four five " * 4), (None, "é x 1 2 3 4 5 6 7 8 9"), (5, "# " * 50),
        (5, "# " * 50), (6, "same line of words\n" * 9 + "another line that has many more words than ten"), (7, "x" * 500 + " a b c d e f g h i j"),
        (8, "long text of many words " * 60_000), (9, "\x0b\x0c tab\tand\rreturn a b c d e f g")]


def test_ledger_matches(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame(ROWS, "doc_id bigint, text string")).selectExpr("*", "1 as n_words", "2 as failed", "3 as N_Lines")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    ledger = rule_ledger(docs)
    wanted = sorted(((k, *measured(t).values(), sum(1 << r.bit for r in RULES if r.name in failed(t))) for k, t in rows), key=repr)
    assert sorted((tuple(r[c] for c in ("doc_id", *MEASURES, "failed")) for r in ledger.collect()), key=repr) == wanted
    for policy in POLICIES:
        kept = apply_policy(ledger, policy).where("kept").count()
        assert kept == sum(verdict(t, policy) for _, t in rows) == keep_documents(docs, policy).count()
    assert keep_documents(docs).columns == docs.columns
    for row in ablations(ledger, "v2").collect():
        mine = [failed(t) & set(POLICIES["v2"]) for _, t in rows]
        assert row.fails == sum(row.rule in f for f in mine)
        assert row.only == sum({row.rule} == f for f in mine)
        assert row.rejected - row.rejected_without == row.only and row.rejected == sum(map(bool, mine))


def test_contract_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    out = quality_query(docs)
    assert out.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    for row in out.collect():
        assert row.base_failed == (row.n_words < 10 or 100 * row.n_repeat_words > 20 * row.n_words)
        assert not (row.base_failed and row.kept)
    assert quality_query(spark.createDataFrame([], SCHEMA)).count() == 0


def test_masks_are_stable():
    assert [r.bit for r in RULES] == list(range(len(RULES)))
    assert policy_mask("base") == 3 and policy_mask(["symbols"]) == 32
