"""The pipeline stage by stage against plain recomputations of each stage's own input."""

import re
from collections import Counter, defaultdict

import corpus_pipeline as cp
from tests.llm.test_line_dedup import expected as line_rows
from tests.llm.test_minhash import groups
from tests.llm.test_mixing import plan_of
from tests.llm.test_quality_rules import verdict


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, stages = docs.columns, dict(cp.STAGES)
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "pack"]

    kept = cp.stored(stages["quality_rules"](spark, docs, small), "t")
    given = rows_of(docs)
    assert sorted(rows_of(kept)) == sorted((k, t) for k, t in given if verdict(t))

    lines = cp.stored(stages["line_dedup"](spark, kept, small), "t")
    wanted = [(k, t) for k, t, _, exact, near in line_rows(rows_of(kept)) if t is None or t.strip(" \t\n\r\x0b\x0c") or not exact + near]
    assert sorted(rows_of(lines)) == sorted(wanted)
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    unique = cp.stored(stages["near_dedup"](spark, lines, small), "t")
    given = rows_of(lines)
    keep = {k for k, _, c in groups(given) if k == c}
    assert sorted(rows_of(unique)) == sorted((k, t) for k, t in given if k in keep)

    mixed = cp.stored(stages["mix_sources"](spark, unique, small), "t")
    plan = plan_of([(r.doc_id, r.text, r.source) for r in unique.collect()])
    assert Counter(r.doc_id for r in mixed.select("doc_id").collect()) == Counter({k: n for k, n in plan.items() if n})
    for df in (kept, lines, unique, mixed):
        assert df.columns == columns

    pieces = stages["pack"](spark, mixed, small).collect()
    tokens, copies = defaultdict(int), Counter(r.doc_id for r in mixed.select("doc_id").collect())
    for p in pieces:
        tokens[p.doc_id, p.doc_tokens] += p.length
    assert all(total == n * copies[k] for (k, n), total in tokens.items())
    assert {k for k, _ in tokens} == set(copies)
    assert Counter(p.length for p in cp.run(spark, small).collect()) == Counter(p.length for p in pieces)


def test_empty_and_null_rows(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for rows in ([], [(1, None, None, None, None), (None, "", None, None, 0)], [(None, "w%d " % i * 30, None, None, 5) for i in range(3)]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in cp.STAGES:
            docs = stage(spark, docs, "")
            assert name == "pack" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.collect()
