"""Mixing against a plain recomputation, and nearness to the targets."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from offramp.llm import mixing
from offramp.llm.mixing import mix_documents, mix_plan, mix_query
from tests.llm.conftest import SCHEMA


def number(text, digits):
    return int(hashlib.md5(text.encode()).hexdigest()[:digits], 16)


def targets_of(sizes):
    """Dealing out by weight, with the excess of full sources dealt out again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = 1.5 * total - sum(2 * sizes[s] for s in full)
        open_ = sum(weight[s] for s in sizes if s not in full)
        level = rest / open_ if open_ else 0.0
        above = {s for s in sizes if s not in full and 2 * sizes[s] < weight[s] * level}
        if not above:
            return {s: 2.0 * sizes[s] if s in full else min(weight[s] * level, 2.0 * sizes[s]) for s in sizes}
        full |= above


def plan_of(rows):
    """Copies by doc_id of ``(doc_id, text, source)`` rows."""
    by_source = defaultdict(list)
    for key, text, source in rows:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        by_source[source].append((size, number(f"8:{'' if key is None else key}", 15), key))
    sizes = {s: sum(r[0] for r in some) for s, some in by_source.items()}
    targets, out = targets_of(sizes), Counter()
    for source, some in by_source.items():
        step = min(targets[source] / sizes[source], 2.0) if sizes[source] else 0.0
        u = number("8:" + ("none" if source is None else f"source {source}"), 8) / 2 ** 32
        for rank, (_, _, key) in enumerate(sorted(some), 1):
            out[key] += math.floor(u + rank * step) - math.floor(u + (rank - 1) * step)
    return out


@pytest.mark.parametrize("run", [20_000, 3])
def test_documents_match(spark, small, monkeypatch, run):
    monkeypatch.setattr(mixing, "RUN_ROWS", run)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    plan = plan_of(rows)
    assert {r.doc_id: r.copies for r in mix_plan(docs.repartition(4)).collect()} == dict(plan)
    mixed = Counter(r.doc_id for r in mix_documents(docs).select("doc_id").collect())
    assert mixed == Counter({k: n for k, n in plan.items() if n})


def test_sources_come_near_their_targets(spark, medium):
    by_source, most = defaultdict(int), defaultdict(int)
    rows = mix_query(spark.read.parquet(f"{medium}/documents.parquet").selectExpr("*", "source as s")).collect()
    assert all(r.taken <= 2 * r.size for r in rows)
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    target = {source[r.doc_id]: r.target for r in rows}
    for r in rows:
        by_source[source[r.doc_id]] += r.taken
        most[source[r.doc_id]] = max(most[source[r.doc_id]], r.size)
    for s, taken in by_source.items():
        assert abs(taken - target[s]) <= 2 * most[s]
    assert sum(target.values()) == pytest.approx(1.5 * sum(r.size for r in rows))


def test_edge_cases(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (1, "c", "x"), (2, None, "y"), (3, "", None), (None, "a b c", None), (None, "a b c", None),
            (4, "w " * 300_000, "é"), (5, "q", "\U0001f600")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 as size", "2 as plan_key", "3 as _identity", "4 as target")
    plan = plan_of(rows)
    found = Counter()
    for r in mix_plan(docs).collect():
        found[r.doc_id] += r.copies
    assert found == plan
    mixed = mix_documents(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({k: n for k, n in plan.items() if n})
    empty = spark.createDataFrame([], SCHEMA)
    assert mix_query(empty).count() == 0 and mix_documents(empty).count() == 0


def test_repeated_rows_with_other_columns_agree_between_reruns(spark):
    rows = [(1, "a b c", "s", i, [i]) for i in range(7)] + [(None, "a b c", "s", i, None) for i in range(5)] + [(2, "d " * 40, None, 0, [])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, turn int, copies array<int>")
    first = sorted(map(repr, mix_documents(docs).collect()))
    assert first == sorted(map(repr, mix_documents(docs.repartition(5).orderBy("turn")).collect()))
    taken = {(r.doc_id, r.taken) for r in mix_query(docs.select("doc_id", "text", "source")).collect()}
    assert len(first) == sum(r.taken // r.size for r in mix_query(docs.select("doc_id", "text", "source")).collect()), taken


def test_texts_are_shuffled_once(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plan = mix_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1
    assert plan.split("REPARTITION_BY_COL")[0].count("Exchange hashpartitioning") == 1  # none between it and the result
