"""Line deduplication against a comparison of every two lines."""

import random

import pytest

from offramp.llm import line_dedup
from offramp.llm.common import sieved, stored
from offramp.llm.line_dedup import _variants, dedup_lines
from tests.llm.conftest import SCHEMA


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    at = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[at + (len(a) == len(b)):] == b[at + 1:]


def expected(rows, edits=1, least=16):
    """[(doc_id, text, n_lines, n_exact, n_near)] with all pairs of lines compared."""
    seen, out = [], []
    for key, text in sorted(rows):
        kept, exact, near = [], 0, 0
        for line in (text or "").split("\n"):
            bare = line.strip(" \t\r\x0b\x0c")
            if len(bare) >= least:
                if bare in seen:
                    exact += 1
                    continue
                close = edits and any(one_edit(bare, x) for x in seen)
                seen.append(bare)
                if close:
                    near += 1
                    continue
            kept.append(line)
        out.append((key, None if text is None else "\n".join(kept), 0 if text is None else len(text.split("\n")), exact, near))
    return out


def result(df):
    return sorted((r.doc_id, r.text, r.n_lines, r.n_exact, r.n_near) for r in df.collect())


def edited(rng, line):
    at = rng.randrange(len(line) + 1)
    kind = rng.choice("rid")
    c = rng.choice("abcé \t")
    return line[:at] + ("" if kind == "d" else c) + line[at + (kind != "i"):]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_all_pairs(spark, seed):
    rng = random.Random(seed)
    lines = ["".join(rng.choice("abcdefg éß") for _ in range(rng.choice([16, 17, 24, 31, 32, 33, 60, 300]))) for _ in range(25)]
    for _ in range(160):  # neighbours of neighbours, so that "earlier" is not transitive
        lines.append(edited(rng, rng.choice(lines)))
    lines += ["Chapter number %d of the book" % i for i in range(1, 30)] + ["short", "short", "", "a" * 16, "a" * 17, "a" * 18]
    rng.shuffle(lines)
    rows = []
    while lines:
        n = rng.randint(1, 6)
        rows.append((len(rows), "\n".join(lines[:n] + rng.sample(lines[:n], 1))))
        lines = lines[n:]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    wanted = expected(rows)
    assert sum(r[4] for r in wanted) > 50
    assert result(dedup_lines(docs)) == wanted
    assert result(dedup_lines(docs, max_edits=0)) == expected(rows, 0)


def test_very_long_line(spark):
    rng = random.Random(7)
    line = "".join(rng.choice("abcdefgh ") for _ in range(40_000))
    rows = [(1, line), (2, line[:20_001] + line[20_002:]), (3, line[:9] + "Z" + line[10:]), (4, line[:-9]), (5, line)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert [r[3:] for r in result(dedup_lines(docs))] == [(0, 0), (0, 1), (0, 1), (0, 0), (1, 0)]


def test_edge_cases(spark):
    line = "a line of more than sixteen characters"
    rows = [(1, None), (2, ""), (3, line), (3, line), (4, f"  {line}\t\nx"), (None, line.upper()), (5, line.upper() + "\n\n"), (6, "x\nx")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "9 as N_near", "7 as h1", "8 as id", "1 as near", "2 as exact")
    out = dedup_lines(docs)
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_exact, r.n_near) for r in out.select("doc_id", "text", "n_lines", "n_exact", out["n_near"]).collect()), key=repr)
    assert got == sorted([(1, None, 0, 0, 0), (2, "", 1, 0, 0), (3, line, 1, 0, 0), (3, line, 1, 0, 0), (4, "x", 2, 1, 0),
                          (None, line.upper(), 1, 0, 0), (5, "\n", 3, 1, 0), (6, "x\nx", 2, 0, 0)], key=repr)
    assert {"h1", "id", "near", "exact"} < set(out.columns)
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_sieve_misses_nothing(spark):
    lines = spark.range(2000).selectExpr("id", "xxhash64(id) as h1")
    wanted = stored(lines.where("id < 50").select("h1"), "t-wanted")
    left = {r.id for r in sieved(lines, "h1", wanted).collect()}
    assert set(range(50)) <= left and len(left) < 400
    nulls = lines.selectExpr("id", "if(id % 2 = 0, h1, null) as h1")
    assert {r.id for r in sieved(nulls, "h1", stored(nulls, "t-nulls")).collect()} == set(range(0, 2000, 2))
    assert sieved(lines, "h1", wanted.where("false")).count() == 0
    plan = sieved(lines, "h1", wanted).join(wanted.distinct().hint("merge"), "h1")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("SortMergeJoin") < plan.index("Exchange hashpartitioning(h1") < plan.index("BroadcastHashJoin")


def test_a_text_of_a_repeated_line_is_shuffled_once(spark, monkeypatch):
    """Lines that occur in every document meet the join with their texts at about one place each."""
    met = []

    def counted(rows, key, wanted):
        out = sieved(rows, key, wanted)
        met.append((rows.count(), out.count()))
        return out

    monkeypatch.setattr(line_dedup, "sieved", counted)
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(50)) + "z" for _ in range(8)]
    base += [line[:-1] + "y" for line in base]
    rows = [(i, "\n".join(base)) for i in range(100)]
    assert result(dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))) == expected(rows)
    assert len(met) == 1 and met[0][0] == 1600 and met[0][1] < 400


def test_variants_are_made_row_by_row(spark):
    blocks = spark.createDataFrame([(1, 7, "abcb", 0), (2, 7, "abcb", 1), (3, 8, "", 0), (4, 9, "é", 1)],
                                   "h1 bigint, block bigint, middle string, longer int")
    found = _variants(blocks)
    rows = found.collect()
    assert sorted((r.h1, r.kind) for r in rows) == [(1, 0)] * 4 + [(1, 1)] + [(2, 2)] * 4 + [(3, 1), (4, 2)]
    by = {(h, k): [r.variant for r in rows if (r.h1, r.kind) == (h, k)] for h in (1, 2, 3, 4) for k in (0, 1, 2)}
    assert len(set(by[1, 0])) == 4  # each with its place
    assert not set(by[1, 1]) & set(by[2, 2])
    whole = _variants(spark.createDataFrame([(5, 7, "acb", 0)], blocks.schema)).where("kind = 1").first().variant
    assert by[2, 2].count(whole) == 1
    assert "lambda" not in found._jdf.queryExecution().toString()
