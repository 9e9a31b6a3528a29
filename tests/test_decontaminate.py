import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from offramp.functions import bloom
from offramp.functions.bloom import build_filter, held_by, run_hashes
from offramp.functions.text import normalize_text
from offramp.operators import decontaminate as D
from offramp.operators.decontaminate import (Benchmark, decontaminate, decontamination_report,
                                             flag_contaminated, load_benchmark)


def _norm(text):
    return re.sub("[ \t\n\r\f]+", " ", text.lower()).strip(" ")


def _expected(docs, bench):
    items = [_norm(b) for b in bench if _norm(b)]
    return {i for i, t in enumerate(docs) if t is not None and any(b in _norm(t) for b in items)}


def _flagged(spark, docs, bench, local, ngram=8):
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")
    bounds = {} if local else {"max_local_items": 0}
    rows = flag_contaminated(df, items, ngram=ngram, **bounds).collect()
    assert len(rows) == len(docs)
    return {r["doc_id"] for r in rows if r["contaminated"]}


LONG = "one two three four five six seven eight nine ten eleven twelve"


@pytest.mark.parametrize("local", [True, False])
def test_positions_and_near_misses(spark, local):
    docs = [LONG, f"{LONG} and more", f"before {LONG}", f"pre{LONG}post", LONG.upper(),
            LONG.replace(" ", " \n\t "), LONG.replace("seven", "sevenx"), LONG[1:], LONG[:-1], "", None,
            LONG.replace("two three", "two  3")]
    found = _flagged(spark, docs, [LONG], local)
    assert found == {0, 1, 2, 3, 4, 5} == _expected(docs, [LONG])


@pytest.mark.parametrize("local", [True, False])
@pytest.mark.parametrize("item", ["a", "ab", "a b", "bc ab", "a b c", "b a c b", "", "  ", "é", "a\x1eb"])
def test_short_items(spark, local, item):
    docs = ["a", "b", "ab", "xab cy", "a b", "za bz", "a b c", "xa b cz", "b a c b", "bb a c bb", "É", "a\x1eb", ""]
    assert _flagged(spark, docs, [item], local) == _expected(docs, [item])


@pytest.mark.parametrize("local", [True, False])
@pytest.mark.parametrize("ngram", [1, 3, 8])
def test_random_texts_against_brute_force(spark, local, ngram):
    rng = random.Random(ngram)
    alphabet = ["a", "b", "ab", "ba", "c", "A", "Bc"]
    bench = [" ".join(rng.choices(alphabet, k=rng.randint(1, 12))) for _ in range(25)]
    docs = [" ".join(rng.choices(alphabet, k=rng.randint(0, 14))) for _ in range(150)]
    for _ in range(60):
        docs.append(" ".join(rng.choices(alphabet, k=3)) + rng.choice(["", " "]) + rng.choice(bench)
                    + rng.choice(["", " "]) + " ".join(rng.choices(alphabet, k=3)))
    assert _flagged(spark, docs, bench, local, ngram) == _expected(docs, bench)


def test_hot_item_and_shared_openings(spark):
    """A third of the rows hold the same item, and all items open alike."""
    bench = [f"write a short program that prints the number {i} on one line" for i in range(50)]
    docs = [bench[7] + f" {i}" if i % 3 == 0 else f"nothing to see {i}" for i in range(300)]
    for local in (True, False):
        assert _flagged(spark, docs, bench, local) == _expected(docs, bench)


def test_rows_sharing_a_key_are_judged_each(spark):
    df = spark.createDataFrame([(1, LONG), (1, "clean"), (2, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(0, LONG)], "item_id long, text string")
    for bounds in ({}, {"max_local_items": 0}):
        kept = decontaminate(df, bench, **bounds).collect()
        assert sorted(map(tuple, kept)) == [(1, "clean"), (2, "clean")]


def test_empty_benchmark_keeps_everything(spark):
    df = spark.createDataFrame([(1, LONG)], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(df, bench).count() == 1
    assert decontaminate(df, bench, max_local_items=-1).count() == 1


def test_bounds_decide_the_plan(spark, small):
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    assert load_benchmark(bench).is_local
    assert not load_benchmark(bench, max_local_items=10).is_local
    assert not load_benchmark(bench, max_local_bytes=10).is_local
    assert isinstance(load_benchmark(bench), Benchmark)


@pytest.mark.parametrize("sf,hits", [("0.001", 3), ("0.01", 26)])
def test_known_counts(spark, sf, hits):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    bench = spark.read.parquet(f"/root/testdata/sf{sf}/benchmark.parquet")
    report = decontamination_report(flag_contaminated(docs, bench)).first()
    assert report["removed"] == hits
    assert report["kept"] + report["removed"] == report["rows_before"] == docs.count()


def test_report_of_no_rows(spark):
    empty = spark.createDataFrame([], "contaminated boolean")
    assert tuple(decontamination_report(empty).first()) == (0, 0, 0, 0.0)


def test_literals_are_folded(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plan = decontaminate(docs, spark.read.parquet(f"{small}/benchmark.parquet"))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "cast(split(" not in text and "Join" not in text
    assert plan.where(F.lit(True)).count() > 0


def test_templates_give_pairs_linear_in_the_texts(spark):
    """5,000 items that differ in their ends only, 20,000 texts with the template."""
    phrase = "w1 w2 w3 w4 w5 w6 w7 w8 w9"
    bench = spark.range(5_000).select(F.concat(F.lit("a"), F.col("id") % 70, F.lit(f" {phrase} end"), "id").alias("text"))
    texts = spark.range(20_000).select("id", F.concat(
        F.lit("see xa"), F.col("id") % 71, F.lit(f" {phrase} END"), F.col("id") % 9_000, F.lit("x and more")).alias("text"))
    benchmark = load_benchmark(bench)
    assert not benchmark.is_local
    hits = texts.select("id", "text", D.benchmark_hits("text", benchmark).alias("hits"))
    suspects = hits.select(F.sha2("text", 256).alias("digest"), normalize_text("text").alias("norm"), "hits")
    pairs = D.candidate_pairs(suspects, benchmark).count()
    flagged = {r["id"] for r in flag_contaminated(texts, benchmark, key="id").where("contaminated").collect()}
    want = {i for i in range(20_000)
            for n in {int(str(i % 9_000)[:k]) for k in range(1, len(str(i % 9_000)) + 1)}
            if n < 5_000 and n % 70 == i % 71}
    assert flagged == want and len(want) > 50
    assert pairs <= 4 * 20_000


@pytest.mark.parametrize("items", [
    ["ab cd", "ab ce", "ab cf"], [f"abcdefgh{i}" for i in range(30)], [f"abcdefgh i{i}" for i in range(30)],
    [f"x{i} mid" for i in range(30)], [f"x{i} m n y{i % 3}" for i in range(30)],
    [" ".join(["t"] * n) for n in range(3, 40)], [f"{i} t t t t t t t t {i % 4}" for i in range(40)]])
def test_shared_anchors(spark, monkeypatch, items):
    monkeypatch.setattr(D, "MANY_ITEMS", 2)
    rng = random.Random(len(items))
    docs = [f"pre {i} post" for i in items[::2]] + [f"pre{i}post" for i in items[::3]] + [i[1:] for i in items] + [i[:-1] for i in items]
    docs += [f"{rng.choice(items)} {rng.choice(items)[:5]} t t t {rng.choice(items)[3:]}" for _ in range(40)] + ["t " * 60, "none of it"]
    assert _flagged(spark, docs, items, False) == _expected(docs, items)


def test_runs_are_hashed_alike(spark):
    rng = np.random.default_rng(4)
    parts = rng.integers(-2**63, 2**63 - 1, 20)
    df = spark.createDataFrame([([int(x) for x in parts],)], "h array<bigint>")
    for kind in (1, 3, 8, -1, -5, -8):
        want = df.select(D._shingles(F.col("h"), abs(kind), kind).alias("s")).first()["s"]
        assert run_hashes(parts, abs(kind), kind).tolist() == want and len(want) == 21 - abs(kind)
    assert len(run_hashes(parts[:2], 3, 3)) == 0


def test_the_filter_misses_no_key(spark):
    rng = np.random.default_rng(3)
    keys = rng.integers(-2**63, 2**63 - 1, 30_000)
    df = spark.createDataFrame([(int(k),) for k in keys[:20_000]] + [(None,)], "key bigint")
    blocks = build_filter(df, "key", 20_000)
    assert len(held_by(blocks, keys[:20_000])) == 20_000
    assert len(held_by(blocks, keys[20_000:])) < 100
    small = build_filter(df, "key", 20_000, max_bytes=1_000)
    assert len(held_by(small, keys[:20_000])) == 20_000 and small.nbytes <= 1_000
    assert len(held_by(build_filter(df.limit(0), "key", 0), keys)) == 0


def test_clean_texts_stay_where_they_are(spark, small):
    """Two scans of the texts; only those with hits are exchanged."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    bench = load_benchmark(spark.read.parquet(f"{small}/benchmark.parquet"), max_local_items=0)
    plan = flag_contaminated(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, LONG, "a", "b"), (2, "clean", "c", "d")], "doc_id long, text string, _digest string, _held string")
    bench = spark.createDataFrame([(0, LONG)], "item_id long, text string")
    kept = decontaminate(df, bench, max_local_items=0)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(2, "clean", "c", "d")]


def test_hits_are_found_some_rows_at_a_time(spark, monkeypatch):
    """The same runs whether a batch is hashed at once or in slices, with long, empty and null rows."""
    import numpy as np
    parts = F.when(F.col("id") == 5, F.lit(None)).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("id") * 7 % 40), lambda i: F.xxhash64(i)))
    rows = spark.range(30).coalesce(1).select("id", F.array(F.when(F.col("id") % 4 > 0, parts).otherwise(F.array().cast("array<bigint>"))).alias("p"))
    blocks = np.full((4, 8), 0x55555555, np.uint32)
    blocks[:2] = 0xFFFFFFFF

    def found():
        return rows.select("id", bloom.passing_runs(blocks, [[2, 3]], F.col("p")).alias("hits")).orderBy("id").collect()

    whole = found()
    assert any(r["hits"] for r in whole)
    for size in (1, 50):
        monkeypatch.setattr(bloom, "_PARTS", size)
        assert found() == whole
