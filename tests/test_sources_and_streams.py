import gc
import glob
import time
import weakref

import pytest
from pyspark.sql import functions as F

from offramp.operators import userfuncs
from offramp.operators.decontaminate import load_benchmark
from offramp.operators.metrics import log_window
from offramp.plans import jobs
from offramp.plans.inputs import event_metrics, examples
from offramp.session import scratch_path
from offramp.sources import tables as T
from offramp.streaming import jobs as streams


@pytest.fixture(scope="module")
def documents(spark, medium):
    return spark.read.parquet(f"{medium}/documents.parquet")


def test_mixing_is_repeatable_and_has_the_known_counts(documents):
    fractions = {"en": 1.0, "de": 0.5, "fr": 0.25, "es": 0.0}
    for parts in (1, 7):
        df = documents.select("doc_id", "lang").repartition(parts)
        mixed = T.mix_datasets({k: (df.where(F.col("lang") == k), f) for k, f in fractions.items()}, 42, "doc_id")
        counts = {r["lang"]: r["count"] for r in mixed.groupBy("lang").count().collect()}
        assert counts == {"en": 620, "de": 65, "fr": 37}
        one_scan = T.mix_by_column(df, "lang", fractions, 42, "doc_id")
        assert sorted(one_scan.collect()) == sorted(mixed.collect())


def test_bad_fractions(documents):
    for fraction in (-0.1, 1.1):
        with pytest.raises(ValueError):
            T.mix_datasets({"a": (documents, fraction)}, 1, "doc_id")
        with pytest.raises(ValueError):
            T.mix_by_column(documents, "lang", {"en": fraction}, 1, "doc_id")
    with pytest.raises(ValueError):
        T.mix_datasets({}, 1, "doc_id")


def test_split_does_not_depend_on_partitions(documents):
    a = T.select_split(documents.repartition(3), "test", "doc_id", 0.1).select("doc_id").collect()
    b = T.select_split(documents.repartition(8), "test", "doc_id", 0.1).select("doc_id").collect()
    train = T.select_split(documents, "train", "doc_id", 0.1).select("doc_id").collect()
    assert sorted(a) == sorted(b) and len(a) + len(train) == documents.count() and not set(a) & set(train)
    assert 60 < len(a) < 140
    named = documents.select("doc_id").withColumn("split", F.lit("train"))
    assert T.select_split(named, "test").count() == 0
    with pytest.raises(ValueError):
        T.select_split(documents)


def test_shards(spark, documents):
    path = scratch_path(spark, "t-shards")
    T.write_shards(documents.select("doc_id", "lang"), path, "doc_id", 16)
    assert len(glob.glob(f"{path}/part-*.parquet")) == 16
    back = spark.read.parquet(path)
    assert sorted(back.collect()) == sorted(documents.select("doc_id", "lang").collect())


@pytest.mark.parametrize("rows", [3_000, 30_000, 120_000])
def test_shards_of_a_size(spark, rows):
    """Whatever the number of rows, and with a tenth of them a hundred times as long."""
    import os
    length = F.when(F.col("id") % 10 == 0, 400).otherwise(4)
    words = F.transform(F.sequence(F.lit(1), length), lambda i: F.hex(F.xxhash64("id", i)))
    df = spark.range(rows).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text"))
    path, target = scratch_path(spark, "t-sized"), 600_000
    T.write_shards(df, path, "doc_id", target_bytes=target)
    sizes = [os.path.getsize(f) for f in glob.glob(f"{path}/part-*.parquet")]
    assert len(sizes) > 1 and target / 2 <= min(sizes) and max(sizes) <= 2 * target
    assert spark.read.parquet(path).count() == rows
    T.write_shards(df.limit(0), path, "doc_id", target_bytes=target)
    assert spark.read.parquet(path).count() == 0


def test_sizing_reads_in_many_tasks(spark):
    """The trial file's rows come from a shuffle: no task reads the whole table for them."""
    import os
    path = scratch_path(spark, "t-many")
    spark.range(4_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("t")).repartition(8).write.parquet(path)
    df = spark.read.parquet(path).withColumn("reader", F.spark_partition_id())
    T.shards_by_size(df, ["id"], 20_000)
    trials = sorted(glob.glob(f"{scratch_path(spark, 'x').rsplit('/', 1)[0]}/trial-*"), key=os.path.getmtime)
    assert spark.read.parquet(trials[-1]).select("reader").distinct().count() > 1


def test_read_examples_split(spark, documents):
    path = scratch_path(spark, "t-split")
    labelled = T.assign_split(examples(documents), "doc_id", 0.2, 1)
    T.write_shards(labelled, path, "doc_id", 4, partition_by=["split"])
    test = T.read_examples(spark, path, split="test")
    assert test.columns == ["prompt", "text"] and test.count() == labelled.where("split = 'test'").count()
    assert "PartitionFilters: [isnotnull(split" in test._jdf.queryExecution().executedPlan().toString()


def test_prepared_set_is_reused_until_settings_change(spark):
    path, built = scratch_path(spark, "t-prep"), []

    def build():
        built.append(1)
        return spark.range(20).withColumnRenamed("id", "doc_id")

    for settings in ({"a": 1, "b": 2}, {"b": 2, "a": 1}, {"a": 1, "b": 3}):
        assert T.prepare_or_load(spark, path, build, settings, num_shards=2).count() == 20
    assert len(built) == 2
    # a set without its completion marker counts as not written
    broken = scratch_path(spark, "t-broken")
    spark.range(3).withColumnRenamed("id", "doc_id").write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{broken}/set-{T.fingerprint({})}")
    assert T.prepare_or_load(spark, broken, build, {}, num_shards=2).count() == 20
    with pytest.raises(ValueError):
        T.prepare_or_load(spark, "", build, {})


def _sets(path):
    """Modification times of all complete sets below a path."""
    import os
    return {m: os.stat(m).st_mtime_ns for m in glob.glob(f"{path}/**/_SUCCESS", recursive=True) if "/set-" in m}


def test_only_what_changed_is_prepared_again(spark):
    folder, path = scratch_path(spark, "t-in"), scratch_path(spark, "t-out")
    rows = lambda low, high: spark.range(low, high).selectExpr("id AS doc_id", "concat('p', id) AS prompt", "concat('text ', id) AS text")
    for name, low in (("a", 0), ("b", 1000)):
        rows(low, low + 40).repartition(3).write.parquet(f"{folder}/{name}")
    bench = lambda: spark.read.parquet(f"{folder}/bench")
    spark.createDataFrame([("text 7<|eot_id|>",)], "text string").write.parquet(f"{folder}/bench")
    settings = jobs.CorpusSettings(mixer={"a": 1.0, "b": 0.5}, decontaminate=True)

    def prepared(**changes):
        from dataclasses import replace
        sources = {n: spark.read.parquet(f"{folder}/{n}") for n in ("a", "b")}
        return jobs.prepare_corpus(spark, sources, path, replace(settings, **changes), bench(), num_shards=4)

    first = prepared().count()
    before = _sets(path)
    assert len(before) == 2 and prepared().count() == first and _sets(path) == before
    # the same rows in other files: nothing to do
    spark.read.parquet(f"{folder}/a").coalesce(1).write.parquet(f"{folder}/a2")
    rows(0, 0).write.mode("overwrite").parquet(f"{folder}/a")
    spark.read.parquet(f"{folder}/a2").write.mode("overwrite").parquet(f"{folder}/a")
    assert prepared().count() == first and _sets(path) == before
    # one source grows, then its fraction changes: the other one's set stays
    rows(5000, 5010).coalesce(1).write.mode("append").parquet(f"{folder}/a")
    assert prepared().count() == first + 10
    grown = _sets(path)
    assert len(grown) == 3 and all(grown[k] == t for k, t in before.items())
    assert prepared(mixer={"a": 1.0, "b": 1.0}).count() > first + 10 and len(_sets(path)) == 4
    # another benchmark: both again
    spark.createDataFrame([("text 8<|eot_id|>",), ("text 7<|eot_id|>",)], "text string").write.mode("overwrite").parquet(f"{folder}/bench")
    assert prepared().count() == first + 9 and len(_sets(path)) == 6
    with pytest.raises(ValueError, match="no such sources"):
        prepared(mixer={"c": 1.0})


def test_prepared_sets_have_more_files_when_larger(spark, monkeypatch):
    monkeypatch.setattr(T, "MAX_SHARD_BYTES", 20_000)
    folder, path = scratch_path(spark, "t-in"), scratch_path(spark, "t-out")
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.hex(F.xxhash64("id", i))))
    spark.range(600).select(F.col("id").alias("doc_id"), F.lit("p").alias("prompt"), text.alias("text")).write.parquet(f"{folder}/a")
    spark.range(5).select(F.col("id").alias("doc_id"), F.lit("p").alias("prompt"), F.lit("t").alias("text")).write.parquet(f"{folder}/b")
    sources = {n: spark.read.parquet(f"{folder}/{n}") for n in ("a", "b")}
    assert jobs.prepare_corpus(spark, sources, path, jobs.CorpusSettings(), num_shards=4).count() == 605
    files = sorted(len(glob.glob(f"{s.rsplit('/', 1)[0]}/part-*.parquet")) for s in _sets(path))
    assert files[0] <= 2 and 10 <= files[1] <= 12
    # the built rows are summed where no inputs are given
    plain = scratch_path(spark, "t-plain")
    assert T.prepare_or_load(spark, plain, lambda: sources["a"], {}, num_shards=2).count() == 600
    assert [len(glob.glob(f"{s.rsplit('/', 1)[0]}/part-*.parquet")) for s in _sets(plain)] == [11]


def test_content_digests(spark):
    folder = scratch_path(spark, "t-digest")
    df = spark.range(50).selectExpr("id", "if(id % 7 = 0, null, concat('x', id)) AS t", "array(id, id + 1) AS v", "map('k', id) AS m")
    df.repartition(4).write.parquet(f"{folder}/in dir")
    read = lambda: spark.read.parquet(f"{folder}/in dir")
    digest = T.content_digest(read(), f"{folder}/m")
    assert T.content_digest(read(), f"{folder}/m") == digest == T.content_digest(df, f"{folder}/m")
    known = spark.read.parquet(f"{folder}/m")
    assert known.count() == len(read().inputFiles()) and known.agg(F.sum("rows")).first()[0] == 50
    part = T.content_digest(read().where("id < 30"), f"{folder}/m")
    assert part != digest and part == T.content_digest(df.where("id < 30"), f"{folder}/m")
    df.limit(1).coalesce(1).write.mode("append").parquet(f"{folder}/in dir")
    assert T.content_digest(read(), f"{folder}/m") != digest
    assert spark.read.parquet(f"{folder}/m").where(F.col("rows") == 1).count() == 1
    assert T.content_digest(read().groupBy("id").count(), f"{folder}/m") == T.content_digest(
        spark.range(50).selectExpr("id", "if(id = 0, 2L, 1L) AS count"), f"{folder}/m")


def test_metrics_append(spark):
    path = scratch_path(spark, "t-metrics")
    rows = spark.createDataFrame([("r", 1, "ce_loss", 4, 0.5)],
                                 "run_id string, step long, metric string, exit_layer int, value double")
    T.write_metrics(rows, path)
    T.write_metrics(rows.withColumn("run_id", F.lit("s")), path)
    T.write_metrics(rows.withColumn("step", F.lit(2)), path)
    assert spark.read.parquet(path).where("run_id = 'r'").count() == 2
    assert spark.read.parquet(path).count() == 3


@pytest.fixture(scope="module")
def files(spark, documents):
    """The same rows in 1 and in 4 files."""
    paths = {}
    for n in (1, 4):
        paths[n] = scratch_path(spark, f"t-files{n}")
        documents.repartition(n, "doc_id").write.parquet(paths[n])
    return paths


@pytest.mark.parametrize("n", [1, 4])
def test_stream_equals_batch_and_resumes(spark, documents, files, medium, n):
    benchmark = load_benchmark(spark.read.parquet(f"{medium}/benchmark.parquet"))
    settings = jobs.CorpusSettings(empty_system=True, decontaminate=True)
    batch = jobs.template_corpus(examples(documents), settings, benchmark)
    out, state = scratch_path(spark, "t-out"), scratch_path(spark, "t-state")

    def run():
        stream = examples(T.stream_examples(spark, files[n], documents.schema))
        query = streams.run_prepare(streams.prepare_stream(stream, benchmark, system=True), out, state)
        query.awaitTermination()
        return [p for p in query.recentProgress if p["numInputRows"]]

    assert len(run()) == n
    assert run() == []
    rows = streams.read_prepared(spark, out)
    assert rows.count() == 974 and sorted(rows.collect()) == sorted(batch.collect())
    documents.limit(5).withColumn("doc_id", F.col("doc_id") + 10**6).coalesce(1).write.mode("append").parquet(files[n])
    assert len(run()) == 1
    assert spark.read.parquet(out).count() >= 974
    assert spark.read.parquet(out).count() == spark.read.parquet(out).select("doc_id").distinct().count()


def test_stream_with_a_large_benchmark(spark, documents, medium):
    source = scratch_path(spark, "t-large")
    documents.repartition(2, "doc_id").write.parquet(source)
    benchmark = load_benchmark(spark.read.parquet(f"{medium}/benchmark.parquet"), max_local_items=0)
    out, state = scratch_path(spark, "t-large-out"), scratch_path(spark, "t-large-state")
    for _ in range(2):
        stream = examples(T.stream_examples(spark, source, documents.schema))
        prepared = streams.prepare_stream(stream, benchmark)
        with pytest.raises(ValueError):
            streams.run_prepare(prepared, out, state)
        streams.run_prepare(prepared, out, state, benchmark).awaitTermination()
    settings = jobs.CorpusSettings(decontaminate=True)
    batch = jobs.template_corpus(examples(documents), settings, benchmark)
    assert sorted(streams.read_prepared(spark, out).collect()) == sorted(batch.collect())
    assert batch.count() == 974


def test_stream_metrics_equal_batch(spark, medium):
    events = spark.read.parquet(f"{medium}/events.parquet")
    source = scratch_path(spark, "t-events")
    events.repartition(4, "event_id").write.parquet(source)
    out, state = scratch_path(spark, "t-means"), scratch_path(spark, "t-means-state")
    for _ in range(2):
        stream = event_metrics(T.stream_examples(spark, source, events.schema))
        streams.run_window_means(streams.window_means(stream), out, state).awaitTermination()
    got = {(r["run_id"], r["window"], r["metric"]): (round(r["value"], 6), r["n"])
           for r in streams.read_window_means(spark, out).collect()}
    want = {(r["run_id"], r["window"], r["metric"]): (round(r["value"], 6), r["n"])
            for r in log_window(event_metrics(events)).collect()}
    assert got == want


def test_windows_end_once_and_leave_no_state(spark):
    """Two runs at different steps, files in order, a restart in between, then late rows."""
    source, out, state = (scratch_path(spark, f"t-ended-{n}") for n in ("in", "out", "state"))
    schema = "run_id string, step bigint, metric string, exit_layer int, value double"

    def rows(run, low, high):
        return [(run, s, m, e, (s * 7 + e) % 13 / 4) for s in range(low, high) for m in ("ce_loss", "kl_loss") for e in (4, 8)]

    def add(*parts):
        for part in parts:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
            time.sleep(0.05)  # files are read in the order of their time

    def run():
        stream = T.stream_examples(spark, source, schema)
        query = streams.run_ended_windows(streams.ended_windows(stream, late_steps=5), out, state)
        query.awaitTermination()
        return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"]]

    def wanted(high):
        want = log_window(spark.read.schema(schema).parquet(source)).collect()
        return {(r["run_id"], r["window"], r["metric"]): (round(r["value"], 9), r["n"])
                for r in want if r["window"] < (high[r["run_id"]] - 5) // 10}

    def got():
        return {(r["run_id"], r["window"], r["metric"]): (round(r["value"], 9), r["n"])
                for r in streams.read_ended_windows(spark, out).collect()}

    add(rows("a", 1000, 1033), rows("b", 0, 17))
    assert max(run()) == 8  # one state for each run and metric, whatever the steps
    assert got() == wanted({"a": 1032, "b": 16}) and len(got()) == 12
    add(rows("a", 1033, 1090), rows("b", 17, 41))
    assert max(run()) == 8 and got() == wanted({"a": 1089, "b": 40})
    written = spark.read.parquet(out)
    assert written.count() == written.select("run_id", "window", "metric").distinct().count()  # each once
    add([("b", 3, "ce_loss", 4, 100.0)])
    run()
    assert got() == wanted({"a": 1089, "b": 40}) and spark.read.parquet(out).count() == written.count() + 1


def test_user_functions(spark):
    df = spark.range(30).withColumn("text", F.concat(F.lit("t"), "id"))
    mapped = userfuncs.map_examples(df, lambda d: d.withColumn("n", F.length("text")), remove_columns=["text"])
    assert mapped.columns == ["id", "n"]
    batch = userfuncs.map_examples(df, lambda b: b.assign(text=b["text"].str.upper()), df.schema, num_partitions=3)
    assert {r["text"] for r in batch.collect()} == {f"T{i}" for i in range(30)}
    kept = userfuncs.filter_batches(df, lambda i, t: [x % 2 == 0 and len(s) == 2 for x, s in zip(i, t)], ["id", "text"])
    assert sorted(r["id"] for r in kept.collect()) == [0, 2, 4, 6, 8]
    with pytest.raises(Exception, match="one answer per row"):
        userfuncs.filter_batches(df, lambda t: [True], ["text"]).collect()


def test_corpus_settings(spark, documents):
    with pytest.raises(ValueError):
        jobs.template_corpus(examples(documents), jobs.CorpusSettings(decontaminate=True))


def test_reference_cycles_of_user_functions_do_not_pile_up(spark):
    name, refs = "spark.sql.execution.arrow.maxRecordsPerBatch", []

    def left_alive():
        """How many objects of earlier calls are alive; leaves one in a cycle. No collection comes by itself."""
        class Node:
            pass

        gc.disable()
        alive = sum(r() is not None for r in refs)
        node = Node()
        node.me = node
        refs.append(weakref.ref(node))
        return alive

    df = spark.range(50).repartition(1)
    size = spark.conf.get(name)
    spark.conf.set(name, "10")
    try:
        mapped = userfuncs.map_examples(df, lambda b: b.assign(alive=left_alive()), "id bigint, alive bigint")
        assert [r["alive"] for r in mapped.collect()] == [0] * 50
        kept = userfuncs.filter_batches(df, lambda s: [left_alive() == 0] * len(s), ["id"])
        assert kept.count() == 50
    finally:
        spark.conf.set(name, size)


def test_map_examples_gives_long_rows_in_parts(spark):
    df = spark.range(30).repartition(1).withColumn("text", F.repeat(F.lit("x"), 1 << 20))

    def shape(batch):
        return batch.assign(n=len(batch), first=batch.index[0], text=batch["text"].str.len().astype(str))

    rows = userfuncs.map_examples(df, shape, "id bigint, text string, n bigint, first bigint").collect()
    assert sorted(r["id"] for r in rows) == list(range(30)) and {r["text"] for r in rows} == {str(1 << 20)}
    assert max(r["n"] for r in rows) <= 4 and {r["first"] for r in rows} == {0}


def test_micro_batches_cut_by_bytes(spark, tmp_path):
    rows = spark.range(400).selectExpr("id as doc_id", "'a prompt' as prompt", "'a text' as text").repartition(4)
    rows.write.parquet(str(tmp_path / "in"))
    size = sum(f.stat().st_size for f in (tmp_path / "in").glob("*.parquet"))
    for name, bound, batches in (("all", 10 * size, 1), ("some", size // 2, 2), ("each", 1, 4)):
        stream = T.stream_examples(spark, str(tmp_path / "in"), rows.schema, max_bytes=bound)
        streams.run_prepare(stream, str(tmp_path / name), str(tmp_path / f"{name}-state")).awaitTermination()
        assert streams.read_prepared(spark, str(tmp_path / name)).count() == 400
        found = len(list((tmp_path / name).glob("batch_id=*")))
        assert found == batches or (name == "some" and 1 < found < 4)
