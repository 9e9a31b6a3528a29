"""Reading, mixing, writing and reusing tables of examples."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from offramp.functions.hashing import hash_below
from offramp.operators.ordering import bucket_of
from offramp.session import scratch_path


# Bytes of rows before compression that a task of a prepared set gets, on average at most.
MAX_SHARD_BYTES = 128 << 20


def read_examples(spark: SparkSession, path: str, columns: Sequence[str] = ("prompt", "text"),
                  split: str | None = None) -> DataFrame:
    """Read only the listed columns, optionally of one split (a ``split`` column)."""
    df = spark.read.parquet(path)
    if split is not None:
        df = df.where(F.col("split") == split)
    return df.select(*columns)


def mix_datasets(sources: Mapping[str, tuple[DataFrame, float]], seed: int, key: str) -> DataFrame:
    """Union of the sources, each with a seeded fraction of its rows.

    A row is kept when the hash of ``seed:key`` lies below the fraction, so the choice does
    not depend on partitioning and is the same after a retry. A whole source is kept or
    skipped without hashing.
    """
    if not sources:
        raise ValueError("no source to mix")
    parts = []
    for name, (df, fraction) in sources.items():
        if not 0.0 <= fraction <= 1.0:
            raise ValueError(f"fraction of {name!r} must be between 0 and 1, got {fraction}")
        if fraction == 0.0:
            df = df.where(F.lit(False))
        elif fraction < 1.0:
            df = df.where(hash_below(seed, key, fraction))
        parts.append(df)
    mixed = parts[0]
    for part in parts[1:]:
        mixed = mixed.unionByName(part)
    return mixed


def mix_by_column(df: DataFrame, column: str, fractions: Mapping[str, float], seed: int,
                  key: str) -> DataFrame:
    """``mix_datasets`` for sources that share one table: one scan instead of one per source.

    Rows of a source that is not named are dropped, as an unnamed dataset is not read.
    """
    kept = F.lit(False)
    for name, fraction in fractions.items():
        if not 0.0 <= fraction <= 1.0:
            raise ValueError(f"fraction of {name!r} must be between 0 and 1, got {fraction}")
        if fraction > 0.0:
            of_source = F.col(column) == name
            if fraction < 1.0:
                of_source = of_source & hash_below(seed, key, fraction)
            kept = kept | of_source
    wanted = [name for name, fraction in fractions.items() if fraction > 0.0]
    return df.where(F.col(column).isin(wanted)).where(kept)


def _row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row before compression."""
    def of(name: str, kind: str) -> Column:
        if kind in ("string", "binary"):
            return F.octet_length(name)
        if "<" in kind:
            return F.octet_length(F.to_json(F.struct(name)))
        return F.lit(8)

    sizes = [F.coalesce(of(name, kind), F.lit(1)).cast("bigint") for name, kind in df.dtypes]
    return reduce(lambda a, b: a + b, sizes, F.lit(0).cast("bigint"))


def shards_at_least(least: int, rows: Sequence[DataFrame]) -> int:
    """``least``, or as many shards as it takes for the bytes of the rows at ``MAX_SHARD_BYTES`` each."""
    total = sum(df.agg(F.sum(_row_bytes(df))).first()[0] or 0 for df in rows)
    return max(least, -(-total // MAX_SHARD_BYTES))


def shards_by_size(df: DataFrame, keys: Sequence[str], target_bytes: int) -> tuple[int, Column]:
    """The number of files of about ``target_bytes`` that the rows make, and the file of each row.

    The hash range of the keys is cut into cells, the bytes of the rows are summed per cell (a histogram
    of 65,536 or about a million numbers), and cells are joined to ranges of about equal bytes. What compression
    makes of the bytes is measured on one range that is written on trial.
    """
    bits = 16
    while True:
        cell = F.shiftrightunsigned(F.xxhash64(*keys), 64 - bits).cast("int")
        found = df.select(cell.alias("cell"), _row_bytes(df).alias("n")).groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        cells, sizes = found["cell"].to_numpy(), found["n"].to_numpy()
        order = np.argsort(cells)
        cells, ends = cells[order], np.cumsum(sizes[order])
        total = int(ends[-1]) if len(ends) else 0
        if bits == 20 or total <= target_bytes << (bits - 4):
            break
        bits = 20
    if not total:
        return 1, F.lit(0)
    # the trial: the first cells with about two files' bytes, found by all tasks and written by one
    some = int(cells[np.searchsorted(ends, min(total, 2 * target_bytes))])
    path = scratch_path(df.sparkSession, "trial")
    df.where(cell <= some).repartition(1).write.parquet(path)
    location, system = _file_system(df.sparkSession, path)
    written = system.getContentSummary(location).getLength()
    factor = written / int(ends[np.searchsorted(cells, some)])
    shards = max(1, round(total * factor / target_bytes))
    cuts = cells[np.searchsorted(ends, total * np.arange(1, shards) / shards, "right")]
    return shards, bucket_of(cell, sorted({int(c) for c in cuts}))


def write_shards(df: DataFrame, path: str, key: str | Sequence[str], num_shards: int = 64,
                 partition_by: Sequence[str] = (), target_bytes: int | None = None) -> None:
    """Write the prepared rows as ``num_shards`` files (per value of ``partition_by``), or with
    ``target_bytes`` as as many files of about that size as the rows make.

    Rows go to shards by the hash of ``key``, never round-robin, so a retried task writes the
    same file again. Use a key that is close to unique: rows of one key share a shard.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if target_bytes is None:
        spread = df.repartition(num_shards, *keys)
    else:
        shards, shard = shards_by_size(df, keys, target_bytes)
        spread = df.repartitionById(shards, shard.cast("int"))
    writer = spread.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, key: str = "seq_id", buckets: int = 64,
                   then_by: Sequence[str] = ()) -> None:
    """Save as a table bucketed by ``key`` and sorted by it and ``then_by``.

    Rows of a sequence then already share a partition: pairing exits with their teacher, attaching
    targets and deciding exits on such tables plan no exchange, and neither does a join with
    another table of as many buckets on ``key`` and more (with the session's
    ``spark.sql.requireAllClusterKeysForCoPartition`` off). Worth it for logits and hidden states that are read more than once.
    """
    (df.repartition(buckets, key).write.mode("overwrite").option("path", path)
     .bucketBy(buckets, key).sortBy(key, *then_by).saveAsTable(table))


def fingerprint(settings: Mapping[str, object]) -> str:
    """Short stable hash of the settings a prepared set was built with."""
    text = json.dumps(settings, sort_keys=True, default=str)
    return hashlib.sha256(text.encode("utf-8")).hexdigest()[:16]


def _file_system(spark: SparkSession, path: str):
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location, location.getFileSystem(spark._jsc.hadoopConfiguration())


def is_complete(spark: SparkSession, path: str) -> bool:
    """True when ``path`` was written to the end (its ``_SUCCESS`` marker exists)."""
    marker, files = _file_system(spark, f"{path.rstrip('/')}/_SUCCESS")
    return files.exists(marker)


def _listed(spark: SparkSession, files: Sequence[str]) -> dict[str, tuple[int, int]]:
    """Length and modification time of the files (given as URLs), from one listing of each folder."""
    listed: dict[str, dict[str, tuple[int, int]]] = {}
    found = {}
    for file in files:
        folder, name = unquote(file).rsplit("/", 1)
        if folder not in listed:
            location, system = _file_system(spark, folder)
            listed[folder] = {s.getPath().getName(): (s.getLen(), s.getModificationTime())
                              for s in system.listStatus(location)}
        found[file] = listed[folder][name]
    return found


def _file_digests(df: DataFrame) -> DataFrame:
    """``(file, rows, low, high)``: sums over the hashes of a file's rows, the same in any order."""
    row = F.xxhash64(*[F.to_json(F.struct(c)) if t.startswith("map") else F.col(c) for c, t in df.dtypes])
    return (df.select(F.input_file_name().alias("file"), row.alias("h")).groupBy("file").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("h").bitwiseAND(F.lit((1 << 31) - 1))).alias("low"),
        F.sum(F.shiftrightunsigned("h", 31)).alias("high")))


def content_digest(df: DataFrame, manifest: str) -> str:
    """A hash of the rows of a table, whatever their order or files.

    The digest of each file it is read from is kept in ``manifest``, a folder, with the file's length and
    time, for this way of reading it. Only files that are new or changed are read again; a file
    that was only rewritten with the same rows leaves the digest as it was.
    """
    spark = df.sparkSession
    plan = df._jdf.queryExecution().optimizedPlan().canonicalized().toString()
    reading = hashlib.sha256(plan.encode("utf-8")).hexdigest()[:16]
    files = _listed(spark, df.inputFiles())
    location, system = _file_system(spark, manifest)
    known = {}
    if system.exists(location):
        rows = spark.read.parquet(manifest).where(F.col("reading") == reading).collect()
        known = {(r["file"], r["length"], r["modified"]): (r["rows"], r["low"], r["high"]) for r in rows}
    current = {f: known.get((f, *status)) for f, status in files.items()}
    missing = [f for f, digest in current.items() if digest is None]
    if not files:  # not read from files: all of it is one
        return _digest_of([tuple(r)[1:] for r in _file_digests(df).collect()])
    if missing:
        rows = df if len(missing) == len(files) else _only(df, missing)
        counted = {r["file"]: (r["rows"], r["low"], r["high"]) for r in _file_digests(rows).collect()}
        if "" in counted:  # beyond a shuffle, rows have no file
            return _digest_of([tuple(r)[1:] for r in _file_digests(df).collect()])
        current |= {f: counted.get(f, (0, 0, 0)) for f in missing}
        spark.createDataFrame([(reading, f, *files[f], *current[f]) for f in missing],
                              "reading string, file string, length bigint, modified bigint, rows bigint, low bigint, "
                              "high bigint").coalesce(1).write.mode("append").parquet(manifest)
    return _digest_of(list(current.values()))


def _only(df: DataFrame, files: Sequence[str]) -> DataFrame:
    """The rows read from these files; the others are not opened where the table is a plain scan."""
    try:
        # a local file's path has one slash there and three in its URL
        return df.where(F.col("_metadata.file_path").isin([*files, *(f.replace(":///", ":/", 1) for f in files)]))
    except AnalysisException:
        return df.where(F.input_file_name().isin(list(files)))


def _digest_of(parts: Sequence[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(str(sum(p[i] or 0 for p in parts)) for i in range(3)).encode()).hexdigest()[:32]


def prepare_or_load(spark: SparkSession, path: str, build: Callable[[], DataFrame],
                    settings: Mapping[str, object], key: str | Sequence[str] = "doc_id",
                    num_shards: int = 64, inputs: Mapping[str, DataFrame] | None = None,
                    sizes: Sequence[DataFrame] = ()) -> DataFrame:
    """Load the set prepared with these settings; build and write it first if there is none.

    The folder name carries the fingerprint of the settings and of the rows of ``inputs``, so
    changed settings or inputs never read a stale set, and a write that did not finish is done
    again. Inputs whose files are unchanged are not read to find that out.

    ``num_shards`` files are written, or more, so that a file's task has about ``MAX_SHARD_BYTES`` to read at
    most: the bytes of ``inputs`` are summed for that, or without them those of the built rows. ``sizes`` may
    give other rows to sum instead, such as the part of the inputs that the set is made from.
    """
    if not path:
        raise ValueError("prepare_or_load needs a path")
    root = path.rstrip("/")
    described = dict(settings)
    if inputs:
        described["inputs"] = {name: content_digest(df, f"{root}/manifest") for name, df in inputs.items()}
    target = f"{root}/set-{fingerprint(described)}"
    if not is_complete(spark, target):
        built = build()
        measured = list(sizes) or (list(inputs.values()) if inputs else [built])
        write_shards(built, target, key, shards_at_least(num_shards, measured))
    return spark.read.parquet(target)


def stream_examples(spark: SparkSession, path: str, schema: StructType | str,
                    max_files: int = 1, max_bytes: int | None = None) -> DataFrame:
    """The prepared set as a stream, ``max_files`` files to a micro-batch, or with ``max_bytes`` as many
    as have about these bytes. The latter is for streams whose micro-batches each cost something besides their rows.

    ``path`` is a folder or a single file; a stream can only watch folders, so for a file
    its folder is watched for that name.
    """
    reader = spark.readStream.schema(schema)
    reader = (reader.option("maxFilesPerTrigger", max_files) if max_bytes is None
              else reader.option("maxBytesPerTrigger", max_bytes))
    location, files = _file_system(spark, path)
    if files.exists(location) and files.getFileStatus(location).isFile():
        return (reader.option("pathGlobFilter", location.getName())
                .parquet(location.getParent().toString()))
    return reader.parquet(path)


METRIC_COLUMNS = ("run_id", "step", "metric", "exit_layer", "value")


def write_metrics(df: DataFrame, path: str) -> None:
    """Append metric rows ``(run_id, step, metric, exit_layer, value)``, one folder per run."""
    df.select(*METRIC_COLUMNS).write.mode("append").partitionBy("run_id").parquet(path)


def assign_split(df: DataFrame, key: str, test_frac: float, seed: int,
                 name: str = "split") -> DataFrame:
    """Label a seeded ``test_frac`` of the rows ``test``, the others ``train``."""
    label: Column = F.when(hash_below(seed, key, test_frac), F.lit("test")).otherwise(F.lit("train"))
    return df.withColumn(name, label)


def select_split(df: DataFrame, split: str = "train", key: str | None = None,
                 test_frac: float = 0.0, seed: int = 42) -> DataFrame:
    """Rows of one split. A table without a ``split`` column is split by the hash of ``key``."""
    if "split" not in df.columns:
        if key is None:
            raise ValueError("the table has no split column: give the key to split by")
        df = assign_split(df, key, test_frac, seed)
    return df.where(F.col("split") == split)
