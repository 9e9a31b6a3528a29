"""Near-duplicate groups by SuperMinHash signatures, banding, verification and union-find.

SuperMinHash gives every shingle a pseudo-random permutation of the signature's slots and, at place
``j`` of the permutation, a rank in ``[j, j + 1)``; a slot keeps its smallest rank. Slots of one
element are thus spread without replacement, which lowers the variance against independent hash
functions, and places are visited level by level until every slot holds a rank of an earlier
level: later levels cannot change anything, so long documents stop after the first.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offramp.llm.common import fresh, mix64, shared_count, shingle_set, sieved, stored
from offramp.llm.components import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS = 5
PERCENT = 75
#: 32 bands of 3 slots: a pair at a similarity of 0.75 shares no band once in 4e7 pairs.
BANDS, ROWS = 32, 3
#: Members of a pivot that are held against it, or against what its group has in common, in one go; a
#: pivot with more is copied for each so many.
HUB = 512
#: 64-bit maps of a member's shared elements.
MAPS = 4

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64(0xFFFFFFFF)
#: Shingles of short documents that are hashed together.
_CHUNK = 1 << 18


def super_minhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """Signatures (documents x slots) of non-empty sets of 64-bit hashes; all bits set: empty set."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.full(len(sets) * slots, _EMPTY, np.uint64)
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(sets)), sizes)
    order = None
    for level in range(slots):
        if level == 1:  # only elements of unfinished documents carry their permutation on
            order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32), (len(values), 1))
            order[np.arange(len(values)), first] = 0
            order[:, 0] = first
        draw = mix64(values + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        at = level + (((draw & _LOW) * np.uint64(slots - level)) >> np.uint64(32)).astype(np.int64)
        if level == 0:
            first, slot = at, at
        else:
            here = np.arange(len(values))
            slot = order[here, at].astype(np.int64)
            order[here, at] = order[here, level]
            order[here, level] = slot
        np.minimum.at(out, doc * slots + slot, (np.uint64(level) << np.uint64(32)) | (draw >> np.uint64(32)))
        worst = out.reshape(len(sets), slots).max(axis=1, initial=0)
        open_ = (worst >= np.uint64(level + 1) << np.uint64(32))[doc]
        if not open_.any():
            break
        if not open_.all():
            values, doc = values[open_], doc[open_]
            if level == 0:
                first = first[open_]
            else:
                order = order[open_]
    return out.reshape(len(sets), slots)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per document and band, different between bands."""
    parts = signatures.reshape(len(signatures), bands, rows)
    key = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for r in range(rows):
        key = mix64(key + parts[:, :, r])
    return key.view(np.int64)


def _features(words: int, bands: int, rows: int):
    slots = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.cast(batch.column(1), pa.large_binary())
            start = 0
            while start < len(texts):
                sets, end, held = [], start, 0
                while end < len(texts) and held < _CHUNK:
                    text = texts[end].as_py()
                    sets.append(shingle_set(text or b"", words))
                    held += len(sets[-1])
                    end += 1
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = band_keys(super_minhash([sets[i] for i in full], slots), bands, rows) if full else None
                listed: list = [None] * len(sets)
                classes: list = [None] * len(sets)
                for k, i in enumerate(full):
                    listed[i] = keys[k]
                    classes[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, end - start), batch.column(2).slice(start, end - start), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(classes, pa.binary()), pa.array(listed, pa.list_(pa.int64()))],
                    names=["id", "text_hash", "n", "class", "bands"])
                start = end

    return run


def _compared(words: int):
    """Kernel over ``a, b, deep, left_text, right_text``: the set sizes, the size of the intersection
    and, where ``deep``, the shingles that only one of the two has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 0
        for batch in batches:
            lists: list[list] = [[], [], [], []]
            for i in range(batch.num_rows):
                sets = []
                for side in (0, 1):
                    key = batch.column(side)[i].as_py()
                    if key not in held:
                        if size > _CHUNK:  # pivots come again and again, so the last sets are kept
                            held, size = {}, 0
                        text = batch.column(side + 3)[i].as_py()
                        held[key] = shingle_set(text.encode(), words)
                        size += len(held[key])
                    sets.append(held[key])
                a, b = sets
                lists[0].append(len(a))
                lists[1].append(len(b))
                lists[2].append(shared_count(a, b))
                lists[3].append(np.setxor1d(a, b, assume_unique=True).view(np.int64) if batch.column(2)[i].as_py() else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in lists[:3]), pa.array(lists[3], pa.list_(pa.int64()))],
                names=["a", "b", "n_a", "n_b", "both", "diff"])

    return run


def _may_link(a: Column, b: Column, percent: int) -> Column:
    """Sets whose sizes are too far apart cannot reach the similarity."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _links(tested: DataFrame, percent: int) -> DataFrame:
    return tested.where(100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


def _several(buckets: DataFrame) -> DataFrame:
    """The rows of buckets with at least two members, as a stored table."""
    span = buckets.groupBy("bucket").agg(F.min("v").alias("low"), F.max("v").alias("high")).where("low <> high")
    return stored(buckets.join(span.select("bucket"), "bucket", "left_semi"), "buckets")


def _pivoted(buckets: DataFrame) -> DataFrame:
    """``a, b, n, m, deep``: every member ``b`` beside the most popular one of a bucket, ``a``, once for all
    their buckets; ``deep`` where the pivot has several. Popular is who shares most buckets with most others:
    the text that a group's copies were made from shares more with each than they do among themselves."""
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    fame = buckets.join(sizes, "bucket").groupBy("v").agg(F.sum("size").alias("fame"))
    best = buckets.join(fame, "v").groupBy("bucket").agg(
        F.max(F.struct("fame", -F.col("v"), F.col("v").alias("pivot"), F.col("n").alias("pivot_n"))).alias("m"))
    met = buckets.join(best.select("bucket", F.col("m.pivot").alias("a"), F.col("m.pivot_n").alias("m")), "bucket").where("v <> a")
    met = met.groupBy("a", F.col("v").alias("b")).agg(F.first("n").alias("n"), F.first("m").alias("m"))
    met = stored(met, "met")
    several = met.groupBy("a").agg((F.count(F.lit(1)) > 1).alias("deep"))
    return met.join(several, "a")


def _dealt(rows: DataFrame, *groups: DataFrame) -> list[DataFrame]:
    """``rows`` with a number ``deal`` by which large groups ``a`` fall into parts of about ``HUB`` rows, and
    each of ``groups`` (one row per ``a``) once for every part."""
    parts = rows.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HUB).cast("int").alias("parts"))
    large = parts.where("parts > 1")
    rows = rows.join(large, "a", "left").withColumn(
        "deal", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    return [rows, *(g.join(large, "a", "left").withColumn(
        "deal", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts") for g in groups)]


def _centred(open_: DataFrame) -> DataFrame:
    """``a, b, n, component, diff``: differences to what most of the group hold in place of its pivot. An
    element of the differences of more than half of the members leaves those and enters the others'."""
    sizes = open_.groupBy("a").agg(F.count(F.lit(1)).alias("size"))
    counts = open_.select("a", F.explode("diff").alias("x")).groupBy("a", "x").agg(F.count(F.lit(1)).alias("df"))
    common = counts.where("df > 1").join(sizes, "a").where("2 * df > size").groupBy("a").agg(F.collect_list("x").alias("common"))
    rows, common = _dealt(open_, common)
    rows = rows.join(common, ["a", "deal"], "left")
    turned = F.concat(F.array_except("diff", "common"), F.array_except("common", "diff"))
    return stored(rows.select("a", "b", "n", "component", F.when(F.col("common").isNull(), F.col("diff")).otherwise(turned).alias("diff")), "centred")


def _weighed(centred: DataFrame, percent: int) -> DataFrame:
    """The members with ``size`` of their difference, ``w``, ``outer`` and the group's ``near``.

    Sets s and b are linked if the sets differ in at most ``(100 - percent) / (100 + percent)`` of the sum
    of their sizes. With differences S and B to one common set they differ in |S| + |B| - 2 |S & B|; so with
    ``w = (100 + percent) * |S| - (100 - percent) * |s|`` they are linked just if their w
    add up to no more than ``2 * (100 + percent) * |S & B|``. Thus who has w up to that of the smallest one
    turned negative is linked with that one (``near``), and these links unite all pairs whose w add up to zero or
    less. ``outer`` are the others that ``near`` is not yet united with.
    """
    rows = centred.withColumn("size", F.size("diff").cast("bigint"))
    rows = rows.withColumn("w", (100 + percent) * F.col("size") - (100 - percent) * F.col("n"))
    least = rows.groupBy("a").agg(F.min(F.struct("w", F.col("b").alias("near"), "component")).alias("least"))
    rows, least = _dealt(rows, least)
    return rows.join(least, ["a", "deal"]).select(
        "a", "b", "n", "component", "diff", "size", "w", "least.near", F.col("least.w").alias("least"),
        ((F.col("component") != F.col("least.component")) & (F.col("w") + F.col("least.w") > 0)).alias("outer"))


def _candidates(weighed: DataFrame, percent: int) -> DataFrame:
    """``a, b``: pairs of which one at least is outer, whose differences share an element early enough.

    Of two differences that need k equal elements, the first equal one (rarest first) has at least k - 1 behind
    it on both sides. A member stands under the elements that can be first for some partner; a pair meets where
    the element can be first for both and bit maps of the shared elements leave enough of them possible.
    """
    def needed(w: Column, other: Column) -> Column:
        return F.greatest(F.ceil((w + other) / (2 * (100 + percent))).cast("bigint"), F.lit(1))

    outer = weighed.where("outer").groupBy("a").agg(F.min("w").alias("least_outer"))
    rows, outer = _dealt(weighed, outer)
    rows = rows.join(outer, ["a", "deal"])  # groups without an outer member are done
    most = F.col("size") + 1 - needed(F.col("w"), F.when(F.col("outer"), F.col("least")).otherwise(F.col("least_outer")))
    rows = rows.withColumn("most", most).where("most > 0")
    posts = rows.select("a", "b", "n", "component", "size", "w", "outer", "most", F.explode("diff").alias("x"))
    counts = posts.groupBy("a", "x").agg(F.count(F.lit(1)).alias("df"), F.max("outer").alias("any")).where("df > 1")
    posts = posts.join(counts, ["a", "x"])
    by = Window.partitionBy("a", "b")
    shared = F.count(F.lit(1)).over(by)  # elements that somebody else has too; the others come first
    posts = posts.withColumns({"rank": F.col("size") - shared + F.row_number().over(by.orderBy("df", "x")), "shared": shared, **{
        f"map{k}": F.bit_or(F.when(F.pmod(F.shiftright("x", 6), F.lit(MAPS)) == k, F.expr("shiftleft(1L, cast(x & 63 as int))")).otherwise(
            F.lit(0).cast("bigint"))).over(by) for k in range(MAPS)}})
    posts = stored(posts.where("rank <= most and any").drop("df", "any", "most"), "posts")
    left = posts.where("outer").select("a", "x", *(F.col(c).alias(f"{c}_l") for c in posts.columns if c not in ("a", "x", "outer")))
    behind = F.least(F.col("size") - F.col("rank"), F.col("size_l") - F.col("rank_l")) + 1

    def possible(mine: str, other: str) -> Column:
        """Shared elements less one for every bit that only this side's map has set."""
        only = (F.bit_count(F.col(f"map{k}{mine}").bitwiseAND(F.bitwise_not(F.col(f"map{k}{other}")))) for k in range(MAPS))
        return F.col(f"shared{mine}") - sum(only, F.lit(0))

    met = left.join(posts, ["a", "x"]).where(
        (F.col("component") != F.col("component_l")) & (~F.col("outer") | (F.col("b_l") < F.col("b")))
        & (2 * (100 + percent) * F.least(behind, possible("", "_l"), possible("_l", "")) >= F.col("w") + F.col("w_l")) & _may_link(F.col("n"), F.col("n_l"), percent))
    return met.select(*_pair(F.col("b_l"), F.col("b"))).distinct()


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS,
                    percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: ``key, n_shingles, component_id, kept, class_id, text_hash``.

    * Rows with the same shingle set are one class and enter the search once (``class_id`` is the
      smallest key of the class), so groups of copies cost nothing.
    * Classes meet in the buckets of equal bands. Every member of a bucket is held against one
      pivot, on full shingle sets taken from the texts, and confirmed links are united.
    * Groups of a pivot whose members still lie in different components go on, as differences to
      what most of the group hold (``_centred``). Whether two members are linked depends on the sizes
      of their differences and on what these share: many links follow from the sizes alone
      (``_weighed``), and others need a shared element early among the rarest (``_candidates``). Copies with
      edits of their own share none, so they meet nobody; the pairs that meet are confirmed on full sets. Two
      rounds of comparison do for groups of any size, and no link is lost that the bands find.

    Null, empty or blank text: no shingle, linked with nothing. A null key takes part through its
    text and is kept only if no row of its group has a key. Rows that share a key are looked at one
    by one and meet in a component when their texts do (repeated rows: the same values each). An
    empty table gives an empty result. Other columns are not read.
    """
    given = docs.select(docs[key].cast("bigint").alias("id"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("text_hash"))
    features = stored(given.mapInArrow(
        _features(words, bands, rows), "id bigint, text_hash bigint, n bigint, class binary, bands array<bigint>"), "shingles")
    classes = features.where("class is not null and id is not null").groupBy("class").agg(
        F.min("id").alias("v"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = stored(classes, "classes")
    buckets = _several(classes.select("v", "n", F.explode("bands").alias("bucket")))
    members = stored(buckets.select(F.col("v").alias("text_id")).distinct(), "members")
    texts = given.where("id is not null").select(F.col("id").alias("text_id"), "text")
    texts = stored(sieved(texts, "text_id", members).join(members, "text_id"), "texts")
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def compare(pairs: DataFrame) -> DataFrame:
        """Hold the sets of ``a, b, deep`` against each other."""
        lefts = pairs.select("a").distinct().join(texts.withColumnsRenamed({"text_id": "a", "text": "left_text"}), "a")
        pairs, lefts = _dealt(pairs, lefts)
        # pairs are small beside their sets, so they are dealt by number, not by size
        pairs = pairs.repartition(tasks, "a", "deal").sortWithinPartitions("a", "b")
        met = pairs.join(texts.withColumnsRenamed({"text_id": "b", "text": "right_text"}), "b").join(lefts, ["a", "deal"])
        return stored(met.select("a", "b", "deep", "left_text", "right_text").mapInArrow(
            _compared(words), "a bigint, b bigint, n_a bigint, n_b bigint, both bigint, diff array<bigint>"), "compared")

    held = compare(stored(_pivoted(buckets), "pivots").where(F.col("deep") | _may_link(F.col("n"), F.col("m"), percent)))
    links = _links(held, percent)
    found = stored(components(links), "found")
    own = found.withColumnsRenamed({"node": "a", "component": "main"})
    named = held.where("diff is not null").join(found.withColumnRenamed("node", "b"), "b", "left").join(own, "a", "left").withColumns(
        {"component": F.coalesce("component", "b"), "main": F.coalesce("main", "a")})
    several = named.where("component <> main").select("a").distinct()
    open_ = named.join(several, "a", "left_semi")
    pivots = open_.groupBy("a").agg(F.first("n_a").alias("n"), F.first("main").alias("component")).select(
        "a", F.col("a").alias("b"), "n", "component", F.array().cast("array<bigint>").alias("diff"))
    open_ = stored(open_.select("a", "b", F.col("n_b").alias("n"), "component", "diff").unionByName(pivots), "open")
    if not open_.isEmpty():
        weighed = stored(_weighed(_centred(open_), percent), "weighed")
        sure = weighed.where("w + least <= 0 and b <> near").select(*_pair(F.col("near"), F.col("b")))
        pairs = stored(_candidates(weighed, percent), "candidates")
        tested = compare(pairs.withColumn("deep", F.lit(False)))
        found = components(links.unionByName(sure).unionByName(_links(tested, percent)))
    rows_ = features.join(classes.select(F.col("class").alias("c"), "v"), F.col("class") == F.col("c"), "left")
    rows_ = rows_.join(found, F.col("v") == F.col("node"), "left")
    component = F.coalesce("component", "v", "id")
    return rows_.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"),
                        component.eqNullSafe(F.col("id")).alias("kept"), F.coalesce("v", "id").alias("class_id"), "text_hash")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The documents with one row of each group left: the one with the smallest key, all columns.

    Of rows that repeat both key and text one stays. Rows without a key stay unless a row of their
    group has one.
    """
    judged = near_duplicates(docs, key, text, **settings)
    id_, none, hash_, turn = (fresh(docs, base=b) for b in ("_kept", "_none", "_hash", "_turn"))
    met = lambda id_of, hash_of: {id_: F.coalesce(id_of, F.lit(0).cast("bigint")), none: id_of.isNull(), hash_: hash_of}
    kept = judged.where("kept").withColumns(met(F.col(key), F.col("text_hash"))).select(id_, none, hash_).distinct()
    # the columns of the join are those of the window too, so the texts are shuffled once
    left = docs.withColumns(met(docs[key].cast("bigint"), F.xxhash64(docs[text]))).join(kept, [id_, none, hash_], "left_semi")
    by = Window.partitionBy(id_, none, hash_, key).orderBy(F.lit(0))
    left = left.withColumn(turn, F.row_number().over(by)).where(F.col(key).isNull() | (F.col(turn) == 1))
    return left.select(*docs.columns)
