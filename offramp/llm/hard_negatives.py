"""Hard negatives by segment summaries.

Every vector is stored with the mean and the deviation of its segments, in long segments and in short
ones. Within a segment of ``n`` components, the product of two vectors is ``n`` times the product of
their means, give or take ``n`` times the product of their deviations; summed over the segments
this bounds a score from above and below. Pairs whose bounds cannot matter are left out at the long
segments, of the others more at the short ones, and only the rest are scored exactly, in whole numbers.

Anchors and rows meet as blocks: a block of anchors and a block of rows go to one task, which
returns the best few of its rows for each of its anchors.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offramp.llm.common import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Components of a long and of a short segment.
SEGMENTS = (16, 4)
#: Rows of a block at least (so that small tables spread) and at most, and anchors of a block at most.
LEAST_ROWS, MOST_ROWS, MOST_ANCHORS = 4096, 65_536, 65_536
#: Anchors and rows whose bounds are held at a time inside a task.
TILE = (1024, 4096)
#: Below this share, pairs are followed one by one, not as a whole tile.
SPARSE = 0.05
#: Bounds are computed in single precision: room for rounding, as a share of the norms' product.
ROOM = 1e-5
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


# -- vectors and their summaries ------------------------------------------------------------------
def _summarised(dim: int, kind: str):
    """Whole-number vectors as bytes, padded with zeros to ``dim``, and their segments' summary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("v")
            x = np.zeros((len(values), dim), np.int64)
            sizes = values.value_lengths().to_numpy()
            row = np.repeat(np.arange(len(values)), sizes)
            column = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            x[row, column] = values.flatten().to_numpy()
            parts = []
            for width in SEGMENTS:
                segments = x.reshape(len(x), -1, width).astype(np.float64)
                parts += [segments.mean(2), segments.std(2)]
            parts.append(np.linalg.norm(x.astype(np.float64), axis=1)[:, None])
            summary = np.hstack(parts).astype("<f4")
            columns = [_bytes(x.astype(kind)), _bytes(summary)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("id", "label", "anchor")), *columns],
                                             names=["id", "label", "anchor", "x", "summary"])

    return run


def _bytes(rows: np.ndarray) -> pa.Array:
    size = rows.shape[1] * rows.itemsize
    bounds = np.arange(0, (len(rows) + 1) * size, max(size, 1), dtype=np.int64)[:len(rows) + 1] if size else np.zeros(
        len(rows) + 1, np.int64)
    raw = np.ascontiguousarray(rows).tobytes()
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(bounds), pa.py_buffer(raw)]).cast(
        pa.binary())


class _Vectors:
    """Some vectors with what the bounds need."""

    def __init__(self, table: pa.Table, dim: int, kind: str, exact: type):
        x = np.frombuffer(b"".join(table.column("x").to_pylist()), kind).reshape(-1, dim)
        summary = np.frombuffer(b"".join(table.column("summary").to_pylist()), "<f4").reshape(len(x), -1)
        self.x = x.astype(exact)
        self.levels, at = [], 0
        for width in SEGMENTS:
            n, root = dim // width, np.float32(np.sqrt(width))
            self.levels.append((summary[:, at:at + n] * root, summary[:, at + n:at + 2 * n] * root))
            at += 2 * n
        self.norm = summary[:, at]

    def part(self, which) -> _Vectors:
        out = object.__new__(_Vectors)
        out.x, out.norm = self.x[which], self.norm[which]
        out.levels = [(m[which], d[which]) for m, d in self.levels]
        return out


def pairs_within(q: _Vectors, x: _Vectors, low: np.ndarray, high: np.ndarray, allowed: np.ndarray):
    """All pairs ``(i, j, score)`` of ``q[i]`` and ``x[j]`` with ``low[i] <= score <= high[i]`` among the
    ``allowed`` ones (a matrix)."""
    keep, pairs = allowed, None
    for (qm, qd), (xm, xd) in zip(q.levels, x.levels):
        if pairs is None:
            centre, spread = qm @ xm.T, qd @ xd.T + ROOM * np.outer(q.norm, x.norm)
            keep = keep & (centre + spread >= low[:, None]) & (centre - spread <= high[:, None])
            if keep.mean() < SPARSE:
                pairs = np.nonzero(keep)
        else:
            i, j = pairs
            centre = np.einsum("nd,nd->n", qm[i], xm[j])
            spread = np.einsum("nd,nd->n", qd[i], xd[j]) + ROOM * q.norm[i] * x.norm[j]
            kept = (centre + spread >= low[i]) & (centre - spread <= high[i])
            pairs = i[kept], j[kept]
    if pairs is None:
        scores = q.x @ x.x.T
        i, j = np.nonzero(keep & (scores >= low[:, None]) & (scores <= high[:, None]))
        return i, j, scores[i, j].astype(np.int64)
    i, j = pairs
    scores = np.concatenate([np.einsum("nd,nd->n", q.x[i[a:a + 65_536]], x.x[j[a:a + 65_536]])
                             for a in range(0, max(len(i), 1), 65_536)]).astype(np.int64)
    kept = (scores >= low[i]) & (scores <= high[i])
    return i[kept], j[kept], scores[kept]


class _Best:
    """The best ``k`` rows of each slot so far: higher score first, then smaller id."""

    def __init__(self, slots: int, k: int, lowest: np.ndarray):
        self.k, self.lowest = k, lowest
        self.slot = self.score = self.id = np.zeros(0, np.int64)
        self.slots = slots

    def add(self, slot, score, ident) -> None:
        slot, score, ident = (np.concatenate(p) for p in ((self.slot, slot), (self.score, score), (self.id, ident)))
        order = np.lexsort((ident, -score, slot))
        slot, score, ident = slot[order], score[order], ident[order]
        first = np.searchsorted(slot, slot, "left")
        best = np.arange(len(slot)) - first < self.k
        self.slot, self.score, self.id = slot[best], score[best], ident[best]
        last = np.searchsorted(self.slot, np.arange(self.slots), "right")
        full = np.bincount(self.slot, minlength=self.slots) == self.k
        self.lowest[full] = self.score[last[full] - 1]


def _steps(n: int, size: int) -> Iterator[slice]:
    """Row ranges of a block: small ones first, whose best rows sharpen the limits for the rest."""
    at, step = 0, min(size, 256)
    while at < n:
        yield slice(at, min(n, at + step))
        at, step = at + step, min(size, step * 4)


def _positives(k: int, dim: int, kind: str, exact: type):
    """The best ``k`` other rows of the anchor's label in this block of rows."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if anchors.num_rows and rows.num_rows:
            q_all, x_all = _Vectors(anchors, dim, kind, exact), _Vectors(rows, dim, kind, exact)
            q_label, x_label = anchors["label"].to_numpy(), rows["label"].to_numpy()
            q_row, x_row, x_id = anchors["row"].to_numpy(), rows["row"].to_numpy(), rows["id"].to_numpy()
            for label in np.unique(q_label):
                theirs = np.flatnonzero(x_label == label)
                mine = np.flatnonzero(q_label == label)
                for a in range(0, len(mine), TILE[0]):
                    chosen = mine[a:a + TILE[0]]
                    q = q_all.part(chosen)
                    best = _Best(len(chosen), k, np.full(len(chosen), _LEAST))
                    for step in _steps(len(theirs), TILE[1]):
                        some = theirs[step]
                        allowed = q_row[chosen][:, None] != x_row[some]
                        i, j, score = pairs_within(q, x_all.part(some), best.lowest,
                                                   np.full(len(chosen), _MOST), allowed)
                        best.add(i, score, x_id[some][j])
                    found.append((chosen[best.slot], best.id, best.score))
        at, ident, score = (np.concatenate(p) for p in zip(*found)) if found else [np.zeros(0, np.int64)] * 3
        return pa.table([anchors["row"].take(pa.array(at)), anchors["id"].take(pa.array(at)), pa.array(ident),
                         pa.array(score)], names=["row", "anchor_id", "positive_id", "positive_score"])

    return run


def _negatives(k: int, low: int, high: int, dim: int, kind: str, exact: type):
    """For each positive of an anchor, the best ``k`` rows of other labels in the positive's range."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if anchors.num_rows and rows.num_rows:
            q_all, x_all = _Vectors(anchors, dim, kind, exact), _Vectors(rows, dim, kind, exact)
            q_label, x_label, x_id = anchors["label"].to_numpy(), rows["label"].to_numpy(), rows["id"].to_numpy()
            positives = [np.array(p, np.int64) for p in anchors["scores"].to_pylist()]
            width = max(map(len, positives))
            for a in range(0, len(positives), TILE[0]):
                mine = positives[a:a + TILE[0]]
                q = q_all.part(slice(a, a + len(mine)))
                # one slot for each anchor and positive; slots without a positive have an empty range
                least = np.full((len(mine), width), _MOST)
                most = np.full((len(mine), width), _LEAST)
                for i, scores in enumerate(mine):
                    hundreds, rest = scores // 100, scores % 100
                    least[i, :len(scores)] = low * hundreds - (-low * rest // 100)
                    most[i, :len(scores)] = high * hundreds + high * rest // 100
                best = _Best(least.size, k, least.ravel().copy())
                open_ = least <= most
                for step in _steps(len(x_id), TILE[1]):
                    limit = np.where(open_, best.lowest.reshape(least.shape), _MOST)
                    allowed = q_label[a:a + len(mine), None] != x_label[step]
                    i, j, score = pairs_within(q, x_all.part(step), limit.min(1),
                                               np.where(open_, most, _LEAST).max(1), allowed)
                    for p in range(width):
                        fits = (score >= limit[i, p]) & (score <= most[i, p])
                        best.add(i[fits] * width + p, score[fits], x_id[step][j[fits]])
                found.append((a + best.slot // width, best.slot % width, best.id, best.score))
        at, p, ident, score = (np.concatenate(c) for c in zip(*found)) if found else [np.zeros(0, np.int64)] * 4
        return pa.table([anchors["row"].take(pa.array(at)), pa.array(p.astype(np.int32)), pa.array(ident),
                         pa.array(score)], names=["row", "place", "negative_id", "negative_score"])

    return run


# -- the operator ---------------------------------------------------------------------------------
def mine_hard_negatives(vectors: DataFrame, anchor: Column | str, key: str = "vec_id", vector: str = "embedding",
                        label: str = "label", scale: int = 256, positives: int = 5, negatives: int = 3,
                        low: int = 50, high: int = 95) -> DataFrame:
    """Rows ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become ``floor(scale * x)``; a score is the inner product of two such vectors.
    Higher scores come first, ties by smaller id. The rows for which ``anchor`` holds are anchors; an
    anchor's positives are its first ``positives`` other rows of the same label. For each of them the first
    ``negatives`` rows of other labels are returned whose score is ``low`` to ``high`` per cent of the
    positive's (none if that is negative).

    Rows with a null id, label or vector or a null or non-finite component take no part. Rows
    equal in id, label and vector are one row; those that share only the id are different rows. Shorter
    vectors count as padded with zeros. An empty table gives no rows. Other columns are not read.
    Scores have to fit 64 bits, else ``ValueError`` is raised. ``key`` and ``label`` are whole numbers.
    """
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    taken = (vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & usable)
             .select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"),
                     F.coalesce(F.expr(anchor) if isinstance(anchor, str) else anchor, F.lit(False)).alias("anchor"),
                     F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("v"))
             .dropDuplicates(["id", "label", "v"]))
    taken = stored(taken, "negatives-vectors")
    shape = taken.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("anchor").cast("bigint")).alias("anchors"),
                      F.max(F.size("v")).alias("dim"),
                      F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("top"),
                      F.min(F.array_min("v")).alias("least")).first()
    top = max(shape["top"] or 0, -(shape["least"] or 0))
    largest = (shape["dim"] or 0) * top * top
    dim = -(-max(shape["dim"] or 0, 1) // SEGMENTS[0]) * SEGMENTS[0]
    if largest >= 1 << 63:
        raise ValueError("scores do not fit 64 bits")
    kind = next(k for k, bits in (("<i2", 15), ("<i4", 31), ("<i8", 63)) if top < 1 << bits)
    exact = np.float64 if largest < 1 << 53 else np.int64

    rows = stored(taken.mapInArrow(_summarised(dim, kind), "id bigint, label bigint, anchor boolean, x binary, "
                                                           "summary binary")
                  .withColumn("row", F.xxhash64("id", "label", "x")), "negatives-summaries")
    block = min(MOST_ROWS, max(LEAST_ROWS, shape["n"] // 64))
    row_blocks, anchor_blocks = shape["n"] // block + 1, (shape["anchors"] or 0) // MOST_ANCHORS + 1
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))).alias("anchor_block")
    row_block = F.pmod(F.col("row"), F.lit(row_blocks)).alias("row_block")
    dealt = rows.select("id", "label", "x", "summary", "row", everywhere, row_block)

    def meet(anchors: DataFrame, kernel, schema: str) -> DataFrame:
        spread = anchors.select(  # new names for both sides' columns: both come from the same table
            *[F.col(c).alias(c) for c in anchors.columns], F.pmod(F.shiftright("row", 20), F.lit(anchor_blocks)).cast("int").alias("anchor_block"),
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(row_blocks - 1).cast("bigint"))).alias("row_block"))
        return (spread.groupBy("anchor_block", "row_block")
                .cogroup(dealt.groupBy("anchor_block", "row_block")).applyInArrow(kernel, schema))

    anchors = rows.where("anchor").select("id", "label", "x", "summary", "row")
    near = meet(anchors, _positives(positives, dim, kind, exact),
                "row bigint, anchor_id bigint, positive_id bigint, positive_score bigint")
    best = Window.partitionBy("row").orderBy(F.col("positive_score").desc(), "positive_id")
    near = stored(near.withColumn("place", F.row_number().over(best) - 1).where(F.col("place") < positives),
                  "negatives-positives")
    ranges = near.groupBy("row").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "positive_score"))),
                    lambda s: s["positive_score"]).alias("scores"))
    far = meet(anchors.join(ranges, "row"), _negatives(negatives, low, high, dim, kind, exact),
               "row bigint, place int, negative_id bigint, negative_score bigint")
    best = Window.partitionBy("row", "place").orderBy(F.col("negative_score").desc(), "negative_id")
    far = far.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return far.join(near, ["row", "place"]).select("anchor_id", "positive_id", "rank", "negative_id",
                                                  "positive_score", "negative_score")


def hard_negative_query(embeddings: DataFrame) -> DataFrame:
    """Anchors are the ids divisible by 50; where the id is divisible by 7 the label is shifted first."""
    label = F.col("label").cast("bigint")
    shifted = embeddings.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10)
                                .otherwise(label).alias("label"))
    return mine_hard_negatives(shifted, F.col("vec_id") % 50 == 0)
