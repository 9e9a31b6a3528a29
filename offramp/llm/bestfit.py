"""Bulk-synchronous best-fit packing of documents into sequences of one size.

Documents are tokenized once, cut into pieces only where they are longer than a sequence, and stored
with their length and their place among the equally long pieces of their input partition. Sorted by
length, the pieces of one length are a run of consecutive ranks, and so are the gaps of the
open sequences: at most one run per possible length, whatever the number of documents. A
superstep sweeps both sorted lists together: every piece asks for its successor, the smallest gap
that holds it; where more ask than there are gaps, the lower ranks win and the others go on to the
next larger gap. The gaps are updated, and the next superstep begins. Each piece then finds its
sequence by its length and rank.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offramp.llm.common import stored
from offramp.llm.tokens import batch_encoder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEQUENCE = 2048
END = 0
#: The sequences still needed are opened in so many parts.
OPENED = 4

PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"


def _cut(path: str, size: int, end: int):
    """Pieces of every text with ``unit`` (the input partition) and ``place`` (rank among the
    pieces of the same length in it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = batch_encoder(path)
        unit = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            for first, ids, bounds in encode(batch.column(1)):
                totals = np.diff(bounds) + 1
                counts = -(-totals // size)
                text = np.repeat(np.arange(len(totals)), counts)
                piece = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = piece * size
                length = np.minimum(totals[text] - start, size)
                wide = np.empty(int(totals.sum()), "<u4")  # every text's ids and the end token
                ends = np.cumsum(totals)
                inner = np.ones(len(wide), bool)
                inner[ends - 1] = False
                wide[inner] = ids[bounds[0]:bounds[-1]]
                wide[ends - 1] = end
                at = (ends - totals)[text] + start
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(at.tolist(), (at + length).tolist())]
                order = np.argsort(length, kind="stable")
                values, begins, many = np.unique(length[order], return_index=True, return_counts=True)
                place = np.empty(len(length), np.int64)
                place[order] = np.arange(len(order)) - np.repeat(begins, many) + np.repeat(seen[values], many)
                seen[values] += many
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(first + text)), pa.array(piece, pa.int32()), pa.array(start),
                     pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(text), unit)), pa.array(place)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "unit", "place"])

    return run


def sweep(docs: Mapping[int, tuple[int, int]], gaps: dict[int, list[tuple[int, int]]]):
    """One superstep. ``docs``: length -> (first rank, count). ``gaps``: free tokens -> runs of
    sequences ``(first, count)``.

    Returns the placements ``(length, first rank, count, first sequence, free tokens before)``: going
    down the lengths, the gaps passed are stacked, so the top is always the successor.
    """
    placed, stack, waiting = [], [], sorted(gaps, reverse=True)
    at = 0
    for length in sorted(docs, reverse=True):
        while at < len(waiting) and waiting[at] >= length:
            stack += [(waiting[at], *run) for run in reversed(gaps[waiting[at]])]
            at += 1
        rank, count = docs[length]
        while count and stack:
            free, first, many = stack.pop()
            n = min(count, many)
            placed.append((length, rank, n, first, free))
            rank, count = rank + n, count - n
            if n < many:
                stack.append((free, first + n, many - n))
    return placed


def plan_sequences(counts: Mapping[int, int], size: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Placements ``(length, first rank, count, first sequence, offset)`` of ``counts[length]`` pieces of
    each length, and the number of sequences.

    When no gap holds any remaining piece, a part of the sequences that the remaining tokens need
    at least is opened; opened in parts, the gaps meet longer pieces before shorter ones.
    """
    docs = {length: (0, n) for length, n in counts.items() if n}
    gaps: dict[int, list[tuple[int, int]]] = {}
    plan, opened = [], 0
    while docs:
        placed = sweep(docs, gaps)
        if not placed:
            need = -(-sum(length * n for length, (_, n) in docs.items()) // (OPENED * size))
            gaps.setdefault(size, []).append((opened, need))
            opened += need
            continue
        taken: dict[int, list[tuple[int, int]]] = {}
        for length, rank, n, first, free in placed:
            plan.append((length, rank, n, first, size - free))
            taken.setdefault(free, []).append((first, n))
            at, count = docs[length]
            if count == n:
                del docs[length]
            else:
                docs[length] = (rank + n, count - n)
        gaps = _without(gaps, taken)
        for length, _, n, first, free in placed:
            if free > length:
                gaps.setdefault(free - length, []).append((first, n))
        gaps = {free: _joined(runs) for free, runs in gaps.items()}
    return plan, opened


def _joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of sequences in order, neighbours joined."""
    out: list[tuple[int, int]] = []
    for first, n in sorted(runs):
        if out and sum(out[-1]) == first:
            out[-1] = (out[-1][0], out[-1][1] + n)
        else:
            out.append((first, n))
    return out


def _without(gaps, taken):
    """The gap runs less the taken ones (each of them within one run)."""
    left = {}
    for free, runs in gaps.items():
        gone = sorted(taken.get(free, ()))
        kept, at = [], 0
        for first, n in runs:
            end = first + n
            while at < len(gone) and gone[at][0] < end:
                if gone[at][0] > first:
                    kept.append((first, gone[at][0] - first))
                first = sum(gone[at])
                at += 1
            if first < end:
                kept.append((first, end - first))
        if kept:
            left[free] = kept
    return left


def _placed(plan):
    """Look up sequence and offset by length and rank."""
    rows = np.array(sorted(plan), np.int64).reshape(-1, 5)
    lengths, ranks, _, firsts, offsets = rows.T
    edges = np.searchsorted(lengths, np.arange(int(lengths.max(initial=0)) + 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            order = np.lexsort((rank, length))
            at = np.empty(len(order), np.int64)
            values, begins, many = np.unique(length[order], return_index=True, return_counts=True)
            for v, b, m in zip(values.tolist(), begins.tolist(), many.tolist()):
                low, high = edges[v], edges[v + 1]
                at[order[b:b + m]] = low + np.searchsorted(ranks[low:high], rank[order[b:b + m]], "right") - 1
            columns = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(firsts[at] + rank - ranks[at]), pa.array(offsets[at])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack_best_fit(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text",
                  size: int = SEQUENCE, end: int = END) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its ids and ``end``; only documents longer than ``size`` are cut, into pieces of
    ``size`` and a last one. ``tokenizer`` is a file every executor can read. Texts are read once
    and never shuffled; a piece travels once, as some 60 bytes. The driver holds the number of
    pieces of each length (``size`` numbers) and the placements made of them, whatever the input.

    Null or empty text is the end token alone. Null or repeated keys and repeated rows are
    documents of their own. An empty table gives no pieces. Other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    given = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    pieces = stored(given.mapInArrow(_cut(tokenizer, size, end),
                                     f"doc_id {kind}, {PIECES}, unit bigint, place bigint"), "bestfit-pieces")
    runs = pieces.groupBy("unit", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    runs = stored(runs.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0))), "bestfit-runs")
    counts = {r["length"]: r["n"] for r in runs.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan, _ = plan_sequences(counts, size)
    ranked = (pieces.join(runs.select("unit", "length", "earlier"), ["unit", "length"])
              .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("earlier") + F.col("place")).alias("rank")))
    return ranked.mapInArrow(_placed(plan), f"doc_id {kind}, {PIECES}, sequence_id bigint, offset bigint")
