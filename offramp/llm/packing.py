"""Packing documents into windows of several context sizes.

Tiers are powers of two up to the longest window. A document's full longest windows are cut off
first; what is left is routed to the smallest tier that holds it. Tiers are packed from the longest
down: a document opens a window of its tier, the gap is filled with the best fitting documents of the
shorter tiers, and the rest of a gap with the head of one more document, whose tail goes back to the
tier of its length. So all windows but the last of a packing unit are exactly full. Windows are
then dealt out to step groups of equal token counts.
"""

from __future__ import annotations

import heapq
import sys
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offramp.llm.tokens import batch_encoder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 4096
TIERS = (512, 1024, 2048, 4096)
EOS = 2
#: Characters of text that meet in one packing unit, on average (about half as many tokens).
UNIT_CHARS = 2_000_000
#: Tokens of a step group.
STEP_TOKENS = 65_536

PIECES = ("doc_id {key}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
          "offset bigint, window bigint, step_id bigint")

def crc_of_ids(ids: bytes) -> int:
    """CRC-32 of the ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes())


def _tokenized(path: str, window: int, eos: int):
    end = np.array([eos], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = batch_encoder(path)
        names = ["key", "unit", "text_hash", "start", "doc_tokens", "length", "crc", "ids"]
        kinds = [None, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

        def batch_of(source, at, columns):
            arrays = [source.column(i).take(pa.array(at, pa.int64())) for i in range(3)]
            arrays += [pa.array(c, t) for c, t in zip(columns, kinds[3:])]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            at, columns, held = [], [[] for _ in range(5)], 0
            texts = ((first + i, found[bounds[i]:bounds[i + 1]].tobytes())
                     for first, found, bounds in encode(batch.column(3)) for i in range(len(bounds) - 1))
            for i, ids in texts:
                ids += end
                n = len(ids) // 2
                for start in range(0, n, window):
                    part = ids[2 * start:2 * (start + window)]
                    full = len(part) == 2 * window
                    at.append(i)
                    for column, value in zip(columns, (start, n, len(part) // 2, crc_of_ids(part) if full else None,
                                                       None if full else part)):
                        column.append(value)
                    held += 0 if full else len(part)
                if held > 1 << 22 or len(at) > 1 << 14:
                    yield batch_of(batch, at, columns)
                    at, columns, held = [], [[] for _ in range(5)], 0
            if at:
                yield batch_of(batch, at, columns)
        batch = texts = None
        pa.default_memory_pool().release_unused()  # the worker lives on beside later stages

    return run


def plan_unit(lengths: Sequence[int], tiers: Sequence[int] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows ``(size, [(document, start, length), ...])`` of documents shorter than the last tier.

    Every window but the last holds exactly its size.
    """
    pools: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}  # (length, document, start), sorted

    def tier(n: int) -> int:
        return next(t for t in tiers if n <= t)

    for length, doc in sorted((n, i) for i, n in enumerate(lengths) if n > 0):
        pools[tier(length)].append((length, doc, 0))

    def fitting(gap: int, below: int):
        """The longest part of the tiers up to ``below`` that fits the gap."""
        for t in reversed(tiers):
            if t <= below and pools[t] and (at := bisect_right(pools[t], (gap, 1 << 62, 0))):
                return pools[t].pop(at - 1)
        return None

    def shortest(above: int, below: int):
        """The shortest part longer than a gap, to be cut."""
        for t in tiers:
            if t <= below and (at := bisect_right(pools[t], (above, 1 << 62, 0))) < len(pools[t]):
                return pools[t].pop(at)
        return None

    windows = []
    for size in reversed(tiers):
        pool = pools[size]
        while pool:
            length, doc, start = pool.pop()
            parts, gap = [(doc, start, length)], size - length
            while gap:
                part = fitting(gap, size)
                if part is None:
                    part = shortest(gap, size)
                    if part is None:
                        break
                    rest = (part[0] - gap, part[1], part[2] + gap)
                    insort(pools[tier(rest[0])], rest)
                    part = (gap, part[1], part[2])
                parts.append((part[1], part[2], part[0]))
                gap -= part[0]
            windows.append((size, parts))
    # what a tier could not fill is joined: at the end at most the last window has a gap
    full = [w for w in windows if sum(p[2] for p in w[1]) == w[0]]
    loose = [p for w in windows if sum(p[2] for p in w[1]) < w[0] for p in w[1]]
    top, current, used = tiers[-1], [], 0
    for doc, start, length in loose:
        while length:
            take = min(length, top - used)
            current.append((doc, start, take))
            start, length, used = start + take, length - take, used + take
            if used == top:
                full.append((top, current))
                current, used = [], 0
    if current:
        full.append((top, current))
    return full


def balanced_steps(sizes: Sequence[int], step_tokens: int) -> list[int]:
    """A step group for every window: longest first, always into the emptiest group."""
    groups = max(1, -(-sum(sizes) // step_tokens))
    heap = [(0, g) for g in range(groups)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        held, group = heapq.heappop(heap)
        out[i] = group
        heapq.heappush(heap, (held + sizes[i], group))
    return out


def _packed(tiers: Sequence[int], step_tokens: int):
    window = tiers[-1]

    def run(group: pa.Table) -> pa.Table:
        order = pc.sort_indices(group, sort_keys=[(n, "ascending") for n in ("key", "text_hash", "start")])
        group = group.take(order)
        rows = group.select(["start", "length", "crc", "ids"]).to_pydict()
        starts, lengths, crcs, ids = (rows[n] for n in ("start", "length", "crc", "ids"))
        short = [i for i in range(len(starts)) if crcs[i] is None]
        windows = [(window, [(i, 0, window)]) for i in range(len(starts)) if crcs[i] is not None]
        windows += [(size, [(short[d], s, n) for d, s, n in parts])
                    for size, parts in plan_unit([lengths[i] for i in short], tiers)]
        steps = balanced_steps([size for size, _ in windows], step_tokens)
        first = group.column("unit")[0].as_py() << 32
        out = [[] for _ in range(8)]
        for number, (size, parts) in enumerate(windows):
            offset = 0
            for row, start, length in parts:
                crc = crcs[row] if crcs[row] is not None else crc_of_ids(ids[row][2 * start:2 * (start + length)])
                for column, value in zip(out, (row, starts[row] + start, length, crc, first + number, offset, size,
                                               first + steps[number])):
                    column.append(value)
                offset += length
        at = pa.array(out[0], pa.int64())
        columns = [pa.array(c, pa.int64()) for c in out[1:]]
        return pa.table([group.column("key").take(at), *columns[:3], group.column("doc_tokens").take(at), *columns[3:]],
                        names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
                               "window", "step_id"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text",
                   tiers: Sequence[int] = TIERS, eos: int = EOS, step_tokens: int = STEP_TOKENS,
                   unit_chars: int = UNIT_CHARS) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window,
    step_id``. ``tokenizer`` is a file every executor can read.

    Texts are read and tokenized once and not shuffled; what is left of a document after its full
    windows travels as 2-byte ids to a packing unit, full windows as counts only. The number of units
    follows the characters of the table, so a unit stays at some 1,000 documents whatever the
    size; units are drawn by key and text, and no document brings more than a window of ids. The
    token limit of a unit's padding is one window.

    Null or empty text is the end token alone. Null or repeated keys and repeated rows are documents
    of their own, each packed in full. An empty table gives no pieces. Other columns are not read.
    """
    window = max(tiers)
    chars = docs.agg(F.sum(F.length(docs[text]).cast("bigint") + 16)).first()[0] or 0
    units = chars // unit_chars + 1
    text_hash = F.xxhash64(docs[text])
    kind = docs.schema[key].dataType.simpleString()
    given = docs.select(docs[key].alias("key"), F.pmod(F.xxhash64(docs[key], text_hash), F.lit(units)).alias("unit"),
                        text_hash.alias("text_hash"), docs[text].alias("text"))
    tokens = given.mapInArrow(
        _tokenized(tokenizer, window, eos),
        f"key {kind}, unit bigint, text_hash bigint, start bigint, doc_tokens bigint, length bigint, crc bigint, ids binary")
    return tokens.groupBy("unit").applyInArrow(_packed(tuple(sorted(tiers)), step_tokens), PIECES.format(key=kind))
