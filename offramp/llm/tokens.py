"""Token ids of whole Arrow batches of texts by a word-level BPE tokenizer.

Texts fall into pieces as in the tokenizer (runs of letters, single digits, runs of marks), white space
is dropped. Each distinct piece is tokenized once a worker and found again by a 64-bit hash; new
pieces are merged all at once, in arrays, by the tokenizer file's own merge table. A part between
spaces that holds anything but Latin letters, digits and ASCII marks goes to the tokenizer itself.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from offramp.llm.common import mix64

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Distinct pieces that a worker remembers before it starts anew. What it remembers stays while the worker lives,
#: beside the work of all later stages.
REMEMBERED = 500_000
#: Bytes of text that are encoded at a time (a longer text is encoded alone): some 100 bytes of arrays each.
BLOCK_BYTES = 1 << 20
#: Characters of pieces that are merged at a time, with some 50 bytes of arrays each.
MERGE_CELLS = 1 << 18
#: Longer pieces are left to the tokenizer.
LONGEST = 48

SPACE, LETTER, DIGIT, MARK, OTHER = range(5)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.int32(1 << 30)


def _classes() -> np.ndarray:
    """The kind of every single byte; the apostrophe starts contractions and is left out of the marks."""
    kinds = np.full(256, OTHER, np.uint8)
    kinds[[9, 10, 11, 12, 13, 32]] = SPACE
    for low, high, kind in (("A", "Z", LETTER), ("a", "z", LETTER), ("0", "9", DIGIT)):
        kinds[ord(low):ord(high) + 1] = kind
    for mark in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~":
        kinds[ord(mark)] = MARK
    return kinds


def byte_signs() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: bytes without a
    printable Latin-1 character of their own are numbered from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class BatchEncoder:
    """Ids of texts as 16-bit numbers; equal to encoding each text whole."""

    def __init__(self, path: str):
        import json
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary, signs = model["vocab"], byte_signs()
        self.first = np.array([vocabulary[s] for s in signs], np.int64)
        self.last = np.array([vocabulary[s + model["end_of_word_suffix"]] for s in signs], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocabulary[a] << 16 | vocabulary[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.ranks = order.astype(np.int32)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        self.classes = _classes()
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.places = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint16)
        self.starts = np.zeros(1, np.int64)

    # -- new pieces ---------------------------------------------------------------------------
    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 16 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def _merge(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens (in order) and their number of each piece, all pieces of similar length at once."""
        n, width = len(sizes), int(sizes.max())
        column = np.arange(width)
        inside = column < sizes[:, None]
        token = self.first[raw[np.minimum(starts[:, None] + column, len(raw) - 1)]]
        row = np.arange(n)
        token[row, sizes - 1] = self.last[raw[starts + sizes - 1]]
        following = np.minimum(np.tile(column + 1, (n, 1)), width)
        before = np.tile(column - 1, (n, 1))
        alive = inside.copy()
        rank = np.full((n, width), _NONE, np.int32)
        if width > 1:
            pair = inside[:, 1:]
            rank[:, :-1][pair] = self._rank(token[:, :-1][pair], token[:, 1:][pair])
        active = row
        while len(active):
            best = rank[active].argmin(1)
            lowest = rank[active, best]
            going = lowest < _NONE
            active, best, lowest = active[going], best[going], lowest[going]
            if not len(active):
                break
            gone = following[active, best]
            after = following[active, gone]
            token[active, best] = self.merged[lowest]
            alive[active, gone] = False
            rank[active, gone] = _NONE
            following[active, best] = after
            open_ = after < sizes[active]
            before[active[open_], after[open_]] = best[open_]
            rank[active, best] = _NONE
            a, j, k = active[open_], best[open_], after[open_]
            rank[a, j] = self._rank(token[a, j], token[a, k])
            left = before[active, best]
            open_ = left >= 0
            a, j, k = active[open_], left[open_], best[open_]
            rank[a, j] = self._rank(token[a, j], token[a, k])
        return token[alive].astype(np.uint16), alive.sum(1)

    def _alone(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16)

    def _learn(self, raw, given, hashes, starts, ends, odd) -> None:
        """Add pieces, sorted by hash: odd ones by the tokenizer from the bytes as given, the others by merging."""
        sizes = ends - starts
        counts = np.zeros(len(starts), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        odd = odd | (sizes > LONGEST)
        alone = [self._alone(given[starts[i]:ends[i]].decode("utf-8", "replace")) for i in np.flatnonzero(odd)]
        order = [np.flatnonzero(odd)]
        counts[odd] = [len(a) for a in alone]
        parts = alone
        low = 0
        for high in (6, 9, 12, 18, LONGEST):
            some = np.flatnonzero(~odd & (sizes > low) & (sizes <= high))
            low = high
            step = MERGE_CELLS // high
            for at in range(0, len(some), step):
                chosen = some[at:at + step]
                tokens, n = self._merge(raw, starts[chosen], sizes[chosen])
                parts.append(tokens)
                counts[chosen] = n
                order.append(chosen)
        order = np.concatenate(order)
        known = len(self.starts) - 1
        ends_of = self.starts[-1] + np.cumsum(counts[order])
        self.ids = np.concatenate([self.ids, *parts])
        self.starts = np.concatenate([self.starts, ends_of])
        places = np.empty(len(order), np.int64)
        places[order] = known + np.arange(len(order))
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.places = np.insert(self.places, at, places)

    # -- texts --------------------------------------------------------------------------------
    def _pieces(self, raw: np.ndarray, bounds: np.ndarray):
        """Bounds and oddness of the pieces of a block of texts; ``bounds`` are the texts'."""
        kind = self.classes[raw]
        lead = np.flatnonzero(raw[:-1] == 0xC3)
        trail = raw[lead + 1]
        fine = (trail >= 0x80) & (trail <= 0xBF) & (trail != 0x97) & (trail != 0xB7)
        kind[lead[fine]] = LETTER
        kind[lead[fine] + 1] = LETTER
        bar = np.flatnonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|")))
        kind[bar] = OTHER
        edge = np.empty(len(raw) + 1, bool)
        edge[0] = edge[-1] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
        edge[:-1] |= kind == DIGIT
        edge[bounds] = True
        # a part with any odd byte is one odd piece
        if (kind == OTHER).any():
            space = kind == SPACE
            cut = np.empty(len(raw) + 1, bool)
            cut[0] = cut[-1] = True
            np.not_equal(space[1:], space[:-1], out=cut[1:-1])
            cut[bounds] = True
            at = np.flatnonzero(cut)
            strange = np.add.reduceat(kind == OTHER, at[:-1], dtype=np.int64) > 0
            inner = np.repeat(strange, np.diff(at))
            kind[inner] = OTHER
            edge[:-1] &= ~inner
            edge[at] = True
        at = np.flatnonzero(edge)
        starts, ends = at[:-1], at[1:]
        kinds = kind[starts]
        real = kinds != SPACE
        return starts[real], ends[real], kinds[real] == OTHER

    def _block(self, data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        given = np.frombuffer(data, np.uint8)
        if not len(given):
            return np.zeros(0, np.uint16), np.zeros(len(bounds), np.int64)
        starts, ends, odd = self._pieces(given, bounds)
        raw = given.copy()
        upper = (raw >= 65) & (raw <= 90)
        upper[1:] |= (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
        raw[upper] += 32
        power, inverse = _powers(len(raw) + 1)
        # odd pieces are hashed as given
        lower_sums = _sums(_BYTE[raw] * power[:-1])
        hashes = (lower_sums[ends] - lower_sums[starts]) * inverse[starts]
        if odd.any():
            sums = _sums(_BYTE[given] * power[:-1])
            a, b = starts[odd], ends[odd]
            hashes[odd] = (sums[b] - sums[a]) * inverse[a] + np.uint64(1)
        hashes = mix64(hashes + (ends - starts).astype(np.uint64) * _GOLDEN)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > REMEMBERED:
            self._forget()
        if len(distinct):
            at = np.searchsorted(self.hashes, distinct)
            new = at == len(self.hashes)
            new[~new] = self.hashes[at[~new]] != distinct[~new]
            if new.any():
                at = first[new]
                self._learn(raw, data, distinct[new], starts[at], ends[at], odd[at])
            place = self.places[np.searchsorted(self.hashes, distinct)]
        else:
            place = np.zeros(0, np.int64)
        begin, size = self.starts[place], self.starts[place + 1] - self.starts[place]
        begin, size = begin[which], size[which]
        until = np.cumsum(size)
        total = int(until[-1]) if len(until) else 0
        out = self.ids[np.repeat(begin - (until - size), size) + np.arange(total)]
        before = np.concatenate([[0], until])
        return out, before[np.searchsorted(starts, bounds)]

    def __call__(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Blocks ``(first text, ids, bounds)``: text ``first + i`` has ``ids[bounds[i]:bounds[i + 1]]``.

        A null text has no ids.
        """
        if not len(texts):
            return
        large = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(large.buffers()[1], np.int64)[large.offset:large.offset + len(large) + 1]
        data = memoryview(large.buffers()[2]) if large.buffers()[2] is not None else memoryview(b"")
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1)
            yield at, *self._block(bytes(data[offsets[at]:offsets[end]]), offsets[at:end + 1] - offsets[at])
            at = end


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """The first ``n`` powers of an odd base modulo 2^64, and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        base = 0xD6E8FEB86659FD93
        _POWERS.clear()
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            _POWERS.append(np.multiply.accumulate(steps))
    return [p[:n] for p in _POWERS]


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])


def batch_encoder(path: str) -> BatchEncoder:
    """The encoder of a tokenizer file, one a Python worker: workers outlive their tasks, this
    module's own variables do not, so it is held by the tokenizers library's module."""
    import tokenizers
    held = tokenizers.__dict__.setdefault("_offramp_encoders", {})
    if path not in held:
        held[path] = BatchEncoder(path)
    return held[path]
