"""Spelling variants by an index of variable-length grams.

Words are decomposed into grams of variable length: from every position the shortest gram that few
words share, up to a longest length. Which grams are frequent is a dictionary, counted over all
words and pruned by frequency. As a gram is chosen by its own letters, one edit changes only the grams
that span it. So a word is indexed under its rarest grams, as many as no single edit can all touch
(its own bound); two words one edit apart share one of them, with the text on one side of the edit
unchanged. The lists of a gram are split by that text and the length, and their words are verified.
"""

from __future__ import annotations

import math
import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offramp.llm.common import mix64, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Lengths of the shortest and the longest gram.
SHORTEST, LONGEST = 3, 6
#: A gram is frequent if more words' positions hold it than this number, or than this part of all
#: positions. The second bounds the dictionary: at most so many grams of each length are frequent.
FREQUENT, MOST_FREQUENT = 50, 1_000_000
#: Words that a counting task holds before it hands them on.
HELD = 500_000

_BASE = np.uint64(0xD6E8FEB86659FD93)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Marks before and after a word: no code points.
_BEFORE, _AFTER = 0x110000, 0x110001


# -- words ----------------------------------------------------------------------------------------
def _counted(letters: str, min_length: int, slip: int | None):
    lower = str.maketrans({c: c + 32 for c in range(65, 91)})
    longest = re.compile(f"[{letters}]{{{min_length},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()),
                                               pa.array(counts.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                start = zlib.crc32(f"{'' if key is None else key}:".encode())
                for run_, n in Counter(longest.findall(text.as_py() or "")).items():
                    word = run_.lower() if run_.isascii() else run_.translate(lower)
                    if slip:
                        h = zlib.crc32(word.encode(), start)
                        if h % slip == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < min_length:
                                continue
                    counts[word] += n
                if len(counts) > HELD:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return run


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", letters: str = "A-Za-zÀ-ÿ",
                min_length: int = 7, min_count: int = 2, slip: int | None = None) -> DataFrame:
    """``word, n``: the maximal runs of ``letters``, lower-cased in A-Z, that have ``min_length`` code
    points or more and occur ``min_count`` times or more in all texts (null: none).

    With ``slip``, about one in ``slip`` pairs of document and word loses a letter: with h the CRC-32 of
    ``<key>:<word>`` (null key: empty), the code point h % length goes if ``slip`` divides h.
    """
    parts = docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(
        _counted(letters, min_length, slip), "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# -- grams ----------------------------------------------------------------------------------------
class _Grams:
    """The positions of a batch of words (each between its two marks), as arrays."""

    def __init__(self, words: pa.Array, longest: int):
        texts = words.to_pylist()
        self.sizes = np.array([len(t) + 2 for t in texts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        letters = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        self.raw = np.empty(int(self.sizes.sum()), np.uint64)
        inner = np.ones(len(self.raw), bool)
        inner[self.starts] = inner[self.starts + self.sizes - 1] = False
        self.raw[inner] = letters
        self.raw[self.starts], self.raw[self.starts + self.sizes - 1] = _BEFORE, _AFTER
        counts = self.sizes - (SHORTEST - 1)
        self.word = np.repeat(np.arange(len(texts)), counts)
        self.at = np.arange(len(self.word)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.place = self.starts[self.word] + self.at
        self.room = self.sizes[self.word] - self.at
        self.longest = longest

    def codes(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(length, positions that have room for it, hash of the gram)``, short grams first."""
        code = np.zeros(len(self.place), np.uint64)
        for k in range(self.longest):
            fits = self.room > k
            code = code * _BASE + np.where(fits, self.raw[np.minimum(self.place + k, len(self.raw) - 1)], 0)
            if k + 1 >= SHORTEST:
                yield k + 1, fits, mix64(code + np.full(1, k + 1, np.uint64) * _GOLDEN)


def _gram_counts(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged():
            codes, which = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            return codes, np.bincount(which, np.concatenate([n for _, n in held])).astype(np.int64)

        for batch in batches:
            if batch.num_rows:
                for _, fits, code in _Grams(batch.column(0), longest).codes():
                    held.append(np.unique(code[fits], return_counts=True))
                    size += len(held[-1][0])
            if size > 4_000_000:
                held = [merged()]
                size = len(held[0][0]) * 3 // 4
                if len(held[0][0]) > 4_000_000:
                    yield _batch(*held.pop())
                    size = 0
        if held:
            yield _batch(*merged())

    return run


def _batch(codes, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(counts)], names=["gram", "n"])


def gram_dictionary(words: DataFrame, longest: int = LONGEST, frequent: int = FREQUENT,
                    most: int = MOST_FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the frequent grams, in order, and their counts: at most ``most`` of each length."""
    positions = words.agg(F.sum(F.length("word").cast("bigint"))).first()[0] or 0
    limit = max(frequent, positions // most)
    rows = (words.select("word").mapInArrow(_gram_counts(longest), "gram bigint, n bigint")
            .groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > limit).toArrow())
    codes = rows["gram"].to_numpy().view(np.uint64)
    order = np.argsort(codes)
    return codes[order], rows["n"].to_numpy()[order]


def signature(words: pa.Array, codes: np.ndarray, counts: np.ndarray, longest: int):
    """The indexed grams ``(word, start, length)`` of each word, on the word between its marks.

    From each position, the shortest infrequent gram, or the longest possible. A word's grams are taken
    from the rarest on, until no letter lies in all of them: then one edit leaves one of them whole.
    The order depends on the grams' letters only, so it is the same in both words of a pair.
    """
    grams = _Grams(words, longest)
    length = np.zeros(len(grams.place), np.int64)
    chosen = np.zeros(len(grams.place), np.uint64)
    often = np.zeros(len(grams.place), np.int64)
    open_ = np.ones(len(grams.place), bool)
    for size, fits, code in grams.codes():
        open_ = open_ & fits
        at = np.flatnonzero(open_)
        mine = code[at]
        found = np.minimum(np.searchsorted(codes, mine), max(len(codes) - 1, 0))
        known = codes[found] == mine if len(codes) else np.zeros(len(mine), bool)
        length[at], chosen[at] = size, mine
        often[at] = np.where(known, counts[found] if len(codes) else 0, 0)
        open_[at] = known
    order = np.lexsort((grams.at, chosen, often, grams.word))
    start, end = grams.at[order], grams.at[order] + length[order]
    many = grams.sizes - (SHORTEST - 1)
    first = np.cumsum(many) - many
    low, high = np.ones(len(many), np.int64), grams.sizes - 2
    taken = np.zeros(len(order), bool)
    active = np.arange(len(many))
    k = 0
    while len(active):
        row = first[active] + k
        taken[row] = True
        low[active] = np.maximum(low[active], start[row])
        high[active] = np.minimum(high[active], end[row] - 1)
        k += 1
        active = active[(low[active] <= high[active]) & (k < many[active])]
    order = order[taken]
    return grams, grams.word[order], grams.at[order], length[order]


def _entries(sent, longest: int):
    """Index rows ``(key, probe, word, n)``: under its own length each word can be found, under the next
    shorter length it looks for shorter words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            grams, word, start, length = signature(batch.column(0), codes, counts, longest)
            # polynomial hashes of the text up to the gram's end, and from its start, within the word
            powers = np.full(int(grams.sizes.max()) + 1, _BASE, np.uint64)
            powers[0] = 1
            powers = np.multiply.accumulate(powers)
            inside = np.arange(len(grams.raw)) - np.repeat(grams.starts, grams.sizes)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(grams.raw) * powers[inside], dtype=np.uint64)])
            begin, size = grams.starts[word], grams.sizes[word]
            upto = sums[begin + start + length] - sums[begin]
            # letters after an edit stand one place further: aligned at the word's end
            since = (sums[begin + size] - sums[begin + start]) * powers[grams.sizes.max() - size]
            span, letters = start + length, size - 2
            keys, probes, which = [], [], []
            for side, flank, extent, own, shorter in (
                    (1, upto, span, span <= letters + 1, span <= letters),
                    (2, since * _inverse(int(grams.sizes.max())), size - start, start >= 1, start >= 2)):
                flank = mix64(flank + extent.astype(np.uint64) * _GOLDEN + np.uint64(side))
                for probe, good in ((False, own), (True, shorter)):
                    keys.append(mix64(flank[good] + (letters[good] - probe).astype(np.uint64)))
                    probes.append(np.full(int(good.sum()), probe))
                    which.append(word[good])
            which = pa.array(np.concatenate(which))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(probes)),
                 batch.column(0).take(which), batch.column(1).take(which)], names=["key", "probe", "word", "n"])

    return run


def _inverse(n: int) -> np.uint64:
    """The inverse of the base's ``n``-th power modulo 2^64."""
    return np.uint64(pow(pow(int(_BASE), n, 1 << 64), -1, 1 << 64))


def near_pairs(words: DataFrame, min_length: int = 7, frequent: int = FREQUENT,
               most: int = MOST_FREQUENT) -> DataFrame:
    """``a, n_a, b, n_b``: all pairs of words (``word, n``, distinct, each of at least ``min_length`` code
    points) that differ by one inserted, deleted or replaced code point, once each."""
    longest = min(LONGEST, min_length - 1)
    if longest < SHORTEST:
        raise ValueError(f"words need {SHORTEST + 1} letters at least")
    sent = words.sparkSession.sparkContext.broadcast(gram_dictionary(words, longest, frequent, most))
    entries = stored(words.mapInArrow(_entries(sent, longest), "key bigint, probe boolean, word string, n bigint"),
                     "spelling-entries")
    homes = entries.where(~F.col("probe")).select("key", F.col("word").alias("b"), F.col("n").alias("n_b"))
    seeking = entries.select("key", "probe", F.col("word").alias("a"), F.col("n").alias("n_a"))
    return (seeking.join(homes, "key").where((F.col("probe") | (F.col("a") < F.col("b"))))
            .where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b").dropDuplicates(["a", "b"]))


# -- forms ----------------------------------------------------------------------------------------
def spelling_variants(words: DataFrame, min_length: int = 7, ratio: int = 10, frequent: int = FREQUENT,
                      most: int = MOST_FREQUENT) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for a table of distinct words and their counts (``word,
    n``), each of at least ``min_length`` code points.

    ``form`` is the near word (one edit apart) of the largest count, the first in code-point order
    on a tie, if its count ``form_n`` is at least ``ratio`` (2 or more) times the word's, else null. ``root`` is
    where the forms lead to, the word itself without one. ``n_near`` is the number of near words.
    """
    pairs = near_pairs(words, min_length, frequent, most)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    enough = -F.col("best.less") >= F.col("n") * ratio
    formed = stored(words.join(best, "word", "left").select(
        "word", F.when(enough, F.col("best.other")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(enough, -F.col("best.less")).alias("form_n")), "spelling-forms")
    edges = formed.where(F.col("form").isNotNull())
    # counts grow by the ratio at each step, so the longest way is known; each round doubles the reach
    span = edges.agg(F.max("form_n"), F.min("n")).first()
    steps = int(math.log(span[0] / span[1], ratio)) + 1 if span[0] else 0
    roots = edges.select("word", F.col("form").alias("root"))
    for _ in range(max(steps - 1, 0).bit_length()):
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        roots = stored(roots.join(onward, "root", "left").select(
            "word", F.coalesce("onward", "root").alias("root")), "spelling-roots")
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_query(docs: DataFrame) -> DataFrame:
    """Words of seven letters or more; one in 31 pairs of document and word loses a letter first.

    Null or empty texts have no words; null or repeated keys and repeated rows count like others. An
    empty table gives no rows. Other columns are not read.
    """
    return spelling_variants(stored(count_words(docs, slip=31), "spelling-words"))
