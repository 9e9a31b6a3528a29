"""I-Match fingerprints: hashes of a document's terms within several random lexicons.

The lexicon is what lies in a band of inverse document frequency: terms of at least ``min_docs``
documents and of at most ``max_share`` of all. Each random lexicon is a sample of it, drawn by the
term's hash, at one of three rates: the higher ones say something about short documents, the lower
ones about long ones, where a dense sample would never be the same twice. A fingerprint lists,
for every random lexicon, the hash of the document's sorted distinct terms in it (empty if there
is none); the likeness of two is the share of equal hashes where either has one.

All of it is DataFrame functions. Only the sampled terms (about one in fourteen) leave the task
that reads a text, as 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offramp.functions.columns import let
from offramp.llm.common import stored

#: Terms are drawn by hash modulo RANGE: (number of random lexicons, residues of each).
RANGE = 8192
LEXICONS = ((16, 32), (8, 8), (8, 2))
SAMPLED = sum(n * width for n, width in LEXICONS)
MIN_DOCS, MAX_SHARE = 2, 0.05
#: Documents that one task puts in order, on average, and the most of such groups.
RUN_ROWS, MOST_RUNS = 1_000, 65_536
_TERM_ENDS = r"[\x00-/:-@\[-`{-\x7f]+"


def sampled_terms(text: Column) -> Column:
    """Distinct 64-bit hashes of the text's sampled terms. A term is a run of letters and digits,
    or of anything beyond ASCII, in lower case."""
    hashes = F.transform(F.split(F.lower(text), _TERM_ENDS), lambda w: F.when(w != "", F.xxhash64(w)))
    return F.array_distinct(F.filter(hashes, lambda h: F.pmod(h, F.lit(RANGE)) < SAMPLED))


def lexicon_of(term: Column) -> Column:
    """Number of the random lexicon that a sampled term belongs to."""
    place = F.pmod(term, F.lit(RANGE))
    out, first, start = None, 0, 0
    for n, width in LEXICONS:
        number = (first + F.floor((place - start) / width)).cast("int")
        end = start + n * width
        out = F.when(place < end, number) if out is None else out.when(place < end, number)
        first, start = first + n, end
    return out


def _hash_text(value: Column, digits: int) -> Column:
    return F.lower(F.substring(F.lpad(F.hex(value), 16, "0"), 17 - digits, digits))


def fingerprint_of(terms: Column, bit: int, fallback: Column) -> Column:
    """The fingerprint from ``array<struct<lexicon, term, sides>>``, of the terms whose ``sides``
    have the bit; with no term at all, the hash of the whole text after a tilde."""
    own = F.array_sort(F.filter(terms, lambda t: t["sides"].bitwiseAND(F.lit(bit)) != 0))

    def parts(mine: Column) -> Column:
        def one(k: Column) -> Column:
            some = F.transform(F.filter(mine, lambda t: t["lexicon"] == k), lambda t: t["term"])
            return let(some, lambda s: F.when(F.size(s) > 0, _hash_text(F.xxhash64(s), 8)).otherwise(""))

        lexicons = F.sequence(F.lit(0), F.lit(sum(n for n, _ in LEXICONS) - 1))
        return F.when(F.size(mine) > 0, F.array_join(F.transform(lexicons, one), ":"))

    return F.coalesce(let(own, parts), F.concat(F.lit("~"), _hash_text(fallback, 16)))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints; else the share of lexicons with equal terms among those in which
    either has a term; 0 if a fingerprint has no term."""
    held = F.zip_with(F.split(a, ":"), F.split(b, ":"), lambda x, y: F.when((x != "") | (y != ""), x == y))
    counted = let(held, lambda h: F.size(F.filter(h, lambda x: x)) / F.nullif(F.size(F.filter(h, lambda x: x.isNotNull())), F.lit(0)))
    return F.when(a == b, 1.0).when(a.startswith("~") | b.startswith("~"), 0.0).otherwise(F.coalesce(counted, F.lit(0.0)))


def _numbers(values: list[int]) -> Column:
    """An array constant as one literal, split and cast when the plan is built."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _run_of(key: Column, starts: list[int]) -> Column:
    """Index of the last start that is not above the key (0 for a null key), in two short scans."""
    wide = max(1, int(len(starts) ** 0.5))
    coarse, fine = _numbers(starts[::wide]), _numbers(starts)
    below = lambda values: F.size(F.filter(values, lambda s: s <= key))
    block = let(F.greatest(below(coarse) - 1, F.lit(0)), lambda c: c * wide + F.greatest(below(F.slice(fine, c * wide + 1, F.lit(wide))) - 1, F.lit(0)))
    return F.when(key.isNull(), 0).otherwise(block)


def with_next(rows: DataFrame) -> DataFrame:
    """``id, text, text_hash`` with ``next_id, next_text, next_hash`` of the row that follows by id
    (null ids first, then by text hash), the first after the last.

    Rows are dealt into runs of consecutive ids whose starts are ids of the table; a run's first
    documents also travel to the run before, so every run finds its last row's successor.
    """
    size = rows.agg(F.count(F.lit(1)), F.min("id")).first()
    runs = min(MOST_RUNS, size[0] // RUN_ROWS + 1)
    starts = [size[1]]
    if runs > 1 and size[1] is not None:
        shares = [i / runs for i in range(1, runs)]
        starts = sorted({size[1], *rows.agg(F.percentile_approx("id", shares, max(10_000, 10 * runs))).first()[0]})
    if size[1] is None:
        starts = [0]
    runs = len(starts)
    run = _run_of(F.col("id"), starts)
    is_first = F.col("id").isNull() | (F.col("id") == F.get(_numbers(starts), F.col("run")))
    placed = rows.withColumn("run", run).withColumn("at", F.explode(F.concat(
        F.array(F.struct(F.col("run").alias("run"), F.lit(0).alias("guest"))),
        F.when(is_first, F.array(F.struct(F.pmod(F.col("run") - 1, F.lit(runs)).alias("run"), F.lit(1).alias("guest")))).otherwise(
            F.slice(F.array(F.struct(F.col("run").alias("run"), F.lit(0).alias("guest"))), 1, 0)))))
    order = Window.partitionBy("at.run").orderBy("at.guest", F.col("id").asc_nulls_first(), "text_hash")
    following = F.lead(F.struct("id", "text", "text_hash")).over(order)
    return placed.withColumn("next", following).where("at.guest = 0").select(
        "id", "text", "text_hash", F.col("next.id").alias("next_id"), F.col("next.text").alias("next_text"),
        F.col("next.text_hash").alias("next_hash"))


def lexicon(terms: DataFrame, n_docs: int, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """The terms in the band, from one row per document and term (``term``)."""
    counts = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return counts.where((F.col("df") >= min_docs) & (F.col("df") <= F.lit(max(min_docs, max_share * n_docs)))).select("term")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS,
                 max_share: float = MAX_SHARE) -> DataFrame:
    """``key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` per row.

    The edited text is the text with its last ``floor(n_chars / 2)`` code points replaced by the
    first as many of the next document's. Document frequencies count the texts, not the edited ones.

    Null text is empty; a text without a term of the lexicon is fingerprinted by its whole. Null
    keys come first in the order, rows of one key stand by text hash, repeated rows follow each
    other; each row gets its own result. An empty table gives an empty result. Texts are shuffled
    once, to meet their successor.
    """
    rows = docs.select(docs[key].cast("bigint").alias("id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    half = (F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    met = with_next(rows).withColumn("edited", edited).select(
        "id", "text_hash", "next_id", "next_hash", F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"), F.xxhash64("edited").alias("edited_hash"),
        F.xxhash64("id", "text_hash", "next_id", "next_hash").alias("row"),
        sampled_terms(F.col("text")).alias("own"), sampled_terms(F.col("edited")).alias("other"))
    met = stored(met, "edited")

    band = lexicon(met.select(F.explode("own").alias("term")), met.count(), min_docs, max_share)
    sided = lambda terms, sides: F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(sides).alias("sides")))
    terms = met.select("row", F.explode(F.concat(
        sided(F.array_except("own", "other"), 1), sided(F.array_except("other", "own"), 2),
        sided(F.array_intersect("own", "other"), 3))).alias("t")).select("row", "t.*")
    held = terms.join(band, "term").groupBy("row").agg(
        F.collect_set(F.struct(lexicon_of(F.col("term")).alias("lexicon"), "term", "sides")).alias("terms"))
    none = F.array().cast("array<struct<lexicon:int,term:bigint,sides:int>>")
    printed = met.drop("own", "other").join(held, "row", "left").withColumn("terms", F.coalesce("terms", none))
    printed = stored(printed.select(
        "id", "text_hash", "next_id", "next_hash", "n_chars", "edited_sha256",
        fingerprint_of(F.col("terms"), 1, F.col("text_hash")).alias("fingerprint"),
        fingerprint_of(F.col("terms"), 2, F.col("edited_hash")).alias("edited_fingerprint")), "fingerprints")
    following = printed.groupBy(F.col("id").alias("i"), F.col("text_hash").alias("h")).agg(F.first("fingerprint").alias("next_fingerprint"))
    out = printed.join(following, F.col("next_id").eqNullSafe(F.col("i")) & (F.col("next_hash") == F.col("h")))
    return out.select(F.col("id").alias(key), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                      likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                      likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
