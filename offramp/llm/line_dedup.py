"""Line deduplication within one edit, by a deletion-neighbourhood join.

A line is dropped when an earlier line (by document id, then place) of the corpus equals it or is
within one inserted, deleted or replaced character. All of it is DataFrame functions.

Deleting one character from each of two lines within one edit can make them equal, so lines meet
when they share a deletion variant, hashed to 64 bits. A variant of a replacement also carries the
place of the deleted character, which makes every two lines that share one neighbours of each other:
each needs to be held against the earliest line of its key only. An inserted character is the
full shorter line meeting a variant of the longer one. So no key needs its pairs.

One edit leaves the first or the last half of a line as it is, and all of it but one short block.
Lines that share neither a half nor all but a block with another line have no neighbour; they are
left out before any variant is made, and the variants are made inside the block only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offramp.functions.columns import int_div, let
from offramp.llm.common import fresh, sieved, stored

#: Shorter lines are left alone: within one edit of each other they are words, not copies.
MIN_CHARS = 16
#: Halves are cut at multiples of this, so that lengths that differ by one share their cut.
_GRID = 8
#: Blocks of a line: about 16 characters each, longer in lines of more than 256 (the work for a line
#: is its length times its blocks, and then its blocks' variants times their length).
_BLOCK, _MOST_BLOCKS = 16, 16
_TRIM = " \t\r\x0b\x0c"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _half(n: Column) -> Column:
    return (int_div(n, 2 * _GRID) * _GRID).cast("int")


def _half_keys(line: Column, n: Column) -> Column:
    """Keys of which two lines within one edit share at least one."""
    def of(h: Column) -> list[Column]:
        return [F.xxhash64(F.lit(0), h, F.substring(line, F.lit(1), h)),
                F.xxhash64(F.lit(1), h, F.substring(line, n - h + 1, h))]

    own, shorter = _half(n), _half(n - 1)
    return F.when(own == shorter, F.array(*of(own))).otherwise(F.array(*of(own), *of(shorter)))


def _blocks(line: Column, n: Column, longer: int) -> Column:
    """For each block of the shorter of two lines, a key of all the line but the block, and the
    block; ``longer``: the line takes part as the one with a character more."""
    m = n - longer
    count = F.greatest(F.lit(2), F.least(F.lit(_MOST_BLOCKS), int_div(m, _BLOCK).cast("int")))

    def block(b: Column) -> Column:
        start, end = int_div(b * m, count).cast("int"), int_div((b + 1) * m, count).cast("int")
        tail = m - end
        return F.struct(F.xxhash64(m, b, F.substring(line, F.lit(1), start), F.substring(line, n - tail + 1, tail)).alias("block"),
                        F.substring(line, start + 1, n - start - tail).alias("middle"))

    return F.transform(F.sequence(F.lit(0), count - 1), block)


def _without(text: Column, i: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), i), F.substring(text, i + 2, F.length(text)))


def _variants(rows: DataFrame) -> DataFrame:
    """Deletion variants of the blocks ``block, middle, longer``: their other columns, ``kind`` (0 replaced, 1 shorter
    line, 2 longer line) and ``variant``. A row per place comes first, as whole rows are worked on in
    compiled code and array elements are not; place -1 of a shorter line is the middle as it is."""
    others = [c for c in rows.columns if c not in ("block", "middle", "longer")]
    block, middle, longer, i = F.col("block"), F.col("middle"), F.col("longer"), F.col("i")
    places = rows.withColumn("i", F.explode(F.sequence(F.when(longer == 1, 0).otherwise(-1), F.length(middle) - 1)))
    kind = F.when(longer == 1, 2).when(i < 0, 1).otherwise(0)
    variant = (F.when(longer == 1, F.xxhash64(block, F.lit("i"), _without(middle, i)))
               .when(i < 0, F.xxhash64(block, F.lit("i"), middle))
               .otherwise(F.xxhash64(block, F.lit("r"), i, _without(middle, i))))
    return places.select(*others, kind.alias("kind"), variant.alias("variant"))


def _shared(rows: DataFrame, key: str, *, shorter: bool = False) -> DataFrame:
    """The keys that two different lines have (one of them as the shorter), combined before the exchange."""
    bounds = [F.min("h1").alias("low"), F.max("h1").alias("high")]
    if shorter:
        bounds.append(F.min("longer").alias("least"))
    found = rows.groupBy(key).agg(*bounds).where("low <> high")
    return (found.where("least = 0") if shorter else found).select(key)


def near_lines(firsts: DataFrame, lines: DataFrame) -> DataFrame:
    """``h1, h2`` of the lines that an earlier line is within one edit of.

    ``firsts``, stored, one row per line: ``h1, h2, place, spot, halves``; ``lines``: ``h1, h2, spot, line``. Of
    a line that occurs often, only the text at its first place is shuffled.
    """
    halves = firsts.select("h1", "h2", "spot", F.explode("halves").alias("half"))
    some = halves.join(_shared(halves, "half"), "half", "left_semi").select("h1", "h2", "spot").distinct()
    some = stored(some, "half-lines")
    texts = sieved(lines, "spot", some).join(some, ["h1", "h2", "spot"])
    texts = stored(texts.groupBy("h1", "h2").agg(F.first("line").alias("line")), "half-texts")

    n = F.length("line")
    blocks = texts.select("h1", "h2", F.explode(F.array(
        F.struct(F.lit(0).alias("longer"), _blocks(F.col("line"), n, 0).alias("all")),
        F.struct(F.lit(1).alias("longer"), _blocks(F.col("line"), n, 1).alias("all")))).alias("side"))
    blocks = blocks.select("h1", "h2", "side.longer", F.explode("side.all").alias("b")).select("h1", "h2", "longer", "b.*")
    blocks = stored(blocks, "blocks")  # cutting them costs more than reading them twice
    close = stored(blocks.join(_shared(blocks, "block", shorter=True), "block", "left_semi"), "close-lines")

    first = firsts.select("h1", "h2", "place").join(close.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")
    variants = stored(_variants(close.select("h1", "h2", "block", "middle", "longer")).join(first, ["h1", "h2"]), "variants")

    member = F.struct("place", "h1", "h2")
    earliest = variants.groupBy("variant").agg(
        F.min(F.when(F.col("kind") == 0, member)).alias("e0"), F.min(F.when(F.col("kind") == 1, member)).alias("e1"),
        F.min(F.when(F.col("kind") == 2, member)).alias("e2"))
    met = variants.join(earliest, "variant").withColumn(
        "e", F.when(F.col("kind") == 0, F.col("e0")).when(F.col("kind") == 1, F.col("e2")).otherwise(F.col("e1")))
    pairs = met.where(F.col("e.place") < F.col("place")).select(
        "h1", "h2", F.col("e.h1").alias("g1"), F.col("e.h2").alias("g2")).distinct()
    other = texts.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("line").alias("earlier"))
    return pairs.join(texts, ["h1", "h2"]).join(other, ["g1", "g2"]).where(
        F.levenshtein("line", "earlier", 1) == 1).select("h1", "h2").distinct()


def dropped_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", max_edits: int = 1,
                  min_chars: int = MIN_CHARS) -> DataFrame:
    """``id, text_hash, exact, near``: places of the lines to drop, one row per document that has any.

    Places count from 0. A line that equals an earlier one is exact, else near.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    line = F.btrim(F.col("line"), F.lit(_TRIM))
    lines = docs.select(docs[key].alias("id"), F.xxhash64(docs[text]).alias("text_hash"),
                        F.posexplode(split_lines(docs[text])).alias("line_no", "line"))
    lines = lines.withColumn("line", line).where(F.length("line") >= min_chars)
    lines = lines.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit("second"), "line")})
    halves = [let(F.length("line"), lambda n: _half_keys(F.col("line"), n)).alias("halves")] if max_edits else []
    found = stored(lines.select("id", "text_hash", "line_no", "h1", "h2", *halves), "lines")

    firsts = found.groupBy("h1", "h2").agg(
        F.min(F.struct("id", "text_hash", "line_no")).alias("first"), F.count(F.lit(1)).alias("n"),
        *([F.first("halves").alias("halves")] if max_edits else []))
    if max_edits:
        # equal h1 and h2 are equal lines, so that a spot need only tell most places of a line apart
        spot = lambda *place: F.xxhash64(F.lit("spot"), *place)
        firsts = stored(firsts.withColumn("spot", spot("first.id", "first.text_hash", "first.line_no")), "first-lines")
        near = near_lines(firsts.withColumnRenamed("first", "place"), lines.select(
            "h1", "h2", spot("id", "text_hash", "line_no").alias("spot"), "line")).withColumn("near", F.lit(True))
        firsts = firsts.select("h1", "h2", "first", "n").join(near, ["h1", "h2"], "left")
    else:
        firsts = firsts.withColumn("near", F.lit(None).cast("boolean"))
    firsts = firsts.where((F.col("n") > 1) | F.col("near"))
    hit = found.drop("halves").join(firsts, ["h1", "h2"])
    exact = F.struct("id", "text_hash", "line_no") != F.col("first")
    return hit.where(exact | F.col("near")).groupBy("id", "text_hash").agg(
        F.collect_set(F.when(exact, F.col("line_no"))).alias("exact"),
        F.collect_set(F.when(~exact, F.col("line_no"))).alias("near"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", max_edits: int = 1,
                min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the dropped lines taken out of ``text`` and the added columns ``n_lines``,
    ``n_exact`` and ``n_near`` (line counts before, and dropped as exact or near repeats).

    Lines lie between line feeds and are compared without ASCII white space at their ends; lines
    shorter than ``min_chars`` stay. The first of equal or neighbouring lines stays. Order: by key
    (a null key first), then text hash, then place; rows that repeat key and text get the same
    decisions. Null text stays null, with 0 lines; an empty table stays empty; a column of ``docs``
    named like an added one is replaced. Texts are read three times and shuffled once.
    """
    drop = dropped_lines(docs, key, text, max_edits, min_chars)
    names = {c: fresh(docs, base=f"_{c}") for c in ("id", "text_hash", "exact", "near")}
    drop = drop.withColumnsRenamed(names)
    joined = docs.join(drop, docs[key].eqNullSafe(drop[names["id"]]) & (F.xxhash64(docs[text]) == drop[names["text_hash"]]), "left")
    count = lambda c: F.coalesce(F.size(drop[names[c]]), F.lit(0)).cast("bigint")
    lines = split_lines(docs[text])
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.concat(drop[names["exact"]], drop[names["near"]]))
    rest = let(lines, lambda all_: F.array_join(F.transform(places, lambda i: F.get(all_, i)), "\n"))
    new = F.when(docs[text].isNull() | drop[names["exact"]].isNull(), docs[text]).otherwise(rest)
    added = {"n_lines": F.when(docs[text].isNull(), 0).otherwise(F.size(lines)).cast("bigint"),
             "n_exact": count("exact"), "n_near": count("near")}
    kept = [new.alias(c) if c == text else docs[c] for c in docs.columns if c.lower() not in added]
    return joined.select(*kept, *[v.alias(k) for k, v in added.items()])
