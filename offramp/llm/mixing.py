"""Mixing sources to target weights by systematic sampling.

A source's expected copies per document are its target over its size. Documents of a source stand
in one order (by size, so that the sample has the source's sizes; then by a digest of the id), the
prefix sum of the expected copies runs along it, one random offset per source is added, and a
document is taken once for each whole number that its own step crosses. No step is longer than 2,
so no document is taken more often than twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offramp.functions.hashing import digest_number, seeded_digest
from offramp.llm.common import WORD, fresh, stored

#: Documents of one size, source and digest prefix that one task puts in order, on average.
RUN_ROWS = 20_000


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(totals: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5,
                   most: int = 2) -> DataFrame:
    """``source, source_size`` (one row per source) with ``target``.

    Sources by code point, null last, take the weights in turn. ``share`` of all sizes is dealt
    out by weight; a target stops at ``most`` times its source's size, and what is above is dealt
    out again until none is above. Only sums over the sources reach the driver, one row a round.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    weighed = stored(totals.withColumn("weight", weight), "mix-sources")
    level, capped = 0.0, -1
    while True:
        above = F.col("source_size") * most < F.col("weight") * F.lit(level)
        row = weighed.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(above, F.col("source_size") * most).otherwise(0)).alias("full"),
            F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("open"),
            F.count_if(above).alias("n")).first()
        if row["n"] == capped or not row["open"]:
            break
        capped, level = row["n"], (share * row["total"] - row["full"]) / row["open"]
    target = F.least(F.col("weight") * F.lit(level), (F.col("source_size") * most).cast("double"))
    return weighed.select("source", "source_size", target.alias("target"))


def mix_plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
             weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 8,
             identity: Column | None = None) -> DataFrame:
    """One row per input row: ``key, source, size, source_size, target, copies``.

    The texts are read once, for their word counts; only ids, sources and counts are shuffled.
    A row's place is the documents of smaller size in its source, plus those of its size with a
    smaller digest prefix, plus its place among the rest; so no group that is put in order holds
    more than a source's distinct sizes or a small part of one size, however large a source is.

    Null text has size 0. A null source is a source of its own, the last. Null or repeated keys
    and repeated rows are documents of their own; rows that tie in everything share out the copies
    of their places. A source without a word is not taken. An empty table gives an empty plan. ``identity`` adds a column of that name.
    """
    own = [F.lit(None).cast("bigint").alias("identity") if identity is None else identity.alias("identity")]
    sized = stored(docs.select(
        docs[key].alias("key"), docs[source].cast("string").alias("source"), word_count(docs[text]).alias("size"),
        digest_number(seeded_digest(seed, F.coalesce(docs[key].cast("string"), F.lit(""))), 15).alias("digest"),
        *own), "mix-sizes")
    n = sized.count()
    digits = 0
    while digits < 5 and n > RUN_ROWS * 16 ** digits:
        digits += 1
    sized = sized.withColumn("prefix", F.shiftright("digest", 60 - 4 * digits) if digits else F.lit(0).cast("bigint"))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, share, most)

    by_prefix = sized.groupBy("source", "size", "prefix").agg(F.count(F.lit(1)).alias("n"))
    by_size = by_prefix.groupBy("source", "size").agg(F.sum("n").alias("n"))
    before = lambda *keys: Window.partitionBy("source", *keys[:-1]).orderBy(keys[-1])
    sizes = by_size.select(F.col("source"), F.col("size"), (F.sum("n").over(before("size")) - F.col("n")).alias("smaller"))
    sizes = sizes.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    prefixes = by_prefix.select(
        F.col("source").alias("s"), F.col("size").alias("z"), "prefix",
        (F.sum("n").over(before("size", "prefix")) - F.col("n")).alias("earlier"))
    starts = prefixes.join(sizes, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).select(
        F.col("s"), F.col("z"), F.col("prefix").alias("p"), (F.col("smaller") + F.col("earlier")).alias("start"),
        "source_size", "target")
    place = F.row_number().over(before("size", "prefix", F.struct("digest", "key", "identity")))
    placed = sized.withColumn("place", place).join(
        starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("prefix") == F.col("p")))
    step = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size").cast("double"), F.lit(float(most))))
    offset = digest_number(seeded_digest(seed, F.coalesce(F.concat(F.lit("source "), F.col("source")), F.lit("none"))), 8) / F.lit(float(1 << 32))
    rank = (F.col("start") + F.col("place")).cast("double")
    copies = F.floor(offset + rank * step) - F.floor(offset + (rank - 1) * step)
    return placed.select(F.col("key").alias(key), "source", "size", "source_size", "target",
                         F.coalesce(copies, F.lit(0)).cast("bigint").alias("copies"), "identity")


def mix_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **settings) -> DataFrame:
    """The mix itself: every document as often as the plan takes it, all columns as they were.

    Documents meet their copies by a hash of key, text and source: documents and plan rows go through one
    exchange together, are numbered in the same order on both sides, and each document takes the copies of the
    plan row of its number. Rows that repeat key, text and source are told apart by their other columns (maps
    left aside), so reruns agree. The texts are shuffled once.
    """
    ident = F.xxhash64(docs[text], docs[source])
    plan = mix_plan(docs, key, text, source, identity=ident, **settings)
    met, side, ident_, copies, place, turn, rest, hit = (fresh(docs, base=f"_{b}") for b in (
        "met", "side", "identity", "copies", "place", "turn", "rest", "hit"))
    plan = plan.select(F.col(key).alias(place), F.col("identity").alias(ident_), F.col("copies").alias(copies))
    plan = plan.withColumns({met: F.xxhash64(place, ident_), side: F.lit(0), rest: F.lit(0).cast("bigint")})
    told = [docs[f.name] for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    rows = docs.withColumns({place: docs[key], ident_: ident, side: F.lit(1), rest: F.xxhash64(*told)})
    rows = rows.withColumn(met, F.xxhash64(place, ident_))
    both = rows.unionByName(plan, allowMissingColumns=True).repartition(met)
    both = both.withColumn(turn, F.row_number().over(Window.partitionBy(met, side).orderBy(place, ident_, rest, copies)))
    both = both.withColumn(hit, F.lag(copies).over(Window.partitionBy(met).orderBy(turn, side)))
    taken = both.where((F.col(side) == 1) & (F.col(hit) > 0))
    return taken.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(hit).cast("int")))).select(*docs.columns)


def mix_query(docs: DataFrame) -> DataFrame:
    """The contract's rows: words taken of every document."""
    plan = mix_plan(docs)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
