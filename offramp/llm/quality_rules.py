"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit for each
rule that failed; a policy is a named, versioned set of rules, i.e. a mask, and applying one is a
bitwise AND. Ablations (what would each rule alone, or its absence, change?) need no second look
at any text: documents are counted by their failure bits, and the counts answer for every policy.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from offramp.llm.common import SPACES, WORD, fresh, window_hashes, word_hashes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

REPEAT_WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``fails`` is an SQL condition over the measurements; ``bit`` never changes its meaning."""
    bit: int
    name: str
    fails: str


# Whole-number arithmetic only, so that every engine gives the same bits.
RULES = (
    Rule(0, "too_few_words", "n_words < 10"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "too_many_words", "n_words > 1000000"),
    Rule(3, "short_words", "word_chars < 2 * n_words"),
    Rule(4, "long_words", "word_chars > 15 * n_words"),
    Rule(5, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(6, "repeated_lines", "100 * n_dup_lines > 60 * n_lines"),
)
#: Policies by version: the rules whose failure rejects a document. Old versions stay.
POLICIES = {
    "base": ("too_few_words", "repeated_words"),
    "v1": ("too_few_words", "repeated_words", "too_many_words", "short_words", "long_words", "symbols"),
    "v2": tuple(r.name for r in RULES),
}


def policy_mask(policy: str | Iterable[str], rules: tuple[Rule, ...] = RULES) -> int:
    """The bit mask of a policy version or of a list of rule names."""
    names = POLICIES[policy] if isinstance(policy, str) else tuple(policy)
    bits = {r.name: r.bit for r in rules}
    return sum(1 << bits[n] for n in set(names))


def repeated_words(data: bytes) -> int:
    words = word_hashes(data)
    windows = window_hashes(words, REPEAT_WINDOW)
    if len(windows) < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    repeated = np.zeros(len(windows) + 1, np.int8)
    repeated[order[1:][same]] = 1
    repeated[order[:-1][same]] = 1
    at = np.flatnonzero(repeated[:-1])
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + REPEAT_WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(cover[:-1])))


@F.arrow_udf(LongType())
def repeat_words(texts: pa.Array) -> pa.Array:
    """Words that lie in a window of five words found at least twice in the same text."""
    return pa.array([0 if t is None else repeated_words(t)
                     for t in pc.cast(texts, pa.large_binary()).to_pylist()], pa.int64())


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def measure(text: Column) -> list[Column]:
    """The measurements of a text; all 0 for null or empty text.

    Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage
    return; lines are what lies between line feeds, and only lines with a word count.
    """
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(f"[^{SPACES}]")))
    n_lines = F.size(lines).cast("bigint")
    bare = F.regexp_replace(text, f"[{SPACES}]+", "")
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return [_count(text, WORD).alias("n_words"), F.length(bare).cast("bigint").alias("word_chars"),
            symbols.cast("bigint").alias("n_symbols"), n_lines.alias("n_lines"),
            (n_lines - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
            repeat_words(text).alias("n_repeat_words")]


def failure_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    """One bit per failed rule, from the measurement columns."""
    bits = F.lit(0).cast("bigint")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)))
    return bits


def rule_ledger(docs: DataFrame, key: str = "doc_id", text: str = "text",
                rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``key``, the measurements and ``failed`` (BIGINT bits), one row per input row.

    No shuffle. A null or empty text measures 0 everywhere and fails ``too_few_words``; rows with
    a null or repeated key, and repeated rows, are measured one by one; an empty table gives an
    empty ledger; other columns are not read, whatever their names.
    """
    measured = docs.select(docs[key].alias(key), *measure(docs[text]))
    return measured.withColumn("failed", failure_bits(rules))


def apply_policy(ledger: DataFrame, policy: str | Iterable[str], column: str = "kept") -> DataFrame:
    """Add whether a document passes every rule of the policy."""
    return ledger.withColumn(column, F.col("failed").bitwiseAND(F.lit(policy_mask(policy))) == 0)


def pattern_counts(ledger: DataFrame) -> DataFrame:
    """Documents per failure pattern: at most 2^rules rows, combined before the exchange."""
    return ledger.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))


def ablations(ledger: DataFrame, policy: str | Iterable[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail nothing else in the policy
    (``only``: kept again without the rule), and what the policy rejects with and without it."""
    mask = policy_mask(policy, rules)
    counted = pattern_counts(ledger)
    chosen = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("bigint").alias("bit"))
                       for r in rules if mask >> r.bit & 1])
    each = counted.select("failed", "n", F.explode(chosen).alias("r")).select("failed", "n", "r.*")
    within = F.col("failed").bitwiseAND(F.lit(mask))
    total = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0)).alias
    return each.groupBy("rule").agg(
        total(within.bitwiseAND(F.col("bit")) != 0)("fails"),
        total(within == F.col("bit"))("only"),
        total(within != 0)("rejected"),
        total((within != 0) & (within != F.col("bit")))("rejected_without"))


def keep_documents(docs: DataFrame, policy: str = "v2", key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that pass the policy, all their columns unchanged. Row by row, no shuffle."""
    name = fresh(docs, base="_m")
    measured = docs.withColumn(name, F.struct(*measure(docs[text])))
    conditions = [r.fails for r in RULES if policy_mask(policy) >> r.bit & 1]
    failed = F.lit(False)
    for condition in conditions:
        failed = failed | _on_struct(condition, name)
    return measured.where(~failed).drop(name)


def _on_struct(condition: str, struct: str) -> Column:
    words = [f"{struct}.{w}" if w in MEASURES else w for w in condition.split(" ")]
    return F.expr(" ".join(words))


def quality_query(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The contract's rows: base measurements, ``base_failed`` and the policy's verdict."""
    judged = apply_policy(rule_ledger(docs), policy)
    base = F.col("failed").bitwiseAND(F.lit(policy_mask("base"))) != 0
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         base.alias("base_failed"), (F.col("kept") & ~base).alias("kept"), "failed")
