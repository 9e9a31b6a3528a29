"""Text expressions: trimming, normalising, splitting into words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offramp.functions.columns import as_column

# The whitespace characters each function knows.
TRIM_SPACE = " \t\n\r\f\x0b"
WORD_SPACE = " \t\n\r\f"
WORD_SPACE_RUN = "[ \\t\\n\\r\\f]+"


def py_trim(col: Column | str) -> Column:
    """Strip all leading and trailing ASCII whitespace (a plain trim strips spaces only).

    Character-set trimming is linear in the text and stays inside generated code; an anchored
    pattern would be retried at every whitespace run.
    """
    return F.btrim(as_column(col), F.lit(TRIM_SPACE))


def normalize_text(col: Column | str) -> Column:
    """Lower-case, every whitespace run to one space, no space at either end."""
    return F.trim(F.regexp_replace(F.lower(as_column(col)), WORD_SPACE_RUN, " "))


def normalized_words(col: Column | str) -> Column:
    """The words of ``normalize_text``: joined by single spaces they are that text again."""
    return F.split(F.btrim(F.lower(as_column(col)), F.lit(WORD_SPACE)), WORD_SPACE_RUN)


def words(col: Column | str) -> Column:
    """The whitespace-separated words of a text; an empty array for a blank text."""
    trimmed = F.btrim(as_column(col), F.lit(WORD_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, WORD_SPACE_RUN))


def word_count(col: Column | str) -> Column:
    """``size(words(col))`` as BIGINT."""
    return F.size(words(col)).cast("bigint")
