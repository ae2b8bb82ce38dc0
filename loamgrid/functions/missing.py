"""The missing-value model shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of a missing value after trimming and lower-casing.
MISSING = ("", "nan", "none", "null", "na", "n/a", "n.a.", "nil", "missing", "#n/a")
BLANKS = " \t\n\r\f\x0b "


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def is_missing(c: Column) -> Column:
    """True for null and every spelling of a missing value; never null."""
    return F.coalesce(F.lower(trimmed(c)).isin(*MISSING), F.lit(True))


def present(c: Column) -> Column:
    """The value itself, or null where it is missing."""
    return F.when(~is_missing(c), c)
