"""Text semantics of the rules, as Column expressions: Unicode blanks, anchored patterns, dates by strftime format."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamgrid.functions.missing import MISSING


def text(c: Column) -> Column:
    return c.cast("string")


def strip(c: Column) -> Column:
    """Without blanks of any script at both ends."""
    return F.regexp_replace(text(c), r"(?U)\A\s+|\s+\z", "")


def nullish(c: Column) -> Column:
    """True for null and for spellings of a missing value; never null."""
    return F.coalesce(F.lower(strip(c)).isin(*MISSING), F.lit(True))


def full(c: Column, pattern: str) -> Column:
    """The whole text matches."""
    return c.rlike(rf"(?U)(?d)\A(?:{pattern})\z")


def prefix(c: Column, pattern: str) -> Column:
    """The text matches from its start."""
    return c.rlike(rf"(?U)(?d)\A(?:{pattern})")


def usable(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


# Strftime fields and their pattern letters.
STRFTIME = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "b": "MMM", "B": "MMMM", "j": "DDD", "f": "SSSSSS"}
# Formats tried in this order where none is given, the day before the month.
DAY_FIRST = ("%Y-%m-%d", "%d/%m/%Y", "%d-%m-%Y", "%d.%m.%Y", "%Y/%m/%d", "%Y-%m-%d %H:%M:%S", "%d %b %Y", "%d %B %Y")
MONTH_FIRST = ("%Y-%m-%d", "%m/%d/%Y", "%m-%d-%Y", "%m.%d.%Y", "%Y/%m/%d", "%Y-%m-%d %H:%M:%S", "%d %b %Y", "%d %B %Y")


def spark_format(fmt: str) -> str:
    """A strftime format as a date pattern; other letters are quoted."""
    out = ""
    for field, letters, other in re.findall(r"%(\w)|([A-Za-z]+)|([^A-Za-z%]+)", fmt):
        out += STRFTIME[field] if field else f"'{letters}'" if letters else other
    return out


def lenient(fmt: str) -> str:
    """The pattern for reading: days and months of one digit are accepted."""
    return spark_format(fmt).replace("MMMM", "\0").replace("MMM", "\1").replace("MM", "M").replace("dd", "d").replace("\0", "MMMM").replace("\1", "MMM")


def parse_date(c: Column, formats: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(lenient(f))) for f in formats))


def number(c: Column) -> Column:
    """A double where the text is a number, with exponent or infinity; null otherwise."""
    ok = c.rlike(r"(?i)\A\s*[+-]?(?:[0-9]+\.?[0-9]*(?:e[+-]?[0-9]+)?|\.[0-9]+(?:e[+-]?[0-9]+)?|inf|infinity)\s*\z")
    return F.when(ok, strip(c).try_cast("double"))


def proper_case(c: Column) -> Column:
    """A capital after everything that is not a letter, small letters elsewhere."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1_000_000)))), "")
