"""Records that differ only in formatting, collapsed into one each (problem 4).

Each record is a list of named fields in one string. Letters and digits of each field are kept, folded to one
case and one form (letters written as base letter and combining mark are composed first); fields are put in the order
of their names; the result is hashed to 128 bits. Counts are aggregated with map-side combining. A second, independent
64-bit hash goes with the digest as part of the key, so a collision of the digest can never merge two records;
`collisions` reports how many digests had one.

Defined results: a null key or a null list of names gives no group; names without a value count as absent, values
without a name as fields named by their position; an absent field equals only an absent field; an empty field equals
every field without letters and digits, but no absent one; combining marks belong to their letter, composed or not;
`ß` and `ss` differ. Repeated names are
kept, in the order of their values. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loamgrid.session import cut, ship

SEPARATOR = "␟"
ABSENT = "<NULL>"


def _single_forms() -> tuple[str, str]:
    """Characters whose compatibility form is one other character, such as full-width letters, and those forms."""
    pairs = [(chr(i), n) for i in range(0x80, 0x10000) if not 0xD800 <= i < 0xE000 and len(n := unicodedata.normalize("NFKC", chr(i))) == 1 and n != chr(i)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(c: Column) -> Column:
    """Letters, digits and their marks, in one case. Only texts with unusual signs pay for the translation."""
    src, dst = _single_forms()
    plain = F.when(c.rlike(r"[^\x00-\x7F  -⁯␟]"), F.translate(c, src, dst)).otherwise(c)
    return F.regexp_replace(F.lower(F.upper(plain)), r"[^\p{L}\p{M}\p{N}␟]+", "")


def _composed(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else unicodedata.normalize("NFC", t) for t in texts], dtype=object)


def composed(c: Column) -> Column:
    """The text with composed letters. Only texts with combining marks go to a worker; the others are sent as nulls."""
    return F.coalesce(F.pandas_udf(_composed, StringType())(F.when(c.rlike(r"\p{M}"), c)), c)


def canonical(key: Column, names: Column) -> Column:
    """The record's fields, each `name=value` or `name!` where absent, in the order of their names."""
    fields = F.transform(
        F.arrays_zip(F.split(names, ",").alias("n"), F.split(fold(key), SEPARATOR).alias("v"), F.split(key, SEPARATOR).alias("raw")),
        lambda x: F.concat(
            F.lower(F.trim(F.coalesce(x["n"], F.lit("?")))),
            F.when(x["v"].isNull() | (F.trim(x["raw"]) == ABSENT), F.lit("!")).otherwise(F.concat(F.lit("="), x["v"])),
        ),
    )
    return F.array_join(F.sort_array(fields), SEPARATOR)


def keyed(df: DataFrame, key: str = "_dup_key", names: str = "_match_cols", record_id: str = "rec_id") -> DataFrame:
    """(rec_id, h128, check): the 128-bit digest of the canonical record and an independent 64-bit hash of it."""
    ship(df.sparkSession)
    rows = df.where(F.col(key).isNotNull() & F.col(names).isNotNull()).select(F.col(record_id).alias("rec_id"), F.col(key).alias("_key"), F.col(names).alias("_names")).withColumn("_key", composed(F.col("_key")))
    c = rows.select("rec_id", canonical(F.col("_key"), F.col("_names")).alias("_canon"))
    return c.select("rec_id", F.unhex(F.md5("_canon")).alias("h128"), F.xxhash64("_canon").alias("check"))


def collapse(df: DataFrame, key: str = "_dup_key", names: str = "_match_cols", record_id: str = "rec_id") -> DataFrame:
    """One row per record: h128, check, keep_rec_id (the smallest id), n_copies. Counts combine before the shuffle."""
    return _counted(keyed(df, key, names, record_id))


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("h128", "check").agg(F.min("rec_id").alias("keep_rec_id"), F.count("*").alias("n_copies"))


def collisions(groups: DataFrame) -> DataFrame:
    """Digests that stand for several records; their groups stay apart, as the check is part of the key."""
    return groups.groupBy("h128").agg(F.count("*").alias("n_records"), F.sum("n_copies").alias("n_copies")).where("n_records > 1")


def copies(df: DataFrame, key: str = "_dup_key", names: str = "_match_cols", record_id: str = "rec_id") -> DataFrame:
    """(keep_rec_id, rec_id) of each record that copies one with a smaller id.

    The digests are written once to the shared folder, as both the groups and the join read them, and so are the groups
    of two and more: both sides of the join then are plain tables, whose shuffles adaptive execution may split, so that
    the rows of a hot group go to many tasks, each with a copy of the group's single row.
    """
    rows = cut(keyed(df, key, names, record_id))
    groups = cut(_counted(rows).where("n_copies > 1").select("h128", "check", "keep_rec_id"))
    return rows.join(groups, ["h128", "check"]).where("rec_id > keep_rec_id").select("keep_rec_id", "rec_id")
