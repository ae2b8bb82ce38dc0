"""Fuzzy duplicates: blocking, pair scores, connected components; and value clusters.

Blocks are formed on the leading letters of the first column (and of a place column, if there is one). Within a block
only distinct values are compared, and scored where a bound does not rule the pair out (`near`). Every block is compared. A caller may set `max_pairs`: blocks whose rows would make more pairs then are reported by `oversize` and not
compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.functions import scorers
from loamgrid.functions import text as T
from loamgrid.operators import near
from loamgrid.operators.ids import numbered
from loamgrid.session import cut, ship

# Names of place columns, the first that exists refines the blocks.
PLACE_COLUMNS = ("Country", "country", "COUNTRY", "City", "city", "CITY", "State", "state", "STATE", "Region", "region")


def _keyed(df: DataFrame, columns: list[str], row: Column, letters: int, ignore_nulls: bool, place_columns: tuple[str, ...]) -> DataFrame:
    """(_row, _block, v0, v1, ...): each row's block and trimmed lower-cased values."""
    rows = df
    if ignore_nulls:
        for c in columns:
            rows = rows.where(~T.nullish(F.col(f"`{c}`")))
    value = lambda c: F.coalesce(F.lower(T.strip(F.col(f"`{c}`"))), F.lit(""))
    place = next((c for c in place_columns if c in df.columns), None)
    block = F.substring(value(columns[0]), 1, letters)
    block = F.concat(block, F.lit("|"), F.substring(value(place), 1, 3)) if place else block
    return rows.select(row.cast("long").alias("_row"), block.alias("_block"), *(value(c).alias(f"v{i}") for i, c in enumerate(columns)))


def oversize(keyed: DataFrame, max_pairs: int) -> DataFrame:
    """(_block, n_rows, n_pairs) of the blocks beyond the limit."""
    sizes = keyed.groupBy("_block").agg(F.count("*").alias("n_rows"))
    return sizes.withColumn("n_pairs", (F.col("n_rows") * (F.col("n_rows") - 1) / 2).cast("long")).where(F.col("n_pairs") > max_pairs)


def matches(df: DataFrame, columns: list[str], row: Column, threshold: float = 80, weights: list[float] | None = None, max_pairs: int | None = None, ignore_nulls: bool = True, scorer: str = "hybrid", letters: int = 2, place_columns: tuple[str, ...] = PLACE_COLUMNS, rounded: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members, skipped): members (_row, _group, _score) of fuzzy groups, and the skipped blocks.

    A group's score is its best edge. Equal rows are one value with several rows, linked at 100 without a comparison.
    """
    ship(df.sparkSession)
    weights = weights or [1.0] * len(columns)
    keyed = _keyed(df, columns, row, letters, ignore_nulls, place_columns)
    skipped = oversize(keyed, max_pairs) if max_pairs is not None else None
    if skipped is not None:
        keyed = keyed.join(skipped.select("_block"), "_block", "left_anti")
    vals = [f"v{i}" for i in range(len(columns))]
    keyed = cut(keyed)  # read for the nodes and for the members
    # One node for each distinct combination of values in a block: the least of its rows.
    nodes = cut(keyed.groupBy("_block", *vals).agg(F.min("_row").alias("_node"), F.count("*").alias("_n")))
    found = near.groups(nodes, vals, threshold, weights, scorer, rounded)
    members = cut(keyed.join(found, ["_block", *vals]).select("_row", "_group", F.bround("_score", 2).alias("_score")))  # read for the groups' numbers and for the records
    return members, skipped


def core(df: DataFrame, columns: list[str], row: Column, **options) -> DataFrame:
    """The core profile's duplicate records; groups numbered by their first row."""
    members, _ = matches(df, columns, row, **options)
    groups = numbered(members.groupBy("_group").agg(F.min("_row").alias("_first")), [F.col("_first")], "Duplicate_Group_ID").select("_group", "Duplicate_Group_ID")
    rows = df.withColumn("Row_Number", row.cast("long"))
    found = members.join(groups, "_group").select(F.col("_row").alias("Row_Number"), "Duplicate_Group_ID", F.lit("Hybrid Fuzzy").alias("Duplicate_Type"), F.col("_score").alias("Similarity_Score"))
    return rows.join(found, "Row_Number")


def basic(df: DataFrame, name: str, columns: list[str], row: Column, **options) -> DataFrame:
    """The basic profile's fuzzy duplicates: blocks of one letter, token-set scores rounded to whole numbers."""
    members, _ = matches(df, columns, row, scorer="token_set", letters=1, place_columns=("Country", "country", "City", "city"), rounded=True, **options)
    sizes = members.groupBy("_group").agg(F.count("*").alias("_group_size"), F.min("_row").alias("_first"))
    groups = numbered(sizes, [F.col("_first")], "_group_id").select("_group", "_group_id", "_group_size")
    found = members.join(groups, "_group").select(F.col("_row"), F.lit(name).alias("_rule"), F.lit("FUZZY").alias("_match_type"), F.lit(", ".join(columns)).alias("_match_cols"), "_group_id", "_group_size", F.col("_score").cast("long").alias("_score"))
    return found.join(df.withColumn("_row", row.cast("long")), "_row").drop("_row")


def value_clusters(values: DataFrame, column: str, threshold: float = 85, most: int | None = 5_000, scorer: str = "token_set", row: Column | None = None) -> DataFrame:
    """(leader, value) of clusters of near-equal distinct values: each value joins the first leader that it resembles.

    Values are trimmed and lower-cased. Leaders depend on order, so the distinct values are clustered in one task, by
    their first row or, without one, in their own order. More than `most` of them are refused; None sets no bound.
    Spellings that score 100 against each other form no cluster.
    """
    ship(values.sparkSession)
    value = F.lower(T.strip(F.col(f"`{column}`")))
    first = F.min(row) if row is not None else F.lit(0)
    distinct = cut(values.where(value != "").groupBy(value.alias("value")).agg(first.cast("long").alias("_first"), F.lit(0).alias("_g")))
    if most is not None and distinct.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} distinct values")

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        f, leaders, out = scorers.SCORERS[scorer], {}, []
        for _, v in sorted(zip(pdf["_first"], pdf["value"])):
            lead = next((x for x in leaders if threshold <= f(x, v) < 100), None)
            if lead is None:
                leaders[v] = []
            else:
                leaders[lead].append(v)
        for lead, vs in leaders.items():
            if vs:
                out += [(lead, v) for v in [lead, *vs]]
        return pd.DataFrame(out, columns=["leader", "value"])

    return distinct.groupBy("_g").applyInPandas(cluster, "leader string, value string")


def with_partner(values: DataFrame, column: str, threshold: float = 88, scorer: str = "token_set") -> DataFrame:
    """(value, n): the trimmed, lower-cased values that have an equal or near-equal value of the same first letter, with their rows."""
    ship(values.sparkSession)
    value = F.lower(T.strip(F.col(f"`{column}`")))
    distinct = cut(values.where(value != "").groupBy(value.alias("value")).agg(F.count("*").alias("n")).withColumn("_b", F.left("value", F.lit(1))))
    found = near.pairs(distinct.select("_b", F.col("value").alias("_node"), "value").withColumnRenamed("_b", "_block"), ["value"], threshold, [1.0], scorer)
    linked = found.select(F.explode(F.array("src", "dst")).alias("value")).unionByName(distinct.where("n > 1").select("value")).distinct()
    return distinct.join(linked, "value", "left_semi").select("value", "n")
