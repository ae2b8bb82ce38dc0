"""The best value of each attribute in each duplicate group (problem 2).

Field-by-field survivorship. Members are first combined per group, attribute and exact value (smallest row id, best
trust, latest date among the most trusted); then one aggregation takes, for each group and attribute, the maximum of
the composite (not missing, trust, date, value). Both combine before the shuffle, so a group of any size, even a
third of all rows, is never gathered in one task.

Defined results: a missing value never survives; an attribute whose members all miss it gives no row (long form) or
null (wide form). A null date is older than every date; an unknown or null source is trusted less than every listed
one. Of values with equal trust and date the larger string wins. Repeated rows change nothing. A group is the pair of
rule and group number, nulls included, whatever the stated group size says. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.functions.missing import present
from loamgrid.session import broadcast_if_small

ATTRIBUTES = ("contact_email", "phone", "pan_number", "payment_terms", "credit_limit")
#: Source lists up to this many rows are broadcast; longer ones are joined by a shuffle.
MOST_SOURCES = 100_000


def survivors(members: DataFrame, sources: DataFrame, attributes: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    """(_rule, _group_id, column_name, value, row_id, n_values, n_holders): the surviving value of each attribute.

    row_id is the smallest id among the members that hold exactly that value.
    """
    trust = sources.where("source_system is not null").groupBy("source_system").agg(F.min("trust_rank").alias("_rank"))
    cells = (
        members.select("_rule", "_group_id", "row_id", "updated_at", "source_system", *attributes)
        .join(broadcast_if_small(trust, MOST_SOURCES), "source_system", "left")
        .select(
            "_rule", "_group_id", "row_id",
            F.struct((-F.col("_rank")).alias("trust"), F.col("updated_at").alias("at")).alias("_best"),
            F.explode(F.array(*(F.struct(F.lit(a).alias("column_name"), present(F.col(a)).alias("value")) for a in attributes))).alias("_c"),
        )
        .select("_rule", "_group_id", "row_id", "_best", "_c.*")
        .where("value is not null")
    )
    values = cells.groupBy("_rule", "_group_id", "column_name", "value").agg(F.min("row_id").alias("row_id"), F.max("_best").alias("_best"), F.count("*").alias("_n"))
    best = values.groupBy("_rule", "_group_id", "column_name").agg(
        F.max(F.struct(F.lit(1).alias("given"), "_best.trust", "_best.at", "value", "row_id", "_n")).alias("_s"), F.count("*").alias("n_values")
    )
    return best.select("_rule", "_group_id", "column_name", "_s.value", "_s.row_id", "n_values", F.col("_s._n").alias("n_holders"))


def golden(members: DataFrame, sources: DataFrame, attributes: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    """One built record per group: each attribute's surviving value, and the number of members counted anew."""
    kept = survivors(members, sources, attributes).groupBy("_rule", "_group_id").agg(*(F.max(F.when(F.col("column_name") == a, F.col("value"))).alias(a) for a in attributes))
    sizes = members.groupBy("_rule", "_group_id").agg(F.count("*").alias("n_members"), F.min("row_id").alias("first_row_id"))
    same = sizes["_rule"].eqNullSafe(kept["_rule"]) & sizes["_group_id"].eqNullSafe(kept["_group_id"])
    return sizes.join(kept, same, "left").select(sizes["_rule"], sizes["_group_id"], "n_members", "first_row_id", *attributes)
