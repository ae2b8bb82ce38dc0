"""Weighted ratings: wide response tables to long form, weighted means, levels, exceptions and keyed updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.functions import text as T

# Rating labels, lowest first, and the least score of each level.
RATINGS = ("Adhoc", "Repeatable", "Defined", "Managed", "Optimised")
LEVELS = ((95, "Optimised"), (80, "Managed"), (60, "Defined"), (40, "Repeatable"))


def level(score: Column) -> Column:
    out = F.lit(RATINGS[0])
    for least, name in reversed(LEVELS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def score(rating: Column) -> Column:
    """1 to 5 of a label; null for anything else."""
    return F.create_map(*(F.lit(x) for i, r in enumerate(RATINGS, 1) for x in (r, i)))[rating]


def long_form(responses: DataFrame, objects: list[str]) -> DataFrame:
    """(dimension, question_id, weight, object, rating) of a table with one rating column for each object."""
    return responses.unpivot(["dimension", "question_id", "weight"], objects, "object", "rating")


def dimension_scores(long: DataFrame) -> DataFrame:
    """Weighted mean for each dimension and object, over positive weights and known ratings."""
    s, w = score(F.col("rating")), F.col("weight")
    ok = s.isNotNull() & (w > 0)
    return long.groupBy("dimension", "object").agg((F.sum(F.when(ok, s * w)) / F.sum(F.when(ok, w))).alias("score"))


def overall(scores: DataFrame) -> DataFrame:
    return scores.groupBy("object").agg(F.avg("score").alias("overall"))


def exceptions(long: DataFrame, at_most: float = 2.0) -> DataFrame:
    return long.withColumn("score", score(F.col("rating"))).where(F.col("score") <= at_most)


def invalid(long: DataFrame) -> DataFrame:
    return long.where(score(F.coalesce("rating", F.lit(""))).isNull())


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of both by key; values of the new table win where given. Other columns of the old table stay, null for new keys."""
    o, n = old.alias("o"), new.alias("n")
    rest = [c for c in old.columns if c != key and c not in columns]
    given = lambda c: F.coalesce(f"n.{c}", f"o.{c}") if c in new.columns and c in old.columns else F.col(f"n.{c}" if c in new.columns else f"o.{c}")
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), *(given(c).alias(c) for c in columns), *(F.col(f"o.`{c}`") for c in rest))


def from_template(rows: DataFrame, objects: list[str]) -> DataFrame:
    """A filled-in template as responses: an unknown rating is the lowest, a weight that is no number or negative is 1."""
    w = T.number(T.text(F.col("weight")))
    known = lambda c: F.when(score(T.strip(F.col(f"`{c}`"))).isNotNull(), T.strip(F.col(f"`{c}`"))).otherwise(RATINGS[0]).alias(c)
    return rows.select("dimension", "question_id", F.coalesce(F.when(w >= 0, w), F.lit(1.0)).alias("weight"), *(known(c) for c in objects if c in rows.columns))


def absent(rows: DataFrame, objects: list[str]) -> list[str]:
    """Objects that a response table has no column for."""
    return [c for c in objects if c not in rows.columns]


def as_score(c: Column) -> Column:
    """A number between 0 and 5 of any text; null where it is none."""
    return F.least(F.greatest(T.number(T.text(c)), F.lit(0.0)), F.lit(5.0))


def whole_level(c: Column) -> Column:
    """A score as the nearest of the levels 1 to 5."""
    return F.least(F.greatest(F.bround(c), F.lit(1.0)), F.lit(5.0)).cast("int")


def report_set(responses: DataFrame, objects: list[str], at_most: float = 2.0) -> dict[str, DataFrame]:
    """The tables of a report on ratings: scores of dimensions, overall, details and exceptions."""
    long = long_form(responses, [o for o in objects if o in responses.columns])
    scores = dimension_scores(long)
    return {"Dimension Scores": scores, "Overall": overall(scores), "Details": long.withColumn("score", score(F.col("rating"))), "Exceptions": exceptions(long, at_most)}


def mean_of_means(scores: DataFrame) -> DataFrame:
    """The mean over all objects of their mean over dimensions, and its level."""
    return overall(scores).agg(F.avg("overall").alias("overall")).withColumn("level", level(F.col("overall") * 20))
