"""All row rules in one pass: the issue table, the execution log and the scores.

The issue table is one scan: each row's failing checks are an array, exploded. The log is one wide aggregate with
map-side combining, in groups of WIDTH checks so that generated code stays small. Neither shuffles rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.plans.rules import Check

WIDTH = 150


def issues(df: DataFrame, checks: list[Check], row_number: Column) -> DataFrame:
    """One row for each failing cell and rule; _ord keeps the rules' order."""
    found = F.array(*(
        F.when(~c.passes, F.struct(F.lit(i).alias("_ord"), F.lit(c.column).alias("Column_Name"), F.lit(c.label).alias("Rule_Applied"), F.lit(c.issue).alias("Issue_Type"), c.original.alias("Original_Value"), c.expected.alias("Expected_Value"), F.lit(c.dimension).alias("Dimension")))
        for i, c in enumerate(checks)
    ))
    return df.select(row_number.cast("long").alias("Row_Number"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("_x")).select("Row_Number", "_x.*")


def severity(score: Column) -> Column:
    return F.when(score < 50, "Critical").when(score < 70, "High").when(score < 85, "Medium").when(score < 95, "Low").otherwise("Pass")


def log(df: DataFrame, checks: list[Check]) -> DataFrame:
    """One row for each check, failing or not: rows evaluated, failed and passed, score and severity."""
    parts = []
    for at in range(0, len(checks), WIDTH):
        part = checks[at : at + WIDTH]
        wide = df.agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(F.when(~c.passes, 1)), F.lit(0)).cast("long").alias(f"f{i}") for i, c in enumerate(part)))
        rows = F.array(*(F.struct(F.lit(c.dimension).alias("Dimension"), F.lit(c.column).alias("Column"), F.lit(c.label).alias("Rule"), F.lit(c.issue).alias("Issue_Type"), F.col(f"f{i}").alias("Failed")) for i, c in enumerate(part)))
        parts.append(wide.select("n", F.explode(rows).alias("_x")).select(F.col("n").alias("Evaluated"), "_x.*"))
    score = F.bround((F.col("Evaluated") - F.col("Failed")) / F.nullif(F.col("Evaluated"), F.lit(0)) * 100, 2)
    all_rows = reduce(DataFrame.unionByName, parts).withColumn("Passed", F.col("Evaluated") - F.col("Failed")).withColumn("Score", score)
    return all_rows.select("Dimension", "Column", "Rule", "Evaluated", "Failed", "Passed", "Score", severity(F.col("Score")).alias("Severity"), "Issue_Type")


def dimension_scores(exec_log: DataFrame) -> DataFrame:
    """Share of passed evaluations of each dimension, at least 0."""
    return exec_log.groupBy("Dimension").agg(F.greatest(F.lit(0.0), F.bround((F.sum("Evaluated") - F.sum("Failed")) / F.nullif(F.sum("Evaluated"), F.lit(0)) * 100, 2)).alias("Score"))


def score_of(exec_log: DataFrame | None, issues: DataFrame, dimension: str, n_rows: int, n_checks: int) -> float:
    """A dimension's score from its log or, where it has no entry, from the issues and the number of checks.

    Without rows it is 0; without log and checks it is 0, for Standardization 100, as nothing was to be changed.
    """
    if n_rows == 0:
        return 0.0
    if exec_log is not None and (r := dimension_scores(exec_log.where(F.col("Dimension") == dimension)).first()):
        return r["Score"]
    total = n_rows * n_checks
    if total == 0:
        return 100.0 if dimension == "Standardization" else 0.0
    failed = issues.where(F.col("Dimension") == dimension).count()
    return round(max(0.0, (total - failed) / total * 100), 2)


def uniqueness_score(duplicates: DataFrame, n_rows: int) -> DataFrame:
    """Share of rows in no duplicate group."""
    bad = F.least(F.countDistinct("Row_Number"), F.lit(n_rows))
    return duplicates.agg(F.lit("Uniqueness").alias("Dimension"), (F.bround((F.lit(n_rows) - bad) / F.lit(max(n_rows, 1)) * 100, 2)).alias("Score"))


def overall(scores: DataFrame) -> DataFrame:
    """The unweighted mean of the dimension scores."""
    return scores.agg(F.bround(F.avg("Score"), 2).alias("Overall"))


def cleaned(df: DataFrame, new_values: dict[str, Column]) -> DataFrame:
    """The dataset with standardized columns."""
    return df.select(*(new_values[c].alias(c) if c in new_values else F.col(f"`{c}`") for c in df.columns))
