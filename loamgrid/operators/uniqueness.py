"""The uniqueness dimension as one plan: exact, combined and fuzzy duplicates, their issues, score and log entry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.functions import text as T
from loamgrid.operators import assess, exact, fuzzy
from loamgrid.session import cut


@dataclass(frozen=True)
class Alike:
    """Near-equal rows over some columns."""

    columns: tuple[str, ...]
    threshold: float = 80
    weights: tuple[float, ...] = ()
    max_pairs: int | None = None
    ignore_nulls: bool = True


@dataclass(frozen=True)
class Uniqueness:
    """Which duplicates are looked for: in single columns, in combinations of two and more, and near-equal rows."""

    single: tuple[str, ...] = ()
    combinations: tuple[tuple[str, ...], ...] = ()
    alike: tuple[Alike, ...] = ()


def merge(rules: list[Uniqueness]) -> Uniqueness:
    """Several entries as one plan: every column, combination and near-equality once, in their order."""
    every = lambda part: tuple(dict.fromkeys(x for r in rules for x in getattr(r, part)))
    return Uniqueness(every("single"), every("combinations"), every("alike"))


def duplicates(df: DataFrame, plan: Uniqueness, row: Column) -> tuple[DataFrame, DataFrame]:
    """(records, issues): each duplicate row once, by the first part that found it; and an issue for each part that did.

    Columns that the table does not have are left out, and with them combinations of fewer than two. Both are empty
    tables if no part is left.
    """
    have = lambda columns: [c for c in columns if c in df.columns]
    parts, issues = [], []
    group = F.concat(F.lit("Duplicate (Group "), F.col("Duplicate_Group_ID"), F.lit(")"))

    def add(found: DataFrame, *described) -> None:
        found = cut(found)  # read as records and as issues
        parts.append(found)
        issues.append(_issues(found, *described))

    if single := have(plan.single):
        value = F.coalesce(*(F.when(F.col("_Source_Column") == c, T.text(F.col(f"`{c}`"))) for c in single))
        add(exact.multi_single(df, single, row), F.col("_Source_Column"), "Single Column Exact Duplicate", group, value, "Unique value")
    for columns in map(have, plan.combinations):
        if len(columns) > 1:
            add(exact.combination(df, columns, row), F.lit(" + ".join(columns)), "Combination Column Exact Duplicate", group, _shown(columns), "Unique combination")
    for a in plan.alike:
        if columns := have(a.columns):
            weights = [w for c, w in zip(a.columns, a.weights) if c in columns] or None
            kind = F.concat(F.lit("Fuzzy Dup (Group "), F.col("Duplicate_Group_ID"), F.lit(", "), F.bround("Similarity_Score").cast("int"), F.lit("%)"))
            found = fuzzy.core(df, columns, row, threshold=a.threshold, weights=weights, max_pairs=a.max_pairs, ignore_nulls=a.ignore_nulls)
            add(found, F.lit(" + ".join(columns)), f"Fuzzy Match (>={a.threshold:g}%)", kind, _shown(columns), "Unique record")
    if not parts:
        none = df.withColumns({"Row_Number": row.cast("long"), "Duplicate_Group_ID": F.lit(0).cast("long"), "Duplicate_Type": F.lit(""), "Similarity_Score": F.lit(0.0)}).where("false")
        return none, _issues(none, F.lit(""), "", F.lit(""), F.lit(""), "")
    every = issues[0]
    for i in issues[1:]:
        every = every.unionByName(i)
    return exact.merged(parts), every


def _shown(columns: list[str]) -> Column:
    return F.concat_ws(" | ", *(F.coalesce(T.text(F.col(f"`{c}`")), F.lit("None")) for c in columns))


def _issues(found: DataFrame, column: Column, rule: str, kind: Column, value: Column, expected: str) -> DataFrame:
    return found.select("Row_Number", F.lit(1_000_000).alias("_ord"), column.alias("Column_Name"), F.lit(rule).alias("Rule_Applied"), kind.alias("Issue_Type"), value.alias("Original_Value"), F.lit(expected).alias("Expected_Value"), F.lit("Uniqueness").alias("Dimension"))


def log(records: DataFrame, n_rows: int) -> DataFrame:
    """The dimension's entry in the execution log: all rows evaluated, the distinct duplicate rows failed."""
    failed = records.agg(F.least(F.countDistinct("Row_Number"), F.lit(n_rows)).cast("long").alias("Failed"))
    entry = failed.select(F.lit("Uniqueness").alias("Dimension"), F.lit("ALL").alias("Column"), F.lit("Exact/Fuzzy Duplicate Check").alias("Rule"), F.lit(n_rows).cast("long").alias("Evaluated"), "Failed")
    scored = entry.withColumn("Passed", F.col("Evaluated") - F.col("Failed")).withColumn("Score", F.bround(F.col("Passed") / F.nullif(F.col("Evaluated"), F.lit(0)) * 100, 2))
    return scored.select("*", assess.severity(F.col("Score")).alias("Severity"), F.lit("Duplicate Records").alias("Issue_Type"))
