"""Report tables over the issue table, the log and the duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions import text as T
from loamgrid.session import cut

# Categories of rules by their name's beginning.
CATEGORIES = {
    "Missing Values": ("Not Null", "Not Empty", "Mandatory Column", "Whitespace Only"),
    "Invalid Format": ("Email Format", "Phone Format", "PAN Format", "Regex", "Data Type", "Length Check", "Format Check"),
    "Domain Violations": ("Numeric Range", "Allowed Values", "Minimum Length"),
    "Duplicate Records": ("Single Column Exact", "Combination Column Exact", "Fuzzy Match", "Hybrid Fuzzy"),
    "Non-Standard Values": ("Convert to", "Special Characters Not Allowed", "Date Format", "Trim Spaces", "Remove", "Normalize Date", "Replace Null"),
}


def _joined(c: str, sep: str) -> Column:
    return F.array_join(F.sort_array(F.collect_set(c)), sep)


def by_column(issues: DataFrame) -> DataFrame:
    """Issues of each column, with their rules, kinds and dimensions."""
    return issues.groupBy("Column_Name").agg(F.count("*").alias("Issue_Count"), _joined("Rule_Applied", " | ").alias("Failed_Rules"), _joined("Issue_Type", " | ").alias("Issue_Types"), _joined("Dimension", " | ").alias("Dimensions")).orderBy(F.col("Issue_Count").desc(), "Column_Name")


def by_row(issues: DataFrame) -> DataFrame:
    """Issues of each row: rules in their order, each once, their number, and sorted dimensions. Uniqueness is left out."""
    own = issues.where("Dimension <> 'Uniqueness'")
    first = own.groupBy("Row_Number", "Rule_Applied").agg(F.min("_ord").alias("_ord"), F.min("Dimension").alias("Dimension"))
    rules = F.sort_array(F.collect_list(F.struct("_ord", "Rule_Applied")))
    return first.groupBy("Row_Number").agg(F.array_join(F.transform(rules, lambda x: x["Rule_Applied"]), "; ").alias("Issues"), F.count("*").alias("Count_of_issues"), _joined("Dimension", ", ").alias("Issue_categories"))


def groups(issues: DataFrame, duplicate_rows: DataFrame | None = None) -> DataFrame:
    """Annexures: distinct rows of each rule, most first; duplicates come last. There are as many rows as rules."""
    own = issues.where("Dimension <> 'Uniqueness'").groupBy("Rule_Applied").agg(F.countDistinct("Row_Number").alias("row_count"), F.min("_ord").alias("_ord")).withColumn("is_duplicate", F.lit(False))
    if duplicate_rows is not None:
        dup = duplicate_rows.agg(F.countDistinct("Row_Number").alias("row_count")).where("row_count > 0").select(F.lit("Duplicates").alias("Rule_Applied"), "row_count", F.lit(2_000_000_000).alias("_ord"), F.lit(True).alias("is_duplicate"))
        own = own.unionByName(dup)
    w = Window.orderBy("is_duplicate", F.col("row_count").desc(), "_ord")
    return own.withColumn("annexure_no", F.row_number().over(w).cast("long")).select("annexure_no", F.col("Rule_Applied").alias("rule_label"), "row_count", "is_duplicate")


def summary(annexures: DataFrame) -> DataFrame:
    return annexures.select(F.concat(F.lit("Annexure "), F.col("annexure_no").cast("string")).alias("S_No"), F.col("rule_label").alias("Particulars"), F.col("row_count").alias("Total_Records"))


def mismatches(annexures: DataFrame, issues: DataFrame) -> DataFrame:
    """Annexures whose row count differs from the issue table; empty if the report is consistent."""
    n = issues.groupBy("Rule_Applied").agg(F.countDistinct("Row_Number").alias("_n"))
    return annexures.where("not is_duplicate").join(n, F.col("rule_label") == F.col("Rule_Applied"), "left").where("_n is null or _n <> row_count")


def results(df: DataFrame, issues: DataFrame, row: Column) -> DataFrame:
    """Rows with issues, and their issues."""
    return df.withColumn("Row_Number", row.cast("long")).join(by_row(issues), "Row_Number")


def members(df: DataFrame, issues: DataFrame, row: Column, label: str) -> DataFrame:
    """The rows that fail one rule, with all their issues."""
    failing = issues.where(F.col("Rule_Applied") == label).select("Row_Number").distinct()
    return results(df, issues, row).join(failing, "Row_Number", "left_semi")


def classified(issues: DataFrame) -> DataFrame:
    """Issues, rows, rules and severity of each category."""
    category = F.lit("Invalid Format")
    for name, starts in CATEGORIES.items():
        for s in starts:
            category = F.when(F.col("Rule_Applied").startswith(s), name).otherwise(category)
    n, rows = F.col("n_issues"), F.col("unique_rows")
    return issues.groupBy(category.alias("category")).agg(F.count("*").alias("n_issues"), F.countDistinct("Row_Number").alias("unique_rows"), _joined("Rule_Applied", " | ").alias("rules")).withColumn(
        "severity", F.when((rows > 500) | (n > 1000), "HIGH").when((rows > 100) | (n > 200), "MEDIUM").otherwise("LOW")
    )


def by_dimension(issues: DataFrame) -> DataFrame:
    return issues.groupBy("Dimension").agg(F.count("*").alias("n_issues"), F.countDistinct("Row_Number").alias("n_rows"), F.countDistinct("Rule_Applied").alias("n_rules"))


def by_rule(issues: DataFrame, n_rows: int) -> DataFrame:
    """Failures of each rule and their share of all rows."""
    return issues.groupBy("Rule_Applied", "Dimension", "Issue_Type").agg(F.count("*").alias("n_failed")).withColumn("pct", F.bround(F.col("n_failed") / F.lit(max(n_rows, 1)) * 100, 2)).orderBy(F.col("n_failed").desc(), "Rule_Applied")


def status(score: Column) -> Column:
    return F.when(score > 95, "Good").when(score >= 85, "Moderate").otherwise("Needs Improvement")


def band(score: Column) -> Column:
    return F.when(score >= 80, "Good").when(score >= 60, "Fair").when(score >= 40, "Poor").otherwise("Critical")


def column_sheet(columns: list[str], log: DataFrame) -> DataFrame:
    """For each column the score of each dimension it was tested in, its failures and the severity of the worst."""
    spark = log.sparkSession
    per = log.groupBy("Column").agg(
        *(F.bround((1 - F.sum(F.when(F.col("Dimension") == d, F.col("Failed"))) / F.sum(F.when(F.col("Dimension") == d, F.col("Evaluated")))) * 100, 2).alias(d) for d in ("Completeness", "Validity", "Standardization")), F.sum("Failed").alias("n_failed")
    )
    worst = F.least("Completeness", "Validity", "Standardization")
    listed = spark.createDataFrame([(c,) for c in columns], "Column string")
    return listed.join(per, "Column", "left").withColumn("worst", worst).withColumn("severity", F.when(worst.isNull() | (worst > 95), "Low").when(worst >= 85, "Medium").otherwise("High")).withColumn("n_failed", F.coalesce("n_failed", F.lit(0)))


def clean_set(df: DataFrame, duplicates: DataFrame | None, issues: DataFrame, row: Column) -> DataFrame:
    """The dataset without the rows that only follow in duplicate groups, and whether a row has an issue.

    duplicates has Row_Number, Duplicate_Group_ID, Duplicate_Type and, where groups are numbered for each column anew,
    _Source_Column. A group is all of these together, nulls included. The first row of any group stays, once, even if
    it follows in another; so each group keeps a row.
    """
    rows = df.withColumn("Row_Number", row.cast("long"))
    flagged = issues.select("Row_Number").distinct().withColumn("_bad", F.lit(1))
    if duplicates is not None:
        keys = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_k{i}") for i, c in enumerate(("Duplicate_Type", "_Source_Column", "Duplicate_Group_ID")) if c in duplicates.columns]
        names = [f"_k{i}" for i, c in enumerate(("Duplicate_Type", "_Source_Column", "Duplicate_Group_ID")) if c in duplicates.columns]
        dup = cut(duplicates.select(F.col("Row_Number").cast("long").alias("Row_Number"), *keys))  # read three times
        keep = dup.groupBy(*names).agg(F.min("Row_Number").alias("Row_Number")).select("Row_Number").distinct()
        drop = dup.select("Row_Number").distinct().join(keep, "Row_Number", "left_anti")
        rows = rows.join(drop, "Row_Number", "left_anti")
        flagged = flagged.unionByName(dup.select("Row_Number", F.lit(1).alias("_bad"))).distinct()
    return rows.join(flagged, "Row_Number", "left").withColumn("Issue_Flag", F.when(F.col("_bad") == 1, "Yes").otherwise("No")).drop("_bad")


def duplicates_sheet(df: DataFrame, duplicates: DataFrame, issues: DataFrame, row: Column) -> DataFrame:
    """The duplicate rows, each once, as they are in the dataset, with their group and their other issues."""
    w = F.row_number().over(Window.partitionBy("Row_Number").orderBy("Duplicate_Type", "Duplicate_Group_ID"))
    found = duplicates.select(F.col("Row_Number").cast("long").alias("Row_Number"), "Duplicate_Group_ID", "Duplicate_Type", "Similarity_Score").withColumn("_w", w).where("_w = 1").drop("_w")
    return df.withColumn("Row_Number", row.cast("long")).join(found, "Row_Number").join(by_row(issues), "Row_Number", "left")


def full_set(df: DataFrame, issues: DataFrame, duplicates: DataFrame | None, row: Column) -> dict[str, DataFrame]:
    """The tables of a report: Results, an annexure for each rule in the order of their sizes, Duplicates, Summary.

    There are as many annexures as rules that failed, so their list comes to the driver.
    """
    listed = groups(issues, duplicates)
    names = [(r["annexure_no"], r["rule_label"], r["is_duplicate"]) for r in listed.orderBy("annexure_no").collect()]
    out = {"Results": results(df, issues, row)}
    for n, label, is_duplicate in names:
        out[f"Annexure {n}"] = duplicates_sheet(df, duplicates, issues, row) if is_duplicate else members(df, issues, row, label)
    if duplicates is not None and any(d for _, _, d in names):
        out["Duplicates"] = duplicates_sheet(df, duplicates, issues, row)
    out["Summary"] = summary(listed)
    return out


def duplicate_groups(duplicates: DataFrame) -> DataFrame:
    """Type, source column and size of each group."""
    keys = [c for c in ("Duplicate_Type", "_Source_Column", "Duplicate_Group_ID") if c in duplicates.columns]
    return duplicates.groupBy(*keys).agg(F.count("*").alias("n_rows")).orderBy(F.col("n_rows").desc(), *keys)


def duplicate_columns(duplicates: DataFrame, names: str, sep: str = ", ") -> DataFrame:
    """How many duplicate rows each column of the rules' column lists takes part in."""
    return duplicates.select(F.explode(F.split(F.col(names), F.lit(sep))).alias("column")).groupBy("column").agg(F.count("*").alias("n_rows")).orderBy(F.col("n_rows").desc(), "column")


def unique_rows(found: DataFrame, n_rows: int, row: str = "Row_Number") -> DataFrame:
    """Distinct rows among issues or duplicates, at most n_rows."""
    return found.agg(F.least(F.countDistinct(row), F.lit(n_rows)).cast("long").alias("unique_rows"))


def dashboard(issues: DataFrame, exec_log: DataFrame, n_rows: int) -> DataFrame:
    """Rows without and with issues, and the columns whose every check passed."""
    bad = unique_rows(issues, n_rows).withColumnRenamed("unique_rows", "issue_rows")
    per = exec_log.groupBy("Column").agg(F.sum("Failed").alias("_f")).agg(F.coalesce(F.sum(F.when(F.col("_f") == 0, 1)), F.lit(0)).cast("long").alias("perfect_columns"))
    return bad.crossJoin(per).select((F.lit(n_rows) - F.col("issue_rows")).cast("long").alias("clean_rows"), "issue_rows", "perfect_columns")  # one row each


def safe_values(df: DataFrame) -> DataFrame:
    """Null, NaN and infinite cells as empty text, for workbooks."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        text = F.coalesce(T.text(c), F.lit(""))
        out.append((F.when(F.isnan(c) | (F.abs(c) == float("inf")), "").otherwise(text) if kind in ("double", "float") else text).alias(name))
    return df.select(*out)
