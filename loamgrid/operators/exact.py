"""Exact duplicates, in the core, basic and studio profiles.

Keys are counted with map-side combining; only keys with several rows meet the rows again. The groups are a table by
then, and neither side of the join is repartitioned by hand, so adaptive execution can split the rows of a hot key over
many tasks. Group numbers are given to the groups, not to the rows. Long keys are shuffled as digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions import text as T
from loamgrid.operators.ids import numbered
from loamgrid.session import cut

SHOWN_SEPARATOR = "||"
#: Keys of more letters are replaced by a digest.
LONG_KEY = 64


def compact(c: Column) -> Column:
    """A key for grouping: long texts as 192 bits of digest behind a sign that no trimmed text begins with."""
    return F.when(F.length(c) > LONG_KEY, F.concat(F.lit("\n"), F.md5(c), F.hex(F.xxhash64(c)))).otherwise(c)


def _grouped(keyed: DataFrame, order: str) -> DataFrame:
    """Adds __gid and __size to the rows whose __key occurs more than once. keyed has __key and __row."""
    groups = keyed.groupBy("__key").agg(F.count("*").alias("__size"), F.min("__row").alias("__first")).where("__size > 1")
    by = {"first": [F.col("__first")], "key": [F.col("__key")], "frequency": [F.col("__size").desc(), F.col("__first")]}[order]
    return keyed.join(numbered(groups, by, "__gid").select("__key", "__gid", "__size"), "__key")


def single(df: DataFrame, column: str, row: Column) -> DataFrame:
    """Rows whose trimmed, lower-cased value occurs more than once; missing values never match."""
    c = F.col(f"`{column}`")
    keyed = df.where(~T.nullish(c)).withColumn("__key", compact(F.lower(T.strip(c)))).withColumn("__row", row)
    return _core(_grouped(keyed, "first"), "Exact")


def _core(grouped: DataFrame, kind: str) -> DataFrame:
    return grouped.withColumns({"Duplicate_Group_ID": F.col("__gid"), "Duplicate_Type": F.lit(kind), "Similarity_Score": F.lit(100.0), "Row_Number": F.col("__row").cast("long")}).drop("__key", "__gid", "__size", "__row")


def multi_single(df: DataFrame, columns: list[str], row: Column) -> DataFrame:
    """The union of single() over several columns; group numbers start anew for each, _Source_Column names it."""
    out = None
    for c in columns:
        part = single(df, c, row).withColumn("_Source_Column", F.lit(c))
        out = part if out is None else out.unionByName(part)
    return out


def combination(df: DataFrame, columns: list[str], row: Column) -> DataFrame:
    """Rows whose values agree in all columns; rows that miss all of them never match."""
    cols = [F.col(f"`{c}`") for c in columns]
    some = ~F.array_min(F.array(*map(T.nullish, cols)))
    keyed = df.where(some).withColumn("__key", F.struct(*(compact(F.coalesce(F.lower(T.strip(c)), F.lit("none"))).alias(f"k{i}") for i, c in enumerate(cols)))).withColumn("__row", row)
    return _core(_grouped(keyed, "first"), "Combination")


def merged(parts: list[DataFrame]) -> DataFrame:
    """Several results as one, each row number once: the first rule that found it, and its first group."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("__rule_no", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    w = Window.partitionBy("Row_Number").orderBy("__rule_no", F.col("_Source_Column").asc_nulls_last() if "_Source_Column" in out.columns else F.lit(0), "Duplicate_Group_ID")
    return out.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__rule_no")


def normalized(c: Column, lower: bool = True, trim: bool = True, blank_null: bool = True, punctuation: bool = False) -> Column:
    """The basic profile's cell: trimmed, lower-cased, punctuation as blanks, blank as null."""
    out = T.text(c)
    out = T.strip(out) if trim else out
    out = F.lower(out) if lower else out
    out = T.strip(F.regexp_replace(F.regexp_replace(out, r"(?U)[^\w\s@.+\-]", " "), r"(?U)\s+", " ")) if punctuation else out
    return F.when(T.strip(out) != "", out) if blank_null else out


def normalized_table(df: DataFrame, **options) -> DataFrame:
    """The basic profile's cells: text columns normalized, all others as they are."""
    return df.select(*(normalized(F.col(f"`{c}`"), **options).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes))


def missing(df: DataFrame, fields: list[str], row: Column, shown: list[str] | None = None, **options) -> DataFrame:
    """One row for each missing cell of the fields: the field, the issue, the row's number, and the raw columns shown."""
    gone = F.array(*(F.when((normalized(F.col(f"`{c}`"), **options) if t == "string" else F.col(f"`{c}`")).isNull(), F.lit(c)) for c, t in df.dtypes if c in fields))
    return df.select(F.explode(F.filter(gone, lambda x: x.isNotNull())).alias("_missing_field"), F.lit("Missing value").alias("_issue"), row.cast("long").alias("_row_id"), *(F.col(f"`{c}`") for c in shown or df.columns))


def missing_summary(exceptions: DataFrame) -> DataFrame:
    """(field, missing_rows), most first."""
    return exceptions.groupBy(F.col("_missing_field").alias("field")).agg(F.count("*").alias("missing_rows")).orderBy(F.col("missing_rows").desc(), "field")


def basic(df: DataFrame, name: str, columns: list[str], ignore_nulls: bool = True) -> DataFrame:
    """The basic profile: rule columns first; groups numbered in the order of their keys."""
    cols = [F.col(f"`{c}`") for c in columns]
    rows = df.where(~F.array_max(F.array(*(c.isNull() for c in cols)))) if ignore_nulls else df
    keyed = rows.withColumn("__key", F.concat_ws("␟", *(F.coalesce(T.text(c), F.lit("<NULL>")) for c in cols))).withColumn("__row", F.lit(0))
    g = _grouped(keyed, "key")
    return g.select(
        F.lit(name).alias("_rule"), F.lit("EXACT").alias("_match_type"), F.lit(", ".join(columns)).alias("_match_cols"), F.col("__gid").alias("_group_id"), F.col("__size").alias("_group_size"),
        F.lit(100).cast("long").alias("_score"), F.col("__key").alias("_dup_key"), *(F.col(f"`{c}`") for c in df.columns),
    )


def basic_summary(duplicates: DataFrame) -> DataFrame:
    """Rows, groups and scores of each rule."""
    return duplicates.groupBy("_rule", "_match_type", "_match_cols").agg(F.count("*").alias("duplicate_rows"), F.countDistinct("_group_id").alias("duplicate_groups"), F.max("_score").alias("max_score"), F.min("_score").alias("min_score")).orderBy(F.col("duplicate_groups").desc(), F.col("duplicate_rows").desc(), "_rule")


def studio(df: DataFrame, columns: list[str], row: Column, recency: str | None = None) -> DataFrame:
    """Every row with its group, if any, its completeness and its place by recency in the group.

    Blank keys match each other. Groups are numbered by their size, the largest first, then by their first row. A null
    date is the oldest; without a date the last row is the most recent.
    """
    key = F.concat_ws("|", *(F.lower(T.strip(F.coalesce(T.text(F.col(f"`{c}`")), F.lit("none")))) for c in columns))
    own = [c for c in df.columns if not c.startswith("_")]
    keyed = df.withColumn("__key", compact(key)).withColumn("__row", row.cast("long"))
    groups = keyed.groupBy("__key").agg(F.count("*").alias("__n"), F.min("__row").alias("__first")).where("__n > 1")
    ids = numbered(groups, [F.col("__n").desc(), F.col("__first")], "__gid").select("__key", "__gid", "__n")
    # Grouped rows are numbered over all groups at once, by ranges that may cut through a large group; a row's place in
    # its group is the distance from the group's first number. Rows without a group take no part in it.
    newest = F.col(f"`{recency}`").desc_nulls_last() if recency else F.col("__row").desc()
    grouped = numbered(keyed.join(ids, "__key"), [F.col("__gid"), newest, F.col("__row")], "__place")
    first = grouped.groupBy("__gid").agg(F.min("__place").alias("__begin"))
    ranked = grouped.join(cut(first), "__gid").withColumn("__rank", F.col("__place") - F.col("__begin") + 1).drop("__place", "__begin")
    alone = keyed.join(ids.select("__key"), "__key", "left_anti")
    every = ranked.unionByName(alone, allowMissingColumns=True)
    present = sum((F.col(f"`{c}`").isNotNull().cast("int") for c in own), F.lit(0))
    number = F.col("__gid").cast("string")
    in_group = F.col("__gid").isNotNull()
    return every.select(
        *(F.col(f"`{c}`") for c in df.columns), F.col("__row").alias("_row_id"),
        F.when(in_group, F.concat(F.lit("DG-"), F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number))).alias("_dup_group_id"),
        in_group.alias("_is_duplicate"), F.coalesce("__n", F.lit(0)).cast("long").alias("_dup_count"), F.when(in_group, "Exact").otherwise("").alias("_match_type"),
        F.when(in_group, 1.0).otherwise(0.0).alias("_similarity_score"), F.bround(present / F.lit(max(len(own), 1)) * 100, 2).alias("_completeness"),
        F.coalesce("__rank", F.lit(0)).cast("long").alias("_recency_rank"),
    )
