"""The row rules on streams: the same plans as on tables, as rules are expressions without state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.operators import assess
from loamgrid.plans.rules import Check


def issues(stream: DataFrame, checks: list[Check], row_number: Column) -> DataFrame:
    """Failing cells as they arrive; append mode."""
    return assess.issues(stream, checks, row_number)


def failures_by_window(stream: DataFrame, checks: list[Check], row_number: Column, at: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Failures of each rule in windows of event time; rows later than `late` behind the watermark are left out."""
    timed = stream.withWatermark(at, late)
    found = F.array(*(F.when(~c.passes, F.struct(F.lit(c.column).alias("Column_Name"), F.lit(c.label).alias("Rule_Applied"))) for c in checks))
    return timed.select(F.window(at, window).alias("w"), row_number.alias("Row_Number"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("_x")).groupBy("w", "_x.Column_Name", "_x.Rule_Applied").agg(F.count("*").alias("failed")).select("w.start", "w.end", "Column_Name", "Rule_Applied", "failed")


def running_log(stream: DataFrame, checks: list[Check]) -> DataFrame:
    """The cumulative execution log, one row for each check; complete mode."""
    one = F.array(*(F.struct(F.lit(c.dimension).alias("Dimension"), F.lit(c.column).alias("Column"), F.lit(c.label).alias("Rule"), F.when(~c.passes, 1).otherwise(0).alias("bad")) for c in checks))
    return stream.select(F.explode(one).alias("_x")).groupBy("_x.Dimension", "_x.Column", "_x.Rule").agg(F.count("*").alias("Evaluated"), F.sum("_x.bad").alias("Failed"))
