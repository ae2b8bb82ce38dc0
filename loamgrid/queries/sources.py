"""Queries on files, rulebooks and planning, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loamgrid.plans import planning
from loamgrid.plans.rules import Rule, plan
from loamgrid.queries.dirty import COLUMNS, dirty
from loamgrid.queries.dirty import SQL as DV
from loamgrid.session import scratch, table
from loamgrid.sources import files
from loamgrid.streaming import rules as streaming

TEXT = tuple(c for c in COLUMNS if c != "rn")


def _written(spark, d):
    path = f"{scratch(spark)}/cut-{uuid.uuid4().hex}.csv"
    files.own_columns(dirty(spark, d).withColumn("_hidden", F.lit(1))).write.csv(path, **files.CSV)
    return path


def csv_text(spark, d):
    """All cells as text, after a round trip through delimited files."""
    return files.read(spark, _written(spark, d))


def csv_typed(spark, d):
    """Inferred types, without empty rows and columns, after the same round trip."""
    return files.drop_empty(files.read_typed(spark, _written(spark, d))).select("rn", "cust_id", "segment")


def file_summary(spark, d):
    return files.summary(dirty(spark, d))


def rulebook_read(spark, d):
    return files.read_rulebook(table(spark, d, "rulebook").withColumnsRenamed({"column_name": "column", "rule": "rule_type", "dimension": "rule_category"}))


def vendor_suggestions(spark, d):
    """The kind of the vendor master by its columns, and the rules suggested for them."""
    names = table(spark, d, "vendor_master").columns
    kind = planning.dataset_kind(names)
    return spark.createDataFrame([(kind, r.column, r.dimension, r.rule) for r in planning.suggest(names)], "kind string, column_name string, dimension string, rule string")


def _stream(spark, d):
    """The customers as a stream of files."""
    given = spark.read.parquet(f"{d}/customer.parquet")
    rows = spark.readStream.schema(given.schema).parquet(f"{d}/customer.parque[t]")
    return rows.selectExpr(*(f"{e} AS {c}" for c, e in COLUMNS.items()))


def _checks(df):
    return plan([Rule("email", "Validity", "Email Format"), Rule("phone", "Completeness", "Not Null")], df.columns)


def stream_issues(spark, d):
    """Failing cells as they arrive, appended to files."""
    rows, path = _stream(spark, d), f"{scratch(spark)}/cut-{uuid.uuid4().hex}"
    found = streaming.issues(rows, _checks(rows), F.col("rn")).drop("_ord")
    found.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(path)


def stream_log(spark, d):
    """The running log when the stream has been read; it has one row for each check."""
    rows, name = _stream(spark, d), f"log_{uuid.uuid4().hex}"
    log = streaming.running_log(rows, _checks(rows))
    log.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{scratch(spark)}/{name}").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


_TYPED = "select rn::bigint rn, cust_id::bigint cust_id, segment from dv"
_HITS = "unnest([('vendor_id', 'Completeness', 'Not Null'), ('vendor_id', 'Completeness', 'Not Empty'), ('contact_email', 'Validity', 'Email Format'), ('phone', 'Validity', 'Phone Format'), ('pan_number', 'Validity', 'PAN Format'), ('payment_terms', 'Validity', 'Allowed Values'), ('credit_limit', 'Validity', 'Numeric Range'), ('rating', 'Validity', 'Numeric Range'), ('status', 'Validity', 'Allowed Values')])"
_MISS = "coalesce(lower(trim({c})) in ('','nan','none','null','na','n/a','n.a.','nil','missing','#n/a'), true)"
_BAD = {
    "email": (f"not {_MISS.format(c='email')} and not regexp_full_match(trim(email), '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+')", "Validity", "Email Format", "Invalid Format", "Valid email (user@domain.tld)"),
    "phone": (_MISS.format(c="phone"), "Completeness", "Not Null", "Missing Values", "Non-null value"),
}
SQL = {
    "stream_issues": f"with dv as ({DV}) " + " union all ".join(f"select rn Row_Number, '{c}' Column_Name, '{rule}' Rule_Applied, '{kind}' Issue_Type, {c} Original_Value, '{want}' Expected_Value, '{dim}' Dimension from dv where {bad}" for c, (bad, dim, rule, kind, want) in _BAD.items()),
    "stream_log": f"with dv as ({DV}) " + " union all ".join(f"select '{dim}' Dimension, '{c}' \"Column\", '{rule}' Rule, count(*) Evaluated, count(*) filter (where {bad}) Failed from dv" for c, (bad, dim, rule, _, _) in _BAD.items()),
    "csv_text": f"with dv as ({DV}) select rn::varchar rn, " + ", ".join(f"coalesce({c}, '') {c}" for c in TEXT) + " from dv",
    "csv_typed": f"with dv as ({DV}) {_TYPED}",
    "file_summary": f"select count(*) \"rows\", {len(COLUMNS)}::bigint \"columns\" from ({DV})",
    "rulebook_read": "select column_name, rule, dimension, message, expression, severity from rulebook",
    "vendor_suggestions": f"select 'Vendor' kind, h[1] column_name, h[2] dimension, h[3] rule from (select {_HITS} h)",
}
QUERIES = {k: globals()[k] for k in SQL}
