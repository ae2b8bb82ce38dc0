"""A customer table with faults, made by the same expressions in both engines."""

from __future__ import annotations

from loamgrid.session import table

COLUMNS = {
    "rn": "c_custkey + 2",
    "cust_id": "cast(c_custkey AS string)",
    "name": "CASE c_custkey % 5 WHEN 0 THEN concat('  ', c_name) WHEN 1 THEN upper(c_name) WHEN 2 THEN lower(c_name) WHEN 3 THEN replace(c_name, '#', '  ') ELSE c_name END",
    "email": "CASE c_custkey % 13 WHEN 0 THEN '' WHEN 1 THEN 'N/A' WHEN 2 THEN '   ' WHEN 3 THEN concat('user', cast(c_custkey AS string), 'example.com') WHEN 4 THEN concat(' user', cast(c_custkey AS string), '@example.com ') ELSE concat('user', cast(c_custkey % 700 AS string), '@example.com') END",
    "phone": "CASE c_custkey % 11 WHEN 0 THEN '12345' WHEN 1 THEN '(555) 123-4567' WHEN 2 THEN 'nil' ELSE concat('+91 98765', lpad(cast(c_custkey % 100000 AS string), 5, '0')) END",
    "pan": "CASE c_custkey % 7 WHEN 0 THEN 'abcde1234f' WHEN 1 THEN 'ABCDE12345' ELSE concat('ABCDE', lpad(cast(c_custkey % 10000 AS string), 4, '0'), 'F') END",
    "balance": "CASE c_custkey % 17 WHEN 0 THEN 'abc' WHEN 1 THEN '' ELSE cast(c_acctbal AS string) END",
    "since": "CASE c_custkey % 6 WHEN 0 THEN '2024-02-30' WHEN 1 THEN '31/12/2023' WHEN 2 THEN '' ELSE '2024-03-04' END",
    "segment": "c_mktsegment",
}
SQL = "select " + ", ".join(f"{e} AS {c}" for c, e in COLUMNS.items()) + " from customer"


def dirty(spark, d):
    return table(spark, d, "customer").selectExpr(*(f"{e} AS {c}" for c, e in COLUMNS.items()))
