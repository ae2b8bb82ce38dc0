"""The queries of the core library and their SQL: quality profiles here, all others gathered from their modules."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgrid.operators import quality
from loamgrid.queries import duplicates, rules, sources, studio
from loamgrid.session import cut, table

TEXT_COLUMNS = ("vendor_id", "vendorname", "city", "country", "contact_email", "phone", "pan_number", "payment_terms", "credit_limit", "rating", "status", "source_system")


def _watches(spark, d):
    patterns, ranges = quality.rules(table(spark, d, "rulebook"))
    return {
        "vendor_master": quality.Watch("vendor_master", TEXT_COLUMNS, {c: patterns[c] for c in ("contact_email", "phone", "pan_number") if c in patterns}, {c: ranges[c] for c in ("credit_limit", "rating") if c in ranges}, ("payment_terms", "status", "source_system")),
        "rule_issues": quality.Watch("rule_issues", ("column_name", "rule", "dimension"), mix=("column_name", "rule", "dimension")),
    }


def _each(spark, d, f):
    """The union of f(value counts, watch) over both tables."""
    out = None
    for name, watch in _watches(spark, d).items():
        part = f(quality.value_counts(table(spark, d, name), watch), watch)
        out = part if out is None else out.unionByName(part)
    return out


def _shapes(counts, watch):
    return cut(quality.shapes(counts, watch))  # read by the search and by the coverage


def p5_found(spark, d):
    """The changes of all measures; rows that break a Format rule are counted through the expressions of their column."""

    def one(counts, watch):
        counts = cut(counts)  # read by the measures, the shapes and the mix
        if not watch.patterns:
            return quality.changes(counts, watch)
        s = _shapes(counts.where(F.col("column_name").isin(*watch.patterns)), watch)
        return quality.changes(counts, watch, quality.covered(s, quality.induce(s)))

    return quality.findings(_each(spark, d, one))


def p5_profile(spark, d):
    return _each(spark, d, lambda c, w: quality.profile(c, w).drop("missing", "distinct", "pattern", "range"))


def p5_expressions(spark, d):
    found = _each(spark, d, lambda c, w: quality.induce(quality.shapes(c)))
    return found.groupBy("table_name", "column_name", "expression").agg(F.sum("n_values").alias("n_values"))


def _coverages(spark, d):
    def one(c, w):
        s = _shapes(c, w)
        return quality.coverage(s, quality.induce(s))

    return _each(spark, d, one)


def p5_coverage(spark, d):
    return _coverages(spark, d)


def p5_coverage_changes(spark, d):
    """Expressions whose share of a column's rows changed between neighbouring loads."""
    return quality.coverage_findings(_coverages(spark, d))


QUERIES: dict = {f.__name__: f for f in (p5_found, p5_profile, p5_expressions, p5_coverage, p5_coverage_changes)}

_MISS = "coalesce(lower(trim({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160))) in ('','nan','none','null','na','n/a','n.a.','nil','missing','#n/a'), true)"
_CELLS = " union all ".join(
    f"select '{t}' table_name, load_id, '{c}' column_name, case when not {_MISS.format(c=c)} then {c} end v from {t} where load_id is not null"
    for t, cols in (("vendor_master", TEXT_COLUMNS), ("rule_issues", ("column_name", "rule", "dimension")))
    for c in cols
)
_P5 = f"""with c as ({_CELLS}),
x as (select c.*, case when c.table_name = 'vendor_master' and v is not null then not regexp_full_match(v, f.expression) end bp,
  case when c.table_name = 'vendor_master' and v is not null and r.expression is not null then not (regexp_full_match(v, '-?[0-9]+(\\.[0-9]+)?') and coalesce(try_cast(v as double) between cast(split_part(r.expression, '..', 1) as double) and cast(split_part(r.expression, '..', 2) as double), false)) end br,
  case when regexp_full_match(v, '-?[0-9]+(\\.[0-9]+)?') then try_cast(v as double) end num
  from c left join rulebook f on f.column_name = c.column_name and f.rule like '%Format' and c.table_name = 'vendor_master'
         left join rulebook r on r.column_name = c.column_name and r.rule = 'Numeric Range' and c.table_name = 'vendor_master'),
p as (select table_name, load_id, column_name, count(*) n_rows, count(*) - count(v) n_missing, count(distinct v) n_distinct,
  coalesce(sum(bp::int), 0) n_bad_pattern, coalesce(sum(br::int), 0) n_bad_range, min(v) min_value, max(v) max_value, min(num) min_number, max(num) max_number, min(length(v)) min_length, max(length(v)) max_length,
  (count(*) - count(v)) / count(*) missing, count(distinct v) / nullif(count(v), 0) dist, sum(bp::int) / nullif(count(v), 0) pat, sum(br::int) / nullif(count(v), 0) rng from x group by all)
"""
SQL: dict = {
    "p5_profile": _P5 + "select table_name, load_id, column_name, n_rows, n_missing, n_distinct, n_bad_pattern, n_bad_range, min_value, max_value, min_number, max_number, min_length, max_length from p",
    "p5_found": _P5
    + """, q as (select p.table_name, p.load_id, p.column_name, abs(p.missing - b.missing) missing, abs(p.dist - b.dist) dist, abs(p.pat - b.pat) pat, abs(p.rng - b.rng) rng
    from p join p b on b.table_name = p.table_name and b.column_name = p.column_name and b.load_id = p.load_id - 1),
  n as (select table_name, load_id, column_name, v, count(*) k from c
    where column_name in ('payment_terms', 'status', 'source_system') or table_name = 'rule_issues' group by all),
  s as (select table_name, load_id, column_name, v, k / sum(k) over (partition by table_name, load_id, column_name) share from n),
  m as (select table_name, column_name, load_id, sum(abs(d)) / 2 change from (select table_name, column_name, load_id, v, sum(share) d from (
      select * from s union all select table_name, load_id + 1, column_name, v, -share from s) group by all) group by all)
select table_name, load_id, column_name, 'missing' finding from q where missing > 0.15 + 1e-9 union all
select table_name, load_id, column_name, 'distinct' from q where dist > 0.25 + 1e-9 union all
select table_name, load_id, column_name, 'pattern' from q where pat > 0.15 + 1e-9 union all
select table_name, load_id, column_name, 'range' from q where rng > 0.15 + 1e-9 union all
select m.table_name, m.load_id, m.column_name, 'mix' from m join q using (table_name, load_id, column_name) where m.change > 0.25 + 1e-9""",
}

for _module in (rules, duplicates, studio, sources):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
