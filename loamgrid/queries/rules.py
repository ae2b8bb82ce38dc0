"""Queries on the row rules, their log, scores and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgrid.operators import assess, report
from loamgrid.plans.rules import Rule, plan, standardize
from loamgrid.queries.dirty import SQL as DV
from loamgrid.queries.dirty import dirty

_NULLISH = "coalesce(lower(trim({c})) in ('','nan','none','null','na','n/a','n.a.','nil','missing','#n/a'), true)"


def _skip(c: str, ok: str) -> str:
    return f"({_NULLISH.format(c=c)} or ({ok}))"


def _full(c: str, p: str) -> str:
    return f"regexp_full_match(trim({c}), '{p}')"


_NUM = "^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)(e[+-]?[0-9]+)?$"
_MV, _IF, _NS = "Missing Values", "Invalid Format", "Non-Standard Values"
#: (rule, label, issue, expected, SQL of passing)
CHECKS = [
    (Rule("email", "Completeness", "Not Null"), "Not Null", _MV, "Non-null value", f"not {_NULLISH.format(c='email')}"),
    (Rule("email", "Completeness", "Not Empty"), "Not Empty", _MV, "Non-empty value", "length(trim(email)) > 0"),
    (Rule("name", "Completeness", "Minimum Length", {"min_length": 19}), "Minimum Length (19)", _MV, "Length ≥ 19", f"not {_NULLISH.format(c='name')} and length(trim(name)) >= 19"),
    (Rule("phone", "Completeness", "Mandatory Column"), "Mandatory Column", _MV, "Required value", f"not {_NULLISH.format(c='phone')}"),
    (Rule("balance", "Completeness", "Not Null"), "Not Null", _MV, "Non-null value", f"not {_NULLISH.format(c='balance')}"),
    (Rule("since", "Completeness", "Not Null"), "Not Null", _MV, "Non-null value", f"not {_NULLISH.format(c='since')}"),
    (Rule("email", "Validity", "Email Format"), "Email Format", _IF, "Valid email (user@domain.tld)", _skip("email", _full("email", "[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+"))),
    (Rule("phone", "Validity", "Phone Format"), "Phone Format", _IF, "Valid phone (7–15 digits)", _skip("phone", _full("phone", "\\+?[0-9][0-9\\s\\-()]{6,14}"))),
    (Rule("pan", "Validity", "PAN Format"), "PAN Format", _IF, "PAN: AAAAA9999A", _skip("pan", "regexp_full_match(upper(trim(pan)), '[A-Z]{5}[0-9]{4}[A-Z]')")),
    (Rule("balance", "Validity", "Data Type Validation", {"data_type": "numeric"}), "Data Type (numeric)", _IF, "Expected type: numeric", _skip("balance", _full("balance", "-?\\d+(?:\\.\\d+)?"))),
    (Rule("balance", "Validity", "Data Type Validation", {"data_type": "integer"}), "Data Type (integer)", _IF, "Expected type: integer", _skip("balance", _full("balance", "-?\\d+"))),
    (Rule("balance", "Validity", "Data Type Validation", {"data_type": "float"}), "Data Type (float)", _IF, "Expected type: float", _skip("balance", _full("balance", "-?\\d+\\.\\d+"))),
    (Rule("since", "Validity", "Date Format", {"date_fmt": "%Y-%m-%d"}), "Date Format", _IF, "Valid date (%Y-%m-%d)", _skip("since", "try_strptime(trim(since), '%Y-%m-%d') is not null")),
    (Rule("since", "Validity", "Data Type Validation", {"data_type": "date"}), "Data Type (date)", _IF, "Expected type: date", _skip("since", "try_strptime(trim(since), ['%Y-%m-%d', '%d/%m/%Y']) is not null")),
    (Rule("balance", "Validity", "Numeric Range", {"range_min": 0, "range_max": 5000}), "Numeric Range [0.0–5000.0]", _IF, "Between 0.0 and 5000.0", _skip("balance", f"regexp_matches(lower(trim(balance)), '{_NUM}') and try_cast(trim(balance) as double) between 0 and 5000")),
    (Rule("segment", "Validity", "Allowed Values", {"allowed_values_str": "BUILDING, machinery"}), "Allowed Values", _IF, "One of: BUILDING, machinery", _skip("segment", "lower(trim(segment)) in ('building', 'machinery')")),
    (Rule("cust_id", "Validity", "Custom Regex", {"regex": "[1-9][0-9]*[02468]"}), "Regex: [1-9][0-9]*[02468]", _IF, "Matches: [1-9][0-9]*[02468]", _skip("cust_id", _full("cust_id", "[1-9][0-9]*[02468]"))),
    (Rule("cust_id", "Validity", "Custom Regex", {"regex": "(["}), "Regex: ([", _IF, "Matches: ([", "true"),
    (Rule("name", "Validity", "Special Characters Not Allowed"), "Special Characters Not Allowed", _IF, "Alphanumeric + spaces only", "regexp_matches(name, '^[a-zA-Z0-9\\s]+$')"),
    (Rule("email", "Validity", "Length Check", {"max_length_val": 19}), "Length Check (max 19)", _IF, "Length ≤ 19", "length(email) <= 19"),
    (Rule("segment", "Validity", "Format Check", {"format_pattern": "[A-H]"}), "Format Check ([A-H])", _IF, "Expected format: [A-H]", "regexp_matches(segment, '^[A-H]')"),
    (Rule("name", "Standardization", "Special Characters Not Allowed"), "Special Characters Not Allowed", _NS, "Alphanumeric + spaces only", "regexp_matches(name, '^[a-zA-Z0-9\\s]+$')"),
]
RULES = [c[0] for c in CHECKS]
#: (rule, label, SQL of the new value, SQL of the change or None)
CHAIN = [
    (Rule("name", "Standardization", "Remove Extra Spaces"), "Remove Extra Spaces", "regexp_replace(trim({c}), '\\s+', ' ', 'g')", None),
    (Rule("name", "Standardization", "Convert to Uppercase"), "Convert to Uppercase", "upper(trim({c}))", None),
    (Rule("name", "Standardization", "Remove Special Characters"), "Remove Special Characters", "trim(regexp_replace({c}, '[^a-zA-Z0-9\\s]', '', 'g'))", None),
    (Rule("email", "Standardization", "Trim Spaces"), "Trim Spaces", "trim({c})", None),
    (Rule("email", "Standardization", "Replace Null with Default", {"null_default": "none given"}), "Replace Null → none given", "case when coalesce(lower(trim({c})) in ('', 'nan', 'none'), true) then 'none given' else trim({c}) end", "coalesce(lower(trim({c})) in ('', 'nan', 'none'), true)"),
    (Rule("segment", "Standardization", "Convert to Lowercase"), "Convert to Lowercase", "lower(trim({c}))", None),
    (Rule("since", "Standardization", "Normalize Date Format", {"date_target_fmt": "%d-%m-%Y"}), "Normalize Date (%d-%m-%Y)", "coalesce(strftime(try_strptime(trim({c}), ['%Y-%m-%d', '%d/%m/%Y']), '%d-%m-%Y'), {c})", None),
]


def _checks(df):
    return plan(RULES, df.columns)


def _issues(spark, d):
    df = dirty(spark, d)
    return df, assess.issues(df, _checks(df), F.col("rn"))


def _log(spark, d, dimensions=("Completeness", "Validity", "Standardization")):
    df = dirty(spark, d)
    return assess.log(df, [c for c in _checks(df) if c.dimension in dimensions])


def completeness_log(spark, d):
    return _log(spark, d, ("Completeness",))


def validity_log(spark, d):
    return _log(spark, d, ("Validity",))


def completeness_annexure(spark, d):
    return _issues(spark, d)[1].where("Dimension = 'Completeness'").drop("_ord")


def validity_annexure(spark, d):
    return _issues(spark, d)[1].where("Dimension <> 'Completeness'").drop("_ord")


def std_chain(spark, d):
    df = dirty(spark, d)
    return assess.issues(df, standardize([c[0] for c in CHAIN], df.columns)[0], F.col("rn")).drop("_ord")


def std_dataset(spark, d):
    df = dirty(spark, d)
    return assess.cleaned(df, standardize([c[0] for c in CHAIN], df.columns)[1])


def dim_scores(spark, d):
    return assess.dimension_scores(_log(spark, d))


def overall_score(spark, d):
    return assess.overall(dim_scores(spark, d))


def column_annexure(spark, d):
    return report.by_column(_issues(spark, d)[1])


def row_issue_map(spark, d):
    return report.by_row(_issues(spark, d)[1])


def annexure_groups(spark, d):
    return report.groups(_issues(spark, d)[1])


def report_summary(spark, d):
    return report.summary(report.groups(_issues(spark, d)[1]))


def report_mismatches(spark, d):
    """An annexure list made before the last column's issues were found, held against all issues."""
    i = _issues(spark, d)[1]
    return report.mismatches(report.groups(i.where("Column_Name <> 'phone' and not (Rule_Applied = 'Not Null' and Column_Name = 'since')")), i).select("annexure_no", "rule_label", "row_count", F.col("_n").alias("rows_now"))


def whitespace_annexure(spark, d):
    """Whitespace Only, any text, and Proper Case."""
    df = dirty(spark, d)
    checks = plan([Rule("email", "Completeness", "Whitespace Only"), Rule("email", "Validity", "Data Type Validation", {"data_type": "string"})], df.columns)
    return assess.issues(df, checks + standardize([Rule("name", "Standardization", "Convert to Proper Case")], df.columns)[0], F.col("rn")).drop("_ord")


def _whole_log(spark, d):
    from loamgrid.operators import uniqueness
    from loamgrid.queries.duplicates import _plan

    df = dirty(spark, d)
    records, _ = uniqueness.duplicates(df, _plan(), F.col("rn"))
    return _log(spark, d).unionByName(uniqueness.log(records, df.count()))


def whole_scores(spark, d):
    """The scores of all four dimensions."""
    return assess.dimension_scores(_whole_log(spark, d))


def whole_overall(spark, d):
    return assess.overall(whole_scores(spark, d))


def invalid_rows(spark, d):
    df, i = _issues(spark, d)
    return report.unique_rows(i, df.count())


def dashboard(spark, d):
    df, i = _issues(spark, d)
    return report.dashboard(i, _log(spark, d), df.count())


def report_tables(spark, d):
    """Name and rows of each table of the full report."""
    from loamgrid.operators import uniqueness
    from loamgrid.queries.duplicates import _plan

    df, i = _issues(spark, d)
    records, _ = uniqueness.duplicates(df, _plan(), F.col("rn"))
    out = None
    for name, t in report.full_set(df, i, records, F.col("rn")).items():
        one = t.agg(F.lit(name).alias("sheet"), F.count(F.lit(1)).alias("n_rows"))
        out = one if out is None else out.unionByName(one)
    return out


def annexures_with_duplicates(spark, d):
    from loamgrid.operators import exact

    df, i = _issues(spark, d)
    return report.groups(i, exact.single(df, "email", F.col("rn")))


def duplicates_sheet(spark, d):
    from loamgrid.operators import uniqueness
    from loamgrid.queries.duplicates import _plan

    df, i = _issues(spark, d)
    records, _ = uniqueness.duplicates(df, _plan(), F.col("rn"))
    return report.duplicates_sheet(df, records, i, F.col("rn")).select("Row_Number", "Duplicate_Type", "Duplicate_Group_ID", "email", "Issues", "Count_of_issues")


def clean_two_columns(spark, d):
    """Groups of two columns, whose numbers collide."""
    from loamgrid.operators import exact

    df, i = _issues(spark, d)
    return report.clean_set(df, exact.multi_single(df, ["email", "phone"], F.col("rn")), i, F.col("rn")).select("Row_Number", "email", "phone", "Issue_Flag")


def results_sheet(spark, d):
    df, i = _issues(spark, d)
    return report.results(df, i, F.col("rn")).drop("rn")


def rule_annexure(spark, d):
    df, i = _issues(spark, d)
    return report.members(df, i, F.col("rn"), "Email Format").select("Row_Number", "Issues", "Count_of_issues", "Issue_categories")


def issue_classification(spark, d):
    return report.classified(_issues(spark, d)[1])


def dimension_breakdown(spark, d):
    return report.by_dimension(_issues(spark, d)[1])


def rule_failure_summary(spark, d):
    df, i = _issues(spark, d)
    return report.by_rule(i, df.count())


def column_profile_sheet(spark, d):
    df = dirty(spark, d)
    return report.column_sheet([c for c in df.columns if c != "rn"], _log(spark, d))


def scorecard(spark, d):
    return dim_scores(spark, d).withColumn("Status", report.status(F.col("Score"))).withColumn("Band", report.band(F.col("Score")))


def clean_dataset(spark, d):
    from loamgrid.operators import exact

    df, i = _issues(spark, d)
    dup = exact.merged([exact.single(df, "email", F.col("rn")), exact.combination(df, ["pan", "segment"], F.col("rn"))])
    return report.clean_set(df, dup, i, F.col("rn")).select("Row_Number", "cust_id", "email", "Issue_Flag")


def safe_values(spark, d):
    return report.safe_values(dirty(spark, d))


def _esc(s: str) -> str:
    return s.replace("'", "''")


_ISSUES = f"with dv as ({DV}), i as (" + " union all ".join(
    f"select rn Row_Number, {k} _ord, '{r.column}' Column_Name, '{_esc(label)}' Rule_Applied, '{issue}' Issue_Type, {r.column} Original_Value, '{_esc(exp)}' Expected_Value, '{r.dimension}' Dimension from dv where not ({ok})"
    for k, (r, label, issue, exp, ok) in enumerate(CHECKS)
) + ")"
_SEV = "case when Score < 50 then 'Critical' when Score < 70 then 'High' when Score < 85 then 'Medium' when Score < 95 then 'Low' else 'Pass' end"
_LOGS = f"dv0 as ({DV}), l0 as (" + " union all ".join(
    f"select '{r.dimension}' Dimension, '{r.column}' \"Column\", '{_esc(label)}' Rule, count(*) Evaluated, count(*) filter (where not ({ok})) Failed, '{issue}' Issue_Type from dv0" for r, label, issue, _, ok in CHECKS
) + "), l as (select *, Evaluated - Failed Passed, round_even((Evaluated - Failed) / Evaluated * 100, 2) Score from l0)"
_LOGQ = f"with {_LOGS} select Dimension, \"Column\", Rule, Evaluated, Failed, Passed, Score, {_SEV} Severity, Issue_Type from l where Dimension = " + "'{}'"
_DIM = f"with {_LOGS}, s as (select Dimension, greatest(0.0, round_even((sum(Evaluated) - sum(Failed)) / sum(Evaluated) * 100, 2)) Score from l group by 1)"
_COLS = "Row_Number, Column_Name, Rule_Applied, Issue_Type, Original_Value, Expected_Value, Dimension"
_MAP = ", f as (select Row_Number, Rule_Applied, min(_ord) o, min(Dimension) Dimension from i group by 1, 2), m as (select Row_Number, string_agg(Rule_Applied, '; ' order by o) Issues, count(*) Count_of_issues, string_agg(distinct Dimension, ', ' order by Dimension) Issue_categories from f group by 1)"
_GROUPS = ", g as (select row_number() over (order by count(distinct Row_Number) desc, min(_ord)) annexure_no, Rule_Applied rule_label, count(distinct Row_Number) row_count, false is_duplicate from i group by Rule_Applied)"


def _chain_sql() -> tuple[str, str]:
    """Issues of the chained transforms, and the final columns."""
    now, parts = {}, []
    for r, label, new, changed in CHAIN:
        c = now.get(r.column, r.column)
        value = new.format(c=f"({c})")
        cond = changed.format(c=f"({c})") if changed else f"({value}) <> ({c})"
        parts.append(f"select rn Row_Number, '{r.column}' Column_Name, '{_esc(label)}' Rule_Applied, '{_NS}' Issue_Type, {c} Original_Value, {value} Expected_Value, 'Standardization' Dimension from dv where {cond}")
        now[r.column] = value
    return " union all ".join(parts), ", ".join(f"{now.get(c, c)} {c}" for c in ("rn", "cust_id", "name", "email", "phone", "pan", "balance", "since", "segment"))


def _grouped_sql(c: str, key: str, cond: str, kind: str, o: int) -> str:
    return f"select rn Row_Number, {o} o, {c} c, dense_rank() over (order by f) g, '{kind}' t from (select *, count(*) over (partition by k) n, min(rn) over (partition by k) f from (select *, {key} k from dvu where {cond})) where n > 1"


_UNIQ = f"dvu as ({DV}), ux as (" + " union all ".join([_grouped_sql(f"'{c}'", f"lower(trim({c}))", f"not {_NULLISH.format(c=c)}", "Exact", 0) for c in ("email", "phone")] + [_grouped_sql("null", "struct_pack(a := lower(trim(pan)), b := lower(trim(segment)))", "true", "Combination", 1)]) + "), uu as (select (select count(*) from dvu) n, (select count(distinct Row_Number) from ux) k)"
_CHAIN, _FINAL = _chain_sql()
_CAT = "case " + " ".join(f"when starts_with(Rule_Applied, '{s}') then '{cat}'" for cat, starts in reversed(report.CATEGORIES.items()) for s in reversed(starts)) + " else 'Invalid Format' end"
SQL = {
    "completeness_log": _LOGQ.replace('{}', 'Completeness'),
    "validity_log": _LOGQ.replace('{}', 'Validity'),
    "completeness_annexure": f"{_ISSUES} select {_COLS} from i where Dimension = 'Completeness'",
    "validity_annexure": f"{_ISSUES} select {_COLS} from i where Dimension <> 'Completeness'",
    "std_chain": f"with dv as ({DV}) {_CHAIN}",
    "std_dataset": f"with dv as ({DV}) select {_FINAL} from dv",
    "dim_scores": f"{_DIM} select * from s",
    "overall_score": f"{_DIM} select round_even(avg(Score), 2) Overall from s",
    "column_annexure": f"{_ISSUES} select Column_Name, count(*) Issue_Count, string_agg(distinct Rule_Applied, ' | ' order by Rule_Applied) Failed_Rules, string_agg(distinct Issue_Type, ' | ' order by Issue_Type) Issue_Types, string_agg(distinct Dimension, ' | ' order by Dimension) Dimensions from i group by 1",
    "row_issue_map": f"{_ISSUES} {_MAP} select * from m",
    "annexure_groups": f"{_ISSUES} {_GROUPS} select * from g",
    "report_summary": f"{_ISSUES} {_GROUPS} select 'Annexure ' || annexure_no S_No, rule_label Particulars, row_count Total_Records from g",
    "report_mismatches": f"{_ISSUES}, h as (select row_number() over (order by count(distinct Row_Number) desc, min(_ord)) annexure_no, Rule_Applied rule_label, count(distinct Row_Number) row_count from i where Column_Name <> 'phone' and not (Rule_Applied = 'Not Null' and Column_Name = 'since') group by 2), k as (select Rule_Applied, count(distinct Row_Number) rows_now from i group by 1) select annexure_no, rule_label, row_count, rows_now from h left join k on Rule_Applied = rule_label where rows_now is distinct from row_count",
    "whitespace_annexure": f"with dv as ({DV}) select rn Row_Number, 'email' Column_Name, 'Whitespace Only' Rule_Applied, '{_MV}' Issue_Type, chr(39) || email || chr(39) Original_Value, 'Non-whitespace value' Expected_Value, 'Completeness' Dimension from dv where regexp_full_match(email, '\\s+') union all select * from (select rn, 'name', 'Convert to Proper Case', '{_NS}', name, array_to_string(list_transform(regexp_extract_all(trim(name), '[A-Za-z]+|[^A-Za-z]+'), lambda x: upper(x[1]) || lower(x[2:])), '') e, 'Standardization' from dv) where e <> name",
    "whole_scores": f"{_DIM}, {_UNIQ} select * from s union all select 'Uniqueness', round_even((n - k) / n * 100, 2) from uu",
    "whole_overall": f"{_DIM}, {_UNIQ} select round_even(avg(Score), 2) Overall from (select Score from s union all select round_even((n - k) / n * 100, 2) from uu)",
    "invalid_rows": f"{_ISSUES} select count(distinct Row_Number) unique_rows from i",
    "dashboard": f"{_ISSUES}, {_LOGS}, q as (select (select count(*) from dv) n, (select count(distinct Row_Number) from i) b) select n - b clean_rows, b issue_rows, (select count(*) from (select 1 from l group by \"Column\" having sum(Failed) = 0)) perfect_columns from q",
    "report_tables": f"{_ISSUES} {_MAP}{_GROUPS}, {_UNIQ.replace('with', '')} select 'Results' sheet, count(*) n_rows from m union all select 'Annexure ' || annexure_no, row_count from g union all select x, k from uu, (select unnest(['Annexure ' || (select count(*) + 1 from g), 'Duplicates']) x) union all select 'Summary', count(*) + 1 from g",
    "annexures_with_duplicates": f"{_ISSUES} {_GROUPS}, e as (select count(*) over (partition by lower(trim(email))) n from dv where not {_NULLISH.format(c='email')}) select * from g union all select (select count(*) + 1 from g), 'Duplicates', count(*), true from e where n > 1",
    "duplicates_sheet": f"{_ISSUES} {_MAP}, {_UNIQ} select Row_Number, t Duplicate_Type, g Duplicate_Group_ID, email, Issues, Count_of_issues from (select *, row_number() over (partition by Row_Number order by o, c) w from ux) join dv on rn = Row_Number left join m using (Row_Number) where w = 1",
    "clean_two_columns": f"""{_ISSUES}, e as (select rn, k, count(*) over (partition by c, k) n, min(rn) over (partition by c, k) m from (select rn, 1 c, lower(trim(email)) k from dv where not {_NULLISH.format(c='email')} union all select rn, 2, lower(trim(phone)) from dv where not {_NULLISH.format(c='phone')})),
 x as (select rn, bool_or(rn = m) lead from e where n > 1 group by rn)
 select rn Row_Number, email, phone, case when rn in (select rn from x) or rn in (select Row_Number from i) then 'Yes' else 'No' end Issue_Flag from dv where rn not in (select rn from x where not lead)""",
    "results_sheet": f"{_ISSUES} {_MAP} select m.*, dv.* exclude (rn) from m join dv on rn = Row_Number",
    "rule_annexure": f"{_ISSUES} {_MAP} select * from m where Row_Number in (select Row_Number from i where Rule_Applied = 'Email Format')",
    "issue_classification": f"{_ISSUES}, k as (select {_CAT} category, count(*) n_issues, count(distinct Row_Number) unique_rows, string_agg(distinct Rule_Applied, ' | ' order by Rule_Applied) rules from i group by 1) select *, case when unique_rows > 500 or n_issues > 1000 then 'HIGH' when unique_rows > 100 or n_issues > 200 then 'MEDIUM' else 'LOW' end severity from k",
    "dimension_breakdown": f"{_ISSUES} select Dimension, count(*) n_issues, count(distinct Row_Number) n_rows, count(distinct Rule_Applied) n_rules from i group by 1",
    "rule_failure_summary": f"{_ISSUES} select Rule_Applied, Dimension, Issue_Type, count(*) n_failed, round_even(count(*) / (select count(*) from dv) * 100, 2) pct from i group by 1, 2, 3",
    "column_profile_sheet": f"with {_LOGS}, p as (select \"Column\" c, " + ", ".join(f"round_even((1 - sum(Failed) filter (where Dimension = '{x}') / sum(Evaluated) filter (where Dimension = '{x}')) * 100, 2) {x}" for x in ("Completeness", "Validity", "Standardization"))
    + ", sum(Failed) n_failed from l group by 1), w as (select x.c \"Column\", Completeness, Validity, Standardization, coalesce(n_failed, 0) n_failed, least(Completeness, Validity, Standardization) worst from (select unnest(['cust_id','name','email','phone','pan','balance','since','segment']) c) x left join p on p.c = x.c) select *, case when worst is null or worst > 95 then 'Low' when worst >= 85 then 'Medium' else 'High' end severity from w",
    "scorecard": f"{_DIM} select *, case when Score > 95 then 'Good' when Score >= 85 then 'Moderate' else 'Needs Improvement' end Status, case when Score >= 80 then 'Good' when Score >= 60 then 'Fair' when Score >= 40 then 'Poor' else 'Critical' end Band from s",
    "clean_dataset": f"""{_ISSUES}, e as (select rn, lower(trim(email)) k, count(*) over (partition by lower(trim(email))) n, min(rn) over (partition by lower(trim(email))) m from dv where not {_NULLISH.format(c='email')}),
 c as (select rn, count(*) over (partition by lower(trim(pan)), lower(trim(segment))) n, min(rn) over (partition by lower(trim(pan)), lower(trim(segment))) m from dv),
 e2 as (select rn, m from e where n > 1), c2 as (select rn, case when rn in (select rn from e2) then null else m end m from c where n > 1),
 c3 as (select c2.rn, (select min(x.rn) from c2 x join c y on x.rn = y.rn where x.m is not null and y.m = c2.m) m from c2 where m is not null),
 drops as (select rn from e2 where rn > m union select rn from c3 where rn > m), bad as (select rn from e2 union select rn from c2 union select Row_Number from i)
 select rn Row_Number, cust_id, email, case when rn in (select rn from bad) then 'Yes' else 'No' end Issue_Flag from dv where rn not in (select rn from drops)""",
    "safe_values": f"with dv as ({DV}) select cast(rn as varchar) rn, * exclude (rn) from dv",
}
QUERIES = {k: globals()[k] for k in SQL}
