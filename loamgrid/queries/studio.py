"""Queries on the studio profile, survivorship and weighted ratings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgrid.operators import exact, ratings, studio
from loamgrid.queries.dirty import SQL as DV
from loamgrid.queries.dirty import dirty
from loamgrid.session import table

CHECKS = [
    ("email", "not_null", ""), ("email", "email_format", ""), ("balance", "numeric_only", ""), ("since", "date_format", ""), ("cust_id", "regex_pattern", "[1-4]"), ("segment", "allowed_values", "building, machinery"), ("segment", "allowed_values", ""),
    ("balance", "range_check", "0,5000"), ("balance", "range_check", "x"), ("email", "trim_spaces", ""), ("name", "mixed_case", ""), ("name", "special_chars", ""), ("name", "no_such_rule", ""),
]


def studio_rules(spark, d):
    return studio.rules(dirty(spark, d), CHECKS)


def studio_group_rules(spark, d):
    """The rules that need more than a row, by their names."""
    checks = [("email", "min_fill_pct", "90"), ("phone", "min_fill_pct", ""), ("email", "unique_values", ""), ("segment", "unique_combo", "segment, since"), ("segment", "unique_combo", "segment"), ("segment", "fuzzy_dups", ""), ("phone", "fuzzy_dups", "100")]
    return studio.rules(dirty(spark, d), checks)


def studio_failing(spark, d):
    return studio.failing(dirty(spark, d), CHECKS, F.col("rn"))


def studio_fill_rate(spark, d):
    df = dirty(spark, d)
    return studio.fill_rate(df, "email", 90).unionByName(studio.fill_rate(df, "phone", 80))


def studio_unique(spark, d):
    return studio.unique_values(dirty(spark, d), ["email"]).unionByName(studio.unique_values(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], blanks_count=True))


def studio_overall(spark, d):
    return studio.overall(studio.rules(dirty(spark, d), CHECKS[:6]))


def profile_columns(spark, d):
    return studio.profile(dirty(spark, d).drop("rn"))


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")


def studio_duplicates(spark, d):
    return exact.studio(_events(spark, d), ["user_id", "event_type"], F.col("event_id"), "ts").drop("_row_id")


def _golden(spark, d, strategy):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts", F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("value"), F.concat(F.lit("s"), (F.col("event_id") % 4).cast("string")).alias("source"))
    return studio.golden(exact.studio(e, ["user_id", "event_type"], F.col("event_id"), "ts"), strategy).where("_golden").select("event_id", "_dup_count")


def golden_complete(spark, d):
    return _golden(spark, d, "Most Complete")


def golden_recent(spark, d):
    return _golden(spark, d, "Most Recent")


def golden_frequent(spark, d):
    return _golden(spark, d, "Most Frequent")


def golden_source(spark, d):
    return _golden(spark, d, "Source Priority")


def golden_first(spark, d):
    return _golden(spark, d, "Manual Selection")


def golden_discards(spark, d):
    return studio.golden(exact.studio(_events(spark, d), ["user_id", "event_type"], F.col("event_id"), "ts"), "Most Recent").where("not _golden").select("event_id")


def dup_kpis(spark, d):
    return studio.kpis(exact.studio(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey", "o_orderdate"], F.col("o_orderkey")))


def studio_mostly_unique(spark, d):
    """Orders by customer and day: hardly a row has a duplicate."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return exact.studio(o, ["o_custkey", "o_orderdate"], F.col("o_orderkey"), "o_orderdate").select("o_orderkey", "_dup_group_id", "_dup_count", "_recency_rank")


def match_types(spark, d):
    return studio.match_types(exact.studio(_events(spark, d), ["user_id", "event_type"], F.col("event_id")))


def top_groups(spark, d):
    return studio.top_groups(exact.studio(_events(spark, d), ["user_id", "event_type"], F.col("event_id")))


def score_histogram(spark, d):
    return studio.score_histogram(table(spark, d, "duplicate_records").where("_score is not null").select((F.col("_score") / 100).alias("s")), "s")


#: The labels of ratings as the vendor master's statuses and customers' balances give them.
_RATED = "case when {c} is null then null when {c} % 7 = 0 then 'none' else element_at(array('Adhoc', 'Repeatable', 'Defined', 'Managed', 'Optimised'), cast({c} % 5 + 1 as int)) end"


def _responses(spark, d):
    """Each order as a question with ratings of two objects, some of them unknown, and weights down to zero."""
    keys = {"customer": "o_orderkey", "vendor": "o_custkey"}
    return table(spark, d, "orders").selectExpr("o_orderpriority as dimension", "o_orderkey as question_id", "cast(o_custkey % 4 as double) as weight", *(f"{_RATED.format(c=c)} as {o}" for o, c in keys.items()), "o_orderstatus as note")


def _long(spark, d):
    return ratings.long_form(_responses(spark, d), ["customer", "vendor"])


def ratings_dimension(spark, d):
    return ratings.dimension_scores(_long(spark, d)).withColumn("score", F.bround("score", 6))


def ratings_overall(spark, d):
    return ratings.overall(ratings.dimension_scores(_long(spark, d))).withColumn("overall", F.bround("overall", 6))


def ratings_mean(spark, d):
    return ratings.mean_of_means(ratings.dimension_scores(_long(spark, d))).withColumn("overall", F.bround("overall", 6))


def ratings_exceptions(spark, d):
    return ratings.exceptions(_long(spark, d))


def ratings_invalid(spark, d):
    return ratings.invalid(_long(spark, d))


def ratings_upsert(spark, d):
    """New answers for one third of the questions, and questions that are new; the note stays."""
    new = table(spark, d, "orders").selectExpr("case when o_orderkey % 3 = 0 then o_orderkey else -o_orderkey end as question_id", "case when o_orderkey % 2 = 0 then 9.0D end as weight", "'Managed' as customer")
    return ratings.upsert(_responses(spark, d).drop("vendor"), new, "question_id", ["weight", "customer"])


def ratings_template(spark, d):
    raw = _responses(spark, d).withColumn("weight", F.when(F.col("weight") > 0, F.col("weight").cast("string")).otherwise("heavy"))
    return ratings.from_template(raw, ["customer", "vendor"])


def score_levels(spark, d):
    return table(spark, d, "customer").select("c_custkey", ratings.level(F.col("c_acctbal") / 100).alias("level"))


_F = "coalesce(trim({c}) <> '', false)"
_NUM = "^\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)\\s*$"
_IS_DATE = "try_strptime(trim(since), ['%Y-%m-%d', '%m/%d/%Y']) is not null"
_RULES_SQL = [
    ("email", "not_null", "true", f"not {_F.format(c='email')} or lower(trim(email)) = 'nan'"), ("email", "email_format", "email is not null", "not regexp_full_match(email, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}')"),
    ("balance", "numeric_only", _F.format(c="balance"), f"{_F.format(c='balance')} and not regexp_full_match(regexp_replace(balance, '[,.\\-+\\s]', '', 'g'), '[0-9]+')"), ("since", "date_format", _F.format(c="since"), f"{_F.format(c='since')} and not ({_IS_DATE})"),
    ("cust_id", "regex_pattern", _F.format(c="cust_id"), "not regexp_matches(cust_id, '^[1-4]')"), ("segment", "allowed_values", _F.format(c="segment"), "lower(trim(segment)) not in ('building', 'machinery')"), ("segment", "allowed_values", _F.format(c="segment"), "false"),
    ("balance", "range_check", f"regexp_matches(balance, '{_NUM}')", f"regexp_matches(balance, '{_NUM}') and not (try_cast(balance as double) between 0 and 5000)"), ("balance", "range_check", f"regexp_matches(balance, '{_NUM}')", f"regexp_matches(balance, '{_NUM}') and not (try_cast(balance as double) between 0 and 999999)"),
    ("email", "trim_spaces", _F.format(c="email"), f"{_F.format(c='email')} and email <> trim(email)"), ("name", "mixed_case", _F.format(c="name"), "not (upper(name) = name or lower(name) = name or regexp_matches(name, '^[^A-Za-z]*([A-Z][a-z]*[^A-Za-z]*)*$'))"),
    ("name", "special_chars", _F.format(c="name"), "regexp_matches(name, '[^\\w\\s@.+\\-]')"), ("name", "no_such_rule", "true", "false"),
]


def _rules_sql(n: int) -> str:
    return " union all ".join(f"select '{c}' \"column\", '{r}' rule, count(*) filter (where {f}) fail_count, count(*) - count(*) filter (where {f}) pass_count, round_even((1 - count(*) filter (where {f}) / greatest(count(*) filter (where {d}), 1)) * 100, 2) score from dv" for c, r, d, f in _RULES_SQL[:n])


_EV = "with e as (select event_id, user_id, event_type, ts{x} from events), s as (select *, count(*) over (partition by user_id, event_type) n, min(event_id) over (partition by user_id, event_type) f from e)"
_EVX = _EV.replace("{x}", ", case when event_id % 3 > 0 then value end value, 's' || (event_id % 4) source")
_EV0 = _EV.replace("{x}", "")
_SQLRATED = "case when {c} is null then null when {c} % 7 = 0 then 'none' else (['Adhoc', 'Repeatable', 'Defined', 'Managed', 'Optimised'])[{c} % 5 + 1] end"
_ASKED = f"r as (select o_orderpriority dimension, o_orderkey question_id, (o_custkey % 4)::double weight, {_SQLRATED.format(c='o_orderkey')} customer, {_SQLRATED.format(c='o_custkey')} vendor, o_orderstatus note from orders)"
_LONG = f"with {_ASKED}, l as (select dimension, question_id, weight, 'customer' object, customer rating from r union all select dimension, question_id, weight, 'vendor', vendor from r), k as (select *, nullif(list_position(['Adhoc','Repeatable','Defined','Managed','Optimised'], rating), 0) s from l), q as (select dimension, object, sum(weight * s) filter (where weight > 0) / sum(weight) filter (where weight > 0 and s is not null) score from k group by 1, 2)"


def _win(order: str) -> str:
    return f"{_EVX} select event_id, case when n > 1 then n else 0 end _dup_count from (select *, row_number() over (partition by user_id, event_type order by {order}) w from s) where n = 1 or w = 1"


SQL = {
    "studio_rules": f"with dv as ({DV}) select * from ({_rules_sql(99)})",
    "studio_fill_rate": f"with dv as ({DV}), p as (" + " union all ".join(f"select '{c}' \"column\", {t} t, count(*) n, count(*) filter (where {_F.format(c=c)}) f from dv" for c, t in (("email", 90), ("phone", 80))) + "), q as (select *, round_even(f / n * 100, 2) score from p) select \"column\", 'min_fill_pct' rule, case when score >= t then 0 else n - f end fail_count, n - case when score >= t then 0 else n - f end pass_count, score from q",
    "studio_unique": f"with dv as ({DV}), a as (select email, count(*) n from dv group by 1), b as (select count(*) n from lineitem group by l_orderkey, l_linenumber) select 'email' \"column\", 'unique_values' rule, sum(n) filter (where trim(email) <> '' and n > 1) fail_count, sum(n) - sum(n) filter (where trim(email) <> '' and n > 1) pass_count, round_even((1 - sum(n) filter (where trim(email) <> '' and n > 1) / sum(n) filter (where trim(email) <> '')) * 100, 2) score from a union all select 'l_orderkey + l_linenumber', 'unique_combo', sum(n) filter (where n > 1), sum(n) - sum(n) filter (where n > 1), round(cast((1 - sum(n) filter (where n > 1) / sum(n)) * 100 as decimal(30, 20)), 2)::double from b",
    "studio_overall": f"with dv as ({DV}), r as ({_rules_sql(6)}) select round_even(avg(score), 2) overall, case when round_even(avg(score), 2) >= 80 then 'Good' when round_even(avg(score), 2) >= 60 then 'Fair' else 'Poor' end rating from r",
    "profile_columns": f"with dv as ({DV}), p as (" + " union all ".join(f"select '{c}' \"Column\", count(*) n, count(distinct nullif(nullif(lower(trim({c})), ''), 'nan')) \"Cardinality\", count(*) filter (where coalesce(lower(trim({c})), '') in ('', 'nan')) e from dv" for c in ("cust_id", "name", "email", "phone", "pan", "balance", "since", "segment")) + ") select \"Column\", \"Cardinality\", round_even(\"Cardinality\" / n * 100, 1) \"Uniqueness_pct\", round_even(e / n * 100, 1) \"Empty_pct\", case when \"Cardinality\" / n * 100 >= 90 and e / n * 100 < 5 then 'Strong' when \"Cardinality\" / n * 100 >= 50 and e / n * 100 < 20 then 'Medium' else 'Weak' end \"Recommendation\" from p",
    "studio_duplicates": f"{_EV0}, g as (select *, dense_rank() over (order by n desc, f) k, row_number() over (partition by user_id, event_type order by ts desc nulls last, event_id) w from s where n > 1), u as (select *, 0 k, 0 w from s where n = 1) select event_id, user_id, event_type, ts, case when n > 1 then 'DG-' || case when k < 1000 then lpad(k::varchar, 4, '0') else k::varchar end end _dup_group_id, n > 1 _is_duplicate, case when n > 1 then n else 0 end _dup_count, case when n > 1 then 'Exact' else '' end _match_type, case when n > 1 then 1.0::double else 0.0 end _similarity_score, 100.0::double _completeness, w _recency_rank from (select * from g union all select * from u)",
    "golden_complete": _win("case when value is null then 1 else 0 end, event_id"),
    "golden_recent": _win("ts desc nulls last, event_id"),
    "golden_source": _win("source, event_id"),
    "golden_first": _win("event_id"),
    "golden_discards": f"{_EV0} select event_id from (select *, row_number() over (partition by user_id, event_type order by ts desc nulls last, event_id) w from s) where w > 1",
    "dup_kpis": "with s as (select count(*) over (partition by o_custkey, o_orderdate) n, o_custkey, o_orderdate from orders) select count(*) total, count(*) filter (where n > 1) duplicate_rows, count(distinct struct_pack(a := o_custkey, b := o_orderdate)) filter (where n > 1) \"groups\", count(*) filter (where n = 1) unique_rows, 0::bigint fuzzy_rows from s",
    "top_groups": f"{_EV0}, g as (select n, f, row_number() over (order by n desc, f) k from (select distinct n, f from s where n > 1)) select 'DG-' || lpad(k::varchar, 4, '0') _dup_group_id, n n_rows from g order by n_rows desc, _dup_group_id limit 20",
    "score_histogram": "select least(floor(_score / 10.0)::bigint + 1, 10) bin, count(*) n_rows from duplicate_records where _score is not null group by 1",
    "ratings_dimension": f"{_LONG} select dimension, object, round_even(score, 6) score from q",
    "ratings_overall": f"{_LONG} select object, round_even(avg(score), 6) overall from q group by 1",
    "ratings_mean": f"{_LONG}, z as (select avg(a) a from (select avg(score) a from q group by object)) select round_even(a, 6) overall, case when a >= 4.75 then 'Optimised' when a >= 4 then 'Managed' when a >= 3 then 'Defined' when a >= 2 then 'Repeatable' else 'Adhoc' end \"level\" from z",
    "ratings_template": f"with {_ASKED} select dimension, question_id, case when weight > 0 then weight else 1.0 end weight, case when coalesce(customer, 'none') = 'none' then 'Adhoc' else customer end customer, case when coalesce(vendor, 'none') = 'none' then 'Adhoc' else vendor end vendor from r",
    "ratings_exceptions": f"{_LONG} select dimension, question_id, weight, object, rating, s score from k where s <= 2",
    "ratings_invalid": f"{_LONG} select dimension, question_id, weight, object, rating from k where s is null",
    "ratings_upsert": f"with {_ASKED}, n as (select case when o_orderkey % 3 = 0 then o_orderkey else -o_orderkey end question_id, case when o_orderkey % 2 = 0 then 9.0::double end weight, 'Managed' customer from orders) select coalesce(n.question_id, r.question_id) question_id, coalesce(n.weight, r.weight) weight, coalesce(n.customer, r.customer) customer, r.dimension, r.note from r full join n on r.question_id = n.question_id",
    "golden_frequent": _win("case when value is null then 1 else 0 end, event_id"),
    "studio_group_rules": f"with dv as ({DV}), t as (select count(*) n, count(*) filter (where {_F.format(c='email')}) e, count(*) filter (where {_F.format(c='phone')}) p from dv), "
    + "q as (select 'email' \"column\", 'min_fill_pct' rule, n, case when round_even(e / n * 100, 2) >= 90 then 0 else n - e end f, round_even(e / n * 100, 2) score from t union all select 'phone', 'min_fill_pct', n, case when round_even(p / n * 100, 2) >= 90 then 0 else n - p end, round_even(p / n * 100, 2) from t union all "
    + "select 'segment', 'unique_combo', n, 0, 100.0 from t union all "
    + f"select 'email', 'unique_values', n, f, round_even((1 - f / e) * 100, 2) from t, (select coalesce(sum(k), 0) f from (select count(*) k from dv where {_F.format(c='email')} group by email having count(*) > 1)) union all "
    + "select 'segment', 'unique_combo', n, f, round_even((1 - f / n) * 100, 2) from t, (select coalesce(sum(k), 0) f from (select count(*) k from dv group by segment, since having count(*) > 1)) union all "
    + f"select c, 'fuzzy_dups', n, f, round_even((1 - f / greatest(g, 1)) * 100, 2) from t, (select 'segment' c, coalesce(sum(k) filter (where k > 1), 0) f, sum(k) g from (select count(*) k from dv where {_F.format(c='segment')} group by lower(trim(segment))) union all select 'phone', coalesce(sum(k) filter (where k > 1), 0), sum(k) from (select count(*) k from dv where {_F.format(c='phone')} group by lower(trim(phone)))))"
    + " select \"column\", rule, f::bigint fail_count, (n - f)::bigint pass_count, score from q",
    "studio_failing": f"with dv as ({DV}) " + " union all ".join(f"select rn Row_Number, '{c}' \"column\", '{r}' rule, {c} \"value\" from dv where {f}" for c, r, _, f in _RULES_SQL if f != "false"),
    "studio_mostly_unique": "with s as (select o_orderkey, count(*) over w n, min(o_orderkey) over w f, row_number() over (partition by o_custkey, o_orderdate order by o_orderkey) k from orders window w as (partition by o_custkey, o_orderdate)), g as (select *, dense_rank() over (order by n desc, f) i from s where n > 1) select o_orderkey, 'DG-' || case when i < 1000 then lpad(i::varchar, 4, '0') else i::varchar end _dup_group_id, n _dup_count, k _recency_rank from g union all select o_orderkey, null, 0, 0 from s where n = 1",
    "match_types": "select 'Exact' _match_type, sum(n)::bigint n_rows, count(*) n_groups from (select count(*) n from events group by user_id, event_type having count(*) > 1)",
    "score_levels": "select c_custkey, case when c_acctbal / 100 >= 95 then 'Optimised' when c_acctbal / 100 >= 80 then 'Managed' when c_acctbal / 100 >= 60 then 'Defined' when c_acctbal / 100 >= 40 then 'Repeatable' else 'Adhoc' end \"level\" from customer",
}
QUERIES = {k: globals()[k] for k in SQL}
