"""Queries on exact and fuzzy duplicates, with their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgrid.operators import components as comp
from loamgrid.operators import exact, fuzzy, report, uniqueness
from loamgrid.queries.dirty import SQL as DV
from loamgrid.queries.dirty import dirty
from loamgrid.session import table


def _part(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")


def _prow():
    return F.col("p_partkey") + 2


def dup_single(spark, d):
    return exact.single(_part(spark, d), "p_name", _prow())


def dup_multi_single(spark, d):
    return exact.multi_single(dirty(spark, d), ["email", "phone", "pan"], F.col("rn")).select("Row_Number", "_Source_Column", "Duplicate_Group_ID", "Duplicate_Type", "Similarity_Score")


def dup_combo(spark, d):
    return exact.combination(_part(spark, d), ["p_name", "p_brand"], _prow())


def dup_dispatch(spark, d):
    df = dirty(spark, d)
    parts = [exact.multi_single(df, ["email"], F.col("rn")), exact.combination(df, ["pan", "segment"], F.col("rn"))]
    return exact.merged(parts).select("Row_Number", "Duplicate_Group_ID", "Duplicate_Type")


def dup_documents(spark, d):
    return exact.single(table(spark, d, "documents").select("doc_id", "text"), "text", F.col("doc_id") + 2).select("doc_id", "Duplicate_Group_ID")


def basic_exact(spark, d):
    df = _part(spark, d).withColumn("p_name", exact.normalized(F.col("p_name"))).withColumn("p_type", exact.normalized(F.col("p_type")))
    return exact.basic(df, "Exact name", ["p_name", "p_type"])


def basic_exact_summary(spark, d):
    df = _part(spark, d)
    one = exact.basic(df, "Exact name", ["p_name"])
    return exact.basic_summary(one.unionByName(exact.basic(df, "Exact name and brand", ["p_name", "p_brand"])))


def basic_nulls(spark, d):
    df = dirty(spark, d)
    cols = ["phone", "since"]
    df = df.select("rn", *(F.when(~F.lower(exact.normalized(F.col(c))).isin("nil"), exact.normalized(F.col(c))).alias(c) for c in cols))
    return exact.basic(df, "With nulls", cols, ignore_nulls=False).select("rn", "_group_id", "_group_size", "_dup_key")


def normalize_text(spark, d):
    df = dirty(spark, d)
    return df.select("rn", exact.normalized(F.col("name")).alias("name"), exact.normalized(F.col("email")).alias("email"), exact.normalized(F.col("phone"), punctuation=True).alias("phone"))


def _missing(spark, d):
    return exact.missing(dirty(spark, d), ["email", "phone", "balance", "since"], F.col("rn") - 1, ["cust_id", "email", "phone", "balance", "since"])


def missing_exceptions(spark, d):
    return _missing(spark, d)


def missing_summary(spark, d):
    return exact.missing_summary(_missing(spark, d))


def normalize_table(spark, d):
    """Text columns only: numbers stay as they are."""
    return exact.normalized_table(dirty(spark, d).withColumn("balance", F.expr("try_cast(balance as double)")).select("rn", "name", "email", "balance"))


def fuzzy_core(spark, d):
    """Vendor names and places against each other, all blocks, without a limit on their pairs."""
    df = table(spark, d, "vendor_master").select("row_id", "vendorname", "city", "country")
    return fuzzy.core(df, ["vendorname", "city"], F.col("row_id") + 2, threshold=90, weights=[3.0, 1.0], max_pairs=None)


def fuzzy_basic(spark, d):
    df = table(spark, d, "vendor_master").select("row_id", "vendorname", "city")
    return fuzzy.basic(df, "Fuzzy name 95", ["vendorname"], F.col("row_id"), threshold=95, max_pairs=None)


def fuzzy_skipped(spark, d):
    keyed = fuzzy._keyed(_part(spark, d), ["p_name"], _prow(), 2, True, ())
    return fuzzy.oversize(keyed, 20_000)


def fuzzy_values(spark, d):
    return fuzzy.value_clusters(table(spark, d, "part"), "p_name", 75)


def components(spark, d):
    """Customers and the orders' shares of them as a graph: each order links its customer to a part of the key's range."""
    o = table(spark, d, "orders").where("o_custkey is not null and o_orderkey is not null")
    return comp.components(o.select(F.col("o_custkey").alias("src"), (-1 - F.floor(F.col("o_custkey") / 5)).alias("dst")))


def _plan():
    return uniqueness.Uniqueness(("email", "phone"), (("pan", "segment"),))


def uniqueness_records(spark, d):
    """Single columns whose group numbers collide, then a combination; each row once."""
    records, _ = uniqueness.duplicates(dirty(spark, d), _plan(), F.col("rn"))
    return records.select("Row_Number", "_Source_Column", "Duplicate_Group_ID", "Duplicate_Type")


def uniqueness_issues(spark, d):
    return uniqueness.duplicates(dirty(spark, d), _plan(), F.col("rn"))[1].drop("_ord")


def uniqueness_log(spark, d):
    df = dirty(spark, d)
    return uniqueness.log(uniqueness.duplicates(df, _plan(), F.col("rn"))[0], df.count())


def uniqueness_fuzzy(spark, d):
    """Exact and near-equal vendor names in one plan; each row once."""
    df = table(spark, d, "vendor_master").select("row_id", "vendorname", "city", "country")
    plan = uniqueness.merge([uniqueness.Uniqueness(("vendorname",)), uniqueness.Uniqueness(alike=(uniqueness.Alike(("vendorname", "city"), 90, (3.0, 1.0)),))])
    return uniqueness.duplicates(df, plan, F.col("row_id") + 2)[0].select("Row_Number", "Duplicate_Type", "Duplicate_Group_ID")


def dup_groups(spark, d):
    return report.duplicate_groups(exact.multi_single(dirty(spark, d), ["email", "phone"], F.col("rn")))


def dup_columns(spark, d):
    df = _part(spark, d)
    both = exact.basic(df, "Exact name", ["p_name", "p_type"]).unionByName(exact.basic(df, "Exact name and brand", ["p_name", "p_brand"]))
    return report.duplicate_columns(both, "_match_cols")


def duplicate_rows(spark, d):
    df = dirty(spark, d)
    return report.unique_rows(exact.multi_single(df, ["email", "phone"], F.col("rn")), df.count())


_STRIP = r"lower(regexp_replace({c}, '^[\s\pZ]+|[\s\pZ]+$', '', 'g'))"


def _lcs(p: str, q: str) -> str:
    """The length of the longest common subsequence of two SQL texts, by bit vectors; up to 120 letters."""
    mask = f"list_sum(list_transform(range(1, length({p}) + 1), lambda zi: case when ({p})[zi] = zc then 1::hugeint << (zi - 1)::hugeint else 0::hugeint end))"
    full = f"((1::hugeint << length({p})::hugeint) - 1)"
    bits = f"list_reduce(list_transform(string_split({q}, ''), lambda zc: {mask}::hugeint), lambda zs, zm: ((zs + (zs & zm)) | (zs - (zs & zm))) & {full}, {full})"
    return f"(case when {p} = '' or {q} = '' then 0 else length({p}) - bit_count({bits}) end)"


def _ratio(p: str, q: str) -> str:
    return f"(case when {p} = {q} then 100.0::double else 200.0::double * {_lcs(p, q)} / (length({p}) + length({q})) end)"


_SPLIT = r"list_filter(regexp_split_to_array({v}, '[\s\pZ]+'), lambda t: t <> '')"
_JOINED = "array_to_string(list_sort({l}), ' ')"


def _token_set(pairs: str) -> str:
    """(x, y, sc) of pairs (x, y): the token set score; what both begin with need not be compared."""
    tokens = lambda v: f"list_distinct({_SPLIT.format(v=v)})"
    return f"""select x, y, case when x = y or n > 0 and (p = '' or q = '') then 100.0::double when p = '' or q = '' then case when n = 0 then 0.0 end
      else greatest(200.0 * (k + lcs) / (2 * k + length(p) + length(q)), case when n > 0 then greatest(200.0 * n / (2 * n + 1 + length(p)), 200.0 * n / (2 * n + 1 + length(q))) else 0.0 end)::double end sc
    from (select *, case when n > 0 then n + 1 else 0 end k, {_lcs('p', 'q')} lcs
      from (select x, y, length({_JOINED.format(l='list_intersect(a, b)')}) n, {_JOINED.format(l='list_filter(a, lambda t: not list_contains(b, t))')} p, {_JOINED.format(l='list_filter(b, lambda t: not list_contains(a, t))')} q
        from (select x, y, {tokens('x')} a, {tokens('y')} b from ({pairs}))))"""


def _hybrid(pairs: str) -> str:
    """(x, y, h) of pairs (x, y): the blend of the four scorers where it can reach 60, else null. Windows stick out at both ends."""
    window = lambda l, m: f"list_max(list_transform(range(1 - length({m}), length({l})), lambda w: {_ratio('u', f'({l})[greatest(w, 0) + 1 : w + length({m})]')}))"
    return f"""select x, y, case when x = y then 100.0::double when x = '' or y = '' then 0.0 else z + 0.20 * greatest(a, coalesce(b, 0.0)) end h from (
      select *, {window('v', 'u')} a, case when length(u) = length(v) then list_max(list_transform(range(1 - length(v), length(v)), lambda w: {_ratio('v', '(u)[greatest(w, 0) + 1 : w + length(v)]')})) end b from (
        select x, y, case when length(x) <= length(y) then x else y end u, case when length(x) <= length(y) then y else x end v, 0.35 * sc + 0.30 * {_ratio('i', 'j')} + 0.15 * {_ratio('x', 'y')} z
        from (select x, y, sc, {_JOINED.format(l=_SPLIT.format(v='x'))} i, {_JOINED.format(l=_SPLIT.format(v='y'))} j from ({_token_set(pairs)}))) where z >= 40 or x = y or x = '' or y = '')"""


_NULLISH = "coalesce(lower(trim({c})) in ('','nan','none','null','na','n/a','n.a.','nil','missing','#n/a'), true)"


def _single(src: str, key: str, row: str, cond: str) -> str:
    return f"select *, dense_rank() over (order by f) g from (select *, count(*) over (partition by k) n, min(r) over (partition by k) f from (select *, {key} k, {row} r from {src} where {cond})) where n > 1"


_P = "(select p_partkey, p_name, p_brand, p_type, p_size from part)"
_PC = "p_partkey, p_name, p_brand, p_type, p_size, g Duplicate_Group_ID, {t} Duplicate_Type, 100.0::double Similarity_Score, r Row_Number"
_EMAIL = _single("dv", "lower(trim(email))", "rn", f"not {_NULLISH.format(c='email')}")
_BK = "␟"
_NORM = "nullif(lower(trim({c})), '')"


def _basic(src: str, cols: str, key: str, name: str, match: str) -> str:
    return f"select '{name}' _rule, 'EXACT' _match_type, '{match}' _match_cols, dense_rank() over (order by k) _group_id, n _group_size, 100::bigint _score, k _dup_key, {cols} from (select *, count(*) over (partition by k) n from (select *, {key} k from {src})) where n > 1"


_MISSING = " union all ".join(f"select '{c}' _missing_field, 'Missing value' _issue, rn - 1 _row_id, cust_id, email, phone, balance, since from dv where nullif(trim({c}), '') is null" for c in ("email", "phone", "balance", "since"))
_UNIQUE = f"with dv as ({DV}), u as (" + " union all ".join(f"select r Row_Number, '{c}' _Source_Column, g Duplicate_Group_ID, 'Exact' Duplicate_Type, {c} v, 0 o from ({_single('dv', f'lower(trim({c}))', 'rn', 'not ' + _NULLISH.format(c=c))})" for c in ("email", "phone")) + f" union all select r, null, g, 'Combination', pan || ' | ' || segment, 1 from ({_single('dv', 'struct_pack(a := lower(trim(pan)), b := lower(trim(segment)))', 'rn', 'true')})) "
_GIVEN = "{c} not in ('','nan','none','null','na','n/a','n.a.','nil','missing','#n/a')"
_FUZZY = f"""with recursive v as (select *, left(k, 2) || '|' || left(coalesce(ct, ''), 3) b from (select row_id, {_STRIP.format(c='vendorname')} k, {_STRIP.format(c='city')} c, {_STRIP.format(c='country')} ct from vendor_master) where {_GIVEN.format(c='k')} and {_GIVEN.format(c='c')}),
  n as (select b, k, c, min(row_id) node, count(*) m from v group by 1, 2, 3),
  d as (select l.k lk, r.k rk, l.c lc, r.c rc, l.node src, r.node dst from n l join n r on l.b = r.b and l.node < r.node),
  hk as materialized ({_hybrid('select distinct lk x, rk y from d')}), d2 as (select d.*, h from d join hk on x = lk and y = rk where 3 * h + 100 >= 360 - 1e-9),
  hc as materialized ({_hybrid('select distinct lc x, rc y from d2')}),
  e as (select src, dst, (3 * d2.h + hc.h) / 4 s from d2 join hc on x = lc and y = rc where (3 * d2.h + hc.h) / 4 >= 90 union all select node, node, 100.0 from n where m > 1),
  g(node, seen) as (select src, src from e union select dst, dst from e union select case when e.src = g.node then e.dst else e.src end, g.seen from g join e on e.src = g.node or e.dst = g.node),
  cc as (select node, min(seen) cc from g group by 1), z as (select cc, round_even(max(s), 2) s from e join cc on cc.node = e.src group by 1),
  fz as (select v.row_id, z.s, dense_rank() over (order by f) g from (select v.row_id, cc.cc, min(v.row_id) over (partition by cc.cc) f from v join n using (b, k, c) join cc on cc.node = n.node) v join z using (cc))"""
SQL = {
    "dup_single": f"select {_PC.format(t=chr(39) + 'Exact' + chr(39))} from ({_single(_P, 'lower(trim(p_name))', 'p_partkey + 2', 'p_name is not null')})",
    "dup_multi_single": f"with dv as ({DV}) " + " union all ".join(f"select r Row_Number, '{c}' _Source_Column, g Duplicate_Group_ID, 'Exact' Duplicate_Type, 100.0::double Similarity_Score from ({_single('dv', f'lower(trim({c}))', 'rn', 'not ' + _NULLISH.format(c=c))})" for c in ("email", "phone", "pan")),
    "dup_combo": f"select {_PC.format(t=chr(39) + 'Combination' + chr(39))} from ({_single(_P, '{p}'.format(p='struct_pack(a := lower(trim(p_name)), b := lower(trim(p_brand)))'), 'p_partkey + 2', 'true')})",
    "dup_dispatch": f"with dv as ({DV}), e as ({_EMAIL}), c as ({_single('dv', 'struct_pack(a := lower(trim(pan)), b := lower(trim(segment)))', 'rn', 'true')}) select r Row_Number, g Duplicate_Group_ID, 'Exact' Duplicate_Type from e union all select r, g, 'Combination' from c where r not in (select r from e)",
    "dup_documents": f"select doc_id, g Duplicate_Group_ID from ({_single('(select doc_id, text from documents)', r'lower(trim(text, chr(32) || chr(10) || chr(9) || chr(13)))', 'doc_id + 2', 'text is not null')})",
    "basic_exact": _basic("(select p_partkey, lower(trim(p_name)) p_name, p_brand, lower(trim(p_type)) p_type, p_size from part)", "p_partkey, p_name, p_brand, p_type, p_size", f"p_name || '{_BK}' || p_type", "Exact name", "p_name, p_type"),
    "basic_exact_summary": f"with x as ({_basic(_P, 'p_partkey', 'p_name', 'Exact name', 'p_name')} union all {_basic(_P, 'p_partkey', f"p_name || '{_BK}' || p_brand", 'Exact name and brand', 'p_name, p_brand')}) select _rule, _match_type, _match_cols, count(*) duplicate_rows, count(distinct _group_id) duplicate_groups, max(_score) max_score, min(_score) min_score from x group by 1, 2, 3",
    "basic_nulls": f"with dv as ({DV}), x as (select rn, nullif({_NORM.format(c='phone')}, 'nil') phone, nullif({_NORM.format(c='since')}, 'nil') since from dv) select rn, _group_id, _group_size, _dup_key from ({_basic('x', 'rn', f"coalesce(phone, '<NULL>') || '{_BK}' || coalesce(since, '<NULL>')", 'w', 'w')})",
    "normalize_text": f"with dv as ({DV}) select rn, {_NORM.format(c='name')} name, {_NORM.format(c='email')} email, nullif(trim(regexp_replace(regexp_replace(lower(trim(phone)), '[^\\w\\s@.+\\-]', ' ', 'g'), '\\s+', ' ', 'g')), '') phone from dv",
    "missing_exceptions": f"with dv as ({DV}) {_MISSING}",
    "missing_summary": f"with dv as ({DV}), x as ({_MISSING}) select _missing_field field, count(*) missing_rows from x group by 1",
    "fuzzy_basic": f"""with recursive v as (select row_id, vendorname, city, {_STRIP.format(c='vendorname')} k, left({_STRIP.format(c='vendorname')}, 1) || '|' || left(coalesce({_STRIP.format(c='city')}, ''), 3) b from vendor_master where {_STRIP.format(c='vendorname')} not in ('','nan','none','null','na','n/a','n.a.','nil','missing','#n/a')),
  n as (select b, k, min(row_id) node, count(*) m from v group by 1, 2),
  d as (select distinct l.k x, r.k y from n l join n r on l.b = r.b and l.node < r.node), t as ({_token_set('select x, y from d')}),
  e as (select l.node src, r.node dst, round_even(sc, 0) s from n l join n r on l.b = r.b and l.node < r.node join t on t.x = l.k and t.y = r.k where round_even(sc, 0) >= 95 union all select node, node, 100.0 from n where m > 1),
  g(node, seen) as (select src, src from e union select dst, dst from e union select case when e.src = g.node then e.dst else e.src end, g.seen from g join e on e.src = g.node or e.dst = g.node),
  c as (select node, min(seen) c from g group by 1), z as (select c, max(s) s from e join c on c.node = e.src group by 1),
  w as (select v.*, c.c, z.s, count(*) over (partition by c.c) size, min(v.row_id) over (partition by c.c) f from v join n using (b, k) join c on c.node = n.node join z on z.c = c.c)
  select 'Fuzzy name 95' _rule, 'FUZZY' _match_type, 'vendorname' _match_cols, dense_rank() over (order by f) _group_id, size _group_size, s::bigint _score, row_id, vendorname, city from w""",
    "fuzzy_values": f"""with recursive v as (select k, row_number() over (order by k) i from (select distinct {_STRIP.format(c='p_name')} k from part) where k <> ''),
  t as ({_token_set('select l.k x, r.k y from v l join v r on l.i < r.i')}), s as (select l.i i, r.i j from t join v l on l.k = x join v r on r.k = y where sc >= 75 and sc < 100),
  r(i, leaders, lead) as (select 0::bigint, []::bigint[], null::bigint union all
    select q.i + 1, case when q.l is null then list_append(q.leaders, q.i + 1) else q.leaders end, q.l from (select r.i, r.leaders, (select min(s.i) from s where s.j = r.i + 1 and list_contains(r.leaders, s.i)) l from r where r.i < (select max(i) from v)) q)
  select a.k leader, b.k "value" from (select lead, i from r where lead is not null union select lead, lead from r where lead is not null) m join v a on a.i = m.lead join v b on b.i = m.i""",
    "fuzzy_core": f"{_FUZZY} select d.*, 'Hybrid Fuzzy' Duplicate_Type, g Duplicate_Group_ID, s Similarity_Score from fz join (select row_id, vendorname, city, country, row_id + 2 Row_Number from vendor_master) d using (row_id)",
    "uniqueness_fuzzy": f"{_FUZZY}, x as (select *, count(*) over (partition by k) n, min(row_id) over (partition by k) f from (select row_id, {_STRIP.format(c='vendorname')} k from vendor_master) where {_GIVEN.format(c='k')}), o as (select row_id, 'Exact' t, dense_rank() over (order by f) g from x where n > 1) select row_id + 2 Row_Number, t Duplicate_Type, g Duplicate_Group_ID from o union all select row_id + 2, 'Hybrid Fuzzy', g from fz where row_id not in (select row_id from o)",
    "fuzzy_skipped": "select *, n_rows * (n_rows - 1) // 2 n_pairs from (select substring(lower(trim(p_name)), 1, 2) _block, count(*) n_rows from part where p_name is not null group by 1) where n_rows * (n_rows - 1) // 2 > 20000",
    "components": """with recursive e as (select distinct o_custkey src, -1 - o_custkey // 5 dst from orders where o_custkey is not null and o_orderkey is not null),
 b as (select src, dst from e union select dst, src from e), r(node, seen) as (select src, src from b union select b.dst, r.seen from r join b on b.src = r.node)
 select node, min(seen) component from r group by 1""",
    "normalize_table": f"with dv as ({DV}) select rn, {_NORM.format(c='name')} name, {_NORM.format(c='email')} email, try_cast(balance as double) balance from dv",
    "uniqueness_records": _UNIQUE + "select Row_Number, _Source_Column, Duplicate_Group_ID, Duplicate_Type from (select *, row_number() over (partition by Row_Number order by o, _Source_Column) w from u) where w = 1",
    "uniqueness_issues": _UNIQUE + "select Row_Number, coalesce(_Source_Column, 'pan + segment') Column_Name, case when o = 0 then 'Single Column Exact Duplicate' else 'Combination Column Exact Duplicate' end Rule_Applied, 'Duplicate (Group ' || Duplicate_Group_ID || ')' Issue_Type, v Original_Value, case when o = 0 then 'Unique value' else 'Unique combination' end Expected_Value, 'Uniqueness' Dimension from u",
    "uniqueness_log": _UNIQUE + ", f as (select (select count(*) from dv) n, (select count(distinct Row_Number) from u) k), g as (select *, round_even((n - k) / n * 100, 2) s from f) select 'Uniqueness' Dimension, 'ALL' \"Column\", 'Exact/Fuzzy Duplicate Check' Rule, n Evaluated, k Failed, n - k Passed, s Score, case when s < 50 then 'Critical' when s < 70 then 'High' when s < 85 then 'Medium' when s < 95 then 'Low' else 'Pass' end Severity, 'Duplicate Records' Issue_Type from g",
    "dup_groups": _UNIQUE + "select Duplicate_Type, _Source_Column, Duplicate_Group_ID, count(*) n_rows from u where o = 0 group by 1, 2, 3",
    "dup_columns": f"with x as (select unnest(['p_name', 'p_type']) \"column\", n from ({_basic(_P, 'n', f"p_name || '{_BK}' || p_type", 'a', 'a').replace('n _group_size, ', '')}) union all select unnest(['p_name', 'p_brand']), n from ({_basic(_P, 'n', f"p_name || '{_BK}' || p_brand", 'b', 'b').replace('n _group_size, ', '')})) select \"column\", count(*) n_rows from x group by 1",
    "duplicate_rows": _UNIQUE + "select count(distinct Row_Number) unique_rows from u where o = 0",
}
QUERIES = {f.__name__: f for f in (dup_single, dup_multi_single, dup_combo, dup_dispatch, dup_documents, basic_exact, basic_exact_summary, basic_nulls, normalize_text, missing_exceptions, missing_summary, normalize_table, uniqueness_records, uniqueness_issues, uniqueness_log, uniqueness_fuzzy, dup_groups, dup_columns, duplicate_rows, fuzzy_core, fuzzy_basic, fuzzy_skipped, fuzzy_values, components)}
