"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from loamgrid.llm import abuse, formatting, leaks, names, packing, places, survivors
from loamgrid.session import table

MISSING_SQL = "coalesce(lower(trim({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160))) in ('','nan','none','null','na','n/a','n.a.','nil','missing','#n/a'), true)"


def p1_found(spark, d):
    return names.pairs(table(spark, d, "vendor_master"))


def p1_vendors(spark, d):
    return names.vendors(table(spark, d, "vendor_master"))


def p2_found(spark, d):
    return survivors.survivors(table(spark, d, "duplicate_records"), table(spark, d, "source_systems")).select("_rule", "_group_id", "column_name", "row_id")


def p2_golden(spark, d):
    return survivors.golden(table(spark, d, "duplicate_records"), table(spark, d, "source_systems"))


def p3_found(spark, d):
    return places.found(places.mapped(table(spark, d, "vendor_master"), table(spark, d, "place_list")))


def p3_misses(spark, d):
    return places.misses(places.mapped(table(spark, d, "vendor_master"), table(spark, d, "place_list")))


def p4_found(spark, d):
    return formatting.copies(table(spark, d, "vendor_feed"))


def p4_collapsed(spark, d):
    return formatting.collapse(table(spark, d, "vendor_feed")).select("keep_rec_id", "n_copies")


def p4_collisions(spark, d):
    return formatting.collisions(formatting.collapse(table(spark, d, "vendor_feed"))).selectExpr("hex(h128) as digest", "n_records", "n_copies")


def p6_packed(spark, d):
    return packing.pack(table(spark, d, "documents"))


def p6_report(spark, d):
    return packing.report(packing.pack(table(spark, d, "documents")))


def p7_found(spark, d):
    return leaks.found(leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")))


def p7_passages(spark, d):
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_items(spark, d):
    return leaks.report(leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")))


def _scored(spark, d):
    return abuse.scored(table(spark, d, "documents"), table(spark, d, "review_labels"))


def p8_found(spark, d):
    return _scored(spark, d).where("flagged").select("doc_id")


def p8_scores(spark, d):
    return _scored(spark, d).select("doc_id", "score", "flagged")


def p8_rates(spark, d):
    return abuse.rates(_scored(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_vendors, p2_found, p2_golden, p3_found, p3_misses, p4_found, p4_collapsed, p4_collisions, p6_packed, p6_report, p7_found, p7_passages, p7_items, p8_found, p8_scores, p8_rates)}

_CELLS = " union all ".join(
    f"select d._rule, d._group_id, '{a}' column_name, d.row_id, d.{a} v, d.updated_at t, s.trust_rank r from duplicate_records d left join source_systems s using (source_system) where not {MISSING_SQL.format(c='d.' + a)}"
    for a in survivors.ATTRIBUTES
)
_BEST = f"""with c as ({_CELLS}), b as (
  select _rule, _group_id, column_name, v, row_number() over (partition by _rule, _group_id, column_name order by r asc nulls last, t desc nulls last, v desc) n from c)
"""
_FEED = r"""with f as (select rec_id, list_transform(range(1, len(string_split(_dup_key, chr(9247))) + 1), lambda i:
   lower(trim(string_split(_match_cols, ',')[i])) || case when trim(string_split(_dup_key, chr(9247))[i]) = '<NULL>' then '!'
   else '=' || regexp_replace(lower(upper(string_split(_dup_key, chr(9247))[i])), '[^\p{L}\p{M}\p{N}]+', '', 'g') end) k
   from vendor_feed where _dup_key is not null and _match_cols is not null),
 g as (select rec_id, min(rec_id) over (partition by array_to_string(list_sort(k), '|')) m, count(*) over (partition by array_to_string(list_sort(k), '|')) n from f)
"""
SQL = {
    "p2_found": _BEST + "select b._rule, b._group_id, b.column_name, min(c.row_id) row_id from b join c on b.n = 1 and c._rule is not distinct from b._rule and c._group_id is not distinct from b._group_id and c.column_name = b.column_name and c.v = b.v group by all",
    "p2_golden": _BEST + "select d._rule, d._group_id, d.n n_members, d.m first_row_id, " + ", ".join(f"max(case when b.column_name = '{a}' then b.v end) {a}" for a in survivors.ATTRIBUTES)
    + " from (select _rule, _group_id, count(*) n, min(row_id) m from duplicate_records group by all) d left join b on b.n = 1 and b._rule is not distinct from d._rule and b._group_id is not distinct from d._group_id group by d._rule, d._group_id, d.n, d.m",
    "p4_found": _FEED + "select m keep_rec_id, rec_id from g where rec_id > m",
    "p4_collisions": _FEED + "select md5(c) digest, count(*) n_records, sum(n)::bigint n_copies from (select array_to_string(list_sort(k), '|') c, count(*) n from f group by 1) group by 1 having count(*) > 1",
    "p4_collapsed": _FEED + "select distinct m keep_rec_id, n n_copies from g",
}
