"""The studio profile: column profiles, rules with their own denominators, survivorship of duplicate groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions import text as T
from loamgrid.operators import fuzzy
from loamgrid.session import cut


def profile(df: DataFrame) -> DataFrame:
    """Cardinality, uniqueness and emptiness of each column, and its fitness as an identifier; one pass over the table."""
    own = [c for c in df.columns if not c.startswith("_")]
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("Column"), F.lower(T.strip(F.col(f"`{c}`"))).alias("v")) for c in own)))
    counts = df.select(values.alias("_x")).select("_x.*").groupBy("Column", "v").agg(F.count("*").alias("n"))
    empty = F.col("v").isNull() | F.col("v").isin("", "nan")
    p = counts.groupBy("Column").agg(F.sum("n").alias("total"), F.sum(F.when(empty, F.col("n")).otherwise(0)).alias("n_empty"), F.count(F.when(~empty, 1)).alias("Cardinality"))
    u, e = F.col("Cardinality") / F.col("total") * 100, F.col("n_empty") / F.col("total") * 100
    return p.select("Column", "Cardinality", F.bround(u, 1).alias("Uniqueness_pct"), F.bround(e, 1).alias("Empty_pct"), F.when((u >= 90) & (e < 5), "Strong").when((u >= 50) & (e < 20), "Medium").otherwise("Weak").alias("Recommendation")).orderBy(F.col("Uniqueness_pct").desc(), "Column")


def _filled(c: Column) -> Column:
    return F.coalesce(T.strip(c) != "", F.lit(False))


def _one(c: Column, rule: str, arg: str) -> tuple[Column, Column]:
    """(counts in the denominator, fails) of a row rule."""
    t, filled = T.text(c), _filled(c)
    fails = lambda ok: filled & ~F.coalesce(ok, F.lit(False))
    every, given = F.lit(True), t.isNotNull()
    if rule == "range_check":
        try:
            lo, hi = map(float, arg.split(","))
        except ValueError:
            lo, hi = 0.0, 999999.0
        n = T.number(t)
        return n.isNotNull(), n.isNotNull() & ~n.between(lo, hi)
    allowed = [v.strip().lower() for v in arg.split(",") if v.strip()]
    title = T.proper_case(t) == t
    # The patterns of the studio's rules.
    found = {
        "not_null": lambda: (every, ~filled | (F.lower(T.strip(c)) == "nan")),
        "email_format": lambda: (given, given & ~T.prefix(t, r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$")),
        "numeric_only": lambda: (filled, fails(F.regexp_replace(t, r"(?U)[,.\-+\s]", "").rlike(r"(?U)\A\p{N}+\z"))),
        "date_format": lambda: (filled, fails(T.parse_date(T.strip(t), T.MONTH_FIRST).isNotNull())),
        "regex_pattern": lambda: (filled, fails(T.prefix(t, arg or ".*")) if T.usable(arg) else F.lit(False)),
        "allowed_values": lambda: (filled, fails(F.lower(T.strip(t)).isin(*allowed)) if allowed else F.lit(False)),
        "trim_spaces": lambda: (filled, filled & (t != T.strip(t))),
        "mixed_case": lambda: (filled, fails(t.rlike(r"\p{L}") & ((F.upper(t) == t) | (F.lower(t) == t) | title))),
        "special_chars": lambda: (filled, filled & t.rlike(r"(?U)[^\w\s@.+\-]")),
    }
    return found[rule]() if rule in found else (every, F.lit(False))


#: Rules that need more than the row itself.
GROUP_RULES = ("min_fill_pct", "fuzzy_standardize", "unique_values", "unique_combo", "fuzzy_dups")


def rules(df: DataFrame, checks: list[tuple[str, str, str]]) -> DataFrame:
    """(column, rule, fail_count, pass_count, score) of rules (column, rule, argument).

    Row rules are one aggregate together; the others are planned each on its own. The argument is a threshold, or the
    columns of a combination. A combination of less than two columns and a rule that the studio does not have pass.
    """
    simple = [(c, r, a) for c, r, a in checks if r not in GROUP_RULES or r == "unique_combo" and "," not in a]
    out = _row_rules(df, simple) if simple else None
    for c, r, a in checks:
        if r not in GROUP_RULES or r == "unique_combo" and "," not in a:
            continue
        if r == "unique_combo":
            one = unique_values(df, [x.strip() for x in a.split(",")], blanks_count=True).withColumn("column", F.lit(c))
        else:
            number = {"threshold": float(a)} if a else {}
            one = {
                "min_fill_pct": lambda: fill_rate(df, c, *number.values()), "unique_values": lambda: unique_values(df, [c]),
                "fuzzy_standardize": lambda: fuzzy_standardize(df, c, **number), "fuzzy_dups": lambda: fuzzy_dups(df, c, **number),
            }[r]()
        out = one if out is None else out.unionByName(one)
    return out


def _row_rules(df: DataFrame, checks: list[tuple[str, str, str]]) -> DataFrame:
    pairs = [_one(F.col(f"`{c}`"), r, a) for c, r, a in checks]
    wide = df.agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(F.when(d, 1)), F.lit(0)).alias(f"d{i}") for i, (d, _) in enumerate(pairs)), *(F.coalesce(F.sum(F.when(f, 1)), F.lit(0)).alias(f"f{i}") for i, (_, f) in enumerate(pairs)))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(r).alias("rule"), F.col(f"d{i}").alias("d"), F.col(f"f{i}").alias("fail_count")) for i, (c, r, _) in enumerate(checks)))
    return wide.select("n", F.explode(rows).alias("_x")).select("_x.column", "_x.rule", "_x.fail_count", (F.col("n") - F.col("_x.fail_count")).alias("pass_count"), _score(F.col("_x.fail_count"), F.col("_x.d")).alias("score"))


def _counted(df: DataFrame, column: str, rule: str, bad: DataFrame) -> DataFrame:
    """The result of a rule that fails rows by their trimmed, lower-cased value. bad: (value, n)."""
    filled = F.coalesce(F.sum(_filled(F.col(f"`{column}`")).cast("int")), F.lit(0))
    both = df.agg(F.count(F.lit(1)).alias("n"), filled.alias("d")).crossJoin(bad.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("fail_count")))  # one row each
    return both.select(F.lit(column).alias("column"), F.lit(rule).alias("rule"), "fail_count", (F.col("n") - F.col("fail_count")).alias("pass_count"), _score(F.col("fail_count"), F.col("d")).alias("score"))


def fuzzy_standardize(df: DataFrame, column: str, threshold: float = 85, most: int | None = 5_000, row: Column | None = None) -> DataFrame:
    """Rows whose value belongs to a cluster of near-equal values fail. More than `most` distinct values are refused."""
    clusters = fuzzy.value_clusters(df, column, threshold, most, row=row).select("value").distinct()
    value = F.lower(T.strip(F.col(f"`{column}`")))
    counts = df.where(value != "").groupBy(value.alias("value")).agg(F.count("*").alias("n"))
    return _counted(df, column, "fuzzy_standardize", counts.join(clusters, "value", "left_semi"))


def fuzzy_dups(df: DataFrame, column: str, threshold: float = 88) -> DataFrame:
    """Rows fail that have an equal or near-equal partner of the same first letter, whatever the size of its block."""
    return _counted(df, column, "fuzzy_dups", fuzzy.with_partner(df, column, threshold))


def failing(df: DataFrame, checks: list[tuple[str, str, str]], row: Column) -> DataFrame:
    """(column, rule, Row_Number, value): every row that fails a row rule, in one scan."""
    pairs = [(c, r, _one(F.col(f"`{c}`"), r, a)[1]) for c, r, a in checks if r not in GROUP_RULES]
    found = F.array(*(F.when(f, F.struct(F.lit(c).alias("column"), F.lit(r).alias("rule"), T.text(F.col(f"`{c}`")).alias("value"))) for c, r, f in pairs))
    return df.select(row.cast("long").alias("Row_Number"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("_x")).select("Row_Number", "_x.*")


def _score(fails: Column, of: Column) -> Column:
    return F.bround((1 - fails / F.greatest(of, F.lit(1))) * 100, 2)


def fill_rate(df: DataFrame, column: str, least: float = 90) -> DataFrame:
    """The share of filled rows is the score; below `least` every blank row fails."""
    filled = F.sum(_filled(F.col(f"`{column}`")).cast("int"))
    p = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(filled, F.lit(0)).alias("k")).withColumn("score", F.bround(F.col("k") / F.greatest(F.col("n"), F.lit(1)) * 100, 2))
    fails = F.when(F.col("score") >= least, 0).otherwise(F.col("n") - F.col("k"))
    return p.select(F.lit(column).alias("column"), F.lit("min_fill_pct").alias("rule"), fails.alias("fail_count"), (F.col("n") - fails).alias("pass_count"), "score")


def unique_values(df: DataFrame, columns: list[str], blanks_count: bool = False) -> DataFrame:
    """Rows whose value, or combination of values, occurs more than once. Blank values never do unless blanks_count."""
    cols = [F.col(f"`{c}`") for c in columns]
    counts = df.groupBy(*(c.alias(f"k{i}") for i, c in enumerate(cols))).agg(F.count("*").alias("n"))
    given = F.lit(True) if blanks_count else reduce(lambda a, b: a & b, (_filled(F.col(f"k{i}")) for i in range(len(cols))))
    fails, of = F.coalesce(F.sum(F.when(given & (F.col("n") > 1), F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(given, F.col("n"))), F.lit(0))
    name = "unique_combo" if len(columns) > 1 else "unique_values"
    return counts.agg(fails.alias("fail_count"), of.alias("d"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit(" + ".join(columns)).alias("column"), F.lit(name).alias("rule"), "fail_count", (F.col("n") - F.col("fail_count")).alias("pass_count"), _score(F.col("fail_count"), F.col("d")).alias("score"))


def overall(rule_results: DataFrame) -> DataFrame:
    s = F.bround(F.avg("score"), 2)
    return rule_results.agg(s.alias("overall"), F.when(s >= 80, "Good").when(s >= 60, "Fair").otherwise("Poor").alias("rating"))


def golden(annotated: DataFrame, strategy: str = "Most Complete") -> DataFrame:
    """Adds _golden: whether the row survives. Rows in no group survive; ties go to the first row.

    The winner of a group is the least of a composite, taken in one aggregation with map-side combining. The winners are
    a table before they meet the rows, so adaptive execution can split the rows of a hot group.
    """
    own = [c for c in annotated.columns if not c.startswith("_")]
    # Words of a source column's name, and the names of the strategies.
    source = next((c for c in own if any(w in c.lower() for w in ("source", "system", "origin", "priority"))), None)
    filled = sum((F.col(f"`{c}`").isNotNull().cast("int") for c in own), F.lit(0))
    by = {
        "Most Complete": -F.col("_completeness"), "Most Recent": F.when(F.col("_recency_rank") > 0, F.col("_recency_rank")).otherwise(2**40),
        "Most Frequent": -filled, "Source Priority": F.coalesce(T.text(F.col(f"`{source}`")), F.lit("\U0010ffff")) if source else -F.col("_completeness"),
    }.get(strategy, F.lit(0))
    best = annotated.where("_is_duplicate").groupBy("_dup_group_id").agg(F.min(F.struct(by.alias("a"), F.col("_row_id").alias("r"))).alias("_b")).select("_dup_group_id", F.col("_b.r").alias("_winner"))
    return annotated.join(cut(best), "_dup_group_id", "left").withColumn("_golden", ~F.col("_is_duplicate") | (F.col("_row_id") == F.col("_winner"))).drop("_winner")


def match_types(annotated: DataFrame) -> DataFrame:
    """Duplicate rows and groups of each match type."""
    return annotated.where("_is_duplicate").groupBy("_match_type").agg(F.count("*").alias("n_rows"), F.countDistinct("_dup_group_id").alias("n_groups"))


def with_fuzzy(annotated: DataFrame, column: str, threshold: float = 0.85, most: int = 5_000) -> DataFrame:
    """Adds fuzzy groups of one column to the rows that no exact group holds; a row's group and score are those of its text."""
    free = annotated.where("not _is_duplicate")
    found = leader_groups(free, column, F.col("_row_id"), threshold, most)
    value = F.lower(T.strip(F.col(f"`{column}`")))
    text = found.join(free.select("_row_id", value.alias("_v")), "_row_id").select("_v", F.col("_dup_group_id").alias("_g"), F.col("_similarity_score").alias("_s"))
    sizes = free.select(value.alias("_v")).join(text, "_v").groupBy("_g").agg(F.count("*").alias("_n"))
    hit = free.withColumn("_v", value).join(text.join(sizes, "_g"), "_v", "left").drop("_v")
    new = {"_dup_group_id": F.col("_g"), "_is_duplicate": F.col("_g").isNotNull(), "_dup_count": F.coalesce("_n", "_dup_count"), "_match_type": F.when(F.col("_g").isNotNull(), "Fuzzy").otherwise(F.col("_match_type")), "_similarity_score": F.coalesce("_s", "_similarity_score")}
    return annotated.where("_is_duplicate").unionByName(hit.withColumns(new).select(annotated.columns))


def kpis(annotated: DataFrame) -> DataFrame:
    return annotated.agg(F.count("*").alias("total"), F.sum(F.col("_is_duplicate").cast("long")).alias("duplicate_rows"), F.countDistinct("_dup_group_id").alias("groups"), F.sum((~F.col("_is_duplicate")).cast("long")).alias("unique_rows"), F.sum((F.col("_match_type") == "Fuzzy").cast("long")).alias("fuzzy_rows"))


def top_groups(annotated: DataFrame, k: int = 20) -> DataFrame:
    """The k largest groups: a report of the top."""
    return annotated.where("_is_duplicate").groupBy("_dup_group_id").agg(F.count("*").alias("n_rows")).orderBy(F.col("n_rows").desc(), "_dup_group_id").limit(k)


def score_histogram(duplicates: DataFrame, score: str, bins: int = 10, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    b = F.least(F.width_bucket(F.col(score), F.lit(lo), F.lit(hi), F.lit(bins)), F.lit(bins))
    return duplicates.groupBy(b.alias("bin")).agg(F.count("*").alias("n_rows"))


def leader_groups(rows: DataFrame, column: str, row: Column, threshold: float = 0.85, most: int = 5_000) -> DataFrame:
    """(_row_id, _dup_group_id, _similarity_score): rows whose text resembles an earlier leader's by the matching-block ratio.

    Order decides who leads, so the distinct texts form one group; more than `most` of them are refused.
    """
    import pandas as pd

    from loamgrid.functions.scorers import difflib_ratio
    from loamgrid.session import ship

    ship(rows.sparkSession)

    distinct = rows.select(F.lower(T.strip(F.col(column))).alias("v"), row.cast("long").alias("r")).where("v is not null and v <> ''").groupBy("v").agg(F.min("r").alias("r"), F.lit(0).alias("_g"))
    if distinct.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} distinct values")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        leaders, out = [], []
        for v, r in sorted(zip(pdf["v"], pdf["r"]), key=lambda x: x[1]):
            hit = next(((i, s) for i, (u, _) in enumerate(leaders) if (s := difflib_ratio(u, v)) >= threshold), None)
            if hit is None:
                leaders.append((v, [(r, 1.0)]))
            else:
                leaders[hit[0]][1].append((r, round(hit[1], 3)))
        for n, (_, ms) in enumerate([x for x in leaders if len(x[1]) > 1], 1):
            out += [(r, f"DG-{n:04d}-F", s) for r, s in ms]
        return pd.DataFrame(out, columns=["_row_id", "_dup_group_id", "_similarity_score"])

    return distinct.groupBy("_g").applyInPandas(run, "_row_id long, _dup_group_id string, _similarity_score double")
