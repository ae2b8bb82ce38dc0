"""Duplicates, components, survivorship and scorers."""

import itertools
import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamgrid.functions import scorers
from loamgrid.operators import components, exact, fuzzy, ids, near, ratings, report, studio, uniqueness


def frame(spark, values, schema="i int, v string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], schema)


def test_ids_by_first_appearance_and_by_key(spark):
    df = frame(spark, ["b", "a", "b", "a", "c", None, " N/A ", "n/a"])
    core = {(r["Row_Number"], r["Duplicate_Group_ID"]) for r in exact.single(df, "v", F.col("i")).collect()}
    assert core == {(0, 1), (2, 1), (1, 2), (3, 2)}
    basic = {(r["i"], r["_group_id"], r["_group_size"]) for r in exact.basic(df, "r", ["v"]).collect()}
    assert basic == {(0, 2, 2), (2, 2, 2), (1, 1, 2), (3, 1, 2)}
    assert exact.single(df.limit(0), "v", F.col("i")).count() == 0


def test_combination_of_blanks(spark):
    df = spark.createDataFrame([(0, "", " "), (1, "", ""), (2, "x", ""), (3, "X ", "")], "i int, a string, b string")
    assert {r["Row_Number"] for r in exact.combination(df, ["a", "b"], F.col("i")).collect()} == {2, 3}
    s = {r["i"]: r["_dup_group_id"] for r in exact.studio(df, ["a"], F.col("i")).collect()}
    assert s[0] == s[1] == "DG-0001" and s[2] == s[3] == "DG-0002"


def test_one_record_for_a_row_of_two_rules(spark):
    df = spark.createDataFrame([(0, "k", "m"), (1, "k", "m"), (2, "z", "m")], "i int, a string, b string")
    m = exact.merged([exact.multi_single(df, ["a"], F.col("i")), exact.combination(df, ["a", "b"], F.col("i"))]).collect()
    assert sorted((r["Row_Number"], r["Duplicate_Type"]) for r in m) == [(0, "Exact"), (1, "Exact")]


def test_numbers_over_partitions(spark):
    df = spark.range(0, 5000, numPartitions=17).select((F.col("id") * 7919 % 5000).alias("id"))
    assert all(r["n"] == r["id"] + 1 for r in ids.numbered(df, [F.col("id")], "n").collect())
    assert ids.numbered(df.limit(0), [F.col("id")], "n").count() == 0


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 3), (3, 9), (7, 7)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and got[9] == 3 and got[7] == 7


def brute_fuzzy(values, threshold):
    values = [v.strip().lower() for v in values]
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for j in range(i + 1, len(values)):
            if a[:2] == values[j][:2] and scorers.hybrid(a, values[j]) >= threshold:
                parent[find(j)] = find(i)
    groups = {}
    for i in range(len(values)):
        groups.setdefault(find(i), []).append(i)
    return sorted(sorted(g) for g in groups.values() if len(g) > 1)


@pytest.mark.parametrize("parts", [1, 5])
def test_fuzzy_matches_brute_force(spark, parts):
    rnd = random.Random(3)
    base = ["acme corp north", "acme tools", "acorn mills ltd", "bolt and sons", "bolton group", "zeta works"]
    values = [b if rnd.random() < 0.4 else b[: (k := rnd.randrange(1, len(b)))] + rnd.choice("aeioux") + b[k:] for b in base for _ in range(6)]
    df = frame(spark, values).repartition(parts)
    members, skipped = fuzzy.matches(df, ["v"], F.col("i"), threshold=88, max_pairs=10_000)
    groups = {}
    for r in members.collect():
        groups.setdefault(r["_group"], []).append(r["_row"])
    assert sorted(sorted(g) for g in groups.values()) == brute_fuzzy(values, 88) and skipped.count() == 0


def test_oversize_blocks_are_reported(spark):
    df = frame(spark, [f"ab{i}" for i in range(201)] + [f"cd{i}" for i in range(200)])
    _, skipped = fuzzy.matches(df, ["v"], F.col("i"), threshold=99, max_pairs=20_000)
    assert [(r["_block"], r["n_pairs"]) for r in skipped.collect()] == [("ab", 20_100)]


def test_value_clusters_do_not_chain(spark):
    df = frame(spark, ["acme corp", "acme corps", "zeta", None, ""])
    assert {(r["leader"], r["value"]) for r in fuzzy.value_clusters(df, "v", 85).collect()} == {("acme corp", "acme corp"), ("acme corp", "acme corps")}
    with pytest.raises(ValueError):
        fuzzy.value_clusters(df, "v", 85, most=2)
    assert fuzzy.value_clusters(df, "v", 85, most=None).count() == 2
    by_row = frame(spark, ["acme corps", "ACME corp ", "zeta"])
    assert {r["leader"] for r in fuzzy.value_clusters(by_row, "v", 85, row=F.col("i")).collect()} == {"acme corps"}
    got = studio.leader_groups(frame(spark, ["acme corp", "zeta", "acme corps"]), "v", F.col("i")).collect()
    assert sorted((r["_row_id"], r["_dup_group_id"]) for r in got) == [(0, "DG-0001-F"), (2, "DG-0001-F")]


def test_survivors(spark):
    rows = [(0, "k", "a", None), (1, "k", None, 5), (2, "k", "b", 9), (3, "solo", "c", 1), (4, "k", "b", 9)]
    df = spark.createDataFrame(rows, "i int, g string, v string, t int")
    s = exact.studio(df, ["g"], F.col("i"), "t")
    win = lambda strategy: sorted(r["i"] for r in studio.golden(s, strategy).where("_golden").collect())
    assert win("Most Complete") == [2, 3] and win("Most Recent") == [2, 3] and win("Manual Selection") == [0, 3]
    assert studio.golden(s).count() == len(rows)


def test_clean_set_keeps_first_of_each_group(spark):
    df = frame(spark, ["x", "x", "y", "x"])
    from loamgrid.operators import assess
    from loamgrid.plans.rules import Rule, plan

    issues = assess.issues(df, plan([Rule("v", "Completeness", "Not Null")], df.columns), F.col("i"))
    got = {r["Row_Number"]: r["Issue_Flag"] for r in report.clean_set(df, exact.single(df, "v", F.col("i")), issues, F.col("i")).collect()}
    assert got == {0: "Yes", 2: "No"}


def test_clean_set_tells_groups_of_two_columns_apart(spark):
    from loamgrid.operators import assess
    from loamgrid.plans.rules import Rule, plan

    cells = [("a@x", "1")] + [("e", "2"), ("e", "3")] + [(None, str(k)) for k in range(10, 16)] + [(None, "77"), ("f", "77"), ("f", "9")]
    df = spark.createDataFrame([(i, m, p) for i, (m, p) in enumerate(cells)], "i int, mail string, phone string")
    issues = assess.issues(df, plan([Rule("mail", "Completeness", "Not Empty")], df.columns), F.col("i"))
    kept = {r["Row_Number"] for r in report.clean_set(df, exact.multi_single(df, ["mail", "phone"], F.col("i")), issues, F.col("i")).collect()}
    # Row 2 follows row 1 by mail; row 10 follows row 9 by phone, but leads row 11 by mail, so it stays, once.
    assert kept == set(range(12)) - {2, 11}


def test_recency_in_a_group_that_spans_partitions(spark):
    df = spark.range(0, 3000, 1, 7).selectExpr("cast(id as int) as i", "case when id % 3 < 2 then 'hot' when id < 1500 then concat('k', id % 40) else concat('s', id) end as g", "cast(case when id % 11 = 0 then null else id % 500 end as int) as t", "'x' as _n")
    got = exact.studio(df, ["g"], F.col("i"), "t").select("i", "g", "t", "_recency_rank", "_dup_count").collect()
    groups = {}
    for r in got:
        groups.setdefault(r["g"], []).append(r)
    assert len(got) == 3000
    for rows in groups.values():
        rows.sort(key=lambda r: (r["t"] is None, -(r["t"] or 0), r["i"]))
        assert [r["_recency_rank"] for r in rows] == (list(range(1, len(rows) + 1)) if len(rows) > 1 else [0])


def test_all_sixteen_studio_rules_answer(spark):
    df = frame(spark, ["acme corp", "acme corps", "ACME corp", "zeta", None, " "])
    rules = ("not_null", "min_fill_pct", "email_format", "numeric_only", "date_format", "regex_pattern", "allowed_values", "range_check", "trim_spaces", "mixed_case", "special_chars", "fuzzy_standardize", "unique_values", "unique_combo", "fuzzy_dups", "no_such_rule")
    arg = {"unique_combo": "i, v", "allowed_values": "zeta", "regex_pattern": "z"}
    got = {r["rule"]: (r["fail_count"], r["pass_count"], r["score"]) for r in studio.rules(df, [("v", r, arg.get(r, "")) for r in rules]).collect()}
    assert set(got) == set(rules) and all(f + p == 6 for f, p, _ in got.values())
    assert got["min_fill_pct"] == (2, 4, 66.67) and got["fuzzy_standardize"] == (3, 3, 25.0) and got["fuzzy_dups"] == (3, 3, 25.0)
    assert got["unique_values"] == (0, 6, 100.0) and got["no_such_rule"] == (0, 6, 100.0) and got["allowed_values"] == (3, 3, 25.0)
    empty = {r["rule"]: r["score"] for r in studio.rules(df.limit(0), [("v", r, arg.get(r, "")) for r in rules]).collect()}
    assert len(empty) == 16 and empty["fuzzy_dups"] == 100.0


def test_uniqueness_as_one_plan(spark):
    df = spark.createDataFrame([(0, "k", "m", "acme corp"), (1, "k", "m", "acme corpx"), (2, "z", "m", "acme crop"), (3, "y", "n", "zeta"), (4, None, None, None)], "i int, a string, b string, c string")
    plan = uniqueness.merge([uniqueness.Uniqueness(("a", "no such")), uniqueness.Uniqueness(("a",), (("a", "b"), ("b",)), (uniqueness.Alike(("c",), 70),))])
    records, issues = uniqueness.duplicates(df, plan, F.col("i"))
    assert sorted((r["Row_Number"], r["Duplicate_Type"]) for r in records.collect()) == [(0, "Exact"), (1, "Exact"), (2, "Hybrid Fuzzy")]
    assert {(r["Rule_Applied"], r["Row_Number"]) for r in issues.collect()} == {("Single Column Exact Duplicate", 0), ("Single Column Exact Duplicate", 1), ("Combination Column Exact Duplicate", 0), ("Combination Column Exact Duplicate", 1), *(("Fuzzy Match (>=70%)", i) for i in range(3))}
    entry = uniqueness.log(records, 5).first()
    assert (entry["Evaluated"], entry["Failed"], entry["Score"], entry["Severity"]) == (5, 3, 40.0, "Critical")
    none, no_issues = uniqueness.duplicates(df, uniqueness.Uniqueness(("no such",)), F.col("i"))
    assert none.count() == no_issues.count() == 0 and uniqueness.log(none, 5).first()["Score"] == 100.0


def test_fuzzy_groups_leave_exact_groups_alone(spark):
    df = frame(spark, ["acme corp", "acme corp", "bolt works", "bolt workz", "BOLT WORKS", None], "i int, v string")
    got = {r["i"]: (r["_match_type"], r["_dup_group_id"], r["_dup_count"]) for r in studio.with_fuzzy(exact.studio(df, ["v"], F.col("i")), "v").collect()}
    assert got[0] == got[1] and got[0][0] == "Exact" and got[2] == got[4] and got[3][0] == "" and got[5][0] == ""
    free = frame(spark, ["acme corp", "bolt works", "bolt workz"])
    annotated = studio.with_fuzzy(exact.studio(free, ["v"], F.col("i")), "v")
    assert {r["i"]: r["_match_type"] for r in annotated.collect()} == {0: "", 1: "Fuzzy", 2: "Fuzzy"}
    assert studio.kpis(annotated).first()["fuzzy_rows"] == 2


def test_rows_of_a_hot_key_are_split(spark):
    rows = spark.range(0, 60_000, 1, 6).selectExpr("cast(id as int) as i", "case when id % 10 < 7 then 'hot key' else concat('k', id % 9000) end as v", "repeat('x', 40) as w")
    options = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB"}
    before = {k: spark.conf.get(k) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        got = exact.single(rows, "v", F.col("i"))
        assert len(got.collect()) > 42_000
        assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_tables_are_deleted(spark):
    import glob

    from loamgrid.session import scratch, sweep

    components.components(spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")).collect()
    folder = scratch(spark)
    before = len(glob.glob(f"{folder}/cut-*"))
    components.components(spark.createDataFrame([(1, 2), (2, 3), (8, 9)], "src long, dst long")).collect()
    assert len(glob.glob(f"{folder}/cut-*")) == before + 1
    sweep(spark)
    assert not glob.glob(f"{folder}/cut-*")


def test_scorer_fixtures():
    for a, b, r, s, t in [("acme corp", "acme corporation", 72, 72, 72), ("acme corp", "corp acme", 44.4444, 100, 100), ("john smith", "jon smith", 94.7368, 94.7368, 94.7368), ("red widget", "red gadget", 80, 40, 80), ("acme", "zeta", 25, 25, 25)]:
        assert scorers.ratio(a, b) == pytest.approx(r, abs=1e-3) and scorers.token_sort_ratio(a, b) == pytest.approx(s, abs=1e-3) and scorers.token_set_ratio(a, b) == pytest.approx(t, abs=1e-3)
    assert scorers.difflib_ratio("tide", "diet") == 0.25 and scorers.difflib_ratio("diet", "tide") == 0.5
    assert scorers.partial_ratio("acme", "the acme corp") == 100


@given(st.text(alphabet="ab c", max_size=12), st.text(alphabet="ab c", max_size=12), st.floats(0, 100))
@settings(max_examples=150, deadline=None)
def test_scorer_properties(a, b, least):
    assert scorers.ratio(a, b) == scorers.ratio(b, a) and 0 <= scorers.hybrid(a, b) <= 100.0001 and scorers.hybrid(a, a) == 100
    exact_score, early = scorers.hybrid(a, b), scorers.hybrid(a, b, least)
    assert early == pytest.approx(exact_score) or exact_score < least


def test_weighted_mean(spark):
    long = spark.createDataFrame([("A", "q1", 2.0, "o", "Adhoc"), ("A", "q2", 1.0, "o", "Managed"), ("A", "q3", 1.0, "o", None)], "dimension string, question_id string, weight double, object string, rating string")
    assert ratings.dimension_scores(long).first()["score"] == 2.0 and [r["question_id"] for r in ratings.exceptions(long).collect()] == ["q1"] and ratings.invalid(long).count() == 1
    assert [spark.range(1).select(ratings.level(F.lit(s))).first()[0] for s in (39.99, 40, 60, 80, 95)] == ["Adhoc", "Repeatable", "Defined", "Managed", "Optimised"]
    old = spark.createDataFrame([("q1", 1.0, "Adhoc", "kept"), ("q2", 2.0, "Managed", None)], "q string, weight double, o string, note string")
    new = spark.createDataFrame([("q1", None, "Defined"), ("q9", 3.0, "Adhoc")], "q string, weight double, o string")
    assert sorted(tuple(r) for r in ratings.upsert(old, new, "q", ["weight", "o"]).collect()) == [("q1", 1.0, "Defined", "kept"), ("q2", 2.0, "Managed", None), ("q9", 3.0, "Adhoc", None)]
    raw = spark.createDataFrame([("A", "q1", "x", "odd"), ("A", "q2", "2", " Managed ")], "dimension string, question_id string, weight string, o string")
    assert [tuple(r)[2:] for r in ratings.from_template(raw, ["o", "absent"]).collect()] == [(1.0, "Adhoc"), (2.0, "Managed")] and ratings.absent(raw, ["o", "absent"]) == ["absent"]
    assert [spark.range(1).select(ratings.whole_level(F.lit(x)), ratings.as_score(F.lit(str(x)))).first()[:] for x in (0.2, 4.6, 9.0)] == [(1, 0.2), (5, 4.6), (5, 5.0)]
    assert set(ratings.report_set(long.withColumn("o", F.col("rating")).drop("rating", "object"), ["o"])) == {"Dimension Scores", "Overall", "Details", "Exceptions"}


def names(n, seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(rnd.randrange(1, 5)))
    out = []
    for _ in range(n):
        v = " ".join(["a" + word(), *(word() for _ in range(rnd.randrange(4))), *rnd.choices(["ltd", "co", "", "and sons"], k=1)]).strip()
        if out and rnd.random() < 0.5:  # a neighbour: a letter changed, a word dropped, doubled or added, the words turned
            v = rnd.choice(out)
            k, w = rnd.randrange(1, len(v) + 1), v.split()
            v = rnd.choice([v[:k] + rnd.choice("xé ") + v[k:], v[: k - 1] + v[k:], " ".join(w[:-1]) or v, " ".join([*w, w[0]]), " ".join([*w, "q"]), " ".join(w[::-1]), v + "\u2003z"])
        out.append(v)
    return [v for v in dict.fromkeys(out) if v]


def frame_of(blocks):
    rows = sorted((v[:1], i, v, w) for i, (v, w) in enumerate(blocks))
    frame = pd.DataFrame(rows, columns=["_block", "_node", "v0", "v1"])
    return frame.assign(_i=0, _j=0, _t=0)


def brute_pairs(frame, used, threshold, scorer, rounded):
    f, out = scorers.SCORERS[scorer], {}
    for _, g in frame.groupby("_block"):
        for x, y in itertools.combinations(g.to_dict("records"), 2):
            s = sum(w * (100.0 if x[c] == y[c] else f(x[c], y[c])) for c, w in used) / sum(w for _, w in used)
            s = float(round(s)) if rounded else s
            if s >= threshold:
                out[frozenset((x["_node"], y["_node"]))] = s
    return out


@pytest.mark.parametrize("scorer", ["token_set", "hybrid", "ratio"])
@pytest.mark.parametrize("threshold, rounded, two", [(95, True, False), (88, False, False), (100, False, False), (55, False, False), (90, False, True), (70, True, True)])
def test_near_pairs_equal_brute_force(scorer, threshold, rounded, two):
    values, rnd = names(130, threshold), random.Random(4)
    frame, used = frame_of([(v, rnd.choice(["", "port", "porto", "x y", "lodz"])) for v in values]), [("v0", 3.0), ("v1", 1.0)][: 1 + two]
    got = {}
    for found in near.compare(frame, used, threshold, scorer, rounded):
        got |= {frozenset((a, b)): s for a, b, s in zip(found["src"], found["dst"], found["score"])}
    expected = brute_pairs(frame, used, threshold, scorer, rounded)
    assert set(got) == set(expected)
    assert all(got[k] == pytest.approx(expected[k]) for k in got)


def scored(monkeypatch, frame, *options):
    counts, score = [], near._scored
    monkeypatch.setattr(near, "_scored", lambda *a: counts.append(len(a[-1])) or score(*a))
    list(near.compare(frame, *options))
    return sum(counts)


def test_few_pairs_of_a_block_get_a_token_set_score(monkeypatch):
    """fuzzy_basic scored every pair of a block."""
    frame = frame_of([(v, "") for v in names(3000)]).assign(_block="a")
    n = len(frame)
    assert scored(monkeypatch, frame, [("v0", 1.0)], 95, "token_set", True) < n * (n - 1) / 2 / 20


def test_tiles_of_a_block_have_every_pair(spark, monkeypatch):
    monkeypatch.setattr(near, "TILE", 20)
    frame = frame_of([(v, "") for v in names(150)]).assign(_block="a")
    nodes = spark.createDataFrame(frame[["_block", "_node", "v0"]], "_block string, _node long, v0 string")
    got = {frozenset((r["src"], r["dst"])): r["score"] for r in near.pairs(nodes, ["v0"], 90, [1.0], "token_set").collect()}
    assert got == brute_pairs(frame, [("v0", 1.0)], 90, "token_set", False)


def test_partners_among_many_values_of_one_letter(spark):
    """studio_group_rules compared each of the phone numbers, which all begin with the same letter, with all others."""
    df = spark.range(0, 30_000, 1, 4).selectExpr("concat('+91 98765', lpad(cast(id as string), 5, '0')) as v")
    turned = spark.range(0, 30_000, 1500).selectExpr("concat('+91 98765', lpad(cast(id as string), 5, '0'), ' +91') as v")  # the same tokens
    assert studio.fuzzy_dups(df.unionByName(turned), "v", 100).first()["fail_count"] == 40


def test_few_pairs_of_a_block_get_a_hybrid_score(monkeypatch):
    """fuzzy_core scored every pair of a block."""
    rnd = random.Random(2)
    frame = frame_of([(v, rnd.choice(["gdynia", "porto", "lodz", "new bergen", "saint ives"])) for v in names(2000)]).assign(_block="a")
    n = len(frame)
    assert scored(monkeypatch, frame, [("v0", 3.0), ("v1", 1.0)], 90, "hybrid", False) < n * (n - 1) / 2 / 20


@given(st.text(alphabet="ab c", max_size=9), st.text(alphabet="ab cé", max_size=9))
@settings(max_examples=300, deadline=None)
def test_partial_ratio_equals_its_windows(a, b):
    short, long = sorted((a, b), key=len)
    every = lambda x, y: [scorers.ratio(x, y[max(0, i) : i + len(short)]) for i in range(1 - len(short), len(y)) if y[max(0, i) : i + len(short)]]
    best = max(every(short, long) + (every(long, short) if len(a) == len(b) else [])) if short else 100.0 if a == b else 0.0
    assert scorers.partial_ratio(a, b) == best


def test_partial_ratio_takes_few_steps():
    """A window's subsequences come from one pass over all windows, not from a pass for each."""
    a, b = "kakheddid jatfaljur hardware and sons", "kakhedid jatfaljur hardware & sons limited"
    calls, lcs = [], scorers._lcs
    scorers._lcs = lambda x, y: calls.append(1) or lcs(x, y)
    try:
        assert scorers.partial_ratio(a, b) > 90
    finally:
        scorers._lcs = lcs
    assert len(calls) < 5


def test_groups_over_tiles_are_those_of_whole_blocks(spark, monkeypatch):
    values = [v for v in names(150, 5) for _ in range(1 + (len(v) % 7 == 0))]
    got = []
    for tile in (near.TILE, 25):
        monkeypatch.setattr(near, "TILE", tile)
        members, _ = fuzzy.matches(frame(spark, values), ["v"], F.col("i"), threshold=88)
        groups = {}
        for r in members.collect():
            groups.setdefault((r["_group"], r["_score"]), []).append(r["_row"])
        got.append(sorted((sorted(g), s) for (_, s), g in groups.items()))
    assert got[0] == got[1] and [g for g, _ in got[0]] == brute_fuzzy(values, 88)
    assert all(s == 100 for g, s in got[0] if len({values[i] for i in g}) < len(g))


def test_shared_words_alone_do_not_ask_for_a_score(monkeypatch):
    """uniqueness_fuzzy scored every pair of a block, also those that share no more than usual words."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") + rnd.choice("dklmnprst") for _ in range(3))
    rows = frame_of([(f"ab{word()} {word()} {w}", "lodz") for w in ("trading private limited", "and sons", "co") for _ in range(400)]).assign(_block="ab")
    n = len(rows)
    assert scored(monkeypatch, rows, [("v0", 3.0), ("v1", 1.0)], 90, "hybrid", False) < n * (n - 1) / 2 / 50


def test_uniqueness_finds_the_groups_of_brute_force(spark):
    values = names(100, 11)
    records, _ = uniqueness.duplicates(frame(spark, values), uniqueness.Uniqueness(("v",), alike=(uniqueness.Alike(("v",), 88),)), F.col("i"))
    groups = {}
    for r in records.collect():
        groups.setdefault(r["Duplicate_Group_ID"], []).append(r["Row_Number"])
    assert sorted(sorted(g) for g in groups.values()) == brute_fuzzy(values, 88)
