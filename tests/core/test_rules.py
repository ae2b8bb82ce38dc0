"""Truth tables of the row rules, and their plans."""

import pytest
from pyspark.sql import functions as F

from loamgrid.functions import text as T
from loamgrid.operators import assess, report
from loamgrid.plans import planning
from loamgrid.plans.rules import Rule, plan, standardize

NAMES = ["Not Null", "Not Empty", "Whitespace Only", ("Minimum Length", {"min_length": 3}), ("Data Type Validation", {"data_type": "numeric"}), ("Data Type Validation", {"data_type": "integer"}), ("Data Type Validation", {"data_type": "float"}), "Email Format", "Phone Format", "PAN Format", ("Numeric Range", {}), ("Length Check", {"max_length_val": 5}), "Special Characters Not Allowed", "Format Check"]
TRUTH = {
    "": "FFPFPPPPPPPPFF", "   ": "FFFFPPPPPPPPPF", "\t": "FFFFPPPPPPPPPF", "N/A": "FPPFPPPPPPPPFF", " nil ": "FPPFPPPPPPPPPF", "ab": "PPPFFFFFFFFPPP", " a ": "PPPFFFFFFFFPPF", "12": "PPPFPPFFFFPPPP", "-3.50": "PPPPPFPFFFFPFF", "12.": "PPPPFFFFFFPPFF",
    "1e3": "PPPPFFFFFFFPPP", "x@y.co": "PPPPFFFPFFFFFF", "x@y": "PPPPFFFFFFFPFF", "a.b+c@d-e.co.uk": "PPPPFFFPFFFFFF", "+91 98765-43210": "PPPPFFFFPFFFFF", "12345": "PPPPPPFFFFFPPP", "(555) 123-4567": "PPPPFFFFFFFFFF", "abcde1234f": "PPPPFFFFFPFFPP", "ABCDE12345": "PPPPFFFFFFFFPP",
    "A-1": "PPPPFFFFFFFPFF", "JOHN": "PPPPFFFFFFFPPP", "John Smith": "PPPPFFFFFFFFPF", "o'neil": "PPPPFFFFFFFFFF",
}


def rules_of(column="v"):
    out = []
    for n in NAMES:
        name, cfg = n if isinstance(n, tuple) else (n, {})
        out.append(Rule(column, planning.dimension_of(name), name, cfg))
    return out


def test_truth_table(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(TRUTH)], "i int, v string")
    checks = plan(rules_of(), df.columns)
    got = df.select("v", *(c.passes.alias(f"c{k}") for k, c in enumerate(checks))).collect()
    assert {r["v"]: "".join("PF"[not r[f"c{k}"]] for k in range(len(checks))) for r in got} == TRUTH


def test_log_and_issues_agree(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*TRUTH, None])], "i int, v string").repartition(3)
    checks = plan(rules_of() + [Rule("nope", "Validity", "PAN Format"), Rule("v", "Validity", "Allowed Values"), Rule("v", "Validity", "Custom Regex", {"regex": "(["})], df.columns)
    assert len(checks) == len(NAMES) + 1
    issues, log = assess.issues(df, checks, F.col("i") + 2), assess.log(df, checks)
    for r in log.collect():
        assert r["Evaluated"] == len(TRUTH) + 1 and r["Passed"] + r["Failed"] == r["Evaluated"]
    per = {(r["Dimension"], r["Rule_Applied"]): r["count"] for r in issues.groupBy("Dimension", "Rule_Applied").count().collect()}
    assert per == {(r["Dimension"], r["Rule"]): r["Failed"] for r in log.collect() if r["Failed"]}
    assert report.mismatches(report.groups(issues), issues).count() == 0
    assert assess.issues(df.limit(0), checks, F.col("i")).count() == 0 and assess.overall(assess.dimension_scores(assess.log(df.limit(0), checks))).first()["Overall"] == 0


def test_whitespace_only_shows_the_blanks(spark):
    df = spark.createDataFrame([(0, "\t ")], "i int, v string")
    assert assess.issues(df, plan([Rule("v", "Completeness", "Whitespace Only")], df.columns), F.col("i")).first()["Original_Value"] == "'\\t '"


def test_chained_transforms(spark):
    df = spark.createDataFrame([(0, "  ab  Cd "), (1, None), (2, "o'neil mc-donald x2y")], "i int, v string")
    checks, new = standardize([Rule("v", "Standardization", "Remove Extra Spaces"), Rule("v", "Standardization", "Convert to Uppercase")], df.columns)
    rows = [(r["Original_Value"], r["Expected_Value"]) for r in assess.issues(df, checks, F.col("i")).orderBy("Row_Number", "_ord").collect()]
    assert rows == [("  ab  Cd ", "ab Cd"), ("ab Cd", "AB CD"), ("o'neil mc-donald x2y", "O'NEIL MC-DONALD X2Y")]
    assert [r["v"] for r in assess.cleaned(df, new).orderBy("i").collect()][:2] == ["AB CD", None]
    assert df.select(T.proper_case(F.col("v")).alias("p")).collect()[2]["p"] == "O'Neil Mc-Donald X2Y"


@pytest.mark.parametrize("score,name", [(49.99, "Critical"), (50, "High"), (70, "Medium"), (85, "Low"), (95, "Pass")])
def test_severity(spark, score, name):
    assert spark.range(1).select(assess.severity(F.lit(score)).alias("s")).first()["s"] == name


def test_dates(spark):
    df = spark.createDataFrame([("2024-02-30",), ("31/12/2023",), ("1/2/2024",), ("31 Dec 2023",)], "v string")
    got = [str(r["d"])[:10] for r in df.select(T.parse_date(F.col("v"), T.DAY_FIRST).alias("d")).collect()]
    assert got == ["None", "2023-12-31", "2024-02-01", "2023-12-31"]


def test_planning():
    assert planning.dataset_kind(["Vendor ID", "PAN", "Payment-Terms"]) == "Vendor" and planning.dataset_kind(["x"]) == "Other"
    assert Rule("PAN Number", "Validity", "PAN Format") in planning.suggest(["PAN Number"], "Vendor")
    assert planning.problems(Rule("a", "Validity", "Numeric Range", {"range_min": 5, "range_max": 1})) and planning.problems(Rule("a", "Validity", "Custom Regex", {"regex": "("})) and planning.problems(Rule("a", "Validity", "Allowed Values"))
    rules, skipped = planning.from_entries([{"column": "a", "rule": "Not Null"}, {"column": "z", "rule": "Not Null"}], ["a"])
    assert rules == [Rule("a", "Completeness", "Not Null")] and len(skipped) == 1


def test_planning_of_entries():
    from loamgrid.plans import planning
    from loamgrid.plans.rules import Rule

    entries = [{"column": "a", "rule": "Minimum Length", "config": {"min_length": 2}}, {"column": "a", "rule": "Numeric Range", "config": {"range_min": 1}}, {"column": "a", "rule": "Numeric Range", "config": {"range_max": 5}}, {"column": "gone", "rule": "Not Null"}]
    rules, gone = planning.from_entries(entries, ["a"])
    assert rules == [Rule("a", "Completeness", "Minimum Length", {"min_length": 2}), Rule("a", "Validity", "Numeric Range", {"range_min": 1, "range_max": 5})] and len(gone) == 1
    assert planning.selected(rules, dimension="Validity") == rules[1:] and planning.selected(rules, column="b") == []
    assert "Not Null" in planning.library("Vendor")["Completeness"] and planning.library("Other") == {}
    bad = lambda rule, **c: planning.problems(Rule("a", "Validity", rule, c))
    assert bad("Numeric Range", range_min="x") == ["bound is no number"] and bad("Numeric Range", range_min=None, range_max=3) == ["bound is no number"] and bad("Numeric Range", range_min="9", range_max="3") == ["minimum above maximum"]
    assert bad("Allowed Values", allowed_values=7) == [] and bad("Allowed Values") == ["no allowed values"] and bad("Custom Regex", regex="([") == ["pattern does not compile"] and bad("Length Check", max_length_val="-1") == ["max_length_val is no length"]


def test_scores_without_a_log(spark):
    from loamgrid.operators import assess

    none = spark.createDataFrame([], "Dimension string, Row_Number long")
    some = spark.createDataFrame([("Validity", 1), ("Validity", 2)], "Dimension string, Row_Number long")
    log = spark.createDataFrame([("Validity", 10, 1)], "Dimension string, Evaluated long, Failed long")
    assert assess.score_of(None, none, "Completeness", 0, 3) == 0.0 and assess.score_of(None, none, "Completeness", 5, 0) == 0.0 and assess.score_of(None, none, "Standardization", 5, 0) == 100.0
    assert assess.score_of(None, some, "Validity", 4, 2) == 75.0 and assess.score_of(log, some, "Validity", 4, 2) == 90.0 and assess.score_of(log, some, "Completeness", 4, 2) == 100.0
