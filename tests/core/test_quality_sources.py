"""Column profiles between loads, induced expressions, files and streams."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loamgrid.operators import quality
from loamgrid.plans.rules import Rule, plan
from loamgrid.sources import files
from loamgrid.streaming import rules as streaming

W = quality.Watch("t", ("mail", "n", "kind"), {"mail": r"[a-z]+@[a-z]+\.[a-z]+"}, {"n": (1.0, 5.0)}, ("kind",))


def loads(spark):
    rows = [(1, f"{c}@x.yz", str(i % 5 + 1), "A") for i, c in enumerate("abcdefghij")] + [(2, "a@x.yz" if i < 6 else [None, " n/a ", "bad", ""][i - 6], "9" if i < 3 else "2.5", "B" if i < 4 else "A") for i in range(10)] + [(4, None, None, None), (None, "z", "1", "A")]
    return spark.createDataFrame([(*r, "x") for r in rows], "load_id int, mail string, n string, kind string, value string").repartition(3)


def test_findings(spark):
    c = quality.value_counts(loads(spark), W)
    got = {(r["load_id"], r["column_name"], r["finding"]) for r in quality.findings(quality.changes(c, W)).collect()}
    assert got == {(2, "mail", "missing"), (2, "mail", "distinct"), (2, "n", "range"), (2, "n", "distinct"), (2, "kind", "mix")} - ({(2, "n", "distinct")} if abs(2 / 10 - 5 / 10) <= 0.25 else set())
    p = {(r["load_id"], r["column_name"]): r for r in quality.profile(c, W).collect()}
    assert p[(2, "mail")]["n_missing"] == 3 and p[(2, "mail")]["n_bad_pattern"] == 1 and p[(4, "mail")]["pattern"] is None and p[(1, "n")]["max_number"] == 5.0
    assert quality.findings(quality.changes(quality.value_counts(loads(spark).limit(0), W), W)).count() == 0


def test_violations_counted_through_expressions_equal_those_counted_at_once(spark):
    c = quality.value_counts(loads(spark), W)
    s = quality.shapes(c.where("column_name = 'mail'"), W)
    both = [{tuple(r)[:4]: r["change"] for r in quality.changes(c, W, x).collect()} for x in (None, quality.covered(s, quality.induce(s)))]
    assert both[0] == both[1] and (loads(spark).count(), any(k[3] == "pattern" for k in both[0])) == (22, True)
    found = quality.coverage_findings(quality.coverage(s, quality.induce(s))).collect()
    assert all(abs(r["change"]) > quality.COVERAGE and r["finding"] == "coverage" for r in found)


def test_expressions_of_one_build_are_joined():
    make = lambda kinds, n: quality.Expression(kinds, (1,) * len(kinds), (3,) * len(kinds), n, "", ("".join(kinds),))
    few = quality._searched([make(("U", "'-", "D"), 2), make(("L", "'-", "D"), 2), make(("D", "'-", "D"), 1)], 5)
    assert len(few) == 1 and few[0].text_and_bits()[0] == r"[\p{L}0-9]{1,3}\-[0-9]{1,3}" and few[0].n == 5
    many = quality._searched([make(("U", "'-", "D"), 10_000), make(("D", "'-", "D"), 10_000)], 20_000)
    assert len(many) == 2
    assert quality.Expression(("'+", "D", "S", "D"), (1, 2, 1, 3), (1, 2, 1, 5), 99, "+49 3", ("k",)).text_and_bits()[0] == r"\+49 3[0-9]{2,4}"


def test_expressions_cover_their_values(spark):
    vals = [f"AB{i:04d}" for i in range(300)] + [f"x-{i}" for i in range(100, 160)] + ["odd one out!", None, "  ", "q" * 50_000]
    df = spark.createDataFrame([(1 + i % 2, v) for i, v in enumerate(vals)], "load_id int, mail string")
    w = quality.Watch("t", ("mail",))
    s = quality.shapes(quality.value_counts(df, w))
    kept = [r["expression"] for r in quality.induce(s).collect()]
    assert r"AB0[0-9]{3}" in kept and r"x\-1[0-9]{2}" in kept
    plain = [k.replace(r"\p{Lu}", "[A-Z]").replace(r"\p{L}", "[a-z]") for k in kept]
    assert all(any(re.fullmatch(k, v) for k in plain) for v in vals[:360])
    cover = quality.coverage(s, quality.induce(s)).collect()
    assert sum(r["n_rows"] for r in cover) == 362 and {r["change"] is None for r in cover if r["load_id"] == 1} == {True}
    assert quality.induce(s.limit(0)).count() == 0


def test_values_of_many_runs_get_expressions(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(3, 9))).capitalize()
    rows = [(1, " ".join(word() for _ in range(rnd.randrange(7, 11)))) for _ in range(150)] + [(2, ". ".join(word() for _ in range(8)) + " [old] x-1 \t a.b (c) z9 " + word()) for _ in range(150)]
    rows += [(2, " a1 b2  c3 d4 e5 f6 "), (2, "A\u001fB c D e F g H i J k L m"), (2, "\U0001f600" * 20)]
    df = spark.createDataFrame(rows, "load_id int, v string")
    counts = quality.value_counts(df, quality.Watch("t", ("v",)))
    s = quality.shapes(counts)
    kept = quality.induce(s)
    assert s.agg(F.sum("n_values")).first()[0] == counts.count()
    assert {r["load_id"] for r in quality.coverage(s, kept).where("expression is not null").collect()} == {1, 2}
    met = counts.select("value", quality.long_shape(F.col("value"))["kinds"].alias("kinds")).join(kept, "kinds").selectExpr("value", r"rlike(value, concat('\\A(?:', expression, ')\\z')) as fits").collect()
    assert len(met) >= 300 and all(r["fits"] for r in met)


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text(' id ,name,empty\n1,"x, ""y""",\n2,,\n,,\n')
    df = files.read(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id", "name", "empty"] and [tuple(r) for r in df.collect()] == [("1", 'x, "y"', ""), ("2", "", ""), ("", "", "")]
    typed = files.drop_empty(files.read_typed(spark, str(tmp_path / "a.csv")))
    assert typed.columns == ["id", "name"] and typed.count() == 2
    data = files.workbook({"One: [x]": (["a", "b"], [("1", None), ("<&>", "z")]), "Two": (["c"], [])})
    (tmp_path / "b.xlsx").write_bytes(data)
    assert files.sheet_names(data) == ["One_ _x_", "Two"] and files.sheet_names(b"no") == []
    assert [tuple(r) for r in files.read(spark, str(tmp_path / "b.xlsx")).collect()] == [("1", ""), ("<&>", "z")]
    used = set()
    assert [files.safe_sheet_name("n" * 40, used) for _ in range(2)] == ["n" * 31, "n" * 29 + "_2"]
    with pytest.raises(ValueError):
        files.read(spark, "x.ods")
    files.write_tables({"T 1": df}, str(tmp_path / "out"), "csv")
    assert spark.read.csv(str(tmp_path / "out" / "T_1"), header=True).count() == 3
    rb = files.read_rulebook(spark.createDataFrame([("c", "Not Null", "d")], "column string, rule_type string, rule_category string")).first()
    assert (rb["column_name"], rb["rule"], rb["dimension"], rb["severity"]) == ("c", "Not Null", "d", None)


def test_small_exports(spark, tmp_path):
    (tmp_path / "t.xlsx").write_bytes(files.workbook({"S": (["a", "b", "c", "d"], [("1", "1.5", "true", "x"), ("", "2", "FALSE", "")])}))
    df = files.read_workbook_typed(spark, str(tmp_path / "t.xlsx"))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "boolean", "string"] and df.collect()[1][:] == (None, 2.0, False, None)
    assert files.preview(df, 1).count() == 1 and files.summary(df).first()[:] == (2, 4)
    marked = df.withColumns({"_is_duplicate": F.lit(True), "_golden": F.col("a").isNotNull(), "_dup_group_id": F.lit("g"), "_row_id": F.lit(1)})
    out = files.golden_set(marked)
    assert out["Golden Records"].columns == df.columns and out["Discarded Records"].count() == 1 and out["Duplicate Groups"].count() == 2
    import io
    import zipfile

    with zipfile.ZipFile(io.BytesIO(files.bundle({"x.txt": b"1", "y": b""}))) as z:
        assert z.namelist() == ["x.txt", "y"] and z.read("x.txt") == b"1"
    blanks = spark.createDataFrame([("  a ", 'q"')], "x string, y string")
    files.write_tables({"B": blanks}, str(tmp_path / "o"), "csv")
    assert files.read(spark, str(tmp_path / "o" / "B") + "/*.csv").first()[:] == ("  a ", 'q"')


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "a@b.cd", "2024-01-01 00:00:00"), (2, "bad", "2024-01-01 00:10:00"), (3, "", "2024-01-01 02:00:00")], "i int, mail string, at string").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "in"))
    checks = plan([Rule("mail", "Validity", "Email Format"), Rule("mail", "Completeness", "Not Null")], df.columns)
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, query, mode in (("s_issues", streaming.issues(stream, checks, F.col("i")), "append"), ("s_log", streaming.running_log(stream, checks), "complete"), ("s_win", streaming.failures_by_window(stream, checks, F.col("i"), "at"), "complete")):
        q = query.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert {(r["Row_Number"], r["Rule_Applied"]) for r in spark.table("s_issues").collect()} == {(2, "Email Format"), (3, "Not Null")}
    assert {(r["Rule"], r["Evaluated"], r["Failed"]) for r in spark.table("s_log").collect()} == {("Email Format", 3, 1), ("Not Null", 3, 1)}
    assert sum(r["failed"] for r in spark.table("s_win").collect()) == 2
