"""Problems 1 to 4 on small fixtures."""

import datetime as dt
import random
import string

import pytest

pytest.importorskip("loamgrid.llm")
from loamgrid.llm import formatting, names, places, survivors  # noqa: E402

SEP = formatting.SEPARATOR
VENDOR = "row_id long, vendorname string, city string, country string, contact_email string, phone string, pan_number string, row long"
MEMBER = "_rule string, _group_id long, _group_size long, row_id long, contact_email string, phone string, pan_number string, payment_terms string, credit_limit string, source_system string, updated_at timestamp, value string"


def ids(df):
    return sorted(tuple(r) for r in df.collect())


# Problem 4


def brute_copies(rows):
    first, out = {}, []
    for i, key, cols in sorted(rows):
        if key is None or cols is None:
            continue
        fields = sorted((c.strip().lower(), "!" if v.strip() == "<NULL>" else "".join(ch for ch in v.lower() if ch.isalnum())) for c, v in zip(cols.split(","), key.split(SEP), strict=True))
        fields = repr(fields)
        if fields in first:
            out.append((first[fields], i))
        else:
            first[fields] = i
    return sorted(out)


def test_copies_match_brute_force(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(300):
        vals = [rnd.choice(["Ab c", "aB-C", "a.b,c", "abd", "<NULL>", "", "É1", "é 1"]), rnd.choice(["+1 2", "12", "1-2!", "21"])]
        cols = ["Name", "Phone"]
        if rnd.random() < 0.5:
            vals, cols = vals[::-1], cols[::-1]
        rows.append((i, SEP.join(vals), ", ".join(cols)))
    df = spark.createDataFrame(rows, "rec_id long, _dup_key string, _match_cols string").repartition(5)
    assert ids(formatting.copies(df)) == brute_copies(rows)


def test_formatting_edges(spark):
    long = "x" * 200_000
    rows = [
        (1, None, "A"), (2, "a", None), (3, "", "A"), (4, "--", "A"), (5, "<NULL>", "A"), (6, " <NULL> ", "a"), (7, long, "A"), (8, long.upper() + ".", "A"),
        (9, "Ｎｏ１", "A"), (10, "no1", "A"), (11, f"p{SEP}q", "A"), (12, "null", "A"), (13, f"ab{SEP}c", "A, B"), (14, f"a{SEP}bc", "A, B"), (15, "straße", "A"), (16, "STRASSE", "A"),
    ]
    df = spark.createDataFrame([(*r, 0, "") for r in rows], "rec_id long, _dup_key string, _match_cols string, n_copies int, check string")
    assert ids(formatting.copies(df)) == [(3, 4), (5, 6), (7, 8), (9, 10)]
    assert formatting.copies(df.limit(0)).count() == 0
    marks = spark.createDataFrame([(1, "Caf\u00e9 1", "A"), (2, "cafe\u0301-1", "A"), (3, "cafe1", "A"), (4, "\u1e0b\u0323", "A"), (5, "d\u0323\u0307", "A")], "rec_id long, _dup_key string, _match_cols string")
    assert ids(formatting.copies(marks)) == [(1, 2), (4, 5)]
    clash = spark.sql("select * from values (unhex('0a'), 1L, 1L, 3L), (unhex('0a'), 2L, 5L, 2L), (unhex('0b'), 1L, 9L, 1L) as t(h128, check, keep_rec_id, n_copies)")
    assert [tuple(r)[1:] for r in formatting.collisions(clash).collect()] == [(2, 5)]
    assert formatting.collisions(formatting.collapse(df)).count() == 0


def test_rows_of_a_hot_group_are_split(spark):
    rows = spark.range(0, 60_000, 1, 6).selectExpr("id as rec_id", "case when id % 10 < 7 then 'hot key' else concat('k', id % 9000) end as _dup_key", "'A' as _match_cols")
    options = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB"}
    before = {k: spark.conf.get(k) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        got = formatting.copies(rows)
        assert got.count() == got.where("keep_rec_id < rec_id").count() > 41_000
        got.write.format("noop").mode("overwrite").save()
        got.collect()
        assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


# Problem 2


def test_survivors(spark):
    t = lambda y: dt.datetime(y, 1, 1)
    rows = [
        ("r", 1, 9, 5, "a@x", None, "P1", "NET30", "5", "low", t(2024), "v"), ("r", 1, 9, 3, "a@x", " n/a ", "P2", "", "7", "top", t(2020), "v"), ("r", 1, None, 4, "b@x", "1", "P3", None, "7", "top", t(2021), "v"),
        ("r", 1, 9, 4, "b@x", "1", "P3", None, "7", "top", t(2021), "v"), ("r", 2, 1, 6, "c@x", "2", None, None, None, None, None, "v"), ("r", 2, 1, 7, "d@x", "2", None, None, None, "unknown", None, "v"), (None, None, 1, 8, "z", "", None, None, "\t", "top", None, "v"),
    ]
    src = spark.createDataFrame([("top", 1, "o"), ("low", 5, "o"), (None, 3, "o"), ("top", 1, "again")], "source_system string, trust_rank int, owner_team string")
    df = spark.createDataFrame(rows, MEMBER)
    got = sorted(((r["_rule"] or "", r["_group_id"] or 0, r["column_name"], r["value"], r["row_id"]) for r in survivors.survivors(df, src).collect()))
    assert got == sorted([
        ("r", 1, "contact_email", "b@x", 4), ("r", 1, "phone", "1", 4), ("r", 1, "pan_number", "P3", 4), ("r", 1, "payment_terms", "NET30", 5), ("r", 1, "credit_limit", "7", 3),
        ("r", 2, "contact_email", "d@x", 7), ("r", 2, "phone", "2", 6), ("", 0, "contact_email", "z", 8),
    ])
    wide = {(r["_rule"], r["_group_id"]): r for r in survivors.golden(df, src).collect()}
    assert wide[("r", 1)]["n_members"] == 4 and wide[("r", 2)]["payment_terms"] is None and wide[(None, None)]["contact_email"] == "z"
    assert survivors.survivors(df.limit(0), src).count() == 0 and survivors.survivors(df, src.limit(0)).count() == 8


# Problem 3

LIST = [
    (1, "country", "Norvalia", "NOR", None, "Republic of Norvalia"), (2, "country", "Estrania", "EST", None, "Estrania Islands Union"), (3, "country", "Gorland", "GOR", None, "Republic of Gorland"), (4, "country", "Vimland", None, None, "Vimland Islands Union"),
    (10, "city", "Kelbuzmar", None, 1, "Oldname"), (11, "city", "Kelbuzmar", None, 2, None), (12, "city", "Saint Hamsor", None, 1, None), (13, "city", "Saint Tolvek", None, 2, None), (14, "city", "Saint Rupmin", None, 3, None), (15, "city", "Kelbuzmir", None, 3, None), (None, "city", "Void", None, 1, None), (16, "city", None, None, 1, None),
]
PLACES = "ref_id long, place_kind string, ref_value string, place_code string, country_ref_id long, alt_names string"


def test_places(spark):
    cases = [
        ("Kelbuzmar", "Norvalia", 10, 1), ("KELBUZMAR", "estrania", 11, 2), ("Kelbuzmr", "Rep. of Norvalia", 10, 1), ("Kelbuzmri", "Gorland", 15, 3), ("St. Hamsor", "N.O.R.", 12, 1), ("Hamsor Saint", "Norvalai", 12, 1),
        ("Saint Tolvek, Estrania", None, 13, None), ("Kelbuzmar / Estrania", " n/a ", 11, None), ("Saint Tolvek 12345", "Estrania Is. Union", 13, 2), ("oldname", "", 10, None), ("head office", "overseas", 0, 0), (None, "\t", None, None), ("Q" * 100_000, "???", 0, 0), ("Saint Rupm.", "Gorland *", 14, 3),
    ]
    df = spark.createDataFrame([(i, "n", c, k, None, None, None, 0) for i, (c, k, _, _) in enumerate(cases)], VENDOR)
    ref = spark.createDataFrame(LIST, PLACES)
    m = places.mapped(df, ref)
    got = {r["row_id"]: (r["city_ref"], r["country_ref"]) for r in m.collect()}
    assert got == {i: (a, b) for i, (_, _, a, b) in enumerate(cases)}
    assert places.found(m).count() == sum((a is not None) + (b is not None) for _, _, a, b in cases)
    assert {r["value"] for r in places.misses(m).collect()} == {"head office", "overseas", "???", "Q" * 100_000}
    assert places.mapped(df.limit(0), ref).count() == 0
    parts = places.mapped(df, ref, most_entries=4)  # the list in parts gives the same
    assert {r["row_id"]: (r["city_ref"], r["country_ref"]) for r in parts.collect()} == got
    assert {r["city_ref"] for r in places.mapped(df, ref.limit(0)).collect()} == {0, None}


def test_long_words_may_lack_as_many_letters_as_short_ones():
    g = places.Gazetteer([(1, "Krasnovodarskiyeopolis", None, None, None), (2, "Kelbuzmar", None, None, None)], set(), set())
    assert g.find("Krsnvdarskiyeopolis")[0][1] == 1 and g.find("Klbzmar")[0][1] == 2


def test_symmetric_deletes_reach_every_close_string():
    rnd = random.Random(3)
    word = "kelbuzmar"
    index = places.deletes(word, 2)
    for _ in range(300):
        s = list(word)
        for _ in range(2):
            k, i = rnd.randrange(3), rnd.randrange(len(s))
            if k == 0:
                s[i] = rnd.choice(string.ascii_lowercase)
            elif k == 1:
                s.insert(i, rnd.choice(string.ascii_lowercase))
            else:
                del s[i]
        assert index & places.deletes("".join(s), 2)
    assert places.distance("abc", "abc", 3) == 0 and places.distance("acb", "abc", 3) == pytest.approx(0.7) and places.distance("", "ab", 3) == 2


# Problem 1


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs_matches_brute_force():
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abcd") for _ in range(rnd.randrange(14))) for _ in range(2))
        assert names.lcs(a, b) == brute_lcs(a, b)


def test_vendor_pairs(spark):
    rows = [
        (1, "Fovgekdid Morfuxvim Foods Ltd", "ABCDE1234F", None, None), (2, "Morfuxvim Fovgekdid Foods Limited", None, None, None), (3, "fovgekdidmorfuxvim fds ltd.", None, None, None), (4, "Fovgekdid Morfuxvim Castings Ltd", "BBCDE1234F", None, None),
        (5, "Fovgekdid Morfuxvim Ltd", "ABCDE1234F", None, None), (6, "Margaret Hibgozrav Mevposzit", None, "m@x.example", None), (7, "Mevposzit, Meg Hibgozrav", None, None, None), (8, "M. Hibgozrav Mevposzit", None, None, None), (9, "Oliver Hibgozrav Mevposzit", None, None, None),
        (10, None, "ABCDE1234F", None, None), (11, " n/a ", None, None, None), (12, "Ltd", None, None, None), (13, "Ltd", None, None, None), (14, "Fovgekdid  Morfuxvim Foods Ltd [old]", None, None, None), (15, "Unrelated Tolvarek Gumbiran Foods Ltd", None, None, None), (16, "z" * 50_000, None, None, None),
    ]
    df = spark.createDataFrame([(i, n, None, None, m, t, p, 0) for i, n, p, m, t in rows], VENDOR)
    got = ids(names.pairs(df.repartition(4)))
    org, person = [1, 2, 3, 5, 14], [6, 7, 8]
    want = sorted([(a, b) for g in (org, person) for i, a in enumerate(g) for b in g[i + 1 :]])
    assert [p for p in got if 12 not in p] == want
    assert names.pairs(df.limit(0)).count() == 0
    v = {r["row_id"]: (r["vendor_row_id"], r["n_rows"]) for r in names.vendors(df).collect()}
    assert v[14] == (1, 5) and v[4] == (4, 1) and 10 not in v and 11 not in v


def test_a_contact_on_many_rows_still_links_acronyms_and_other_endings(spark):
    phone = "+49 30 1234567"
    known = [(i, "Fovgekdid Tolmuvar Papers Ltd", phone) for i in range(names.SHARED + 5)]
    odd = [(1000, "FTP LLP", phone), (1001, "F.T. Ltd", phone), (1002, "Fovgekdib Tolmuvas Papers Ltd", phone), (1003, "Bolgidrex Nusvarhim Papers Ltd", phone), (1004, "BNP LLP", None)]
    df = spark.createDataFrame([(i, n, None, None, None, t, None, 0) for i, n, t in known + odd], VENDOR)
    got = {r["row_id"]: r["vendor_row_id"] for r in names.vendors(df.repartition(4)).collect()}
    assert [got[i] for i in (1000, 1001, 1002, 1003, 1004)] == [0, 0, 0, 1003, 1004]
    two = [(2000, "Fursilgop Tagvorwin Foods Ltd", phone), (2001, "FT Ltd", phone)]  # a vendor with as many spellings: the acronym is undecided
    df = spark.createDataFrame([(i, n, None, None, None, t, None, 0) for i, n, t in known + two], VENDOR)
    got = {r["row_id"]: r["vendor_row_id"] for r in names.vendors(df).collect()}
    assert got[2001] == 2001 and got[2000] == 2000 and got[1] == 0


def vendors_of(spark, cells):
    df = spark.createDataFrame([(i, n, None, None, None, t, None, 0) for i, (n, t) in enumerate(cells)], VENDOR)
    return {r["row_id"]: r["vendor_row_id"] for r in names.vendors(df.repartition(3)).collect()}


def test_one_typing_error_anywhere_and_words_that_tell_apart(spark):
    cells = ["Bremolqast Foods Ltd", "Bromolqast Foods Ltd", "Zarkovin Ltd", "Zerkovin Ltd", "New Fovgekdid Morfuxvim Foods", "Old Fovgekdid Morfuxvim Foods", "Main Office Supplies", "Fovgekdid Morfuxvim Foods - Head Office", "Fovgekdid Morfuxvim Foods"]
    got = vendors_of(spark, [(c, None) for c in cells])
    assert [got[i] for i in range(9)] == [0, 0, 2, 2, 4, 5, 6, 7, 7], got
    got = vendors_of(spark, [("New Fovgekdid Morfuxvim Foods", "+49 30 1234567"), ("Old Fovgekdid Morfuxvim Foods", "+49 30 1234567")])
    assert got == {0: 0, 1: 0}


@pytest.mark.parametrize("common, crowded", [(24, 400), (1, 3), (1, 1)])
def test_common_suffixes_are_refined_and_lose_no_link(spark, monkeypatch, common, crowded):
    monkeypatch.setattr(names, "COMMON", common)
    monkeypatch.setattr(names, "CROWDED", crowded)
    first = ["tolmuvar", "borsipgan", "kevludhar", "nemroxfit", "pasgudvil", "wurhekcom"]
    cells = [f"{f.capitalize()} Fovgekdid Foods Ltd" for f in first]
    cells += [f"{f[0].upper()}{f[2]}{f[1]}{f[3:]} Fovgekdid Foods Ltd" for f in first] + [f"{f.capitalize()} Fovgekdid Foods Ltd."[: len(f) - 1] + "x Fovgekdid Foods Ltd" for f in first]
    got = vendors_of(spark, [(c, None) for c in cells])
    assert [got[i] for i in range(18)] == [0, 1, 2, 3, 4, 5] * 3


def test_links_do_not_depend_on_partitions(spark):
    rnd = random.Random(5)
    syll = ["fov", "gek", "did", "mor", "fux", "vim", "tol", "ban", "rir", "sot"]
    rows = []
    for i in range(150):
        core = ["".join(random.Random(i // 5 * 7 + k).choice(syll) for _ in range(3)) for k in (0, 1)]
        core = [c if rnd.random() < 0.7 else c[: (j := rnd.randrange(9))] + rnd.choice("aeiou") + c[j:] for c in core]
        rows.append((i, " ".join([*core, "Foods Ltd"]), None, None, None, None, None, 0))
    df = spark.createDataFrame(rows, VENDOR)
    assert ids(names.vendors(df.repartition(1))) == ids(names.vendors(df.repartition(13)))
