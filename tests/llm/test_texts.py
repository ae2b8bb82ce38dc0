"""Problems 6 to 8 on small fixtures."""

import random
from collections import defaultdict

import pytest

pytest.importorskip("loamgrid.llm")
from loamgrid.llm import abuse, folding, leaks, packing  # noqa: E402

DOC = "doc_id long, text string, source string, n_tokens string, item_id string"


def docs(spark, texts, parts=3):
    return spark.createDataFrame([(i, t, "s" if i % 2 else None, "", "") for i, t in enumerate(texts)], DOC).repartition(parts)


# Problem 6


def test_packing_round_trip(spark):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["alpha", "beta", "x = y + 1;", "ümlaut"]) for _ in range(rnd.choice([1, 5, 40, 90, 400]))) for _ in range(200)] + ["", None, "word " * 5000, "dup", "dup"]
    got = packing.pack(docs(spark, texts), capacity=256).collect()
    counts = packing.token_counts([t or "" for t in texts], packing.vocabulary_path())
    by_doc, by_box = defaultdict(list), defaultdict(int)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_box[r["container_id"]] += r["n_tokens"]
    assert max(by_box.values()) <= 256
    assert set(by_doc) == {i for i, t in enumerate(texts) if t is not None}
    for i, rows in by_doc.items():
        rows.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in rows] == list(range(len(rows))) and sum(r["n_tokens"] for r in rows) == counts[i]
        assert len(rows) == 1 if counts[i] <= 256 else all(r["n_tokens"] == 256 for r in rows[:-1])
        assert [r["start_token"] for r in rows] == [256 * k for k in range(len(rows))]
    assert packing.pack(docs(spark, texts).limit(0)).count() == 0
    assert packing.report(packing.pack(docs(spark, texts).limit(0))).collect()[0]["n_containers"] == 0


def test_windows_hardly_change_the_packing(spark):
    rnd = random.Random(3)
    texts = [" ".join(["alpha"] * int(min(300, rnd.lognormvariate(3.5, 1)))) for _ in range(600)] + [""] * 5
    used = []
    for window in (10**9, 40):
        got = packing.pack(docs(spark, texts, 1), capacity=256, window=window).collect()
        assert len({(r["doc_id"], r["piece"]) for r in got}) == len(got) and {r["doc_id"] for r in got} == set(range(605))
        room = defaultdict(int)
        for r in got:
            room[r["container_id"]] += r["n_tokens"]
        assert max(room.values()) <= 256
        used.append(len(room))
    assert used[1] <= used[0] + 2


def test_packing_wastes_little():
    rnd = random.Random(4)
    p = packing.Packer(4096)
    total = 0
    for i in range(5000):
        n = min(4096, int(rnd.lognormvariate(6, 1)) + 1)
        total += n
        p.add((i, 0, 0), n)
    p.close()
    out = p.take()
    assert len(out) == 5000 and len({o[0] for o in out}) * 4096 * 0.98 < total
    q = packing.Packer(4096)
    for i in range(9):
        q.add((i, 0, 0), 1000)  # class 4: four a bin
    q.close()
    nine = q.take()
    assert sorted(sum(o[4] for o in nine if o[0] == c) for c in range(3)) == [1000, 4000, 4000]


# Problem 7

ITEM = "Only the frozen lantern knows which harbour to verify; the copper ledger and the quiet anvil have to count by catalogue. Explain why the dense orchard may limit the river locally, given that nobody asked the candle to limit first."


def test_leaks(spark):
    w = ITEM.split()
    quoted = "\n".join("> # " + " ".join(w[i : i + 6]) for i in range(0, len(w), 6))
    edited = [x if i % 9 else "changed" for i, x in enumerate(w)]
    texts = [
        "noise before " + ITEM + " noise", quoted.upper(), "a b c " + " ".join(edited), " ".join(w[:14]) + " some words stand between the two pieces here today " + "x y z " * 9 + " ".join(w[20:]), "only eight words: " + " ".join(w[:8]), "", None,
        "nothing", "Write a commit message for the change shown here; mention what was wrong and how it was repaired.", "y " * 60_000 + ITEM, ITEM.replace("o", "о").replace("lan", "lan​"), ITEM.replace(" ", "&nbsp;<br/>\\n"), ITEM + " " + ITEM,
    ]
    note = "Write a commit message for the change shown here; mention what was wrong and how it was repaired. "
    items = [(1, ITEM), (2, None), (3, "short"), (4, "")] + [(10 + k, note + f"tail{k} of its own") for k in range(6)]
    it = spark.createDataFrame([(i, "b", "prose", t) for i, t in items], "item_id long, benchmark string, item_kind string, text string")
    found = sorted(tuple(r) for r in leaks.found(leaks.leaks(docs(spark, texts), it)).collect())
    assert found == [(i, 1) for i in (0, 1, 2, 3, 9, 10, 11, 12)]
    r = [x for x in leaks.leaks(docs(spark, texts), it).collect() if x["doc_id"] == 0][0]
    assert texts[0][r["start"] : r["end"]] == ITEM[:-1]
    assert leaks.leaks(docs(spark, texts).limit(0), it).count() == 0 and leaks.leaks(docs(spark, texts), it.limit(0)).count() == 0


def test_leaks_of_equal_items_templates_and_unspaced_scripts(spark):
    note = "Answer the question below in one short sentence and give no reason. "
    han = "春眠不觉晓处处闻啼鸟夜来风雨声花落知多少白日依山尽黄河入海流欲穷千里目更上一层楼"
    body = "The copper ledger with the quiet anvil has to count by catalogue while nobody may limit the dense orchard or the river before the shallow harbour and its frozen lantern agree on a common rota for every candle that was left behind in the attic"
    items = [(k, ITEM) for k in range(4)] + [(10 + k, f"{body} number{k} of six") for k in range(6)] + [(30 + k, note + f"what{k} is{k} it{k}") for k in range(6)] + [(20, han)]
    it = spark.createDataFrame([(i, "b", "prose", t) for i, t in items], "item_id long, benchmark string, item_kind string, text string")
    texts = ["x " + ITEM, note, "y " + items[5][1], "注：" + han + "。", "\n".join(["the copper ledger with the quiet anvil"] * 30) + " " + ITEM]
    want = {(0, k) for k in range(4)} | {(2, 10 + k) for k in range(6)} | {(3, 20)} | {(4, k) for k in range(4)}
    for most in (leaks.MOST_LETTERS, 300):
        got = leaks.leaks(docs(spark, texts), it, most_letters=most)
        assert {tuple(r) for r in leaks.found(got).collect()} == want


def test_pieces_match_brute_force():
    rnd = random.Random(6)
    for _ in range(60):
        hits = [(rnd.randrange(60), rnd.randrange(12), True) for _ in range(rnd.randrange(80))]
        open_, chains = [], 0
        for p, q, _ in sorted(set(hits)):
            fits = [c for c in open_ if 0 <= p - c[0] <= leaks.GAP and 0 < q - c[1] <= leaks.GAP and abs((p - q) - (c[0] - c[1])) <= leaks.EDIT]
            chains += not fits
            if fits:
                open_.remove(best := min(fits, key=lambda c: (abs((p - q) - (c[0] - c[1])), -c[0])))
            open_.append((p, q))
        assert sum(len(c) >= leaks.PIECE for _, _, c in leaks.pieces(hits)) <= chains


def test_hits_match_brute_force():
    rnd = random.Random(9)
    vocab = ["ab", "b", "cab", "d"]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(12))) for i in range(3)]
    index = leaks.Index(items)
    for _ in range(40):
        t = [rnd.choice(vocab) for _ in range(40)]
        want = defaultdict(set)
        for k, (_, text) in enumerate(items):
            v = text.split()
            for p in range(len(t) - leaks.GRAM + 1):
                for q in range(len(v) - leaks.GRAM + 1):
                    if t[p : p + leaks.GRAM] == v[q : q + leaks.GRAM]:
                        want[k].add((p, q))
        assert {k: {(p, q) for p, q, _ in h} for k, h in index.hits(t).items()} == dict(want)


# Problem 8


def corpus(n=240, seed=1):
    rnd = random.Random(seed)
    nouns = ["parser", "ledger", "router", "cache", "schema", "widget"]
    people = ["Tove", "Borin", "Yara", "Nils"]
    ugly = [lambda: f"shut up {rnd.choice(people)}, you worthless idiot", lambda: f"{rnd.choice(people)}, you are a stupid prick and everybody here knows it", lambda: "those people are vermin and should be thrown out"]
    out = []
    for i in range(n):
        lines = [f"fix the {rnd.choice(nouns)} of each {rnd.choice(nouns)}" for _ in range(6)]
        if i % 10 == 3:
            lines.append(f"this stupid {rnd.choice(nouns)} flakes again")
        bad = i % 4 == 0
        if bad:
            lines.insert(rnd.randrange(6), rnd.choice(ugly)())
        out.append(("\n".join(lines), bad))
    return out


def test_models_find_held_out_documents():
    train, held = corpus(seed=1), corpus(seed=2)
    m = abuse.train([t for t, b in train if b], [t for t, b in train if not b])
    limit = abuse.threshold([t for t, b in train if b], [t for t, b in train if not b])
    right = sum((s > limit) == b for (_, b), s in zip(held, m.score([t for t, _ in held])))
    assert right >= 0.95 * len(held)
    hidden = ["fix the parser\n$hut up Tоve, y​ou w0rthless i d i o t", "SHUT UP NILS, YOU WORTHLESSSSS IDIOT!!!"]
    assert all(s > limit for s in m.score(hidden))
    assert m.score([None, "", "...", hidden[0], hidden[0]])[:3] == [None, None, None]


def test_lines_that_only_begin_like_headers_are_scored():
    header = ["commit 0123456789abcdef", "Author: Tove B <t@x.example>", "Date:   2024-01-02 03:04:05 +0000"]
    diff = ["diff --git a/x.sql b/x.sql", "index 0a1b2c3..4d5e6f7 100644", "--- a/x.sql", "+++ b/x.sql"]
    c = corpus(seed=1)
    m, limit = abuse.train([t for t, b in c if b], [t for t, b in c if not b]), abuse.threshold([t for t, b in c if b], [t for t, b in c if not b])
    ugly = "shut up Nils, you worthless idiot"
    begun = [start + ugly for start in ("--- ", "+++ ", "index ", "commit ", "Author: ", "Date: ", "Merge: ", "diff --git ", "@@ ", "@@ -1,2 +3,4 @@ ")]
    texts = ["\n".join([*header, "", "    fix the parser", "", *diff, "@@ -1,2 +3,4 @@", line, "+fix the cache"]) for line in begun]
    assert all(s is not None and s > limit for s in m.score(texts))
    assert abuse.lines_of("\n".join([*header, *diff, "@@ -1 +1 @@ def f():", "--- a/b c"])) == [" def f():", "--- a/b c"]


def test_kneser_ney_probabilities_sum_to_one():
    import numpy as np

    m = abuse.Models([("a", "b", "c"), ("a", "b", "b")], [("c", "a"), ("b", "c", "a", "b")])
    every = np.arange(1, m.size)
    for part in m.parts:
        for u, v in ((m.ids["a"], m.ids["b"]), (m.ids["c"], m.ids["c"]), (m.ids["<s>"], m.ids["<s>"])):
            p = np.exp(m._log_p(part, np.full(len(every), u), np.full(len(every), v), every)).sum()
            assert p == pytest.approx(1.0, abs=1e-6)


def test_scored_tables(spark):
    c = corpus(120)
    texts = [t for t, _ in c] + [None, "", "x" * 100_000]
    labels = [(i, "abusive" if b else "clean", "r") for i, (_, b) in enumerate(c)] + [(0, None, "r"), (None, "clean", "r"), (99999, "abusive", "r"), (0, "clean", "r"), (0, "hateful", "r")]
    lab = spark.createDataFrame(labels, "doc_id long, label string, reviewer string")
    s = abuse.scored(docs(spark, texts), lab)
    got = {r["doc_id"]: r for r in s.collect()}
    assert len(got) == len(texts) and sum(got[i]["flagged"] == b for i, (_, b) in enumerate(c)) >= 0.95 * len(c)
    assert got[120]["score"] is None and not got[120]["flagged"] and got[121]["score"] is None
    rates = {r["source"]: r for r in abuse.rates(s).collect()}
    assert sum(r["n_docs"] for r in rates.values()) == len(texts) and None in rates
    assert abuse.scored(docs(spark, texts).limit(0), lab).count() == 0
    assert {r["score"] for r in abuse.scored(docs(spark, texts), lab.limit(0)).collect()} == {None}


def test_folding():
    assert folding.fold("nаked ve­rmin") == "naked vermin"
    assert [abuse.canonical(t) for t in ("$h!th34d", "idiiiot", "12", "x9q2", "a**e")] == ["shithead", "idiot", "<number>", "", "<masked>"]
