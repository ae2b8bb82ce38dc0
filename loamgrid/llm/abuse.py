"""Abusive, hateful or sexual language scored by two class-conditional language models (problem 8).

Two Kneser-Ney trigram models are trained on the labelled documents: one of lines that reviewers called abusive,
hateful or sexual, one of ordinary lines. Both back off to one shared unigram distribution of continuation counts, so
that a rare expression is judged by what the classes know of it together. A passage is a window of up to WINDOW words
of a line; its score is the difference of the two log-likelihoods divided by its words. A document's score is that of
its worst passage.

Labels speak of documents, not of lines. So the training starts from the lines of labelled documents whose words lean
most to the bad label, and in ROUNDS rounds takes as bad, in each half of the documents labelled bad, the lines that the
model of the other half scores above PICK and that stand in no two clean documents, so that the lines of a wrongly labelled document find no support.
The lines of documents labelled clean are ordinary, but for those of one document only that the other half's
model scores above PICK + 3. Contradicting labels are settled by
majority, ties by the bad label. The threshold is found on labelled documents that a model trained on the others
scores.

Words are folded first: look-alike letters, hidden signs, digits and signs for letters, letters spelt apart, stretched
letters and case. Words that neither class saw count nothing.

Bounds: the models are fitted on at most MOST_BAD and MOST_CLEAN labelled documents of at most MOST_LETTERS letters,
those with the smallest hash of their id; at most MOST_BAD + MOST_CLEAN times MOST_LETTERS letters come to the driver.
The model of all of them, and the two of one half each for the threshold, are fitted by three tasks. Everything else reads every line of every document but the exact headers of commits and files (`lines_of`).

Defined results: a null or empty text scores null and is no case; labels that are null, and labels of unknown
documents, are left out; without labels of both kinds every score is null; equal texts score equally; a null source is
reported as null. Repeated documents count each time in the rates.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.folding import LEET, fold
from loamgrid.session import ship

# The labels of the review.
BAD = ("abusive", "hateful", "sexual")
MOST_BAD = 1500
MOST_CLEAN = 3000
MOST_LETTERS = 100_000
WINDOW = 6
ROUNDS = 3
DISCOUNT = 0.75
#: A document's first line is taken if its words lean this much to the bad label.
FIRST = 0.3
#: A line of a document labelled bad counts as bad if the model of the other documents scores it above this.
PICK = 2.0
MEMO = 400_000

_RAW = re.compile(r"[$!@]*[^\W_]+(?:[$!@*]+[^\W_]+)*")
_APART = re.compile(r"(?<![^\W_])[^\W\d_](?:([ ._*-])[^\W\d_](?:\1[^\W\d_])+)(?![^\W_])")
_TWICE = re.compile(r"(.)\1+")
# Exact forms of header lines. They count as headers only where such a header stands.
_COMMIT = re.compile(r"commit [0-9a-f]{7,64}$")
_TOP = re.compile(r"(?:Merge: [0-9a-f ]+|Author: .*<[^<>]*>|Date: .*[0-9]{2}:[0-9]{2}:[0-9]{2} .*)$")
_DIFF = re.compile(r'diff --git "?a/.* "?b/')
_INDEX = re.compile(r"index [0-9a-f]+(?:,[0-9a-f]+)*\.\.[0-9a-f]+(?: [0-7]+)?$")
_OLD, _NEW = re.compile(r'--- (?:"?a/|/dev/null$)'), re.compile(r'\+\+\+ (?:"?b/|/dev/null$)')
_HUNK = re.compile(r"@@ -[0-9]+(?:,[0-9]+)? \+[0-9]+(?:,[0-9]+)? @@")


def canonical(token: str) -> str:
    """A typed token as the word meant; '' for numbers and codes."""
    t = token.lstrip("!@")
    if "*" in t:
        return "<masked>"
    if not t.isalpha():
        if t.isdigit():
            return "<number>"
        t = (token if token[0] == "$" or token[0] == "@" else t).translate(LEET)
        if not t.isalpha():
            return ""
    t = _TWICE.sub(r"\1", t)
    return t if len(t) > 1 or t in "ai" else ""


def lines_of(text: str) -> list[str]:
    """A document's lines but for the headers that name its commit and files; of a hunk's header the text behind the numbers.

    A header is told by its form and its place: Merge, Author and Date stand below a commit's line, the names of a
    file's two sides below each other. What only begins like one, such as a removed `-- comment`, is a line.
    """
    lines, out, top = text.split("\n"), [], False
    for i, line in enumerate(lines):
        c = line[:1]
        top = c == "c" and bool(_COMMIT.match(line)) or top and c in ("M", "A", "D") and bool(_TOP.match(line))
        if top or c == "d" and _DIFF.match(line) or c == "i" and _INDEX.match(line):
            continue
        if c == "-" and _OLD.match(line) and i + 1 < len(lines) and _NEW.match(lines[i + 1]) or c == "+" and _NEW.match(line) and i and _OLD.match(lines[i - 1]):
            continue
        out.append(line[m.end() :] if c == "@" and (m := _HUNK.match(line)) else line)
    return out


def tokens_of(line: str) -> list[str]:
    """Typed tokens of a folded line, letters spelt apart put together."""
    if _APART.search(line):
        line = _APART.sub(lambda m: m[0].replace(m[1], ""), line)
    return _RAW.findall(line)


class Models:
    """Both models as sorted arrays, for scoring many lines at once."""

    def __init__(self, bad: list[tuple], clean: list[tuple]):
        words = sorted({w for lines in (bad, clean) for line in lines for w in line} | {"<s>"})
        self.ids = {w: i + 1 for i, w in enumerate(words)}  # 0: unknown
        self.size = len(words) + 1
        grams = [self._count(lines) for lines in (bad, clean)]
        shared: Counter = Counter()
        for _, bi in grams:
            shared.update(w for _, w in bi)
        total = sum(shared.values()) + len(words)
        base = np.full(self.size, 1 / total)
        for w, n in shared.items():
            base[w] = (n + 1) / total
        self.parts = [self._fit(tri, bi, base) for tri, bi in grams]
        self.memo: dict[str, int] = {}

    def _count(self, lines: list[tuple]) -> tuple[Counter, Counter]:
        tri: Counter = Counter()
        start = self.ids["<s>"]
        for line in lines:
            u = v = start
            for w in map(self.ids.__getitem__, line):
                tri[(u, v, w)] += 1
                u, v = v, w
        return tri, Counter((v, w) for _, v, w in tri)

    def _fit(self, tri: Counter, bi: Counter, base: np.ndarray) -> dict:
        """Discounted shares of seen trigrams and bigrams, back-off weights of their histories, unigrams."""
        size, d = self.size, DISCOUNT
        uni, uni_types = np.zeros(size), 0
        for (_, w), _n in bi.items():
            uni[w] += 1
        total, uni_types = uni.sum(), (uni > 0).sum()
        uni = (np.maximum(uni - d, 0) + d * uni_types * base) / total if total else base
        bi_total, bi_types = np.zeros(size), np.zeros(size)
        for (v, _), n in bi.items():
            bi_total[v] += n
            bi_types[v] += 1
        keys = np.array(sorted(v * size + w for v, w in bi), dtype=np.int64)
        share = np.array([(bi[(int(k // size), int(k % size))] - d) / bi_total[k // size] for k in keys])
        back = np.where(bi_total > 0, d * bi_types / np.maximum(bi_total, 1), 1.0)
        h_total: Counter = Counter()
        h_types: Counter = Counter()
        for (u, v, _), n in tri.items():
            h_total[(u, v)] += n
            h_types[(u, v)] += 1
        history = np.array(sorted(u * size + v for u, v in h_total), dtype=np.int64)
        h_back = np.array([d * h_types[(int(k // size), int(k % size))] / h_total[(int(k // size), int(k % size))] for k in history])
        at = {int(k): i for i, k in enumerate(history)}
        pairs = sorted((at[u * size + v] * size + w, (n - d) / h_total[(u, v)]) for (u, v, w), n in tri.items())
        return {"uni": uni, "keys": keys, "share": share, "back": back, "history": history, "h_back": h_back, "tri": np.array([p[0] for p in pairs], dtype=np.int64), "t_share": np.array([p[1] for p in pairs])}

    @staticmethod
    def _look(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
        i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return i, keys[i] == wanted

    def _log_p(self, m: dict, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        i, hit = self._look(m["keys"], v * self.size + w)
        p = np.where(hit, m["share"][i], 0.0) + m["back"][v] * m["uni"][w]
        h, known = self._look(m["history"], u * self.size + v)
        j, seen = self._look(m["tri"], h * self.size + w)
        return np.log(np.where(known, np.where(seen, m["t_share"][j], 0.0) + m["h_back"][h] * p, p))

    def id_of(self, token: str) -> int:
        if (i := self.memo.get(token)) is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            i = self.memo[token] = self.ids.get(canonical(token), 0)
        return i

    def score_lines(self, lines: list[str]) -> np.ndarray:
        """The score of each folded line's worst passage; -inf for a line without words."""
        start, ids, begins = self.ids["<s>"], [], []
        known, memo = self.id_of, self.memo
        for line in lines:
            begins.append(len(ids))
            ids += [start, start]
            ids += [memo[t] if t in memo else known(t) for t in tokens_of(line)]
        begins.append(len(ids))
        a = np.array(ids, dtype=np.int64)
        if len(a) < 3:
            return np.full(len(lines), -np.inf)
        u, v, w = a[:-2], a[1:-1], a[2:]
        v_, u_ = np.where(v == 0, start, v), np.where((u == 0) | (v == 0), start, u)
        real = (w != 0) & (w != start)
        x = np.zeros(len(a))
        k = np.flatnonzero(real)
        x[k + 2] = self._log_p(self.parts[0], u_[k], v_[k], w[k]) - self._log_p(self.parts[1], u_[k], v_[k], w[k])
        total = np.concatenate(([0.0], np.cumsum(x)))
        b = np.array(begins)
        length = b[1:] - b[:-1] - 2
        which = np.repeat(np.arange(len(lines)), np.maximum(length, 0))
        end = np.arange(len(which)) - np.repeat(np.concatenate(([0], np.cumsum(np.maximum(length, 0))[:-1])), np.maximum(length, 0)) + b[which] + 3
        first = np.maximum(end - WINDOW, b[which] + 2)
        full = (end - first == WINDOW) | (length[which] < WINDOW) & (end == b[which + 1])
        out = np.full(len(lines), -np.inf)
        value = (total[end] - total[first]) / np.maximum(end - first, 3)
        np.maximum.at(out, which[full], value[full])
        return out

    def score(self, texts: list[str | None]) -> list[float | None]:
        """The score of each text; equal lines of the batch are scored once."""
        split = [[] if not t else lines_of(t) for t in texts]
        distinct = list(dict.fromkeys(line for lines in split for line in lines))
        values = dict(zip(distinct, self.score_lines([fold(line) for line in distinct]).tolist()))
        out = []
        for t, lines in zip(texts, split):
            best = max((values[line] for line in lines), default=-np.inf)
            out.append(None if not t or best == -np.inf else best)
        return out


def _words(line: str) -> list[str]:
    return [w for t in tokens_of(fold(line)) if (w := canonical(t))]


def train(bad: list[str], clean: list[str], rounds: int = ROUNDS) -> Models:
    """Models of the lines in documents of either label."""
    sets = lambda texts: [sorted({tuple(_words(line)) for line in lines_of(t)} - {()}) for t in texts]
    docs, ordinary = sets(bad), sets(clean)
    by_doc = lambda parts: Counter(w for d in parts for w in {w for line in d for w in line})
    in_bad, in_clean, times = by_doc(docs), by_doc(ordinary), len(docs) / max(1, len(ordinary))
    lean = {w: np.log((n + 2) / (in_clean[w] * times + 2)) for w, n in in_bad.items()}
    score = lambda line: sum(lean[w] for w in line) / max(4, len(line))
    clean_docs = Counter(line for d in ordinary for line in d)
    chosen = [[x for x in d[:1] if score(x) > FIRST] for d in (sorted(d, key=lambda x: (x in clean_docs, -score(x), x)) for d in docs)]
    kept = ordinary
    fit = lambda some, others: Models(sorted({line for d in some for line in d}), sorted({line for d in others for line in d} - {line for d in some for line in d}))
    for _ in range(rounds):
        picked: list[list[tuple]] = [[] for _ in docs]
        sure: list[list[tuple]] = [[] for _ in ordinary]
        for half in (0, 1):  # a document's lines are judged by a model of the other documents
            m = fit(chosen[half::2], kept[half::2])
            for out, source, keep in ((picked, docs, lambda line, x: x > PICK and clean_docs[line] < 2), (sure, ordinary, None)):
                part = range(1 - half, len(source), 2)
                x = m.score_lines([" ".join(line) for i in part for line in source[i]])
                at = 0
                for i in part:
                    out[i] = [line for line, v in zip(source[i], x[at : at + len(source[i])]) if (keep(line, v) if keep else clean_docs[line] > 1 or v <= PICK + 3)]
                    at += len(source[i])
        if not any(picked):
            break
        chosen, kept = picked, sure
    return fit(chosen, kept)


def threshold(bad: list[str], clean: list[str], halves: list | None = None) -> float:
    """The limit on documents that their model was not trained on: the middle of the widest gap between scores among the limits with (nearly) the fewest errors."""
    scores = []
    for half in (0, 1):
        of_bad, of_clean = halves[half] if halves else held_out(bad, clean, half)
        scores += [(s, True) for s in of_bad if s is not None] + [(s, False) for s in of_clean if s is not None]
    scores.sort()
    errors = [sum(not b for _, b in scores)]
    for _, b in scores:  # errors[i]: the i lowest scores are no cases
        errors.append(errors[-1] + (1 if b else -1))
    few = min(errors) + max(1, min(errors) // 50)
    gaps = [(scores[i][0] - scores[i - 1][0], (scores[i][0] + scores[i - 1][0]) / 2) for i in range(1, len(scores)) if errors[i] <= few]
    return max(gaps)[1] if gaps else 0.0


def held_out(bad: list[str], clean: list[str], half: int) -> tuple[list, list]:
    """The scores of one half of the documents by a model of the other."""
    m = train(bad[half::2], clean[half::2])
    return m.score(bad[1 - half :: 2]), m.score(clean[1 - half :: 2])


def fitted(spark, bad: list[str], clean: list[str]) -> tuple[Models, float]:
    """The models of all documents and the threshold, fitted by three tasks."""
    texts = spark.sparkContext.broadcast((bad, clean))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in b["id"].tolist():
                out = train(*texts.value) if k == 2 else held_out(*texts.value, k)
                yield pd.DataFrame({"id": [k], "fit": [pickle.dumps(out)]})

    got = {r["id"]: pickle.loads(r["fit"]) for r in spark.range(0, 3, 1, 3).mapInPandas(run, "id long, fit binary").collect()}
    texts.destroy()
    return got[2], threshold(bad, clean, [got[0], got[1]])


def labelled(docs: DataFrame, labels: DataFrame, most_bad: int = MOST_BAD, most_clean: int = MOST_CLEAN, most_letters: int = MOST_LETTERS) -> tuple[list[str], list[str]]:
    """Texts of the documents labelled bad and clean, within the documented bounds, in the order of their ids' hashes."""
    votes = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.sum(F.when(F.col("label").isin(*BAD), 1).otherwise(-1)).alias("_v")).withColumn("bad", F.col("_v") >= 0)
    order = F.xxhash64(F.col("doc_id"))
    chosen = votes.where("bad").orderBy(order, "doc_id").limit(most_bad).unionByName(votes.where("not bad").orderBy(order, "doc_id").limit(most_clean))
    rows = docs.select("doc_id", "text").where(F.length("text") <= most_letters).join(F.broadcast(chosen.select("doc_id", "bad")), "doc_id").collect()  # at most most_bad + most_clean
    rows.sort(key=lambda r: (hash(r["doc_id"]) * 2654435761 % 2**32, r["doc_id"], r["text"]))
    return [r["text"] for r in rows if r["bad"]], [r["text"] for r in rows if not r["bad"]]


def scored(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, source, score, flagged): flagged is false where the score is null."""
    ship(docs.sparkSession)
    bad, clean = labelled(docs, labels)
    usable = len(bad) >= 2 and len(clean) >= 2
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs.sparkSession, bad, clean) if usable else (None, 0.0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models, limit = shared.value
        for b in batches:
            s = models.score(b["text"].tolist()) if models else [None] * len(b)
            out = b[["doc_id", "source"]].copy()
            out["score"] = pd.Series(s, dtype="float64", index=b.index)
            out["flagged"] = (out["score"] > limit).fillna(False)
            yield out

    return docs.select("doc_id", "source", F.col(text).alias("text")).mapInPandas(run, "doc_id long, source string, score double, flagged boolean")


def rates(scores: DataFrame) -> DataFrame:
    """(source, n_docs, n_flagged, rate) of each source."""
    n = F.sum(F.col("flagged").cast("long"))
    return scores.groupBy("source").agg(F.count("*").alias("n_docs"), n.alias("n_flagged"), (n / F.count("*")).alias("rate"))
