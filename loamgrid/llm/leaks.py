"""Test material that leaked into documents (problem 7).

One Aho-Corasick automaton holds every run of GRAM normalised words of every test item, and scans each document's
normalised words once. Hits of one item that lie on one diagonal (same distance between the places in the document
and in the item, but for EDIT words) form a piece; single changed words inside a piece are bridged. An item leaked if
its pieces of at least PIECE words cover at least PASSAGE of its words. Every piece comes with its offsets in the
original text.

No run is left out for being frequent. Items of the same words are one text with several ids, and texts that share most
of their runs are one family. An instruction is told by its place: the words that an item begins or ends with are no
evidence as far as more than SHARED families begin or end with the same words. Any other run that more than SHARED
families hold is a stock phrase: it counts inside a piece, between runs of the item's own, if these make up half of it.

Normalised words are letters and digits in one case, with look-alike letters and hidden signs resolved; line layout,
quote and comment signs, mark-up entities and written escapes separate words. In scripts written without blanks each
letter is a word.

The automaton is bounded by MOST_LETTERS of test material and goes to every worker once; the documents are read in one
pass without a shuffle. More material is scanned in parts, one automaton after the other; items that begin alike stay
in one part, so that instructions are seen as such.

Defined results: a null or empty text, and an item of fewer than GRAM words, give no row; equal items all leak where
one does; a document that holds an item several times gives one row; an empty table on either side gives an empty
result.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.folding import HIDDEN, fold
from loamgrid.session import bounded_collect, ship

GRAM = 4
SHARED = 3
#: Share of common runs from which two texts are one family.
FAMILY = 0.8
# Odd multipliers that give as many orders of the runs' hashes.
_ODD = tuple(2 * k * k * 2654435761 + 1 for k in range(1, 9))
EDIT = 3
GAP = 14
PIECE = 7
PASSAGE = 17
#: Letters of test material that one automaton holds, and items that come to the driver at once.
MOST_LETTERS, MOST_ITEMS = 40_000_000, 1_000_000
#: Items that agree in so many letters at their begin are scanned in one part.
BEGIN = 20

_WORD = re.compile(r"\\[nrt]|&#?\w{1,8};|</?\w{1,10}\s?/?>|([^\W_]+)")
_HIDDEN = HIDDEN.pattern
_WORD_HIDDEN = re.compile(rf"\\[nrt]|&#?\w{{1,8}};|</?\w{{1,10}}\s?/?>|([^\W_](?:{_HIDDEN}*[^\W_])*)")


# Scripts written without blanks between words (Thai to Khmer, Kana, Han).
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_HAS_UNSPACED = re.compile(f"[{_UNSPACED}]")
_LETTER = re.compile(rf"\\[nrt]|&#?\w{{1,8}};|</?\w{{1,10}}\s?/?>|((?:(?![{_UNSPACED}])[^\W_])(?:{_HIDDEN}*(?![{_UNSPACED}])[^\W_])*|[{_UNSPACED}])")


def _pattern(text: str) -> re.Pattern:
    return _WORD if text.isascii() else _LETTER if _HAS_UNSPACED.search(text) else _WORD_HIDDEN if HIDDEN.search(text) else _WORD


def words(text: str) -> list[str]:
    """Normalised words of a text."""
    if text.isascii():
        return [w for w in _WORD.findall(text.lower()) if w]
    return [fold(m) for m in _pattern(text).findall(text) if m]


def spans(text: str) -> list[tuple[int, int]]:
    """Offsets of the words in the original text, in the order of words()."""
    return [m.span(1) for m in _pattern(text).finditer(text.lower() if text.isascii() else text) if m[1]]


def families(texts: list[tuple]) -> list[int]:
    """For each word list the first one that shares FAMILY of its runs, found by equal least hashes of the runs."""
    runs = [{hash(w[q : q + GRAM]) for q in range(len(w) - GRAM + 1)} for w in texts]
    first: dict[tuple, list] = {}
    out = list(range(len(texts)))
    for i, own in enumerate(runs):
        if not own:
            continue
        marks = [(k, min(h * m & 0xFFFFFFFFFFFF for h in own)) for k, m in enumerate(_ODD)]
        for other in {j for mark in marks for j in first.get(mark, ())}:
            if len(own & runs[other]) >= FAMILY * len(own | runs[other]):
                out[i] = min(out[i], out[other])
        if out[i] == i:
            for mark in marks:
                first.setdefault(mark, []).append(i)
    return out


def evidence(texts: list[tuple], family: list[int]) -> list[tuple[int, int]]:
    """(first, end) of each word list without the opening and the closing that more than SHARED families share."""
    begin: Counter = Counter(k for k, _ in {(key, f) for w, f in zip(texts, family) for key in _ends(w)})
    close: Counter = Counter(k for k, _ in {(key, f) for w, f in zip(texts, family) for key in _ends(w[::-1])})
    out = []
    for w in texts:
        first = max((n for n, key in enumerate(_ends(w), GRAM) if begin[key] > SHARED), default=0)
        last = max((n for n, key in enumerate(_ends(w[::-1]), GRAM) if close[key] > SHARED), default=0)
        out.append((first, len(w) - last))
    return out


def _ends(w: tuple) -> list[int]:
    """A running hash of each beginning of GRAM words and more."""
    out, h = [], hash(w[: GRAM - 1])
    for x in w[GRAM - 1 :]:
        h = hash((h, x))
        out.append(h)
    return out


class Index:
    """The automaton, and the places of each run of words."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        ids: dict[tuple, list] = defaultdict(list)
        for i, text in items:
            ids[tuple(words(text))].append(i)
        self.items = list(ids.values())
        texts = list(ids)
        family = families(texts)
        places: dict[str, list] = defaultdict(list)
        for k, (w, (first, end)) in enumerate(zip(texts, evidence(texts, family))):
            for q in range(first, end - GRAM + 1):
                places[" ".join(w[q : q + GRAM])].append((k, q))
        self.automaton = ahocorasick.Automaton()
        for run, at in places.items():
            own = len({family[k] for k, _ in at}) <= SHARED
            self.automaton.add_word(f" {run} ", [(k, q, own) for k, q in at])
        self.ready = len(self.automaton) > 0
        if self.ready:
            self.automaton.make_automaton()

    def hits(self, w: list[str]) -> dict[int, list[tuple[int, int, bool]]]:
        """For each item, (place in the document, place in the item, whether the run is its own) of each run they share."""
        text = f" {' '.join(w)} "
        found = list(self.automaton.iter(text)) if self.ready else []
        out: dict[int, list] = defaultdict(list)
        if found:
            blanks = list(accumulate((len(word) + 1 for word in w)))  # the blank behind each word
            for e, where in found:
                p = bisect.bisect_left(blanks, e) - GRAM + 1
                for k, q, own in where:
                    out[k].append((p, q, own))
        return out


def pieces(hits: list[tuple[int, int, bool]]) -> list[tuple[int, int, set]]:
    """(first word, last word, item words covered) of each piece, from its first to its last run of the item's own.

    The latest open piece of each diagonal is at hand.
    """
    chains: list[list] = []  # [last p, last q, covered, covered by own runs, first own p, last own p]
    latest: dict[int, list] = {}  # diagonal p - q -> piece
    for p, q, own in sorted(set(hits)):
        best, off = None, EDIT + 1
        for d in range(p - q - EDIT, p - q + EDIT + 1):
            if (c := latest.get(d)) is not None and 0 <= p - c[0] <= GAP and 0 < q - c[1] <= GAP and abs(p - q - d) < off:
                best, off = c, abs(p - q - d)
        if best is None:
            best = [p, q, set(), set(), p, -1]
            chains.append(best)
        else:
            if q - best[1] <= GRAM + EDIT:  # up to EDIT changed words lie between the runs
                best[2].update(range(best[1], q))
            if latest.get(best[0] - best[1]) is best:
                del latest[best[0] - best[1]]
            best[0], best[1] = p, q
        best[2].update(range(q, q + GRAM))
        if own:
            best[4] = best[4] if best[3] else p
            best[3].update(range(q, q + GRAM))
            best[5] = p
        latest[p - q] = best
    out = []
    for _, _, covered, own, first, last in chains:
        if own:
            kept = {x for x in covered if min(own) <= x <= max(own)}
            if len(kept) >= PIECE and 2 * len(own) >= len(kept):
                out.append((first, last + GRAM - 1, kept))
    return out


def leaks_of(index: Index, text: str) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(item id, words covered, word ranges) of each item that leaked into the text."""
    out = []
    for k, h in index.hits(words(text)).items():
        kept = pieces(h)
        covered = len(set().union(*(c for _, _, c in kept))) if kept else 0
        if covered >= PASSAGE:
            out += [(i, covered, [(a, b) for a, b, _ in kept]) for i in index.items[k]]
    return out


_READY: dict = {}


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", most_letters: int = MOST_LETTERS) -> DataFrame:
    """(doc_id, item_id, n_words, start, end): one row for each leaked piece; start and end are offsets in the original text."""
    given = items.select("item_id", "text").where("item_id is not null and text is not null")
    letters = given.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-letters // most_letters) or 1
    begin = F.left(F.lower(F.regexp_replace("text", r"[^\p{L}\p{N}]+", "")), F.lit(BEGIN))
    part = F.pmod(F.xxhash64(begin), F.lit(parts))
    ship(docs.sparkSession)
    out = None
    for n in range(parts):
        rows = bounded_collect(given.where(part == n) if parts > 1 else given, MOST_ITEMS, "a part of the test material")
        one = _scanned(docs, sorted((r["item_id"], r["text"]) for r in rows), text)
        out = one if out is None else out.unionByName(one)
    return out


def _scanned(docs: DataFrame, material: list[tuple[int, str]], text: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(material)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if _READY.get("of") is not shared.value:
            _READY.update(of=shared.value, index=Index(shared.value))
        index = _READY["index"]
        for b in batches:
            out = []
            for i, t in zip(b["doc_id"].tolist(), b["text"]):
                if t and (found := leaks_of(index, t)):
                    at = spans(t)
                    out += [(i, item, n, at[a][0], at[z][1]) for item, n, ranges in found for a, z in ranges]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "n_words", "start", "end"])

    return docs.where(F.col(text).isNotNull()).select("doc_id", F.col(text).alias("text")).mapInPandas(run, "doc_id long, item_id long, n_words int, start int, end int")


def found(all_leaks: DataFrame) -> DataFrame:
    """(doc_id, item_id), once for each document and item."""
    return all_leaks.select("doc_id", "item_id").distinct()


def report(all_leaks: DataFrame) -> DataFrame:
    """(item_id, n_docs, most_words): how far each item leaked."""
    return all_leaks.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("n_words").alias("most_words"))
