"""Typed places mapped to a reference list (problem 3).

The list becomes a symmetric-delete dictionary: every entry, alternative name and code under all strings left by
deleting up to MAX_DELETES letters. A typed value meets all entries within that many Damerau-Levenshtein edits by
looking up its own deletions. Candidates are ranked by a weighted Damerau-Levenshtein distance (letters that sound
alike and swapped neighbours cost less), then by agreement of a city's country with the row's country, then by how
often the entry is written exactly in the table. The dictionary goes to all workers once; rows are mapped where they
lie, with no shuffle, and each worker remembers the values it has seen. A list of more than MOST_ENTRIES rows is read
in parts: the distinct typed values meet the dictionary of each part in turn, all parts' candidates of a value are
ranked together, and the answers are joined to the rows.

What a list calls a place is learnt from the list: leading words that several entries share (Saint, New) may be
abbreviated or moved to the end, and the words that alternative names add to an entry (Republic of) may be left out.

Defined results: a missing value gives no row; a value without an entry in reach gives ref_id 0; a value that names
two entries of equal rank goes to the more frequent, then to the smaller ref_id; null entries of the list are left
out; with an empty list every value is a miss. A value longer than every
entry by more than MAX_DELETES letters is a miss, as none can be within reach. What MAX_DELETES deletions on either side
do not bring together is not looked at, whatever the length of the words.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.functions.missing import BLANKS, is_missing, trimmed
from loamgrid.session import bounded_collect, broadcast_if_small, cut, ship

#: Entries of one dictionary; a longer list is read in parts.
MOST_ENTRIES = 20_000
#: Leading and form words that a list may have; they come to the driver.
MOST_WORDS = 100_000
MAX_DELETES = 3
#: Accepted cost for each letter of the entry.
REACH = 0.34
#: What a city outside the row's country costs besides its spelling.
OTHER_COUNTRY = 0.7
MEMO = 200_000
# Letters that are typed for each other because they sound alike.
ALIKE = {frozenset(p) for p in ("ck", "vw", "iy", "sz", "jy", "jg", "gk", "dt", "bp", "kq", "uw", "ae", "ei", "ou", "ao", "fv")}
# Spellings of one sound.
SOUNDS = (("ph", "f"), ("ks", "x"), ("ck", "k"), ("y", "i"), ("w", "v"), ("c", "k"), ("q", "k"), ("z", "s"))
# Words that typed addresses put behind a place.
TAILS = {"town", "city", "dist", "district", "hq", "east", "west", "north", "south", "area", "region", "province"}


def plain(s: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFKD", s).casefold() if not unicodedata.combining(ch))


def words(s: str) -> list[str]:
    """Words of a value; a hyphen or dot inside a word is dropped."""
    s = re.sub(r"(?<=\w)[-.'’](?=\w)", "", s)
    return re.findall(r"[^\W_]+", s)


def sound(s: str) -> str:
    for a, b in SOUNDS:
        s = s.replace(a, b)
    return s


def deletes(s: str, n: int) -> set[str]:
    """All strings left when up to n letters are taken out."""
    out = {s}
    for k in range(1, min(n, len(s) - 2) + 1):
        out.update(map("".join, combinations(s, len(s) - k)))
    return out


def distance(a: str, b: str, most: float) -> float:
    """Weighted Damerau-Levenshtein (optimal alignment); beyond `most` any larger number."""
    if a == b:
        return 0.0
    prev2, prev = None, [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [float(i)]
        for j, y in enumerate(b, 1):
            step = 0.0 if x == y else 0.45 if frozenset((x, y)) in ALIKE else 1.0
            best = min(prev[j] + (0.7 if i > 1 and a[i - 2] == x else 1.0), row[-1] + (0.7 if j > 1 and b[j - 2] == y else 1.0), prev[j - 1] + step)
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2] and x != y:
                best = min(best, prev2[j - 2] + 0.7)
            row.append(best)
        if min(row) > most + 1:
            return most + 1
        prev2, prev = prev, row
    return prev[-1]


def shortened(short: str, word: str) -> bool:
    """Whether `short` abbreviates `word`: same first letter, its letters in order, and no longer than four."""
    if not short or len(short) > 4 or len(short) >= len(word) or short[0] != word[0]:
        return False
    it = iter(word)
    return all(ch in it for ch in short)


def names_of(entry: tuple) -> list[str]:
    return [n for n in (entry[1], *(entry[4] or "").split(";")) if n and n.strip()]


def learnt(entries) -> Counter:
    """How many entries (ref_id, ref_value, ...) begin with a word (`h`), and how often an alternative name adds one (`f`)."""
    out: Counter = Counter()
    for e in entries:
        if not e[1] or not e[1].strip():
            continue
        first, *others = names_of(e)
        w = words(plain(first))
        if len(w) > 1:
            out["h", w[0]] += 1
        for alt in others:
            more = set(words(plain(alt)))
            if more & set(w):
                out.update(("f", x) for x in more - set(w))
    return out


def told(counts) -> tuple[set, set]:
    """Leading words of three entries and more, and words that two alternative names and more add."""
    return {w for (k, w), n in counts.items() if k == "h" and n >= 3}, {w for (k, w), n in counts.items() if k == "f" and n >= 2}


class Gazetteer:
    """The dictionary of one kind of place."""

    def __init__(self, entries: list[tuple], heads: set, forms: set):
        """entries: (ref_id, ref_value, place_code, country_ref_id, alt_names); heads and forms of the whole list."""
        self.country: dict = {}
        self.heads, self.forms = heads, forms
        named = [(e[0], names_of(e)) for e in entries if e[1] and e[1].strip()]
        self.codes: dict[str, set] = defaultdict(set)
        self.by_core: dict[str, set] = defaultdict(set)
        self.longest = 0
        for e in entries:
            if e[2]:
                self.codes["".join(words(plain(e[2])))].add(e[0])
            self.country[e[0]] = e[3]
        for ref, names in named:
            for name in names:
                head, core = self.split(words(plain(name)))
                if core:
                    self.by_core[core].add((ref, head))
                    self.longest = max(self.longest, len(core))
        self.index: dict[str, set] = defaultdict(set)
        for core in self.by_core:
            for form in {core, sound(core)}:
                for d in deletes(form, self.reach(core)):
                    self.index[d].add(core)
        self.heard = {core: sound(core) for core in self.by_core}
        self.memo: dict = {}
        self.starts: dict[str, set] = defaultdict(set)
        for core in self.by_core:
            for k in range(min(5, len(core) - 1), len(core)):
                self.starts[core[:k]].add(core)

    def reach(self, core: str) -> int:
        return min(MAX_DELETES, int(len(core) * REACH), max(0, (len(core) - 2) // 2))

    def split(self, w: list[str], dotted: frozenset = frozenset()) -> tuple[str, str]:
        """The leading word, written out, and the rest as one string, without form words."""
        if self.forms and len(w) > 1:
            kept = [x for x in w if x not in self.forms and not (len(x) > 1 and any(shortened(x, f) for f in self.forms))]
            w = kept or w
        head = ""
        if len(w) > 1 and self.heads:
            for at in (0, -1):
                x = w[at]
                full = x if x in self.heads else next((h for h in sorted(self.heads) if shortened(x, h)), "") if at == 0 or len(x) > 1 else ""
                if not full and len(x) > 2 and at == 0:
                    full = next((h for h in sorted(self.heads) if abs(len(h) - len(x)) < 2 and distance(x, h, 1.0) <= 1.0), "")
                if full:
                    head, w = full, (w[1:] if at == 0 else w[:-1])
                    break
        return head, "".join(w)

    def find(self, typed: str) -> list[tuple[float, int]]:
        """(cost, ref_id) of every entry in reach, cheapest first."""
        s = plain(typed)
        compact = "".join(words(s))
        if compact in self.codes and len(compact) <= 4:
            return sorted((0.0, r) for r in self.codes[compact])
        best: dict[int, float] = {}
        body = re.split(r"[,/(\[]|\s-\s", s)
        first = next((p for p in body if words(p)), "")
        w = [x for x in words(first)]
        while len(w) > 1 and (w[-1] in TAILS or w[-1].isdigit()):
            w.pop()
        if not w:
            return []
        cut_off = first.rstrip().endswith(".")
        forms = {self.split(w)}
        if len(w) > 1:
            forms.add(("", "".join(w)))
        for head, core in forms:
            for ref, cost in self.near(head, core, cut_off):
                best[ref] = min(best.get(ref, 99.0), cost)
        return sorted((c, r) for r, c in best.items())

    def near(self, head: str, core: str, cut_off: bool) -> list[tuple[int, float]]:
        """(ref_id, cost) of the entries in reach of a leading word and a core; remembered, as many typed forms share them."""
        key = (head, core, cut_off)
        if (hit := self.memo.get(key)) is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            hit = self.memo[key] = self._near(head, core, cut_off)
        return hit

    def _near(self, head: str, core: str, cut_off: bool) -> list[tuple[int, float]]:
        if len(core) > self.longest + MAX_DELETES:
            return []
        exact = [(ref, 0.0) for ref, h in self.by_core.get(core, ()) if h == head]
        if exact:
            return exact
        near = {core} if core in self.by_core else set()
        most_deletes = min(MAX_DELETES, max(0, (len(core) - 2) // 2))
        for form in {core, sound(core)}:
            for d in deletes(form, most_deletes):
                near.update(self.index.get(d, ()))
        near.update(self.starts.get(core, ()))
        best: dict[int, float] = {}
        heard = sound(core)
        for c in near:
            most = REACH * len(c) + 0.05
            cost = min(distance(core, c, most), distance(heard, self.heard[c], most) + 0.3)
            if len(core) >= 4 and c.startswith(core) and c != core:
                cost = min(cost, (0.1 if cut_off else 0.25) * (len(c) - len(core)) + 0.2)
            if cost > most:
                continue
            for ref, h in self.by_core[c]:
                total = cost + (0.0 if h == head else 1.3)
                best[ref] = min(best.get(ref, 99.0), total)
        return list(best.items())


def hint_of(typed: str) -> str:
    """What a typed city says of its country: the part behind its last comma, slash or bracket."""
    m = re.search(r"[,/(]\s*([^,/()]+)\)?\s*$", typed)
    return m[1].strip() if m else ""


def choice(candidates: list[tuple], country: int) -> int:
    """The best of candidates (cost, ref, country, frequency): a city outside a known country costs more; 0 without any."""
    cost = lambda x: x[0] + (OTHER_COUNTRY if country and x[2] != country else 0)
    return min(candidates, key=lambda x: (round(cost(x), 6), -x[3], x[1]))[1] if candidates else 0


class Mapper:
    """Maps (city, country) as typed to (city ref, country ref); 0 for a miss, None for a missing value."""

    def __init__(self, entries: list[tuple], frequency: dict[int, int], words_of: dict | None = None):
        self.frequency = frequency
        of = {k: [e[1:] for e in entries if e[0] == k] for k in ("city", "country")}
        told_of = words_of or {k: told(learnt(v)) for k, v in of.items()}
        self.lists = {k: Gazetteer(v, *told_of[k]) for k, v in of.items()}
        self.seen: dict = {}

    def _kept(self, key: tuple, make):
        if (hit := self.seen.get(key)) is None:
            if len(self.seen) >= MEMO:
                self.seen.clear()
            hit = self.seen[key] = make()
        return hit

    def candidates(self, kind: str, typed: str) -> list[tuple]:
        """(cost, ref, country, frequency) of each entry in reach."""
        g = self.lists[kind]
        return self._kept((kind, typed), lambda: [(c, r, g.country.get(r), self.frequency.get(r, 0)) for c, r in g.find(typed)])

    def country(self, typed: str) -> int:
        return choice(self.candidates("country", typed), 0)

    def city(self, typed: str, country: int) -> int:
        hint = lambda: country or (self.country(h) if (h := hint_of(typed)) else 0)
        return self._kept(("of", typed, country), lambda: choice(self.candidates("city", typed), hint()))


def mapped(df: DataFrame, places: DataFrame, row_id: str = "row_id", city: str = "city", country: str = "country", most_entries: int = MOST_ENTRIES) -> DataFrame:
    """(row_id, city, country, city_ref, country_ref): refs are null for missing values and 0 for misses."""
    spark = df.sparkSession
    ship(spark)
    listed = places.select("place_kind", "ref_id", "ref_value", "place_code", "country_ref_id", "alt_names").where("ref_id is not null and ref_value is not null")
    given = lambda c: F.when(~is_missing(F.col(c)), F.col(c))
    rows = df.select(F.col(row_id).alias("row_id"), given(city).alias("city"), given(country).alias("country"))
    n = listed.count()
    if n > most_entries:
        return _mapped_in_parts(rows, listed, -(-n // most_entries))
    counts = _frequencies(rows, listed).collect()  # at most one row per entry
    shared = spark.sparkContext.broadcast((_entries(listed, most_entries), {r["ref_id"]: r["n"] for r in counts}))

    @F.pandas_udf("struct<city_ref: long, country_ref: long>")
    def to_refs(c: pd.Series, k: pd.Series) -> pd.DataFrame:
        mapper = _mapper(shared)
        out_c, out_k = [], []
        for a, b in zip(c, k):
            kr = None if b is None else mapper.country(b.strip(BLANKS))
            out_k.append(kr)
            out_c.append(None if a is None else mapper.city(a.strip(BLANKS), kr or 0))
        return pd.DataFrame({"city_ref": pd.array(out_c, "Int64"), "country_ref": pd.array(out_k, "Int64")})

    return rows.withColumn("_r", to_refs("city", "country")).select("row_id", "city", "country", "_r.*")


def _entries(listed: DataFrame, most: int) -> list[tuple]:
    return [tuple(None if pd.isna(v) else v for v in r) for r in bounded_collect(listed, most, "the reference list")]


def _frequencies(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """(ref_id, n): how often each entry is written exactly."""
    names = listed.select(F.lower(F.trim("ref_value")).alias("_name"), "place_kind", "ref_id")
    typed = rows.select(F.explode(F.array(*(F.struct(F.lit(k).alias("place_kind"), F.lower(trimmed(F.col(k))).alias("_name")) for k in ("city", "country")))).alias("_v")).select("_v.*").where("_name is not null")
    return typed.join(broadcast_if_small(names, MOST_ENTRIES), ["place_kind", "_name"]).groupBy("ref_id").agg(F.count("*").alias("n"))


def _mapped_in_parts(rows: DataFrame, listed: DataFrame, parts: int) -> DataFrame:
    """mapped() for a long list: the candidates of the distinct values from every part, then the best for each row."""
    spark = rows.sparkSession
    listed = cut(listed.join(_frequencies(rows, listed), "ref_id", "left").select("place_kind", "ref_id", "ref_value", "place_code", "country_ref_id", "alt_names", F.coalesce("n", F.lit(0)).alias("n"), F.pmod(F.xxhash64("ref_id"), F.lit(2 * parts)).alias("_p")))

    def count(batches):
        for b in batches:
            got = {k: learnt(b[b["place_kind"] == k][["ref_id", "ref_value", "place_code", "country_ref_id", "alt_names"]].itertuples(index=False)) for k in ("city", "country")}
            yield pd.DataFrame([(k, what, w, c) for k, counts in got.items() for (what, w), c in counts.items()], columns=["k", "what", "w", "c"])

    told_words = listed.mapInPandas(count, "k string, what string, w string, c long").groupBy("k", "what", "w").agg(F.sum("c").alias("c")).where("c >= 2")
    counts: dict = {"city": Counter(), "country": Counter()}
    for r in bounded_collect(told_words, MOST_WORDS, "the list's leading and form words"):
        counts[r["k"]][r["what"], r["w"]] = r["c"]
    of = {k: told(c) for k, c in counts.items()}
    strip = lambda c: F.btrim(c, F.lit(BLANKS))

    @F.pandas_udf("string")
    def hint(typed: pd.Series) -> pd.Series:
        return typed.map(lambda v: hint_of(v) if v else None)

    pairs = cut(rows.groupBy(strip(F.col("city")).alias("city"), strip(F.col("country")).alias("country")).agg(F.count("*").alias("_n")).withColumn("hint", F.when(F.col("city").isNotNull(), F.nullif(hint("city"), F.lit("")))))
    kinds = (("city", "city"), ("country", "country"), ("country", "hint"))
    values = cut(pairs.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in kinds))).alias("_v")).select("_v.*").where("value is not null").distinct())
    met = None
    for p in range(2 * parts):
        part = _entries(listed.where(F.col("_p") == p).drop("_p"), MOST_ENTRIES)
        shared = spark.sparkContext.broadcast(([e[:-1] for e in part], {e[1]: e[-1] for e in part}, of))

        def find(batches, shared=shared):
            mapper = _mapper(shared)
            for b in batches:
                out = [(k, v, *c) for k, v in zip(b["kind"], b["value"]) for c in mapper.candidates(k, v)]
                yield pd.DataFrame(out, columns=["kind", "value", "cost", "ref", "country", "n"]).astype({"country": "Int64"})

        one = values.mapInPandas(find, "kind string, value string, cost double, ref long, country long, n long")
        met = one if met is None else met.unionByName(one)
    # A value's candidates are few: entries within reach. Only the best can win for a country, so a maximum decides.
    met = cut(met)
    best = lambda extra: F.min(F.struct(F.round(F.col("cost") + extra, 6).alias("c"), (-F.col("n")).alias("n"), F.col("ref").alias("ref"))).alias("_b")
    countries = cut(met.where("kind = 'country'").groupBy("value").agg(best(F.lit(0.0))).select("value", F.col("_b.ref").alias("_c")))
    known = pairs.join(countries.select(F.col("value").alias("country"), F.col("_c").alias("country_ref")), "country", "left").join(countries.select(F.col("value").alias("hint"), F.col("_c").alias("_hinted")), "hint", "left").withColumn("_of", F.coalesce("country_ref", "_hinted", F.lit(0)))
    cities = met.where("kind = 'city'").select(F.col("value").alias("city"), "cost", "ref", F.col("country").alias("_in"), "n")
    asked = known.select("city", "_of").where("city is not null").distinct().join(cities, "city")
    won = asked.groupBy("city", "_of").agg(best(F.when((F.col("_of") != 0) & ~F.col("_in").eqNullSafe(F.col("_of")), OTHER_COUNTRY).otherwise(0.0))).select("city", "_of", F.col("_b.ref").alias("city_ref"))
    final = known.join(won, ["city", "_of"], "left").select(F.col("city").alias("_ct"), F.col("country").alias("_cy"), "city_ref", "country_ref")
    joined = rows.join(final, F.col("_ct").eqNullSafe(strip(F.col("city"))) & F.col("_cy").eqNullSafe(strip(F.col("country"))), "left")
    return joined.select("row_id", "city", "country", *(F.when(F.col(c).isNotNull(), F.coalesce(f"{c}_ref", F.lit(0))).alias(f"{c}_ref") for c in ("city", "country")))


_READY: dict = {}


def _mapper(shared) -> Mapper:
    """One dictionary per worker process and broadcast."""
    if _READY.get("of") is not shared.value:
        _READY.update(of=shared.value, mapper=Mapper(*shared.value))
    return _READY["mapper"]


def found(refs: DataFrame) -> DataFrame:
    """(row_id, column_name, ref_id), one row for each value that is not missing."""
    one = lambda c: F.struct(F.lit(c).alias("column_name"), F.col(f"{c}_ref").alias("ref_id"))
    return refs.select("row_id", F.explode(F.array(one("city"), one("country"))).alias("_x")).select("row_id", "_x.*").where("ref_id is not null")


def misses(refs: DataFrame) -> DataFrame:
    """(column_name, value, n_rows): the values without an entry, with the rows that hold each."""
    one = lambda c: F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value"), F.col(f"{c}_ref").alias("ref_id"))
    return refs.select(F.explode(F.array(one("city"), one("country"))).alias("_x")).select("_x.*").where("ref_id = 0").groupBy("column_name", "value").agg(F.count("*").alias("n_rows"))
