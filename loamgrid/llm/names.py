"""Variant spellings of vendor names linked to one vendor each (problem 1).

A name is parsed into its core (the words that are its own), its kind (a person's given name or an organisation's
line of business) and nothing else: legal forms, titles, notes in brackets or behind a dash and account numbers fall
away, nicknames and abbreviations are written out. Two rows stand for the same vendor if their cores are variants of
one another and their kinds agree.

Cores are found by suffix blocking. Each distinct core is indexed under the suffix of MIN_SUFFIX letters of each of
its words. A suffix of up to COMMON cores is a block as it is. A commoner one is refined, not discarded: by the first
letters and, apart from that, by the last letters of the core's other words, so that a typing error in either place
leaves one block in common. A refined block of more than CROWDED cores is refined again by more letters; as it cannot
be larger than its suffix, only the suffixes beyond that size are counted again. A tax number, mail address or
telephone number makes a block of its own; one on more than SHARED rows is refined by the beginnings and suffixes of
the words. Such a contact may stand for many vendors: an acronym there that nothing else links goes to the family that
holds more than half of the distinct cores with its initials, and to none without one.

Inside a block, which is read in sorted order as a stream, a core is compared with the cores of every cluster that it
does not belong to yet, by the ratio of the longest common subsequence, and joins each cluster that holds one like it.
Cores must also agree word by word, at least roughly: New X, Old X and X stay apart unless they share a contact. Only distinct cores reach a block, so the copies of a hot name are gone before the shuffle. Links are
joined to families by label propagation over tables in the shared folder.

Within a family, kinds separate the vendors: rows of different given names or lines of business are different
vendors. A row without a kind, or with an initial only, goes to the vendor whose tax number, mail address or telephone
it shares, or to the family's only vendor.

Defined results: a missing vendorname links to nothing; a name without a core of its own (legal words only) is its
own core; equal names in equal rows link like others; nulls in other columns are no evidence; ties go to the kind that
comes first in order; an empty table gives an empty result. The pairs of one vendor grow with the square of its rows,
as the statement asks for each pair; `vendors` gives one row per record instead. Cores are told by 64-bit numbers: among
a billion cores, one pair of different cores is expected to share one with a chance of three in a hundred.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.functions.missing import is_missing
from loamgrid.llm.folding import fold
from loamgrid.operators.components import components
from loamgrid.session import broadcast_if_small, cut, drop_cut, ship

MIN_SUFFIX = 5
#: A suffix of more distinct cores is refined by the other words; a refined block of more is refined further.
COMMON, CROWDED = 24, 400
#: Letters at the begin and at the end of the other words, for each step of the refinement. More would leave an error in
#: a word of eight letters without a block in common; what is crowded even then is compared whole.
STEPS = ((2, 3), (4, 4))
#: A contact on more rows than this is shared by many vendors and must be refined by a suffix.
SHARED = 200
#: So many shared contacts or common suffixes are broadcast at most; more are joined by a shuffle.
MOST_HOT = 100_000
#: For cores without a contact in common: least ratio of two words that stand in one place, and of words that count as found.
WORD_ALIKE, WORD_FOUND = 0.5, 0.85
#: What a block stands for: parts of a name, or a contact.
NAME, CONTACT = 0, 1
#: A core of fewer letters is an acronym: it is a name only together with a contact.
SHORT = 5
#: Least ratio of the longest common subsequence for two cores, and for two cores that share a contact.
ALIKE, ALIKE_CONTACT = 0.82, 0.72

# Words of legal forms, and words that join the parts of a name.
LEGAL = frozenset("ltd limited llp lp co coy company corp corpn corporation inc incorporated pvt private plc gmbh sa ag nv bv llc prop proprietor sons sns son bros brothers and of the".split())
# Spellings of one sound, and the letter that stands for it.
SOUNDS = (("ph", "f"), ("ks", "x"), ("ck", "k"))
SOUND_LETTERS = str.maketrans("ywcqzj", "ivkksi")
# Titles before a name.
TITLES = frozenset("mr mrs ms miss dr prof sir messrs".split())
# Lines of business.
LINES = (
    "agencies", "apparel", "associates", "automotive", "builders", "castings", "cements", "ceramics", "chemicals", "construction", "consultants", "electricals", "electronics", "energy", "engineering", "enterprises", "exports",
    "foods", "foundry", "furniture", "garments", "hardware", "industries", "infrastructure", "instruments", "insurance", "logistics", "machinery", "manufacturing", "materials", "metals", "mills", "minerals", "motors", "packaging",
    "papers", "pharmaceuticals", "plastics", "polymers", "power", "printing", "products", "projects", "refineries", "rubber", "services", "shipping", "software", "solutions", "steels", "suppliers", "systems", "technologies", "textiles", "tools", "trading", "transport", "utilities",
)
# Given names and the short forms in use for them.
NICKNAMES = {
    "alexander": "alex sasha xander sandy lex", "andrew": "andy drew", "anthony": "tony", "benjamin": "ben benny", "catherine": "cathy kate", "charles": "charlie chuck", "christopher": "chris kit topher", "daniel": "dan danny",
    "david": "dave", "deborah": "deb debbie", "dominic": "dom nick dominick", "donald": "don", "dorothy": "dot dottie", "edward": "ed eddie ned ted", "eleanor": "ella nell nora", "elizabeth": "liz lizzie beth betty eliza elsie libby",
    "frances": "fran frankie", "francis": "frank", "frederick": "fred freddy freddie", "gabriella": "gabi gabby ella", "george": "geo", "gregory": "greg", "henrietta": "hettie etta hetty", "henry": "harry hank", "isabella": "bella izzy ella isa", "jacob": "jake",
    "james": "jim jimmy jamie", "jennifer": "jen jenny", "jessica": "jess jessie", "john": "jack johnny", "jonathan": "jon", "joseph": "joe joey", "josephine": "jo josie", "joshua": "josh", "katherine": "kate kathy kat katie kit kay",
    "kenneth": "ken kenny", "lawrence": "larry", "leonard": "leo len lenny", "margaret": "maggie meg peggy marge greta", "matthew": "matt", "michael": "mike mick mickey", "nathaniel": "nate nat nathan", "nicholas": "nick nicky",
    "oliver": "ollie noll", "patricia": "pat patty trish", "patrick": "pat paddy", "peter": "pete", "philip": "phil", "rebecca": "becky", "richard": "rick dick richie", "robert": "rob bob robbie bobby", "ronald": "ron",
    "samuel": "sam sammy", "stephen": "steve", "susannah": "sue susie susan", "susan": "sue susie", "theodore": "theo ted teddy", "thomas": "tom tommy", "timothy": "tim", "victoria": "vicky tori vic", "walter": "walt", "william": "bill will willy billy liam",
}
_FORMAL: dict[str, frozenset] = {}
for _name, _short in NICKNAMES.items():
    for _s in (_name, *_short.split()):
        _FORMAL[_s] = _FORMAL.get(_s, frozenset()) | {_name}
_LINE_FORMS = {f: x for x in LINES for f in (x, x + "s", x[:-1] if x[-1] == "s" else x, x[:-3] + "y" if x.endswith("ies") else x)}
_LINES_BY_START, _LINES_BY_END, _LINES_BY_LETTER, _NAMES_BY_START = defaultdict(list), defaultdict(list), defaultdict(list), defaultdict(list)
for _line in LINES:
    _LINES_BY_START[_line[:2]].append(_line)
    _LINES_BY_END[_line[-3:]].append(_line)
    _LINES_BY_LETTER[_line[0]].append(_line)
for _name in NICKNAMES:
    _NAMES_BY_START[_name[0]].append(_name)


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits; what both begin and end with belongs to it."""
    n = min(len(a), len(b))
    head = 0
    while head < n and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < n - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    same = head + tail
    if same == n:
        return same
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & where.get(ch, 0)
        s = (s + u | s - u) & full
    return same + len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths; 1 for equal strings."""
    return 1.0 if a == b else 2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0


@lru_cache(200_000)
def line_of(word: str) -> tuple[int, str]:
    """(strength, line of business): 3 for the word itself or its other number, 2 for a misspelling, 1 for an abbreviation, 0 for none."""
    if word in _LINE_FORMS:
        return 3, _LINE_FORMS[word]
    n = len(word)
    if n >= 6:
        best = _nearest(word, _LINES_BY_START.get(word[:2], ()), 0.84, 3)
        best = max(best, _nearest(word, _LINES_BY_END.get(word[-3:], ()), 0.84, 3))
        if best[1]:
            return 2, best[1]
    if 2 < n <= 7:
        fits = []
        for line in _LINES_BY_LETTER.get(word[0], ()):
            it = iter(line)
            if n < len(line) and all(ch in it for ch in word):
                vowels = sum(ch in "aeiou" for ch in word)
                if line.startswith(word) or line.startswith(word[:3]) and word[-1] in line[-3:] or not vowels:
                    fits.append((not line.startswith(word), len(line), line))
        if fits:
            return 1, min(fits)[2]
    return 0, ""


def _nearest(word: str, others, least: float, apart: int) -> tuple[float, str]:
    """(ratio, word) of the most similar of some words, at most `apart` letters longer or shorter; (0, '') below `least`."""
    n, best, letters = len(word), (0.0, ""), set(word)
    for x in others:
        m = len(x)
        if abs(m - n) <= apart and 2 * min(m, n, n - len(letters.difference(x))) >= least * (m + n) and (r := ratio(word, x)) >= least:
            best = max(best, (r, x))
    return best


@lru_cache(100_000)
def given_of(word: str) -> frozenset:
    """Formal given names that a word may stand for."""
    if word in _FORMAL:
        return _FORMAL[word]
    if len(word) >= 6 and (best := _nearest(word, _NAMES_BY_START.get(word[0], ()), 0.85, 2)[1]):
        return frozenset((best,))
    return frozenset()


_NOTE = re.compile(r"\[[^\]]*\]|\ba\s?/\s?c\b[\s#:]*\d*|\bacc?(?:ount)?t?\s*(?:no\.?)?\s*\d+|#\s*\d+|\((?!p\))[^)]*\)")
#: A note behind a dash: at most two words.
_BEHIND = re.compile(r"^(.*\w.*?)\s-\s+([^\W\d_]+(?:\s+[^\W\d_]+)?)\s*$")
_NOTED = re.compile(r"[\[/#(\-]|\bacc?(?:ount)?t?\b")
_WORDS = re.compile(r"[^\W_]+")
_DOTTED = re.compile(r"\b(?:[a-z]\.\s?){2,}(?:[a-z]\b\.?)?")


_TWICE = re.compile(r"(.)\1+")
_OWN, _LEGAL, _NONE = 0, 1, 2


def sound(word: str) -> str:
    """A word as it sounds: letters typed for each other become one, doubled letters single."""
    for a, b in SOUNDS:
        if a in word:
            word = word.replace(a, b)
    return _TWICE.sub(r"\1", word.translate(SOUND_LETTERS))


@lru_cache(200_000)
def _meant(word: str) -> tuple[int, int, str, str]:
    """What a word is (its own, of a legal form, or none: titles and numbers), its strength as a line of business, that line, and its sound."""
    if word in LEGAL:
        return _NONE if word in ("and", "of", "the") else _LEGAL, 0, "", word
    if word in TITLES or word.isdigit():
        return _NONE, 0, "", word
    return _OWN, *line_of(word), sound(word)


def parse(name: str) -> tuple[list[str], str]:
    """(core words as they sound in their order, kind). kind: `L:` and a line, `G:` and given names, `I:` and an initial, or nothing."""
    s = fold(name)
    if _NOTED.search(s):
        s = _NOTE.sub(" ", s).replace("m/s", " ").replace("(p)", " private ")
        if " - " in s and (m := _BEHIND.match(s)) and len(_WORDS.findall(m[1])) > 1 and all(_meant(x)[:2] == (_OWN, 0) for x in m[2].split()):
            s = m[1]
    if "." in s:
        s = _DOTTED.sub(lambda m: m[0].replace(".", "").replace(" ", "") + " ", s)
    raw = _WORDS.findall(s)
    w, core, legal, at, most = [], [], False, -1, 0
    for x in raw:
        what, strength, _, heard = meant = _meant(x)
        if what == _OWN:
            if strength > most or strength and strength == most and len(x) > len(w[at]):
                at, most, line = len(w), strength, meant[2]
            w.append(x)
            core.append(heard)
        elif what == _LEGAL:
            legal = True
    if not w:
        return [sound(x) for x in raw or [s.strip() or name]], ""
    kind = ""
    if len(w) > 1:
        if most:
            kind = "L:" + line
        elif not legal:
            at = next((i for i, x in enumerate(w) if given_of(x)), -1)
            if at >= 0:
                kind = "G:" + "|".join(sorted(given_of(w[at])))
            elif (at := next((i for i, x in enumerate(w) if len(x) == 1), -1)) >= 0:
                kind = "I:" + w[at]
            elif len(w) == 3:
                at, kind = 0, "G:" + w[0]
        if kind:
            del w[at], core[at]
    return [c for x, c in zip(w, core) if len(x) > 1] or core, kind


def _parsed(name: str) -> tuple[str, str]:
    core, kind = parse(name)
    return " ".join(core), kind


def _contacts(df: DataFrame) -> DataFrame:
    """Rows with a name, and the numbers of their tax number, mail address and telephone in one form; 0 where malformed.

    Plainly written values take a short way; only the others pay for general patterns.
    """
    number = lambda tag, c: F.coalesce(F.when(c != "", F.xxhash64(F.lit(tag), c)), F.lit(0).cast("long"))
    pan = F.upper(F.translate("pan_number", " -./", ""))
    pan = F.when(pan.rlike("^[A-Z]{5}[0-9]{4}[A-Z]$"), pan).when(pan.rlike("[^A-Z0-9]"), F.regexp_extract(F.regexp_replace(pan, "[^A-Z0-9]", ""), "^[A-Z]{5}[0-9]{4}[A-Z]$", 0))
    mail = F.replace(F.lower(F.trim("contact_email")), F.lit(" at "), F.lit("@"))
    plain = mail.rlike(r"^[a-z0-9._+-]++@[a-z0-9.-]+\.[a-z]++$")
    mail = F.when(plain, mail).when(F.contains(mail, F.lit("@")), F.regexp_extract(mail, r"([a-z0-9._+-]++@[a-z0-9.-]+\.[a-z]+)", 1))
    phone = F.translate("phone", " -()+./", "")
    digits = F.regexp_replace(F.regexp_replace(F.lower(F.col("phone")), r"ext\W*[0-9]+\s*$", ""), "[^0-9]", "")
    phone = F.when(phone.rlike("^[0-9]*$"), phone).otherwise(digits)
    return df.where(~is_missing(F.col("vendorname"))).select(
        "row_id", "vendorname", number("p", pan).alias("pan"), number("m", mail).alias("mail"),
        number("t", F.when(F.length(phone).between(8, 15), phone)).alias("phone"),
    )


def parsed(df: DataFrame) -> DataFrame:
    """(row_id, core, kind, pan, mail, phone, node): core words as they sound, joined by blanks; node is the core's number.

    The number of an acronym takes in the first contact or, without one, the row.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = [_parsed(n) for n in b.column("vendorname").to_pylist()]
            yield pa.record_batch([b.column("row_id"), pa.array([c for c, _ in p], pa.string()), pa.array([k for _, k in p], pa.string()), *(b.column(c) for c in ("pan", "mail", "phone"))], names=["row_id", "core", "kind", "pan", "mail", "phone"])

    rows = _contacts(df).mapInArrow(run, "row_id long, core string, kind string, pan long, mail long, phone long")
    whole = F.replace("core", F.lit(" "), F.lit(""))
    own = F.coalesce(*(F.nullif(F.col(c), F.lit(0)) for c in ("pan", "mail", "phone")), F.col("row_id"))
    return rows.withColumn("node", F.when(F.length(whole) < SHORT, F.xxhash64(whole, own)).otherwise(F.xxhash64(whole)))


def suffix_keys(core: str) -> list[tuple[str, str, str]]:
    """(suffix, other, text) for each word of a core: its suffix, the other words joined, and all words, this one last.

    A core of one word may be two written together, so what stands before its suffix is its other part; its first
    letter, and the letter before the suffix, make it meet other cores of one word.
    """
    w = core.split()
    n = sum(map(len, w))
    long = [i for i, x in enumerate(w) if len(x) >= MIN_SUFFIX]
    if len(w) == 1 or not long:
        one = "".join(w)
        end, front = one[-MIN_SUFFIX:], one[:-MIN_SUFFIX]
        return [(end, front, core), ("1" + end, front[:1], core), ("2" + end, front[-1:], core)] if n >= SHORT else []
    out = []
    for i in long:
        rest = w[:i] + w[i + 1 :]
        out.append((w[i][-MIN_SUFFIX:], "".join(rest), " ".join([*rest, w[i]])))
    return out


def initials(words: list[str]) -> list[str]:
    """The first letters of each two words of a core in order; of an acronym its first two letters, of one word its first."""
    whole = "".join(words)
    firsts = sorted(whole[:2] if len(whole) < SHORT else (x[0] for x in words if x))
    return [a + b for i, a in enumerate(firsts) for b in firsts[i + 1 :]] or firsts


def _emit(make):
    """A mapInArrow function: one row for each tuple that make(core) gives, with the core's node (and contact, if any)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [c for c in b.schema.names if c != "core"]
            at, out = [], []
            for i, core in enumerate(b.column("core").to_pylist()):
                for t in make(core):
                    at.append(i)
                    out.append(t)
            at = pa.array(at, pa.int64())
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.record_batch([*(b.column(c).take(at) for c in kept), *(pa.array(c, pa.string()) for c in columns)], names=[*kept, "suffix", "other", "text"])

    return run


def _contact_keys(core: str) -> list[tuple[str, str, str]]:
    """(key, other, text) for each word of a core within a shared contact: its beginning and its suffix, and the other words."""
    w = core.split()
    out = {}
    for i, x in enumerate(w):
        if len(x) >= MIN_SUFFIX:
            rest = "".join(w[:i] + w[i + 1 :])
            out |= {x[-MIN_SUFFIX:]: rest, x[:MIN_SUFFIX] + "-": rest}
    return [(k, rest, core) for k, rest in out.items()]


def _initial_keys(core: str) -> list[tuple[str, str, str]]:
    return [(k, "", "") for k in sorted(set(initials(core.split())))]


def _blocks_of(keys: DataFrame, common: int, contact: int) -> tuple[DataFrame, DataFrame]:
    """(block, text, contact, node) of keys (node, key, other, text), and the table of common keys.

    A key of up to `common` cores is a block. A commoner one is refined by the first and by the last letters of the
    other words; as a refined key is no commoner than the key, only those of more than CROWDED cores are counted again.
    """
    sizes = keys.groupBy("key").agg(F.count("*").alias("_n"))  # few keys, so counts combine before the shuffle
    many = cut(sizes.where(F.col("_n") > common))
    marked = keys.join(broadcast_if_small(many, MOST_HOT), "key", "left")
    parts = [marked.where("_n is null").select("node", "text", F.xxhash64("key").alias("block"))]
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("s"), o.alias("o")) for s, o in (("<", F.left("other", F.lit(STEPS[0][0]))), (">", F.right("other", F.lit(STEPS[0][1])))))))
    refined = lambda df: df.select("node", "text", "key", "other", sides.alias("_k")).select("node", "text", "key", "other", "_k.s", F.xxhash64("key", "_k.s", "_k.o").alias("block"))
    if common < CROWDED:
        parts.append(refined(marked.where(F.col("_n") <= CROWDED)).select("node", "text", "block"))
    if many.where(F.col("_n") > CROWDED).limit(1).count():
        rest = refined(marked.where(F.col("_n") > CROWDED))
        for a, b in STEPS[1:]:
            full = cut(rest.groupBy("block").agg(F.count("*").alias("_m")).where(F.col("_m") > CROWDED).select("block"))
            parts.append(rest.join(full, "block", "left_anti").select("node", "text", "block"))
            if not full.limit(1).count():
                rest = None
                break
            more = F.when(F.col("s") == "<", F.left("other", F.lit(a))).otherwise(F.right("other", F.lit(b)))
            rest = rest.join(full, "block", "left_semi").withColumn("block", F.xxhash64("key", "s", more, F.lit(a)))
        if rest is not None:
            parts.append(rest.select("node", "text", "block"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("contact", F.lit(contact)), many


def _shared(rows: DataFrame) -> tuple[DataFrame, DataFrame | None, list[DataFrame]]:
    """(node, block, core) of the contacts on up to SHARED rows, (node, contact, core) of the others if any, and tables to delete."""
    contact = F.explode(F.array("pan", "mail", "phone")).alias("block")
    given = rows.select("node", "core", contact).where("block <> 0")
    hot = cut(rows.select(contact).where("block <> 0").groupBy("block").agg(F.count("*").alias("_n")).where(F.col("_n") > SHARED).select("block"))
    if not hot.limit(1).count():
        return given, None, [hot]
    few = broadcast_if_small(hot, MOST_HOT)
    shared = cut(given.join(few, "block", "left_semi").groupBy("node", F.col("block").alias("contact")).agg(F.min("core").alias("core")))
    return given.join(few, "block", "left_anti"), shared, [hot, shared]


def blocks(rows: DataFrame, own: DataFrame, shared: DataFrame | None) -> tuple[DataFrame, list[DataFrame]]:
    """(block, text, contact, node): each core under its suffixes and contacts, and the tables to delete once read."""
    cores = rows.where(F.length(F.replace("core", F.lit(" "), F.lit(""))) >= SHORT).select("node", "core").groupBy("node").agg(F.min("core").alias("core"))
    keys = cut(cores.mapInArrow(_emit(suffix_keys), "node long, suffix string, other string, text string").withColumnRenamed("suffix", "key"))
    out, many = _blocks_of(keys, COMMON, NAME)
    done = [keys, many]
    out = out.unionByName(own.select("node", F.col("core").alias("text"), "block", F.lit(CONTACT).alias("contact")))
    if shared is not None:
        given = cut(shared.mapInArrow(_emit(_contact_keys), "node long, contact long, suffix string, other string, text string").select("node", F.xxhash64("contact", "suffix").alias("key"), "other", "text"))
        refined, many = _blocks_of(given, CROWDED, CONTACT)
        out, done = out.unionByName(refined), [*done, given, many]
    return out, done


def _clusters(members: list[tuple]) -> list[tuple[int, int]]:
    """Links of one block: each core with a core of every cluster it resembles. members: (text, contact, node)."""
    out: list[tuple[int, int]] = []
    clusters: list[list[tuple[str, str, str, int]]] = []  # of (words, letters, letters of the sorted words, node)
    seen = set()
    for words, contact, node in members:
        if node in seen:
            continue
        seen.add(node)
        letters = words.replace(" ", "")
        core = (words, letters, "".join(sorted(words.split())) if contact else letters)
        joined = None
        for k, c in enumerate(clusters):
            for *other, hit in c:
                if same(core, other, contact):
                    out.append((node, hit))
                    if joined is None:
                        joined = c
                    else:
                        joined += c
                        clusters[k] = []
                    break
        if joined is None:
            clusters.append([(*core, node)])
        else:
            joined.append((*core, node))
            clusters = [c for c in clusters if c]
    return out


def _near(a: str, b: str, least: float) -> bool:
    n, m = len(a), len(b)
    return a == b or 2 * min(n, m) >= least * (n + m) and 2 * lcs(a, b) >= least * (n + m)


def same(core: tuple, other: list, contact: int) -> bool:
    """Whether two cores (words, letters, letters of the sorted words) are variants: by their letters, without a contact in common also word by word."""
    (words_a, a, x), (words_b, b, y) = core, other
    if a == b:
        return True
    if contact:
        return _near(a, b, ALIKE_CONTACT) or (x, y) != (a, b) and _near(x, y, ALIKE_CONTACT) or _abbreviated(x, y)
    if not _near(a, b, ALIKE):
        return False
    v, w = sorted((words_a.split(), words_b.split()), key=len)
    if len(v) == len(w):
        return all(ratio(x, y) >= WORD_ALIKE for x, y in zip(v, w))
    # A word more is a part of a word split in two, unless each word of the shorter core stands in the longer one.
    found = [max(w, key=lambda y: ratio(x, y)) for x in v]
    return any(ratio(x, y) < WORD_FOUND for x, y in zip(v, found)) or all(len(y) < 3 for y in w if y not in found)


def _links_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within blocks, over rows sorted by block. Rows alone in their block are passed over unread."""
    block, members = None, []
    table = lambda out: pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["src", "dst"])
    for b in batches:
        k = b.column("block").to_numpy()
        if not len(k):
            continue
        near = np.zeros(len(k), dtype=bool)
        near[1:] = k[1:] == k[:-1]
        near[:-1] |= near[1:]
        near[0] = near[-1] = True  # their blocks may reach into the batches before and after
        b = b.filter(pa.array(near))
        out = []
        for k, *m in zip(*(b.column(c).to_pylist() for c in ("block", "text", "contact", "node"))):
            if k != block:
                if len(members) > 1:
                    out += _clusters(members)
                block, members = k, []
            members.append(m)
        yield table(out)
    if len(members) > 1:
        yield table(_clusters(members))


def _abbreviated(a: str, b: str) -> bool:
    """Whether one core is a word of the other, whose other word was left as an initial or left out, or its acronym. They share a contact."""
    a, b = sorted((a, b), key=len)
    if len(a) < SHORT:  # the words of b stand in the order of their letters
        first, *more = sorted(a[:2])
        return b[0] == first and all(x in b[1:] for x in more)
    return len(a) >= 6 and len(b) - len(a) >= 4 and (b.startswith(a) or b.endswith(a))


def links(rows: DataFrame, own: DataFrame, shared: DataFrame | None) -> tuple[DataFrame, list[DataFrame]]:
    """(src, dst): cores that are variants of one another, and the tables to delete once it is read."""
    b, done = blocks(rows, own, shared)
    return b.withColumn("size", -F.length("text")).repartition("block").sortWithinPartitions("block", "size", "node", "text").select("block", "text", "contact", "node").mapInArrow(_links_in, "src long, dst long").distinct(), done


def _acronyms(shared: DataFrame, fam: DataFrame) -> DataFrame:
    """(node, family): acronyms that no other evidence links, and the family that holds more than half of the cores with their initials in a shared contact."""
    keys = shared.join(fam, "node", "left").mapInArrow(_emit(_initial_keys), "node long, contact long, family long, suffix string, other string, text string")
    short = F.length(F.replace("core", F.lit(" "), F.lit(""))) < SHORT
    known = shared.where(~short).select("node", "contact").join(keys.select("node", "contact", F.coalesce("family", "node").alias("family"), "suffix"), ["node", "contact"])
    best = known.groupBy("contact", "suffix", "family").agg(F.count("*").alias("_n")).groupBy("contact", "suffix").agg(F.max(F.struct("_n", "family")).alias("_b"), F.sum("_n").alias("_all")).where("2 * _b._n > _all")
    odd = shared.where(short).select("node", "contact").join(keys.where("family is null").select("node", "contact", "suffix"), ["node", "contact"])
    return odd.join(best, ["contact", "suffix"]).groupBy("node").agg(F.min("_b.family").alias("family"))


def resolve(rows: list[tuple]) -> list[list[int]]:
    """Vendors of one family: lists of ids. rows: (id, kind, pan, mail, phone, n), n rows of the same evidence; 0 for a missing contact."""
    if len(rows) == 1:
        return [[rows[0][0]]]
    group = {k: k for k in {r[1] for r in rows} if k[:1] in ("L", "G") and "|" not in k}
    for k in sorted({r[1] for r in rows if "|" in r[1]}, key=lambda k: (k.count("|"), k)):  # short forms of several names
        fits = sorted({g for g in group.values() if set(g[2:].split("|")) & set(k[2:].split("|"))})
        if len(fits) < 2:
            group[k] = fits[0] if fits else k
    clear = sorted(set(group.values()))
    out: dict = defaultdict(list)
    vague = []
    proof: dict = defaultdict(Counter)
    for r in rows:
        if r[1] in group:
            g = group[r[1]]
            out[g].append(r[0])
            for c, weight in zip(r[2:5], (3, 2, 1)):
                if c:
                    proof[c][g] += weight * r[5]
        else:
            vague.append(r)
    rest: dict = defaultdict(list)
    for r in vague:
        fits = clear
        if r[1][:1] == "I":
            fits = [g for g in clear if g[0] == "G" and any(n.startswith(r[1][2:]) for n in g[2:].split("|"))]
        elif r[1]:
            fits = [g for g in clear if set(g[2:].split("|")) & set(r[1][2:].split("|"))]
        if len(clear) == 1 and fits:
            out[clear[0]].append(r[0])
            continue
        votes: Counter = Counter()
        for c in r[2:5]:
            if c and c in proof:
                for g, n in proof[c].items():
                    if g in fits:
                        votes[g] += n
        if votes:
            out[min(votes, key=lambda g: (-votes[g], g))].append(r[0])
        elif len(fits) == 1 and r[1][:1] == "I":
            out[fits[0]].append(r[0])
        else:
            rest[r[1] if clear else ""].append(r[0])
    return [*out.values(), *rest.values()]


def _families_in_order(batches: Iterator[pd.DataFrame]) -> Iterator[list[list[list[int]]]]:
    """For each batch, the vendors of each family that ended in it.

    Of a family, a worker holds each different evidence once, and eight bytes for each row.
    """
    family, held = None, {}

    def settled() -> list[list[int]]:
        ids = list(held.values())
        if len(ids) == 1 and len(ids[0]) == 1:
            return [ids[0].tolist()]
        vendors = resolve([(i, *evidence, len(ids[i])) for i, evidence in enumerate(held)])
        return [[r for i in v for r in ids[i]] for v in vendors]

    for b in batches:
        done = []
        for f, r, *evidence in zip(*(b[c].tolist() for c in ("family", "row_id", "kind", "pan", "mail", "phone"))):
            if f != family:
                if held:
                    done.append(settled())
                family, held = f, {}
            evidence = tuple(evidence)
            if evidence in held:
                held[evidence].append(r)
            else:
                held[evidence] = array("q", (r,))
        yield done
    if held:
        yield [settled()]


def _grouped(df: DataFrame) -> DataFrame:
    """Rows with their family, ready to be read family by family."""
    rows = cut(parsed(df))
    own, shared, kept = _shared(rows)
    edges, done = links(rows, own, shared)
    fam = components(edges).withColumnRenamed("component", "family")
    if shared is not None:
        fam = cut(fam.unionByName(_acronyms(shared, fam)))
    for t in done + kept:
        drop_cut(t)
    named = rows.select("row_id", "kind", "pan", "mail", "phone", "node").join(fam, "node", "left").withColumn("family", F.coalesce("family", "node"))
    return named.select("family", "row_id", "kind", "pan", "mail", "phone").repartition("family").sortWithinPartitions("family", "row_id")


def vendors(df: DataFrame) -> DataFrame:
    """(row_id, vendor_row_id, n_rows): each named row with the smallest row id of its vendor and the vendor's rows."""

    def run(batches):
        for done in _families_in_order(batches):
            out = [(r, min(v), len(v)) for family in done for v in family for r in v]
            yield pd.DataFrame(out, columns=["row_id", "vendor_row_id", "n_rows"])

    return _grouped(df).mapInPandas(run, "row_id long, vendor_row_id long, n_rows int")


def pairs(df: DataFrame) -> DataFrame:
    """(row_id_a, row_id_b): each pair of rows of one vendor, a < b."""

    def run(batches):
        for done in _families_in_order(batches):
            a, b = [], []
            for family in done:
                for v in family:
                    v.sort()
                    for i, x in enumerate(v):
                        a += [x] * (len(v) - i - 1)
                        b += v[i + 1 :]
                        if len(a) > 1_000_000:
                            yield pd.DataFrame({"row_id_a": a, "row_id_b": b}, dtype="int64")
                            a, b = [], []
            yield pd.DataFrame({"row_id_a": a, "row_id_b": b}, dtype="int64")

    return _grouped(df).mapInPandas(run, "row_id_a long, row_id_b long")
