"""Column-level quality profile of loads (problem 5).

Everything starts from one aggregate: the rows of each (load, column, value), counted with map-side combining, where
all spellings of a missing value are one value. Standard measures, rule violations and the induced expressions are
computed from these distinct values, each weighted by its rows, so no value is matched twice and a value that a third
of all rows share costs one row after the combine.

Expressions are induced by minimum description length. Each distinct value is turned into a sequence of runs of one
character class (upper, lower, digit, blank, or the sign itself); values of one sequence form a shape. The search starts
with an expression for each shape and joins two of like build, widening their classes and lengths, as long as the total
of model bits and value bits falls; a beginning that all values of an expression share is written out where that is
shorter. An expression that costs more than the general `.*` is dropped. Sequences of more than MOST_RUNS runs are merged
to groups of like words, and those of more than MOST_GROUPS groups to the set of their characters, so the shapes of a
column are bounded by the alphabet of classes and signs and not by the rows, and every value has a shape.

The values that do not conform to a rule are counted for each shape, so the shares of a load come from the rows that the
expressions cover, and the same table gives the change of each expression's coverage between loads.

Defined results: nulls and other missing values are counted, and take no part in any other measure but `mix`; a column
without values has null shares, and no finding but `missing` and `mix`; an empty table gives an empty result; repeated
rows count each time; loads are compared only with the load numbered one less, if that exists; a null load is left out.
"""

from __future__ import annotations

import os
import string
from collections import defaultdict
from dataclasses import dataclass, field, replace
from math import log2

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.functions.missing import is_missing
from loamgrid.session import bounded_collect, broadcast_if_small, cut, ship

#: Runs of a shape, and groups of words of a longer one (3 + 2 lengths each).
MOST_RUNS, MOST_GROUPS = 12, 4
#: Letters of a beginning that an expression may write out.
MOST_LITERAL = 24
#: Rules and profiled columns come to the driver; there are as many as a person wrote.
MOST_RULES = 10_000
#: Totals of loads and columns that are broadcast at most; more are joined by a shuffle.
MOST_TOTALS = 100_000
NUMBER = r"-?[0-9]+(\.[0-9]+)?"
SHARE = {"missing": 0.15, "distinct": 0.25, "pattern": 0.15, "range": 0.15, "mix": 0.25}
#: A change of the share of rows that one expression covers, beyond which it is a finding of its own.
COVERAGE = 0.15


@dataclass(frozen=True)
class Watch:
    """What is measured on a table's columns."""

    table: str
    columns: tuple[str, ...]
    patterns: dict = field(default_factory=dict)
    ranges: dict = field(default_factory=dict)
    mix: tuple[str, ...] = ()


def rules(rulebook: DataFrame) -> tuple[dict, dict]:
    """Format expressions and numeric ranges of the rulebook by column."""
    rows = bounded_collect(rulebook.select("column_name", "rule", "expression").where("column_name is not null and rule is not null and expression is not null"), MOST_RULES, "the rulebook")
    patterns = {r["column_name"]: r["expression"] for r in rows if r["rule"].strip().endswith("Format")}
    ranges = {r["column_name"]: tuple(map(float, r["expression"].split(".."))) for r in rows if r["rule"].strip() == "Numeric Range"}
    return patterns, ranges


def value_counts(df: DataFrame, watch: Watch, load: str = "load_id") -> DataFrame:
    """(table_name, load_id, column_name, value, n): rows of each value; null is any missing value."""
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("_k"), F.when(~is_missing(F.col(c)), F.col(c)).alias("value")) for i, c in enumerate(watch.columns))))
    counts = df.where(F.col(load).isNotNull()).select(F.col(load).alias("load_id"), cells.alias("_c")).select("load_id", "_c.*").groupBy("load_id", "_k", "value").agg(F.count("*").alias("n"))
    name = F.array(*map(F.lit, watch.columns))[F.col("_k")]
    return counts.select(F.lit(watch.table).alias("table_name"), "load_id", name.alias("column_name"), "value", "n")


def _by_column(options: dict, test) -> F.Column:
    """The test of the value's column, null for columns without one."""
    out = None
    for c, option in options.items():
        out = (F.when if out is None else out.when)(F.col("column_name") == c, test(option))
    return F.lit(None).cast("boolean") if out is None else out


def profile(counts: DataFrame, watch: Watch) -> DataFrame:
    """One row for each load and column: rows, missing and distinct values, ranges, lengths and violations."""
    v, n, has = F.col("value"), F.col("n"), F.col("value").isNotNull()
    bad_pattern = has & _by_column(watch.patterns, lambda p: ~v.rlike(rf"\A(?:{p})\z"))
    number = F.when(v.rlike(rf"\A{NUMBER}\z"), F.expr("try_cast(value as double)"))
    bad_range = has & _by_column(watch.ranges, lambda r: F.coalesce(~number.between(*r), F.lit(True)))
    summed = lambda c: F.sum(F.when(c, n).otherwise(0))
    rows = counts.groupBy("table_name", "load_id", "column_name").agg(
        F.sum("n").alias("n_rows"), summed(~has).alias("n_missing"), F.count("value").alias("n_distinct"),
        summed(bad_pattern).alias("n_bad_pattern"), summed(bad_range).alias("n_bad_range"),
        F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.min(number).alias("min_number"), F.max(number).alias("max_number"),
        F.min(F.length("value")).alias("min_length"), F.max(F.length("value")).alias("max_length"),
    )
    given = F.nullif(F.col("n_rows") - F.col("n_missing"), F.lit(0))
    only = lambda cols, c: F.when(F.col("column_name").isin(*cols), c) if cols else F.lit(None).cast("double")
    return rows.select(
        "*",
        (F.col("n_missing") / F.col("n_rows")).alias("missing"), (F.col("n_distinct") / given).alias("distinct"),
        only(watch.patterns, F.col("n_bad_pattern") / given).alias("pattern"), only(watch.ranges, F.col("n_bad_range") / given).alias("range"),
    )


def mix_changes(counts: DataFrame, watch: Watch) -> DataFrame:
    """(table_name, load_id, column_name, finding, change): half the summed difference of value shares against the load before.

    Each value's share is sent to its own load and, negated, to the next; both meet in one aggregation. A load without
    the one before has shares of one sign only, and is left out.
    """
    mixed = counts.where(F.col("column_name").isin(*watch.mix)) if watch.mix else counts.where("false")
    total = cut(mixed.groupBy("table_name", "load_id", "column_name").agg(F.sum("n").alias("_total")))  # loads x columns
    shares = mixed.join(broadcast_if_small(total, MOST_TOTALS), ["table_name", "load_id", "column_name"]).select("table_name", "column_name", "value", "load_id", (F.col("n") / F.col("_total")).alias("share"))
    side = lambda load, share, now: F.struct(load.alias("load_id"), share.alias("share"), F.lit(now).alias("now"))
    both = shares.select("table_name", "column_name", "value", F.explode(F.array(side(F.col("load_id"), F.col("share"), 1), side(F.col("load_id") + 1, -F.col("share"), 0))).alias("_s"))
    per_value = both.groupBy("table_name", "column_name", "value", "_s.load_id").agg(F.sum("_s.share").alias("d"), F.max("_s.now").alias("now"), F.min("_s.now").alias("was"))
    return per_value.groupBy("table_name", "load_id", "column_name").agg((F.sum(F.abs("d")) / 2).alias("change"), F.max("now").alias("now"), F.min("was").alias("was")).where("now = 1 and was = 0").select("table_name", "load_id", "column_name", F.lit("mix").alias("finding"), "change")


def conformity(covered: DataFrame) -> DataFrame:
    """(table_name, load_id, column_name, pattern): the share of rows that do not conform to the column's rule, over all expressions."""
    rows = covered.groupBy("table_name", "load_id", "column_name").agg(F.sum("n_rows").alias("_n"), F.sum("n_bad").alias("_b"))
    return rows.select("table_name", "load_id", "column_name", (F.col("_b") / F.col("_n")).alias("pattern"))


def changes(counts: DataFrame, watch: Watch, covered: DataFrame | None = None) -> DataFrame:
    """(table_name, load_id, column_name, finding, change) for every measure of each load that has a neighbour before it.

    Each load's measures are sent to its own number and to the next and meet there, so the profile is made once. The
    measure `pattern` comes from the expressions' coverage, if that is given.
    """
    measures = ("missing", "distinct", "pattern", "range")
    p = profile(counts, watch if covered is None else replace(watch, patterns={}))
    if covered is not None:
        p = p.drop("pattern").join(conformity(covered), ["table_name", "load_id", "column_name"], "left")  # both loads x columns
    p = p.select("table_name", "load_id", "column_name", F.struct(*(F.col(f"`{m}`").alias(m) for m in measures)).alias("_m"))
    null = F.lit(None).cast(p.schema["_m"].dataType)
    sides = F.explode(F.array(F.struct("load_id", F.col("_m").alias("now"), null.alias("was")), F.struct((F.col("load_id") + 1).alias("load_id"), null.alias("now"), F.col("_m").alias("was"))))
    met = p.select("table_name", "column_name", sides.alias("_s")).groupBy("table_name", "_s.load_id", "column_name").agg(F.max("_s.now").alias("now"), F.max("_s.was").alias("was")).where("now is not null and was is not null")
    pairs = met.select("table_name", "load_id", "column_name", F.explode(F.array(*(F.struct(F.lit(m).alias("finding"), F.abs(F.col(f"now.{m}") - F.col(f"was.{m}")).alias("change")) for m in measures))).alias("_m"))
    return pairs.select("table_name", "load_id", "column_name", "_m.*").where("change is not null").unionByName(mix_changes(counts, watch))


def findings(all_changes: DataFrame, limits: dict = SHARE) -> DataFrame:
    """The changes beyond their limit. Shares are quotients, so a difference equal to the limit up to rounding is no case."""
    over = F.lit(False)
    for m, limit in limits.items():
        over = over | ((F.col("finding") == m) & (F.col("change") > limit + 1e-9))
    return all_changes.where(over).select("table_name", "load_id", "column_name", "finding")


# Induced expressions


_ASCII = (string.digits + string.ascii_uppercase + string.ascii_lowercase + " \t\n\r\f\x0b", "\u0001" * 10 + "\u0002" * 26 + "\u0003" * 26 + "\u0004" * 6)


def _marked(c: F.Column) -> F.Column:
    """Digits, capitals, other letters and blanks as four signs. Plain texts take a short way."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), _marked_any(c)).otherwise(F.translate(c, *_ASCII))


def _marked_any(c: F.Column) -> F.Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[0-9]", "\u0001"), r"\p{Lu}", "\u0002"), r"\p{L}", "\u0003"), r"\s", "\u0004")


def shape(c: F.Column) -> F.Column:
    """A value's runs: U, L, D, S and signs, each with its length, such as `U5 D4 U1`; null beyond MOST_RUNS runs."""
    runs = F.regexp_extract_all(_marked(c), F.lit(r"(\u0001+|\u0002+|\u0003+|\u0004+|[^\u0001-\u0004])"), F.lit(1))
    kind = F.lit("DULS")
    text = F.transform(runs, lambda r: F.when(F.ascii(r) <= 4, F.concat(F.substring(kind, F.ascii(r), F.lit(1)), F.length(r).cast("string"))).otherwise(F.concat(F.lit("'"), r)))
    return F.when(F.size(runs) <= MOST_RUNS, F.array_join(text, "\u001f"))


def _signs(c: F.Column) -> F.Column:
    """The distinct characters of a marked string in order."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))), "")


def long_shape(c: F.Column) -> F.Column:
    """struct(kinds, lo, hi) of a value of many runs.

    Words of the same characters are one repeated group: `W` and the groups' characters, with the lengths of the blanks
    before, between and behind the words, and of each group the lengths and the number of its words. Values of more than
    MOST_GROUPS groups are `C` and their characters, with the length.
    """
    m = _marked(c)
    words = F.transform(F.regexp_extract_all(m, F.lit(r"([^\u0004]+)"), F.lit(1)), lambda w: F.struct(_signs(w).alias("k"), F.length(w).alias("lo"), F.length(w).alias("hi"), F.lit(1).alias("n")))
    join = lambda g, w: F.struct(w["k"].alias("k"), F.least(g["lo"], w["lo"]).alias("lo"), F.greatest(g["hi"], w["hi"]).alias("hi"), (g["n"] + 1).alias("n"))
    empty = F.array().cast("array<struct<k: string, lo: int, hi: int, n: int>>")
    groups = F.aggregate(
        words, empty, lambda acc, w: F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["k"] == w["k"]), F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(join(F.get(acc, F.size(acc) - 1), w)))).otherwise(F.concat(acc, F.array(w)))
    )
    blanks = F.transform(F.regexp_extract_all(F.regexp_replace(m, r"^\u0004+|\u0004+$", ""), F.lit(r"(\u0004+)"), F.lit(1)), F.length)
    edge = lambda at: F.length(F.regexp_extract(m, at, 1))
    ends = lambda between: [edge(r"^(\u0004+)"), F.coalesce(between, F.lit(1)), edge(r"(\u0004+)$")]
    of = lambda b, k: F.concat(F.array(*ends(b)), F.flatten(F.transform(groups, lambda g: F.array(g[k], g["n"]))))
    worded = F.struct(F.concat(F.lit("W\u001f"), F.array_join(F.transform(groups, lambda g: g["k"]), "\u001f")).alias("kinds"), of(F.array_min(blanks), "lo").alias("lo"), of(F.array_max(blanks), "hi").alias("hi"))
    whole = F.struct(F.concat(F.lit("C\u001f"), _signs(m)).alias("kinds"), F.array(F.length(m)).alias("lo"), F.array(F.length(m)).alias("hi"))
    return F.when((F.size(groups) <= MOST_GROUPS) & ~F.contains(c, F.lit("\u001f")), worded).otherwise(whole)


def shapes(counts: DataFrame, watch: Watch | None = None) -> DataFrame:
    """(table_name, column_name, load_id, kinds, lo, hi, n_values, n_rows, n_bad, ...): shapes with the lengths of their runs.

    With a watch, n_bad is the rows whose value does not match the whole expression of the column's rule.
    """
    bad = F.coalesce(_by_column(watch.patterns if watch else {}, lambda p: ~F.col("value").rlike(rf"\A(?:{p})\z")), F.lit(False))
    s = counts.where("value is not null").select("table_name", "column_name", "load_id", "n", "value", bad.alias("bad"), F.length("value").alias("len"), shape(F.col("value")).alias("s"))
    runs = F.split("s", "\u001f")
    kinds = F.array_join(F.transform(runs, lambda r: F.when(r.startswith("'"), r).otherwise(F.substring(r, 1, 1))), "\u001f")
    sizes = F.transform(runs, lambda r: F.coalesce(F.when(~r.startswith("'"), F.substring(r, 2, 10).try_cast("int")), F.lit(1)))
    form = F.when(F.col("s").isNull(), long_shape(F.col("value"))).otherwise(F.struct(kinds.alias("kinds"), sizes.alias("lo"), sizes.alias("hi")))
    sized = s.select("table_name", "column_name", "load_id", "n", "len", "bad", F.left("value", F.lit(MOST_LITERAL)).alias("begin"), form.alias("_f"))
    # The bounds of each run are plain min and max columns, so they combine map-side. Long shapes have at most as many.
    return sized.groupBy("table_name", "column_name", "load_id", F.col("_f.kinds").alias("kinds")).agg(
        *(F.min(F.get("_f.lo", F.lit(i))).alias(f"lo{i}") for i in range(MOST_RUNS)), *(F.max(F.get("_f.hi", F.lit(i))).alias(f"hi{i}") for i in range(MOST_RUNS)),
        F.count("*").alias("n_values"), F.sum("n").alias("n_rows"), F.sum("len").alias("len_sum"), F.min("len").alias("len_lo"), F.max("len").alias("len_hi"),
        F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("n_bad"), F.min("begin").alias("first"), F.max("begin").alias("last"),
    )


#: Bits of a character of each class, and the class as an expression. N: letters and digits.
_BITS = {"D": log2(10), "U": log2(26), "L": log2(52), "S": 1.0, "N": log2(62)}
_CLASS = {"D": "[0-9]", "U": r"\p{Lu}", "L": r"\p{L}", "S": r"\s", "N": r"[\p{L}0-9]"}
_ANY_BITS = log2(96)


def _wider(a: str, b: str) -> str | None:
    """The least class or sign that holds two, if there is one."""
    if a == b:
        return a
    return None if not {a, b} <= {"D", "U", "L", "N"} else "L" if {a, b} <= {"U", "L"} else "N"


@dataclass
class Expression:
    """A sequence of runs with their lengths, the values it stands for, and what all of them begin with."""

    kinds: tuple[str, ...]
    lo: tuple[int, ...]
    hi: tuple[int, ...]
    n: int
    begin: str
    of: tuple[str, ...]

    def joined(self, other: Expression) -> Expression | None:
        kinds = tuple(map(_wider, self.kinds, other.kinds))
        if None in kinds:
            return None
        return Expression(kinds, tuple(map(min, self.lo, other.lo)), tuple(map(max, self.hi, other.hi)), self.n + other.n, os.path.commonprefix([self.begin, other.begin]), self.of + other.of)

    def literal(self) -> tuple[str, list[tuple[str, int, int]]]:
        """The beginning that can be written out, and the runs behind it."""
        used, rest = 0, list(zip(self.kinds, self.lo, self.hi))
        while rest and used < len(self.begin):
            k, a, b = rest[0]
            take = min(a, len(self.begin) - used)
            used += take
            if take == a == b:
                rest.pop(0)
                continue
            rest[0] = (k, a - take, b - take)
            break
        return self.begin[:used], rest

    def text_and_bits(self) -> tuple[str, float, float]:
        """The expression, its own bits, and the bits by which one of its values is told from the others."""
        begin, rest = self.literal()
        plain = list(zip(self.kinds, self.lo, self.hi))
        options = [("", plain)] + ([(begin, rest)] if begin else [])
        made = [self._made(b, r) for b, r in options]
        return min(made, key=lambda m: (m[1] + self.n * m[2], m[0]))

    @staticmethod
    def _made(begin: str, runs: list[tuple[str, int, int]]) -> tuple[str, float, float]:
        out, model, value = "".join(map(_quoted, begin)), 4.0 + 8 * len(begin), 0.0
        for k, a, b in runs:
            if k[:1] == "'":
                out += _quoted(k[1:])
                model += 8
            else:
                out += _CLASS[k] + _times(a, b)
                model += 2 + 2 * log2(a + 1) + (0 if a == b else 2 * log2(b + 1))
                value += log2(b - a + 1) + _BITS[k] * (a + b) / 2
        return out, model, value

    def cost(self, total: int) -> float:
        _, model, value = self.text_and_bits()
        return model + self.n * (value - log2(self.n / total))


def _quoted(sign: str) -> str:
    return ("" if sign.isalnum() or sign.isspace() else "\\") + sign


def _searched(found: list[Expression], total: int) -> list[Expression]:
    """Joins expressions of one build, the commonest first, while the description gets shorter."""
    kept: list[tuple[float, Expression]] = []
    for e in sorted(found, key=lambda x: (-x.n, x.kinds)):
        own, best = e.cost(total), None
        for i, (cost, k) in enumerate(kept):
            both = k.joined(e)
            if both is not None and (gain := cost + own - (new := both.cost(total))) > 0 and (best is None or gain > best[0]):
                best = gain, i, (new, both)
        if best is None:
            kept.append((own, e))
        else:
            kept[best[1]] = best[2]
    return [k for _, k in kept]


def _bounds_of(kinds: str) -> int:
    """How many lengths a shape has."""
    parts = len(kinds.split("\u001f"))
    return {"W": 2 * parts + 1, "C": 1}.get(kinds[:1], parts)


def _times(a: int, b: int) -> str:
    return "" if a == b == 1 else f"{{{a}}}" if a == b else f"{{{a},{b}}}"


def _set(signs: str) -> tuple[str, int]:
    """A set of marked characters as an expression, and the number of characters it stands for."""
    own = "".join(x if x.isalnum() else "\\" + x for x in signs if x > "\u0004")
    named = [(r"0-9", 10), (r"\p{Lu}", 26), (r"\p{L}", 26), (r"\s", 2)]
    used = [named[ord(x) - 1] for x in signs if x <= "\u0004"]
    return "[" + "".join(t for t, _ in used) + own + "]", sum(n for _, n in used) + sum(x > "\u0004" for x in signs)


def _long_expressions(kinds: str, lo: list[int], hi: list[int], n: int, length: int, bounds: tuple[int, int]) -> list[tuple[str, float, float]]:
    """(expression, model bits, bits a value) of a long shape: its groups of words, and the set of its characters."""
    form, groups = kinds[0], kinds[2:].split("\u001f") if kinds[0] == "W" else [kinds[2:]]
    signs = "".join(sorted(set("".join(groups)) | ({"\u0004"} if form == "W" else set())))
    text, size = _set(signs)
    whole = lambda a, b: 8 * sum(x > "\u0004" for x in signs) + 6 + 2 * log2(a + 1) + 2 * log2(b + 1)
    out = [(text + _times(*bounds), whole(*bounds), log2(size) * length / n + log2(bounds[1] - bounds[0] + 1))]
    if form == "W":
        blank = r"\s" + _times(lo[1], hi[1])
        parts, model, chars, size, free = [], 4.0, 0.0, 1, 0.0
        for i, g in enumerate(groups):
            (a, m), (b, k) = lo[3 + 2 * i : 5 + 2 * i], hi[3 + 2 * i : 5 + 2 * i]
            text, size_of = _set(g)
            word = text + _times(a, b)
            parts.append(word + (f"(?:{blank}{word})" + _times(m - 1, k - 1) if k > 1 else ""))
            size = max(size, size_of)
            free += (m + k) / 2 * log2(b - a + 1) + log2(k - m + 1)
            model += 8 * sum(x > "\u0004" for x in g) + 6 + 2 * sum(log2(x + 1) for x in (a, b, m, k))
        edges = ["" if hi[i] == 0 else r"\s" + _times(lo[i], hi[i]) for i in (0, 2)]
        free += sum(log2(hi[i] - lo[i] + 1) for i in (0, 2))
        out.append((edges[0] + blank.join(parts) + edges[1], model, log2(size) * length / n + free))
    return out


def induce_column(pdf: pd.DataFrame) -> pd.DataFrame:
    """(kinds, expression) of one column's shapes over all loads, by minimum description length.

    The rows of pdf are the shapes of one column, whose number is bounded by MOST_RUNS and the classes.
    """
    merged: dict = defaultdict(lambda: [None, None, 0, 0, 2**31, 0, None])
    for r in pdf.itertuples(index=False):
        k = _bounds_of(r.kinds)
        lo, hi = [int(getattr(r, f"lo{i}")) for i in range(k)], [int(getattr(r, f"hi{i}")) for i in range(k)]
        m = merged[r.kinds]
        m[0] = lo if m[0] is None else [min(a, b) for a, b in zip(m[0], lo)]
        m[1] = hi if m[1] is None else [max(a, b) for a, b in zip(m[1], hi)]
        m[2] += int(r.n_values)
        m[3] += int(r.len_sum)
        m[4], m[5] = min(m[4], int(r.len_lo)), max(m[5], int(r.len_hi))
        begin = os.path.commonprefix([r.first, r.last])
        m[6] = begin if m[6] is None else os.path.commonprefix([m[6], begin])
    total = max(1, sum(m[2] for m in merged.values()))
    out, builds = [], defaultdict(list)
    for kinds, (lo, hi, n, length, *bounds, begin) in sorted(merged.items(), key=lambda x: (-x[1][2], x[0])):
        if kinds == "":
            continue
        if kinds[0] in "WC":
            cost, text = min((model + n * (bits - log2(n / total)), text) for text, model, bits in _long_expressions(kinds, lo, hi, n, length, tuple(bounds)))
            if cost < _ANY_BITS * length:
                out.append((kinds, text, n, cost))
            continue
        runs = tuple(kinds.split("\u001f"))
        builds[tuple(k if k[:1] == "'" or k == "S" else "" for k in runs)].append(Expression(runs, tuple(lo), tuple(hi), n, begin, (kinds,)))
    for found in builds.values():
        for e in _searched(found, total):
            cost = e.cost(total)
            if cost < sum(_ANY_BITS * merged[k][3] for k in e.of):
                out += [(k, e.text_and_bits()[0], merged[k][2], cost * merged[k][2] / e.n) for k in e.of]
    first = pdf.iloc[0]
    out.sort(key=lambda o: (-o[2], o[0]))
    return pd.DataFrame([(first.table_name, first.column_name, *o) for o in out], columns=["table_name", "column_name", "kinds", "expression", "n_values", "bits"])


def induce(all_shapes: DataFrame) -> DataFrame:
    """(table_name, column_name, kinds, expression, n_values, bits): the kept expression of each shape of a column, with the shape's values and bits."""
    ship(all_shapes.sparkSession)
    return all_shapes.groupBy("table_name", "column_name").applyInPandas(induce_column, "table_name string, column_name string, kinds string, expression string, n_values long, bits double")


def covered(all_shapes: DataFrame, expressions: DataFrame) -> DataFrame:
    """(table_name, column_name, load_id, expression, n_rows, n_bad): rows of each load that each kept expression covers.

    Rows that none covers stand under a null expression.
    """
    kept = expressions.select("table_name", "column_name", "kinds", "expression")
    return all_shapes.join(kept, ["table_name", "column_name", "kinds"], "left").groupBy("table_name", "column_name", "load_id", "expression").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_bad").alias("n_bad"))


def coverage(all_shapes: DataFrame, expressions: DataFrame) -> DataFrame:
    """(table_name, column_name, load_id, expression, n_rows, share, change): covered() with shares and their changes.

    change is the difference of the share against the load before, null for the first load; an expression that a load
    no longer uses has a row with share 0.
    """
    keys = ["table_name", "column_name", "load_id"]
    per = covered(all_shapes, expressions).drop("n_bad")
    total = per.groupBy(*keys).agg(F.sum("n_rows").alias("_t"))
    shares = per.join(total, keys).select(*keys, "expression", "n_rows", (F.col("n_rows") / F.col("_t")).alias("share"))
    sides = F.explode(F.array(F.struct("load_id", "n_rows", "share", F.lit(None).cast("double").alias("was")), F.struct((F.col("load_id") + 1).alias("load_id"), F.lit(0).cast("long").alias("n_rows"), F.lit(0.0).alias("share"), F.col("share").alias("was"))))
    met = shares.select("table_name", "column_name", "expression", sides.alias("_s")).groupBy("table_name", "column_name", "_s.load_id", "expression").agg(
        F.sum("_s.n_rows").alias("n_rows"), F.sum("_s.share").alias("share"), F.sum("_s.was").alias("was")
    )
    has_before = total.select("table_name", "column_name", (F.col("load_id") + 1).alias("load_id"), F.lit(1).alias("_b"))
    return met.join(total.drop("_t"), keys).join(has_before, keys, "left").select(
        *keys, "expression", "n_rows", "share", F.when(F.col("_b") == 1, F.col("share") - F.coalesce("was", F.lit(0.0))).alias("change")
    )


def coverage_findings(coverages: DataFrame, limit: float = COVERAGE) -> DataFrame:
    """(table_name, load_id, column_name, finding, expression, change): expressions whose share of rows changed beyond the limit."""
    return coverages.where(F.abs("change") > limit + 1e-9).select("table_name", "load_id", "column_name", F.lit("coverage").alias("finding"), "expression", "change")
