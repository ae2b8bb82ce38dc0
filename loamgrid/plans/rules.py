"""The rule registry: each rule becomes one pass expression with its label, issue and expected value."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamgrid.functions import text as T


@dataclass(frozen=True)
class Rule:
    """A rule on a column, as a user writes it."""

    column: str
    dimension: str
    rule: str
    config: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Check:
    """A planned rule."""

    column: str
    dimension: str
    label: str
    issue: str
    expected: Column
    passes: Column
    original: Column


# The patterns of the format rules.
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
PHONE = r"\+?[0-9][0-9\s\-()]{6,14}"
PAN = r"[A-Z]{5}[0-9]{4}[A-Z]"
TYPES = {"numeric": r"-?\d+(?:\.\d+)?", "integer": r"-?\d+", "float": r"-?\d+\.\d+"}
# The issue kinds.
MISSING, INVALID, NON_STANDARD = "Missing Values", "Invalid Format", "Non-Standard Values"


def _listed(config: dict) -> list[str]:
    return [v.strip() for v in (config.get("allowed_values_str") or config.get("allowed_values") or "").split(",") if v.strip()]


def _completeness(rule: str, c: Column, cfg: dict):
    t, n = T.strip(c), int(cfg.get("min_length", cfg.get("min_length_val", 3)))
    return {
        "Not Null": lambda: (rule, "Non-null value", ~T.nullish(c)),
        "Not Empty": lambda: (rule, "Non-empty value", F.length(t) > 0),
        "Whitespace Only": lambda: (rule, "Non-whitespace value", ~T.text(c).rlike(r"(?U)\A\s+\z")),
        "Minimum Length": lambda: (f"Minimum Length ({n})", f"Length ≥ {n}", ~T.nullish(c) & (F.length(t) >= n)),
        "Mandatory Column": lambda: (rule, "Required value", ~T.nullish(c)),
    }.get(rule)


def _validity(rule: str, c: Column, cfg: dict):
    t, raw = T.strip(c), T.text(c)
    or_missing = lambda ok: T.nullish(c) | F.coalesce(ok, F.lit(False))
    kind, fmt = cfg.get("data_type", "string"), cfg.get("date_fmt", "")
    lo, hi = float(cfg.get("range_min", 0)), float(cfg.get("range_max", 100))
    allowed, pattern = _listed(cfg), cfg.get("regex", cfg.get("custom_regex", ""))
    most, form = int(cfg.get("max_length_val", 255)), cfg.get("format_pattern", r"^[a-zA-Z0-9]+$")
    date = lambda: T.parse_date(t, (fmt,) if fmt else T.DAY_FIRST).isNotNull()
    typed = lambda: T.full(t, TYPES[kind]) if kind in TYPES else date() if kind == "date" else F.lit(True)
    found = {
        "Email Format": lambda: (rule, "Valid email (user@domain.tld)", or_missing(T.full(t, EMAIL))),
        "Phone Format": lambda: (rule, "Valid phone (7–15 digits)", or_missing(T.full(t, PHONE))),
        "PAN Format": lambda: (rule, "PAN: AAAAA9999A", or_missing(T.full(F.upper(t), PAN))),
        "Data Type Validation": lambda: (f"Data Type ({kind})", f"Expected type: {kind}", or_missing(typed())),
        "Date Format": lambda: (rule, "Valid date" + (f" ({fmt})" if fmt else " (any parseable)"), or_missing(date())),
        "Numeric Range": lambda: (f"Numeric Range [{lo}–{hi}]", f"Between {lo} and {hi}", or_missing(T.number(t).between(lo, hi))),
        "Allowed Values": lambda: allowed and (rule, "One of: " + ", ".join(allowed[:5]) + ("…" if len(allowed) > 5 else ""), or_missing(F.lower(t).isin(*{v.lower() for v in allowed}))),
        "Custom Regex": lambda: pattern and (f"Regex: {pattern[:30]}", f"Matches: {pattern[:50]}", or_missing(T.full(t, pattern)) if T.usable(pattern) else F.lit(True)),
        "Special Characters Not Allowed": lambda: (rule, "Alphanumeric + spaces only", F.coalesce(T.prefix(raw, cfg.get("allowed_chars_pattern", r"^[a-zA-Z0-9\s]+$")), F.lit(True))),
        "Length Check": lambda: (f"Length Check (max {most})", f"Length ≤ {most}", F.coalesce(F.length(raw) <= most, F.lit(True))),
        "Format Check": lambda: (f"Format Check ({form[:30]})", f"Expected format: {form[:50]}", F.coalesce(T.prefix(raw, form), F.lit(True))),
    }
    return found.get(rule)


def transform(rule: str, c: Column, cfg: dict) -> tuple[str, Column, Column | None] | None:
    """(label, new value, whether it changed) of a standardization rule; None for the last compares the values."""
    t, raw = T.strip(c), T.text(c)
    fmt, default = cfg.get("date_target_fmt", "%Y-%m-%d"), cfg.get("null_default", "N/A")
    empty = F.coalesce(F.lower(t).isin("", "nan", "none"), F.lit(True))
    date = lambda: F.coalesce(F.date_format(T.parse_date(t, T.DAY_FIRST), T.spark_format(fmt)), raw)
    found = {
        "Trim Spaces": lambda: (rule, t, None),
        "Remove Extra Spaces": lambda: (rule, F.regexp_replace(t, r"(?U)\s+", " "), None),
        "Convert to Proper Case": lambda: (rule, T.proper_case(t), None),
        "Convert to Lowercase": lambda: (rule, F.lower(t), None),
        "Convert to Uppercase": lambda: (rule, F.upper(t), None),
        "Remove Special Characters": lambda: (rule, T.strip(F.regexp_replace(raw, r"(?U)[^a-zA-Z0-9\s]", "")), None),
        "Normalize Date Format": lambda: (f"Normalize Date ({fmt})", date(), None),
        "Replace Null with Default": lambda: (f"Replace Null → {default}", F.when(empty, F.lit(default)).otherwise(t), empty),
    }
    return found[rule]() if rule in found else None


def plan(rules: list[Rule], columns: list[str]) -> list[Check]:
    """Row checks in the rules' order. Rules on columns that do not exist, and rules without their setting, are left out.

    Standardization rules that only flag (special characters, date format) are planned like their validity twins.
    """
    out = []
    for r in rules:
        if r.column not in columns:
            continue
        c = F.col(f"`{r.column}`")
        make = _completeness(r.rule, c, r.config) if r.dimension == "Completeness" else _validity(r.rule, c, r.config)
        made = make() if make else None
        if made:
            label, expected, passes = made
            issue = {"Completeness": MISSING, "Standardization": NON_STANDARD}.get(r.dimension, INVALID)
            raw = T.text(c)
            original = F.concat(F.lit("'"), F.replace(F.replace(raw, F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n")), F.lit("'")) if r.rule == "Whitespace Only" else raw
            out.append(Check(r.column, r.dimension, label, issue, F.lit(expected), passes, original))
    return out


def standardize(rules: list[Rule], columns: list[str]) -> tuple[list[Check], dict[str, Column]]:
    """Chained transforms: each reads what the one before left. Returns their checks and the final value of each column."""
    now: dict[str, Column] = {}
    out = []
    for r in rules:
        if r.column not in columns:
            continue
        c = now.get(r.column, F.col(f"`{r.column}`"))
        made = transform(r.rule, c, r.config)
        if made:
            label, new, changed = made
            changed = F.coalesce(new != T.text(c), new.isNotNull() != T.text(c).isNotNull()) if changed is None else changed
            out.append(Check(r.column, "Standardization", label, NON_STANDARD, new, ~changed, T.text(c)))
            now[r.column] = new
    return out, now
