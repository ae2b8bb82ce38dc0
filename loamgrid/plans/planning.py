"""Driver-side planning: dataset kinds, suggested rules, rule entries to plans. No data is read."""

from __future__ import annotations

from loamgrid.functions.text import usable
from loamgrid.plans.rules import Rule

# Parts of column names that hint at a dataset's kind.
HINTS = {
    "Customer": ("email", "phone", "mobile", "age", "gender", "dob", "customer_id", "first_name", "last_name", "address", "zip", "postal"),
    "Vendor": ("vendor", "supplier", "gstin", "pan", "ifsc", "vendor_id", "vendor_name", "payment_terms"),
    "Product": ("sku", "product_id", "mrp", "price", "category", "brand", "uom", "unit_of_measure", "barcode"),
    "Finance": ("amount", "debit", "credit", "gl_code", "cost_center", "ledger", "account_no", "transaction", "voucher"),
}
# Rules suggested for column names, by kind.
SUGGESTED = {
    "Customer": {"email": ["Email Format"], "phone": ["Phone Format"], "mobile": ["Phone Format"], "dob": ["Date Format"], "date_of_birth": ["Date Format"], "birthdate": ["Date Format"], "age": ["Numeric Range"], "gender": ["Allowed Values"], "sex": ["Allowed Values"], "country": ["Allowed Values"], "status": ["Allowed Values"], "name": ["Minimum Length"], "first_name": ["Minimum Length"], "last_name": ["Minimum Length"], "customer_id": ["Not Null", "Not Empty"], "id": ["Not Null"]},
    "Vendor": {"vendor_email": ["Email Format"], "contact_email": ["Email Format"], "phone": ["Phone Format"], "pan": ["PAN Format"], "pan_number": ["PAN Format"], "gstin": ["Custom Regex"], "gst": ["Custom Regex"], "payment_terms": ["Allowed Values"], "status": ["Allowed Values"], "vendor_id": ["Not Null", "Not Empty"], "vendor_name": ["Minimum Length"], "credit_limit": ["Numeric Range"], "rating": ["Numeric Range"]},
    "Product": {"sku": ["Not Null", "Not Empty"], "product_id": ["Not Null"], "price": ["Numeric Range"], "cost": ["Numeric Range"], "mrp": ["Numeric Range"], "quantity": ["Numeric Range"], "stock": ["Numeric Range"], "category": ["Allowed Values"], "status": ["Allowed Values"], "launch_date": ["Date Format"], "expiry_date": ["Date Format"], "product_name": ["Minimum Length"], "description": ["Minimum Length"]},
    "Finance": {"amount": ["Numeric Range"], "debit": ["Numeric Range"], "credit": ["Numeric Range"], "transaction_date": ["Date Format"], "posting_date": ["Date Format"], "account_no": ["Custom Regex"], "ifsc": ["Custom Regex"], "currency": ["Allowed Values"], "transaction_type": ["Allowed Values"], "gl_code": ["Not Null", "Not Empty"], "cost_center": ["Not Null"]},
}
_COMPLETENESS = {"Not Null", "Not Empty", "Whitespace Only", "Minimum Length", "Mandatory Column"}
_TRANSFORMS = {"Trim Spaces", "Remove Extra Spaces", "Convert to Proper Case", "Convert to Lowercase", "Convert to Uppercase", "Remove Special Characters", "Normalize Date Format", "Replace Null with Default"}


def _name(column: str) -> str:
    return column.lower().replace(" ", "_").replace("-", "_")


def dataset_kind(columns: list[str]) -> str:
    """The kind whose hints occur most often in the column names; the first on ties, Other without any."""
    names = {_name(c) for c in columns}
    score = {kind: sum(h in c for c in names for h in hints) for kind, hints in HINTS.items()}
    best = max(score, key=lambda k: score[k])
    return best if score[best] else "Other"


def dimension_of(rule: str) -> str:
    return "Completeness" if rule in _COMPLETENESS else "Standardization" if rule in _TRANSFORMS else "Validity"


def suggest(columns: list[str], kind: str | None = None) -> list[Rule]:
    """Rules for columns whose name is a known one, or else contains or is part of one; each rule once."""
    known = SUGGESTED.get(kind or dataset_kind(columns), {})
    out: list[Rule] = []
    for c in columns:
        n = _name(c)
        key = n if n in known else next((k for k in known if k in n or n in k), None)
        for r in known.get(key, []):
            rule = Rule(c, dimension_of(r), r)
            if rule not in out:
                out.append(rule)
    return out


def apply_to(rule: str, columns: list[str], config: dict | None = None) -> list[Rule]:
    """One rule on many columns."""
    return [Rule(c, dimension_of(rule), rule, config or {}) for c in columns]


def from_entries(entries: list[dict], columns: list[str]) -> tuple[list[Rule], list[dict]]:
    """Rules of entries {column, dimension, rule, config}, and the entries on columns that do not exist.

    Entries of one column and rule are one rule; the settings of the later entry win where it has them.
    """
    made: dict[tuple, Rule] = {}
    for e in entries:
        if e.get("column") not in columns:
            continue
        dimension = e.get("dimension") or dimension_of(e["rule"])
        key = (e["column"], dimension, e["rule"])
        old = made[key].config if key in made else {}
        made[key] = Rule(e["column"], dimension, e["rule"], {**old, **(e.get("config") or {})})
    return list(made.values()), [e for e in entries if e.get("column") not in columns]


def selected(rules: list[Rule], dimension: str | None = None, column: str | None = None) -> list[Rule]:
    """The rules of a dimension, of a column, or of both."""
    return [r for r in rules if dimension in (None, r.dimension) and column in (None, r.column)]


def library(kind: str) -> dict[str, list[str]]:
    """The rules that a dataset kind's suggestions use, by dimension."""
    used = dict.fromkeys(r for rules in SUGGESTED.get(kind, {}).values() for r in rules)
    out: dict[str, list[str]] = {}
    for r in used:
        out.setdefault(dimension_of(r), []).append(r)
    return out


def _bound(value) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def problems(rule: Rule) -> list[str]:
    """What is wrong with a rule's settings, of whatever type these are."""
    c, out = rule.config, []
    words = lambda *keys: next((str(c[k]) for k in keys if c.get(k)), "")
    if rule.rule == "Numeric Range":
        lo, hi = _bound(c.get("range_min", 0)), _bound(c.get("range_max", 100))
        if lo is None or hi is None:
            out.append("bound is no number")
        elif lo > hi:
            out.append("minimum above maximum")
    if rule.rule == "Allowed Values" and not words("allowed_values_str", "allowed_values").strip(" ,"):
        out.append("no allowed values")
    if rule.rule in ("Custom Regex", "Format Check") and not usable(words("regex", "custom_regex", "format_pattern")):
        out.append("pattern does not compile")
    if rule.rule == "Replace Null with Default" and not str(c.get("null_default", "N/A")).strip():
        out.append("empty default")
    for key in ("min_length", "min_length_val", "max_length_val"):
        if key in c and (_bound(c[key]) is None or _bound(c[key]) < 0):
            out.append(f"{key} is no length")
    return out


def shown(rule: Rule) -> str:
    """A rule's settings as text."""
    return ", ".join(f"{k} = {v}" for k, v in sorted(rule.config.items())) or "no settings"
