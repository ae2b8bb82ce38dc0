"""Readers of delimited files and workbooks, rulebooks, and writers of report tables."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: A workbook is read by the driver, as its format allows no split; larger ones must come as Parquet or CSV.
MOST_WORKBOOK_BYTES = 200_000_000


#: Delimited files as they are written: cells keep their blanks, quotes are doubled.
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _trimmed(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.strip() for c in df.columns))


def read_text(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Every cell as text; empty cells are empty text, never null. Column names are trimmed."""
    df = spark.read.csv(path, sep=sep, header=True, inferSchema=False, multiLine=True, quote='"', escape='"', emptyValue="")
    return _trimmed(df).na.fill("")


def read_typed(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return _trimmed(spark.read.csv(path, sep=sep, header=True, inferSchema=True, multiLine=True, quote='"', escape='"'))


def drop_empty(df: DataFrame) -> DataFrame:
    """Without rows that are null throughout, then without columns that are."""
    rows = df.dropna(how="all")
    if not df.columns:
        return rows
    counts = rows.agg(*(F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns))).first()
    return rows.select(*(F.col(f"`{c}`") for i, c in enumerate(df.columns) if counts[i]))


def read(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A dataset by the ending of its name: csv, tsv, json, parquet, xml (rows tagged `row`) or a workbook."""
    end = path.rsplit(".", 1)[-1].lower()
    if end in ("csv", "tsv"):
        return read_text(spark, path, "\t" if end == "tsv" else ",")
    if end in ("xlsx", "xlsm"):
        return read_workbook(spark, path, sheet)
    if end == "xml":
        return spark.read.option("rowTag", "row").format("xml").load(path)
    if end in ("json", "parquet"):
        return getattr(spark.read, end)(path)
    raise ValueError(f"unsupported format: {end}")


def _sheets(z: zipfile.ZipFile) -> dict[str, str]:
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    path = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
    return {s.get("name"): path(targets[s.get(_REL)]) for s in book.iter(f"{_NS}sheet")}


def sheet_names(data: bytes) -> list[str]:
    """Names of a workbook's sheets; none if it cannot be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return list(_sheets(z))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def workbook_rows(data: bytes, sheet: str | None = None) -> list[list[str]]:
    """All cells of one sheet as text."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        sheets = _sheets(z)
        texts = []
        if "xl/sharedStrings.xml" in z.namelist():
            texts = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        rows = []
        for row in ElementTree.fromstring(z.read(sheets[sheet or next(iter(sheets))])).iter(f"{_NS}row"):
            cells: list[str] = []
            for k, c in enumerate(row.iter(f"{_NS}c")):
                at = _column(c.get("r")) if c.get("r") else k
                cells += [""] * (at + 1 - len(cells))
                v = c.find(f"{_NS}v")
                if c.get("t") == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                elif v is not None and v.text is not None:
                    cells[at] = texts[int(v.text)] if c.get("t") == "s" else v.text
            rows.append(cells)
        return rows


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """One sheet, every cell as text, the first row as header."""
    row = spark.read.format("binaryFile").load(path).where(F.col("length") <= MOST_WORKBOOK_BYTES).select("content").first()
    if row is None:
        raise ValueError("the workbook is missing or too large; give it as Parquet or CSV")
    rows = workbook_rows(bytes(row["content"]), sheet)
    if not rows:
        return spark.createDataFrame([], StructType([]))
    width = max(map(len, rows))
    header = [h.strip() or f"column_{i + 1}" for i, h in enumerate(rows[0] + [""] * (width - len(rows[0])))]
    body = [tuple(r + [""] * (width - len(r))) for r in rows[1:]]
    return spark.createDataFrame(body, StructType([StructField(h, StringType()) for h in header]))


def read_workbook_typed(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """One sheet with inferred types: long, double, boolean or text for each column; empty cells are null."""
    df = read_workbook(spark, path, sheet)
    if not df.columns:
        return df
    cells = [F.nullif(F.col(f"`{c}`"), F.lit("")) for c in df.columns]
    tests = (("bigint", r"[+-]?[0-9]{1,18}"), ("double", r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"), ("boolean", r"(?i)true|false"))
    fits = df.agg(*(F.coalesce(F.bool_and(c.rlike(rf"\A(?:{p})\z")), F.lit(False)).alias(f"{t}{i}") for i, c in enumerate(cells) for t, p in tests)).first()
    kind = lambda i: next((t for t, _ in tests if fits[f"{t}{i}"]), "string")
    return df.select(*(c.cast(kind(i)).alias(n) for i, (c, n) in enumerate(zip(cells, df.columns))))


def preview(df: DataFrame, rows: int = 10) -> DataFrame:
    """The first rows of a table, for a look."""
    return df.limit(rows)


def summary(df: DataFrame) -> DataFrame:
    """(rows, columns) of a table."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns"))


def own_columns(df: DataFrame) -> DataFrame:
    """The table without the columns that operators added: those whose names begin with an underscore."""
    return df.select(*(F.col(f"`{c}`") for c in df.columns if not c.startswith("_")))


def golden_set(annotated: DataFrame) -> dict[str, DataFrame]:
    """The tables of a survivorship report. annotated has _golden."""
    grouped = annotated.where("_is_duplicate")
    return {"Duplicate Groups": grouped.orderBy("_dup_group_id", "_row_id"), "Golden Records": own_columns(annotated.where("_golden")), "Discarded Records": own_columns(annotated.where("not _golden"))}


def missing_set(exceptions: DataFrame, counts: DataFrame, fields: list[str]) -> dict[str, DataFrame]:
    """The exceptions of each field, and their summary."""
    return {**{f: exceptions.where(F.col("_missing_field") == f).drop("_missing_field") for f in fields}, "Summary": counts}


def bundle(files: dict[str, bytes]) -> bytes:
    """Small files as one compressed archive."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def safe_sheet_name(name: str, used: set[str]) -> str:
    """At most 31 letters without signs that workbooks forbid, made unique by a number."""
    base = re.sub(r"[\[\]:*?/\\]", "_", name)[:31] or "Sheet"
    out, n = base, 1
    while out in used:
        n += 1
        out = f"{base[: 31 - len(str(n)) - 1]}_{n}"
    used.add(out)
    return out


def workbook(tables: dict[str, tuple[list[str], list[tuple]]]) -> bytes:
    """Small report tables (columns, rows) as a workbook."""
    used: set[str] = set()
    names = [safe_sheet_name(n, used) for n in tables]
    cell = lambda v: f'<c t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v)))}</t></is></c>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        over = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{over}</Types>')
        z.writestr("_rels/.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_NS[1:-1]}" xmlns:r="{_REL[1:].split("}")[0]}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        for i, (columns, rows) in enumerate(tables.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{_NS[1:-1]}"><sheetData>' + "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [columns, *rows]) + "</sheetData></worksheet>")
    return out.getvalue()


def write_tables(tables: dict[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    """A set of report tables, each in its own folder, written by the executors."""
    used: set[str] = set()
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        path = f"{folder}/{safe_sheet_name(name, used).replace(' ', '_')}"
        writer.csv(path, **CSV) if kind == "csv" else writer.parquet(path)


def read_rulebook(df: DataFrame) -> DataFrame:
    """(column_name, rule, dimension, message, expression, severity) of a rulebook under either set of column names."""
    pick = lambda *names: F.coalesce(*(F.col(f"`{n}`") for n in names if n in df.columns), F.lit(None).cast("string"))
    return df.select(pick("column_name", "column").alias("column_name"), pick("rule", "rule_type").alias("rule"), pick("dimension", "rule_category").alias("dimension"), pick("message").alias("message"), pick("expression").alias("expression"), pick("severity").alias("severity"))
