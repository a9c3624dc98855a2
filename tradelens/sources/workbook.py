"""Financial workbooks (XLSX) as cells, and their report rows by DataFrame steps; archives are checked before anything is unpacked.

A workbook is bounded (25 MB, 100 MB unpacked), so one is unpacked whole in a task; many are in parallel.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import col, parse_sale_day
from ..shared import settle

# Limits of an archive, and the columns of a financial report with their headers.
MAX_BYTES, MAX_UNPACKED, MAX_ENTRIES = 25 * 1024 * 1024, 100 * 1024 * 1024, 500
HEADERS = {
    "sold_on": "Data da Venda", "order_reference": "Número E-commerce", "channel": "Canal de Venda", "status": "Status",
    "product_cost": "Custo Total dos Produtos", "product_sold": "Valor do produto vendido", "discount": "Desconto",
    "total_products": "Total prod. vendidos", "customer_shipping": "Valor Frete Pago pelo Cliente", "total_sale": "Total venda",
    "fees": "Comissão final", "tax": "Imposto Total", "net": "Valor Líquido", "margin": "Margem", "margin_rate": "% sobre Venda",
}
NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


class WorkbookError(ValueError):
    """The message starts with a code: INVALID_XLSX, FILE_TOO_LARGE, UNSAFE_ARCHIVE, MISSING_HEADERS, DUPLICATE_HEADERS, FORMULA_NOT_ALLOWED, EMPTY_REPORT."""


def open_archive(content: bytes) -> zipfile.ZipFile:
    if len(content) > MAX_BYTES:
        raise WorkbookError(f"FILE_TOO_LARGE: {len(content)} bytes")
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise WorkbookError("INVALID_XLSX: no archive") from e
    entries = archive.infolist()
    if not 0 < len(entries) <= MAX_ENTRIES or "xl/workbook.xml" not in archive.namelist():
        raise WorkbookError("INVALID_XLSX: entries")
    if any(e.flag_bits & 1 or e.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) for e in entries):
        raise WorkbookError("UNSAFE_ARCHIVE: encrypted or unknown compression")
    if sum(e.file_size for e in entries) > MAX_UNPACKED:
        raise WorkbookError("UNSAFE_ARCHIVE: too large when unpacked")
    return archive


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    body = archive.read(name)
    if b"<!DOCTYPE" in body or b"<!ENTITY" in body:
        raise WorkbookError("UNSAFE_ARCHIVE: entity declarations")
    return ElementTree.fromstring(body)


def _column(reference: str) -> int:
    n = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(letter) - 64
    return n


def _cells(archive: zipfile.ZipFile):
    """(sheet, row, column, text, kind, formula, from 1904) of all cells, sheet by sheet; ``kind`` is the cell's type, ``n`` for a number."""
    shared = []
    if "xl/sharedStrings.xml" in archive.namelist():
        shared = ["".join(t.text or "" for t in s.iterfind(".//m:t", NS)) for s in _xml(archive, "xl/sharedStrings.xml").iterfind("m:si", NS)]
    files = {r.get("Id"): r.get("Target").removeprefix("/xl/") for r in _xml(archive, "xl/_rels/workbook.xml.rels")}
    book = _xml(archive, "xl/workbook.xml")
    settings = book.find("m:workbookPr", NS)
    from_1904 = settings is not None and settings.get("date1904") in ("1", "true")
    for number, sheet in enumerate(book.iterfind("m:sheets/m:sheet", NS), 1):
        for row in _xml(archive, "xl/" + files[sheet.get(f"{{{NS['r']}}}id")]).iterfind("m:sheetData/m:row", NS):
            for c in row.iterfind("m:c", NS):
                value, kind = c.findtext("m:v", None, NS), c.get("t", "n")
                if kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iterfind(".//m:t", NS))
                elif kind == "s" and value is not None:
                    value = shared[int(value)]
                yield number, int(row.get("r")), _column(c.get("r")), value, kind, c.find("m:f", NS) is not None, from_1904


CELLS_DDL = "path string, sheet int, row_number long, column int, text string, kind string, formula boolean, from_1904 boolean"


def cells(files: DataFrame) -> DataFrame:
    """One row per cell; ``files`` has path and content, as ``binaryFile`` gives them. A broken file fails the job with its code.

    A file without a cell gives one row of nulls, so that it is not lost.
    """
    import pandas as pd

    def read(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                found = [(path, *x) for x in _cells(open_archive(content))] or [(path, None, None, None, None, None, None, None)]
                for at in range(0, len(found), 50_000):
                    yield pd.DataFrame(found[at : at + 50_000], columns=[x.split()[0] for x in CELLS_DDL.split(", ")]).astype({"sheet": "Int32", "row_number": "Int64", "column": "Int32", "formula": "boolean", "from_1904": "boolean"})

    return files.select("path", "content").mapInPandas(read, CELLS_DDL)


def serial_day(text, from_1904) -> Column:
    """The day of a serial number of days (its part of a day does not count). The 1900 system has a 29 February 1900, number 60, which is no day; null for it, for numbers below 1 there, and for other text."""
    whole = F.floor(col(text).try_cast("double")).try_cast("int")
    old = F.when(whole >= 61, F.date_add(F.lit("1899-12-30").cast("date"), whole)).when((whole >= 1) & (whole <= 59), F.date_add(F.lit("1899-12-31").cast("date"), whole))
    return F.when(col(from_1904), F.when(whole >= 0, F.date_add(F.lit("1904-01-01").cast("date"), whole))).otherwise(old)


def _stop(code: str, *parts: Column) -> Column:
    return F.raise_error(F.concat(F.lit(code), *parts))


def report_rows(found: DataFrame, headers: dict[str, str] = HEADERS, days: tuple[str, ...] = ("sold_on",)) -> DataFrame:
    """path, row_number, the text of each column, and ``<column>_day`` of ``days``, of the first sheet that has all headers in row 1.

    Blank rows are left out. A numeric cell of a day column is a serial number in the workbook's date
    system, text is dd/mm/yyyy. Two equal headers, a file without all of them (the fewest missing
    are named), a formula in a row's cells, and a file without rows are errors.
    """
    names = F.create_map(*(F.lit(x) for k, h in headers.items() for x in (h, k)))
    name = names[F.trim("text")]
    heads = found.where((F.col("row_number") == 1) & name.isNotNull()).select("path", "sheet", "column", name.alias("name"))
    sheets = heads.groupBy("path", "sheet").agg(F.collect_set("name").alias("names"), F.count("*").alias("n"))  # as many as there are headers
    lacking = F.transform(F.array_except(F.array(*map(F.lit, headers)), "names"), lambda k: F.create_map(*(F.lit(x) for kv in headers.items() for x in kv))[k])
    whole = F.when(F.size("lacking") == 0, F.col("sheet"))
    per_file = sheets.withColumn("lacking", lacking).groupBy("path").agg(
        F.min(whole).alias("chosen"), F.min_by("lacking", F.struct(F.size("lacking"), "sheet")).alias("lacking"), F.min(F.when(F.col("n") > F.size("names"), F.col("sheet"))).alias("twice"),
    )
    cut = ", "
    files = found.select("path").distinct().join(per_file, "path", "left")
    chosen = (
        F.when(F.col("twice") <= F.coalesce("chosen", "twice"), _stop("DUPLICATE_HEADERS: ", F.col("path")).cast("int"))
        .when(F.col("chosen").isNull(), _stop("MISSING_HEADERS: ", F.array_join(F.coalesce("lacking", F.array(*map(F.lit, headers.values()))), cut), F.lit(" in "), F.col("path")).cast("int"))
        .otherwise(F.col("chosen"))
    )
    files = files.select("path", chosen.alias("sheet"))
    columns = heads.join(files, ["path", "sheet"])
    body = found.where(F.col("row_number") > 1).join(columns, ["path", "sheet", "column"])
    day = F.when(F.col("kind") == "n", serial_day("text", "from_1904")).otherwise(parse_sale_day("text"))
    of = lambda k, value: F.max(F.when(F.col("name") == k, value))
    rows = body.groupBy("path", "row_number").agg(F.bool_or("formula").alias("formula"), *(of(k, F.col("text")).alias(k) for k in headers), *(of(k, day).alias(f"{k}_day") for k in days))
    filled = rows.where(F.col("formula") | (F.concat_ws("", *headers) != ""))
    out = files.join(filled, "path", "left")
    number = (
        F.when(F.col("row_number").isNull(), _stop("EMPTY_REPORT: ", F.col("path")).cast("long"))
        .when(F.col("formula"), _stop("FORMULA_NOT_ALLOWED: row ", F.col("row_number").cast("string"), F.lit(" of "), F.col("path")).cast("long"))
        .otherwise(F.col("row_number"))
    )
    return out.select("path", number.alias("row_number"), *headers, *(f"{k}_day" for k in days))


def build(rows: list[tuple], headers: dict[str, str] = HEADERS, from_1904: bool = False) -> bytes:
    """A workbook with one sheet of cells, text or number."""

    def cell(place: str, v) -> str:
        return f'<c r="{place}"><v>{v:g}</v></c>' if isinstance(v, (int, float)) else f'<c r="{place}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'

    line = lambda n, values: f'<row r="{n}">' + "".join(cell(f"{chr(65 + i)}{n}", v) for i, v in enumerate(values) if v is not None) + "</row>"
    body = "".join(line(n, values) for n, values in enumerate([tuple(headers.values()), *rows], 1))
    settings = '<workbookPr date1904="1"/>' if from_1904 else ""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{NS["m"]}" xmlns:r="{NS["r"]}">{settings}<sheets><sheet name="report" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{NS["m"]}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def read_workbooks(files: DataFrame, headers: dict[str, str] = HEADERS, days: tuple[str, ...] = ("sold_on",)) -> DataFrame:
    """The report rows of all files: the cells are unpacked once, what they mean is worked out in DataFrame steps."""
    return report_rows(settle(cells(files)), headers, days)


def write_workbooks(rows: DataFrame, path: str, order: str, headers: dict[str, str] = HEADERS, from_1904: str | None = None) -> DataFrame:
    """path and content of one workbook for each value of ``path``; the caller keeps a workbook within its limits.

    Text columns become text cells, others numbers. ``from_1904`` names a boolean column, equal in a
    workbook, for its date system. A column ``<name>_number`` is written for ``name`` where it is not null.
    """
    import pandas as pd

    numbers = [c for c in headers if f"{c}_number" in rows.columns]

    def write(one):
        one = one.sort_values(order).astype(object).where(lambda x: x.notna(), None)
        for c in numbers:
            one[c] = [t if n is None else float(n) for t, n in zip(one[c], one[f"{c}_number"])]
        old = bool(one[from_1904].iloc[0]) if from_1904 else False
        return pd.DataFrame({"path": [one[path].iloc[0]], "content": [build(list(one[list(headers)].itertuples(index=False, name=None)), headers, old)]})

    more = [*(f"{c}_number" for c in numbers), *([from_1904] if from_1904 else [])]
    return rows.select(path, order, *(F.col(c).cast("string").alias(c) for c in headers), *more).groupBy(path).applyInPandas(write, "path string, content binary")
