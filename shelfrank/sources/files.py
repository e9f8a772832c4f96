"""Raw sales files: CSV (S1, S2, S3), Excel workbooks (S4), format dispatch.

All readers return the export's columns as strings; :func:`shelfrank.operators.clean.rename_raw`
maps them to ``store_id, product, value_raw, date_raw``.
"""

from __future__ import annotations

import io
import itertools
import posixpath
import re
import tempfile
import uuid
import zipfile
from datetime import date, timedelta
from decimal import Decimal
from functools import lru_cache
from xml.etree import ElementTree as ET
from xml.sax.saxutils import unescape

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfrank.session import qualified
from shelfrank.sources.csv_records import CORRUPT, MalformedFile, records

# The charsets that the exports come in, by their usual names.
_CHARSETS = {"utf8": "utf-8", "latin1": "iso-8859-1", "latin-1": "iso-8859-1", "iso8859-1": "iso-8859-1", "windows-1252": "cp1252"}


def read_csv(spark: SparkSession, path: str, sep: str = ";", encoding: str = "auto",
             strict: bool = False) -> DataFrame:
    """``;`` CSV with a header, every column a string.

    Quoted fields may hold separators, doubled quotes and line breaks; blank
    lines are skipped, an empty field is null. Bad lines (D8): a record with
    *more* fields than its file's header, empty ones included, or one whose quote
    is never closed, is dropped (S1) or fails the read (``strict=True``, S2); a
    short one is kept with nulls. Files of a folder are matched by column name; a
    file with other names fails the read. ``encoding='auto'`` decodes every value
    as UTF-8 when its bytes are valid UTF-8 and as ISO-8859-1 otherwise (D9:
    UTF-8 first), in the same scan. Files of any size are read in splits
    (:mod:`shelfrank.sources.csv_records`).
    """
    df = records(spark, path, sep, _CHARSETS.get(encoding.lower(), encoding.lower()))
    if strict and (bad := df.where(F.col(CORRUPT).isNotNull()).limit(1).collect()):
        raise MalformedFile(f"{path}: a line has more fields than the header or an open quote: {bad[0][CORRUPT][:200]}")
    return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


# ----------------------------------------------------------------------------- Excel

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


@lru_cache(1024)
def _col_index(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group(0):
        n = n * 26 + ord(ch) - 64
    return n - 1


# Number formats that show a date, by their built-in numbers (fixed values).
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _shows_date(code: str) -> bool:
    """Whether a custom number format shows a date: it has y, m, d, h or s
    outside quoted text, escapes, colours and conditions."""
    bare = re.sub(r'"[^"]*"|\\.|\[(?!h|m|s)[^\]]*\]|_.', "", code.lower())
    return bool(re.search(r"[ymdhs]", bare.split(";")[0])) and bare != "general"


def _date_styles(z: zipfile.ZipFile, names: set[str]) -> set[int]:
    """Cell styles whose number format shows a date."""
    if "xl/styles.xml" not in names:
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    custom = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in root.iterfind("m:numFmts/m:numFmt", _NS)}
    ids = [int(x.get("numFmtId") or 0) for x in root.iterfind("m:cellXfs/m:xf", _NS)]
    return {i for i, f in enumerate(ids) if (_shows_date(custom[f]) if f in custom else f in _DATE_FORMATS)}


#: Numbers that a float holds digit by digit (up to 15 characters of them).
_PLAIN_NUMBER = re.compile(r"(?:0|-?[1-9][0-9]*)(\.[0-9]+)?")


def _number_text(v: str, decimal: str) -> str:
    """A native number as text without exponent or grouping."""
    if len(v) <= 15 and (m := _PLAIN_NUMBER.fullmatch(v)):
        return v.rstrip("0").rstrip(".").replace(".", decimal) if m[1] else v
    return format(Decimal(repr(float(v))).normalize(), "f").replace(".", decimal)


@lru_cache(65_536)
def _serial_date(v: str, base_1904: bool) -> str:
    """A date serial as ``dd/MM/yyyy`` (the 1900 calendar counts a 29 February
    1900 that never was)."""
    days = int(float(v))
    if base_1904:
        first = date(1904, 1, 1)
    else:
        first = date(1899, 12, 30) if days > 59 else date(1899, 12, 31)
    return (first + timedelta(days)).strftime("%d/%m/%Y")


# The markup that most writers give a sheet: cells of one <v> or one <is><t>, in
# UTF-8 and the default namespace. All else matches as a character of its own.
_PLAIN_HEAD = re.compile(rb"""(?:\xEF\xBB\xBF)?(?:<\?xml version="1.0"(?: encoding="(?i:utf-8)")?(?: standalone="[a-z]+")? ?\?>)?\s*"""
                         rb"""<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"[^<>]*>(?:(?!<!|<sheetData)[\s\S])*<sheetData>""")
_TEXT = r"[^<&\x00-\x08\x0B-\x1F]*(?:&(?:lt|gt|amp|quot|apos);[^<&\x00-\x08\x0B-\x1F]*)*"
_ROW = r"""<row(?: (?!xmlns)[A-Za-z0-9:]+="[^"<>&]*")*"""
_PLAIN_CELL = re.compile(rf"""({_ROW}>)?<c(?: r="([A-Z]+)[0-9]+")?((?: [a-z]+="[^"<>&]*")*)"""
                         rf"""(?:/>|>(?:<v>({_TEXT})</v>|<is><t(?: xml:space="[a-z]+")?>({_TEXT})</t></is>)?</c>)(</row>)?"""
                         rf"""|({_ROW}(?:/>|></row>))|([\s\S])""")
_ATTRIBUTE = re.compile(r' ([a-z]+)="([^"]*)"')


@lru_cache(1024)
def _cell_type(attributes: str) -> tuple[str, int] | None:
    """Type and style of a cell; None if it has attributes that are not known."""
    found = _ATTRIBUTE.findall(attributes)
    of = dict(found)
    if len(of) < len(found) or not of.keys() <= {"s", "t", "cm", "vm", "ph"}:
        return None
    return of.get("t", "n"), int(of.get("s", 0))


def _first_sheet_rows(data: bytes, decimal: str = ","):
    """Cells of the first worksheet of an .xlsx as text, one list per row,
    streamed so that memory holds the shared strings and the rows of one piece of
    the sheet, not the sheet (stdlib only). A native number becomes a plain number with
    ``decimal`` as its mark, a native date ``dd/MM/yyyy``, an error null."""
    m = f"{{{_NS['m']}}}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            with z.open("xl/sharedStrings.xml") as f:
                for _, el in ET.iterparse(f):
                    if el.tag == f"{m}si":
                        shared.append("".join(t.text or "" for t in el.iter(f"{m}t")))
                        el.clear()
        wb = ET.fromstring(z.read("xl/workbook.xml"))
        props = wb.find("m:workbookPr", _NS)
        base_1904 = props is not None and props.get("date1904") in ("1", "true")
        dates = _date_styles(z, names)
        first = wb.find("m:sheets/m:sheet", _NS)
        target = "worksheets/sheet1.xml"
        if first is not None and "xl/_rels/workbook.xml.rels" in names:
            rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
            for r in rels:
                if r.get("Id") == first.get(_REL):
                    target = r.get("Target")
        path = posixpath.normpath(posixpath.join("xl", target.lstrip("/").removeprefix("xl/")))

        row_tag, cell_tag, v_tag, t_tag = (m + x for x in ("row", "c", "v", "t"))

        def value(kind: str, style: int, v: str | None) -> str | None:
            if not v or kind == "e":
                return None
            if kind == "s":
                return shared[int(v)]
            if kind == "d":
                return date.fromisoformat(v[:10]).strftime("%d/%m/%Y")
            if kind == "n":
                return _serial_date(v, base_1904) if style in dates else _number_text(v, decimal)
            return v

        def cell(c) -> str | None:
            kind = c.get("t", "n")
            if kind == "inlineStr":
                return "".join(x.text or "" for x in c.iter(t_tag))
            return value(kind, int(c.get("s", 0)), c.findtext(v_tag))

        def plain(text: str) -> list[list[str | None]] | None:
            """The rows of a piece in the plain form; None if any of it has another."""
            out: list[list[str | None]] = []
            row = None
            for opened, ref, attributes, v, t, closed, empty, other in _PLAIN_CELL.findall(text):
                kept = _cell_type(attributes)
                if other or kept is None or bool(opened or empty) == (row is not None):
                    return None
                if empty:
                    out.append([])
                    continue
                if opened:
                    row, i = [], 0
                kind, style = kept
                got = t if kind == "inlineStr" else value(kind, style, v)
                if got and "&" in got and kind != "s":
                    got = unescape(got, {"&quot;": '"', "&apos;": "'"})
                at = _col_index(ref) if ref else i
                i += 1
                if at != len(row):
                    row.extend([None] * (at + 1 - len(row)))
                    row[at] = got
                else:
                    row.append(got)
                if closed:
                    out.append(row)
                    row = None
            return out if row is None else None

        def values(row) -> list[str | None]:
            vals: list[str | None] = []
            for i, c in enumerate(row.findall(cell_tag)):
                ref = c.get("r")
                at = _col_index(ref.rstrip("0123456789")) if ref else i
                vals.extend([None] * (at + 1 - len(vals)))
                vals[at] = cell(c)
            return vals

        def parsed():
            # the tree grows as the sheet is fed; rows that are whole leave it
            tree = ET.TreeBuilder()
            parser = ET.XMLParser(target=tree)
            with z.open(path) as f:
                while piece := f.read(1 << 18):
                    parser.feed(piece)
                    root = tree.close()
                    rows = None if root is None else root.find(f"{m}sheetData")
                    if rows is not None and len(rows) > 1:
                        yield from [values(row) for row in rows[:-1] if row.tag == row_tag]
                        del rows[:-1]
                parser.close()
                rows = tree.close().find(f"{m}sheetData")
                yield from [] if rows is None else [values(row) for row in rows if row.tag == row_tag]

        # rows are read by pattern as long as their markup is plain; from the first
        # piece of another form on, an XML parser reads the sheet
        n = 0
        with z.open(path) as f:
            head = f.read(1 << 18)
            start = _PLAIN_HEAD.match(head)
            rest = head[start.end():] if start else None
            while rest is not None:
                end = rest.rfind(b"</row>") + 6
                if (stop := rest.find(b"</sheetData>")) >= 0:
                    end = stop
                elif end < 6:
                    end = 0
                try:
                    rows = plain(rest[:end].decode())
                except UnicodeDecodeError:
                    rows = None
                if rows is None:
                    break
                yield from rows
                n += len(rows)
                if stop >= 0:
                    while f.read(1 << 18):  # to the end, where the checksum is held against it
                        pass
                    return
                more = f.read(1 << 18)
                rest = rest[end:] + more if more else None
        yield from itertools.islice(parsed(), n, None)


def read_xlsx(spark: SparkSession, path: str, columns: list[str], batch_rows: int = 10_000,
              decimal: str = ",") -> DataFrame:
    """First sheet of every workbook under ``path`` (one task per file,
    as the zip container forces), header row matched by name to ``columns``;
    all values as text. Rows leave the task in batches of ``batch_rows``.

    Native cells come as the text that the export would have: numbers with
    ``decimal`` as their mark (the comma for money mode ``br``, the dot for
    ``plain``), dates as ``dd/MM/yyyy``. A workbook without one of the columns
    (P1) and an old ``.xls`` file fail the read.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns]
                          + [T.StructField("source_file", T.StringType())])

    def parse(batches):
        def out(p, rows):
            arrays = [pa.array(c, pa.string()) for c in zip(*rows)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([p] * len(rows), pa.string())], names=[*columns, "source_file"])

        for batch in batches:
            for p, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = _first_sheet_rows(content.as_py(), decimal)
                head = [str(h).strip() if h is not None else "" for h in next(rows, [])]
                if missing := [c for c in columns if c not in head]:
                    raise MalformedFile(f"{p}: missing columns {missing}; available {head}")
                idx = [head.index(c) for c in columns]
                kept = []
                for r in rows:
                    kept.append([r[i] if i < len(r) else None for i in idx])
                    if len(kept) >= batch_rows:
                        yield out(p, kept)
                        kept = []
                if kept:
                    yield out(p, kept)

    listed = spark.read.format("binaryFile").load(path).select("path")
    if old := listed.where(F.lower("path").endswith(".xls")).limit(1).collect():
        raise MalformedFile(f"{old[0].path}: old binary workbooks (.xls) cannot be read; save as .xlsx")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][lL][sS][xX]").load(path)
    return files.select("path", "content").mapInArrow(parse, schema)


def read_sales(spark: SparkSession, path: str, fmt: str | None = None, columns=None, decimal: str = ",",
               **csv_options) -> DataFrame:
    """Dispatch on ``fmt`` or the path's extension (``.xlsx`` -> Excel, else
    CSV). A missing path raises Spark's AnalysisException, an ``.xls`` file
    ``MalformedFile``. ``decimal``: the mark of native numbers of workbooks."""
    from shelfrank.config import RAW_COLUMNS

    kind = fmt or ("xlsx" if path.lower().rstrip("/").endswith((".xlsx", ".xls")) else "csv")
    if kind in ("xlsx", "xls"):
        return read_xlsx(spark, path, list(columns or RAW_COLUMNS), decimal=decimal)
    return read_csv(spark, path, **csv_options)


# ----------------------------------------------------------------------------- Excel writer (fixtures)

#: Rows that a sheet holds at most (the format's limit), less the header.
SHEET_ROWS = 1_048_575

_STYLES = ('<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="http://schemas.openxmlformats.org/'
           'spreadsheetml/2006/main"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1">'
           '<border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/>'
           '<xf numFmtId="14" applyNumberFormat="1"/></cellXfs></styleSheet>')
_WORKBOOK = ('<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/'
             'spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/'
             'relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>')
_RELS = ('<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/'
         'package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/'
         'officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')


def _column_name(i: int) -> str:
    name = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        name = chr(65 + r) + name
    return name


def _cell(ref: str, v) -> str:
    """A cell: numbers and dates native, other values as inline text."""
    from xml.sax.saxutils import escape

    if v is None or v != v:
        return ""
    if isinstance(v, date):
        days = (date(v.year, v.month, v.day) - date(1899, 12, 30)).days
        return f'<c r="{ref}" s="1"><v>{days if days > 60 else days - 1}</v></c>'
    if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool):
        return f'<c r="{ref}"><v>{v}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'


def _row_xml(n: int, values) -> bytes:
    return f'<row r="{n}">{"".join(_cell(f"{_column_name(i)}{n}", v) for i, v in enumerate(values))}</row>'.encode()


def _rows_xml(batch: pa.RecordBatch, first: int) -> bytes:
    """The rows of a batch, numbered from ``first``, a column at a time: the same
    cells as ``_cell`` writes. Types that are neither text, whole numbers,
    decimals nor dates go through ``_cell``."""
    numbers = pa.array(range(first, first + batch.num_rows), pa.int64()).cast(pa.string())

    def joined(*parts):
        # a missing value is a missing cell
        return pc.fill_null(pc.binary_join_element_wise(*parts, ""), "")

    cells = []
    for i, column in enumerate(batch.columns):
        name, kind = _column_name(i), column.type
        if pa.types.is_string(kind) or pa.types.is_large_string(kind):
            text = column.cast(pa.string())
            for sign, entity in (("&", "&amp;"), (">", "&gt;"), ("<", "&lt;")):
                text = pc.replace_substring(text, sign, entity)
            cells.append(joined(f'<c r="{name}', numbers, '" t="inlineStr"><is><t>', text, "</t></is></c>"))
        elif pa.types.is_integer(kind) or pa.types.is_decimal(kind):
            cells.append(joined(f'<c r="{name}', numbers, '"><v>', column.cast(pa.string()), "</v></c>"))
        elif pa.types.is_date32(kind):
            days = pc.add(column.cast(pa.int32()), 25_569)
            days = pc.if_else(pc.greater(days, 60), days, pc.subtract(days, 1))
            cells.append(joined(f'<c r="{name}', numbers, '" s="1"><v>', days.cast(pa.string()), "</v></c>"))
        else:
            cells.append(pa.array([_cell(f"{name}{n}", v) for n, v in enumerate(column.to_pylist(), first)], pa.string()))
    return "".join(pc.binary_join_element_wise('<row r="', numbers, '">', *cells, "</row>", "").to_pylist()).encode()


def _write_xlsx(out, rows_xml) -> None:
    """A minimal one-sheet workbook, its rows streamed to a file object."""
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", _WORKBOOK)
        z.writestr("xl/_rels/workbook.xml.rels", _RELS)
        z.writestr("xl/styles.xml", _STYLES)
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
            sheet.write(b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/'
                        b'spreadsheetml/2006/main"><sheetData>')
            for part in rows_xml:
                sheet.write(part)
            sheet.write(b"</sheetData></worksheet>")


def _xlsx_bytes(header: list[str], rows: list[list]) -> bytes:
    buf = io.BytesIO()
    _write_xlsx(buf, (_row_xml(n, r) for n, r in enumerate([header, *rows], 1)))
    return buf.getvalue()


def write_xlsx_parts(df: DataFrame, path: str, sheet_rows: int = 100_000) -> DataFrame:
    """Write ``df`` as workbooks of at most ``sheet_rows`` rows under ``path``:
    each partition is streamed into as many as it needs, numbers and dates as
    native cells. Every workbook leaves its task as one binary row, which
    Spark's own writers can put anywhere; here the executors write it through
    the session's default file system (``pyarrow.fs``). Returns one row per
    file written (lazy: run an action to write). Spark has no Excel sink; this
    builds fixtures.
    """
    cols = df.columns
    sheet_rows = min(sheet_rows, SHEET_ROWS)
    uri = qualified(df.sparkSession, path)

    def write(batches):
        from pyarrow import fs as pafs

        filesystem, base = pafs.FileSystem.from_uri(uri)
        batches = (b for b in batches if b.num_rows)
        rest = next(batches, None)
        while rest is not None:
            filesystem.create_dir(base, recursive=True)
            name = f"part-{uuid.uuid4().hex[:12]}.xlsx"
            count = 0

            def rows_xml():
                nonlocal rest, count
                yield _row_xml(1, cols)
                while rest is not None and count < sheet_rows:
                    part = rest.slice(0, sheet_rows - count)
                    yield _rows_xml(part, count + 2)
                    count += part.num_rows
                    rest = rest.slice(part.num_rows) if part.num_rows < rest.num_rows else next(batches, None)

            # the zip is streamed to a bounded spool, then copied
            with tempfile.SpooledTemporaryFile(16 << 20) as spool:
                _write_xlsx(spool, rows_xml())
                spool.seek(0)
                with filesystem.open_output_stream(f"{base}/{name}") as f:
                    while part := spool.read(1 << 20):
                        f.write(part)
            yield pa.RecordBatch.from_pylist([{"file": f"{path.rstrip('/')}/{name}", "rows": count}])

    return df.mapInArrow(write, "file string, rows long")
