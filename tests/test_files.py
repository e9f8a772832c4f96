"""File sources (F-H): encodings, bad lines, required columns, workbooks."""

import io
import os
import zipfile

import pytest

from shelfrank.config import RAW_COLUMNS
from shelfrank.operators.clean import MissingColumns, clean_sales, rename_raw, require_columns
from shelfrank.sources import files

HEADER = ";".join(RAW_COLUMNS)


def write(path, text, enc):
    with open(path, "wb") as f:
        f.write(text.encode(enc) if enc != "utf-8-sig" else b"\xef\xbb\xbf" + text.encode("utf-8"))


BODY = (HEADER + "\n1;pão de queijo;1.234,56;05/01/2024\n"
        "2;café;10,00;06/01/2024\n"
        "3;suco;5,00;07/01/2024;extra\n"
        "4;água;2,50\n")


@pytest.mark.parametrize("enc,opt", [("utf-8", "auto"), ("utf-8-sig", "auto"), ("iso-8859-1", "auto"),
                                     ("cp1252", "cp1252")])
def test_csv_encodings_and_bad_lines(spark, tmp_dir, enc, opt):
    p = os.path.join(tmp_dir, "sales.csv")
    write(p, BODY, enc)
    df = files.read_csv(spark, p, encoding=opt)
    assert df.columns == list(RAW_COLUMNS)
    rows = {r[0]: r for r in df.collect()}
    assert set(rows) == {"1", "2", "4"}  # too many fields: dropped; too few: kept
    assert rows["1"][1] == "pão de queijo" and rows["2"][1] == "café"
    assert rows["4"][3] is None
    fact = clean_sales(rename_raw(df))
    assert {r.product for r in fact.collect()} == {"PÃO DE QUEIJO", "CAFÉ", "ÁGUA"}


def test_csv_strict_and_missing_columns(spark, tmp_dir):
    p = os.path.join(tmp_dir, "bad.csv")
    write(p, BODY, "utf-8")
    with pytest.raises(files.MalformedFile):
        files.read_csv(spark, p, strict=True)
    q = os.path.join(tmp_dir, "cols.csv")
    write(q, "a;b\n1;2\n", "utf-8")
    with pytest.raises(MissingColumns):
        require_columns(rename_raw(files.read_csv(spark, q)))


def test_xlsx_two_workbooks(spark, tmp_dir):
    d = os.path.join(tmp_dir, "books")
    os.makedirs(d)
    for i, rows in enumerate([[["1", "a", "1,00", "01/01/2024"]], [["2", "b", "2,00", "02/01/2024"],
                                                                    ["2", "c", "3,00", "03/01/2024"]]]):
        with open(os.path.join(d, f"w{i}.xlsx"), "wb") as f:
            f.write(files._xlsx_bytes(list(RAW_COLUMNS), rows))
    df = files.read_sales(spark, d, fmt="xlsx")
    assert df.count() == 3
    fact = clean_sales(rename_raw(df.drop("source_file")))
    assert sorted(r.product for r in fact.collect()) == ["A", "B", "C"]


def test_cp1252_only_characters(spark, tmp_dir):
    # euro sign, curly quotes and en dash are bytes 0x80-0x9F in cp1252
    p = os.path.join(tmp_dir, "win.csv")
    write(p, HEADER + "\n1;\u201cpão\u201d \u2013 €;1,00;05/01/2024\n", "cp1252")
    rows = files.read_csv(spark, p, encoding="cp1252").collect()
    assert [r[1] for r in rows] == ["\u201cpão\u201d \u2013 €"]


def test_xlsx_streams_in_batches(spark, tmp_dir):
    # 2,500 rows of one workbook leave the task in batches of 1,000
    d = os.path.join(tmp_dir, "big")
    os.makedirs(d)
    rows = [[str(i % 5), f"item {i}", f"{i},00", "01/02/2024"] for i in range(1, 2501)]
    with open(os.path.join(d, "w.xlsx"), "wb") as f:
        f.write(files._xlsx_bytes(list(RAW_COLUMNS), rows))
    got = files.read_xlsx(spark, d, list(RAW_COLUMNS), batch_rows=1000)
    assert got.count() == 2500
    assert got.filter(got[RAW_COLUMNS[1]] == "item 2500").count() == 1


def test_auto_encoding_mixed_folder(spark, tmp_dir):
    # one UTF-8 file and one ISO-8859-1 file in the same folder, read in one scan
    d = os.path.join(tmp_dir, "mixed")
    os.makedirs(d)
    write(os.path.join(d, "a.csv"), HEADER + "\n1;pão;1,00;05/01/2024\n", "utf-8")
    write(os.path.join(d, "b.csv"), HEADER + "\n2;café;2,00;06/01/2024\n", "iso-8859-1")
    rows = {r[0]: r[1] for r in files.read_csv(spark, d).collect()}
    assert rows == {"1": "pão", "2": "café"}


def test_auto_encoding_needs_no_extra_pass(spark, tmp_dir):
    # reading only runs the header job; the encoding is decided inside the scan
    p = os.path.join(tmp_dir, "lazy.csv")
    write(p, BODY, "iso-8859-1")
    sc = spark.sparkContext
    sc.setJobGroup("read-auto", "read_csv auto")
    try:
        df = files.read_csv(spark, p)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("read-auto")) <= 1
    assert {r[1] for r in df.collect()} == {"pão de queijo", "café", "água"}


# ------------------------------------------------------------ bad lines and headers

LONG = ["9;x;1,00;01/01/2024;", "9;x;1,00;01/01/2024;;y", "9;x;1,00;01/01/2024;z", '9;"x;y";1,00;01/01/2024;']


def test_every_surplus_field_makes_a_long_line(spark, tmp_dir):
    p = os.path.join(tmp_dir, "long.csv")
    keep = ["1;a;1,00;01/01/2024", "2;b;2,00", "3", '4;"c;d";4,00;01/01/2024', ";;;"]
    write(p, "\n".join([HEADER, *keep, *LONG]) + "\n", "utf-8")
    got = sorted((r[0] or "", r[1]) for r in files.read_csv(spark, p).collect())
    assert got == [("", None), ("1", "a"), ("2", "b"), ("3", None), ("4", "c;d")]
    assert files.read_csv(spark, p).select(f"`{RAW_COLUMNS[0]}`").count() == 5


@pytest.mark.parametrize("line", LONG)
def test_strict_refuses_each_long_form(spark, tmp_dir, line):
    p = os.path.join(tmp_dir, "strict.csv")
    write(p, HEADER + "\n1;a;1,00;01/01/2024\n" + line + "\n", "utf-8")
    with pytest.raises(files.MalformedFile):
        files.read_csv(spark, p, strict=True)


def test_files_of_a_folder_are_matched_by_name(spark, tmp_dir):
    d = os.path.join(tmp_dir, "mixed")
    os.makedirs(d)
    write(os.path.join(d, "a.csv"), "s;p;v\n1;pão;1,0\n2;b;2,0;\n", "utf-8")
    write(os.path.join(d, "b.csv"), "v;s;p\n3,0;3;café\n4,0;4\n", "iso-8859-1")
    write(os.path.join(d, "empty.csv"), "", "utf-8")
    df = files.read_csv(spark, d)
    assert sorted(tuple(r[c] for c in "spv") for r in df.collect() if r.p) == [("1", "pão", "1,0"), ("3", "café", "3,0")]
    assert df.count() == 3
    write(os.path.join(d, "c.csv"), "v;s;q\n1;1;1\n", "utf-8")
    with pytest.raises(files.MalformedFile):
        files.read_csv(spark, d)


# ------------------------------------------------------------ workbooks

def book(d, name, header, rows):
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, name), "wb") as f:
        f.write(files._xlsx_bytes(header, rows))


def test_native_numbers_and_dates(spark, tmp_dir):
    from datetime import date
    from decimal import Decimal

    from shelfrank.plans.jobs import load_fact
    d = os.path.join(tmp_dir, "native")
    book(d, "a.xlsx", list(RAW_COLUMNS), [[7, "pão", 1234.56, date(2024, 3, 1)], ["8", "b", "1.234,56", "02/03/2024"],
                                          [9, "c", 1e-7, date(2024, 1, 1)], [10, "d", 3, None], [11, 12, Decimal("0.5"), date(1900, 1, 5)]])
    got = sorted((r.store_id, r.product, r.value, r.d) for r in load_fact(spark, d, fmt="xlsx").collect())
    assert got == [("10", "D", Decimal("3.00"), None), ("11", "12", Decimal("0.50"), date(1900, 1, 5)),
                   ("7", "PÃO", Decimal("1234.56"), date(2024, 3, 1)), ("8", "B", Decimal("1234.56"), date(2024, 3, 2))]
    plain = load_fact(spark, d, fmt="xlsx", money="plain")
    assert {r.store_id: r.value for r in plain.collect()}["7"] == Decimal("1234.56")


def test_cell_styles_and_calendars():
    from datetime import date
    assert [files._shows_date(c) for c in ("dd/mm/yyyy", 'General', '#,##0.00', '"day" 0', "[$-409]d-mmm", "[h]:mm", "0.0%", '[Red]0;"d"', "_d0")] == \
        [True, False, False, False, True, True, False, False, False]
    assert files._serial_date("45352", False) == "01/03/2024" and files._serial_date("45352.75", False) == "01/03/2024"
    assert files._serial_date("1", False) == "01/01/1900" and files._serial_date("61", False) == "01/03/1900"
    assert files._serial_date("0", True) == "01/01/1904"
    assert [files._number_text(v, ",") for v in ("1234.56", "1E3", "1e-7", "5", "0.1", "-2.50")] == ["1234,56", "1000", "0,0000001", "5", "0,1", "-2,5"]
    assert date(1904, 1, 1)


def test_bad_workbooks_fail(spark, tmp_dir):
    d = os.path.join(tmp_dir, "bad")
    book(d, "a.xlsx", ["loja", "x"], [["1", "2"]])
    with pytest.raises(Exception, match="missing columns"):
        files.read_sales(spark, d, fmt="xlsx").collect()
    old = os.path.join(tmp_dir, "old")
    os.makedirs(old)
    write(os.path.join(old, "a.XLS"), "x", "utf-8")
    for path, fmt in ((old, "xlsx"), (os.path.join(old, "a.XLS"), None)):
        with pytest.raises(files.MalformedFile):
            files.read_sales(spark, path, fmt)


def test_written_workbooks_follow_the_rows(spark, tmp_dir):
    df = spark.range(2500).selectExpr("cast(id as string) a", "cast(id as double) / 4 b", "date_add('2024-01-01', cast(id % 9 as int)) c").coalesce(1)
    out = files.write_xlsx_parts(df, os.path.join(tmp_dir, "parts"), sheet_rows=1000).collect()
    assert sorted(r.rows for r in out) == [500, 1000, 1000]
    back = files.read_xlsx(spark, os.path.join(tmp_dir, "parts"), ["a", "b", "c"], decimal=".")
    assert {(r.a, float(r.b), r.c) for r in back.collect()} == {(str(i), i / 4, f"{1 + i % 9:02d}/01/2024") for i in range(2500)}


MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def sheet_bytes(sheet, shared=True):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", files._WORKBOOK)
        z.writestr("xl/_rels/workbook.xml.rels", files._RELS)
        z.writestr("xl/styles.xml", files._STYLES)
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}"><si><t>one</t></si><si><t>t&amp;amp;wo</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    return out.getvalue()


PLAIN = ('<row r="1" spans="1:4"><c r="A1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t xml:space="preserve"> a &amp; b&lt;</t></is></c></row>'
         '<row r="2"/><row r="3"></row><row><c><v>12.50</v></c><c s="1"><v>45352</v></c><c r="C4"/><c r="E4" t="e"><v>#N/A</v></c></row>')
PLAIN_ROWS = [["t&amp;wo", None, " a & b<"], [], [], ["12,5", "01/03/2024", None, None, None]]


def test_plain_sheets_are_read_without_a_tree(monkeypatch):
    # pieces of 256 KB, rows cut anywhere by them
    head = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\r\n<worksheet xmlns="{MAIN}"><cols><col/></cols><sheetData>'
    body = PLAIN.replace('t="s"><v>1</v>', 't="str"><v>t&amp;amp;wo</v>') * 3000
    data = sheet_bytes(f"{head}{body}</sheetData><pageMargins/></worksheet>", shared=False)

    built = []
    monkeypatch.setattr(files.ET, "TreeBuilder", lambda whole=files.ET.TreeBuilder: built.append(1) or whole())
    monkeypatch.delattr(files.ET, "iterparse")
    assert list(files._first_sheet_rows(data)) == PLAIN_ROWS * 3000
    assert len(built) == 3  # workbook, relations and styles


@pytest.mark.parametrize(("odd", "row"), [
    ('<row r="5"><c r="A5"><f>A1+1</f><v>3</v></c></row>', ["3"]),
    ('<row r="5"><c r="A5" t="inlineStr"><is><r><t>a</t></r><r><t>b</t></r></is></c></row>', ["ab"]),
    ('<row r="5"><!-- </row><row> --><c r="A5" t="str"><v><![CDATA[</row>&]]></v></c></row>', ["</row>&"]),
    ('<row r="5">\n <c t="str" r="B5"><v>&#65;\r\n</v></c>\n</row>', [None, "A\n"]),
])
def test_sheets_of_other_markup_give_the_same_rows(odd, row):
    body = PLAIN * 3000 + odd + PLAIN
    data = sheet_bytes(f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>')
    assert list(files._first_sheet_rows(data)) == [*PLAIN_ROWS * 3000, row, *PLAIN_ROWS]


def test_other_sheet_heads():
    row = "<x:row><x:c><x:v>1</x:v></x:c></x:row>"
    assert list(files._first_sheet_rows(sheet_bytes(f'<x:worksheet xmlns:x="{MAIN}"><x:sheetData>{row}</x:sheetData></x:worksheet>'))) == [["1"]]
    assert list(files._first_sheet_rows(sheet_bytes(f'<worksheet xmlns="{MAIN}"><sheetData/></worksheet>'))) == []


def test_columns_are_written_as_cells_are():
    from datetime import date
    from decimal import Decimal

    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({
        "a": pa.array(["x & <y>", None, ""]), "b": pa.array([1, None, -3], pa.int32()), "c": pa.array([Decimal("1.50"), Decimal("0.00"), None], pa.decimal128(18, 2)),
        "d": pa.array([date(2024, 3, 1), None, date(1900, 1, 5)]), "e": [0.25, float("nan"), None], "f": [True, None, False]})
    rows = zip(*(c.to_pylist() for c in batch.columns))
    assert files._rows_xml(batch.slice(0), 7) == b"".join(files._row_xml(n, r) for n, r in enumerate(rows, 7))
    assert files._rows_xml(batch.slice(1, 2), 8) == files._rows_xml(batch, 7).split(b"</row>", 1)[1]


# ------------------------------------------------------------ cleaning options

def test_numeric_columns_and_money_modes(spark):
    from decimal import Decimal

    from shelfrank.operators.clean import money_mode, quality_counts
    native = spark.createDataFrame([("1", "a", 1234.56, "01/02/2024"), ("1", "b", 2.675, "01/02/2024"), ("1", "c", float("nan"), "x"), ("1", "d", None, "x")],
                                   "store_id string, product string, value_raw double, date_raw string")
    got = {r.product: r.value for r in clean_sales(native).collect()}
    assert got == {"A": Decimal("1234.56"), "B": Decimal("2.68")}
    text = lambda *v: spark.createDataFrame([("1", "a", x, "01/02/2024") for x in v], "store_id string, product string, value_raw string, date_raw string")
    assert money_mode(text("1.5", None, " 3 ")) == "plain" and money_mode(text("1.5", "2,5")) == "br" and money_mode(native) == "plain"
    assert [r.value for r in clean_sales(text("1.50"), money="auto").collect()] == [Decimal("1.50")]
    assert [r.value for r in clean_sales(text("1.234,50"), money="auto").collect()] == [Decimal("1234.50")]
    for t in ("R$ 1.234,56", "R$ 1.234,56", " R$1.234,56 "):
        assert [r.value for r in clean_sales(text(t), currency=True).collect()] == [Decimal("1234.56")], t
    raw = spark.createDataFrame([("1", "a", "1,005", "01/02/2024"), (" ", "a", "1,00", "x"), (None, "a", "1,00", "x"), ("1", " ", "1,500", "01/02/2024"),
                                 ("1", "a", "0", "x")], "store_id string, product string, value_raw string, date_raw string")
    q = quality_counts(raw).first().asDict()
    assert q == {"rows_read": 5, "non_positive_values": 1, "rounded_values": 1, "invalid_dates": 2, "invalid_products": 1, "invalid_stores": 2, "valid_rows": 1}
    assert clean_sales(raw).count() == q["valid_rows"]
