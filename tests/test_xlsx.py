"""Workbooks as other programs write them, packed by hand, and as the library writes them."""

import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestream.sources import readers, sinks, xlsx

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def book(path, sheets, strings=(), styles=None, date1904=False, absolute=False):
    """``sheets``: name -> the XML of its sheetData."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        names = list(sheets)
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{MAIN}" xmlns:r="{REL}"><workbookPr date1904="{int(date1904)}"/><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        target = "/xl/worksheets/s{}.xml" if absolute else "worksheets/s{}.xml"
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="x" Target="{target.format(i)}"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        for i, n in enumerate(names, 1):
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{sheets[n]}</sheetData></worksheet>')
        if strings:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">' + "".join(f"<si>{s}</si>" for s in strings) + "</sst>")
        if styles:
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}">{styles}</styleSheet>')
    return str(path)


STRINGS = ["<t>Code</t>", '<t xml:space="preserve"> Name </t>', "<r><t>Pu</t></r><r><t>mp</t></r>", "<t>valve</t><rPh sb='0' eb='1'><t>reading</t></rPh>", "<t>When</t>"]
STYLES = '<numFmts count="2"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="0.0&quot;days&quot;"/></numFmts><cellXfs count="4"><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs>'
FIRST = """<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c><c r="D2" t="s"><v>4</v></c><c r="E2" t="s"><v>0</v></c></row>
<row r="3"><c r="A3"><v>7</v></c><c r="B3" t="s"><v>2</v></c><c r="C3" t="b"><v>1</v></c><c r="D3" s="1"><v>45297.5</v></c><c r="E3" s="3"><v>0.1</v></c></row>
<row r="5"><c t="inlineStr"><is><t>x&amp;y</t></is></c><c t="s"><v>3</v></c><c t="e"><v>#N/A</v></c><c s="2"><v>45297</v></c><c t="str"><f>A1</f><v>formula</v></c></row><row r="6"><c r="B6"/></row>"""


def test_cells_of_every_kind(spark, tmp_path):
    path = book(tmp_path / "a.xlsx", {"First": FIRST}, STRINGS, STYLES)
    out = readers.excel(spark, path, header=1)
    assert out.columns == ["Code", "Name", "Unnamed: 2", "When", "Code.1"]
    assert sorted(map(tuple, out.collect())) == [("7", "Pump", "True", "2024-01-06 12:00:00", "0.1"), ("x&y", "valve", "", "2024-01-06 00:00:00", "formula")]


def test_sheets_by_name_place_and_all_of_several_books(spark, tmp_path):
    row = lambda n, *cells: f'<row r="{n}">' + "".join(f'<c t="inlineStr"><is><t>{c}</t></is></c>' for c in cells) + "</row>"
    book(tmp_path / "one.xlsx", {"Jan": row(1, "a", "b") + row(2, "1", "2"), "Feb": row(1, "b", "c") + row(2, "3", "4") + row(3, "", "5"), "None": ""})
    book(tmp_path / "two.xlsx", {"Jan": row(1, "a") + row(2, "9")}, absolute=True)
    one, both = str(tmp_path / "one.xlsx"), str(tmp_path / "*.xlsx")
    assert readers.excel(spark, one, "Feb").columns == ["b", "c"] and readers.excel(spark, one, 1).count() == 2
    out = readers.excel(spark, both, None)
    assert out.columns == ["sheet", "a", "b", "c"]
    assert sorted(map(tuple, out.collect()), key=repr) == [("Feb", None, "", "5"), ("Feb", None, "3", "4"), ("Jan", "1", "2", None), ("Jan", "9", None, None)]
    assert readers.excel(spark, one, "None").count() == 0 and readers.excel(spark, one, "absent").count() == 0


def test_dates_of_the_other_epoch(spark, tmp_path):
    path = book(tmp_path / "mac.xlsx", {"s": '<row r="1"><c t="str"><v>d</v></c></row><row r="2"><c s="1"><v>1</v></c></row>'}, (), STYLES, date1904=True)
    assert readers.excel(spark, path).first()["d"] == "1904-01-02 00:00:00"


def test_header_is_found_below_a_title(spark, tmp_path):
    rows = [["Payroll"], [], ["Emp. Code", "Employee Name", "Net Pay"], ["1", " Ann ", "10"], ["", "", ""], ["2", "Bob"]]
    data = "".join(f'<row r="{i}">' + "".join(f'<c r="{xlsx.column_name(j)}{i}" t="inlineStr"><is><t xml:space="preserve">{v}</t></is></c>' for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1) if r)
    path = book(tmp_path / "p.xlsx", {"s": data})
    aliases = {"code": ["employee code", "emp code"], "name": ["employee name"], "pay": ["net pay"]}
    assert sorted(map(tuple, readers.excel_with_header(spark, path, aliases).collect())) == [("1", "Ann", "10"), ("2", "Bob", None)]


def test_written_books_are_read_again(spark, tmp_path):
    df = spark.createDataFrame([(1, "a <b> & \"c\"", 0.5, True, dt.date(2024, 1, 2)), (2, None, float("nan"), False, None), (10**12, " x\ty\x07 ", -3.0, None, None)], "n long, `t & u` string, v double, b boolean, d date")
    path = str(tmp_path / "out.xlsx")
    sinks.master_file(df, path, "excel")
    sinks.master_file(df, path, "excel")  # replaces
    out = readers.excel(spark, path)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == [("1", 'a <b> & "c"', "0.5", "True", "2024-01-02"), ("1000000000000", " x\ty ", "-3", "", ""), ("2", "", "nan", "False", "")]
    sinks.excel_file({"one": df.select("n"), "two & more": df.select(F.lit("z").alias("k"))}, path)
    assert readers.excel(spark, path, "two & more").count() == 3 and readers.excel(spark, path, None).columns == ["sheet", "n", "k"]


def test_long_sheets_are_streamed_and_too_long_ones_refused(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "long.xlsx")
    sinks.master_file(spark.range(30_000).select("id", (F.col("id") * 2).alias("twice")), path, "excel")
    out = readers.excel(spark, path)
    assert out.count() == 30_000 and out.agg(F.sum(F.col("twice").cast("long"))).first()[0] == 30_000 * 29_999
    monkeypatch.setattr(sinks, "EXCEL_ROWS", 10)
    with pytest.raises(ValueError):
        sinks.master_file(spark.range(11).toDF("id"), path, "excel")


def test_column_names():
    assert [xlsx.column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert [xlsx.column_number(xlsx.column_name(i) + "12") for i in (0, 25, 26, 701, 702, 16383)] == [0, 25, 26, 701, 702, 16383]
