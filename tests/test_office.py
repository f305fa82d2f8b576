"""Workbooks and documents read and written by the standard library, stored suppliers, date hints."""

import io
import re
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from folioflow import values as V
from folioflow.operators import pages
from folioflow.sources import files, office

MONTHS = "|".join(V.MONTHS)


def test_round_trip(spark, tmp_path):
    rows = [(1, "a & <b> \"c\"", 1.5, True, None), (2, " spaced ", -3.0, False, "x\ny"), (3, "\x01gone", float("nan"), None, "ñ 漢 👍")]
    df = spark.createDataFrame(rows, "n long, t string, f double, b boolean, u string")
    path = f"file:{tmp_path}/a.xlsx"
    office.write_workbook({"Uno": df, "Dos & más": df.limit(0)}, path)
    got = [tuple(r) for r in office.read_workbook(spark, path).orderBy("ordinal").collect()]
    assert got == [(0, "1", "a & <b> \"c\"", "1.5", "True", None), (1, "2", " spaced ", "-3", "False", "x\ny"), (2, "3", "gone", "nan", None, "ñ 漢 👍")]
    assert office.read_workbook(spark, path, 1).collect() == [] and office.read_workbook(spark, path, 1).columns == ["ordinal", "n", "t", "f", "b", "u"]
    with pytest.raises(ValueError):
        office.read_workbook(spark, path, 2)


def test_rows_beyond_a_sheet_go_on_in_the_next(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(office, "MOST_ROWS", 4)
    path = f"file:{tmp_path}/a.xlsx"
    office.write_workbook({"Uno": spark.range(7).select("id", (F.col("id") * 2).alias("twice")).orderBy("id")}, path)
    assert [tuple(r) for r in office.read_workbook(spark, path, None).orderBy("ordinal").collect()] == [(i, str(i), str(2 * i)) for i in range(7)]
    assert [r.id for r in office.read_workbook(spark, path, 2).collect()] == ["6"]


def test_cells_are_held_some_at_a_time(monkeypatch):
    def peak(rows):
        raw = office.workbook_bytes({"S": (["a", "b"], ((i, f"value {i}") for i in range(rows)))})
        tracemalloc.start()
        n = sum(b.num_rows for b in office.cell_batches("x", raw))
        high = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n == 2 * rows + 2
        return high

    monkeypatch.setattr(office, "CELLS_AT_ONCE", 1000)
    monkeypatch.setattr(office, "MOST_HELD", 1000)
    assert peak(20_000) - peak(5_000) < 15_000 * 100  # bytes a row, a fraction of what its cells take
    whole = office.workbook_bytes({"S": (["a"], [(i,) for i in range(3000)])})
    assert list(office.cell_batches("x", whole[:-30])) == []


def book(sheet, shared="", styles=""):
    out, ns = io.BytesIO(), f'xmlns="{office.MAIN[1:-1]}"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{office.RELATION[1:].partition("}")[0]}"><sheets><sheet name="S" sheetId="9" r:id="q"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="q" Target="/xl/other.xml"/></Relationships>')
        z.writestr("xl/other.xml", f"<worksheet {ns}><sheetData>{sheet}</sheetData></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{shared}</sst>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {ns}>{styles}</styleSheet>")
    return out.getvalue()


def test_cells_as_other_programs_write_them():
    styles = '<numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm&quot;x&quot;"/><numFmt numFmtId="171" formatCode="0.0&quot;d&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs>'
    shared = "<si><t>one</t></si><si><r><t>tw</t></r><r><t>o</t></r><rPh><t>no</t></rPh></si>"
    sheet = (
        '<row r="2"><c r="B2" t="s"><v>0</v></c><c r="AA2" t="s"><v>1</v></c><c r="AB2"/></row>'
        '<row><c t="str"><v>f</v></c><c s="1"><v>45292</v></c><c s="2"><v>45292.5</v></c><c s="3"><v>2.50</v></c><c t="e"><v>#N/A</v></c><c><v>1E3</v></c></row>'
    )
    got = list(office.workbook_cells(book(sheet, shared, styles)))
    assert [x[2:] for x in got] == [
        (1, 1, "one"), (1, 26, "two"), (2, 0, "f"), (2, 1, "2024-01-01 00:00:00"), (2, 2, "2024-01-01 12:00:00"), (2, 3, "2.5"), (2, 4, "#N/A"), (2, 5, "1000"),
    ]
    assert {x[:2] for x in got} == {("S", 0)}


def test_texts_of_files(spark):
    good = office.workbook_bytes({"Hoja 1": (["RFC", "x"], [(1, None), (None, None)]), "B": (["y"], [])})
    rows = [("/a/x.XLSX", bytearray(good)), ("/a/broken.xlsx", bytearray(b"no zip")), ("/a/broken.docx", bytearray(b"no")), ("/a/none", bytearray(b"")), ("/a/b.exe", bytearray(b""))]
    got = {r.path: (r.text, r.error_category) for r in files.texts(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["/a/x.XLSX"][1] is None and got["/a/x.XLSX"][0].splitlines()[0] == "Hoja: Hoja 1" and "RFC | x" in got["/a/x.XLSX"][0]
    assert got["/a/broken.xlsx"] == (None, "extraction_empty") and got["/a/broken.docx"] == (None, "processing_error")
    assert got["/a/none"][1] == got["/a/b.exe"][1] == "unsupported_type"
    assert files.texts(spark.createDataFrame([], "path string, content binary")).collect() == []


def test_stored_suppliers(spark, tmp_path):
    path = f"{tmp_path}/s"
    rows = spark.createDataFrame([(1, "a")], "id long, vendor_name string")
    assert files.bootstrap(spark, path, lambda: None) == "file_not_found"
    assert files.bootstrap(spark, path, lambda: rows) == "loaded" and files.bootstrap(spark, path, lambda: rows) == "already_loaded"
    files.store_suppliers(rows, path, replace=False)
    assert spark.read.parquet(path).count() == 2
    files.store_suppliers(rows, path)
    assert spark.read.parquet(path).count() == 1


def plain_hints(text):
    low = text.lower().translate(str.maketrans("áéíóúñ", "aeioun"))
    tidy = lambda x: re.sub(r"\s+", " ", x).strip().strip(" .,:;_-")
    found = [tidy(m) for p in V.DATE_HINTS for m in re.findall("(?s)" + p.replace("MONTHS", MONTHS), low)]
    found = [x for x in found if len(x) >= 12]
    for line in low.splitlines():
        line = re.sub(r"\s+", " ", line).strip()
        month, year, day = re.search(MONTHS, line), re.search(V.DATE_HINT_YEAR, line), re.search(V.DATE_HINT_DAY, line)
        if (month and year and day) or ("siendo el dia" in line and (month or year)):
            found.append(tidy(line))
    return list(dict.fromkeys(found))


TEXTS = [
    "", "nada", "Siendo el día 5 de MAYO de 2O20\n", "firman 12 de enero de 2024, y 12  de\nenero de 2024", "mayo 3 1999\r\nmayo 3 1999", "siendo el dia 7", "siendo el dia 7 enero", "1 de abril",
    "l5 de octubre de 20ls fin", "x12 de enero de 2024", "2024 marzo\x0b3", "siendo el dia 2021 :", "a 1 de junio del 2020. - 1.de:junio_de-2020",
]


def test_date_hints(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").select("i", pages.date_hints(F.col("t")).alias("h"))
    assert {r.i: list(r.h) for r in df.collect()} == {i: plain_hints(t) for i, t in enumerate(TEXTS)}


def test_footer_hints(spark):
    readings = [None, [], ["nada"], ["siendo el dia 7 enero", "siendo el dia 8 mayo", "1 de enero de 2001"], ["siendo el dia 7 enero", "1 de enero de 2001", "2 de enero de 2002"], ["x", None, "1 de enero de 2001", "2 de mayo de 2002"]]
    df = spark.createDataFrame(list(enumerate(readings)), "i int, r array<string>").select("i", pages.footer_hints(F.col("r")).alias("h"))
    assert {r.i: r.h for r in df.collect()} == {
        0: "", 1: "", 2: "", 3: "siendo el dia 7 enero\nsiendo el dia 8 mayo", 4: "siendo el dia 7 enero\n1 de enero de 2001", 5: "1 de enero de 2001",
    }
