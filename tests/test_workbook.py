"""A workbook made by hand against the same catalogue as CSV."""

import zipfile

from quire.sources.tables import read_catalogue, read_sheet
from quire.sources.workbook import column_number, sheet_rows

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
SHARED = ["numero", "autor", "obras", "paginas", "notas", "Homero", "Ilíada", "1[2]"]
ROWS = [
    '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>2</v></c><c r="D1" t="s"><v>3</v></c><c r="E1" t="s"><v>4</v></c></row>',
    '<row r="2"><c r="A2"><v>150.0</v></c><c r="B2" t="s"><v>5</v></c><c r="C2" t="s"><v>6</v></c><c r="D2" t="inlineStr"><is><t>600 p.</t></is></c><c r="G2"><v>9</v></c></row>',
    '<row r="4"><c r="A4"/><c r="C4" t="str"><f>A1</f><v>  </v></c></row>',
    '<row r="7"><c r="A7" t="s"><v>7</v></c><c r="C7" t="inlineStr"><is><r><t>Fas</t></r><r><t>tos</t></r></is></c><c r="E7" t="b"><v>1</v></c></row>',
    '<row><c t="inlineStr"><is><t>9.5</t></is></c><c t="inlineStr"><is><t>Ovidio</t></is></c><c t="e"><v>#REF!</v></c><c><v>320</v></c></row>',
]


def workbook(path, sheet="worksheets/hoja.xml"):
    with zipfile.ZipFile(path, "w") as out:
        out.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="x" sheetId="1" r:id="rId9"/><sheet name="y" sheetId="2" r:id="rId1"/></sheets></workbook>')
        out.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/other.xml"/><Relationship Id="rId9" Target="{sheet}"/></Relationships>')
        out.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si><t>{s}</t><rPh><t>no</t></rPh></si>" for s in SHARED) + "</sst>")
        out.writestr("xl/" + sheet.removeprefix("/xl/"), f"<worksheet {MAIN}><sheetData>{''.join(ROWS)}</sheetData></worksheet>")
    return str(path)


def test_a_workbook_reads_as_its_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text("numero,autor,obras,paginas,notas\n150.0,Homero,Ilíada,600 p.,\n,,  ,,\n1[2],,Fastos,,TRUE\n9.5,Ovidio,,320,\n")
    plain = [tuple(r)[1:] for r in read_catalogue(spark, str(tmp_path / "c.csv")).orderBy("fila").collect()]
    for name, sheet in (("a.xlsx", "worksheets/hoja.xml"), ("b.XLSX", "/xl/worksheets/otra.xml")):
        got = read_catalogue(spark, workbook(tmp_path / name, sheet)).orderBy("fila").collect()
        assert [tuple(r)[1:] for r in got] == plain and len(plain) == 3


def test_cells(spark, tmp_path):
    content = open(workbook(tmp_path / "a.xlsx"), "rb").read()
    assert list(sheet_rows(content, 5))[1:] == [(2, "150", "Homero", "Ilíada", "600 p.", None), (4, None, None, "  ", None, None), (7, "1[2]", None, "Fastos", None, "TRUE"), (8, "9.5", "Ovidio", None, "320", None)]
    assert [column_number(r) for r in ("A1", "Z9", "AA10", "AB7")] == [0, 25, 26, 27]
    assert read_sheet(spark, str(tmp_path / "a.xlsx"), ("x", "y")).count() == 5
