import io
import zipfile
from datetime import datetime

import pytest
from weirflow.sources.workbook import MAIN, sheet_rows

NS = MAIN.strip("{}")


def workbook(sheets, styles="", strings="", settings=""):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{NS}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">{settings}<sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="/xl/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, body in enumerate(sheets.values()):
            z.writestr(f"xl/s{i}.xml", f'<worksheet xmlns="{NS}"><sheetData>{body}</sheetData></worksheet>')
        if styles:
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{NS}">{styles}</styleSheet>')
        if strings:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{NS}">{strings}</sst>')
    held.seek(0)
    return held


def test_kinds_of_cells_gaps_and_sheets():
    styles = '<numFmts><numFmt numFmtId="164" formatCode="yyyy-mm-dd"/><numFmt numFmtId="165" formatCode="0.0&quot;days&quot;[Red]"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs>'
    one = '<row r="2"><c r="B2" t="s"><v>0</v></c><c r="D2"><v>1.5</v></c></row><row r="4"><c s="1"><v>46023.25</v></c><c s="2"><v>3</v></c><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c><c t="str"><v>x</v></c><c/></row>'
    strings = "<si><r><t>two</t></r><r><t> runs</t></r><rPh><t>hint</t></rPh></si>"
    sheets = {"first": one, "second": '<row><c r="AB1" t="inlineStr"><is><t>far</t></is></c></row>'}
    assert sheet_rows(workbook(sheets, styles, strings)) == [[], [None, "two runs", None, 1.5], [], [datetime(2026, 1, 1, 6), 3, True, None, "x", None]]
    assert sheet_rows(workbook(sheets, styles, strings), "second") == sheet_rows(workbook(sheets, styles, strings), 1) == [[None] * 27 + ["far"]]
    assert sheet_rows(workbook({"s": '<row><c s="1"><v>1</v></c></row>'}, styles, settings='<workbookPr date1904="1"/>')) == [[datetime(1904, 1, 2)]]
    assert sheet_rows(workbook({"s": ""})) == []
    with pytest.raises(KeyError):
        sheet_rows(workbook({"s": ""}), "other")
