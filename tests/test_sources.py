"""Sources that tests alone can feed: office files, extractors, hooks that fail."""

from __future__ import annotations

import io
import zipfile

from lorekeep.sources import files, office

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def archive(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def workbook() -> bytes:
    row = lambda *cells: "<row>" + "".join(cells) + "</row>"
    return archive(
        {
            "xl/workbook.xml": f'<workbook {NS}><sheets><sheet name="Prices" r:id="a"/><sheet name="Empty" r:id="b"/><sheet name="Lone" r:id="c"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="a" Target="worksheets/one.xml"/><Relationship Id="b" Target="/xl/worksheets/two.xml"/><Relationship Id="c" Target="worksheets/three.xml"/></Relationships>',
            "xl/sharedStrings.xml": f"<sst {NS}><si><t>item</t></si><si><r><t>pri</t></r><r><t>ce</t></r></si></sst>",
            "xl/worksheets/one.xml": f"<worksheet {NS}><sheetData>"
            + row('<c r="A1" t="s"><v>0</v></c>', '<c r="B1" t="s"><v>1</v></c>')
            + row('<c r="B2"><v>3.5</v></c>', '<c r="C2"><v>9</v></c>')
            + row()
            + row('<c r="A4" t="inlineStr"><is><t>tea</t></is></c>')
            + "</sheetData></worksheet>",
            "xl/worksheets/two.xml": f"<worksheet {NS}><sheetData/></worksheet>",
            "xl/worksheets/three.xml": f"<worksheet {NS}><sheetData>" + row('<c r="A1"><v>1</v></c>', '<c r="C1"><v>2</v></c>') + "</sheetData></worksheet>",
        }
    )


def document() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    return archive({"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>line.</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Two.</w:t></w:r></w:p></w:body></w:document>"})


def test_workbook_and_document_texts():
    assert office.workbook_text(workbook()) == "## Prices\n\n| item | price |\n| --- | --- |\n|  | 3.5 |\n| tea |  |\n\n\n## Lone\n\n1 |  | 2\n"
    assert office.document_text(document()) == "One line.\n\nTwo."


def test_extractors_by_suffix(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name, content in {"a.XLSX": workbook(), "deep/b.docx": document(), "c.md": "# é".encode(), "d.py": b"x = 1", "e.bin": b"\0", "f.docx": b"broken", ".hidden.txt": b"no"}.items():
        (tmp_path / name).write_bytes(content)
    got = {r.name: r.text for r in files.extract(files.scan(spark, str(tmp_path)), office.EXTRACTORS).collect()}
    assert got == {"a.XLSX": office.workbook_text(workbook()), "b.docx": "One line.\n\nTwo.", "c.md": "# é", "d.py": "x = 1", "e.bin": "", "f.docx": ""}
    flat = files.scan(spark, str(tmp_path), "*.docx", recursive=False).select("name").collect()
    assert [r.name for r in flat] == ["f.docx"]
