import zipfile

from fitloom.sources.files import read_resumes

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(path, paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{a}</w:t></w:r><w:r><w:t>{b}</w:t></w:r></w:p>" for a, b in paragraphs)
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}{table}</w:body></w:document>')


def test_read_resumes(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n Jane \nline two\n", encoding="utf-8")
    (tmp_path / "B.TXT").write_text("Zoë", encoding="utf-8")
    (tmp_path / "empty.txt").write_text(" \n")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "noext").write_bytes(b"x")
    (tmp_path / "bad.docx").write_bytes(b"not a zip")
    docx(tmp_path / "d.docx", [("Jo", "hn"), (" ", ""), ("two", "")])
    good, bad = read_resumes(spark, str(tmp_path))
    texts = {r.source_file.rsplit("/", 1)[1]: r.raw_text for r in good.collect()}
    assert texts == {"a.txt": "Jane \nline two", "B.TXT": "Zoë", "d.docx": "John\ntwo"}
    assert good.select("resume_id").distinct().count() == 3
    reasons = {r.source_file.rsplit("/", 1)[1]: r.reason for r in bad.collect()}
    assert reasons == {"empty.txt": "no text found", "bad.docx": "no text found",
                       "c.pdf": "unsupported format: .pdf", "noext": "unsupported format: "}
