import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.operators import jobs as J
from quire.operators import office as O
from quire.queries import documents as D
from quire.sources import config as G
from quire.sources import documents as S


@pytest.fixture
def packages(tmp_path):
    sheet = f'<sst xmlns="{O.SHEET_NS}"><si><t>Hola mundo</t></si><si><r><t>Monto</t></r></si><si><t>12</t></si></sst>'
    book = f'<workbook xmlns="{O.SHEET_NS}"><sheets><sheet name="Hoja1" sheetId="1"/><sheet name="Datos" sheetId="2"/></sheets></workbook>'
    word = f'<w:document xmlns:w="{O.WORD_NS}"><w:body><w:p><w:r><w:t>Texto</w:t></w:r></w:p></w:body></w:document>'
    for name, parts in {"a.xlsx": {"xl/workbook.xml": book, "xl/sharedStrings.xml": sheet, "xl/drawings/d.bin": "x"}, "b.docx": {"word/document.xml": word, "word/footnotes.xml": word, "word/header1.xml": "<broken"}}.items():
        with zipfile.ZipFile(tmp_path / name, "w") as package:
            for part, data in parts.items():
                package.writestr(part, data)
    (tmp_path / "c.docx").write_bytes(b"no package")
    return str(tmp_path)


def test_packages(spark, packages):
    parts = O.read_parts(spark, packages).withColumn("doc", F.regexp_extract("doc", "([^/]*)$", 1)).cache()
    assert parts.count() == 6
    nodes = O.text_nodes(parts)
    assert sorted((r.doc, r.node_no, r.text) for r in nodes.collect()) == [("a.xlsx", 0, "Hola mundo"), ("a.xlsx", 1, "Monto"), ("a.xlsx", 2, "12"), ("b.docx", 0, "Texto")]
    assert sorted(r.text for r in O.first_seen(nodes, ["doc"], ["part_no", "node_no"]).collect()) == ["Hola mundo", "Monto", "Texto"]
    assert [(r.sheet_no, r.name) for r in O.sheet_names(parts).orderBy("sheet_no").collect()] == [(0, "Hoja1"), (1, "Datos")]
    new = O.rewrite_parts(parts, spark.createDataFrame([("Hola mundo", "Hello world"), ("Monto", "Monto")], "source string, en string"))
    assert {r.part_name: r.replaced for r in new.where("replaced > 0").collect()} == {"xl/sharedStrings.xml": 1}
    again = O.text_nodes(new)
    assert "Hello world" in {r.text for r in again.collect()}
    kept = new.where("part_name <> 'xl/sharedStrings.xml'")
    assert [r.change for r in O.part_diff(parts, new, ["doc", "part_name"]).collect()] == ["changed"]
    assert {r.part_name: r.change for r in O.part_diff(parts, kept, ["doc", "part_name"]).collect()} == {"xl/sharedStrings.xml": "lost"}
    assert {r.change for r in O.part_diff(kept, parts, ["doc", "part_name"]).collect()} == {"added"}


def test_packages_are_written_whole(spark, tmp_path):
    """Everything but the translated texts and names survives byte for byte, with its compression and time."""
    sheet = f'<worksheet xmlns="{O.SHEET_NS}"><sheetData><row><c><f>SUM(Datos!A1,\'Hoja 1\'!B2)</f></c></row></sheetData></worksheet>'
    parts = {
        "[Content_Types].xml": "<Types/>", "xl/workbook.xml": f'<workbook xmlns="{O.SHEET_NS}"><sheets><sheet name="Hoja 1" sheetId="1"/><sheet name="Datos" sheetId="2"/></sheets></workbook>',
        "xl/sharedStrings.xml": f'<sst xmlns="{O.SHEET_NS}"><si><t>Hola mundo</t></si></sst>', "xl/worksheets/sheet1.xml": sheet, "xl/drawings/drawing1.xml": "<d/>", "xl/persons/person.xml": "<p/>", "xl/webextensions/w.bin": "\x00x",
    }
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as package:
        for i, (name, data) in enumerate(parts.items()):
            info = zipfile.ZipInfo(name, (2010, 1, 2, 3, 4, 2 * i))
            info.compress_type = zipfile.ZIP_DEFLATED if i % 2 else zipfile.ZIP_STORED
            package.writestr(info, data)
    (tmp_path / "b.docx").write_bytes(b"no package")
    words = spark.createDataFrame([("Hola mundo", "Hello world"), ("Datos", "Data: all"), ("Hoja 1", "Sheet 1"), ("none", None)], "source string, en string")
    got = {r.doc.rsplit("/")[-1]: r for r in O.translate_packages(O.read_packages(spark, f"file://{tmp_path}"), words).collect()}
    assert bytes(got["b.docx"].content) == b"no package" and (got["a.xlsx"].replaced, got["a.xlsx"].renamed) == (1, 2)
    with zipfile.ZipFile(io.BytesIO(got["a.xlsx"].content)) as new, zipfile.ZipFile(tmp_path / "a.xlsx") as old:
        facts = lambda z: [(i.filename, i.date_time, i.compress_type) for i in z.infolist()]
        assert facts(new) == facts(old)
        assert [n for n in parts if new.read(n) != old.read(n)] == ["xl/workbook.xml", "xl/sharedStrings.xml", "xl/worksheets/sheet1.xml"]
        assert b'name="Data  all"' in new.read("xl/workbook.xml") and b"SUM('Data  all'!A1,'Sheet 1'!B2)" in new.read("xl/worksheets/sheet1.xml")


def test_rewriting_of_empty_texts_and_missing_keys(spark):
    word = f'<w:document xmlns:w="{O.WORD_NS}"><w:t/><w:t>Texto</w:t><w:t></w:t></w:document>'.encode()
    parts = spark.createDataFrame([("a", 0, "word/document.xml", word), (None, 0, "word/document.xml", word)], "doc string, part_no int, part_name string, bytes binary")
    counts = lambda *pairs: {r.doc: r.replaced for r in O.rewrite_parts(parts, spark.createDataFrame(pairs, "source string, en string")).collect()}
    assert counts(("", "new")) == {"a": 2, None: 2}
    assert counts(("Texto", "Text")) == {"a": 1, None: 1}


@pytest.mark.parametrize("texts", [["Hola\n", "", None, "\n\n", "Hola"], ["A\r\nHola", "A\r\nA"], ["A\x01 ]]> <b>&\nHola\nA\x01 ]]> <b>&", "Hola", "hex:41"], ["A ]]>"], ["replaced"]])
def test_office_rewrite_counts_the_first_line_whatever_it_is(spark, tmp_path, texts):
    spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lines = {i: (t or "").split("\n") for i, t in [*enumerate(texts), (None, texts[0])]}
    first = min(line for found in lines.values() for line in found)
    got = {r.doc: r.replaced for r in D.office_rewrite(spark, str(tmp_path)).collect()}
    assert got == {i if i is None else str(i): found.count(first) for i, found in lines.items()}
    nodes = sorted((r.doc or "", r.node_no, r.text) for r in D.office_text_nodes(spark, str(tmp_path)).collect())
    assert nodes == sorted(("" if i is None else str(i), n, line) for i, found in lines.items() for n, line in enumerate(found) if line)


@pytest.mark.parametrize(("chars", "fonts", "kind"), [(0, [], "scan"), (39, ["A"], "scan"), (40, ["A"], "digital"), (50, ["GlyphLessFont"], "ocr"), (50, ["GlyphLessFont", "A"], "digital"), (50, [], "digital")])
def test_classification(spark, chars, fonts, kind):
    pages = spark.createDataFrame([(1, "x" * chars, fonts)], "doc_id long, text string, fonts array<string>")
    assert J.classify_documents(pages, ["doc_id"]).first().kind == kind


def test_uploads(spark):
    rows = [("a.pdf", "255044462D31", 10, 3, None), ("x/a.pdf", "25", 1, 1, "invalid filename"), ("..", "", 1, 1, "invalid filename"), ("a.exe", "", 1, 1, "unsupported file type"), ("a.pdf", "", 0, 1, "empty file"), ("a.PDF", "2550", 60_000_000, 1, "file too large"), ("a.docx", "255044462D", 5, 1, "content does not match"), ("a.pdf", "255044462D", 5, 501, "too many pages"), ("a.xls", "D0CF11E0A1B11AE100", 5, None, None)]
    df = spark.createDataFrame(rows, "name string, head string, size long, pages int, want string")
    got = df.select(J.rejection(*(F.col(c) for c in ("name", "head", "size", "pages"))).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_jobs(spark):
    jobs = spark.createDataFrame([(1, "queued", "v", False), (2, "running", "v", False), (3, "done", "w", True), (4, "queued", "w", False)], "job_id long, status string, visitor_id string, cancelled boolean")
    files = spark.createDataFrame([(1, "failed"), (1, "done"), (2, "done"), (3, "failed")], "job_id long, status string")
    assert {r.job_id: r.status for r in J.job_status(files, jobs).collect()} == {1: "failed", 2: "done", 3: "cancelled", 4: "done"}
    assert {r.visitor_id: r.active for r in J.active_jobs(jobs).collect()} == {"v": 2, "w": 1}
    after = {r.job_id: r.status for r in J.recovered(J.cancelled(J.cancelled(jobs, 1, "v"), 4, "v")).collect()}
    assert after == {1: "cancelled", 2: "failed", 3: "done", 4: "failed"} and J.within_limit(jobs, 2).where("may_start").first().visitor_id == "w"


def test_incremental_and_copies(spark):
    sources = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "rel string, mtime long")
    outputs = spark.createDataFrame([("a", 5), ("b", 4)], "rel string, mtime long")
    assert sorted(r.rel for r in J.up_to_date(sources, outputs).collect()) == ["b", "c"]
    files = spark.createDataFrame([("x/img/a",), ("img/b/c",), ("x/a",), ("one",)], "rel string")
    assert sorted(r.rel for r in J.copies(files, ["img", "one"]).collect()) == ["img/b/c", "one", "x/img/a"]
    docs = spark.createDataFrame([(0, "scan"), (1, "digital"), (2, None), (3, "digital")], "n int, kind string")
    assert [r.n for r in J.scan_last(docs, "n").collect()] == [1, 3, 0, 2]


def test_document_json(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"source": "s", "pages": [{"number": 0, "width": 612, "height": 792, "paragraphs": [{"text": "t", "size": 11}, {"text": "u", "align": "center", "starts_item": true, "clip": {"x0": 1, "y0": 2, "x1": 3, "y1": 4}}]}]}')
    rows = S.read_documents(spark, str(tmp_path))
    a, b = rows.orderBy("para_no").collect()
    assert (a.text, a.align, a.starts_item, a.indent, list(a.color), a.runs, a.clip) == ("t", "left", False, 0.0, [0.0] * 3, [], None) and (b.align, b.starts_item, b.clip.x1) == ("center", True, 3.0)
    back = S.paragraphs(S.to_documents(rows))
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    composed = spark.createDataFrame([("é",), (None,)], "t string").select(S.composed("t")).collect()
    assert [r[0] for r in composed] == ["é", None]


def test_configuration(spark, tmp_path):
    (tmp_path / "c.toml").write_text('schema_version = 1\n[paths]\nout = "o"\nroot = "/r"\n[t]\nlist = [1]\nb = 2\n')
    config = G.load_config(tmp_path / "c.toml", {"t": {"list": [1, 2], "a": 1}})
    assert config["t"] == {"list": [1], "a": 1, "b": 2} and config["paths"] == {"out": str(tmp_path / "o"), "root": "/r"}
    (tmp_path / "c.toml").write_text("schema_version = 9\n")
    with pytest.raises(ValueError, match="version 9"):
        G.load_config(tmp_path / "c.toml")
    G.save_roster(tmp_path / "e.toml", {"companies": ['A "B"'], "people": ["P"]})
    assert sorted(map(tuple, G.load_roster(spark, tmp_path / "e.toml").collect())) == [('A "B"', "companies"), ("P", "people")]
    assert G.load_roster(spark, tmp_path / "none.toml").count() == 0
    (tmp_path / "m.toml").write_text('[pdf]\n"a.pdf" = "b.pdf"\n[copy_as_is]\nfiles = ["x"]\n')
    assert sorted(map(tuple, G.load_document_map(spark, tmp_path / "m.toml").collect())) == [("copy", "x", "x"), ("pdf", "a.pdf", "b.pdf")]
