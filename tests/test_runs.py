import struct

import pytest
from pyspark.sql import functions as F

from quire.operators import batch as A
from quire.operators import glossary as G
from quire.operators import render as D
from quire.operators import report as P
from quire.sources import documents as S
from quire.sources.fonts import face, font_index

DOCUMENTS = "src string, kind string, mtime long"


def test_plan_and_report(spark):
    documents = spark.createDataFrame([("a", "pdf", 5), ("b", "pdf", 5), ("c", "office", 5), ("d", "copy", 5), ("e", "pdf", None), ("f", "other", 1)], DOCUMENTS)
    outputs = spark.createDataFrame([("a", 5), ("a", 1), ("b", 4), ("e", 9)], "src string, mtime long")
    results = spark.createDataFrame([("a", "unused", []), ("b", "broken", []), ("c", None, ["y", "x"]), ("d", None, None)], "src string, error string, lost_parts array<string>")
    report = A.corpus_report(A.plan(documents, outputs), results)
    got = {r.src: (r.status, r.error) for r in report.collect()}
    assert got == {"a": ("skipped", None), "b": ("ERROR", "broken"), "c": ("ok", "LOST PARTS: x, y"), "d": ("copied", None), "e": ("ERROR", "no result")}
    assert {r.src for r in A.errors(report).collect()} == {"b", "c", "e"}
    assert {r.src for r in A.plan(documents, outputs, "pdf", force=True).where("due").collect()} == {"a", "b", "e"}
    with pytest.raises(ValueError, match="only must be one of"):
        A.plan(documents, outputs, "pdfs")
    assert A.corpus_report(A.plan(documents.limit(0), outputs), results).count() == 0


def test_full_report(spark):
    parts = spark.createDataFrame([(1, 0, "a", "backend", "ok"), (1, 1, "b", "protected", "ok"), (2, 0, "c", "backend", "failed")], "doc_id long, page_no int, unit string, via string, status string")
    drawn = spark.createDataFrame([(1, 0, 1, "x" * 100, True, True), (1, 0, 0, "y", True, False)], "doc_id long, page_no int, place int, text string, scaled boolean, overflow boolean")
    kinds = spark.createDataFrame([(1, "ocr"), (2, "digital")], "doc_id long, kind string")
    fonts = spark.createDataFrame([(1, "Foo", "arial", True), (1, "Foo", "arial", True), (1, "Arial", "arial", False)], "doc_id long, font string, resolved string, substituted boolean")
    one, two = P.full_report(parts, drawn, kinds, fonts, ["doc_id"]).orderBy("doc_id").collect()
    assert (one.translated, one.skipped, one.scaled, one.overflow, one.inpainted, one.font_substitutions) == (1, 1, 2, 1, 2, {"Foo": "arial"})
    assert [(d.page, d.text) for d in one.overflow_detail] == [(1, "x" * 90)]
    assert (two.failed, two.scaled, two.overflow, two.inpainted, two.overflow_detail, two.font_substitutions) == (1, 0, 0, 0, None, None)


def test_edits(spark):
    row = spark.createDataFrame([(10.0, 20.0, 30.0, 40.0, 10.0)], "x0 double, y0 double, x1 double, y1 double, size double")
    got = D.clear_rects(row).first()
    assert (got.clear_x0, got.clear_y0, got.clear_x1) == (9.25, 12.0, 30.75) and got.clear_y1 == pytest.approx(42.2)
    held = row.select(D.kept_runs(F.array(F.struct(F.lit("a").alias("text")), F.struct(F.lit(" \t").alias("text")))).alias("runs"), F.struct("*").alias("own"))
    edit = F.struct(F.lit(None).cast("double").alias("x0"), F.lit(1.0).alias("y0"), F.lit(None).cast("double").alias("x1"), F.lit(2.0).alias("y1"))
    got = held.select("runs", D.edited_rect(edit, F.col("own")).alias("r")).first()
    assert [r.text for r in got.runs] == ["a"] and tuple(got.r) == (10.0, 1.0, 30.0, 2.0)


def test_domains(spark, tmp_path):
    for name, amount in (("legal", "Sum"), ("works", "Amount")):
        (tmp_path / f"{name}.toml").write_text(f'[terms]\n"Monto" = "{amount}"\n')
    assert G.available_domains(tmp_path) == ["legal", "works"]
    row = G.merge_glossary(G.load_domains(spark, tmp_path, ["works", "legal"])).first()
    assert (row.translation, row.collision) == ("Sum", True)
    with pytest.raises(ValueError, match="unknown glossary domain food; there are: legal, works"):
        G.load_domains(spark, tmp_path, ["food"])


def test_marked_pages(spark):
    pages = spark.range(4).withColumnRenamed("id", "page_no")
    assert [r.selected for r in S.marked_pages(pages, "2, 4").orderBy("page_no").collect()] == [False, True, False, True]
    assert S.marked_pages(pages, None).where("selected").count() == 4


def font(names, style=0, collection=False, tables=("head", "name")):
    """A font file that holds nothing but its names (platform, language, kind, text) and style bits."""
    start = 16 if collection else 0
    head = bytes(44) + struct.pack(">H", style) + bytes(8)
    texts = [text.encode("utf-16-be" if platform == 3 else "latin-1") for platform, _, _, text in names]
    records, at = b"", 0
    for (platform, language, kind, _), text in zip(names, texts, strict=True):
        records += struct.pack(">6H", platform, 1, language, kind, len(text), at)
        at += len(text)
    body = {"head": head, "name": struct.pack(">3H", 0, len(names), 6 + len(records)) + records + b"".join(texts)}
    out = (b"ttcf" + struct.pack(">3I", 1, 1, start)[:8] + struct.pack(">I", start)) if collection else b""
    out += struct.pack(">I4H", 0x10000, len(tables), 0, 0, 0)
    at = len(out) + 16 * len(tables)
    for table in tables:
        out += table.encode() + struct.pack(">3I", 0, at, len(body[table]))
        at += len(body[table])
    return out + b"".join(body[table] for table in tables)


def test_face():
    names = [(1, 0, 1, "Mac"), (3, 0x40C, 1, "Français"), (3, 0x409, 2, "Bold"), (3, 0x409, 1, "English "), (3, 0x409, 1, "Other")]
    assert face(font(names, 3)) == ("English", True, True) == face(font(names, 3, collection=True))
    assert face(font(names[:2], 2)) == ("Français", False, True) and face(font(names[:1])) == ("Mac", False, False)
    assert face(font([(3, 0x409, 1, "")], 1)) == (None, True, False) and face(font(names, 1, tables=("head",))) == (None, True, False)
    whole = font(names)
    assert face(b"") == (None, False, False) and all(len(face(whole[:cut])) == 3 for cut in range(len(whole)))


def test_font_index(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
    files = {"one/z.ttf": font([(3, 0x409, 1, "Foo")]), "one/a.otf": font([(3, 0x409, 1, "foo")]), "two/a.ttf": font([(3, 0x409, 1, "FOO")]), "two/b.ttc": font([(3, 0x409, 1, "Foo")], 1, collection=True), "two/bad.ttf": b"no font", "two/c.txt": font([(3, 0x409, 1, "Text")])}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {(r.family, r.bold, r.italic, r.path.split("/", 1)[1].split(tmp_path.name + "/")[1]) for r in font_index(spark, [str(tmp_path / n) for n in ("one", "two")]).collect()}
    assert got == {("foo", False, False, "one/z.ttf"), ("foo", True, False, "two/b.ttc")}
    assert font_index(spark, []).count() == 0
    resolved = D.resolve_fonts(spark.createDataFrame([("Foo-Bold",)], "font string"), font_index(spark, [str(tmp_path / "two")]), font_index(spark, []))
    assert resolved.first().path.endswith("two/b.ttc")
