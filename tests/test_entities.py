import pytest
from pyspark.sql import functions as F

from quire.operators import entities as E

ROSTER = ["Grupo Aurora, SRL.", "Grupo Peñasco", "Banco Litoral", "CCI", "MICM"]


def protected(spark, *texts, roster=ROSTER):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    marked, tokens = E.protect(F.col("t"), E.protect_pattern(roster))
    return [tuple(r) for r in df.select(marked, tokens).collect()]


def test_protect(spark):
    got = protected(spark, "Pago RD$1,250.50 y US$400 a GRUPO AURORA, SRL. el 37", "La reducción y contracción", "grupo penasco y Grupo Peñasco.", "CCI, (CCI) xCCI")
    assert got[0] == ("Pago [[0]] y [[1]] a [[2]] el [[3]]", ["RD$1,250.50", "US$400", "GRUPO AURORA, SRL.", "37"])
    assert got[1] == ("La reducción y contracción", [])
    assert got[2] == ("[[0]] y [[1]].", ["grupo penasco", "Grupo Peñasco"]) and got[3][1] == ["CCI", "CCI"]
    assert protected(spark, "CCI 12", roster=[]) == [("CCI [[0]]", ["12"])]


def test_restore(spark):
    df = spark.createDataFrame([("a [[0]] [[ 1 ]]", ["$5", "x"]), ("[[9]] [[ 9 ]]", []), (None, ["x"]), ("[[99999999999]]", ["x"])], "t string, k array<string>")
    got = [r[0] for r in df.select(E.restore(F.col("t"), F.col("k"))).collect()]
    assert got == ["a $5 x", "[[9]] [[ 9 ]]", None, "[[99999999999]]"]
    done = df.select(E.all_restored(F.col("t"))).collect()
    assert [r[0] for r in done] == [False, False, True, False]


@pytest.mark.parametrize(("text", "skip"), [("GRUPO", True), (" grupo. ", True), ("Grupo,", True), ("Peñasco", True), ("SRL", True), ("MICM", True), ("micm y CCI", True), ("Banco Litoral paga", False), ("otro", False), ("", False), ("el Grupo Peñasco de", True), ("el Grupo Peñasco dos", False)])
def test_guard(spark, text, skip):
    assert spark.createDataFrame([(text,)], "t string").select(E.is_guarded(F.col("t"), ROSTER)).first()[0] is skip


def test_fragments_agree(spark):
    df = spark.createDataFrame([(e,) for e in ROSTER], "entity string")
    assert sorted(r[0] for r in E.name_fragments(df).collect()) == E.fragment_words(ROSTER) == ["AURORA", "BANCO", "GRUPO", "LITORAL", "PENASCO", "SRL"]


@pytest.mark.parametrize(
    ("source", "en", "want"),
    [("MICM paga 5", "the micm pays 5", True), ("MICM paga 5", "it pays 5", False), ("5 y 6", "6 and 5", True), ("5 y 5", "5", False), ("Grupo Peñasco", "GRUPO PENASCO", True)],
)
def test_verification(spark, source, en, want):
    assert spark.createDataFrame([(source, en)], "a string, b string").select(E.verified(F.col("a"), F.col("b"), ROSTER)).first()[0] is want


def test_audit_and_deny_list(spark):
    cache = spark.createDataFrame([("GRUPO", "CLUSTER"), ("Grupo", "Grupo "), ("MICM", "X"), ("otro", "x"), ("banco", None)], "source string, en string")
    assert sorted(r.source for r in E.poisoned_entries(cache, ROSTER).collect()) == ["GRUPO", "banco"]
    texts = spark.createDataFrame([("El SEÑOR x",), ("nada",)], "text string")
    assert [r.terms for r in E.denied(texts, ["señor"]).collect()] == [["senor"]]
