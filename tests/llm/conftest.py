import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Makes a documents table of (doc_id, text) or (doc_id, text, lang, source) rows."""

    def make(rows):
        return spark.createDataFrame([(*r, *(None, None)[len(r) - 2 :], None) for r in rows], DOCUMENTS)

    return make


@pytest.fixture
def clashing(spark):
    """Adds columns that are named like an operator's results or working columns."""

    def add(df):
        from pyspark.sql import functions as F

        names = "keep_id kept size target taken fingerprint component_id score held_out lang_pred n_tokens digest salt key bucket word gram row payload last page_no a b h texts".split()
        return df.select("*", *(F.lit("x").alias(n) for n in names if n not in df.columns))

    return add
