import hashlib

from pyspark.sql import functions as F

from quire.llm.exact_dedup import exact_dedup

ROWS = [(1, "a"), (5, "a"), (3, "b"), (4, None), (2, ""), (None, "a"), (None, "z"), (7, "c"), (7, "c"), (8, "x" * 300_000), (9, "x" * 300_000), (10, "A")]


def expected(rows):
    out = []
    for doc, text in rows:
        same = [d for d, t in rows if (t or "") == (text or "")]
        keep = max((d for d in same if d is not None), default=None)
        out.append((doc, keep, len(same), doc == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_brute_force(documents, clashing):
    assert found(exact_dedup(clashing(documents(ROWS)))) == expected(ROWS)


def test_collided_digests_compare_whole_texts(documents):
    digest = lambda text: F.length(text).cast("string")
    got = [r[:4] for r in found(exact_dedup(documents(ROWS), digest=digest))]
    assert sorted(got, key=str) == sorted((r[:4] for r in expected(ROWS)), key=str)


def test_result_does_not_depend_on_partitions(documents):
    docs = documents(ROWS * 3)
    assert found(exact_dedup(docs.repartition(1))) == found(exact_dedup(docs.repartition(9), salts=2)) == expected(ROWS * 3)


def test_empty_table(documents):
    df = exact_dedup(documents([]))
    assert df.collect() == [] and df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
