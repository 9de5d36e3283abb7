import re

import pytest

from quire.llm import mixing


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes):
    """Reshares the excess over twice a source's size, by weight, until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    fixed, left = {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 2 * sizes[s]] if free else []
        if not over:
            return fixed | {s: left * weight[s] / total for s in free}
        for s in over:
            fixed[s] = 2.0 * sizes[s]
        left -= sum(2.0 * sizes[s] for s in over)


ROWS = [(i, "w " * (i % 40 + 1), "en", f"s{i % 5}") for i in range(200)] + [
    (500, None, "en", "s1"), (501, " \t\n", "en", None), (502, "a b c", "en", None), (503, "a b c", "en", None), (503, "a b c", "en", None), (None, "a b", "en", "s2"), (600, "long " * 20_000, "en", "s3"),
]


def test_targets_and_takes(documents, clashing):
    got = mixing.mix(clashing(documents(ROWS))).collect()
    assert len(got) == len(ROWS)
    sizes = {}
    for _, text, _, source in ROWS:
        sizes[source] = sizes.get(source, 0) + words(text)
    want = targets(sizes)
    assert sorted({(r.source_size, round(r.target, 6)) for r in got}) == sorted({(sizes[s], round(want[s], 6)) for s in sizes})
    taken = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.target] = taken.get(r.target, 0) + r.taken
    for target, total in taken.items():
        assert abs(total - target) <= 1
    places = [r.position for r in got]
    known = [p for p in places if p is not None]
    assert known == sorted(known) and places[: len(known)] == known and all(0 <= p <= 1 for p in known)


def test_reruns_and_partitions_agree(documents):
    docs = documents(ROWS)
    a = sorted(map(tuple, mixing.mix(docs.repartition(1)).collect()), key=str)
    b = sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)
    assert a == b


def test_small_buckets_give_the_same_places(documents, monkeypatch):
    docs = documents(ROWS)
    a = sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)
    assert a == sorted(map(tuple, mixing.mix(docs).collect()), key=str)


@pytest.mark.parametrize("weights", [(1.0, 1.0, 1.0), (1.5, 1.0, 0.5), (0.5, 1.0, 1.5), (2.0, 0.25, 1.0, 3.0)])
def test_position_inverts_the_integral(spark, weights):
    from pyspark.sql import functions as F

    shares = spark.createDataFrame([(i / 50,) for i in range(51)], "share double")
    got = shares.select("share", mixing._position(F.col("share"), F.lit(0), [weights]).alias("at")).collect()
    steps = 20_000

    def weight(t):
        i = min(int(t * (len(weights) - 1)), len(weights) - 2)
        return weights[i] + (weights[i + 1] - weights[i]) * (t * (len(weights) - 1) - i)

    whole = sum(weight((k + 0.5) / steps) for k in range(steps))
    for share, at in got:
        part = sum(weight((k + 0.5) / steps) for k in range(round(at * steps)))
        assert part / whole == pytest.approx(share, abs=2e-4)


def test_mixed_rows(documents, clashing):
    """Whole documents only; a source misses its target by half a document at most."""
    docs = clashing(documents(ROWS))
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    texts = {r[1] for r in ROWS}
    assert all(r.text in texts for r in rows)
    sources = {r[0]: r[3] for r in ROWS}
    target, largest, taken = {}, {}, {}
    for r in mixing.mix(docs).collect():
        source = sources[r.doc_id]
        target[source], largest[source] = r.target, max(r.size, largest.get(source, 0))
    for r in rows:
        taken[r.source] = taken.get(r.source, 0) + words(r.text)
    assert all(abs(taken.get(s, 0) - t) <= largest[s] / 2 + 1 for s, t in target.items())
    assert mixing.mixed(documents([])).collect() == []


def test_rows_without_ids_are_spread_over_buckets(spark, documents):
    docs = documents([(None, f"text number {i}", None, "one") for i in range(600)])
    keys = mixing.sized(docs).select("key").distinct().count()
    assert keys == 600


def test_empty_table(documents):
    assert mixing.mix(documents([])).collect() == []
