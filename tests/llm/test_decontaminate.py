import random

import pytest

from quire.llm.decontaminate import Matcher, contaminated, cut, myers, normal, pattern_masks, within_one, without_contaminated


def least_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i] + [0] * len(text)
        for j, d in enumerate(text, 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d))
        row = new
    return min(row)


def edited(text, edits, rng):
    chars = list(text)
    for _ in range(edits):
        at = rng.randrange(len(chars))
        kind = rng.choice("sid")
        if kind == "d":
            del chars[at]
        else:
            chars[at : at + (kind == "s")] = rng.choice("abcdefg")
    return "".join(chars)


def test_myers():
    rng = random.Random(1)
    for _ in range(800):
        pattern = "".join(rng.choices("abc", k=rng.randint(1, 90 if rng.random() < 0.1 else 10)))
        text = "".join(rng.choices("abc", k=rng.randint(1, 60)))
        assert myers(pattern_masks(pattern), len(pattern), text, len(pattern))[0] == least_distance(pattern, text)


def test_pieces_and_partners():
    assert [p for _, p in cut("abcdefghij", 3)] == ["ab", "cde", "fg", "hij"]
    for piece, text, near in [("abcd", "abcd", True), ("abcd", "abxd", True), ("abcd", "acd", True), ("abcd", "abxcd", True), ("abcd", "abc", True), ("abcd", "ab", False), ("abcd", "xbyd", False), ("", "x", True)]:
        assert within_one(piece, text) == near


def test_normal():
    assert normal(" ÉTÉ,\n«Le»  chat—noir! 12 ") == "été le chat noir 12" and normal(None) == normal(" \n.") == ""


ITEMS = [(i, " ".join(random.Random(i).choices("alpha beta gamma delta epsilon zeta eta theta iota kappa".split(), k=14))) for i in range(6)]


def test_matches_equal_brute_force():
    rng = random.Random(7)
    matcher = Matcher(ITEMS, 0.1)
    hits = 0
    for _ in range(250):
        doc = "lead words " + edited(rng.choice(ITEMS)[1], rng.randint(0, 14), rng) + " and a tail"
        got = {key: distance for key, distance, *_ in matcher.matches(doc)}
        want = {key: d for key, text, most in matcher.items if (d := least_distance(text, normal(doc))) <= most}
        assert got == want
        hits += len(want)
    assert hits > 100


@pytest.fixture
def benchmark(spark):
    return spark.createDataFrame([*ITEMS, (50, None), (51, " .. "), (None, ITEMS[0][1])], "item_id long, text string")


def test_query(documents, clashing, benchmark):
    rows = [(1, "x " + ITEMS[2][1].upper().replace(" ", ",\n") + " y"), (1, "clean text of other words"), (2, None), (3, ""), (None, ITEMS[4][1]), (4, ITEMS[0][1]), (5, "filler words " * 20_000 + ITEMS[5][1])]
    docs = clashing(documents(rows))
    got = contaminated(docs, benchmark).collect()
    assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == sorted([(1, 2), (None, 4), (4, 0), (4, None), (5, 5)], key=str)
    # A block of items at a time gives the same.
    assert sorted(map(str, contaminated(docs, benchmark, block_chars=100).collect())) == sorted(map(str, got))
    kept = without_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.text) for r in kept.collect() if r.text is not None) == [(1, "clean text of other words"), (3, "")]
    assert kept.count() == 3
    assert sorted(map(str, without_contaminated(docs, benchmark, block_chars=100).collect())) == sorted(map(str, kept.collect()))


def test_empty_tables(documents, benchmark, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(documents([]), benchmark).collect() == [] and contaminated(documents([(1, "a")]), none).collect() == []
    assert without_contaminated(documents([(1, "a")]), none).count() == 1


def test_planted_passages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, items).collect()}
    texts, passages = [(r.doc_id, normal(r.text)) for r in docs.collect()], [(r.item_id, normal(r.text)) for r in items.collect()]
    assert {(d, i) for d, t in texts for i, p in passages if p in t} <= got
