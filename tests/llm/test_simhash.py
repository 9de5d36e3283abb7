import random

import numpy as np
import pytest
import xxhash

from quire.llm import simhash
from quire.llm.graph import connected_components


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, prints, radius=2):
    label = {f: min((i for i, g in zip(ids, prints, strict=True) if g == f and i is not None), default=None) for f in set(prints)}
    group = {f: {f} for f in label}
    for a in label:
        for b in label:
            if (a ^ b).bit_count() <= radius and group[a] is not group[b]:
                group[a] |= group[b]
                for f in group[b]:
                    group[f] = group[a]
    return [min((label[g] for g in group[f] if label[g] is not None), default=None) for f in prints]


def near(value, flips, rng):
    for bit in rng.sample(range(64), flips):
        value ^= 1 << bit
    return value


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_bk_tree_finds_all_links(radius):
    rng = random.Random(radius)
    seeds = [rng.getrandbits(64) for _ in range(8)]
    values = np.unique(np.array([near(rng.choice(seeds), rng.randint(0, 5), rng) for _ in range(300)], np.uint64))
    found = {frozenset((int(a), int(b))) for qs, ns in simhash.BKTree(values).links(radius, 64) for a, b in zip(qs, ns, strict=True)}
    want = {frozenset((i, j)) for i in range(len(values)) for j in range(i) if (int(values[i]) ^ int(values[j])).bit_count() <= radius}
    assert found == want


def test_shard_keys_hold_every_link():
    rng = random.Random(4)
    masks = simhash.shard_keys(8, 2)
    assert len(masks) == 28
    for _ in range(300):
        a = rng.getrandbits(64)
        b = near(a, rng.randint(0, 2), rng)
        assert any(a & m == b & m for m in masks)


def test_links_span_the_components(spark):
    rng = random.Random(9)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    prints = sorted({near(rng.choice(seeds), rng.randint(0, 4), rng) for _ in range(400)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fingerprint long"))
    got = {r.node: r.component for r in connected_components(links).collect()}
    same = lambda p: got.get(p, p)
    want = components(range(len(prints)), prints)
    assert len({(same(s), w) for s, w in zip(signed, want, strict=True)}) == len(set(want)) == len({same(s) for s in signed})


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)] + [(300, 300), (None, 5), (7, 3)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 180)) and 300 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for i in range(40):
        words = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 8, 120, 400]))
        for _ in range(rng.choice([1, 1, 3])):
            copy = list(words)
            if len(copy) > 100:
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    return [*out, None, "", " \n", "ONE Two", "one\ttwo", "x " * 50_000, out[0]]


def test_brute_force(documents, clashing):
    rows = [(100 - i, t) for i, t in enumerate(texts())] + [(None, "one two"), (None, "unlike any other text"), (3, "repeated row here"), (3, "repeated row here")]
    got = simhash.near_dedup(clashing(documents(rows))).collect()
    prints = [slow_fingerprint(t) for _, t in rows]
    want = [(i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, components([i for i, _ in rows], prints), strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert len({c for *_, c in want}) < len(rows) - 5


def jaccard(a, b, n=5):
    x, y = ({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in ((t or "").lower().split() for t in (a, b)))
    return len(x & y) / len(x | y)


def near_copies():
    """Originals and copies with one word changed (similarity of 0.9 and more), and texts that share a passage of 60 words."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    passage = [word() for _ in range(60)]
    rows, groups = [], []
    for i in range(40):
        words = [word() for _ in range(rng.choice([120, 300]))]
        copies = [words]
        for _ in range(3):
            copy = list(words)
            copy[rng.randrange(len(copy))] = word()
            copies.append(copy)
        groups.append([])
        for copy in copies:
            groups[-1].append(len(rows))
            rows.append((len(rows), " ".join(copy)))
    alone = len(rows)
    for _ in range(20):
        rows.append((len(rows), " ".join([word() for _ in range(80)] + passage + [word() for _ in range(80)])))
    return rows, groups, alone


def test_near_copies_are_found_and_clean_texts_left_alone(documents):
    rows, groups, alone = near_copies()
    assert all(jaccard(rows[g[0]][1], rows[m][1]) >= 0.8 for g in groups for m in g)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(documents(rows)).collect()}
    for group in groups:
        assert {got[m] for m in group} == {group[0]}
    assert all(got[i] == i for i in range(alone, len(rows)))


def test_a_repeated_line_does_not_merge_texts(documents):
    rng = random.Random(2)
    own = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(120))
    rows = [(i, "one very common line of words here again now\n" * 100 + own()) for i in range(12)]
    rows.append((12, rows[3][1]))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(documents(rows)).collect()}
    assert got == {i: i for i in range(12)} | {12: 3}


def test_links_have_the_stated_similarity(documents):
    """Of 40 pairs each of similarity about 0.7, 0.78 and 0.83, those from 0.8 on are linked and no others."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows = []
    for changed in (70, 50, 36):
        for _ in range(40):
            words = [word() for _ in range(400)]
            rows.append((len(rows), " ".join(words)))
            rows.append((len(rows), " ".join(words[:-changed] + [word() for _ in range(changed)])))
    near = [jaccard(rows[i][1], rows[i + 1][1]) for i in range(0, len(rows), 2)]
    assert min(near) > 0.65 and sum(s < 0.8 for s in near) == 80
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(documents(rows)).collect()}
    linked = [got[i + 1] == i for i in range(0, len(rows), 2)]
    assert not any(linked[:80]) and sum(linked[80:]) >= 39


@pytest.mark.parametrize("least", [0.5, 0.8])
def test_exact_forest_equals_all_pairs(least):
    rng = random.Random(6)
    seeds = [rng.sample(range(1000), 30) for _ in range(6)]
    sets = [np.unique(np.array([*rng.sample(rng.choice(seeds), rng.randint(22, 30)), *rng.sample(range(1000), 2)], np.uint64)) for _ in range(80)] + [np.empty(0, np.uint64)]
    got = simhash.exact_forest(sets, np.zeros((len(sets), simhash.BANDS), np.int64), least)
    group = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(np.intersect1d(a, b))
            if both and both >= least * (len(a) + len(b) - both):
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    assert got.tolist() == group and 1 < len(set(group)) < len(sets)


def test_large_shards_are_cut_without_losing_links(documents, monkeypatch):
    rows, groups, _ = near_copies()
    docs = documents(rows)
    whole = sorted(map(tuple, simhash.similar_groups(docs).select("doc_id", "component_id").collect()))
    monkeypatch.setattr(simhash, "SHARD_MEMBERS", 2)
    monkeypatch.setattr(simhash, "VERIFIED_MEMBERS", 2)
    assert sorted(map(tuple, simhash.similar_groups(docs).select("doc_id", "component_id").collect())) == whole


def test_pairs_of_parts_are_dealt_by_an_exchange_of_their_own(documents):
    distinct = simhash._nodes(simhash._documents(documents(near_copies()[0]), simhash.Similarity()))
    plan = simhash.candidate_links(distinct, simhash.Similarity())._jdf.queryExecution().executedPlan().toString()
    exchange = next(line for line in plan.splitlines() if "low" in line and "Exchange hashpartitioning(band" in line)
    assert "REPARTITION_BY_NUM" in exchange
    assert plan.index(exchange) < plan.index("Generate explode")


def test_texts_that_share_a_repeated_word_stay(documents):
    rng = random.Random(12)
    rows = [(i, "word " * 900 + " ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(300))) for i in range(8)]
    assert simhash.one_of_each_group(documents(rows)).count() == 8


def test_an_input_column_like_a_working_one_is_carried(documents):
    from pyspark.sql import functions as F

    docs = documents([(1, "a b c"), (2, "a b c"), (3, "x y z")])
    for name in ("__id__", "__digest__", "digest", "may", "node", "rows"):
        docs = docs.withColumn(name, F.lit(name))
    got = simhash.one_of_each_group(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [1, 3]


def test_forest_of_a_dense_shard_equals_all_links():
    rng = random.Random(3)
    for spread in (3, 9):
        seeds = [rng.getrandbits(64) for _ in range(3)]
        values = np.unique(np.array([near(rng.choice(seeds), rng.randint(0, spread), rng) for _ in range(250)], np.uint64)).astype(np.int64)
        tied, root = simhash.shard_forest(values, 4)
        got = dict(zip(tied.tolist(), root.tolist(), strict=True))
        want = components([int(v) for v in values], [int(v) % (1 << 64) for v in values], 4)
        assert [got.get(int(v), int(v)) for v in values] == want


def test_one_of_each_group(documents, clashing):
    rows = [(4, "a b c d"), (2, "A B C D"), (9, "other words are here"), (9, "other words are here"), (None, "only null"), (None, "only null"), (6, None), (5, "")]
    docs = clashing(documents(rows))
    got = simhash.one_of_each_group(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0 for r in got.collect())) == [0, 2, 5, 9]
    assert simhash.one_of_each_group(documents([])).collect() == []


def test_rows_without_an_id_or_with_a_shared_one_are_documents(documents):
    rng = random.Random(7)
    own = [" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(80)) for _ in range(9)]
    rows = [(None, t) for t in own[:4]] + [(5, own[4]), (5, own[5]), (5, own[5]), (8, own[6]), (None, own[6] + " more"), (None, own[0]), (7, own[4]), (9, None), (None, "")]
    got = sorted(((r.doc_id, r.text) for r in simhash.one_of_each_group(documents(rows)).collect()), key=str)
    assert got == sorted([(None, t) for t in own[:4]] + [(5, own[4]), (5, own[5]), (8, own[6]), (9, None)], key=str)


def test_empty_table(documents):
    assert simhash.near_dedup(documents([])).collect() == []
