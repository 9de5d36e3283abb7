"""The pipeline's stages against plain versions of the same steps, each on its own input."""

from collections import Counter

import pytest

import corpus_pipeline
from quire.llm import decontaminate, language_id, mixing, packing, simhash
from quire.llm.common import staged

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(staged(stage(spark, out[-1], SF), name))
    return out


def test_stages(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language-id", "simhash", "decontamination", "mixing", "token-ids"]
    assert all(df.columns == steps[0].columns for df in steps[:5])


def test_language_stage_keeps_clean_documents(steps):
    before, after = ({r.doc_id for r in df.collect()} for df in steps[:2])
    assert after <= before and len(after) >= 0.99 * len(before)


def test_near_duplicates_stage(steps):
    """Of texts that are linked by a similarity of 0.8 one stays; what goes has that similarity to one that stays or went."""
    before = {r.doc_id: r.text for r in steps[1].collect()}
    after = {r.doc_id for r in steps[2].collect()}
    group = {d: d for d in before}

    def find(d):
        while group[d] != d:
            d = group[d]
        return d

    shingles = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in ((d, (t or "").lower().split()) for d, t in before.items())}
    gone = set(before) - after
    ids = sorted(before)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
                x, y = sorted((find(a), find(b)))
                group[y] = x
    kept = [find(d) for d in after]
    assert len(kept) == len(set(kept)) and gone
    assert set(kept) == {find(d) for d in before}
    for d in gone:
        assert max(len(shingles[d] & shingles[o]) / len(shingles[d] | shingles[o]) for o in before if o != d) >= 0.8


def test_decontamination_stage(spark, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    matcher = decontaminate.Matcher(items)
    want = [r.doc_id for r in steps[2].collect() if not matcher.matches(r.text)]
    got = [r.doc_id for r in steps[3].collect()]
    assert sorted(got) == sorted(want)
    passages = [decontaminate.normal(t) for _, t in items]
    assert not [r for r in steps[3].collect() if any(p in decontaminate.normal(r.text) for p in passages)]


def test_mixing_stage(steps):
    """Each use that the plan takes at least half of is there as a whole text, and no other."""
    want = Counter()
    for r in mixing.mix(steps[3]).collect():
        first = min(r.taken, r.size)
        want[r.doc_id] += sum(take > 0 and 2 * take >= r.size for take in (first, r.taken - first))
    assert Counter(r.doc_id for r in steps[4].collect()) == +want
    texts = {r.doc_id: r.text for r in steps[3].collect()}
    assert all(r.text == texts[r.doc_id] for r in steps[4].collect())


def test_token_stage(steps):
    copies = Counter(r.doc_id for r in steps[4].collect())
    seen = Counter(d for p in steps[5].collect() for d, s in zip(p.doc_ids, p.segments, strict=True) if s == 0)
    assert seen == copies


def test_run(spark, steps):
    assert corpus_pipeline.run(spark, SF).count() == steps[5].count()


def test_stages_on_an_empty_table(spark, steps):
    docs = steps[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), "empty")
    assert docs.count() == 0


def test_language_stage_rejects(documents):
    rows = [(i, "the of and " * 9, "en", "s") for i in range(8)] + [(100 + i, "der und das " * 9, "de", "s") for i in range(8)] + [(50, None, None, "s"), (51, "123 ###", None, "s")]
    kept = language_id.with_known_language(documents(rows), corpus_pipeline.LEAST_LANGUAGE_SCORE, language_id.Settings(steps=80))
    assert {r.doc_id for r in kept.collect()} == {d for d, *_ in rows} - {50, 51}


def test_modules_are_the_operators():
    assert all(m.__name__.startswith("quire.llm.") for m in (decontaminate, language_id, mixing, packing, simhash))
