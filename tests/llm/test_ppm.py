import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quire.llm import ppm

TEXTS = ["the cat sat on the mat", "The dog sat", "", None, "on the other hand, the hat", "zzz 12 é", "the " * 300, "w" * 100 + " long", "the cat sat on the mat"]


def plain_ppm(training, order):
    """Prediction by partial matching as it is defined, context by context."""
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    for text in training:
        stream = bytes([ppm.PAD]) * order + text.encode().lower() + bytes([ppm.END])
        for i in range(order, len(stream)):
            for j in range(order + 1):
                counts[j][stream[i - j : i]][stream[i]] += 1

    def probability(context, symbol):
        p, excluded = 1.0, set()
        for j in range(order, -1, -1):
            known = counts[j].get(context[order - j :])
            if not known:
                continue
            left = {s: c for s, c in known.items() if s not in excluded}
            total, different = sum(left.values()), len(left)
            if symbol in left:
                return p * left[symbol] / (total + different)
            if total + different:
                p *= different / (total + different)
            excluded |= set(known)
        return p / (ppm.SYMBOLS - len(counts[0][b""]))

    def score(text):
        stream = bytes([ppm.PAD]) * order + text.encode().lower() + bytes([ppm.END])
        return sum(math.log10(probability(stream[i - order : i], stream[i])) for i in range(order, len(stream)))

    return score


def held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 5 == 1


def expected(rows, order):
    training = [t or "" for d, t in rows if not held(d)]
    counts = Counter(w for t in training for w in t.encode().lower().split())
    total = sum(counts.values()) + len(training)
    divisor = total + 0.5 * (len(counts) + bool(training) + 1)
    model = plain_ppm(training, order)
    out = []
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        known = [counts[w] for w in words] + [len(training)]
        base = sum(math.log10((c + 0.5) / divisor) for c in known)
        out.append((doc, held(doc), len(known), sum(c > 0 for c in known), total, base, model(text or "")))
    return out


@pytest.mark.parametrize("order", [1, 3, 5])
def test_brute_force(documents, clashing, order):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(30)] + [(None, "the cat"), (77, "a rare word x" + "y" * 90), (78, "a rare word x" + "y" * 90)]
    got = ppm.score_texts(clashing(documents(rows)), ppm.Settings(order=order, words=4)).collect()
    want = expected(rows, order)
    for a, b in zip(sorted(map(tuple, got), key=lambda r: str(r[:4])), sorted(want, key=lambda r: str(r[:4])), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-5)


def trie(training, order, least=1):
    codes, counts = np.unique(ppm.gram_codes([t.encode().lower() for t in training], order), return_counts=True)
    levels = []
    for j in range(order + 1):
        own, place = np.unique(codes & ppm.mask(j + 1), return_inverse=True)
        n = np.bincount(place, weights=counts).astype(np.int64)
        levels.append((own[n >= least], n[n >= least]))
    return ppm.Trie(levels, len(training))


@pytest.mark.parametrize("least", [1, 2, 3])
def test_probabilities_of_a_context_add_up(least):
    random.seed(1)
    training = ["".join(random.choices("abcde ", k=60)) for _ in range(40)] + ["the rest"] * 3
    model = trie(training, 4, least)
    for context in [bytes([ppm.PAD]) * 4, b"abcd", b"zzzz", b"e ab", bytes([ppm.PAD]) * 3 + b"t", b" the"]:
        base = int.from_bytes(context, "big")
        codes = np.array([(base << 8) | s for s in range(256) if s != ppm.PAD], np.uint64)
        assert (10.0 ** model.log10_probability(codes).astype(float)).sum() == pytest.approx(1, abs=2e-3)


def test_threshold(spark):
    counts = spark.createDataFrame([(n,) for n in [1] * 50 + [2] * 20 + [7] * 5 + [9000] * 3], "n long")
    assert [ppm.threshold(counts, most) for most in (100, 78, 77, 28, 8, 7, 3)] == [1, 1, 2, 2, 3, 8, 8]
    assert counts.where(counts.n >= ppm.threshold(counts, 2)).count() <= 2


def test_pruned_trie_and_joined_words_are_bounded(documents):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(40)]
    full = {r.doc_id: r for r in ppm.score_texts(documents(rows)).collect()}
    small = {r.doc_id: r for r in ppm.score_texts(documents(rows), ppm.Settings(nodes=60, words=1)).collect()}
    for doc, r in small.items():
        assert r.base_score == pytest.approx(full[doc].base_score) and r.n_known == full[doc].n_known and math.isfinite(r.score)


def test_scores_do_not_depend_on_the_bounds(documents, monkeypatch):
    random.seed(4)
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(40)] + [(40 + i, "".join(random.choices("abcdefg é", k=80))) for i in range(40)]
    want = {r[0]: r[-1] for r in expected(rows, 5)}
    monkeypatch.setattr(ppm, "CHUNK_GRAMS", 100, raising=False)
    monkeypatch.setattr(ppm, "GRAMS_IN_ROW", 7, raising=False)
    got = {r.doc_id: r.score for r in ppm.score_texts(documents(rows).repartition(3), ppm.Settings(nodes=600, words=1)).collect()}
    assert got == pytest.approx(want, rel=1e-5)


def test_empty_and_untrained(documents):
    assert ppm.score_texts(documents([])).collect() == []
    only = next(i for i in range(100) if held(i))
    (row,) = ppm.score_texts(documents([(only, "ab")])).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (2, 0, 0) and row.score == pytest.approx(-3 * math.log10(ppm.SYMBOLS), rel=1e-5)
