import random
import zlib

import numpy as np
import pytest

from quire.llm import language_id as L

WORDS = {"en": "the of and that with ing tion".split(), "de": "der und ung keit ich schön über".split(), "fr": "le des une être était que".split()}


def text(lang, n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def rows(n=90):
    return [(i, text(lang, 5 + i % 60, i), lang, "s") for i, lang in zip(range(n), list(WORDS) * n, strict=False)]


SMALL = L.Settings(window=64, filters=8, per_language=40, steps=120)


@pytest.fixture(scope="module")
def net():
    return L.train([(t, lang) for _, t, lang, _ in rows()], SMALL)


def test_learns_and_predicts_whole_texts(net):
    langs, scores = L.predict(net, [text(lang, 200, 999 + i) for i, lang in enumerate(WORDS)])
    assert langs == list(WORDS) and min(scores) > 0.8 and max(scores) <= 1
    # The end of a text counts as much as its beginning.
    mixed = text("en", 50, 1) + " " + text("de", 2000, 2)
    assert L.predict(net, [mixed])[0] == ["de"]


def test_undetermined(net):
    assert L.predict(net, [None, "", " 12 %% \n", "###"]) == (["und"] * 4, [0.0] * 4)
    nothing = L.train([], SMALL)
    assert L.predict(nothing, ["text"]) == (["und"], [0.0])


def test_pair_tables_equal_the_plain_convolution(net):
    windows = np.random.default_rng(1).integers(0, SMALL.classes, (5, 64)).astype(np.uint8)
    plain = []
    for table in net.tables:
        w = len(table)
        places = 64 - w + 1
        plain.append(sum(table[i][windows[:, i : i + places]] for i in range(w)).max(axis=1))
    assert np.allclose(net.features(windows), np.concatenate(plain, axis=1), atol=1e-5)


def test_training_reruns_agree():
    samples = [(t, lang) for _, t, lang, _ in rows(30)]
    a, b = L.train(samples, SMALL), L.train(samples[::-1], SMALL)
    assert all(np.array_equal(x, y) for x, y in zip(a.tables, b.tables, strict=True))


def test_query(documents, clashing):
    data = [*rows(), (1000, None, "en", "s"), (1001, "123", None, "s"), (None, "the of and", "en", None), (5, "und der", None, None)]
    got = L.identify(clashing(documents(data)), SMALL).collect()
    assert len(got) == len(data)
    truth = {d: lang for d, _, lang, _ in rows()}
    for r in got:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    right = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth and r.doc_id != 5]
    assert right and np.mean(right) > 0.9
    assert {r.lang_pred for r in got if r.doc_id in (1000, 1001)} == {"und"}


def test_sample_is_bounded_and_leaves_held_out_rows_alone(documents):
    settings = L.Settings(window=64, per_language=7)
    docs = documents([*rows(), (2000, "der", None, "s")])
    samples = L.labelled_sample(docs, settings)
    held = {t for d, t, _, _ in rows() if zlib.crc32(str(d).encode()) % 4 == 2}
    assert samples and len(samples) <= 3 * 7 * settings.pieces
    assert not [t for t, _ in samples if t in held] and {lang for _, lang in samples} <= set(WORDS)


def test_rows_without_ids_or_with_one_id_are_sampled_like_others(documents):
    settings = L.Settings(window=64, per_language=20)
    for doc_id in (None, 1):
        docs = documents([(doc_id, text(lang, 30, i), lang, "s") for i, lang in zip(range(600), list(WORDS) * 200, strict=False)])
        found = L.labelled_sample(docs, settings)
        assert all(10 <= sum(1 for _, got in found if got == lang) / settings.pieces <= 20 for lang in WORDS)
    same = documents([(None, "der und die", "de", "s")] * 500 + [(None, "the of and", "en", "s")] * 500)
    assert sorted(L.labelled_sample(same, settings)) == [("der und die", "de"), ("the of and", "en")]


def test_all_languages_are_learned_whatever_their_number(documents):
    docs = documents([(i, f"{'abcdefghijklmnopqrstuvwxyz'[i % 26] * 3} word {i}", f"l{i % 260:03}", "s") for i in range(2600)])
    found = L.labelled_sample(docs, L.Settings(window=64, sample=600, per_language=50))
    assert {lang for _, lang in found} == {f"l{i:03}" for i in range(260)} and len(found) <= 600 * 3
    assert L.train(found, L.Settings(window=64, filters=2, steps=1)).labels == [f"l{i:03}" for i in range(260)]


def slow_prediction(net, whole):
    """Window by window, place by place, filter by filter."""
    s = net.settings
    if not whole or not any(c.isalpha() for c in whole):
        return "und", 0.0
    data = [32 if c in b"\t\n\v\f\r" else 48 if 48 <= c <= 57 else c + 32 if 65 <= c <= 90 else c for c in whole.encode()]
    total = np.zeros(len(net.labels))
    for at in range(0, len(data), s.window):
        piece = data[at : at + s.window]
        classes = [int(net.byte_class[c]) for c in piece + [32] * (s.window - len(piece))]
        peaks = [max(sum(float(table[i, classes[p + i], f]) for i in range(len(table))) for p in range(s.window - len(table) + 1)) for table in net.tables for f in range(s.filters)]
        hidden = np.maximum(np.array(peaks) + net.bias, 0)
        raw = np.exp(hidden @ net.weights + net.offset)
        total += raw / raw.sum() * len(piece)
    return net.labels[int(total.argmax())], float(total.max() / len(data))


def test_query_equals_a_slow_network(documents):
    """The query's predictions against a plain version of the same network, on whole texts of all kinds."""
    settings = L.Settings(window=32, filters=2, widths=(2, 3), classes=16, per_language=30, steps=60)
    data = [*rows(30), (400, None, "en", "s"), (401, "", "de", "s"), (402, "12 34", None, "s"), (403, "é\tÜber THE\nOF " * 30, None, "s"), (None, "und der", None, "s"), (3, "x", "fr", "s")]
    docs = documents(data)
    net = L.train(L.labelled_sample(docs, settings), settings)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.lang_pred, round(r.score, 4)) for r in L.identify(docs, settings).collect()))
    want = []
    for d, t, *_ in data:
        lang, score = slow_prediction(net, t)
        want.append((d is None, d or 0, lang, round(score, 4)))
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    assert np.allclose([g[3] for g in got], [w[3] for w in sorted(want)], atol=1e-3)


def test_very_long_texts_are_read_to_the_end(net):
    whole = text("en", 100, 1) + " " + text("de", 150_000, 2)
    assert L.predict(net, [whole])[0] == ["de"]


def test_no_labels_and_empty_table(documents):
    assert {r.lang_pred for r in L.identify(documents([(1, "text"), (2, "der")]), SMALL).collect()} == {"und"}
    assert L.identify(documents([]), SMALL).collect() == []


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.98
