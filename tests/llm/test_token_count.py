import random

import pytest
import sentencepiece

from quire.llm.queries import tokenizer_file
from quire.llm.token_count import Splitter, count_texts, token_counts

PARTS = ["the", " of", "  ", "\n", "\n\n", "é", "😀", "▁", "\x00", "\t", "<s>", "</s>", "<0x0A>", "ononedth", "中", " ", "\r\n", "word,"]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_file())


def test_whole_tokens_encode_alone(model):
    whole = Splitter(tokenizer_file()).whole_tokens
    assert len(whole) > 10_000
    for part, token in list(whole.items())[:200]:
        if part not in (" ", "\n"):
            assert model.encode(part[1:]) == [token]


def test_counts_are_the_librarys(model):
    random.seed(3)
    texts = ["".join(random.choices(PARTS, k=random.randint(0, 40))) for _ in range(3000)] + [None, "", " ", "   ", "a" * 50_000, "x " * 40_000]
    assert count_texts(texts, tokenizer_file()) == [len(model.encode(t or "")) for t in texts]


def test_query(documents, clashing, model):
    rows = [(1, "one two"), (1, "one two"), (None, None), (2, "word " * 9000), (3, "")]
    df = token_counts(clashing(documents(rows)), tokenizer_file(), limit=4096)
    got = sorted(map(tuple, df.collect()), key=str)
    want = [(d, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for d, t in rows]
    assert got == sorted(want, key=str)
    assert token_counts(documents([]), tokenizer_file()).collect() == []


def test_a_full_table_starts_anew(monkeypatch, model):
    from quire.llm import packing, token_count

    monkeypatch.setattr(token_count, "REMEMBERED", 2000)
    # Parts that earlier blocks have learned occur again where the table starts anew.
    texts = [" ".join(f"w{i % 90}q{j} w{i}r{j}" for j in range(12)) for i in range(1500)]
    assert count_texts(texts, tokenizer_file()) == [len(model.encode(t)) for t in texts]
    assert [len(x) // 2 for x in packing.encode_texts(texts, tokenizer_file())] == [len(model.encode(t)) for t in texts]
