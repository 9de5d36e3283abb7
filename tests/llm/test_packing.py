import random

import numpy as np
import pytest
import sentencepiece

from quire.llm import packing
from quire.llm.queries import tokenizer_file


def slow_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(room, i) for i, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(capacity - n)
    return sorted(capacity - r for r in rooms)


@pytest.mark.parametrize("capacity", [1, 2, 7, 64, 100])
def test_best_fit_decreasing(capacity):
    rng = random.Random(capacity)
    lengths = [rng.randint(1, capacity) for _ in range(300)]
    rows = packing.best_fit_decreasing(lengths, capacity)
    assert sorted(i for row in rows for i in row) == list(range(300))
    assert sorted(sum(lengths[i] for i in row) for row in rows) == slow_best_fit(lengths, capacity)
    assert packing.best_fit_decreasing([], capacity) == []


@pytest.mark.parametrize(("length", "block"), [(16, 50), (64, 10_000)])
def test_round_trip(documents, clashing, length, block):
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file())
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices("the of ononedth é\nx word, ▁".split(" "), k=rng.randint(0, 90)))) for i in range(60)] + [(100, None), (101, ""), (102, "long text " * 5000)]
    packs = packing.pack(clashing(documents(rows)), tokenizer_file(), length=length, block_tokens=block).collect()
    assert packing.unpack(packs) == {d: [*model.encode(t or ""), 2] for d, t in rows}
    matrix = packing.id_matrix(packs)
    assert matrix.shape == (len(packs), length) and len({p.pack_id for p in packs}) == len(packs)
    for p, ids in zip(packs, matrix, strict=True):
        assert p.cu_seqlens[0] == 0 and p.cu_seqlens[-1] == p.n_tokens <= length and p.position_resets == p.cu_seqlens[:-1]
        assert len(p.doc_ids) == len(p.segments) == len(p.starts) == len(p.position_resets) and (ids[p.n_tokens :] == 0).all()
        assert all(a < b for a, b in zip(p.cu_seqlens, p.cu_seqlens[1:], strict=False))


def test_null_ids_repeated_rows_and_no_end(documents):
    packs = packing.pack(documents([(None, "the"), (None, "the"), (7, "of"), (7, "of"), (8, "")]), tokenizer_file(), length=8, end_id=None).collect()
    assert sorted(str(d) for p in packs for d in p.doc_ids) == ["7", "7", "None", "None"] and sum(p.n_tokens for p in packs) == 4


def test_empty_table(documents):
    assert packing.pack(documents([]), tokenizer_file()).collect() == []


def test_rows_are_well_filled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts = [r.n_tokens for r in packing.pack(docs, tokenizer_file(), length=2048).collect()]
    assert np.sum(counts) / (2048 * len(counts)) > 0.97


def test_shards_hold_the_rows(spark, documents, tmp_path):
    docs = documents([(i, f"word number {i} " * (i % 90)) for i in range(300)] + [(None, None), (7, "\n" * 40)])
    rows = packing.pack(docs.repartition(3), tokenizer_file(), length=64)
    packing.write_packs(rows, f"file://{tmp_path}/out")
    want = {r.pack_id: r for r in rows.collect()}
    shards = [packing.map_shard(str(f), 64) for f in sorted((tmp_path / "out/ids").glob("part-*"))]
    got = np.concatenate(shards)
    assert len(got) == len(want) and set(got["end"].tolist()) == {10}
    assert all(want[r["pack_id"]].ids == r["ids"].tobytes() and want[r["pack_id"]].n_tokens == r["n_tokens"] for r in got)
    index = {r.pack_id: r for r in spark.read.parquet(f"file://{tmp_path}/out/index").collect()}
    assert all(index[i].cu_seqlens == r.cu_seqlens and index[i].position_resets == r.position_resets and index[i].doc_ids == r.doc_ids for i, r in want.items())
