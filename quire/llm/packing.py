"""Token ids packed into fixed-length rows by best-fit-decreasing.

Documents are tokenised where they were read and packed in blocks of consecutive rows, so
the order of the input - a curriculum - holds to the length of a block and no document is
shuffled. Documents longer than a row are split without loss: whole rows, and a rest that
is packed like a short document. Pieces go, longest first, into the open row with the
least room that still fits them, which a segment tree over room sizes finds in
logarithmic time.

A packed row holds its ids as little-endian 16-bit numbers, padded to the row length, so
consecutive rows are the lines of an id matrix; ``cu_seqlens`` are the cumulative lengths
of its segments and ``position_resets`` the places where positions start again at zero.
Each segment names its document, its number within the document, and its first token's
place there: ``unpack`` restores every document from these.

``write_packs`` puts the rows into files: shards of fixed-width binary records, which
``map_shard`` maps into memory as a matrix, and an index with the segments of each row.
"""

from __future__ import annotations

import itertools
import os
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bounded_batches, removed, staged
from quire.llm.token_count import PartTable, Splitter, runs

#: Tokens of a block, about: what one packing holds in memory.
BLOCK_TOKENS = 4_000_000


class RoomTree:
    """Segment tree over room sizes 0..capacity that counts the open rows of each room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        at = self.size + room
        while at:
            self.count[at] += n
            at >>= 1

    def least(self, need: int) -> int | None:
        """The smallest room of at least ``need`` that an open row has."""
        at = self.size + need
        if self.count[at]:
            return need
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def best_fit_decreasing(lengths: Iterable[int], capacity: int) -> list[list[int]]:
    """Indices of the pieces of each row. Equal lengths keep their order; no piece is longer than a row."""
    tree, open_rows, rows = RoomTree(capacity), defaultdict(list), []
    lengths = list(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[i]
        room = tree.least(need) if need < capacity else None
        if room is None:
            row, room = len(rows), capacity
            rows.append([])
        else:
            row = open_rows[room].pop()
            tree.add(room, -1)
        rows[row].append(i)
        if left := room - need:
            open_rows[left].append(row)
            tree.add(left, 1)
    return rows


def _id_bytes(ids: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    data = ids.astype("<u2").tobytes()
    return [data[2 * a + 2 : 2 * b] for a, b in itertools.pairwise(cuts.tolist())]


_tables: dict[str, PartTable] = {}


def encode_texts(texts: list[str], model_file: str) -> Iterator[bytes]:
    """Ids of each text as little-endian 16-bit numbers, exactly the library's, without special tokens."""
    if model_file not in _tables:
        table = PartTable(Splitter(model_file), _id_bytes)
        if table.splitter.model.get_piece_size() > 1 << 16:
            raise ValueError("ids do not fit 16 bits")
        _tables[model_file] = table
    table = _tables[model_file]
    get, encode = table.__getitem__, table.splitter.model.encode
    for run in runs(texts):
        split = [table.splitter.split(text) for text in run]
        for parts in split:
            table.unknown.extend(itertools.filterfalse(table.__contains__, parts or ()))
        table.learn(split)
        for text, parts in zip(run, split, strict=True):
            yield np.array(encode(text), "<u2").tobytes() if parts is None else b"".join(map(get, parts))


def pack(docs: DataFrame, model_file: str, length: int = 2048, end_id: int | None = 2, pad_id: int = 0, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Packed rows of the texts of ``docs`` (doc_id, text), each text followed by ``end_id`` (None: by nothing).

    Columns: pack_id, ids (binary, ``length`` 16-bit numbers), n_tokens, doc_ids, segments
    (number of each segment in its document), starts (its first token's place there),
    cu_seqlens, position_resets. A null text counts as empty; an empty text is its end
    token, and without one it takes no place. Null ids and repeated rows are documents
    like any other; their segments follow each other. Of pieces of one length the earlier
    goes first. Texts of any length are split, never cut off. Other columns are ignored; an
    empty table gives no rows.
    """
    bounded_batches(docs)
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    ending = b"" if end_id is None else np.array([end_id], "<u2").tobytes()
    width = 2 * length
    padding = np.full(length, pad_id, "<u2").tobytes()
    names = ["pack_id", "ids", "n_tokens", "doc_ids", "segments", "starts", "cu_seqlens", "position_resets"]
    counts = pa.list_(pa.int32())

    def rows_of(block: list[tuple[object, bytes]], first: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        pieces = [(doc, number, data[at : at + width]) for doc, data in block for number, at in enumerate(range(0, len(data), width))]
        packed = best_fit_decreasing((len(data) // 2 for *_, data in pieces), length)
        for at in range(0, len(packed), 1000):
            columns: list[list] = [[] for _ in names]
            for n, members in enumerate(packed[at : at + 1000], first + at):
                held = [pieces[i] for i in members]
                ids = b"".join(data for *_, data in held)
                ends = list(itertools.accumulate((len(data) // 2 for *_, data in held), initial=0))
                row = (n, ids + padding[len(ids) :], ends[-1], [h[0] for h in held], [h[1] for h in held], [h[1] * length for h in held], ends, ends[:-1])
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.list_(id_type), counts, counts, counts, counts]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 33
        block: list[tuple[object, bytes]] = []
        held, id_type = 0, None
        for batch in batches:
            id_type = batch.schema.field(0).type
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc, data in zip(ids, encode_texts(texts, model_file), strict=True):
                block.append((doc, data + ending))
                held += len(data) // 2 + 1
                if held >= block_tokens:
                    for out in rows_of(block, made, id_type):
                        made += out.num_rows
                        yield out
                    block, held = [], 0
        if block:
            yield from rows_of(block, made, id_type)

    array = "array<int>"
    return rows.mapInArrow(packed, f"pack_id long, ids binary, n_tokens int, doc_ids array<{kind}>, segments {array}, starts {array}, cu_seqlens {array}, position_resets {array}")


def record_type(length: int) -> np.dtype:
    """A record of a shard: the row's number, its tokens without padding, its ids, and a line end."""
    return np.dtype([("pack_id", "<i8"), ("n_tokens", "<i4"), ("ids", "<u2", (length,)), ("end", "u1")])


def write_packs(packs: DataFrame, path: str) -> None:
    """Writes packed rows under ``path``: ``ids``, shards of ``record_type`` records, and ``index``, Parquet of everything else.

    The shards are written by Spark's own committer, so a lost executor leaves no half of one; its line separator is the
    byte that ends a record. A shard without rows is an empty file.
    """
    held = staged(packs, "packs")
    little = lambda column, bytes_: F.unhex(F.concat(*(F.substring(F.lpad(F.hex(F.col(column).cast("long")), 16, "0"), 15 - 2 * i, 2) for i in range(bytes_))))
    record = F.concat(little("pack_id", 8), little("n_tokens", 4), "ids")
    held.select(record.cast("string").alias("value")).write.option("lineSep", "\n").text(f"{path}/ids")
    held.drop("ids").write.parquet(f"{path}/index")
    removed(held)


def map_shard(file: str, length: int) -> np.ndarray:
    """The records of a shard in a local file, mapped and not read; its ``ids`` are the packed id matrix."""
    return np.memmap(file, record_type(length), "r") if os.path.getsize(file) else np.empty(0, record_type(length))


def unpack(packs: Iterable, end_id: int | None = 2) -> dict[object, list[int]]:
    """Ids of each document of some packed rows, end token included; for documents with ids of their own."""
    parts: dict[object, dict[int, np.ndarray]] = defaultdict(dict)
    for row in packs:
        ids = np.frombuffer(row.ids, "<u2")
        for doc, start, a, b in zip(row.doc_ids, row.starts, row.cu_seqlens, row.cu_seqlens[1:], strict=False):
            parts[doc][start] = ids[a:b]
    return {doc: np.concatenate([found[k] for k in sorted(found)]).tolist() for doc, found in parts.items()}


def id_matrix(packs: Iterable) -> np.ndarray:
    """The packed id matrix of some rows."""
    return np.stack([np.frombuffer(row.ids, "<u2") for row in packs])
