"""Exact token counts with a whole-token shortcut.

The library's encoder is only asked for pre-tokens that need merging:

* the normalised text is cut before each space that follows another character, and around
  each *isolating* character. ``Splitter`` proves on the model's vocabulary that no piece
  spans such a cut, so the counts of the parts add up to the count of the text;
* vocabulary strings that encode alone as one token are found once per process
  (``whole_tokens``) and count as one without being encoded;
* the other pre-tokens are encoded by the library once and remembered in a table of bounded bytes.

A text holding the space mark itself, which the library takes for a space, is encoded as
a whole.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The model's mark for a space.
MARK = "▁"
#: Bytes of the pre-tokens remembered per process, about, each taking some beside its text; beyond it the table starts anew.
REMEMBERED, EACH = 48 << 20, 120
#: Texts, and characters of them, that are split at once, about.
TEXTS_AT_ONCE, CHARS_AT_ONCE = 256, 4_000_000


def runs(texts: list[str]) -> Iterator[list[str]]:
    """Texts in runs of a bounded number and length; a longer text is a run of its own."""
    run, held = [], 0
    for text in texts:
        if run and (len(run) == TEXTS_AT_ONCE or held + len(text) > CHARS_AT_ONCE):
            yield run
            run, held = [], 0
        run.append(text)
        held += len(text)
    if run:
        yield run


class Splitter:
    """Cuts texts where no vocabulary piece can span, for a piece model without normalisation."""

    def __init__(self, model_file: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        ordinary = [p for i, p in enumerate(pieces) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in ordinary):
            raise ValueError("a piece of this model spans a space")
        if self.model.encode("a  b ", out_type=str)[0] != f"{MARK}a" or "".join(self.model.encode("a  b ", out_type=str)) != f"{MARK}a{MARK}{MARK}b{MARK}":
            raise ValueError("this model normalises white space")
        within = {c for p in ordinary if len(p) > 1 for c in p}
        if "\n" in within:
            raise ValueError("a piece of this model spans a line end")
        self.parts = re.compile(r" +[^ \n]*|\n|[^ \n]+").findall
        before, self.newline = self.model.encode("\n")
        #: Vocabulary strings that encode alone as one token, as pre-tokens of a text.
        self.whole_tokens = {p.replace(MARK, " "): i for i, p in enumerate(pieces) if p[0] == MARK and self.model.encode(p.replace(MARK, " ")[1:]) == [i]}
        self.whole_tokens |= {" ": before, "\n": self.newline}

    def split(self, text: str) -> list[str] | None:
        """The parts of a text, or None where it must be encoded as a whole."""
        return None if MARK in text else self.parts(" " + text) if text else []

    def merge(self, parts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of many parts, and the places before and after each part's ids.

        No part is or holds a line end, so line ends can separate them in one call.
        """
        for at in range(0, len(parts), 2000):
            ids = np.array(self.model.encode("\n" + "\n".join(parts[at : at + 2000]) + "\n"), np.int32)
            yield ids, np.flatnonzero(ids == self.newline)


class PartTable(dict):
    """A value for each part met so far; those of whole tokens stay, the rest is bounded."""

    def __init__(self, splitter: Splitter, values: Callable[[np.ndarray, np.ndarray], list]):
        self.splitter, self.values = splitter, values
        ids = np.array(list(splitter.whole_tokens.values()), np.int32)
        at = np.arange(len(ids) + 1) * 2
        apart = np.full(2 * len(ids) + 1, splitter.newline, np.int32)
        apart[1::2] = ids
        self.whole = dict(zip(splitter.whole_tokens, values(apart, at), strict=True))
        self.unknown: list[str] = []
        self.held = 0
        super().__init__(self.whole)

    def __missing__(self, part: str) -> int:
        """Notes a part that has no value yet; it counts nothing until ``learn``."""
        self.unknown.append(part)
        return 0

    def learn(self, block: list[list[str] | None] = []) -> None:
        """Gives the noted parts their values; where the table is full it starts anew, with all parts of the block."""
        unknown, self.unknown = dict.fromkeys(self.unknown), []
        size = sum(map(len, unknown))
        if self.held + size + EACH * len(unknown) > REMEMBERED and self.held:
            self.clear()
            self.update(self.whole)
            self.held = 0
            unknown |= dict.fromkeys(part for parts in block for part in parts or () if part not in self)
            size = sum(map(len, unknown))
        # What the library makes of a part takes about as much again.
        self.held += 2 * size + EACH * len(unknown)
        values = itertools.chain.from_iterable(self.values(*merged) for merged in self.splitter.merge(list(unknown)))
        self.update(zip(unknown, values, strict=True))


def _lengths(ids: np.ndarray, cuts: np.ndarray) -> list[int]:
    return (np.diff(cuts) - 1).tolist()


_tables: dict[str, PartTable] = {}


def count_texts(texts: list[str | None], model_file: str) -> list[int]:
    """Token count of each text; a null text has none."""
    if model_file not in _tables:
        _tables[model_file] = PartTable(Splitter(model_file), _lengths)
    table = _tables[model_file]
    get, split, encode = table.__getitem__, table.splitter.split, table.splitter.model.encode
    counts: list[int] = []
    for block in runs([text or "" for text in texts]):
        missed = [0]
        for text in block:
            parts = split(text)
            counts.append(len(encode(text)) if parts is None else sum(map(get, parts)))
            missed.append(len(table.unknown))
        unknown = table.unknown
        table.learn()
        for i, (a, b) in enumerate(itertools.pairwise(missed), len(counts) - len(block)):
            counts[i] += sum(map(get, unknown[a:b]))
    return counts


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit.

    Tokens are the library's, without added special tokens. A null or empty text has no
    bytes and no tokens; a null id stays null; repeated rows are counted each; other
    columns are ignored; an empty table gives no rows. Texts of any length are counted
    whole. ``model_file`` must exist on every executor.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(count_texts(batch.column(2).to_pylist(), model_file), pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        F.octet_length(F.coalesce(F.col(text_column), F.lit(""))).cast("long").alias("n_bytes"),
        F.col(text_column).alias("text"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
