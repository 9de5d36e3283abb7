"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as words in lower case with one space between, so case,
punctuation and line breaks don't matter. An item of m characters may occur with up to
``rate`` x m edits, made odd, k. Cut into k + 1 pieces, any such occurrence holds at least
one piece unchanged; an automaton over all items' pieces finds those in one pass over each
whole text. Of the (k + 1) / 2 pairs of neighbouring pieces at least one has at most one
edit, so a hit counts only if its piece's partner follows or precedes it with at most one;
Myers' bit-parallel distance verifies each place that is left.

Items are the stated query set: they are taken in blocks of a bounded number of
characters, each block matched against all rows in a pass of its own. Where there are
several, a block's matches are staged and its broadcast is released before the next one
begins, so what is broadcast has a fixed bound however many items there are.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import KeyFilter, bounded_batches, staged

#: Share of an item's characters that may be edited.
RATE = 0.1
#: Characters of a block of items.
BLOCK_CHARS = 2_000_000

_to_space = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Latin-1 and general punctuation in UTF-8, but for the letters among them.
_wide_punctuation = re.compile(rb"\xc2(?![\xaa\xb5\xba])[\x80-\xbf]|\xe2\x80[\x80-\xbf]")


def normal(text: str | None) -> str:
    data = (text or "").lower().encode().translate(_to_space)
    if b"\xc2" in data or b"\xe2\x80" in data:
        data = _wide_punctuation.sub(b" ", data)
    return b" ".join(data.split()).decode()


def within_one(piece: str, text: str) -> bool:
    """Whether some prefix of ``text`` is within one edit of ``piece``."""
    n = len(piece)
    if text[: n - 1] == piece[: n - 1]:
        return True
    i = 0
    end = min(n, len(text))
    while i < end and piece[i] == text[i]:
        i += 1
    return piece[i + 1 :] == text[i + 1 : n] or piece[i + 1 :] == text[i : n - 1] or piece[i:] == text[i + 1 : n + 1]


def cut(item: str, edits: int) -> list[tuple[int, str]]:
    """``edits`` + 1 pieces of about equal length, with their places."""
    ends = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def pattern_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    return dict(masks)


def myers(masks: dict[str, int], length: int, text: str, most: int) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of ``text``, and where that ends; stops early at 0.

    ``most`` + 1 stands for any larger distance.
    """
    full, last = (1 << length) - 1, 1 << (length - 1)
    up, down, score = full, 0, length
    best, end = most + 1, -1
    for at, c in enumerate(text):
        equal = masks.get(c, 0)
        diagonal = (((equal & up) + up) ^ up) | equal | down
        across_up = down | (full & ~(diagonal | up))
        across_down = up & diagonal
        score += bool(across_up & last) - bool(across_down & last)
        if score < best:
            best, end = score, at
            if not score:
                break
        # The first row is zero everywhere: an occurrence may begin anywhere.
        across_up = (across_up << 1) & full
        across_down = (across_down << 1) & full
        up = across_down | (full & ~(diagonal | across_up))
        down = across_up & diagonal
    return best, end


class Matcher:
    """Finds approximate occurrences of items in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        # An odd budget, so that pieces pair up; an item of one character has none.
        self.items = [(key, text, int(len(text) * rate) | 1 if len(text) > 1 else 0) for key, raw in items if (text := normal(raw))]
        self.masks = [pattern_masks(text) for _, text, _ in self.items]
        #: By piece: item, place in it, and the partner after it, or the partner before it backwards.
        places: dict[str, list[tuple[int, int, str, str]]] = defaultdict(list)
        for n, (_, text, edits) in enumerate(self.items):
            pieces = cut(text, edits)
            for i, (at, piece) in enumerate(pieces):
                after = pieces[i + 1][1] if not i & 1 and i < edits else ""
                before = pieces[i - 1][1][::-1] if i & 1 else ""
                places[piece].append((n, at, after, before))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        self.automaton.make_automaton() if places else None
        self.empty = not places

    def matches(self, raw: str | None) -> list[tuple[int, int, int, int]]:
        """(item key, distance, start of the search window, end) of each item's best occurrence in the normalised text."""
        text = normal(raw)
        if self.empty or not text:
            return []
        # Places where an item may start, by item.
        starts: dict[int, list[int]] = defaultdict(list)
        for end, (size, found) in self.automaton.iter(text):
            for n, at, after, before in found:
                if after:
                    near = within_one(after, text[end + 1 : end + len(after) + 2])
                else:
                    first = end + 1 - size
                    near = not before or within_one(before, text[max(0, first - len(before) - 1) : first][::-1])
                if near:
                    starts[n].append(end + 1 - size - at)
        out = []
        for n, found in starts.items():
            key, item, edits = self.items[n]
            if (at := text.find(item)) >= 0:
                out.append((key, 0, at, at + len(item)))
                continue
            best = (edits + 1, -1, -1)
            found.sort()
            i = 0
            while i < len(found):
                # Overlapping windows are searched as one.
                low = found[i] - edits
                high = found[i] + len(item) + edits
                i += 1
                while i < len(found) and found[i] - edits <= high:
                    high = max(high, found[i] + len(item) + edits)
                    i += 1
                window = text[max(0, low) : high]
                if len(window) < len(item) - edits:
                    continue
                distance, end = myers(self.masks[n], len(item), window, edits)
                if distance < best[0]:
                    best = (distance, max(0, low), max(0, low) + end + 1)
            if best[0] <= edits:
                out.append((key, *best))
        return out


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most ``block_chars`` characters (a longer item is a block of its own), streamed from the table."""
    block, held = [], 0
    for row in benchmark.select("item_id", "text").where("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        if block and held + len(row.text) > block_chars:
            yield block
            block, held = [], 0
        block.append((row.item_id, row.text))
        held += len(row.text)
    if block:
        yield block


_matchers: dict[int, tuple[object, Matcher]] = {}


def _matcher(items: list[tuple[int, str]], rate: float) -> Matcher:
    """One matcher a process and block of items; the block is kept so that its identity stays its own."""
    if id(items) not in _matchers or _matchers[id(items)][0] is not items:
        _matchers.clear()
        _matchers[id(items)] = (items, Matcher(items, rate))
    return _matchers[id(items)][1]


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and item that occurs in it: doc_id, item_id, distance, text_start, text_end.

    Places are those of the best occurrence in the normalised text, of equally good ones the
    first, text_start being where its search window starts. Texts of any length are searched
    whole. Nulls: a null or wordless text holds nothing, a null or
    wordless item is in nothing; a null doc_id or item_id is carried through. Repeated rows
    of documents give repeated matches; items of equal text match alike. Other columns are
    ignored; an empty table on either side gives no rows.
    """
    rows = docs.select(F.col("doc_id").alias("doc_id"), "text")
    found = [kept for kept, _ in _passes(rows, benchmark, rate, block_chars)]
    return functools.reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], _schema(rows))


def _schema(rows: DataFrame) -> str:
    return f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id long, distance int, text_start int, text_end int"


def _passes(rows: DataFrame, benchmark: DataFrame, rate: float, block_chars: int) -> Iterator[tuple[DataFrame, object]]:
    """Matches of each block of items in ``rows`` (doc_id, text), with the block's broadcast, or None where they are staged and it is gone."""
    blocks = item_blocks(benchmark, block_chars)
    block, several = next(blocks, None), False
    while block is not None:
        following = next(blocks, None)
        several = several or following is not None
        shared = rows.sparkSession.sparkContext.broadcast(block)

        def match(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared.value, rate)
            for batch in batches:
                found = [(doc, *m) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in matcher.matches(text)]
                columns = list(zip(*found, strict=True)) or [()] * 5
                kinds = [batch.schema.field(0).type, pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "distance", "text_start", "text_end"])

        found = rows.mapInArrow(match, _schema(rows))
        if several:
            found = staged(found, "item-matches")
            shared.destroy()
            shared = None
        yield found, shared
        block = following


def without_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that no item occurs in.

    With one block of items rows are filtered where they were read; with several, the digests of the texts that hold some
    item are staged block by block, and rows with such a text are taken out at the end. A null or wordless text stays, a
    null or wordless item is in nothing; ids don't matter and repeated rows share their fate. Texts of any length are
    searched whole; an empty table on either side takes nothing away.
    """
    bounded_batches(docs)
    blocks = item_blocks(benchmark, block_chars)
    block, following = next(blocks, None), next(blocks, None)
    if block is None:
        return docs
    if following is None:
        shared, place = docs.sparkSession.sparkContext.broadcast(block), docs.columns.index("text")

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared.value, rate)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.matches(text) for text in batch.column(place).to_pylist()], pa.bool_()))

        return docs.mapInArrow(clean, docs.schema)
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = docs.select(digest.alias("doc_id"), "text")
    found = functools.reduce(DataFrame.unionByName, [kept for kept, _ in _passes(rows, benchmark, rate, block_chars)])
    dirty = staged(found.select(F.col("doc_id").alias("__dirty__")).distinct(), "dirty-texts")
    keyed = docs.select(F.struct("*").alias("__row__"), digest.alias("__digest__"))
    flagged = KeyFilter(dirty, ["__dirty__"], dirty.count()).flagged(keyed, [F.col("__digest__")], "may")
    kept = flagged.where("NOT may").unionByName(flagged.where("may").join(dirty, F.col("__digest__") == F.col("__dirty__"), "left_anti"))
    return kept.select("__row__.*")
