"""Language-model scoring by prediction by partial matching, beside a word-count base score.

The model is a byte-context trie over the training texts of the whole corpus: counts of
what followed each context of up to ``order`` bytes, texts being lower-cased in A-Z,
preceded by padding and closed by an end symbol. A symbol's probability is estimated at
the longest known context: with T occurrences of d different symbols, a symbol seen c
times has c / (T + d) and the escape to the next shorter context d / (T + d). After an
escape, the symbols that the longer context knows are excluded from the shorter one's
counts. Since those counts are fixed once training is over, each context's escape and
exclusion terms are worked out beforehand, and a symbol whose full context is known costs
one lookup.

Counts of (order + 1)-grams and of words are gathered in one pass, combined within each
task, and summed by a shuffle, over all training texts. All of them are used for scoring,
however many there are. The trie is cut into parts by the last bytes of the contexts: a
context and the shorter ones it escapes to end alike, so a part holds all that its grams
need, but for the shortest contexts, whose number is bounded and which every part gets.
Texts are dealt into chunks; the distinct grams of a chunk travel to their parts, their
probabilities travel back to the chunk's texts. Of the words, the most frequent ``words``
at most are looked up in memory and all others are joined.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quire.llm.common import bounded_batches, id_crc, staged

PAD, END, SYMBOLS = 0xFE, 0xFF, 255
#: Longer words are known by their digest, which a blank keeps apart from words.
LONGEST_WORD = 64
#: Codes sorted at once, words counted before they are passed on.
CODES_AT_ONCE, WORDS_AT_ONCE = 1 << 21, 400_000
#: The trie is dealt by so many last bytes of a context; shorter contexts are in every part.
SUFFIX = 3
#: Distinct grams of a chunk of texts, about, and those that travel in a row.
CHUNK_GRAMS, GRAMS_IN_ROW = 1 << 20, 4096


@dataclass(frozen=True)
class Settings:
    """``nodes``: of the trie, in a part, about; ``words``: looked up in memory, the others are joined."""

    order: int = 5
    nodes: int = 1_500_000
    words: int = 200_000


def word_key(word: bytes) -> bytes:
    return word if len(word) <= LONGEST_WORD else b" " + hashlib.sha256(word).digest()


def gram_codes(texts: list[bytes], order: int) -> np.ndarray:
    """The (order + 1)-byte code of each symbol of the lower-cased texts and their ends, in order."""
    pad, end = bytes([PAD]) * order, bytes([END])
    stream = np.frombuffer(b"".join(x for text in texts for x in (pad, text, end)), np.uint8)
    n = len(stream) - order
    codes = np.zeros(max(0, n), np.uint64)
    for i in range(order + 1):
        np.left_shift(codes, np.uint64(8), out=codes)
        np.bitwise_or(codes, stream[i : n + i], out=codes)
    return codes[stream[order:] != PAD] if n > 0 else codes


def _slices(texts: list[bytes], most: int) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in runs of about ``most`` bytes, each with its first index."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text) + 1
        if held >= most:
            yield first, texts[first : i + 1]
            first, held = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[first], np.add.reduceat(counts, first)


def gather_counts(docs: DataFrame, training: Column, order: int) -> DataFrame:
    """(word, gram, n): the corpus counts of each word key - null gram - and each gram code - null word. The end token is the empty word."""
    texts = docs.where(training).select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        grams: list[tuple[np.ndarray, np.ndarray]] = []

        def word_rows() -> pa.RecordBatch:
            keys = pa.array(words.keys(), pa.binary())
            out = pa.RecordBatch.from_arrays([keys, pa.nulls(len(words), pa.int64()), pa.array(words.values(), pa.int64())], ["word", "gram", "n"])
            words.clear()
            return out

        def gram_rows() -> Iterator[pa.RecordBatch]:
            codes, counts = _merged(grams)
            grams.clear()
            for at in range(0, len(codes), 500_000):
                part = codes[at : at + 500_000].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.binary()), pa.array(part), pa.array(counts[at : at + 500_000].astype(np.int64))], ["word", "gram", "n"])

        for batch in batches:
            lower = [text.lower() for text in batch.column(0).to_pylist()]
            for _, run in _slices(lower, CODES_AT_ONCE):
                grams.append(np.unique(gram_codes(run, order), return_counts=True))
                for text in run:
                    split = text.split()
                    words.update(map(word_key, split) if len(text) > LONGEST_WORD and max(map(len, split), default=0) > LONGEST_WORD else split)
                words[b""] += len(run)
                if len(words) > WORDS_AT_ONCE:
                    yield word_rows()
                if sum(len(codes) for codes, _ in grams) > 2 * CODES_AT_ONCE:
                    grams[:] = [_merged(grams)]
                    if len(grams[0][0]) > CODES_AT_ONCE:
                        yield from gram_rows()
        if words:
            yield word_rows()
        if grams:
            yield from gram_rows()

    return texts.mapInArrow(count, "word binary, gram long, n long").groupBy("word", "gram").agg(F.sum("n").alias("n"))


def threshold(counted: DataFrame, most: int) -> int:
    """Least count that at most ``most`` rows of ``counted`` (n) reach, from a histogram of counts."""
    bucket = F.when(F.col("n") < 4096, F.col("n")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("n"))).cast("long"))
    seen, least = 0, None
    for row in counted.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("bucket")).collect():
        if seen + row.rows > most:
            return row.bucket + 1 if row.bucket < 4096 else 2 * row.bucket if least is None else least
        seen, least = seen + row.rows, row.bucket
    return 1


def mask(n: int) -> np.uint64:
    return np.uint64((1 << (8 * n)) - 1)


def _find(among: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of codes in a sorted array, and whether they are there."""
    if not len(among):
        return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
    at = np.minimum(np.searchsorted(among, codes), len(among) - 1)
    return at, among[at] == codes


class Table:
    """Open addressing over distinct codes; all keys are placed together, round by round."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(codes) * 2).bit_length())
        size = 1 << self.bits
        # No code is all ones: an END is always the last symbol.
        self.keys, self.values = np.full(size, np.iinfo(np.uint64).max, np.uint64), np.zeros(size, np.float32)
        rest, slot = np.arange(len(codes)), self._slot(codes)
        while len(rest):
            free = self.keys[slot] == np.iinfo(np.uint64).max
            taken, chosen = np.unique(slot[free], return_index=True)
            placed = rest[free][chosen]
            self.keys[taken], self.values[taken] = codes[placed], values[placed]
            left = np.ones(len(rest), bool)
            left[np.flatnonzero(free)[chosen]] = False
            rest, slot = rest[left], (slot[left] + 1) & (size - 1)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the codes, and the places of codes that have none."""
        out = np.empty(len(codes), np.float32)
        slot = self._slot(codes)
        key = self.keys[slot]
        hit = key == codes
        out[:] = self.values[slot]
        open_ = np.flatnonzero(~hit & (key != np.iinfo(np.uint64).max))
        absent = [np.flatnonzero(~hit & (key == np.iinfo(np.uint64).max))]
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & (len(self.keys) - 1)
            key = self.keys[slot]
            hit, empty = key == codes[open_], key == np.iinfo(np.uint64).max
            out[open_[hit]] = self.values[slot[hit]]
            absent.append(open_[empty])
            open_, slot = open_[~hit & ~empty], slot[~hit & ~empty]
        return out, np.concatenate(absent)


class Trie:
    """The context trie: ``levels`` holds, for each order from 0, the sorted codes of contexts with their symbol, and counts."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], texts: int):
        self.order = len(levels) - 1
        self.codes = [codes for codes, _ in levels]
        self.contexts: list[np.ndarray] = []
        self.first: list[np.ndarray] = []
        self.log_count: list[np.ndarray] = []
        self.escape_first: list[np.ndarray] = []
        self.below: list[np.ndarray] = []
        self.escape_below: list[np.ndarray] = []
        upper = None
        for j, (codes, counts) in enumerate(levels):
            counts = counts.astype(np.float64)
            context, start, inverse, different = np.unique(codes >> np.uint64(8), return_index=True, return_inverse=True, return_counts=True)
            total = np.add.reduceat(counts, start) if len(codes) else np.empty(0)
            if j == 0:
                full = total  # the empty context lost nothing: it has all the symbols there are
            else:
                at, there = _find(levels[j - 1][0], context)
                full = np.where(there, levels[j - 1][1][at].astype(np.float64) if len(levels[j - 1][1]) else 0.0, 0.0)
                full = np.where((context & np.uint64(0xFF)) == PAD, float(texts), full)
            lost = np.maximum(0.0, full - total)
            escape = different + lost
            with np.errstate(divide="ignore", invalid="ignore"):
                self.first.append(np.log10(counts / (total + escape)[inverse]) if len(codes) else np.empty(0))
                self.escape_first.append(np.log10(escape / (total + escape)))
                self.log_count.append(np.log10(counts))
                if j == 0:
                    below, escape_below = np.zeros(len(context)), np.zeros(len(context))
                else:
                    up_context, up_total, up_different, up_lost = upper
                    at, _ = _find(up_context, context & mask(j - 1))
                    node, _ = _find(levels[j - 1][0], codes & mask(j))
                    excluded = np.add.reduceat(levels[j - 1][1][node].astype(np.float64), start) if len(codes) else np.empty(0)
                    rest = np.maximum(0.0, up_total[at] - excluded) if len(at) else np.empty(0)
                    open_ = np.maximum(0.0, up_different[at] - different) + up_lost[at] if len(at) else np.empty(0)
                    below = np.log10(rest + open_)
                    escape_below = np.where(rest + open_ > 0, np.log10(open_) - below, 0.0)
            self.contexts.append(context)
            self.below.append(below)
            self.escape_below.append(escape_below)
            upper = context, total, different.astype(np.float64), lost
        self.unknown = -np.log10(max(1, SYMBOLS - len(self.codes[0])))
        self.table = Table(self.codes[-1], self.first[-1])

    def log10_probability(self, codes: np.ndarray) -> np.ndarray:
        """Of each symbol after its context, both in the (order + 1)-byte code."""
        out, absent = self.table.find(codes)
        out[absent] = self._escaped(codes[absent])
        return out

    def _escaped(self, codes: np.ndarray) -> np.ndarray:
        """As ``log10_probability``, context by context from the longest."""
        out = np.zeros(len(codes))
        active, longer = np.arange(len(codes)), np.full(len(codes), -1, np.int64)
        for j in range(self.order, -1, -1):
            code = codes[active]
            at, seen = _find(self.contexts[j], (code >> np.uint64(8)) & mask(j))
            node, found = _find(self.codes[j], code & mask(j + 1))
            came = longer >= 0
            fresh = seen & ~came
            gain = np.zeros(len(active))
            use = fresh & found
            gain[use] = self.first[j][node[use]]
            use = fresh & ~found
            gain[use] = self.escape_first[j][at[use]]
            if j < self.order:
                use = came & found
                gain[use] = self.log_count[j][node[use]] - self.below[j + 1][longer[use]]
                use = came & ~found
                gain[use] = self.escape_below[j + 1][longer[use]]
            out[active] += gain
            done = found & (seen | came)
            longer = np.where(seen, at, -1)[~done]
            active = active[~done]
        out[active] += self.unknown
        return out


def score(table: Table, texts: list[bytes], order: int) -> np.ndarray:
    """log10 probability of each lower-cased text, its end included, from that of each of its grams."""
    out = np.zeros(len(texts))
    for first, run in _slices(texts, CODES_AT_ONCE // 8):
        found, absent = table.find(gram_codes(run, order))
        if len(absent):
            raise ValueError(f"{len(absent)} grams of a chunk have no probability")
        ends = np.cumsum([len(text) + 1 for text in run])
        out[first : first + len(run)] = np.add.reduceat(found.astype(np.float64), np.r_[0, ends[:-1]])
    return out


def level(codes: np.ndarray, counts: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of order ``j``, sorted, with their counts, from codes of a higher order."""
    return _merged([(codes & mask(j + 1), counts)]) if len(codes) else (codes, counts)


def shared_levels(grams: DataFrame, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The levels of the orders below SUFFIX, which every part gets."""
    most = min(order, SUFFIX)
    table = grams.groupBy(F.col("gram").bitwiseAND(F.lit((1 << (8 * most)) - 1)).alias("code")).agg(F.sum("n").alias("n")).toArrow()
    codes, counts = table.column(0).to_numpy().astype(np.uint64), table.column(1).to_numpy()
    return [level(codes, counts, j) for j in range(most)]


def packed(codes: np.ndarray, order: int) -> bytes:
    """Sorted codes without their empty bytes, byte place by byte place, which compresses well."""
    return codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : order + 1].T.tobytes()


def unpacked(data: list[bytes], order: int) -> np.ndarray:
    """Inverse of ``packed``, of several packs one after another."""
    out = np.zeros((sum(map(len, data)) // (order + 1), 8), np.uint8)
    at = 0
    for pack in data:
        n = len(pack) // (order + 1)
        out[at : at + n, : order + 1] = np.frombuffer(pack, np.uint8).reshape(order + 1, n).T
        at += n
    return out.view("<u8").reshape(-1)


def part_of(codes: np.ndarray, order: int, parts: int) -> np.ndarray:
    """The part of the trie that knows a gram; ``part_column`` is the same."""
    suffix = (codes >> np.uint64(8)) & mask(min(order, SUFFIX))
    return (((suffix * np.uint64(2654435761)) >> np.uint64(8)) & mask(3)).astype(np.int64) % parts


def part_column(gram: Column, order: int, parts: int) -> Column:
    suffix = F.shiftright(gram, 8).bitwiseAND(F.lit((1 << (8 * min(order, SUFFIX))) - 1))
    return (F.shiftright(suffix * F.lit(2654435761), 8).bitwiseAND(F.lit((1 << 24) - 1)) % F.lit(parts)).cast("int")


def gram_probabilities(asked: DataFrame, grams: DataFrame, texts: int, order: int, parts: int) -> DataFrame:
    """(chunk, pack, found): log10 probabilities of the packed grams of ``asked`` (part, chunk, pack, grams) by the counts of ``grams`` (gram, n)."""
    shared = grams.sparkSession.sparkContext.broadcast(shared_levels(grams, order))
    rows = grams.select(
        part_column(F.col("gram"), order, parts).alias("part"), F.lit(None).cast("long").alias("chunk"), F.lit(None).cast("int").alias("pack"), F.lit(None).cast("binary").alias("grams"), "gram", "n"
    )
    rows = rows.unionByName(asked.select("part", "chunk", "pack", "grams"), allowMissingColumns=True)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        trie = None
        for batch in batches:
            # A part's counts come before what is asked of it.
            model = batch.filter(pc.is_valid(batch.column(4)))
            codes.append(model.column(4).to_numpy().astype(np.uint64))
            counts.append(model.column(5).to_numpy())
            batch = batch.filter(pc.is_valid(batch.column(1)))
            if not batch.num_rows:
                continue
            if trie is None:
                own, n = np.concatenate(codes), np.concatenate(counts)
                trie = Trie(shared.value + [level(own, n, j) for j in range(len(shared.value), order + 1)], texts)
            packs = batch.column(3).to_pylist()
            sizes = [len(x) // (order + 1) for x in packs]
            found = np.split(trie.log10_probability(unpacked(packs, order)).astype("<f4"), np.cumsum(sizes)[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([x.tobytes() for x in found], pa.binary())], ["chunk", "pack", "found"])

    dealt = rows.repartitionById(parts, F.col("part")).sortWithinPartitions(F.col("chunk").asc_nulls_first())
    return dealt.mapInArrow(look_up, "chunk long, pack int, found binary")


def held_out(id_column: str = "doc_id") -> Column:
    return id_crc(id_column) % 5 == 1


def score_texts(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Nulls: a null text is empty, so it has its end token alone; a null id counts as the
    empty text in the held-out rule. Repeated rows are learned from and scored each. A
    table without training rows has no counts: every symbol is then equally likely. Other
    columns are ignored; an empty table gives no rows. Texts of any length are read whole;
    equal texts have equal scores.
    """
    spark = docs.sparkSession
    bounded_batches(docs)
    counts = staged(gather_counts(docs, ~held_out(), settings.order), "lm-counts")
    words = counts.where(F.col("word").isNotNull()).select("word", "n")
    total, different, texts = words.agg(F.sum("n"), F.count(F.lit(1)), F.sum(F.when(F.length("word") == 0, F.col("n")))).first()
    total, texts = total or 0, texts or 0
    divisor = total + 0.5 * (different + 1)
    common = threshold(words, settings.words)
    table = words.where(F.col("n") >= common).toArrow()
    known = dict(zip(table.column(0).to_pylist(), np.log10((table.column(1).to_numpy() + 0.5) / divisor).tolist(), strict=True))
    grams = counts.where(F.col("gram").isNotNull()).select("gram", "n")
    order = settings.order
    parts = max(1, -(-grams.count() * (order + 1) // settings.nodes))
    shared = spark.sparkContext.broadcast(known)
    end_score = float(np.log10((texts + 0.5) / divisor))
    rows = docs.select("doc_id", held_out().alias("held_out"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType
    rare = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        get = known.get
        row = TaskContext.get().partitionId() << 40
        chunk = TaskContext.get().partitionId() << 24
        held: list[np.ndarray] = []

        def asked_rows() -> Iterator[pa.RecordBatch]:
            codes = np.unique(np.concatenate(held))
            held.clear()
            part = part_of(codes, order, parts)
            place = np.argsort(part, kind="stable")
            codes, part = codes[place], part[place]
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(codes)]
            spans = [(i, min(i + GRAMS_IN_ROW, b)) for a, b in itertools.pairwise(cuts) for i in range(a, b, GRAMS_IN_ROW)]
            columns = {"chunk": pa.array([chunk] * len(spans), pa.int64()), "part": pa.array([part[a] for a, _ in spans], pa.int32()), "pack": pa.array(range(len(spans)), pa.int32()), "grams": pa.array([packed(codes[a:b], order) for a, b in spans], pa.binary())}
            yield pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(len(spans), f.type)) for f in fields], schema=fields)

        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                lower = [text.lower() for text in batch.column(2).to_pylist()]
                columns: list[list] = [[], [], [], []]
                for text in lower:
                    split = text.split()
                    base, seen = end_score, int(texts > 0)
                    found = list(map(get, split))
                    others = Counter(word_key(w) for w, p in zip(split, found, strict=True) if p is None) if None in found else {}
                    hits = [p for p in found if p is not None]
                    # Long words are known by their digests.
                    for key in [k for k in others if k[:1] == b" " and k in known]:
                        hits += [known[key]] * others.pop(key)
                    base += sum(hits)
                    seen += len(hits)
                    for column, value in zip(columns, (len(split) + 1, seen, base, [{"word": w, "n": n} for w, n in others.items()]), strict=True):
                        column.append(value)
                ids = np.arange(row, row + len(lower))
                row += len(lower)
                made = [pa.array([chunk] * len(ids), pa.int64()), pa.array(ids), batch.column(0), batch.column(1), *map(pa.array, columns[:3], (pa.int64(), pa.int64(), pa.float64())), pa.array(columns[3], rare), pa.array(lower, pa.binary())]
                yield pa.RecordBatch.from_arrays([*made, pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary())], schema=fields)
                for _, run in _slices(lower, CODES_AT_ONCE):
                    held.append(np.unique(gram_codes(run, order)))
                    if sum(map(len, held)) > 2 * CHUNK_GRAMS:
                        held[:] = [np.unique(np.concatenate(held))]
                if sum(map(len, held)) > CHUNK_GRAMS:
                    held[:] = [np.unique(np.concatenate(held))]
                    if len(held[0]) > CHUNK_GRAMS:
                        yield from asked_rows()
                        chunk += 1
        if held:
            yield from asked_rows()

    scored = "row long, doc_id {}, held_out boolean, n_tokens long, n_known long, base_score double".format(kind.simpleString())
    schema = f"chunk long, {scored}, others array<struct<word:binary,n:long>>, text binary, part int, pack int, grams binary"
    kinds = [pa.int64(), pa.int64(), to_arrow_type(kind), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), rare, pa.binary(), pa.int32(), pa.int32(), pa.binary()]
    fields = pa.schema(list(zip("chunk row doc_id held_out n_tokens n_known base_score others text part pack grams".split(), kinds, strict=True)))
    read_rows = staged(rows.mapInArrow(read, schema), "lm-texts")
    asked = read_rows.where(F.col("grams").isNotNull()).select("part", "chunk", "pack", "grams")
    chunks = sorted(r.chunk for r in asked.select("chunk").distinct().collect())
    places = F.broadcast(spark.createDataFrame(list(zip(chunks, range(len(chunks)), strict=True)), "chunk long, place int"))
    found = gram_probabilities(asked, grams, texts, order, parts)
    # The grams stay in their chunk; only their probabilities come back, in the order of the packs.
    met = read_rows.drop("others", "part").unionByName(found, allowMissingColumns=True).join(places, "chunk")
    dealt = met.repartitionById(max(1, len(chunks)), F.col("place")).sortWithinPartitions(F.col("row").asc_nulls_first(), "pack")
    names = [f.split()[0] for f in scored.split(", ")]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, values, table = [], [], None
        for batch in batches:
            # A chunk's grams come before its texts.
            of_texts = pc.is_valid(batch.column(0))
            of_grams = batch.filter(pc.invert(of_texts))
            codes += of_grams.column(len(names) + 1).drop_null().to_pylist()
            values += of_grams.column(len(names) + 2).drop_null().to_pylist()
            batch = batch.filter(of_texts)
            if not batch.num_rows:
                continue
            if table is None:
                table = Table(unpacked(codes, order), np.frombuffer(b"".join(values), "<f4"))
                codes.clear()
                values.clear()
            out = pa.array(score(table, batch.column(len(names)).to_pylist(), order))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], out], [*names, "score"])

    result = dealt.select(*names, "text", "grams", "found").mapInArrow(finish, f"{scored}, score double")
    pairs = read_rows.where(F.col("row").isNotNull()).select("row", F.explode("others").alias("o")).select("row", "o.word", F.col("o.n").alias("times"))
    met_words = pairs.join(words.where(F.col("n") < common), "word", "left")
    word_score = F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / divisor)
    more = met_words.groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(word_score).alias("more_score"))
    return (
        result.join(more, "row", "left")
        .select(
            "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
            (F.col("base_score") + F.coalesce("more_score", F.lit(0.0))).alias("base_score"), "score",
        )
    )
