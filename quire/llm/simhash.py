"""SimHash near-deduplication with BK-trees.

A fingerprint has a bit where over half of the text's shingle hashes have it. Two
fingerprints link if at most ``radius`` of their 64 bits differ. Equal fingerprints are
merged first, so the search works on distinct ones.

The search cuts the 64 bits into ``blocks`` of equal width. Fingerprints that differ in at
most ``radius`` bits differ in at most ``radius`` blocks, so they agree on all blocks but
some choice of ``radius``: each choice makes one shard key of the bits that are left. A
shard holds distinct fingerprints that differ only within the chosen blocks, which bounds
it: with 8 blocks and radius 2, by 2^16 of them. Each shard gets a BK-tree, whose children
are keyed by their Hamming distance to the parent, and each member is searched in it along
the edges within the radius.

A shard tree travels to the shard's queries rather than being broadcast: the number of
distinct fingerprints, and so that of trees, has no bound that a broadcast could be sized
by. Per shard only a spanning forest of the links leaves the search - never all pairs -
and components are found by star rounds over those links.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import KeyFilter, bounded_batches, removed, staged
from quire.llm.graph import connected_components

SEED = 42
#: Hashes turned into bits at once.
BITS_AT_ONCE = 1 << 16


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of each word shingle of a UTF-8 text, repeats included: A-Z lowered, words split at ASCII white space."""
    words = text.lower().split() if text else []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(itertools.accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(end + 1 for end in ends[:-1])]
    spans = zip(starts, ends[shingle - 1 :], strict=False) if len(words) >= shingle else [(0, len(joined))] * bool(words)
    return np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The fingerprint of a text's hashes, as a signed number; zero without hashes."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BITS_AT_ONCE):
        bits = np.unpackbits(hashes[at : at + BITS_AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def fingerprints(texts: list[bytes | None], shingle: int = 3) -> np.ndarray:
    return np.array([fingerprint(shingle_hashes(text, shingle)) for text in texts], np.int64)


class BKTree:
    """A BK-tree over 64-bit values; children are keyed by integer Hamming distance to the parent, equal ones by zero."""

    def __init__(self, values: np.ndarray):
        self.values = values.astype(np.uint64)
        n = len(values)
        self.child = np.full((n, 65), -1, np.int32) if n else np.empty((0, 65), np.int32)
        #: All values descend together: those at a node whose edge is free take it, one for each edge.
        at, rest = np.zeros(max(0, n - 1), np.int64), np.arange(1, n)
        while len(rest):
            edge = np.bitwise_count(self.values[rest] ^ self.values[at])
            below = self.child[at, edge]
            free = below < 0
            slots, first = np.unique(at[free] * 65 + edge[free], return_index=True)
            self.child[slots // 65, slots % 65] = rest[free][first]
            placed = np.zeros(len(rest), bool)
            placed[np.flatnonzero(free)[first]] = True
            at, edge, rest = at[~placed], edge[~placed], rest[~placed]
            at = self.child[at, edge]

    def links(self, radius: int, at_once: int = 1 << 12) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs (query, found) of each value with all others within the radius, block by block."""
        for start in range(0, len(self.values), at_once):
            query = np.arange(start, min(start + at_once, len(self.values)))
            node = np.zeros(len(query), np.int64)
            while len(query):
                distance = np.bitwise_count(self.values[query] ^ self.values[node]).astype(np.int64)
                hit = (distance <= radius) & (query != node)
                yield query[hit], node[hit]
                followed = []
                for step in range(-radius, radius + 1):
                    edge = distance + step
                    fits = (edge >= 0) & (edge <= 64)
                    below = np.where(fits, self.child[node, np.clip(edge, 0, 64)], -1)
                    followed.append((query[below >= 0], below[below >= 0]))
                query, node = (np.concatenate(x).astype(np.int64) for x in zip(*followed, strict=True))


class _Forest:
    """Smallest member of each component of a shard, merged link by link."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root != root[root]).any():
                root[:] = root[root]


def shard_forest(values: np.ndarray, radius: int, sketches: np.ndarray | None = None, agreement: float = 0.0, nodes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (value, smallest value of its component) of the links within a shard of distinct values.

    With ``sketches``, a row for each value, a link also needs that share of equal places.
    With ``nodes``, a distinct number for each value, values may repeat and the forest is one of nodes.
    Dense shards are often one component; a few whole rows of distances show that without
    a search.
    """
    order = np.argsort(values)
    values = values[order]
    nodes = values if nodes is None else nodes[order]
    sketches = None if sketches is None else sketches[order]
    forest = _Forest(len(values))

    def link(query: np.ndarray, found: np.ndarray) -> None:
        if sketches is not None and len(query):
            agree = (sketches[query] == sketches[found]).mean(axis=1) >= agreement
            query, found = query[agree], found[agree]
        forest.add(query, found)

    bits, leader = values.astype(np.uint64), 0
    for _ in range(8 if len(values) > 64 else 0):
        near = np.flatnonzero(np.bitwise_count(bits ^ bits[leader]) <= radius)
        link(np.full(len(near), leader), near)
        outside = np.flatnonzero(forest.root != 0)
        if not len(outside):
            break
        leader = outside[0]
    if forest.root.any():
        for query, found in BKTree(values).links(radius):
            link(query, found)
    root = forest.root
    tied = root < np.arange(len(values))
    return nodes[tied], nodes[root[tied]]


def shard_keys(blocks: int, radius: int) -> list[int]:
    """Masks of the bits that each shard key keeps: all blocks but some choice of ``radius``."""
    width = -(-64 // blocks)
    block = [((1 << min(width, 64 - width * i)) - 1) << (width * i) for i in range(blocks)]
    return [((1 << 64) - 1) & ~sum(chosen) for chosen in itertools.combinations(block, radius)]


def near_links(distinct: DataFrame, radius: int = 2, blocks: int = 8) -> DataFrame:
    """Links (a, b) that span the components of ``distinct`` (fingerprint) at Hamming distance ``radius`` or less."""
    masks = [mask - (1 << 64) if mask >> 63 else mask for mask in shard_keys(blocks, radius)]
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("choice"), F.col("fingerprint").bitwiseAND(F.lit(mask)).alias("key")) for i, mask in enumerate(masks))))
    # Small rows that become many: dealt over all partitions first, which adaptive execution would join to few.
    # In turn and not by fingerprint, by which they lie already.
    spread = distinct.select("fingerprint").repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shards = spread.select("fingerprint", keys.alias("k")).groupBy("k").agg(F.collect_list("fingerprint").alias("members")).where(F.size("members") > 1)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column(0)
            flat, offsets = members.flatten().to_numpy(), np.asarray(members.offsets)
            offsets = offsets - offsets[0]
            sizes = np.diff(offsets)
            out = []
            # Most shards hold two: their tree is a root and perhaps one child.
            two = offsets[:-1][sizes == 2]
            near = np.bitwise_count(flat[two].astype(np.uint64) ^ flat[two + 1].astype(np.uint64)) <= radius
            out.append((flat[two][near], flat[two + 1][near]))
            for i in np.flatnonzero(sizes > 2):
                out.append(shard_forest(flat[offsets[i] : offsets[i + 1]], radius))
            a, b = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return shards.select("members").mapInArrow(search, "a long, b long")


#: Minhash bands of a text and rows of each: two texts of similarity 0.8 share one of 14 bands of 4 with probability 0.9994.
BANDS, ROWS = 14, 4
#: Members, and bytes of texts, of a shard that one task searches or verifies, about; a larger shard is cut into pairs of parts.
SHARD_MEMBERS, VERIFIED_MEMBERS, SHARD_BYTES = 4096, 1024, 32 << 20


@dataclass(frozen=True)
class Similarity:
    """Near copies by similarity of word shingles rather than by a narrow radius.

    At Jaccard similarity 0.8 of two shingle sets, the vectors' angle makes a fingerprint
    bit differ with probability 0.15, so about 10 of 64 bits differ, and 20 at most in 999
    of 1,000 pairs. No choice of equal blocks can shard such a radius; shards are bands of
    minhash values instead. A shard's BK-tree is searched with ``radius``, and a candidate
    link needs ``agreement`` of the minhash values too. Within the components of the
    candidates, two texts link if they share a band and the exact Jaccard similarity of
    their shingle sets is ``jaccard`` or more.
    """

    shingle: int = 5
    radius: int = 20
    agreement: float = 0.6
    jaccard: float = 0.8


_random = np.random.default_rng(SEED)
_MULTIPLIERS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints, band keys (n, BANDS) and sketches (n, BANDS * ROWS) - a byte of each minhash - of texts' sets of shingle hashes."""
    prints = np.array([fingerprint(h) for h in hashes], np.int64)
    least = np.zeros((len(hashes), BANDS * ROWS), np.uint64)
    filled = np.array([i for i, h in enumerate(hashes) if len(h)], np.int64)
    if len(filled):
        starts = np.cumsum([0, *(len(hashes[i]) for i in filled[:-1])])
        joined = np.concatenate([hashes[i] for i in filled])
        for j, multiplier in enumerate(_MULTIPLIERS):
            least[filled, j] = np.minimum.reduceat(joined * multiplier, starts)
    mixed = (least ^ (least >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    keys = np.zeros((len(hashes), BANDS), np.uint64)
    for j in range(ROWS):
        keys = keys * np.uint64(0xBF58476D1CE4E5B9) + mixed[:, j::ROWS]
    return prints, keys.astype(np.int64), (mixed >> np.uint64(56)).astype(np.uint8)


def _sharded(met: DataFrame, group: list[str], carried: list[str]) -> DataFrame:
    """(members): arrays of the ``carried`` of each group of ``met`` (node, parts, ...).

    Each pair of a large group's parts is a shard of its own, dealt by an exchange of its own, so that no task holds
    more than two parts at once and a large group's pairs go to all tasks.
    """
    own = F.pmod(F.xxhash64("node", *group), F.col("parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    dealt = met.withColumn("own", own).withColumn("other", other).select(*group, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), F.struct(*carried).alias("m"))
    shard = [*group, "low", "high"]
    # Few bytes, much work: a fixed number of partitions, which adaptive execution does not join to few.
    return dealt.repartition(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), *shard).groupBy(*shard).agg(F.collect_list("m").alias("members")).where(F.size("members") > 1)


def exact_forest(sets: list[np.ndarray], keys: np.ndarray, least: float) -> np.ndarray:
    """For each sorted set the first of its component; two sets link if they share a band key and ``least`` of their union.

    A set is compared only with those not reached yet, so a group of near copies takes a round for each member that
    reaches others, not all pairs.
    """
    root, sizes = np.full(len(sets), -1), np.array([len(x) for x in sets])
    places = keys.tolist()
    by_key: dict[tuple[int, int], list[int]] = {}
    for i, own in enumerate(places):
        for band in enumerate(own):
            by_key.setdefault(band, []).append(i)
    for first in range(len(sets)):
        if root[first] >= 0:
            continue
        root[first] = first
        waiting = [first]
        while waiting:
            at = waiting.pop()
            near: set[int] = set()
            for band in enumerate(places[at]):
                left = [i for i in by_key[band] if root[i] < 0]
                by_key[band] = left
                near.update(left)
            near_at = np.array(sorted(near), np.int64)
            # The smaller set's share of the larger bounds the similarity.
            near_at = near_at[np.minimum(sizes[near_at], sizes[at]) >= least * np.maximum(sizes[near_at], sizes[at])]
            near_at = near_at[sizes[near_at] > 0]
            if not len(near_at) or not sizes[at]:
                continue
            joined = np.concatenate([sets[i] for i in near_at])
            place = np.minimum(np.searchsorted(sets[at], joined), sizes[at] - 1)
            both = np.add.reduceat((sets[at][place] == joined).astype(np.int64), np.r_[0, np.cumsum(sizes[near_at])[:-1]])
            reached = near_at[both >= least * (sizes[near_at] + sizes[at] - both)]
            root[reached] = first
            waiting.extend(reached.tolist())
    return root


def candidate_links(distinct: DataFrame, how: Similarity) -> DataFrame:
    """Candidate links (a, b) that span the components of ``distinct`` (node, fingerprint, keys, sketch)."""
    banded = distinct.select("node", "fingerprint", "sketch", F.posexplode("keys").alias("band", "key"))
    sizes = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    met = banded.join(sizes.select("band", "key", F.ceil(F.col("members") / SHARD_MEMBERS).alias("parts")), ["band", "key"])
    shards = _sharded(met, ["band", "key"], ["node", "fingerprint", "sketch"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column(0)
            flat, offsets = members.flatten(), np.asarray(members.offsets)
            offsets = offsets - offsets[0]
            nodes, prints = flat.field("node").to_numpy(), flat.field("fingerprint").to_numpy()
            sketches = np.frombuffer(b"".join(flat.field("sketch").to_pylist()), np.uint8).reshape(len(prints), -1)
            out = [shard_forest(prints[a:b], how.radius, sketches[a:b], how.agreement, nodes[a:b]) for a, b in itertools.pairwise(offsets.tolist())]
            a, b = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return shards.select("members").mapInArrow(search, "a long, b long")


def similar_links(docs: DataFrame, distinct: DataFrame, how: Similarity) -> DataFrame:
    """Links (a, b) of exact similarity that span the components of ``distinct`` (node, first, fingerprint, keys, sketch).

    Of ``docs`` (doc_id, text, digest) only the texts that stand for a candidate travel, and their shingles are made
    anew where they meet: a text is smaller than its set of shingles.
    """
    found = connected_components(candidate_links(distinct, how))
    met = staged(found.join(distinct.select("node", "first", "keys", "bytes", "repeated"), "node"), "near-candidates")
    sizes = met.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.sum("bytes").alias("bytes"))
    parts = F.ceil(F.greatest(F.col("members") / VERIFIED_MEMBERS, F.col("bytes") / SHARD_BYTES)).cast("long")
    dealt = met.drop("bytes").join(sizes.select("component", F.greatest(F.lit(1), parts).alias("parts")), "component")
    wanted = dealt.select("node", "component", "parts", "keys", F.col("first.doc_id").alias("__id__"), F.col("first.digest").alias("__digest__"))
    count, repeated = met.agg(F.count(F.lit(1)), F.max("repeated")).first()
    near = KeyFilter(met.select("first.doc_id", "first.digest"), ["doc_id", "digest"], count)
    texts = near.flagged(docs, [F.col("doc_id"), F.col("digest")], "may").where("may")
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("__id__")) & (F.col("digest") == F.col("__digest__")))
    if repeated:
        texts = texts.dropDuplicates(["node"])
    shards = _sharded(texts.withColumn("text", F.col("text").cast("binary")), ["component"], ["node", "keys", "text"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column(0)
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i in range(batch.num_rows):
                own = members[i].values
                nodes = own.field("node").to_numpy()
                sets = [np.unique(shingle_hashes(text.as_py(), how.shingle)) for text in own.field("text")]
                root = exact_forest(sets, own.field("keys").flatten().to_numpy().reshape(-1, BANDS), how.jaccard)
                tied = root != np.arange(len(root))
                a.append(nodes[tied])
                b.append(nodes[root[tied]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return staged(shards.select("members").mapInArrow(verify, "a long, b long"), "near-links")


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, digest of the text): what makes a document here."""
    return docs.select("doc_id", F.col("text").alias("text"), _text_digest().alias("digest"))


def _text_digest() -> Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def _documents(docs: DataFrame, how: Similarity) -> DataFrame:
    """(doc_id, digest, rows, node, fingerprint, keys, sketch, bytes): one row of each id and text, and the number of rows that have both."""
    bounded_batches(docs)
    rows = _keyed(docs).select("doc_id", F.col("text").cast("binary").alias("text"), "digest")
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "digest", "node", "fingerprint", "keys", "sketch", "bytes"]

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = batch.column(1).to_pylist()
                sets = [np.unique(shingle_hashes(text, how.shingle)) for text in texts]
                nodes = np.array([xxhash.xxh64_intdigest(own.tobytes(), SEED) for own in sets], np.uint64).astype(np.int64)
                prints, keys, sketches = signatures(sets)
                lists = pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * BANDS, pa.array(keys.ravel()))
                sizes = pa.array([len(text or b"") for text in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(nodes), pa.array(prints), lists, pa.array([x.tobytes() for x in sketches], pa.binary()), sizes], names)

    made = rows.mapInArrow(signed, f"doc_id {kind}, digest string, node long, fingerprint long, keys array<long>, sketch binary, bytes long")
    return staged(made.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("rows"), *(F.any_value(n).alias(n) for n in names[2:])), "signatures")


def _nodes(documents: DataFrame) -> DataFrame:
    """(node, first, repeated, fingerprint, keys, sketch, bytes): the distinct sets of shingles with the first document that has each.

    First is the smallest id, null ids being the largest, and of its texts the one with the smallest digest.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first")
    held = [F.any_value(n).alias(n) for n in ("fingerprint", "keys", "sketch", "bytes")]
    return staged(documents.groupBy("node").agg(first, (F.max("rows") > 1).alias("repeated"), *held), "signature-groups")


def similar_groups(docs: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """As ``near_dedup``, (doc_id, fingerprint as long, component_id) by similarity; texts of one set of shingles are one.

    Fingerprints are those of the distinct shingles, so that a repeated line doesn't outvote the rest of a text.
    """
    documents = _documents(docs, how)
    distinct = _nodes(documents)
    links = similar_links(_keyed(docs), distinct, how)
    rows = documents.select("doc_id", "fingerprint", "node", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).drop("col")
    return _labelled(rows, distinct.select("node", F.col("first.doc_id").alias("first")), links, "node").drop("node")


def fingerprint_rows(docs: DataFrame, shingle: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fingerprint as long) of each row."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1).to_pylist(), shingle))], ["doc_id", "fingerprint"])

    return rows.mapInArrow(hashed, f"doc_id {kind}, fingerprint long")


def near_dedup(docs: DataFrame, shingle: int = 3, radius: int = 2, blocks: int = 8) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 lowercase hex digits), component_id.

    component_id is the smallest doc_id reachable over links, itself included. Texts
    without words - null, empty, white space - have fingerprint zero and link like any
    other; a text of fewer words than a shingle is one shingle. Null ids don't count as
    smallest; a component of null ids only has a null id. Repeated rows each get their
    row. Other columns are ignored; an empty table gives no rows.
    """
    rows = staged(fingerprint_rows(docs, shingle), "fingerprints")
    distinct = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    found = _labelled(rows, distinct, near_links(distinct.select("fingerprint"), radius, blocks))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def _labelled(rows: DataFrame, distinct: DataFrame, links: DataFrame, node: str = "fingerprint") -> DataFrame:
    """``rows`` (doc_id, ``node``) with the smallest id of their component; ``distinct`` holds each node's first id."""
    labels = connected_components(links)
    grouped = distinct.join(labels.withColumnRenamed("node", node), node, "left")
    grouped = grouped.withColumn("component", F.coalesce("component", node))
    smallest = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    found = staged(grouped.join(smallest, "component").select(node, "component_id"), "near-groups")
    return rows.join(found, node)


def one_of_each_group(docs: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stand for their group of near copies: one of each group.

    It is the row with the smallest id, null ids being the largest, and of those the one with the smallest digest of
    its text. Rows with a null id, or with one id but texts of different groups, are documents of their own. A null
    text is an empty one; texts without words are one group; an empty table gives no rows. Texts of any length are
    taken whole.
    """
    documents = _documents(docs, how)
    distinct = _nodes(documents)
    labels = connected_components(similar_links(_keyed(docs), distinct, how))
    component = F.coalesce("component", "node").alias("component")
    groups = distinct.select("node", "first").join(labels, "node", "left").select(component, "first")
    first = staged(groups.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("__id__"), F.col("first.digest").alias("__digest__")), "near-first")
    same = F.col("doc_id").eqNullSafe(F.col("__id__")) & (F.col("digest") == F.col("__digest__"))
    # Rows are removed by what goes, not chosen by what stays: usually that is less.
    names = [F.col("doc_id").alias("__id__"), F.col("digest").alias("__digest__")]
    going = staged(documents.join(first, same, "left_anti").select(*names), "near-going")
    repeated = staged(documents.where("rows > 1").join(first, same, "left_semi").select(*names), "near-repeated")
    removed(documents, distinct)
    keyed = docs.select(F.struct("*").alias("__row__"), "doc_id", _text_digest().alias("digest"))

    def apart(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
        flagged = KeyFilter(keys, ["__id__", "__digest__"], keys.count()).flagged(rows, [F.col("doc_id"), F.col("digest")], "may")
        return flagged.where("NOT may").drop("may"), flagged.where("may").drop("may")

    sure, perhaps = apart(keyed, going)
    kept = sure.unionByName(perhaps.join(going, same, "left_anti"))
    if not repeated.isEmpty():
        single, several = apart(kept, repeated)
        kept = single.unionByName(several.join(repeated, same, "left_anti")).unionByName(several.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "digest"]))
    return kept.select("__row__.*")
