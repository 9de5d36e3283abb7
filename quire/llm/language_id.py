"""Language identification by a byte convolutional network.

The network reads fixed-length windows of bytes: filters of several widths slide over
them, each filter's largest response in the window goes through a rectifier, and a softmax
over a linear layer gives the languages' probabilities. It is trained in numpy, on the
driver, on a bounded sample of labelled texts; all windows of every whole text are then
read by it, and a text's scores are its windows' mean probabilities, weighted by how much
of a window is text.

A filter's response to a byte string is a sum over places of one number per byte class,
so a filter bank is a set of lookup tables; for reading, tables of two neighbouring places
are added up once into tables over pairs, which gives the same sums with half the lookups.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import bounded_batches, id_crc

UNDETERMINED = "und"
_letter = re.compile(r"[^\W\d_]")
_fold = bytes(c + 32 if 65 <= c <= 90 else (32 if c in b"\t\n\v\f\r" else (48 if 48 <= c <= 57 else c)) for c in range(256))


@dataclass(frozen=True)
class Settings:
    """Of the network and its training.

    ``per_language`` and ``sample`` bound the labelled rows it is fitted on: of each language
    and in all. All languages are learned; with very many, fewer rows of each, one at least.
    """

    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    classes: int = 64
    per_language: int = 1500
    sample: int = 60_000
    pieces: int = 3
    steps: int = 700
    batch: int = 128
    rate: float = 0.02
    seed: int = 7


@dataclass
class Network:
    labels: list[str]
    settings: Settings
    byte_class: np.ndarray
    tables: list[np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def __post_init__(self) -> None:
        c = self.settings.classes
        #: For each width: (table over pairs of classes at places 2i, 2i+1 ...), then a single one if the width is odd.
        self.pairs = []
        for table in self.tables:
            w = len(table)
            self.pairs.append([(table[i][:, None, :] + table[i + 1][None, :, :]).reshape(c * c, -1) for i in range(0, w - 1, 2)])

    def features(self, windows: np.ndarray) -> np.ndarray:
        """Largest filter responses of windows of byte classes (n, window)."""
        n, c = len(windows), self.settings.classes
        wide = windows.astype(np.int32)
        pair = wide[:, :-1] * c + wide[:, 1:]
        out = []
        for table, pairs in zip(self.tables, self.pairs, strict=True):
            w = len(table)
            places = windows.shape[1] - w + 1
            response = None
            for i, sums in enumerate(pairs):
                part = np.take(sums, pair[:, 2 * i : 2 * i + places], axis=0)
                response = part if response is None else np.add(response, part, out=response)
            if w & 1:
                part = np.take(table[w - 1], wide[:, w - 1 : w - 1 + places], axis=0)
                response = part if response is None else np.add(response, part, out=response)
            out.append(response.max(axis=1))
        return np.concatenate(out, axis=1).reshape(n, -1)

    def probabilities(self, windows: np.ndarray, at_once: int = 64) -> np.ndarray:
        out = np.empty((len(windows), len(self.labels)), np.float32)
        for at in range(0, len(windows), at_once):
            hidden = np.maximum(self.features(windows[at : at + at_once]) + self.bias, 0)
            scores = hidden @ self.weights + self.offset
            scores -= scores.max(axis=1, keepdims=True)
            np.exp(scores, out=scores)
            out[at : at + at_once] = scores / scores.sum(axis=1, keepdims=True)
        return out


def windows_of(texts: list[str], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all windows (n, window), the text each belongs to, and its bytes of text; the last window of a text is padded."""
    data = [text.encode().translate(_fold) for text in texts]
    counts = np.array([max(1, -(-len(d) // window)) for d in data], np.int64)
    joined = b"".join(d.ljust(n * window) for d, n in zip(data, counts.tolist(), strict=True))
    owner = np.repeat(np.arange(len(data)), counts)
    lengths = np.full(len(owner), window, np.int64)
    last = np.cumsum(counts) - 1
    lengths[last] = [len(d) - (n - 1) * window for d, n in zip(data, counts.tolist(), strict=True)]
    return np.frombuffer(joined, np.uint8).reshape(-1, window), owner, lengths


def train(samples: list[tuple[str, str]], settings: Settings = Settings()) -> Network:
    """Fits a network to (text, label) pairs. Reruns agree: the order of samples does not matter."""
    samples = sorted(samples)
    labels = sorted({label for _, label in samples})
    windows, owner, lengths = windows_of([text for text, _ in samples], settings.window)
    number = {label: i for i, label in enumerate(labels)}
    target = np.array([number[label] for _, label in samples], np.int64)[owner] if samples else np.empty(0, np.int64)
    frequent = np.argsort(-np.bincount(windows.ravel(), minlength=256), kind="stable")[: settings.classes - 1]
    byte_class = np.full(256, settings.classes - 1, np.uint8)
    byte_class[frequent] = np.arange(len(frequent))
    rng = np.random.default_rng(settings.seed)
    f, k, c = settings.filters, len(labels), settings.classes
    tables = [rng.normal(0, 0.3, (w, c, f)).astype(np.float32) for w in settings.widths]
    hidden = f * len(settings.widths)
    net = Network(labels, settings, byte_class, tables, np.zeros(hidden, np.float32), rng.normal(0, 0.1, (hidden, k)).astype(np.float32), np.zeros(k, np.float32))
    if k < 2:
        return net
    data = byte_class[windows]
    by_label = [np.flatnonzero(target == i) for i in range(k)]
    params = [*net.tables, net.bias, net.weights, net.offset]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, settings.steps + 1):
        # Every language is equally frequent in a batch, whatever the sample holds.
        chosen = np.concatenate([rng.choice(rows, -(-settings.batch // k)) for rows in by_label])
        x, y = data[chosen].astype(np.int64), target[chosen]
        n = len(chosen)
        peaks, tops = [], []
        for table in net.tables:
            w = len(table)
            places = settings.window - w + 1
            response = table[0][x[:, :places]]
            for i in range(1, w):
                response = response + table[i][x[:, i : i + places]]
            peak = response.argmax(axis=1)
            peaks.append(peak)
            tops.append(np.take_along_axis(response, peak[:, None, :], axis=1)[:, 0])
        raw = np.concatenate(tops, axis=1) + net.bias
        h = np.maximum(raw, 0)
        scores = h @ net.weights + net.offset
        scores -= scores.max(axis=1, keepdims=True)
        p = np.exp(scores)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), y] -= 1
        p /= n
        back = (p @ net.weights.T) * (raw > 0)
        grads = []
        for b, (table, peak) in enumerate(zip(net.tables, peaks, strict=True)):
            part = back[:, b * f : (b + 1) * f]
            grad = np.zeros_like(table)
            for i in range(len(table)):
                at = x[np.arange(n)[:, None], peak + i]
                np.add.at(grad[i], (at, np.arange(f)[None, :]), part)
            grads.append(grad)
        grads += [back.sum(axis=0), h.T @ p + 1e-4 * net.weights, p.sum(axis=0)]
        rate = settings.rate * (1 - step / (settings.steps + 1))
        for param, grad, m, v in zip(params, grads, first, second, strict=True):
            m *= 0.9
            m += 0.1 * grad
            v *= 0.99
            v += 0.01 * grad * grad
            param -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return Network(labels, settings, byte_class, net.tables, net.bias, net.weights, net.offset)


def predict(net: Network, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Label and score of each whole text; ``und`` and 0 for a text that is null or has no letter, or where nothing was learned."""
    kept = [i for i, text in enumerate(texts) if net.labels and text and _letter.search(text)]
    langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    for at in range(0, len(kept), 256):
        part = kept[at : at + 256]
        windows, owner, lengths = windows_of([texts[i] for i in part], net.settings.window)
        shares = net.probabilities(net.byte_class[windows]) * lengths[:, None]
        total = np.zeros((len(part), len(net.labels)))
        np.add.at(total, owner, shares)
        total /= total.sum(axis=1, keepdims=True)
        best = total.argmax(axis=1)
        for i, b, row in zip(part, best.tolist(), total, strict=True):
            langs[i], scores[i] = net.labels[b], float(row[b])
    return langs, scores


def held_out(id_column: str = "doc_id"):
    return id_crc(id_column) % 4 == 2


def labelled_sample(docs: DataFrame, settings: Settings = Settings()) -> list[tuple[str, str]]:
    """A bounded number of rows of each language, drawn by a hash of id, text and label; of each row some pieces of its text.

    Rows that are held out, or have no label or text, are never in it. Rows that are equal
    in all three count once, and null or shared ids don't tie rows together.
    """
    hashed = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text", "lang"), F.lit(1 << 40))
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("lang", "text", hashed.alias("h"))
    found = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("rows")).collect()
    if not found:
        return []
    most = max(1, min(settings.per_language, settings.sample // len(found)))
    # Somewhat more are drawn, for the counts are near, and the surplus goes: by the hash again.
    share = F.try_element_at(F.create_map(*(F.lit(v) for row in found for v in (row["lang"], min(1.0, (1.2 * most + 20) / row["rows"])))), F.col("lang"))
    size = settings.window
    starts = [F.pmod(F.xxhash64("h", F.lit(i)), F.greatest(F.lit(1), F.length("text") - size + 1)).cast("int") + 1 for i in range(settings.pieces)]
    texts = F.array_distinct(F.array(*(F.substring("text", start, F.lit(size)) for start in starts)))
    picked = rows.where(F.col("h") < share * float(1 << 40)).select("lang", "h", texts.alias("texts")).groupBy("lang", "h").agg(F.min("texts").alias("texts"))
    by_lang: dict[str, list] = {}
    for row in picked.toLocalIterator():
        by_lang.setdefault(row.lang, []).append((row.h, row.texts))
    return [(text, lang) for lang, got in by_lang.items() for _, texts in sorted(got)[:most] for text in texts]


def add_predictions(docs: DataFrame, net: Network, columns: list[str], lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``columns`` of ``docs`` and the prediction for each row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    rows = docs.select(*columns, F.col("text").alias("__text__"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = predict(shared.value, batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*columns, lang, score])

    fields = [rows.schema[c] for c in columns] + [T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())]
    return rows.mapInArrow(read, T.StructType(fields))


def identify(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    Fitted on ``labelled_sample`` of the same table; id, label and source are no inputs of
    a prediction. Nulls: a null or letterless text is ``und`` with score 0; a null label is
    not learned from; a null id counts as the empty text in the held-out rule. Texts of any
    length are read whole; of languages with equal scores the first in code-point order is
    given. Repeated rows are predicted each and alike; other columns are ignored; an empty
    table, or one without labels, is not predicted (no rows, or all ``und``).
    """
    net = train(labelled_sample(docs, settings), settings)
    return add_predictions(docs, net, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def with_known_language(docs: DataFrame, least_score: float, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is determined with at least that score.

    Null, empty and letterless texts have no language and go; a null id or label does not matter, repeated rows stay or
    go together, texts of any length are read whole, and an empty table gives no rows. ``least_score`` is compared with
    the score's place between that of a guess among the learned languages, 0, and certainty, 1, so that it means the
    same for any number of languages; where only one was learned, letters suffice.
    """
    bounded_batches(docs)
    net = train(labelled_sample(docs, settings), settings)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    guess = 1 / max(1, len(net.labels))
    least = guess + (1 - guess) * least_score if len(net.labels) > 1 else 0.0

    place = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = predict(shared.value, batch.column(place).to_pylist())
            yield batch.filter(pa.array([lang != UNDETERMINED and score >= least for lang, score in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
