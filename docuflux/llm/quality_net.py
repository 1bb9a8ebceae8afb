"""Quality classifier: a convolutional network over bytes, trained in numpy.

Learned filters of `WIDE` bytes run over the embedded bytes of a whole text. A text is covered by
overlapping chunks of `CHUNK` positions, `STRIDE` apart; a chunk keeps each filter's largest
answer and the logarithm of its positions, from which a hidden layer makes the chunk's logit.
The logits of all chunks become one probability by a logistic fit over their mean and their
least. Answers are made once a position: a chunk's are the larger ones of two blocks.

Training picks chunks of both labels evenly and cuts some short, so that little variety in a
short text is not taken for repetition. The model is fitted on at most `SAMPLE` labelled rows,
those of least digest of their id, and `SAMPLE_BYTES` of their texts; scoring covers all rows and
all bytes. Only the text is an input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, kept_rows, text_slices

SAMPLE, SAMPLE_BYTES = 4000, 32 << 20
CHUNK, STRIDE, WIDE = 256, 128, 6
EMBED, FILTERS, HIDDEN = 6, 32, 24
#: Chunks of each label a step, optimiser steps, and the share of chunks cut short.
EVEN, STEPS, SHORT = 64, 400, 0.25
#: Blocks convolved at a time; the probability from which a text is predicted good.
TOGETHER, GOOD = 64, 0.7


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Blocks:
    """Texts in one array of bytes. A text of n bytes has n - WIDE + 1 positions (one if shorter, none
    if empty) in blocks of STRIDE, and a chunk for each two blocks that follow each other."""

    def __init__(self, texts: list):
        texts = [t or b"" for t in texts]
        self.positions = np.array([max(len(t) - WIDE + 1, min(len(t), 1)) for t in texts], np.int64)
        self.count = np.maximum(1, -(-self.positions // STRIDE))
        areas = (self.count + 1) * STRIDE  # the last block's filters read beyond it
        ends = np.cumsum(areas)
        self.bytes = np.zeros((int(ends[-1]) if len(texts) else 0) + CHUNK, np.uint8)
        for text, start in zip(texts, ends - areas, strict=True):
            self.bytes[start : start + len(text)] = np.frombuffer(text, np.uint8)
        owner = np.repeat(np.arange(len(texts)), self.count)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        self.starts = (ends - areas)[owner] + inside * STRIDE
        self.held = np.clip(self.positions[owner] - inside * STRIDE, 0, STRIDE)
        # chunks: each block but a text's last one, if it has another
        self.first = np.flatnonzero((inside < self.count[owner] - 1) | (self.count[owner] == 1))
        self.owner = owner[self.first]
        self.second = self.first + (self.count[self.owner] > 1)
        self.size = np.minimum(CHUNK, self.positions[self.owner] - inside[self.first] * STRIDE)

    def rows(self, starts: np.ndarray, positions: int) -> np.ndarray:
        """The bytes that filters read at so many positions from each start."""
        return self.bytes[starts[:, None] + np.arange(positions + WIDE - 1)]


class Network:
    def __init__(self, seed: int = 13):
        rng = np.random.default_rng(seed)
        scaled = lambda n, *shape: (rng.standard_normal(shape) / np.sqrt(n)).astype(np.float32)
        self.p = {
            "embed": scaled(4, 256, EMBED), "filters": scaled(WIDE * EMBED / 2, WIDE * EMBED, FILTERS), "shift": np.zeros(FILTERS, np.float32),
            "hidden": scaled(FILTERS, FILTERS + 1, HIDDEN), "hb": np.zeros(HIDDEN, np.float32), "out": scaled(HIDDEN, HIDDEN), "ob": np.zeros(1, np.float32),
        }

    def answers(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What filters answer at each position of rows of bytes, and what they read there."""
        x = self.p["embed"][rows]
        n, at = len(rows), rows.shape[1] - WIDE + 1
        read = np.lib.stride_tricks.as_strided(x, (n, at, WIDE * EMBED), (x.strides[0], x.strides[1], x.strides[2])).reshape(n * at, WIDE * EMBED)
        return (read @ self.p["filters"]).reshape(n, at, FILTERS), read

    def largest(self, rows: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Each filter's largest answer at the first `held` positions; -inf without positions."""
        found = self.answers(rows)[0]
        part = np.flatnonzero(held < found.shape[1])
        if len(part):
            found[part] = np.where((np.arange(found.shape[1]) < held[part, None])[:, :, None], found[part], -np.inf)
        return found.max(1)

    def logits(self, largest: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self.head(largest, size)[0]

    def head(self, largest: np.ndarray, size: np.ndarray):
        z = np.concatenate([np.maximum(largest + self.p["shift"], 0), np.log1p(size)[:, None] / 6], 1).astype(np.float32)
        h = np.maximum(z @ self.p["hidden"] + self.p["hb"], 0)
        return h @ self.p["out"] + self.p["ob"][0], z, h

    def gradients(self, rows: np.ndarray, size: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss of chunks."""
        n, each = len(rows), np.arange(len(rows))
        found, read = self.answers(rows)
        found = np.where((np.arange(found.shape[1]) < size[:, None])[:, :, None], found, -np.inf)
        at = found.argmax(1)
        logits, z, h = self.head(np.take_along_axis(found, at[:, None], 1)[:, 0], size)
        d = ((sigmoid(logits) - labels) / n).astype(np.float32)
        g = {"out": h.T @ d, "ob": np.array([d.sum()])}
        d_h = d[:, None] * self.p["out"] * (h > 0)
        g["hidden"], g["hb"] = z.T @ d_h, d_h.sum(0)
        d_z = (d_h @ self.p["hidden"].T)[:, :FILTERS] * (z[:, :FILTERS] > 0)
        g["shift"], g["filters"], d_x = d_z.sum(0), np.empty_like(self.p["filters"]), np.zeros((*rows.shape, EMBED), np.float32)
        read = read.reshape(n, -1, WIDE * EMBED)
        for f in range(FILTERS):  # only the place of the largest answer learns
            g["filters"][:, f] = read[each, at[:, f]].T @ d_z[:, f]
            back = (d_z[:, f, None] * self.p["filters"][:, f]).reshape(n, WIDE, EMBED)
            for j in range(WIDE):
                d_x[each, at[:, f] + j] += back[:, j]
        g["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(g["embed"], rows.ravel(), d_x.reshape(-1, EMBED))
        return g


def line(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and offset of a logistic fit with a small penalty towards halves, by Newton's steps."""
    rows, aim = np.concatenate([x, np.ones((len(x), 1))], 1), np.append(np.full(x.shape[1], 0.5), 0.0)
    w, firm = aim.copy(), np.diag([1.0] * x.shape[1] + [1e-3])
    for _ in range(50):
        p = sigmoid(rows @ w)
        w = w - np.clip(np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + firm, rows.T @ (p - y) + firm @ (w - aim)), -1, 1)
    return w


class Model:
    """Without rows of both labels the score is the same for all texts: the labels' mean, or 0."""

    def __init__(self, texts: list, labels: list[int], seed: int = 13):
        y = np.array(labels, float)
        self.constant = float(y.mean()) if len(y) else 0.0
        self.ready = 0 < y.sum() < len(y)
        if not self.ready:
            return
        rng, self.network, blocks = np.random.default_rng(seed), Network(seed), Blocks(texts)
        # a text is picked, then one of its chunks
        begin, kinds = np.searchsorted(blocks.owner, np.arange(len(y) + 1)), [np.flatnonzero(y == label) for label in (0, 1)]
        moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.network.p.items()}
        for step in range(1, STEPS + 1):
            own = np.concatenate([rng.choice(kind, EVEN) for kind in kinds])
            pick = rng.integers(begin[own], begin[own + 1])
            size = np.where(rng.random(len(pick)) < SHORT, np.minimum(rng.integers(1, CHUNK, len(pick)), blocks.size[pick]), blocks.size[pick])
            grads = self.network.gradients(blocks.rows(blocks.starts[blocks.first[pick]], CHUNK), size, y[own].astype(np.float32))
            rate = 0.01 * (1 - step / STEPS) + 0.0005
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                self.network.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        self.line = line(self.summaries(blocks), y)

    def chunk_logits(self, blocks: Blocks) -> np.ndarray:
        largest = [self.network.largest(blocks.rows(blocks.starts[i : i + TOGETHER], STRIDE), blocks.held[i : i + TOGETHER]) for i in range(0, len(blocks.starts), TOGETHER)]
        largest = np.concatenate(largest)
        return self.network.logits(np.maximum(largest[blocks.first], largest[blocks.second]), blocks.size)

    def summaries(self, blocks: Blocks) -> np.ndarray:
        """The mean and the least chunk logit of each text, within 10 of 0."""
        logits = np.clip(self.chunk_logits(blocks).astype(np.float64), -10, 10)
        begin = np.searchsorted(blocks.owner, np.arange(len(blocks.count)))
        return np.stack([np.add.reduceat(logits, begin) / np.diff(np.append(begin, len(logits))), np.minimum.reduceat(logits, begin)], 1)

    def scores(self, texts: list) -> np.ndarray:
        if not self.ready or not len(texts):
            return np.full(len(texts), self.constant)
        return np.round(sigmoid(self.summaries(Blocks(texts)) @ self.line[:-1] + self.line[-1]), 6)


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of at most `sample` labelled rows that are not held out."""
    # of labels that repeat the lower holds
    marks = labels.filter("quality is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_mark"))
    known = docs.select("doc_id", F.encode(F.col("text").cast("string"), "UTF-8").alias("text")).filter(~held_out(F.col("doc_id")) & F.col("text").isNotNull()).join(marks, F.col("doc_id") == F.col("_id"))
    # the ids come first, so that the texts of so many rows are all that is sorted and sent
    ids = known.select(F.col("doc_id").alias("_pick")).distinct().orderBy(F.md5(F.col("_pick").cast("string"))).limit(sample)
    rows = known.join(F.broadcast(ids), F.col("doc_id") == F.col("_pick"), "left_semi")
    # of rows that share an id the text of least digest
    rows = rows.groupBy("doc_id").agg(F.min_by(F.struct("text", "_mark"), F.md5("text")).alias("r")).orderBy(F.md5(F.col("doc_id").cast("string")))
    texts, marked, taken = [], [], 0
    for r in rows.select("r.*").toLocalIterator():
        taken += len(r.text)
        if texts and taken > SAMPLE_BYTES:
            break
        texts.append(bytes(r.text))
        marked.append(int(r["_mark"]))
    return Model(texts, marked)


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """For each row of docs: doc_id, held_out, score, predicted.

    docs: doc_id, text; labels: doc_id, quality; further columns are ignored. Rows whose
    crc32(doc_id) mod 4 is 2 are never learned from. Null and empty texts are scored as texts of no
    bytes; null labels, ids and texts teach nothing. Rows that repeat give a row each, an empty
    table none. Without labels of both kinds the score is their mean, or 0.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, sample))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(sent.value.scores(texts))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = arrow_map(docs.select("doc_id", F.encode(F.col("text").cast("string"), "UTF-8").alias("text")), work, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def without_poor(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs whose score is `GOOD` or more, in one pass; all columns stay."""
    sent = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, sample))
    return kept_rows(docs, lambda: lambda texts: (sent.value.scores(texts) >= GOOD).tolist())
