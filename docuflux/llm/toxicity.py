"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and
word inputs, trained in numpy; a text's score is that of its worst window.

A word's inputs are a hashed word embedding, the mean of hashed embeddings of its character
4-grams, and statistics of both from the training rows: log odds of the word, and the highest and
mean log odds of its 4-grams (leave-one-out for the training rows themselves). Windows of `WIDTH`
words follow each other `STRIDE` words apart, so that they overlap and cover every whole text.
Training picks, each round, the worst window of each row (a toxic text need not be toxic
throughout) and another one of clean rows. A final logistic fit on the rows' worst windows
makes 0.5 the likelier-toxic line.

The model is fitted on at most `SAMPLE` labelled rows, those of least digest of their id, and
`SAMPLE_BYTES` of their texts; scoring covers all rows. Only the text is an input.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, kept_rows, text_slices

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SAMPLE, BATCH = 4000, 256
#: Bytes of texts that a fit takes; the rest of the sample is left out.
SAMPLE_BYTES = 64 << 20
#: Optimiser steps whatever the number of rows, and how often the worst windows are picked anew.
STEPS, ROUNDS = 120, 6
WIDTH, STRIDE = 64, 48
HIDDEN, EMBED, STATS = 8, 6, 4
WORD_ROWS, GRAM_ROWS, ODDS_ROWS = 1 << 12, 1 << 12, 1 << 18
#: Windows that a fit scores at a time.
CHUNK = 2048
#: Windows scored at a time, new words looked up at a time, and words remembered by a worker; they bound what it holds.
SCORED, FRESH, KEPT = 512, 1 << 14, 1 << 16


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall((text or b"").lower())


class Words:
    """Hashes of distinct words and of their 4-grams, in one flat array."""

    def __init__(self, words: list[bytes]):
        raw = np.frombuffer(b"".join([b"\x02" + w + b"\x03\x03\x03" for w in words]), np.uint8).astype(np.uint64)
        sizes = np.array([len(w) + 4 for w in words], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        with np.errstate(over="ignore"):
            rolled = np.zeros(max(0, len(raw) - 3), np.uint64)
            for j in range(4):
                rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + raw[j : j + len(rolled)] + np.uint64(1)
            rolled ^= rolled >> np.uint64(29)
            rolled *= np.uint64(0xBF58476D1CE4E5B9)
            # the whole word: sum of its bytes times powers of an odd number by place
            place = (np.arange(len(raw)) - np.repeat(starts, sizes)).astype(np.uint64)
            whole = np.add.reduceat((raw + np.uint64(17)) * (place * np.uint64(2) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) ^ (raw << (place % np.uint64(50))), starts) if len(words) else np.zeros(0, np.uint64)
            whole = (whole ^ (whole >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        self.sizes = sizes - 3  # grams of each word
        keep = np.repeat(starts, self.sizes) + np.arange(self.sizes.sum()) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.grams = (rolled[keep] >> np.uint64(40)).astype(np.int64)
        self.words = (whole >> np.uint64(40)).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    smooth = 1.0
    return np.log((toxic + smooth) / (n_toxic + 2 * smooth)) - np.log((clean + smooth * n_clean / max(1.0, n_toxic)) / (n_clean + 2 * smooth * n_clean / max(1.0, n_toxic)))


class Odds:
    """Log odds of hashed words and 4-grams by the share of rows that hold them."""

    def __init__(self, rows: list[np.ndarray], words: Words, labels: np.ndarray):
        self.n = np.array([(labels == 1).sum(), (labels == 0).sum()], float)
        self.word, self.gram = np.zeros((2, ODDS_ROWS)), np.zeros((2, ODDS_ROWS))
        for row, label in zip(rows, labels, strict=True):
            own = np.unique(row) - 1
            at = 0 if label == 1 else 1
            self.word[at][np.unique(words.words[own] % ODDS_ROWS)] += 1
            parts = np.repeat(words.starts[own], words.sizes[own]) + np.arange(words.sizes[own].sum()) - np.repeat(np.cumsum(words.sizes[own]) - words.sizes[own], words.sizes[own])
            self.gram[at][np.unique(words.grams[parts] % ODDS_ROWS)] += 1

    def tables(self, left_out: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log odds by hash of words and of 4-grams. left_out: 1 or 0 takes one row of that label away."""
        n, word, gram = self.n.copy(), self.word, self.gram
        if left_out is not None:
            at = 0 if left_out == 1 else 1
            n[at] -= 1
            less = lambda x: [np.maximum(0, x[i] - (i == at)) for i in (0, 1)]
            word, gram = less(word), less(gram)
        return log_odds(word[0], word[1], *n), log_odds(gram[0], gram[1], *n)

    def stats(self, words: Words, left_out: int | None = None, tables: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """STATS columns for each word, by tables() or those given."""
        by_word, by_gram = tables or self.tables(left_out)
        of_gram = by_gram[words.grams % ODDS_ROWS]
        out = np.zeros((len(words.words), STATS), np.float32)
        if len(words.words):
            out[:, 0] = by_word[words.words % ODDS_ROWS]
            out[:, 1] = np.maximum.reduceat(of_gram, words.starts)
            out[:, 2] = np.add.reduceat(of_gram, words.starts) / words.sizes
            out[:, 3] = np.minimum(words.sizes, 20) / 20
        return np.clip(out, -4, 4)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def windows_of(n: int) -> list[tuple[int, int]]:
    """(start, end) of the overlapping windows that cover n words; none of 0 words."""
    starts = range(0, max(1, n - WIDTH + STRIDE), STRIDE) if n else ()
    return [(s, min(n, s + WIDTH)) for s in starts]


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        size, wide = EMBED * 2 + STATS, 3 * HIDDEN
        scaled = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {
            "word": scaled(WORD_ROWS, EMBED) * 0.1, "gram": scaled(GRAM_ROWS, EMBED) * 0.1,
            "wf": scaled(size, wide), "wb": scaled(size, wide), "uf": scaled(HIDDEN, wide), "ub": scaled(HIDDEN, wide),
            "bf": np.zeros(wide, np.float32), "bb": np.zeros(wide, np.float32),
            "a": scaled(2 * HIDDEN, HIDDEN), "ab": np.zeros(HIDDEN, np.float32), "av": scaled(HIDDEN, 1)[:, 0],
            "o": scaled(2 * HIDDEN, 1)[:, 0], "ob": np.full(1, -1, np.float32),
        }

    def inputs(self, words: Words, stats: np.ndarray) -> np.ndarray:
        if not len(words.words):
            return np.zeros((0, EMBED * 2 + STATS), np.float32)
        grams = np.add.reduceat(self.p["gram"][words.grams % GRAM_ROWS], words.starts) / words.sizes[:, None]
        return np.concatenate([self.p["word"][words.words % WORD_ROWS], grams, stats], 1).astype(np.float32)

    def projected(self, inputs: np.ndarray) -> np.ndarray:
        """Gate inputs of both directions for each word; row 0 stands for padding."""
        table = np.concatenate([inputs @ self.p["wf"] + self.p["bf"], inputs @ self.p["wb"] + self.p["bb"]], 1)
        return np.concatenate([np.zeros((1, table.shape[1]), np.float32), table]).astype(np.float32)

    def run(self, x: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: bool):
        """One direction. x: steps, batch, 3 HIDDEN; mask: steps, batch, 1."""
        h, out, kept = np.zeros((x.shape[1], HIDDEN), np.float32), np.empty((*x.shape[:2], HIDDEN), np.float32), []
        for t in range(len(x)):
            g = h @ u
            zr = sigmoid(x[t, :, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(x[t, :, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
            new = h + mask[t] * (1 - z) * (c - h)
            if keep:
                kept.append((h, z, r, c, g[:, 2 * HIDDEN :]))
            out[t] = h = new
        return out, kept

    def forward(self, table: np.ndarray, ids: np.ndarray, keep: bool = False):
        """Logits of windows. ids: steps, batch; 0 pads."""
        mask = (ids > 0).astype(np.float32)[:, :, None]
        x = table[ids]
        f, kf = self.run(x[:, :, : 3 * HIDDEN], mask, self.p["uf"], keep)
        b, kb = self.run(x[::-1, :, 3 * HIDDEN :], mask[::-1], self.p["ub"], keep)
        both = np.concatenate([f, b[::-1]], 2)
        s = np.tanh(both @ self.p["a"] + self.p["ab"])
        e = np.where(mask[:, :, 0] > 0, s @ self.p["av"], -1e9)
        e = np.exp(e - e.max(0))
        weight = e / e.sum(0)
        pooled = (both * weight[:, :, None]).sum(0)
        return pooled @ self.p["o"] + self.p["ob"][0], (mask, kf, kb, both, s, weight, pooled) if keep else None

    def run_back(self, d_out, mask, kept, u):
        d_u, d_x, d_h = np.zeros_like(u), np.empty((*d_out.shape[:2], 3 * HIDDEN), np.float32), np.zeros(d_out.shape[1:], np.float32)
        for t in range(len(d_out) - 1, -1, -1):
            h, z, r, c, gc = kept[t]
            d = d_out[t] + d_h
            m = mask[t]
            d_c = d * m * (1 - z) * (1 - c * c)
            d_z = -d * m * (c - h) * z * (1 - z)
            d_r = d_c * gc * r * (1 - r)
            d_x[t] = np.concatenate([d_z, d_r, d_c], 1)
            d_g = np.concatenate([d_z, d_r, d_c * r], 1)
            d_u += h.T @ d_g
            d_h = d * (1 - m * (1 - z)) + d_g @ u.T
        return d_x, d_u

    def gradients(self, words: Words, inputs: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        """Gradients of the mean log loss. words, inputs: of the batch's distinct words."""
        p, n = self.p, len(labels)
        logits, (mask, kf, kb, both, s, weight, pooled) = self.forward(self.projected(inputs), ids, True)
        d = ((sigmoid(logits) - labels) / n).astype(np.float32)
        g = {"o": pooled.T @ d, "ob": np.array([d.sum()])}
        d_pooled = d[:, None] * p["o"]
        d_both = weight[:, :, None] * d_pooled
        d_weight = (both * d_pooled).sum(2)
        d_e = weight * (d_weight - (weight * d_weight).sum(0))
        g["av"] = np.einsum("tbh,tb->h", s, d_e)
        d_s = d_e[:, :, None] * p["av"] * (1 - s * s)
        flat = d_s.reshape(-1, HIDDEN)
        g["a"], g["ab"] = both.reshape(-1, 2 * HIDDEN).T @ flat, flat.sum(0)
        d_both = d_both + d_s @ p["a"].T
        d_xf, g["uf"] = self.run_back(d_both[:, :, :HIDDEN], mask, kf, p["uf"])
        d_xb, g["ub"] = self.run_back(d_both[::-1, :, HIDDEN:], mask[::-1], kb, p["ub"])
        d_xb = d_xb[::-1]
        summed = np.zeros((len(inputs) + 1, 6 * HIDDEN), np.float32)
        np.add.at(summed, ids.ravel(), np.concatenate([d_xf, d_xb], 2).reshape(-1, 6 * HIDDEN))
        summed = summed[1:]
        half = 3 * HIDDEN
        g["wf"], g["wb"] = inputs.T @ summed[:, :half], inputs.T @ summed[:, half:]
        g["bf"], g["bb"] = summed[:, :half].sum(0), summed[:, half:].sum(0)
        d_in = summed[:, :half] @ p["wf"].T + summed[:, half:] @ p["wb"].T
        g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        np.add.at(g["word"], words.words % WORD_ROWS, d_in[:, :EMBED])
        np.add.at(g["gram"], words.grams % GRAM_ROWS, np.repeat(d_in[:, EMBED : 2 * EMBED] / words.sizes[:, None], words.sizes, 0))
        return g

    def window_logits(self, table: np.ndarray, ids: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        """ids: windows, WIDTH; in chunks, the shorter ones together."""
        lengths = (ids > 0).sum(1)
        order, out = np.argsort(lengths, kind="stable"), np.empty(len(ids), np.float32)
        for i in range(0, len(ids), chunk):
            part = order[i : i + chunk]
            out[part] = self.forward(table, ids[part, : max(1, lengths[part].max())].T)[0]
        return out


def window_rows(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Padded windows of all rows' word ids, and each window's row."""
    spans = [(k, s, e) for k, row in enumerate(rows) for s, e in windows_of(len(row))]
    ids = np.zeros((len(spans), WIDTH), np.int64)
    for i, (k, s, e) in enumerate(spans):
        ids[i, : e - s] = rows[k][s:e]
    return ids, np.array([k for k, _, _ in spans], np.int64)


def numbered(texts: list) -> tuple[list[np.ndarray], list[bytes]]:
    """Texts as ids from 1 of their distinct words."""
    place: dict[bytes, int] = {}
    rows = [np.array([place.setdefault(w, len(place) + 1) for w in words_of(t)], np.int64) for t in texts]
    return rows, list(place)


class Model:
    """odds: Odds; network: Network; line: slope and offset of the final fit. Without rows of both
    labels the score is the same for all texts."""

    def __init__(self, texts: list, labels: list[int], seed: int = 7):
        y = np.array(labels, float)
        self.constant = float(y.mean()) if len(y) else 0.0
        self.ready = 0 < y.sum() < len(y)
        if not self.ready:
            return
        rng = np.random.default_rng(seed)
        rows, names = numbered(texts)
        words = Words(names)
        self.odds, self.network = Odds(rows, words, y), Network(seed)
        stats = [self.odds.stats(words, label) for label in (0, 1)]
        ids, owner = window_rows(rows)
        by_label = y[owner].astype(np.int64)
        moments = {k: [np.zeros_like(v, np.float64), np.zeros_like(v, np.float64)] for k, v in self.network.p.items()}
        step = 0
        for turn in range(ROUNDS + 1):
            if turn:
                logits = self.logits(words, stats, ids, by_label)
            else:  # before training, the mean of the highest word statistics
                sums = np.array([stats[label][w[w > 0] - 1, :2].sum(1).max() for label, w in zip(by_label, ids, strict=True)])
                logits = sums
            worst = worst_windows(logits, owner, len(rows))
            if turn == ROUNDS:
                break
            pick = worst[worst >= 0]
            clean = np.flatnonzero(by_label == 0)
            pick = np.concatenate([pick, rng.choice(clean, min(len(clean), len(pick)))])
            # few rows are seen more often, and each picked row once at least
            until = step + max(STEPS // ROUNDS, -(-len(pick) // BATCH))
            while step < until:
                rng.shuffle(pick)
                for i in range(0, len(pick), BATCH)[: until - step]:
                    step += 1
                    self._learn(words, stats, ids[pick[i : i + BATCH]], by_label[pick[i : i + BATCH]], moments, step)
        held = worst >= 0
        self.line = fitted_line(np.where(held, logits[np.maximum(worst, 0)], -8.0), y)

    def logits(self, words, stats, ids, by_label) -> np.ndarray:
        out = np.empty(len(ids), np.float32)
        for label in (0, 1):
            own = np.flatnonzero(by_label == label)
            out[own] = self.network.window_logits(self.network.projected(self.network.inputs(words, stats[label])), ids[own])
        return out

    def _learn(self, words: Words, stats, ids, labels, moments, step) -> None:
        # a word has one input row for each label it is met under
        tagged = np.where(ids > 0, ids * 2 + labels[:, None], 0)
        distinct, back = np.unique(tagged, return_inverse=True)
        back = back.reshape(tagged.shape)
        if distinct[0] == 0:
            distinct = distinct[1:]
        else:
            back = back + 1
        of = distinct // 2 - 1
        part = Words.__new__(Words)
        part.words, part.sizes = words.words[of], words.sizes[of]
        part.starts = np.cumsum(part.sizes) - part.sizes
        part.grams = words.grams[np.repeat(words.starts[of], part.sizes) + np.arange(part.sizes.sum()) - np.repeat(part.starts, part.sizes)]
        own = np.where((distinct % 2 == 1)[:, None], stats[1][of], stats[0][of])
        grads = self.network.gradients(part, self.network.inputs(part, own), back.T, labels.astype(np.float32))
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
        for k, g in grads.items():
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.002 * (g * g - v)
            rate = 0.002 if k in ("word", "gram") else 0.02
            self.network.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.998**step)) + 1e-8)).astype(np.float32)


def worst_windows(logits: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The window of highest logit of each row, the first of equal ones; -1 without windows."""
    out = np.full(n, -1, np.int64)
    order = np.lexsort((-np.arange(len(logits)), logits, owner))
    out[owner[order]] = order
    return out


def fitted_line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit with a small penalty, by Newton's steps."""
    w = np.array([1.0, 0.0])
    rows = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = sigmoid(rows @ w)
        grad = rows.T @ (p - y) + np.array([0.1 * (w[0] - 1), 0.0])
        hess = (rows * (p * (1 - p))[:, None]).T @ rows + np.diag([0.1, 1e-3])
        move = np.linalg.solve(hess, grad)
        w = w - np.clip(move, -1, 1)
    return float(max(w[0], 0.05)), float(w[1])


class Scorer:
    """Scores texts with a model; remembers the gate inputs of words it has met."""

    def __init__(self, model: Model):
        self.model, self.place, self.table = model, {}, None
        self.odds = model.odds.tables() if model.ready else None

    def scores(self, texts: list) -> np.ndarray:
        model = self.model
        if not model.ready:
            return np.full(len(texts), model.constant)
        if len(self.place) > KEPT:
            self.place = {}
        place, first = self.place, len(self.place)
        rows = []
        for text in texts:
            rows.append(np.array([place.setdefault(w, len(place) + 1) for w in words_of(text)], np.int64))
        # words are kept in the order in which they came, the newest last
        fresh = list(islice(reversed(place), len(place) - first))[::-1]
        if not first:
            self.table = np.zeros((len(place) + 1, 6 * HIDDEN), np.float32)
        elif len(place) >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(len(place) + 1 - len(self.table), len(self.table) // 2), 6 * HIDDEN), np.float32)])
        for i in range(0, len(fresh), FRESH):
            words = Words(fresh[i : i + FRESH])
            more = model.network.projected(model.network.inputs(words, model.odds.stats(words, tables=self.odds)))[1:]
            self.table[first + 1 + i : first + 1 + i + len(more)] = more
        ids, owner = window_rows(rows)
        out = np.full(len(texts), -8.0)
        if len(ids):
            logits = model.network.window_logits(self.table, ids, SCORED)
            worst = worst_windows(logits, owner, len(texts))
            out[worst >= 0] = logits[worst[worst >= 0]]
        slope, offset = model.line
        return sigmoid(slope * out + offset)


def _worker(sent):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch, texts in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(np.round(scorer.scores(texts).astype(np.float64), 6))], ["doc_id", "score"]
            )

    return work


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of at most `sample` labelled rows that are not held out."""
    # of labels that repeat the higher holds
    marks = labels.filter("toxic is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    known = docs.select("doc_id", F.encode("text", "UTF-8").alias("text")).filter(~held_out(F.col("doc_id")) & F.col("text").isNotNull()).join(marks, F.col("doc_id") == F.col("_id"))
    # the ids come first, so that the texts of so many rows are all that is sorted and sent
    ids = known.select(F.col("doc_id").alias("_pick")).distinct().orderBy(F.md5(F.col("_pick").cast("string"))).limit(sample)
    rows = known.join(F.broadcast(ids), F.col("doc_id") == F.col("_pick"), "left_semi").select("doc_id", "text", "_toxic")
    # of rows that share an id the text of least digest; the driver takes texts up to SAMPLE_BYTES
    rows = rows.groupBy("doc_id").agg(F.min_by(F.struct("text", "_toxic"), F.md5("text")).alias("r")).select("doc_id", "r.*")
    held, texts = 0, []
    for r in rows.orderBy(F.md5(F.col("doc_id").cast("string"))).toLocalIterator():
        held += len(r.text)
        if texts and held > SAMPLE_BYTES:
            break
        texts.append((r.doc_id, bytes(r.text), int(r["_toxic"])))
    texts.sort(key=lambda r: r[:2])
    return Model([t for _, t, _ in texts], [y for *_, y in texts])


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """For each row of docs: doc_id, held_out, score, predicted.

    docs: doc_id, text; labels: doc_id, toxic; further columns are ignored. Rows whose
    crc32(doc_id) mod 5 is 0 are never learned from. Null and empty texts are scored as texts
    without words; null labels and null ids teach nothing. Rows that repeat give a row each, an
    empty table none. Without labels of both kinds the score is their mean, or 0.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, sample))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = arrow_map(docs.select("doc_id", F.encode("text", "UTF-8").alias("text")), _worker(sent), f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs without the rows scored 0.5 or higher, in one pass; all columns stay."""
    sent = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, sample))

    def keep():
        scorer = Scorer(sent.value)
        return lambda texts: (np.round(scorer.scores(texts).astype(np.float64), 6) < 0.5).tolist()

    return kept_rows(docs, keep)
